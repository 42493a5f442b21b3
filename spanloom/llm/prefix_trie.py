"""The trie of conversations' shared prefixes, and totals of its subtrees by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import blocks, running
from .shared import save, small

#: Every conversation begins with up to MOST_SHARED turns of the first of its GROUP.
GROUP, MOST_SHARED = 20, 3
#: A component of so many nodes is worked off in one task; larger ones are split at their centroids by joins.
LOCAL = 20_000
#: Ids of one chunk of a digest's input.
_CHUNK = 4096


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("bigint")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's prefixes (conv, depth, k, l, h, g, words), one row for each of its turns after rebuilding; and all conversations (conv).

    ``k, l`` stand for the first ``depth`` turns: 128 bits, the exclusive or of what each turn hashes to at its
    place, ``h, g``; so the prefix without the last turn is ``k ^ h, l ^ g``. Turns of one conversation are
    ordered by number (null first), role and then the text's MD5; repeated rows are turns of their own. Rows without a conv_id are of
    none. No task holds a conversation: numbers and prefixes are running values in two levels.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"), F.md5(F.concat(role, F.lit("\n"), F.md5(text.cast("binary"))).cast("binary")).alias("mark"), F.md5(text.cast("binary")).alias("tie"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    dealt = blocks(turns, ["conv"], ["turn", "role", "tie"])
    turns = save(running(dealt, ["conv"], ["turn", "role", "tie"], {"n": ("sum", F.lit(1).cast("bigint"))}).select("conv", "n", "mark", "words", "_block", "_tie"), "turns")
    lengths = turns.groupBy("conv").agg(F.max("n").alias("length"))
    convs = lengths.select("conv", (F.col("conv") - F.col("conv") % GROUP).alias("first"), shared_turns(F.col("conv")).alias("shared"), "length")
    heads = turns.where(F.col("n") <= MOST_SHARED).select(F.col("conv").alias("first"), F.col("n").alias("depth"), "mark", "words")
    taken = convs.join(heads, "first").where("depth <= shared").select("conv", "depth", "mark", "words")
    h, g = F.xxhash64(F.lit("k"), F.col("depth"), F.col("mark")), F.xxhash64(F.col("mark"), F.lit("l"), F.col("depth"))
    # at most three rows a conversation
    entry = F.struct("depth", h.alias("h"), g.alias("g"), "words")
    given = taken.groupBy("conv").agg(F.array_sort(F.collect_list(entry)).alias("given"))
    mixed = lambda upto, name: F.aggregate(F.slice("given", 1, upto), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y[name]))
    begun = given.select("conv", F.posexplode("given").alias("at", "e"), "given").select("conv", "e.depth", mixed(F.col("at") + 1, "h").alias("k"), mixed(F.col("at") + 1, "g").alias("l"), "e.h", "e.g", "e.words")
    # what is joined to rows of hot keys is a table, not a sum over the same keys: so Spark can split a key's rows among tasks
    known = convs.join(given, "conv", "left").select("conv", "shared", F.coalesce(F.size("given"), F.lit(0)).alias("size"), *(F.when(F.col("given").isNotNull(), mixed(F.size("given"), c)).otherwise(F.lit(0)).alias(f"base_{c}") for c in ("h", "g")))
    kept = turns.join(save(known, "known"), "conv").where("n > shared").withColumn("depth", F.col("n") - F.col("shared") + F.col("size")).withColumns({"h": h, "g": g})
    kept = save(kept.select("conv", "depth", "h", "g", "words", "base_h", "base_g", "_block", "_tie"), "kept")
    chained = running(kept, ["conv"], ["depth"], {"own_h": ("xor", F.col("h")), "own_g": ("xor", F.col("g"))})
    later = chained.select("conv", "depth", F.col("base_h").bitwiseXOR(F.col("own_h")).alias("k"), F.col("base_g").bitwiseXOR(F.col("own_g")).alias("l"), "h", "g", "words")
    return save(begun.unionByName(later), "prefixes"), convs.select("conv")


def paths(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes from the root to each conversation's end: (conv, depth, top, up, ends, words).

    A node is called (top, depth): ``top`` is its smallest conversation, ``up`` its parent's. The root, of depth 0,
    is on every path. ``ends`` marks a path's last node.
    """
    root = convs.agg(F.min("conv")).first()[0]
    tops = save(prefixes.groupBy("depth", "k", "l").agg(F.min("conv").alias("top")), "tops")
    named = prefixes.join(tops, ["depth", "k", "l"]).select("conv", "depth", "top", "words")
    roots = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("top"), F.lit(0).cast("bigint").alias("words"))
    steps = save(named.unionByName(roots), "steps")
    above = steps.select("conv", (F.col("depth") + 1).alias("depth"), F.col("top").alias("up"))
    below = steps.select("conv", (F.col("depth") - 1).alias("depth"), F.lit(False).alias("ends"))
    linked = steps.join(above, ["conv", "depth"], "left").join(below, ["conv", "depth"], "left")
    return save(linked.select("conv", "depth", "top", "up", F.coalesce("ends", F.lit(True)).alias("ends"), "words"), "paths")


def nodes(paths: DataFrame) -> DataFrame:
    """One row a node: (top, depth, up, n_convs, n_children, words, size), ``size`` the number of nodes in its subtree.

    A conversation is the smallest of the nodes at the end of its path, from some depth on; each path adds to a node how many
    of those lie at or under it.
    """
    own = paths.groupBy("conv").agg(F.max("depth").alias("length"), F.sum((F.col("top") != F.col("conv")).cast("bigint")).alias("others"))
    own = save(own, "own")
    at_or_under = F.greatest(F.col("length") + 1 - F.greatest("others", "depth"), F.lit(0))
    each = paths.join(own, "conv").groupBy("top", "depth").agg(F.min("up").alias("up"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.sum(at_or_under).alias("size"))
    each = save(each, "nodes")
    children = each.where("up is not null").groupBy(F.col("up").alias("top"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return each.join(children, ["top", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))


def rollup(forest: DataFrame, paths: DataFrame, values: Sequence[str], local: int = LOCAL) -> DataFrame:
    """``forest`` (top, depth, up, size, and ``values`` to be added up) with the values' totals over each node's subtree.

    A component's centroid is its deepest node with half of the component at or under it. The component's part at
    and under the centroid is totalled: that is the centroid's own total, and is added to every node on the way from it
    to the component's top. Then each child's part and the rest are components of their own, of half the nodes at most. Components
    of more than ``local`` nodes are split by joins, all at once in a round, so rounds are as many as halvings
    down to ``local``; smaller ones are gathered, and split on in one task. Every node becomes a centroid once, and what it
    gets before comes from parts that were cut off under it.
    """
    key = ["head", "head_depth"]
    start = forest.where("up is null").agg(F.max("top"), F.max("size")).first()
    state = forest.select("top", "depth", "up", "size", *values, *(F.lit(0).cast("bigint").alias(f"_{v}") for v in values), F.lit(start[0]).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("head_depth"), F.lit(start[1]).cast("bigint").alias("total"))
    state, finished = save(state, "forest"), []
    while state.where(F.col("total") > local).limit(1).count():
        large, rest = state.where(F.col("total") > local), state.where(F.col("total") <= local)
        half = large.where(2 * F.col("size") >= F.col("total")).groupBy(*key).agg(F.max(F.struct("depth", "top", "size")).alias("c"))
        centroids = save(half.select(*key, F.col("c.top").alias("c_top"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "centroids")
        # the child that each path takes at a centroid, and the sizes of the children
        kids = large.join(small(centroids.select(*key, F.col("c_top").alias("up"), (F.col("c_depth") + 1).alias("depth")), 64), [*key, "up", "depth"]).select("top", "depth", F.col("size").alias("kid_size"))
        passing = paths.join(small(centroids.select(*key, F.col("c_top").alias("up"), (F.col("c_depth") + 1).alias("depth")), 64), ["up", "depth"]).join(kids, ["top", "depth"])
        passing = passing.select(*key, F.col("conv").alias("top"), F.col("top").alias("kid"), "kid_size")
        placed = large.join(small(centroids, 96), key).join(passing, [*key, "top"], "left")
        itself, under = (F.col("top") == F.col("c_top")) & (F.col("depth") == F.col("c_depth")), F.col("kid").isNotNull() & (F.col("depth") > F.col("c_depth"))
        placed = save(placed.withColumns({"itself": itself, "under": under}), "placed")
        sums = placed.where("itself or under").groupBy(*key).agg(*(F.sum(v).alias(f"sum_{v}") for v in values))
        cut = save(centroids.join(sums, key), "cut")
        way = paths.join(small(cut.withColumnRenamed("c_top", "conv"), 128), "conv").where("depth >= head_depth and depth < c_depth")
        way = way.select(*key, "top", "depth", F.col("c_size").alias("less"), *(f"sum_{v}" for v in values))
        moved = placed.where("not itself").join(way, [*key, "top", "depth"], "left")
        gained = lambda v: F.col(f"_{v}") + F.coalesce(f"sum_{v}", F.lit(0))
        moved = moved.select("top", "depth", "up", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), *values, *(gained(v).alias(f"_{v}") for v in values), F.when(F.col("under"), F.col("kid")).otherwise(F.col("head")).alias("head"), F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("head_depth")).alias("head_depth"), F.when(F.col("under"), F.col("kid_size")).otherwise(F.col("total") - F.col("c_size")).alias("total"))
        done = placed.where("itself").join(cut.select(*key, *(f"sum_{v}" for v in values)), key)
        finished.append(done.select("top", "depth", *(gained(v).alias(f"_{v}") for v in values)))
        state = save(moved.unionByName(rest.select(moved.columns)), "forest")
    kinds = "top long, depth long, " + ", ".join(f"_{v} long" for v in values)
    out = state.repartition(*key).sortWithinPartitions(*key, "depth").mapInArrow(_local_totals(tuple(values)), kinds)
    for part in finished:
        out = out.unionByName(part)
    return forest.drop(*values).join(out.select("top", "depth", *(F.col(f"_{v}").alias(v) for v in values)), ["top", "depth"])


def component_totals(parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals (one row a node) of a forest by centroid decomposition, all components of a level at once.

    ``parent`` is -1 at tops, nodes come with parents before children, ``size`` counts nodes at and under each.
    """
    n, whole, size = len(parent), size, size.copy()
    # preorder places: a node's descendants stand behind it, one child's after the other's
    first, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    siblings = np.argsort(parent, kind="stable")
    starts = np.cumsum(whole[siblings]) - whole[siblings]
    edges = np.flatnonzero(np.diff(parent[siblings], prepend=-2))
    first[siblings] = starts - np.repeat(starts[edges], np.diff(np.append(edges, n)))
    for k, above in enumerate(parent.tolist()):
        if above >= 0:
            first[k] += first[above] + 1
            depth[k] = depth[above] + 1
    tops = np.flatnonzero(parent < 0)
    group, totals, out = np.searchsorted(first[tops], first, "right") - 1, whole[tops], np.zeros_like(values)
    alive = np.lexsort((first, group))
    while len(alive):
        g = group[alive]
        half = alive[2 * size[alive] >= totals[g]]
        order = np.lexsort((depth[half], group[half]))
        last = np.flatnonzero(np.append(np.diff(group[half][order]) != 0, True))
        middle = np.full(len(totals), -1)
        middle[group[half][order][last]] = half[order][last]
        c = middle[g]
        inside = (first[alive] >= first[c]) & (first[alive] < first[c] + whole[c])
        on_way = (first[alive] <= first[c]) & (first[c] < first[alive] + whole[alive]) & (alive != c)
        sums = np.zeros((len(totals), values.shape[1]), values.dtype)
        np.add.at(sums, g[inside], values[alive[inside]])
        found = middle[middle >= 0]
        out[found] += sums[group[found]]
        out[alive[on_way]] += sums[g[on_way]]
        less = np.zeros(len(totals), np.int64)
        less[group[found]] = size[found]
        size[alive[on_way]] -= less[g[on_way]]
        under = alive[inside & (alive != c)]
        head = parent[under] == middle[group[under]]
        group[under] = len(totals) + np.cumsum(head) - 1
        totals = np.concatenate((totals - less, size[under[head]]))
        alive = alive[alive != c]
        alive = alive[np.lexsort((first[alive], group[alive]))]
        used, group_of = np.unique(group[alive], return_inverse=True)
        group[alive], totals = group_of, totals[used]
    return out


def _local_totals(values: tuple[str, ...]):
    """Totals of whole components, as they come sorted; some 50,000 nodes at once, which is more than one component has."""

    def work(parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        top, depth, up, head, head_depth, size = (t.column(c).to_numpy() for c in ("top", "depth", "up", "head", "head_depth", "size"))
        order = np.argsort(depth, kind="stable")
        place = {k: i for i, k in enumerate(zip(top[order].tolist(), depth[order].tolist(), strict=True))}
        inner = (top != head) | (depth != head_depth)
        above = np.nan_to_num(up[order], nan=0).astype(np.int64).tolist()
        parent = np.array([place[u, d - 1] if x else -1 for u, d, x in zip(above, depth[order].tolist(), inner[order].tolist(), strict=True)], np.int64)
        given = np.column_stack([t.column(v).to_numpy() for v in values])[order].astype(np.int64)
        before = np.column_stack([t.column(f"_{v}").to_numpy() for v in values])[order].astype(np.int64)
        found = before + component_totals(parent, size[order].astype(np.int64), given)
        return pa.RecordBatch.from_arrays([pa.array(top[order]), pa.array(depth[order]), *(pa.array(found[:, k]) for k in range(len(values)))], ["top", "depth", *(f"_{v}" for v in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            head, head_depth = t.column("head").to_numpy(), t.column("head_depth").to_numpy()
            edges = np.flatnonzero((np.diff(head) != 0) | (np.diff(head_depth) != 0)) + 1
            if held:
                if (held[-1].column("head")[-1].as_py(), held[-1].column("head_depth")[-1].as_py()) != (head[0], head_depth[0]):
                    edges = np.append(0, edges)
                if sum(map(len, held)) + len(t) >= 50_000 and len(edges):
                    yield work([*held, t.slice(0, edges[-1])])
                    held, t = [], t.slice(edges[-1])
            held.append(t)
        if held:
            yield work(held)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined chunks, as they come sorted; only the running digest is held."""
    names, node, state = ["top", "depth", "ends_sha256"], None, None
    for batch in batches:
        out: list[tuple] = []
        for top, depth, text in zip(*(batch.column(c).to_pylist() for c in ("top", "depth", "text")), strict=True):
            if (top, depth) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (top, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names)


def end_digests(paths: DataFrame) -> DataFrame:
    """(top, depth, ends_sha256) of nodes where conversations end: the digest of their ids in ascending order.

    Ids are joined in chunks of their own range, which tasks share; a digest then runs over a node's chunks, of which a task
    holds one at a time.
    """
    ends = paths.where("ends").select("top", "depth", "conv", F.floor(F.col("conv") / _CHUNK).alias("part"))
    chunks = ends.groupBy("top", "depth", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    return chunks.repartition("top", "depth").sortWithinPartitions("top", "depth", "part").select("top", "depth", "text").mapInArrow(_digests, "top long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row for each distinct sequence of first turns of rebuilt conversations, the root (no turn) included.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the smallest
    conversation of a node, its parent's, how many begin like it, childless nodes and words saved by writing shared
    turns once in its subtree, and the digest of those that end with it. Null roles and texts count as empty, rows without a conv_id are
    not read, repeated rows are turns of their own, other columns are ignored; no rows give no nodes.
    """
    prefixes, convs = rebuilt(conversations)
    found = paths(prefixes, convs)
    each = save(nodes(found), "trie")
    if not each.limit(1).count():
        empty = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        return conversations.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in empty) + ", ends_sha256 string")
    forest = each.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    summed = rollup(forest, found, ("n_leaves", "saved_tokens"), local)
    full = summed.join(end_digests(found), ["top", "depth"], "left")
    return full.select(F.col("top").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
