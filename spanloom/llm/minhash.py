"""Near-duplicate documents by min-max hashing with banding, verified on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import drop, save, small, unused
from .text import LOWER, Words, mix, shingle_sets, slices, utf8

#: 24 bands of 4 values: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**24, all but 3 in a million.
BANDS, ROWS = 24, 4
#: Bytes kept of a shingle's hash where sets are compared.
KEPT_BYTES = 6
#: Members of a bucket of several components up to which all pairs across them are confirmed.
SMALL_BUCKET = 16


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One band hash per set and band, from minimum and maximum under each of bands * rows / 2 permutations."""
    n = bands * rows // 2
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flat, heads = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    values = np.empty((2 * n, len(sets)), np.uint64)
    for k in range(n):
        hashed = flat * a[k] + b[k]
        hashed ^= hashed >> np.uint64(32)
        hashed *= a[n - 1 - k]
        values[2 * k] = np.minimum.reduceat(hashed, heads)
        values[2 * k + 1] = np.maximum.reduceat(hashed, heads)
    # a band takes its values from distinct permutations, so that a minimum and its own maximum don't meet in one
    order = np.concatenate((np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2)))
    out = np.empty((len(sets), bands), np.int64)
    for k in range(bands):
        h = np.full(len(sets), k + 1, np.uint64)
        for v in values[order[k * rows : (k + 1) * rows]]:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + v)
        out[:, k] = h.view(np.int64)
    return out


def sketches(sets: list[np.ndarray], bands: int, rows: int) -> dict[str, pa.Array]:
    """Size, two digests and band hashes of each set; an empty one has no digest and no bands."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    digest, digest2, band = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), np.zeros((len(sets), bands), np.int64)
    if len(full):
        own = [sets[k] for k in full]
        flat, heads, low = np.concatenate(own), np.cumsum(size[full]) - size[full], np.uint64((1 << 63) - 1)
        digest[full] = (np.bitwise_xor.reduceat(mix(flat + np.uint64(11)), heads) & low).view(np.int64)
        digest2[full] = (np.add.reduceat(flat, heads) & low).view(np.int64)
        band[full] = signatures(own, bands, rows)
    empty = size == 0
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(empty, 0, bands))), pa.int32()), pa.array(band[~empty].ravel()))
    return {"n_shingles": pa.array(size), "digest": pa.array(digest, mask=empty), "digest2": pa.array(digest2), "bands": lists}


def packed(sets: list[np.ndarray]) -> pa.Array:
    """Each set's hashes, KEPT_BYTES of each in a row."""
    return pa.array([np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :]).tobytes() for s in sets], pa.binary())


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = utf8(batch.column("text"))
                words = Words(LOWER[data], offsets)
                found = sketches(shingle_sets(words, words.hashes(), shingle), bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *found.values()], ["id", *found])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = utf8(batch.column("text"))
                words = Words(LOWER[data], offsets)
                sets = shingle_sets(words, words.hashes(), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int32()), packed(sets)], ["id", "n", "shingles"])

    return run


def _unpack(raw: bytes) -> np.ndarray:
    cells = np.zeros((len(raw) // KEPT_BYTES, 8), np.uint8)
    cells[:, :KEPT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT_BYTES)
    return cells.view(np.uint64).ravel()


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last = [], (None, None)
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if last[0] is None or not last[0].equals(y):
                    last = (y, _unpack(y))
                left, right = _unpack(x), last[1]
                both = len(left) + len(right) - len(np.unique(np.concatenate((left, right))))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct
    ``shingle``-word shingles (A-Z lower-cased, words apart by ASCII white space); component_id
    is the smallest id reachable over links. A text of fewer words is one shingle; null or
    empty text has none, is linked with nothing and gets its own id. Rows with one id are one
    document: a link of any of its texts counts. A null id is never linked and gets a null
    component. Other columns of ``docs`` are not read, so their names can't clash.

    Documents with equal sets are joined first, by the set's digest, and only one of each such
    class goes on. Band collisions link each member of a bucket with the bucket's smallest id;
    these links are confirmed on full sets. Where a bucket still has members of different
    components, pairs across components (never those within one) are confirmed too: all of
    them in a small bucket, and in a larger one those that an exact prefix filter leaves. Every join is an
    equi-join that adaptive execution may split; no bucket is gathered in a task.
    """
    key, texts = docs.schema[id].dataType.simpleString(), docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sketch = save(texts.mapInArrow(_sketch(shingle, bands, rows), SKETCH.format(key)), "sketch")
    nodes = linked(sketch, lambda wanted: texts.join(small(wanted, 16), "id", "left_semi").mapInArrow(_sets(shingle), f"id {key}, n int, shingles binary"), percent)
    return sketch.select("id", "n_shingles").join(nodes.select(F.col("node").alias("id"), "component"), "id", "left").select(F.col("id").alias(id), "n_shingles", F.coalesce("component", "id").alias("component_id"))


#: Columns of a sketch, with the type of its ids.
SKETCH = "id {}, n_shingles long, digest long, digest2 long, bands array<long>"


def linked(sketch: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, component) of the ids that have a link; ids are of any ordered type.

    sketch: a saved table of :func:`sketches` with ids; sets_of: gives the full sets (id, n,
    shingles) of a table of ids, in the form of :func:`packed`.
    """
    key = sketch.schema["id"].dataType.simpleString()
    usable = sketch.where("id is not null and n_shingles > 0")
    classes = usable.groupBy("n_shingles", "digest", "digest2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.min_by("bands", "id").alias("bands"))
    classes = save(classes, "classes")
    copies = usable.join(classes.where("rep <> last").select("n_shingles", "digest", "digest2", "rep"), ["n_shingles", "digest", "digest2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    member = classes.select(F.col("rep").alias("id"), "n_shingles", F.explode("bands").alias("bucket"))
    heads = member.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("tail"), F.min_by("n_shingles", "id").alias("n_head")).where("head <> tail").drop("tail")
    member = save(member.join(heads, "bucket"), "buckets")
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    wanted = member.select("id").distinct()
    sets = save(sets_of(wanted), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
        left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"shingles_{x}")) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").where(near)
        return save(both.mapInArrow(_confirm(percent), f"a {key}, b {key}").distinct(), "confirmed")

    stars = member.where(f"id <> head and 100 * least(n_shingles, n_head) >= {percent} * greatest(n_shingles, n_head)").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    linked = confirmed(stars)
    found = components(linked)
    placed = member.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y").select("bucket", "size")
    placed = save(placed.join(mixed, "bucket").select("bucket", "size", "id", "n_shingles", "head", "component"), "mixed")
    left, right = (placed.where(F.col("size") <= SMALL_BUCKET).select("bucket", "head", F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("component").alias(f"c_{x}")) for x in "ab")
    across = left.join(right.drop("head"), "bucket").where("a > b and b <> head and c_a <> c_b").where(near).select("a", "b")
    crowd = placed.where(F.col("size") > SMALL_BUCKET).select("id", "component").distinct()
    across = save(across.union(_across_components(sets.join(crowd, "id"), percent)).distinct(), "across")
    links = linked.union(confirmed(across)) if across.limit(1).count() else linked
    nodes = save(components(links.union(copies)), "components")
    for used in (classes, member, sets, placed, across):
        drop(used)
    return nodes


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            sets = [_unpack(x.as_buffer()) for x in part.column("shingles")]
            which = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(which) for c in ("id", "component", "n")), pa.array(np.concatenate(sets).view(np.int64))], ["id", "component", "n", "token"])


def _across_components(sets: DataFrame, percent: int) -> DataFrame:
    """:func:`across_components` of ``sets`` (id, component, n, shingles) with packed shingles."""
    key = sets.schema["id"].dataType.simpleString()
    return across_components(sets.mapInArrow(_tokens, f"id {key}, component {key}, n int, token long"), percent)


def across_components(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets, given as ``tokens`` (id, component, n, token) with a row for each of a set's n shingles, of different components that may reach ``percent``; none that does is missing.

    Prefix and position filter: with every set's shingles in one order, rare ones first, two sets
    that reach the threshold meet in a shingle p of the first such that both can still share
    enough behind p. A set thus meets only sets of sizes that its p allows: the join key is the shingle
    with both size classes. In a crowd of documents that differ from a common text in more and more
    rare places, those that reach nobody meet nobody.
    """
    tokens = save(tokens, "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"), F.min("component").alias("x"), F.max("component").alias("y"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "token")) - 1
    ranked = tokens.join(often, "token").withColumn("p", place).where("x <> y").drop("x", "y", "often")
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("p")) * (100 + percent) / percent) - F.col("n"))
    least = F.ceil(F.col("n") * percent / 100)
    size_class = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")
    keyed = ranked.withColumn("most", most).where(F.col("most") >= least).withColumn("own", size_class(F.col("n"))).withColumn("other", F.explode(F.sequence(size_class(least), size_class(F.col("most")))))
    keyed = keyed.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "component", "n", "p")
    mixed = keyed.groupBy("token", "low", "high").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").drop("x", "y")
    keyed = keyed.join(mixed, ["token", "low", "high"])
    left, right = (keyed.select("token", "low", "high", F.col("id").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab")
    reach = f"(100 + {percent}) * least(n_a - p_a, n_b - p_b) >= {percent} * (n_a + n_b)"
    pairs = left.join(right, ["token", "low", "high"]).where(f"a > b and c_a <> c_b and {reach} and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    out = save(pairs.select("a", "b").distinct(), "crowd")
    drop(tokens)
    return out


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near-duplicates: of each component only the smallest id stays.

    Rows that repeat a kept id stay repeated; rows with a null id, a null or an empty text stay; columns of
    any name stay as they are; an empty table gives no rows.
    """
    gone = near_duplicates(docs, id, text, shingle, percent).where(F.col(id) != F.col("component_id")).select(F.col(id).alias(unused(docs, "_gone"))).distinct()
    return docs.join(gone, F.col(id) == F.col(gone.columns[0]), "left_anti")
