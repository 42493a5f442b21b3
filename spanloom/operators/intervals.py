"""Algebra of half-open intervals [s, e), in whole seconds.

Every operator takes rows with BIGINT columns ``s`` and ``e`` and the columns ``by`` that keep
owners apart, and works bucket by bucket of the time line: an interval is cut at the edges of
fixed-width buckets, buckets are worked off in parallel, and only their few results meet. So an
owner with a third of all rows is spread over as many tasks as its time line has buckets. Rows
with a null bound or without length take no part (a point is no occupancy); repeated rows count as
often as they occur where rows are counted, and once where time is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY
from ..tables import save
from . import scan


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / width).cast("bigint")


def cut(df: DataFrame, width: int = DAY, to: str = "_b") -> DataFrame:
    """One row for each bucket that an interval meets, in column ``to``, with s and e cut to it."""
    pieces = df.where("e > s").withColumn(to, F.explode(F.sequence(_bucket(F.col("s"), width), _bucket(F.col("e") - 1, width))))
    return pieces.withColumns({"s": F.greatest("s", F.col(to) * width), "e": F.least("e", (F.col(to) + 1) * width)})


def _runs(df: DataFrame, keys: Sequence[str], touching: bool = True) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("s") > reach if touching else F.col("s") >= reach
    run = F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def islands(df: DataFrame, by: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """The union of each owner's intervals: disjoint intervals (by, s, e), those that touch merged."""
    pieces = _runs(cut(df.select(*by, "s", "e"), width), [*by, "_b"])
    # only what reaches a bucket's edge, at most two pieces of each, meets in one place (the null group); the rest stays with its bucket
    edge = (F.col("s") % width == 0) | (F.col("e") % width == 0)
    return _runs(pieces.withColumn("_b", F.when(~edge, F.col("_b"))), [*by, "_b"]).drop("_b")


def union_seconds(df: DataFrame, by: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Each owner's occupied time, in column ``seconds``; merging stays within buckets, as length needs no more."""
    pieces = _runs(cut(df.select(*by, "s", "e"), width), [*by, "_b"])
    return pieces.groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("seconds"))


#: An index level of width 2**w takes intervals of up to 2**(w + _MORE) seconds, and of over 2**(w - _LESS - 1): at most 2**_MORE + 1 cells each.
_MORE, _LESS = 3, 2
#: Where at least _CROWD intervals of an owner are open at a time, candidates cost more than copies: pairs then take up to 2**_MORE_CROWDED + 1 cells a row.
_CROWD, _MORE_CROWDED = 32, 6
#: A crowd's cells are put together until so many intervals begin in them; right rows lie in runs of so many; a task has about so many pairs.
_SHARED, _RUN, _TASK = 4096, 64, 50_000_000
#: No interval has as many seconds as 2**_LONGEST.
_LONGEST = 40


def _bits(df: DataFrame) -> Column:
    return F.length(F.bin(F.col("e") - F.col("s") - 1))


def _lengths(df: DataFrame) -> set[int]:
    """How many bits the lengths of ``df`` have: 64 kinds at most."""
    return {r.b for r in df.where("e > s").select(_bits(df).alias("b")).distinct().collect()}


def _fewest(lengths: set[int], more: int = _MORE) -> tuple[int, ...]:
    """Lengths within a factor of 2**(more + _LESS) share a level, as low as its longest allow."""
    groups: list[list[int]] = []
    for bits in sorted(lengths):
        if not groups or bits > groups[-1][0] + _LESS + more:
            groups.append([bits])
        groups[-1].append(bits)
    # in a crowd cells may be shorter than the shortest of a level
    return tuple(max(g[0] if more == _MORE else 0, g[-1] - more) for g in groups) or (0,)


def index_levels(df: DataFrame) -> tuple[int, ...]:
    """The levels w that an index of these intervals needs: every length has one whose cells of 2**w seconds suit it.

    A pass of its own finds the lengths. The fewest levels that serve all are taken: one or two for intervals of like length,
    five for those of a second to ten years.
    """
    return _fewest(_lengths(df))


def _level(levels: Sequence[int], s: str = "s", e: str = "e") -> Column:
    """A row's own level: the first that takes its length."""
    out = F.lit(levels[-1])
    for w in reversed(levels[:-1]):
        out = F.when(F.col(e) - F.col(s) <= 1 << (w + _MORE), w).otherwise(out)
    return out


def _cells(level: Column, s: str = "s", e: str = "e") -> Column:
    at = lambda t: F.call_function("shiftright", t, level)
    return F.sequence(at(F.col(s)), at(F.col(e) - 1))


def _on(level: int) -> Column:
    """The cells of one level, each with the level."""
    return F.transform(_cells(F.lit(level)), lambda c: F.struct(F.lit(level).alias("w"), c.alias("c")))


def begin_in(left: DataFrame, right: DataFrame, by: Sequence[str] = (), levels: Sequence[int] | None = None) -> DataFrame:
    """All pairs of a left and a right row of one owner of which the right one begins inside the left: columns l_* and r_*.

    A left row lies in the few cells of its own level that it meets; a right one is looked up in the one cell of each level that holds its
    begin. So a pair meets once, and no row is copied more often than there are levels or cells of one, however lengths are
    mixed. ``levels`` are those of :func:`index_levels` for the left rows; they are found in a pass of their own if not given.
    """
    levels = tuple(levels or index_levels(left))
    held = left.where("e > s").withColumn("_level", _level(levels)).withColumn("_cell", F.explode(_cells(F.col("_level"))))
    place = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.shiftright("s", w).alias("c")) for w in levels)))
    begun = right.where("e > s").withColumn("_at", place).withColumns({"_level": F.col("_at.w"), "_cell": F.col("_at.c")})
    named = lambda df, side, own: df.select(*by, "_level", "_cell", *(F.col(c).alias(f"{side}_{c}") for c in own if c not in by))
    pairs = named(held, "l", left.columns).join(named(begun, "r", right.columns), [*by, "_level", "_cell"])
    return pairs.where((F.col("r_s") >= F.col("l_s")) & (F.col("r_s") < F.col("l_e"))).drop("_level", "_cell")


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str] = (), lengths: Sequence[int] | None = None) -> DataFrame:
    """All pairs of a left and a right row of one owner that share time.

    Left columns are named l_* and right ones r_*. A pair meets on the higher level of its two rows: there the longer one
    lies in a few cells, and the shorter one in one or two; the pair is kept in the cell where its common time
    begins, so comes once. Levels are those of the left rows, which a pass of its own finds unless their ``lengths`` (in seconds) are
    given, and coarse ones above for longer right rows. A left row is put on its own level and all above it, a right one on its own and on those of left rows above; so let the
    left side be the smaller one.
    """
    mine = _fewest({(n - 1).bit_length() for n in lengths} if lengths else _lengths(left))
    levels, sides = (*mine, *range(mine[-1] + _MORE + _LESS + 1, _LONGEST, _MORE + _LESS + 1)), []
    for name, df, other in (("l", left, levels), ("r", right, mine)):
        own = F.col("_own")
        cells = [F.when((own == w) | (own < w) & F.lit(w in other), _on(w)) for w in levels]
        rows = df.where("e > s").withColumn("_own", _level(levels)).withColumn("_at", F.explode(F.flatten(F.array_compact(F.array(*cells)))))
        sides.append(rows.select(*by, F.col("_at.w").alias("_level"), F.col("_at.c").alias("_cell"), F.col("_own").alias(f"_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in by)))
    begins = F.call_function("shiftright", F.greatest("l_s", "r_s"), F.col("_level")) == F.col("_cell")
    shared = (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e")) & (F.greatest("_l", "_r") == F.col("_level")) & begins
    return sides[0].join(sides[1], [*by, "_level", "_cell"]).where(shared).drop("_level", "_cell", "_l", "_r")


def _same(names: Sequence[str]) -> Column:
    """Equality of columns with those of the same names after an underscore; null equals null."""
    out = F.lit(True)
    for c in names:
        out &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def _named(met: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of :func:`overlap_pairs` of left and right rows that share time, if the left one comes first."""
    # begins differ in almost all pairs, and comparing structs costs more than comparing them
    first = (F.col("l_s") < F.col("r_s")) | (F.col("l_s") == F.col("r_s")) & (F.struct("l_e", "l_id") < F.struct("r_e", "r_id"))
    e = F.least("l_e", "r_e")
    return met.where(first).select(*by, F.col("l_id").alias("left"), F.col("r_id").alias("right"), F.col("r_s").alias("s"), e.alias("e"), (e - F.col("r_s")).alias("seconds"))


def _pairs(left: DataFrame, right: DataFrame, by: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """The pairs of :func:`overlap_pairs` that have their left row in ``left`` and their right one in ``right``."""
    return _named(begin_in(left, right, by, levels), by)


class _Crowd(NamedTuple):
    """What decides how pairs are looked for: how many bits lengths have, begins an owner and second on the densest day, and about how many pairs there are."""

    bits: set[int]
    dense: float
    pairs: float


def _crowd(df: DataFrame, by: Sequence[str]) -> _Crowd:
    """``dense`` is 0 unless many intervals of an owner are open at a time on average."""
    rows = df.where("e > s").withColumn("_day", _bucket(F.col("s"), DAY))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bits(df))
    days = rows.groupBy(*by, "_day").agg(F.bit_or(bit).alias("bits"), F.sum(F.col("e") - F.col("s")).alias("busy"), F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))
    owners = F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)
    found = days.agg(F.bit_or("bits").alias("bits"), F.sum("busy").alias("busy"), F.sum("n").alias("rows"), F.max("n").alias("most"), (F.max("e") - F.min("s")).alias("span"), owners.alias("owners")).first()
    bits = {b for b in range(64) if (found.bits or 0) >> b & 1}
    crowded = bool(bits) and found.busy >= _CROWD * found.span * found.owners
    return _Crowd(bits, found.most / DAY, found.rows * found.busy / (found.span * found.owners)) if crowded else _Crowd(bits, 0.0, 0.0)


def _levels_of(crowd: _Crowd) -> tuple[int, ...]:
    return _fewest(crowd.bits, _MORE_CROWDED if crowd.dense else _MORE)


def _pair_levels(df: DataFrame, by: Sequence[str]) -> tuple[int, ...]:
    """:func:`index_levels`, finer where many intervals of an owner are open at a time on average."""
    return _levels_of(_crowd(df, by))


def _crowded_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], crowd: _Crowd) -> DataFrame:
    """:func:`_pairs` of a crowd, of which rows are copied, and so shuffled, only where a copy meets thousands.

    Neighbouring cells of a level are put together, at most 2**_MORE_CROWDED of them, until some _SHARED intervals begin in them on the densest day: the more sparse the rows, the
    fewer cells a left one lies in, down to two. Levels of which all is shorter than such a cell need none of their own. In a cell right rows lie in runs of _RUN by their
    begins; a left row passes over the runs that it doesn't meet, and what is left is compared in its task, which holds a cell's runs and streams left rows.
    Tasks are dealt out by pairs, as their bytes say little of their work.
    """
    finest, most = _levels_of(crowd), int(_SHARED / crowd.dense).bit_length()
    levels = [w for w in finest if w + _MORE_CROWDED > most] or finest[-1:]
    width = {w: min(max(most, w), w + _MORE_CROWDED) for w in levels}
    # a level's cells are told from another's by their last six bits
    cell, keys = lambda c, w: c * 64 + w, [*by, "_cell"]
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(crowd.pairs / _TASK), 10_000))
    own = _level(levels)
    held = left.where("e > s").withColumn("_cell", F.explode(F.coalesce(*(F.when(own == w, _cells(F.lit(width[w]))) for w in levels))))
    held = held.select(*by, cell(F.col("_cell"), own).alias("_cell"), *(F.col(c).alias(f"l_{c}") for c in ("id", "s", "e"))).repartition(tasks, *keys)
    places = F.array(*(cell(F.shiftright("s", width[w]), w) for w in levels))
    begun = right.where("e > s").select(*by, F.explode(places).alias("_cell"), "id", "s", "e").repartition(tasks, *keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("s", "e", "id"))
    runs = begun.withColumn("_run", F.floor((nth - 1) / _RUN)).groupBy(*keys, "_run")
    runs = runs.agg(F.min("s").alias("_first"), F.max("s").alias("_last"), F.collect_list(F.struct(*(F.col(c).alias(f"r_{c}") for c in ("id", "s", "e")))).alias("_begun"))
    met = held.join(runs, keys).where((F.col("_first") < F.col("l_e")) & (F.col("_last") >= F.col("l_s")))
    return _named(met.select(*by, "l_id", "l_s", "l_e", F.inline("_begun")).where(F.col("r_s") < F.col("l_e")), by)


def overlap_pairs(df: DataFrame, by: Sequence[str] = (), id: str = "id", levels: Sequence[int] | None = None, marked: Column | None = None) -> DataFrame:
    """Each unordered pair of an owner's intervals that share time, once: (by, left, right, s, e, seconds).

    The left one is the first by (s, e, id). Intervals that only touch are no pair; rows equal
    in all three are not compared with themselves. Of two that share time the later begins inside the
    earlier, so pairs are those of :func:`begin_in`. With ``marked`` only pairs of which at least one row is marked (null: not) are
    made: the marked rows with all, and the others with the marked. Pairs grow with the square of how many intervals are open at a time.
    """
    rows = df.select(*by, F.col(id).alias("id"), "s", "e")
    crowd = _Crowd(set(), 0.0, 0.0) if levels else _crowd(rows, by)
    pairs = lambda left, right: _crowded_pairs(left, right, by, crowd) if crowd.dense else _pairs(left, right, by, levels or _levels_of(crowd))
    if marked is None:
        return pairs(rows, rows)
    hit = F.coalesce(marked, F.lit(False))
    hits, others = (df.where(x).select(*by, F.col(id).alias("id"), "s", "e") for x in (hit, ~hit))
    return pairs(hits, rows).unionByName(pairs(others, hits))


def longest_overlaps(df: DataFrame, k: int, by: Sequence[str] = (), id: str = "id") -> DataFrame:
    """The first ``k`` of :func:`overlap_pairs` by (seconds descending, left, right), without listing the others.

    The longest time that a row shares with one before it in (s, e, id) follows from the furthest end before it, a running
    maximum. The k-th longest of these, t, is at most the k-th pair's seconds: so pairs of over t seconds have one of fewer than k
    rows as their right, and of those of t seconds only the k smallest left ids can be among the first k. A row is the left of a pair of at least t
    seconds if the next row of that length begins t before its end. So work grows with the rows, however many pairs or ties there are.
    """
    order, name = ["s", "e", "id"], [*by, "s", "e", "id"]
    rows = df.select(*by, F.col(id).alias("id"), "s", "e").where("e > s").dropna(subset=list(by)) if by else df.select(F.col(id).alias("id"), "s", "e").where("e > s")
    reach = scan.running(scan.blocks(rows.distinct(), by, order), by, order, {"_reach": ("max", F.col("e"))}, own_row=False)
    best = reach.where("_reach > s").select(*name, (F.least("e", "_reach") - F.col("s")).alias("_best"))
    top = best.orderBy(F.desc("_best")).limit(k).collect()
    t = top[-1]["_best"] if len(top) == k else 0
    among = lambda table, few: table.join(F.broadcast(few.select(*(F.col(c).alias(f"_{c}") for c in name))), _same(name), "left_semi")
    rights = df.sparkSession.createDataFrame([r for r in top if r["_best"] > t], best.schema)
    long = rows.where(F.col("e") - F.col("s") >= t)
    pairs = _pairs(long, among(long, rights), by).where(F.col("seconds") > t)
    if t:
        nth = save(scan.numbered(long.distinct(), by, order, "_n"), "nth")
        lefts = nth.join(nth.select(*by, (F.col("_n") - 1).alias("_n"), F.col("s").alias("_next")), [*by, "_n"]).where(F.col("_next") <= F.col("e") - t)
        last = lefts.select("id").orderBy("id").limit(k).collect()[-1]["id"]
        first = lefts.where(F.struct("id") <= F.struct(F.lit(last).cast(rows.schema["id"].dataType).alias("id")))
        pairs = pairs.unionByName(_pairs(among(long, first), long, by).where(F.col("seconds") == t))
    return pairs.orderBy(F.desc("seconds"), "left", "right").limit(k)


def blocks(df: DataFrame, by: Sequence[str] = (), id: str = "id", width: int = DAY) -> DataFrame:
    """:func:`islands` with the sorted ids of their members, of those that begin and of those that end with them."""
    rows = df.select(*by, F.col(id).alias("id"), "s", "e")
    member = begin_in(islands(df, by, width), rows, by)
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("r_id"))))
    grouped = member.groupBy(*by, F.col("l_s").alias("s"), F.col("l_e").alias("e"))
    return grouped.agg(listed(F.lit(True)).alias("members"), listed(F.col("r_s") == F.col("l_s")).alias("starting"), listed(F.col("r_e") == F.col("l_e")).alias("ending"))


def sweep(df: DataFrame, by: Sequence[str], roles: Sequence[str], keep: Callable[[dict[str, Column]], Column], role: str = "role", width: int = DAY, merge: bool = True) -> DataFrame:
    """Spans of time for which ``keep`` holds of how many intervals of each role are open.

    Boundaries add and take away one of their role, running sums over a bucket's boundaries count, and the
    cells between boundaries that pass are merged (or, with merge=False, come with their counts).
    ``keep`` only sees time that some interval covers.
    """
    pieces = cut(df.select(*by, F.col(role).alias("_role"), "s", "e"), width)
    edge = F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d"))))
    steps = pieces.select(*by, "_b", "_role", edge.alias("x")).groupBy(*by, "_b", F.col("x.t").alias("s"))
    steps = steps.agg(*(F.sum(F.when(F.col("_role") == r, F.col("x.d")).otherwise(0)).alias(f"_n{k}") for k, r in enumerate(roles)))
    order = Window.partitionBy(*by, "_b").orderBy("s")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    cells = steps.select(*by, "s", F.lead("s").over(order).alias("e"), *(F.sum(f"_n{k}").over(running).alias(r) for k, r in enumerate(roles)))
    cells = cells.where(F.col("e").isNotNull() & keep({r: F.col(r) for r in roles}))
    return islands(cells, by, width) if merge else cells


def _roles(sets: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    out = None
    for name, df in sets.items():
        rows = df.select(*by, "s", "e", F.lit(name).alias("role"))
        out = rows if out is None else out.unionByName(rows)
    return out


def intersect(left: DataFrame, right: DataFrame, by: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Time in both unions."""
    return sweep(_roles({"l": left, "r": right}, by), by, ("l", "r"), lambda n: (n["l"] > 0) & (n["r"] > 0), width=width)


def subtract(left: DataFrame, right: DataFrame, by: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Time in the left union and not in the right."""
    return sweep(_roles({"l": left, "r": right}, by), by, ("l", "r"), lambda n: (n["l"] > 0) & (n["r"] == 0), width=width)


def common(df: DataFrame, member: str, k: int, by: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Time that at least ``k`` different members of a group hold at once (each member's own overlaps count once)."""
    single = islands(df, [*by, member], width).select(*by, "s", "e", F.lit("m").alias("role"))
    return sweep(single, by, ("m",), lambda n: n["m"] >= k, width=width)


def concurrency(df: DataFrame, by: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """(by, level, seconds): for how long exactly ``level`` intervals were open at once."""
    cells = sweep(df.withColumn("role", F.lit("n")), by, ("n",), lambda n: n["n"] > 0, width=width, merge=False)
    return cells.groupBy(*by, F.col("n").alias("level")).agg(F.sum(F.col("e") - F.col("s")).alias("seconds"))


def clip(df: DataFrame, lo: int | Column, hi: int | Column, s: str = "s", e: str = "e") -> DataFrame:
    """Rows cut to [lo, hi); those without common time go, but a point that lies in it stays."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (lo, hi))
    a, b = F.greatest(F.col(s), lo), F.least(F.col(e), hi)
    point = (F.col(s) == F.col(e)) & (F.col(s) >= lo) & (F.col(s) < hi)
    return df.where((a < b) | point).withColumns({s: a, e: F.greatest(a, b)})


def assign(df: DataFrame, windows: DataFrame, by: Sequence[str] = (), lengths: Sequence[int] | None = None) -> DataFrame:
    """Rows cut to each window that they meet: the columns of both, with s and e of the common time, w_s and w_e of the window.

    ``lengths``: the windows' in seconds, if they are known (:func:`overlap_join`).
    """
    both = overlap_join(windows, df, by, lengths)
    out = {c: F.col(f"r_{c}") for c in df.columns if c not in by} | {"w_s": F.col("l_s"), "w_e": F.col("l_e")} | {c: F.col(f"l_{c}") for c in windows.columns if c not in (*by, "s", "e")}
    return both.select(*by, *(v.alias(k) for k, v in (out | {"s": F.greatest("l_s", "r_s"), "e": F.least("l_e", "r_e")}).items()))


def assign_disjoint(df: DataFrame, windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`assign` for windows of one owner that don't overlap, by counting instead of copying.

    Windows are numbered in order. In time order, a row's begin has so many ends of windows at or before it, and its end so many
    begins of windows before it; the windows between the two numbers are those it meets, and only they are joined. Both counts run in
    two levels over ranges of time, so no owner, window or row of any length is gathered or repeated. A null owner is an owner.
    """
    own = [f"w_{c}" for c in windows.columns if c not in by]
    held = windows.where("e > s").select(*by, *(F.col(c).alias(f"w_{c}") for c in windows.columns if c not in by))
    held = save(scan.numbered(held, by, ["w_s", "w_e"], "_w"), "numbered")
    rows = save(df.where("e > s").withColumn("_row", F.monotonically_increasing_id()), "rows")
    mark = lambda t, kind: F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"))
    marks = lambda table, row, *which: table.select(*by, row.alias("_row"), F.explode(F.array(*which)).alias("m")).select(*by, "_row", "m.t", "m.kind")
    # at one time: ends of windows, begins of rows, ends of rows, begins of windows
    line = marks(held, F.lit(None).cast("bigint"), mark("w_e", 0), mark("w_s", 3)).unionByName(marks(rows, F.col("_row"), mark("s", 1), mark("e", 2)))
    counts = {"_ended": ("sum", (F.col("kind") == 0).cast("bigint")), "_begun": ("sum", (F.col("kind") == 3).cast("bigint"))}
    run = scan.running(scan.blocks(line, by, ["t", "kind"]), by, ["t", "kind"], counts).where("_row is not null")
    span = run.groupBy("_row").agg(F.max(F.when(F.col("kind") == 1, F.col("_ended"))).alias("_lo"), F.max(F.when(F.col("kind") == 2, F.col("_begun"))).alias("_hi")).where("_lo < _hi")
    met = rows.join(span, "_row").withColumn("_w", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
    same = met["_w"] == held["_w"]
    for c in by:
        same &= met[c].eqNullSafe(held[c])
    both = met.join(held.select(*(held[c] for c in by), held["_w"], *(held[c] for c in own)), same)
    columns = {c: met[c] for c in df.columns} | {c: held[c] for c in own} | {"s": F.greatest(met["s"], held["w_s"]), "e": F.least(met["e"], held["w_e"])}
    return both.select(*(v.alias(c if c in ("w_s", "w_e") else c.removeprefix("w_") if c in own else c) for c, v in columns.items()))


def gaps(windows: DataFrame, busy: DataFrame, window: str, by: Sequence[str] = (), minimum: int = 1, width: int = DAY, lengths: Sequence[int] | None = None) -> DataFrame:
    """Free time of each window, in gaps of at least ``minimum`` seconds: (by, window, s, e, seconds). A window without busy time is one gap."""
    held = assign(busy.select(*by, "s", "e"), windows.select(*by, window, "s", "e"), by, lengths)
    free = subtract(windows.select(*by, window, "s", "e"), held, [*by, window], width)
    return free.withColumn("seconds", F.col("e") - F.col("s")).where(F.col("seconds") >= minimum)


def witnessed_gaps(windows: DataFrame, busy: DataFrame, window: str, by: Sequence[str] = (), id: str = "id", minimum: int = 1, width: int = DAY, lengths: Sequence[int] | None = None) -> DataFrame:
    """:func:`gaps` with ``before`` and ``after``: the sorted ids of what ends and begins at their edges, empty at a window's edge."""
    keys = [*by, window]
    held = assign(busy.select(*by, F.col(id).alias("id"), "s", "e"), windows.select(*by, window, "s", "e"), by, lengths)
    free = gaps(windows, busy, window, by, minimum, width, lengths)
    ends = held.groupBy(*keys, F.col("e").alias("_t")).agg(F.array_sort(F.collect_set("id")).alias("before"))
    starts = held.groupBy(*keys, F.col("s").alias("_t")).agg(F.array_sort(F.collect_set("id")).alias("after"))
    with_ends = free.join(ends.withColumnRenamed("_t", "s"), [*keys, "s"], "left")
    both = with_ends.join(starts.withColumnRenamed("_t", "e"), [*keys, "e"], "left")
    kind = held.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    return both.select(*keys, "s", "e", "seconds", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
