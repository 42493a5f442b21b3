"""Interval operators against one-second cells, many seeds in one table."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv

SEEDS = 60


@pytest.fixture(scope="module")
def rows():
    out = []
    for seed in range(SEEDS):
        rng = random.Random(seed)
        for k in range(rng.randint(0, 25)):
            s = rng.randint(-10, 49)
            out.append((seed, f"o{k}", s, s + rng.randint(0, 34), rng.choice("ab")))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([*rows, (0, "null", None, 5, "a"), (0, "null", 5, None, "a")], "seed int, id string, s long, e long, role string").cache()


def cells(rows, role=None):
    out = defaultdict(Counter)
    for seed, _, s, e, r in rows:
        if role in (None, r):
            out[seed].update(range(s, e))
    return out


def covered(found):
    out = defaultdict(list)
    for r in found:
        out[r.seed] += range(r.s, r.e)
    return out


@pytest.mark.parametrize("width", [7, 1000])
def test_union(df, rows, width):
    want, found = cells(rows), iv.islands(df, ["seed"], width).collect()
    got = covered(found)
    assert all(sorted(got[k]) == sorted(want[k]) for k in range(SEEDS))
    ends = Counter((r.seed, r.e) for r in found)
    assert not any((r.seed, r.s) in ends for r in found)  # none touch
    assert {r.seed: r.seconds for r in iv.union_seconds(df, ["seed"], width).collect()} == {k: len(c) for k, c in want.items() if c}


def test_global_union(df, rows):
    want = set().union(*(c.keys() for c in cells(rows).values()))
    found = iv.islands(df, (), 7).orderBy("s").collect()
    assert [t for r in found for t in range(r.s, r.e)] == sorted(want) and all(a.e < b.s for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("levels", [None, (0,), (3,), (2, 30)])
def test_pairs(df, rows, levels):
    by = defaultdict(list)
    for seed, i, s, e, _ in rows:
        if s < e:
            by[seed].append((s, e, i))
    want = Counter((k, a[2], b[2], max(a[0], b[0]), min(a[1], b[1])) for k, own in by.items() for a in own for b in own if a < b and a[0] < b[1] and b[0] < a[1])
    assert Counter((r.seed, r.left, r.right, r.s, r.e) for r in iv.overlap_pairs(df, ["seed"], levels=levels).collect()) == want


def test_set_operations(df, rows):
    a, b = cells(rows, "a"), cells(rows, "b")
    left, right = df.where("role = 'a'"), df.where("role = 'b'")
    both, minus = covered(iv.intersect(left, right, ["seed"], 9).collect()), covered(iv.subtract(left, right, ["seed"], 9).collect())
    for k in range(SEEDS):
        assert sorted(both[k]) == sorted(set(a[k]) & set(b[k])) and sorted(minus[k]) == sorted(set(a[k]) - set(b[k]))
    shared = covered(iv.common(df, "role", 2, ["seed"], 9).collect())
    assert all(sorted(shared[k]) == sorted(both[k]) for k in range(SEEDS))


def test_concurrency(df, rows):
    want = Counter((k, n) for k, c in cells(rows).items() for n in c.values())
    assert {(r.seed, r.level): r.seconds for r in iv.concurrency(df, ["seed"], 8).collect()} == dict(want)


def test_blocks_and_gaps(spark, df, rows):
    found = iv.blocks(df, ["seed"], width=10).collect()
    for r in found:
        own = [(i, s, e) for seed, i, s, e, _ in rows if seed == r.seed and s < e and s < r.e and e > r.s]
        assert r.members == sorted(i for i, _, _ in own) and r.starting == sorted(i for i, s, _ in own if s == r.s) and r.ending == sorted(i for i, _, e in own if e == r.e)
    windows = spark.range(SEEDS).select(F.col("id").cast("int").alias("seed"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(20).cast("long").alias("e")), F.struct(F.lit(20).cast("long").alias("s"), F.lit(70).cast("long").alias("e")))).alias("w")).select("seed", F.col("w.s").alias("window"), "w.s", "w.e")
    want = cells(rows)
    free = defaultdict(list)
    for r in iv.witnessed_gaps(windows, df, "window", ["seed"], width=10).collect():
        lo, hi = (0, 20) if r.window == 0 else (20, 70)
        free[r.seed, r.window] += range(r.s, r.e)
        own = [(i, s, e) for seed, i, s, e, _ in rows if seed == r.seed and s < e and s < hi and e > lo]
        assert r.before == sorted({i for i, _, e in own if e == r.s and r.s > lo}) and r.after == sorted({i for i, s, _ in own if s == r.e and r.e < hi})
    for k in range(SEEDS):
        for lo, hi in ((0, 20), (20, 70)):
            assert sorted(free[k, lo]) == [t for t in range(lo, hi) if t not in want[k]]


def test_empty(df):
    none = df.limit(0)
    assert iv.islands(none, ["seed"]).collect() == [] and iv.overlap_pairs(none, ["seed"]).collect() == [] and iv.concurrency(none).collect() == []


def test_a_hot_owner_is_split_and_its_result_stays_the_union(spark):
    rng = random.Random(99)
    rows = [(int(k % 3 == 0), k, s, s + rng.choice((5, 400, 90_000, 200_000))) for k in range(3000) for s in (rng.randrange(40 * 86_400),)]
    rows += [(7, 10_000 + k, k * 86_400, (k + 1) * 86_400) for k in range(20)]
    df = spark.createDataFrame(rows, "owner int, id int, s long, e long")
    got = defaultdict(list)
    for r in iv.islands(df, ["owner"]).collect():
        got[r.owner].append((r.s, r.e))
    for owner in (0, 1, 7):
        want = []
        for s, e in sorted((s, e) for o, _, s, e in rows if o == owner):
            if want and s <= want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert sorted(got[owner]) == [tuple(x) for x in want]


def test_pairs_of_short_and_long_intervals(spark):
    rng = random.Random(5)
    rows = [(k % 2, k, s, s + rng.choice((1, 30, 60, 100_000 if k % 50 == 0 else 45))) for k in range(400) for s in (rng.randrange(5000),)]
    df = spark.createDataFrame(rows, "owner int, id int, s long, e long")
    want = Counter((o, x, y) for o, x, s, e in rows for p, y, t, u in rows if o == p and s < u and t < e and (s, e, x) < (t, u, y))
    for levels in (None, (6,), (13,)):
        assert Counter((r.owner, r.left, r.right) for r in iv.overlap_pairs(df, ["owner"], levels=levels).collect()) == want


def test_index_of_lengths_from_a_second_to_ten_years(spark):
    """No row has more than nine cells or is looked up on more levels than there are, and pairs are those of brute force."""
    rng = random.Random(17)
    rows = [(k % 2, k, s, s + 2 ** rng.randrange(29) + rng.randrange(9)) for k in range(300) for s in (rng.randrange(-(2**28), 2**28) if k % 3 else rng.randrange(500),)]
    df = spark.createDataFrame(rows, "owner int, id int, s long, e long")
    levels = iv.index_levels(df)
    assert len(levels) <= 6
    cells = df.select(F.size(iv._cells(iv._level(levels))).alias("n")).agg(F.max("n")).first()[0]
    assert cells <= 9
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1 or id < 50")
    shared = Counter((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] % 2 == 0 and (b[1] % 2 or b[1] < 50) and a[2] < b[3] and b[2] < a[3])
    assert Counter((r.owner, r.l_id, r.r_id) for r in iv.overlap_join(left, right, ["owner"]).collect()) == shared
    inside = Counter((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[2] < a[3])
    assert Counter((r.owner, r.l_id, r.r_id) for r in iv.begin_in(df, df, ["owner"]).collect()) == inside
    pairs = Counter((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and (a[2], a[3], a[1]) < (b[2], b[3], b[1]))
    assert Counter((r.left, r.right) for r in iv.overlap_pairs(df, ["owner"]).collect()) == pairs


def test_one_long_interval_among_short_ones(spark):
    """A year beside a minute: nine cells, not half a million."""
    year = 365 * 86_400
    rows = [(0, 0, 0, year)] + [(0, k, k * 5000, k * 5000 + 60) for k in range(1, 500)]
    df = spark.createDataFrame(rows, "owner int, id int, s long, e long")
    levels = iv.index_levels(df)
    assert df.where("id = 0").select(F.size(iv._cells(iv._level(levels)))).first()[0] <= 9
    assert {(r.left, r.right) for r in iv.overlap_pairs(df, ["owner"]).collect()} == {(0, k) for k in range(1, 500)}


def test_disjoint_windows_by_counting(spark):
    rng, windows, rows = random.Random(12), [], []
    for owner in (0, 1, None):
        t = -50
        for k in range(30):
            t += rng.choice((0, 0, 3, 40))
            windows.append((owner, f"w{k}", t, t + rng.randint(1, 60)))
            t = windows[-1][3]
        rows += [(owner, k, s, s + rng.choice((0, 1, 30, 2000))) for k in range(120) for s in (rng.randrange(-100, t + 50),)]
    w, r = spark.createDataFrame(windows, "owner int, name string, s long, e long"), spark.createDataFrame(rows, "owner int, id int, s long, e long")
    want = Counter((o, i, n, max(s, a), min(e, b)) for o, i, s, e in rows for p, n, a, b in windows if o == p and s < b and a < e and s < e)
    found = iv.assign_disjoint(r, w, ["owner"])
    assert found.columns == ["owner", "id", "s", "e", "name", "w_s", "w_e"] or set(found.columns) == {"owner", "id", "s", "e", "name", "w_s", "w_e"}
    assert Counter((x.owner, x.id, x.name, x.s, x.e) for x in found.collect()) == want
    assert iv.assign_disjoint(r, w.limit(0), ["owner"]).count() == 0


@pytest.mark.parametrize("by", [[], ["owner"]])
def test_longest_overlaps_are_the_first_of_all_pairs(spark, by):
    """Also with ties, copies, repeated rows and fewer pairs than asked for."""
    rng = random.Random(8)
    for rows, k in ((60, 7), (60, 5000), (3, 2)):
        for longest in (4, 40):
            data = [(rng.randrange(2), n, s := rng.randrange(60), s + rng.randrange(longest)) for n in rng.sample(range(100), rows)]
            data += data[: rows // 4] + [(o, n + 100, s, e) for o, n, s, e in data[: rows // 2]] + [(None, 1, 0, 50), (None, 2, 0, 50)] * bool(by)
            df = spark.createDataFrame(data, "owner int, id long, s long, e long")
            want = iv.overlap_pairs(df, by).orderBy(F.desc("seconds"), "left", "right").limit(k).collect()
            assert iv.longest_overlaps(df, k, by).collect() == want


def test_longest_overlaps_of_equal_intervals_list_few_pairs(spark):
    """50,000 equal intervals have 1.2 billion pairs."""
    df = spark.range(50_000).select(F.lit(1).alias("owner"), "id", F.lit(0).cast("long").alias("s"), F.lit(100).cast("long").alias("e"))
    found = iv.longest_overlaps(df, 25, ["owner"]).collect()
    assert [(r.left, r.right, r.seconds) for r in found] == [(0, n, 100) for n in range(1, 26)]


def test_pairs_of_a_crowd_and_of_marked_rows(spark):
    """A crowded owner gets finer levels, no row over 65 cells, and the same pairs; with marks those that have one."""
    rng = random.Random(12)
    data = [(1, n, s := rng.randrange(20_000), s + rng.choice((3, 900, 5000, 16_000)) + rng.randrange(20)) for n in range(900)] + [(1, 900, 0, 20_000), (None, 901, 0, 9), (2, 902, 5, 5)]
    df = spark.createDataFrame(data, "owner int, id long, s long, e long")
    levels = iv._pair_levels(df, ["owner"])
    assert max(levels) < max(iv.index_levels(df))
    assert df.where("e > s").select(F.max(F.size(iv._cells(iv._level(levels))))).first()[0] <= 65
    rows = [(s, e, n) for o, n, s, e in data if o == 1]
    want = {(a[2], b[2]) for a in rows for b in rows if a < b and b[0] < a[1]}
    for mark, keep in ((None, lambda n: True), (F.col("id") % 5 == 0, lambda n: n % 5 == 0), (F.when(F.col("id") % 5 == 0, True), lambda n: n % 5 == 0)):
        found = [(r.left, r.right) for r in iv.overlap_pairs(df, ["owner"], marked=mark).collect()]
        assert len(found) == len(set(found)) and set(found) == {p for p in want if keep(p[0]) or keep(p[1])}


@pytest.mark.parametrize("shared", [1, 40, 10**9])
def test_crowded_pairs_of_all_lengths(spark, monkeypatch, shared):
    """Cells of a few begins, of many or of all, runs of three, lengths of a second to 97 days, copies, null owners and a hot hour: pairs are those of brute force."""
    monkeypatch.setattr(iv, "_SHARED", shared)
    monkeypatch.setattr(iv, "_RUN", 3)
    rng = random.Random(31)
    data = [(k % 3 == 0, k, s := rng.randrange(-(2**21), 2**21) if k % 3 else rng.randrange(3600), s + (2 ** rng.randrange(24) if k % 2 else 2**23)) for k in range(600)]
    data += data[:20] + [(o, k + 1000, s, e) for o, k, s, e in data[:20]] + [(None, 2000, 0, 9), (None, 2001, 0, 9), (True, 2002, 5, 5)]
    df = spark.createDataFrame(data, "owner boolean, id long, s long, e long")
    crowd = iv._crowd(df, ["owner"])
    assert crowd.dense > 0
    want = Counter((o, x, y) for o, x, s, e in data for p, y, t, u in data if o is not None and o == p and s < e and t < u and s < u and t < e and (s, e, x) < (t, u, y))
    assert Counter((r.owner, r.left, r.right) for r in iv.overlap_pairs(df, ["owner"]).collect()) == want
    found = Counter((r.owner, r.left, r.right) for r in iv.overlap_pairs(df, ["owner"], marked=F.col("id") % 7 == 0).collect())
    assert found == Counter({k: n for k, n in want.items() if k[1] % 7 == 0 or k[2] % 7 == 0})


@pytest.mark.parametrize("marked", [None, "id % 5 = 0"])
def test_a_crowd_is_shuffled_in_few_copies(spark, marked):
    """What pairs put on disk grows with the rows: two cells a left row here, not 65, and one a right one."""
    n = 4000
    df = spark.range(n).select((F.col("id") % 1).alias("owner"), "id", (F.col("id") * 5).alias("s"), (F.col("id") * 5 + 16_000).alias("e"))
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for held in (spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None),) for x in map(held.apply, range(held.size()))}
    last = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        earlier = stages()
        got = iv.overlap_pairs(df, ["owner"], marked=marked and F.expr(marked)).count()
        written = sum(n for k, n in stages().items() if k not in earlier)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", last)
    want = {k: range(k + 1, min(k + 3200, n)) for k in range(n)}
    assert got == sum(len(r) if marked is None or k % 5 == 0 else sum(j % 5 == 0 for j in r) for k, r in want.items())
    assert written <= 4 * n
