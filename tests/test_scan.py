"""Two-level running values against a loop over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F
from spanloom.operators import scan

SCHEMA = "g string, t long, v long, w long"


def looped(rows):
    """Rows with running sum, xor, maximum and last value, group by group in (t, v, w)."""
    out, low = [], float("-inf")
    for g in {r[0] for r in rows}:
        total, mixed, most, last = 0, 0, None, None
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: tuple(low if x is None else x for x in r[1:])), 1):
            total, mixed, most = total + r[2], mixed ^ r[2], r[2] if most is None else max(most, r[2])
            last = last if r[3] is None else r[3]
            out.append((*r, n, total, mixed, most, last))
    return out


def rows(n, groups, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.choice([None, *range(40)]), rng.randrange(-50, 50), rng.choice([None, None, rng.randrange(9)])) for _ in range(n)]


@pytest.mark.parametrize("groups", [["a"], ["a"] * 8 + ["b", "c", None], [str(k) for k in range(200)]])
def test_against_a_loop(spark, groups):
    data = rows(1500, groups)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        dealt = scan.blocks(spark.createDataFrame(data, SCHEMA).repartition(5), ["g"], ["t", "v", "w"])
        assert dealt.select("_block").distinct().count() > 8
        values = {"n": ("sum", F.lit(1)), "total": ("sum", F.col("v")), "mixed": ("xor", F.col("v")), "most": ("max", F.col("v")), "latest": ("last", F.col("w"))}
        found = scan.running(dealt, ["g"], ["t", "v", "w"], values).drop("_block", "_tie")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(looped(data), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_a_whole_table(spark):
    data = rows(800, ["a", None]) + [("a", 3, 3, 3)] * 200
    found = scan.numbered(spark.createDataFrame(data, SCHEMA), (), ["t", "v"]).collect()
    assert sorted(r.n for r in found) == list(range(1, 1001))
    ordered = [(float("-inf") if r.t is None else r.t, r.v) for r in sorted(found, key=lambda r: r.n)]
    assert ordered == sorted(ordered)
    assert scan.numbered(spark.createDataFrame([], SCHEMA), ["g"], ["t"]).count() == 0


def test_no_task_holds_a_group(spark):
    """The plan has no window over the group alone."""
    dealt = scan.blocks(spark.createDataFrame(rows(50, ["a"]), SCHEMA), ["g"], ["t"])
    plan = scan.running(dealt, ["g"], ["t"], {"n": ("sum", F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    over = [line for line in plan.splitlines() if "windowspecdefinition" in line and "_tie" in line]
    assert over and all("_block" in line for line in over)
