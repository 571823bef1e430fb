"""Places, running sums and selection against plain Python, with ties, nulls, hot groups and groups that span many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import sequences


def rows_of(seed, n):
    rng = random.Random(seed)
    key = lambda: rng.choice([0, 0, 0, 1, 2, None])
    return [(key(), i, rng.choice([rng.uniform(-5, 5), float(rng.randrange(4)), -0.0, None]), rng.choice([rng.randrange(-9, 9), None]), f"x{i % 7}") for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 50, 1000])
def test_running_sums_and_places_equal_loops(spark, n):
    rows = rows_of(n, n)
    df = spark.createDataFrame(rows, "g int, id int, v double, w int, t string").repartition(7)
    got = sequences.running_sums(sequences.places(df, ["g"], ["v", "id"]), ["g"], [F.col("w").desc(), "id"], total=F.col("w"))
    assert got.columns == ["g", "id", "v", "w", "t", "place", "total"]
    null = float("-inf")
    order = lambda r: (null if r[2] is None else r[2] + 0.0, r[1])
    back = lambda r: (10**6 if r[3] is None else -r[3], r[1])
    want = {}
    for r in rows:
        of = [x for x in rows if x[0] == r[0]]
        want[r[1]] = (*r, sorted(of, key=order).index(r) + 1, sum(x[3] or 0 for x in of if back(x) <= back(r)))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [want[i] for i in range(n)]


def test_without_keys_and_with_several_keys(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    assert {r["id"]: r["place"] for r in sequences.places(df, [], [F.desc("id")]).collect()} == {i: 500 - i for i in range(500)}
    got = sequences.places(df, ["a", "b"], ["id"]).collect()
    assert all(r["place"] == r["id"] // 6 + 1 for r in got) and len(got) == 500


def test_names_that_clash_are_refused(spark):
    with pytest.raises(ValueError, match="_part"):
        sequences.places(spark.range(3).withColumn("_part", F.lit(1)), [], ["id"])


def test_a_hot_group_is_dealt_to_many_tasks(spark):
    """One group of all rows: no range holds more than a few times its share of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 40_009).alias("v"))
        got = sequences.places(df, ["g"], ["v"])
        assert got.filter("place <= 0 OR place > 40000").count() == 0 and got.select("place").distinct().count() == 40_000
        dealt = df.repartitionByRange("g", "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert dealt < 3 * 40_000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_place(values, share):
    s = sorted(values)
    return s[min(int(len(s) * share), len(s) - 1)] if s else None


@pytest.mark.parametrize(("n", "accuracy"), [(0, 10_000), (1, 10_000), (3, 10_000), (400, 10_000), (3000, 100), (3000, 20)])
def test_selection_equals_sorting(spark, monkeypatch, n, accuracy):
    monkeypatch.setattr(sequences, "ACCURACY", accuracy)
    rows = rows_of(n + accuracy, n)
    shares = {"least": 0.0, "low": 0.05, "median": 0.5, "high": 0.95, "most": 1.0}
    got = sequences.selected(spark.createDataFrame(rows, "g int, id int, v double, w int, t string").repartition(5), ["g"], "v", **shares)
    assert got.columns == ["g", "n", *shares]
    values = {g: [r[2] for r in rows if r[0] == g and r[2] is not None] for g in {r[0] for r in rows}}
    assert {r["g"]: tuple(r)[1:] for r in got.collect()} == {g: (len(v), *(plain_place(v, s) for s in shares.values())) for g, v in values.items()}


def test_a_bracket_that_misses_changes_nothing(spark, monkeypatch):
    """Brackets from a wrong sketch: the place is then sought under or over them."""
    df = spark.createDataFrame([(i * 37 % 1000 / 10.0,) for i in range(1000)], "v double")
    for wrong in ([-5.0] * 4, [500.0] * 4, [20.0, 30.0, 20.0, 30.0]):
        monkeypatch.setattr(sequences.F, "percentile_approx", lambda *_, w=wrong: F.max(F.array(*map(F.lit, w))))
        assert [tuple(r) for r in sequences.selected(df, [], "v", a=0.1, b=0.9).collect()] == [(1000, 10.0, 90.0)]


def test_selection_of_one_value_and_of_nulls(spark):
    df = spark.createDataFrame([(1, 4.0)] * 900 + [(2, None)] * 3 + [(3, float("nan")), (3, 1.0), (3, float("-inf"))], "g int, v double")
    got = {r["g"]: tuple(r)[1:] for r in sequences.selected(df, ["g"], "v", a=0.0, b=0.5).collect()}
    assert got == {1: (900, 4.0, 4.0), 2: (0, None, None), 3: (3, float("-inf"), 1.0)}
