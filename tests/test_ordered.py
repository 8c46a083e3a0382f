"""Skew-safe primitives against plain Python, with bucket widths that cut keys everywhere."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lureframe.functions import ordered as O

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        data.append((key, i, START + timedelta(seconds=rng.randrange(0, 40_000, 7)), rng.choice("xy")))
    return data, spark.createDataFrame(data, "key string, id int, ts timestamp, v string").cache()


@pytest.mark.parametrize("parts", [1, 7, O.PARTS])
def test_positions(rows, parts):
    data, df = rows
    got = {(r.key, r.id): r.pos for r in O.number_rows(df, ["key"], "ts", "id", parts=parts).collect()}
    want = {}
    for key in {r[0] for r in data}:
        for n, r in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[2], r[1]))):
            want[key, r[1]] = n
    assert got == want


@pytest.mark.parametrize("parts", [1, 7, O.PARTS])
def test_runs_by_value_and_by_gap(rows, parts):
    data, df = rows
    by_value = O.number_runs(df, ["key"], "ts", "id", ["v"], lambda c, p: c["v"] != p["v"], parts=parts)
    by_gap = O.number_runs(df, ["key"], "ts", "id", ["ts"], lambda c, p: F.unix_micros(c["ts"]) - F.unix_micros(p["ts"]) > 150_000_000, parts=parts)
    values, gaps = ({(r.key, r.id): r.run for r in x.collect()} for x in (by_value, by_gap))
    for key in {r[0] for r in data}:
        run_v = run_g = 0
        previous = None
        for r in sorted((r for r in data if r[0] == key), key=lambda r: (r[2], r[1])):
            if previous:
                run_v += r[3] != previous[3]
                run_g += r[2] - previous[2] > timedelta(seconds=150)
            previous = r
            assert (values[key, r[1]], gaps[key, r[1]]) == (run_v, run_g)


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_result_does_not_depend_on_partitioning(spark, rows, partitions):
    _, df = rows
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, O.number_rows(df.repartition(int(partitions)), ["key"], "ts", "id").select("key", "id", "pos").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 600 and [p for k, _, p in sorted(got, key=lambda r: (r[0], r[2])) if k == "hot"] == list(range(sum(k == "hot" for k, _, _ in got)))


def test_interval_join_is_half_open_across_buckets(spark):
    spans = spark.createDataFrame([("a", START, START + timedelta(days=3), 1), ("a", START + timedelta(days=3), START + timedelta(days=4), 2), ("b", START, START, 3)], "key string, start timestamp, end timestamp, n int")
    points = spark.createDataFrame([("a", START), ("a", START + timedelta(days=3)), ("a", START + timedelta(days=3) - timedelta(microseconds=1)), ("a", START + timedelta(days=4)), ("b", START)], "key string, ts timestamp")
    got = {(r.key, r.ts): r.n for r in O.interval_join(points, spans, ["key"], "ts", how="left").collect()}
    assert got == {("a", START): 1, ("a", START + timedelta(days=3)): 2, ("a", START + timedelta(days=3) - timedelta(microseconds=1)): 1, ("a", START + timedelta(days=4)): None, ("b", START): None}


def test_as_of_takes_the_latest_and_later_input_on_a_tie(spark):
    h = [(1, "a", START + timedelta(days=1), "p1"), (2, "a", START + timedelta(days=2), "p2"), (3, "a", START + timedelta(days=2), "p3"), (4, "c", START, "q")]
    history = spark.createDataFrame(h, "id int, key string, at timestamp, persona string")
    points = spark.createDataFrame([("a", START), ("a", START + timedelta(days=1)), ("a", START + timedelta(days=9)), ("b", START), ("c", START)], "key string, t timestamp")
    got = {(r.key, r.t): r.persona for r in O.as_of(points, history, ["key"], "t", "at", ["id"], ["persona"]).collect()}
    assert got == {("a", START): None, ("a", START + timedelta(days=1)): "p1", ("a", START + timedelta(days=9)): "p3", ("b", START): None, ("c", START): "q"}


def test_exact_median(spark):
    rng = random.Random(3)
    data = [("one", 4.5)] + [("even", x) for x in (1.0, 2.0, 10.0, 11.5)] + [("hot", rng.choice([0.25, 0.5, 3.75, 900.0])) for _ in range(501)] + [("flat", 2.0)] * 6
    got = {r.key: r.m for r in O.exact_median(spark.createDataFrame(data, "key string, v double"), ["key"], "v", "m").collect()}
    assert got == {k: statistics.median(v for kk, v in data if kk == k) for k in got} and len(got) == 4


def test_modal_breaks_ties_on_the_smaller_value_and_skips_null(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "w"), ("a", None), ("a", None), ("b", None)], "key string, v string")
    assert [tuple(r) for r in O.modal(df, ["key"], "v", "m").collect()] == [("a", "w")]


def test_group_limit_reaches_below_the_shuffle(spark, rows):
    _, df = rows
    plan = O.top_per_group(df, ["key"], [F.asc("ts"), F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("when", [START, None])
def test_a_burst_at_one_time_or_without_any_is_spread(spark, when):
    """A key with all its rows at one instant, or without times, is cut into many groups of about equal size."""
    data = [("hot", f"e{i:05d}", when) for i in range(20_000)] + [(f"k{i % 50}", f"e{i:05d}", START + timedelta(seconds=i)) for i in range(20_000, 30_000)]
    df = spark.createDataFrame(data, "key string, id string, ts timestamp").repartition(16)
    per_cut = [r["count"] for r in O.intervals(df, ["key"], ["ts", "id"]).where("key = 'hot'").groupBy("_b").count().collect()]
    assert len(per_cut) > 100 and max(per_cut) < 400
    got = O.number_rows(df, ["key"], "ts", "id")
    assert got.where("key = 'hot' AND pos <> CAST(substr(id, 2) AS INT)").count() == 0
    runs = O.number_runs(df, ["key"], "ts", "id", ["id"], lambda c, p: F.substring(c["id"], 1, 4) != F.substring(p["id"], 1, 4))
    assert runs.where("key = 'hot' AND run <> CAST(substr(id, 2, 3) AS INT)").count() == 0
