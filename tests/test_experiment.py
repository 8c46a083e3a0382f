"""Rotation experiment statistics against hand values and a plain loop."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureframe.operators import experiment as X

T0 = datetime(2024, 3, 1)


def test_spread_and_counts():
    assert X._spread(np.array([1.0, 2, 3, 4]), np.array([[0, 0, 1, 1]]), 2)[0] == 4.0
    assert X._relabelings([3, 3, 3, 3]) == 369_600


def test_unranking_lists_every_labelling_once():
    sizes = [2, 1, 2]
    got = [tuple(r) for r in X._unrank(0, X._relabelings(sizes), sizes)]
    assert got == sorted(set(itertools.permutations([0, 0, 1, 2, 2]))) and [tuple(r) for r in X._unrank(7, 11, sizes)] == got[7:11]


def p_of(spark, values, labels, **kw):
    rows = [("g", i, a, float(v)) for i, (v, a) in enumerate(zip(values, labels))]
    return X.permutation(spark.createDataFrame(rows, "g string, block int, arm string, value double"), ["g"], **kw).first()


def test_permutation_values(spark):
    r = p_of(spark, [1, 2, 3, 4], "aabb")
    assert (r.p, r.exhaustive, r.smallest_p) == (pytest.approx(2 / 6), True, pytest.approx(2 / 6))
    assert p_of(spark, [1, 1, 1, 9, 9, 9], "aaabbb", step=3).p == pytest.approx(2 / 20)
    assert p_of(spark, [5, 5, 5, 5], "aabb").p == 1.0
    assert p_of(spark, range(12), "abcdabcdabcd").smallest_p == pytest.approx(24 / 369_600)


def test_sampled_mode_is_close_and_repeatable(spark):
    full = p_of(spark, [1, 2, 4, 3, 6, 5], "aaabbb").p
    one, two = (p_of(spark, [1, 2, 4, 3, 6, 5], "aaabbb", limit=1, samples=20_000, step=4000) for _ in range(2))
    assert one.p == two.p and not one.exhaustive and abs(one.p - full) < 0.02


def test_holm(spark):
    df = spark.createDataFrame([("v", "a", 0.01), ("v", "b", 0.04), ("v", "c", 0.03)], "view string, metric string, p double")
    assert {r.metric: pytest.approx(r.holm) for r in X.holm(df, ["view"]).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


STATS = "honeypot_id string, block int, session_id string, fate string, commands int, downloads int, duration_s double, script string"


def metric(spark, rows):
    df = spark.createDataFrame([("h", 0, f"s{i}", "analysed", c, d, s, x) for i, (c, d, s, x) in enumerate(rows)], STATS)
    return {(r.view, r.metric): r.value for r in X.block_metrics(df).collect()}


def test_block_metrics(spark):
    m = metric(spark, [(0, 0, 10.0, None), (1, 0, 20.0, "u"), (2, 1, 30.0, "uw"), (1, 0, 40.0, "l")])
    assert [m["session", k] for k in ("ran_any_share", "commands_mean", "download_share", "duration_median_s")] == [0.75, 1.0, 0.25, 25.0]


def test_one_vote_per_script(spark):
    m = metric(spark, [(1, 0, 1.0, "u")] * 3 + [(1, 1, 1.0, "w")])
    assert (m["session", "download_share"], m["script", "download_share"], m["script", "scripts"]) == (0.25, 0.5, 2.0)
    m = metric(spark, [(0, 0, 1.0, None)] * 3 + [(1, 0, 1.0, "u")])
    assert (m["script", "commands_mean"], m["script", "scripts"]) == (0.5, 1.0)


def test_assignment_and_exclusion(spark):
    blocks = spark.createDataFrame([("h", 0, T0, T0 + timedelta(hours=30), "a", True), ("h", 1, T0 + timedelta(hours=30), T0 + timedelta(hours=40), "zz", True)], "honeypot_id string, block int, start timestamp, end timestamp, arm string, opened_by_deployment boolean")
    end = T0 + timedelta(hours=30)
    rows = [("h", "far", T0, end - timedelta(seconds=121), True), ("h", "near", T0, end - timedelta(seconds=120), True), ("h", "out", T0 + timedelta(hours=50), T0 + timedelta(hours=51), True), ("h", "anon", T0, T0, False)]
    stats = spark.createDataFrame(rows, "honeypot_id string, session_id string, first timestamp, last timestamp, logged_in boolean")
    assigned = X.assign_to_blocks(stats, blocks)
    assert {r.session_id: r.fate for r in assigned.collect()} == {"far": "analysed", "near": "cut", "anon": "not_logged_in"}
    ev = spark.createDataFrame([("h", T0 + timedelta(hours=h)) for h in range(15)], "honeypot_id string, ts timestamp")
    judged = X.block_exclusion(X.hour_coverage(ev, X.tallies(assigned, blocks)), ["a"])
    assert {r.block: (r.covered, r.total, r.excluded) for r in judged.collect()} == {0: (15, 30, None), 1: (0, 10, "unknown_arm")}
