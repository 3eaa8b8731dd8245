import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchloom.operators.bitemporal import as_known_at

T0 = datetime(2024, 1, 1)


def brute(points, versions, lag):
    out = []
    for i, e, t in points:
        best = None
        if e is not None and t is not None:
            for ve, v, k, x in versions:
                if None not in (ve, v, k, x) and ve == e and v < t and max(k, v) <= t + lag:
                    best = max(best, (v, max(k, v + timedelta(microseconds=1)), x)) if best else (v, max(k, v + timedelta(microseconds=1)), x)
        out.append((i, e, t, None if best is None else float(best[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,lag_hours", [(1, 0), (2, 0), (3, 500), (4, 2000)])
def test_against_brute_force(spark, seed, lag_hours):
    r = random.Random(seed)
    hour = timedelta(hours=1)
    versions = []
    for _ in range(400):
        v = T0 + hour * r.randrange(0, 2500)
        k = v + r.choice([0, 0, 0, 5, 100, 1500]) * hour - r.choice([0, 0, 3]) * hour
        versions.append((r.choice([1, 1, 1, 2, 3]), v, k, r.randrange(100)))
    versions += versions[:20] + [(None, T0, T0, 1), (1, None, T0, 2), (1, T0, None, 3), (1, T0, T0, None)]
    points = [(i, r.choice([1, 1, 2, 3, 9]), T0 + hour * r.randrange(-5, 2600)) for i in range(300)]
    points += [(900, None, T0), (901, 1, None)]
    vs = spark.createDataFrame(versions, "e int, v timestamp, k timestamp, value int")
    ps = spark.createDataFrame(points, "i int, e int, valid_from timestamp")
    lag = timedelta(hours=lag_hours)
    at = F.col("valid_from")
    known_at = None if not lag_hours else at + F.expr(f"interval {lag_hours} hours")
    got = as_known_at(ps, vs, ["e"], at, F.col("v"), F.col("k"), F.col("value"), known_at)
    assert got.columns == ["i", "e", "valid_from", "value"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(points, versions, lag)


def test_one_hot_entity_and_repeats(spark):
    hour = timedelta(hours=1)
    versions = [(1, T0 + hour * i, T0 + hour * i, i) for i in range(3000)]
    points = [(i, 1, T0 + hour * i + timedelta(minutes=1)) for i in range(3000)] * 2
    got = as_known_at(spark.createDataFrame(points, "i int, e int, t timestamp"), spark.createDataFrame(versions, "e int, v timestamp, k timestamp, x int"), ["e"], F.col("t"), F.col("v"), F.col("k"), F.col("x"))
    assert got.count() == 6000 and got.where("value <> i or value is null").count() == 0


def test_empty(spark):
    ps = spark.createDataFrame([(1, 1, T0)], "i int, e int, t timestamp")
    vs = spark.createDataFrame([], "e int, v timestamp, k timestamp, x int")
    args = (["e"], F.col("t"), F.col("v"), F.col("k"), F.col("x"))
    assert as_known_at(ps, vs, *args).collect()[0]["value"] is None
    assert as_known_at(ps.limit(0), vs, *args).count() == 0
