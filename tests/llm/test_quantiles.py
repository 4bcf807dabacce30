import math
import random

from pyspark.sql import functions as F

from graphweft.llm import quantiles as Q

AT = (0.0, 0.1, 0.5, 0.9, 1.0)


def test_bound_and_merge(spark):
    rnd = random.Random(3)
    values = [rnd.choice((-1, 1)) * math.exp(rnd.uniform(-20, 20)) for _ in range(3000)] + [0.0] * 50 + [math.inf, -math.inf]
    rows = [(x, i % 3, "g") for i, x in enumerate(values)] + [(math.nan, 0, "g"), (None, 1, "g"), (None, 1, "only null")]
    df = spark.createDataFrame(rows, "x double, day int, grp string")
    whole = Q.percentiles(Q.sketch(df, "x", ["grp"]), ["grp"], AT).collect()
    parts = Q.sketch(df, "x", ["grp", "day"])
    joined = Q.percentiles(Q.merge(parts, ["grp"]), ["grp"], AT).collect()
    assert sorted(map(str, whole)) == sorted(map(str, joined)) and {r["grp"] for r in whole} == {"g"}
    ordered = sorted(values)
    for r in whole:
        true = ordered[int(r["q"] * (len(values) - 1))]
        assert r["value"] == true or abs(r["value"] - true) <= 0.01 * abs(true) * (1 + 1e-9)
        assert (r["n"], r["n_unknown"]) == (len(values), 2)


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(5.0, None)] * 10, "x double, grp string")
    assert [round(r["value"] / 5, 1) for r in Q.percentiles(Q.sketch(df, "x", ["grp"]), ["grp"], (0.5,)).collect()] == [1.0]
    assert Q.percentiles(Q.sketch(df.where(F.lit(False)), "x", ["grp"]), ["grp"], AT).count() == 0
