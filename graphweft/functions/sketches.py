"""Count-min sketches as tables (row, bucket, n): mergeable by adding, with an estimator."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.scalars import djb2, pairwise_hash

#: Factors and offsets of the rows' hashes: fixed, so that sketches can be merged and compared.
HASHES = ((1103515245, 12345), (1664525, 1013904223), (22695477, 1), (214013, 2531011), (1597334677, 715225739), (69069, 907133923), (1812433253, 1566083941), (134775813, 17))


def size(eps: float, gamma: float) -> tuple[int, int]:
    """(width, depth) for an error of eps * total with probability 1 - gamma."""
    return math.ceil(math.e / eps), math.ceil(math.log(1 / gamma))


def _buckets(item: Column, width: int, depth: int) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("row"), pairwise_hash(item, *HASHES[j], width).alias("bucket")) for j in range(depth)])


def build(df: DataFrame, item: Column, eps: float = 0.01, gamma: float = 0.1, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by..., row, bucket, n. Items are counted before they are spread over the rows, then added up map-side."""
    width, depth = size(eps, gamma)
    kept = df.select(*by, item.alias("_i"), (weight if weight is not None else F.lit(1)).alias("_w")).where("_i is not null").groupBy(*by, "_i").agg(F.sum("_w").alias("_w"))
    return kept.select(*by, F.explode(_buckets(F.col("_i"), width, depth)).alias("b"), "_w").groupBy(*by, "b.row", "b.bucket").agg(F.sum("_w").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in sketches[0].columns if c != "n"]).agg(F.sum("n").alias("n"))


def estimate(sketch: DataFrame, items: DataFrame, item: str, eps: float = 0.01, gamma: float = 0.1) -> DataFrame:
    """items with ``estimate``: the least count over the rows; never below the true count."""
    width, depth = size(eps, gamma)
    asked = items.withColumn("b", F.explode(_buckets(F.col(item), width, depth))).withColumns({"row": F.col("b.row"), "bucket": F.col("b.bucket")}).drop("b")
    found = asked.join(sketch.withColumnRenamed("n", "_n"), ["row", "bucket"], "left")
    return found.groupBy(*items.columns).agg(F.min(F.coalesce("_n", F.lit(0))).alias("estimate"))


def total(sketch: DataFrame) -> DataFrame:
    return sketch.where("row = 0").agg(F.sum("n").alias("total"))


def text_item(text: Column) -> Column:
    """The number under which a string is counted."""
    return djb2(text)
