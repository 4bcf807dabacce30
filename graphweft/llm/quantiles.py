"""Percentiles of very large numeric columns with a guaranteed relative error, from mergeable log-bucket sketches.

A value x falls into the bucket (sign, i) with i = ceil(ln |x| / ln g), g = (1 + a) / (1 - a); a bucket is answered by
2 g^i / (g + 1), which is within a * |x| of every value in it. A sketch is a table of (group columns, sign, bucket, n):
counts of the same bucket add up, so sketches of partitions, days or files are merged by adding them, and the merged
sketch is that of all values, exactly. Counting is partially aggregated before the shuffle; a group holds at most as many
buckets as the logarithm of its range, however many values it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket of infinite values (never reached by a finite one), and of zero and what is smaller than the least normal double.
INFINITE, ZERO = 2_000_000_000, 0
_LEAST = 2.2250738585072014e-308


def bucket_columns(x: Column, alpha: float) -> tuple[Column, Column]:
    """(sign, bucket) of a value; both null for null and NaN."""
    width = math.log((1 + alpha) / (1 - alpha))
    usable = x.isNotNull() & ~F.isnan(x)
    size = F.abs(x)
    tiny = size < F.lit(_LEAST)
    sign = F.when(usable, F.when(tiny, 0).when(x > 0, 1).otherwise(-1)).cast("tinyint")
    bucket = F.when(usable, F.when(tiny, ZERO).when(size == F.lit(float("inf")), INFINITE).otherwise(F.ceil(F.log(size) / F.lit(width)).cast("int")))
    return sign, bucket


_SHIFT = 3_000_000_000


def place_of(x: Column, alpha: float) -> Column:
    """Sign and bucket of a value as one number that rises with the value; null for null and NaN."""
    sign, bucket = bucket_columns(x, alpha)
    return sign.cast("long") * (bucket.cast("long") + _SHIFT)


def sketch_places(df: DataFrame, place: str, by: Sequence[str]) -> DataFrame:
    """The sketch of a column made by :func:`place_of`."""
    counted = df.groupBy(*by, place).agg(F.count("*").alias("n"))
    at = F.col(place)
    return counted.select(*by, F.signum(at.cast("double")).cast("tinyint").alias("sign"), F.when(at == 0, ZERO).otherwise(F.abs(at) - _SHIFT).cast("int").alias("bucket"), "n")


def sketch(df: DataFrame, value: str, by: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """The sketch of ``value`` per group: by..., sign, bucket, n. Null and NaN count under a null bucket."""
    return sketch_places(df.select(*by, place_of(F.col(value).cast("double"), alpha).alias("_place")), "_place", by)


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts joined to those of coarser groups: the counts of the same bucket added."""
    return sketches.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: Sequence[str], at: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """by..., q, value, n, n_unknown, rel_error: the value whose 0-based rank is floor(q * (n - 1)), within ``rel_error``.

    Defined cases: null and NaN aren't ranked, ``n_unknown`` counts them; infinities are ranked and answered exactly; zero
    is answered exactly; groups without a ranked value, and empty tables, have no rows.
    """
    g = (1 + alpha) / (1 - alpha)
    total = Window.partitionBy(*by)
    place = F.col("sign").cast("long") * (F.col("bucket").cast("long") + _SHIFT)  # ascending as the values do
    upto = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bucket").isNotNull()
    counted = sketches.withColumn("n_unknown", F.sum(F.when(~known, F.col("n")).otherwise(0)).over(total)).where(known)
    ranked = counted.withColumn("place", place).withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(total))
    answer = F.when(F.col("sign") == 0, F.lit(0.0)).when(F.col("bucket") == INFINITE, F.col("sign") * F.lit(float("inf"))).otherwise(F.col("sign") * (2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1)))
    q = F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("q")
    rows = ranked.select(*by, "upto", "n", "total", "n_unknown", answer.alias("value"), q)
    rank = F.floor(F.col("q") * (F.col("total") - 1))
    hit = rows.where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
    return hit.select(*by, "q", "value", F.col("total").alias("n"), "n_unknown", F.lit(alpha).alias("rel_error"))


def unpivot_fields(df: DataFrame, keep: Sequence[str], fields: Sequence[str], kind: str = "double") -> DataFrame:
    """One row per field: keep..., field, value (of type ``kind``)."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast(kind).alias("value")) for f in fields]))
    return df.select(*keep, entries.alias("e")).select(*keep, "e.field", "e.value")
