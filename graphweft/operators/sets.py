"""Sets of numbers as arrays, and sparse (i, j) relations as two-column tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def empty(kind: str = "bigint") -> Column:
    return F.array().cast(f"array<{kind}>")


def full(n: int) -> Column:
    """0 .. n - 1."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if n else empty()


def insert(s: Column, x: Column) -> Column:
    return F.array_union(s, F.array(x))


def clear(s: Column, x: Column) -> Column:
    return F.array_remove(s, x)


def contains(s: Column, x: Column) -> Column:
    return F.array_contains(s, x)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def cardinality(s: Column) -> Column:
    return F.size(F.array_distinct(s))


def least(s: Column) -> Column:
    return F.array_min(s)


def greatest(s: Column) -> Column:
    return F.array_max(s)


def text(s: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(s)).cast("array<string>"), " ")


def members(df: DataFrame, s: str) -> DataFrame:
    return df.withColumn("member", F.explode(s))


def pair_insert(r: DataFrame, new: DataFrame) -> DataFrame:
    return r.select("i", "j").unionByName(new.select("i", "j")).distinct()


def pair_remove(r: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the pairs of ``gone``, or without whole rows (column i only) or values (column j only)."""
    return r.join(gone, [c for c in ("i", "j") if c in gone.columns], "left_anti").select("i", "j")


def pair_row(r: DataFrame) -> DataFrame:
    """i, row: each row's values in order."""
    return r.groupBy("i").agg(F.array_sort(F.collect_set("j")).alias("row"))


def relation_at(log: DataFrame, seq: int | None = None) -> DataFrame:
    """i, j, seq: the pairs that are set, from a log of changes (i, j, seq, on: set or cleared), as of ``seq`` or of the last;
    each with the number of the change that set it. Of equal numbers a clearing stands."""
    seen = log if seq is None else log.where(F.col("seq") <= seq)
    last = seen.groupBy("i", "j").agg(F.max(F.struct("seq", (~F.col("on")).alias("off"))).alias("l"))
    return last.where("not l.off").select("i", "j", F.col("l.seq").alias("seq"))


def row_versions(log: DataFrame) -> DataFrame:
    """i, seq: the number of each row's last change; a copy of the row with a lower number is out of date."""
    return log.groupBy("i").agg(F.max("seq").alias("seq"))


def chunk_owner(i: Column, n: int, owners: int) -> Column:
    """The owner of row ``i`` of ``n`` dealt out in equal chunks."""
    return F.floor(i / -(-n // owners)).cast("int")


def window_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change: what stopped, continues and is new between two sets of keys, in one pass over both."""
    k = old.columns[0]
    both = old.select(k, F.lit(1).alias("_s")).unionByName(new.select(F.col(new.columns[0]).alias(k), F.lit(2).alias("_s")))
    bits = both.groupBy(k).agg(F.bit_or("_s").alias("_s"))
    return bits.select(k, F.when(F.col("_s") == 1, "ended").when(F.col("_s") == 2, "new").otherwise("continuing").alias("change"))
