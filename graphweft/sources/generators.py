"""Deterministic generators: every random number is a hash of what it is for, so a lost task makes the same rows again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model
from graphweft.functions.scalars import lcg_draw, uniform


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 2, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """src, dst: an R-MAT graph of 2^scale vertices and edge_factor * 2^scale edges; one hashed draw per edge and bit."""
    edges = spark.range(edge_factor * 2**scale)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        u = uniform("id", F.lit(bit), F.lit(seed))
        low = u >= a + b
        src = src * 2 + low.cast("long")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    return edges.select(src.alias("src"), dst.alias("dst"))


def actors(spark: SparkSession, n: int, dim: tuple[float, float], infected: int = 1, reach: float = 2000.0, seed: int = 0) -> DataFrame:
    """actor, px, py, dst_x, dst_y, infected: uniform starts, destinations up to ``reach`` away on each axis, clamped."""
    draw = lambda k: uniform("id", F.lit(seed), F.lit(k))
    at = spark.range(n).select(F.col("id").alias("actor"), "id", (draw("x") * dim[0]).alias("px"), (draw("y") * dim[1]).alias("py"))
    to = lambda p, k, d: F.least(F.greatest(F.col(p) + (draw(k) * 2 - 1) * reach, F.lit(0.0)), F.lit(float(d) - 1e-6))
    return at.select("actor", "px", "py", to("px", "u", dim[0]).alias("dst_x"), to("py", "v", dim[1]).alias("dst_y"), (F.col("actor") < infected).cast("int").alias("infected"))


def vertex_stream(spark: SparkSession, steps: int, owners: int, per_step: tuple[int, int], dim: tuple[int, int, int], seed: int = 123, spread: str = "uniform") -> DataFrame:
    """step, owner, id, x, y, z: between least and most new vertices per owner and step, integer coordinates in the owner's
    slice of the first axis: ``uniform`` over it, all at its middle (``point``), or ``gaussian`` around it with a sixth of
    each side as deviation, clamped."""
    least, most = per_step
    width = dim[0] / owners
    slots = spark.range(steps * owners).select((F.col("id") / owners).cast("int").alias("step"), (F.col("id") % owners).cast("int").alias("owner"))
    many = (F.floor(uniform("step", "owner", F.lit(seed), F.lit("n")) * (most - least)) + least).cast("int")
    rows = slots.withColumn("n", many).where("n > 0").select("step", "owner", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    draw = lambda axis: uniform("step", "owner", "k", F.lit(seed), F.lit(axis))
    if spread not in ("uniform", "point", "gaussian"):
        raise ValueError(f"no such spread: {spread}")

    def share(axis: str) -> Column:
        if spread == "point":
            return F.lit(0.5)
        if spread == "uniform":
            return draw(axis)
        normal = F.sqrt(-2 * F.log1p(-draw(axis))) * F.cos(2 * math.pi * draw(axis + "'"))
        return F.least(F.greatest(0.5 + normal / 6, F.lit(0.0)), F.lit(1 - 1e-9))

    x = F.floor(F.col("owner") * width + share("x") * width).cast("double")
    return rows.select("step", "owner", model.make_id(F.col("owner"), F.col("step") * most + F.col("k")).alias("id"), x.alias("x"), F.floor(share("y") * dim[1]).cast("double").alias("y"), F.floor(share("z") * dim[2]).cast("double").alias("z"))


def edge_stream(spark: SparkSession, steps: int, owners: int, edges_per_step: int, vertices_per_owner: int, seed: int = 123) -> DataFrame:
    """step, owner, src, dst, dir: random edges from an owner's vertex to a vertex of any owner, from the linear
    congruential generator seeded by owner, step and number."""
    rows = spark.range(steps * owners * edges_per_step).select((F.col("id") / (owners * edges_per_step)).cast("int").alias("step"), ((F.col("id") / edges_per_step).cast("long") % owners).cast("int").alias("owner"), "id")
    start = (F.col("id") + seed + F.col("owner")).bitwiseAND(F.lit(0xFFFFFFFF))
    one, s1 = lcg_draw(start)
    two, s2 = lcg_draw(s1)
    three, _ = lcg_draw(s2)
    src = model.make_id(F.col("owner"), F.pmod(one, F.lit(vertices_per_owner)))
    dst = model.make_id(F.pmod(two, F.lit(owners)), F.pmod(three, F.lit(vertices_per_owner)))
    return rows.select("step", "owner", src.alias("src"), dst.alias("dst"), F.lit(model.BI).cast("tinyint").alias("dir"))


def ring(spark: SparkSession, n: int, factor: int = 100) -> DataFrame:
    """id, dst, value: each vertex with one edge to the next and a value of id * factor."""
    return spark.range(n).select("id", F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"), (F.col("id") * factor).alias("value"))


def batches(edges: DataFrame, size: int, order: str) -> DataFrame:
    """edges with ``batch``: ``size`` of them each, in order; numbered without bringing all rows to one task."""
    from graphweft.session import cut

    placed = cut(edges.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    from pyspark.sql import Window

    sizes = placed.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_m")) - 1
    return placed.join(F.broadcast(sizes), "_p").withColumn("batch", F.floor((inside + F.col("_before")) / size)).drop("_p", "_m", "_before")
