"""Bursts of edges: a key seen much more in the current window than its history lets expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.operators.neighbors import triangles


def bursts(events: DataFrame, key: Sequence[str], time: str, window: str = "1 day", factor: float = 2.0) -> DataFrame:
    """key..., window_start, recent, history, windows_before: windows in which a key with a history comes at ``factor``
    times its rate before, or more.

    Windows tumble and move on with time; the rate before is over all windows since the first of all events. Events are
    counted per key and window before any window function sees them."""
    seconds = F.lit(F.window(F.col(time), window)).getField("start")
    counted = events.where(F.col(time).isNotNull()).groupBy(*key, seconds.alias("window_start")).agg(F.count("*").alias("recent"))
    origin = counted.agg(F.min("window_start").alias("origin"))
    span = F.expr(f"(unix_micros(cast(window_start as timestamp)) - unix_micros(cast(origin as timestamp))) / unix_micros(timestamp'1970-01-01 00:00:00' + interval {window})")
    before = Window.partitionBy(*key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    told = counted.withColumn("history", F.coalesce(F.sum("recent").over(before), F.lit(0))).join(F.broadcast(origin)).withColumn("windows_before", span.cast("long")).drop("origin")
    return told.where((F.col("history") > 0) & (F.col("recent") * F.col("windows_before") >= factor * F.col("history")))


def window_triangles(edges: DataFrame, time: str, window: str) -> DataFrame:
    """window_start, triangles: triangles among the edges (src, dst) of each tumbling window, oriented by degree within it."""
    start = F.window(F.col(time), window).getField("start")
    return triangles(edges.select(start.alias("window_start"), "src", "dst"), ["window_start"]).groupBy("window_start").agg(F.count("*").alias("triangles"))
