"""Streams of edges into graph state, batch by batch, and windowed streams.

State lies in folders that all executors share, one part per micro-batch: a batch reads the parts before its own and writes
its own, so a batch that runs again after a failure gives the same. What grows with the stream is only added to: labels and
edges of a batch are those of vertices and edges not met before. What must be rewritten is small, the components that have
been merged into others and the sketches, and versions of it that no batch needs any more are deleted.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphweft import model
from graphweft.functions import sketches
from graphweft.operators.bsp import connected_components
from graphweft.session import cut, release


class VersionedTable:
    """A table with a version per batch, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _path(self, version: int) -> str:
        return os.path.join(self.folder, f"version={version:012d}")

    def read(self, version: int) -> DataFrame:
        """The table as of ``version``; empty before the first."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(version))

    def write(self, df: DataFrame, version: int) -> DataFrame:
        """``df`` as ``version``. The version before is kept, as the batch may run again; older ones are deleted."""
        df.write.mode("overwrite").parquet(self._path(version))
        if version >= 2:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(version - 2))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(version)

    def latest(self) -> DataFrame:
        return self.read(max(_parts(self.spark, self.folder), default=-1))


def _parts(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the parts or versions under ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName()] if fs.exists(path) else []


class GrowingTable:
    """A table that each batch adds a part to, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def before(self, batch: int | None) -> DataFrame:
        """What the batches before ``batch`` added; all if it is None."""
        paths = [os.path.join(self.folder, f"batch={k:012d}") for k in sorted(_parts(self.spark, self.folder)) if batch is None or k < batch]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(self.folder, f"batch={batch:012d}"))


def edge_file_stream(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 1) -> DataFrame:
    """Edges of parquet files as they appear, ``files_per_batch`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _labels(spark: SparkSession, folder: str) -> tuple[GrowingTable, VersionedTable]:
    return GrowingTable(spark, os.path.join(folder, "labels"), "v long, label long"), VersionedTable(spark, os.path.join(folder, "merged"), "label long, component long")


def _resolved(labels: DataFrame, merged: DataFrame) -> DataFrame:
    return labels.join(merged, "label", "left").select("v", F.coalesce("component", "label").alias("component"))


def current_components(spark: SparkSession, folder: str) -> DataFrame:
    """v, component: what :func:`stream_components` has come to."""
    labels, merged = _labels(spark, folder)
    return _resolved(labels.before(None), merged.latest())


def stream_components(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Components kept up to date, read by :func:`current_components`: a label per vertex, given once, and the component of
    each label that isn't its own any more.

    A batch's edges are joined with the components of their ends; the components of what is new among old components then
    say which labels move. No old edge is read again, and no old vertex is written again."""
    spark = stream.sparkSession
    labels, merged = _labels(spark, folder)

    def step(batch: DataFrame, k: int) -> None:
        edges = batch.select("src", "dst").where("src is not null and dst is not null").distinct()
        ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        known, aliases = labels.before(k), merged.read(k - 1)
        old = _resolved(known.join(ends, "v", "left_semi"), aliases)
        named = cut(ends.join(old, "v", "left").select("v", F.coalesce("component", "v").alias("c"), F.col("component").isNull().alias("new")))
        contracted = edges.join(named.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(named.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").select(F.col("cs").alias("src"), F.col("cd").alias("dst"))
        moved = cut(connected_components(contracted, named.select(F.col("c").alias("id"))).where("v <> component").select(F.col("v").alias("label"), F.col("component").alias("now")))
        follow = aliases.join(moved.select(F.col("label").alias("component"), "now"), "component", "left").select("label", F.coalesce("now", "component").alias("component"))
        merged.write(follow.unionByName(moved.join(aliases, "label", "left_anti").select("label", F.col("now").alias("component"))), k)
        labels.add(named.where("new").select("v", F.col("c").alias("label")), k)
        release(named)
        release(moved)

    return _start(stream, step, checkpoint, once)


def _edges(spark: SparkSession, folder: str) -> GrowingTable:
    return GrowingTable(spark, os.path.join(folder, "edges"), "src long, dst long, dir tinyint, kind tinyint")


def current_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, dir, kind: what :func:`stream_graph` has taken in."""
    return _edges(spark, folder).before(None)


def stream_graph(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Edges kept once each, canonical, first written stays, read by :func:`current_edges`; with what each batch brought
    under <folder>/rates(batch, edges, fresh, seconds, edges_per_second)."""
    spark = stream.sparkSession
    every = _edges(spark, folder)

    def step(batch: DataFrame, k: int) -> None:
        began, counts = time.monotonic(), Observation()
        new = model.canonical_edges(batch.observe(counts, F.count("*").alias("edges")))
        fresh = cut(new.join(every.before(k), ["src", "dst"], "left_anti").select("src", "dst", "dir", "kind"))
        every.add(fresh, k)
        edges, seconds = counts.get["edges"], time.monotonic() - began
        rate = fresh.agg(F.count("*").alias("fresh")).select(F.lit(k).alias("batch"), F.lit(edges).alias("edges"), "fresh", F.lit(seconds).alias("seconds"), F.lit(edges / seconds).alias("edges_per_second"))
        rate.write.mode("overwrite").parquet(os.path.join(folder, f"rates/batch={k}"))
        release(fresh)

    return _start(stream, step, checkpoint, once)


def stream_bursts(stream: DataFrame, key: F.Column, folder: str, checkpoint: str, factor: float = 2.0, once: bool = True) -> StreamingQuery:
    """Bursts by sketches: a batch's keys are held against the sketch of all before; alerts(batch, item, recent, history)
    under <folder>/alerts. Batches are the windows."""
    spark = stream.sparkSession
    sketch = VersionedTable(spark, os.path.join(folder, "sketch"), "row int, bucket int, n long")

    def step(batch: DataFrame, k: int) -> None:
        items = batch.select(key.alias("item")).where("item is not null").groupBy("item").agg(F.count("*").alias("recent"))
        history = sketches.estimate(sketch.read(k - 1), items, "item").withColumnRenamed("estimate", "history")
        alerts = history.where((F.col("history") > 0) & (F.col("recent") * F.lit(k) >= F.lit(factor) * F.col("history")))
        alerts.select(F.lit(k).alias("batch"), "item", "recent", "history").write.mode("overwrite").parquet(os.path.join(folder, f"alerts/batch={k}"))
        new = sketches.build(batch, key)
        sketch.write(sketches.merge(sketch.read(k - 1), new.select(F.col("row").cast("int").alias("row"), F.col("bucket").cast("int").alias("bucket"), "n")), k)

    return _start(stream, step, checkpoint, once)


def windowed_counts(stream: DataFrame, time: str, window: str, by: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per (sliding or tumbling) window; rows later than ``late`` are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
