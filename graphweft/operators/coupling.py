"""Coupled clusters of owners: who exchanges values in lock step, what they see, and when they stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.operators.bsp import connected_components
from graphweft.session import cut, release


def clusters(owners: DataFrame, requests: DataFrame, terminated: DataFrame | None = None) -> DataFrame:
    """owner, cluster: the least owner that each is coupled with. Requests (owner, other) hold both ways and for good;
    requests to owners that had terminated before (column owner) are dropped."""
    live = requests if terminated is None else requests.join(terminated.select(F.col("owner").alias("other")), "other", "left_anti")
    found = connected_components(live.select(F.col("owner").alias("src"), F.col("other").alias("dst")), owners.select(F.col("owner").alias("id")))
    return found.select(F.col("v").alias("owner"), F.col("component").alias("cluster"))


def coupled_metrics(vertices: DataFrame, cluster: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """owner, cluster, each metric of the owner (an aggregate over its vertices), its sum over the cluster (``all_``), and
    the number of members. Vertices are aggregated per owner first; the windows see one row an owner."""
    own = vertices.groupBy("owner").agg(*[m.alias(k) for k, m in metrics.items()])
    w = Window.partitionBy("cluster")
    joined = cluster.join(own, "owner", "left")
    return joined.select("owner", "cluster", *metrics, *[F.sum(k).over(w).alias(f"all_{k}") for k in metrics], F.count("*").over(w).alias("members"))


def terminating(coupled: DataFrame, predicate: Column, terminated: DataFrame | None = None) -> DataFrame:
    """owner: those whose cluster's live members all fulfil ``predicate``; terminated members don't count."""
    live = coupled if terminated is None else coupled.join(terminated.select("owner"), "owner", "left_anti")
    ready = live.groupBy("cluster").agg(F.min(F.coalesce(predicate, F.lit(False)).cast("int")).alias("_all")).where("_all = 1")
    return live.join(ready.select("cluster"), "cluster", "left_semi").select("owner")


def run_lock_step(owners: DataFrame, cluster: DataFrame, update: Callable[[Column, Column, int], Column], ready: Callable[[Column], Column], max_steps: int = 100, total: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """owner, cluster, value, steps: owners (owner, value) that exchange in lock step until they terminate.

    Each step every live member takes ``update(its value, the sum of ``total`` over its cluster's live members, step)``. A cluster ends
    after a step in which ``ready`` (over a value) holds for all its live members; ended owners keep their values and take
    no part any more."""
    state = cut(owners.join(cluster, "owner").select("owner", "cluster", "value", F.lit(0).alias("steps"), F.lit(True).alias("live")))
    w = Window.partitionBy("cluster")
    for step in range(max_steps):
        new = state.withColumn("t", F.sum(F.when(F.col("live"), total(F.col("value")))).over(w)).withColumn("value", F.when(F.col("live"), update(F.col("value"), F.col("t"), step)).otherwise(F.col("value")))
        done = F.min(F.when(F.col("live"), F.coalesce(ready(F.col("value")), F.lit(False)))).over(w)
        before, state = state, cut(new.withColumn("done", done).select("owner", "cluster", "value", (F.col("steps") + F.col("live").cast("int")).alias("steps"), (F.col("live") & ~F.coalesce("done", F.lit(True))).alias("live")))
        release(before)
        if state.where("live").isEmpty():
            break
    return state.select("owner", "cluster", "value", "steps")


def pending_messages(steps: DataFrame) -> DataFrame:
    """cluster, pending: messages sent and not received yet, from rows (cluster, sent, received)."""
    return steps.groupBy("cluster").agg((F.sum("sent") - F.sum("received")).alias("pending"))


def all_reduce(rows: DataFrame, **values: Column) -> DataFrame:
    """One row: the given aggregates over all owners."""
    return rows.agg(*[v.alias(k) for k, v in values.items()])


def modulo_partners(owners: DataFrame, n: int, flag: Column | None = None) -> DataFrame:
    """a < b: owners that are congruent modulo n / 2, both flagged."""
    o = owners if flag is None else owners.where(flag)
    keyed = o.select("owner", F.pmod("owner", F.lit(n // 2)).alias("_k"))
    return keyed.withColumnRenamed("owner", "a").join(keyed.withColumnRenamed("owner", "b"), "_k").where("a < b").select("a", "b")
