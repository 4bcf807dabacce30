"""Synchronous supersteps over DataFrames: frontier, messages, mutations, and the usual programming models on top.

A superstep reads the state of the one before only. Work is limited to the frontier: vertices whose neighbourhood or mail
changed. State is cut (written to the checkpoint folder) after each step, so plans stay of one size and a lost executor
costs nothing but its running tasks.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphweft import model
from graphweft.session import cut, release


@dataclass
class Stats:
    """Per superstep: number, vertices changed, seconds; and why the loop ended."""

    steps: list[tuple[int, int, float]] = field(default_factory=list)
    ended: str = ""

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.steps, "step int, changed long, seconds double")

    def write(self, spark, folder: str) -> None:
        """The steps as JSON lines under ``folder``."""
        self.frame(spark).coalesce(1).write.mode("overwrite").json(folder)


def run_supersteps(
    state: DataFrame,
    adjacency: DataFrame,
    message: Column,
    combine: Callable[[Column], Column],
    update: dict[str, Callable[[Column], Column]],
    max_steps: int = 100,
    max_seconds: float | None = None,
    frontier_only: bool = True,
    fixed_steps: bool = False,
    frozen: Column | None = None,
    stop: Callable[[DataFrame, int], bool] | None = None,
    trigger: Callable[[int], DataFrame | None] | None = None,
    cut_every: int = 1,
) -> tuple[DataFrame, Stats]:
    """The state (id, attributes...) after supersteps, and their statistics.

    ``message``: over the sender's struct s and the edge struct e (dst, dir...). ``combine``: aggregate of the messages a
    vertex gets. ``update``: new value of each attribute from the combined message (null if there was none); old values are
    plain columns. Ends when nothing changes, at ``max_steps`` or ``max_seconds``, or when ``stop`` says so.
    ``frontier_only``: only vertices that changed send. ``fixed_steps``: don't look at changes. ``frozen``: vertices (of
    terminated owners) that keep their state but may still be read. ``trigger``: vertices (column id) that a step counts as
    changed whether they are or not, as many times as they come in. ``cut_every``: steps between cuts, if nothing is looked
    at between them (``fixed_steps`` without ``stop``). State that a later cut replaces is deleted.
    """
    names = state.columns
    links = cut(adjacency.repartition("src"))
    edge = F.struct(*[c for c in links.columns if c != "src"])
    now, stats, began = cut(state.withColumn("_active", F.lit(True))), Stats(), time.monotonic()
    held = now
    for step in range(max_steps):
        if max_seconds is not None and time.monotonic() - began > max_seconds:
            stats.ended = "time"
            return now.select(names), stats
        t = time.monotonic()
        forced = trigger(step) if trigger is not None else None
        if forced is not None:
            now = now.join(forced.select("id", F.lit(True).alias("_f")).distinct(), "id", "left").withColumn("_active", F.col("_active") | F.coalesce("_f", F.lit(False))).drop("_f")
        senders = now.where("_active") if frontier_only else now
        sent = links.join(senders.select(F.col("id").alias("src"), F.struct(*names).alias("s")), "src").select(F.col("dst").alias("id"), edge.alias("e"), "s")
        mail = sent.select("id", message.alias("_m")).groupBy("id").agg(combine(F.col("_m")).alias("_m"))
        joined = now.drop("_active").join(mail, "id", "left")
        new = {k: f(F.col("_m")) for k, f in update.items()}
        if frozen is not None:
            new = {k: F.when(frozen, F.col(k)).otherwise(v) for k, v in new.items()}
        wide = joined.select(*names, *[v.alias(f"_n_{k}") for k, v in new.items()])
        active = F.lit(False)
        for k in new:
            active = active | model.changed(F.col(f"_n_{k}"), F.col(k))
        now = wide.select(*[F.col(f"_n_{c}").alias(c) if c in new else F.col(c) for c in names], active.alias("_active"))
        if not fixed_steps or stop is not None or (step + 1) % cut_every == 0:
            now = cut(now)
            release(held)
            held = now
        moved = -1 if fixed_steps else now.where("_active").count()
        stats.steps.append((step, moved, time.monotonic() - t))
        if moved == 0 and (trigger is None or trigger(step + 1) is None):
            stats.ended = "settled"
            return now.select(names), stats
        if stop is not None and stop(now.select(names), step):
            stats.ended = "stopped"
            return now.select(names), stats
    stats.ended = "steps"
    return now.select(names), stats


class Hung(RuntimeError):
    """A step took longer than it may."""


def abort_after(spark, seconds: float, work: Callable[[], object]):
    """What ``work`` gives; if it takes longer than ``seconds``, its Spark jobs are cancelled and :class:`Hung` is raised."""
    group, late = f"graphweft-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    spark.sparkContext.setJobGroup(group, "with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise Hung(f"not done after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def vertex_centric(state: DataFrame, adjacency: DataFrame, message: Column, combine, update, **how) -> tuple[DataFrame, Stats]:
    """Messages flow along edges and are combined with the vertex's own value."""
    return run_supersteps(state, adjacency, message, combine, update, **how)


scatter_gather = vertex_centric


def gather_sum_apply(state: DataFrame, adjacency: DataFrame, gather: Column, sum_: Callable[[Column], Column], apply: dict[str, Callable[[Column], Column]], **how) -> tuple[DataFrame, Stats]:
    """Each vertex gathers from the other ends of its edges; what it has is replaced by what ``apply`` makes of the sum."""
    turned = adjacency.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in adjacency.columns if c not in ("src", "dst")])
    return run_supersteps(state, turned, gather, sum_, apply, frontier_only=False, **how)


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """v, component: the least vertex that each vertex is connected with.

    Alternates large-star and small-star steps, which end after a number of rounds logarithmic in the size, however long
    the paths. Each step aggregates before its shuffle; nothing is collected. Vertices without edges (from ``vertices``,
    column id) are their own component."""
    pairs = cut(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        mark = Observation()  # of the cut's own job
        held, pairs = pairs, cut(linked.where("u <> v").distinct().observe(mark, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        release(held)
        after = mark.get
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component"))
    ends = edges.where("src is not null and dst is not null").select(F.explode(F.array("src", "dst")).alias("v"))
    if vertices is not None:
        ends = ends.unionByName(vertices.select(F.col("id").alias("v")))
    return ends.distinct().join(roots.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def min_label(vertices: DataFrame, adjacency: DataFrame, **how) -> tuple[DataFrame, Stats]:
    """id, label: label propagation by neighbour minimum from label = id, as many supersteps as the longest shortest path."""
    start = vertices.select("id", F.col("id").alias("label"))
    return run_supersteps(start, adjacency, F.col("s.label"), F.min, {"label": lambda m: F.least("label", m)}, **how)


def pagerank(edges: DataFrame, steps: int = 30, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """id, rank over directed edges (src, dst): r = (1 - d) / N + d * sum(r / outdegree), from 1 / N, for a fixed number of
    supersteps or until no rank moves by more than ``tolerance``. What vertices without edges out hold isn't passed on."""
    links = edges.select("src", "dst").distinct()
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    state = ids.join(out, "id", "left").select("id", "out", F.lit(1.0 / n).alias("rank"), F.lit(1.0).alias("moved"))
    new = lambda m: F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce(m, F.lit(0.0))
    settled = (lambda s, _: s.agg(F.max("moved")).first()[0] <= tolerance) if tolerance is not None else None
    done, _ = run_supersteps(state, links, F.col("s.rank") / F.col("s.out"), F.sum, {"moved": lambda m: F.abs(new(m) - F.col("rank")), "rank": new}, max_steps=steps, frontier_only=False, fixed_steps=True, stop=settled, cut_every=3)
    return done.select("id", "rank")


@dataclass
class Mutations:
    """What a step asks for: vertices to create and delete, explicit edges, messages (dst, seq, payload...)."""

    create: DataFrame | None = None
    delete: DataFrame | None = None
    edges: DataFrame | None = None
    messages: DataFrame | None = None


def deliver(messages: DataFrame | None, vertices: DataFrame, newest_first: bool = True) -> DataFrame:
    """id, mail: the messages of each vertex as an array, newest first; messages to vertices that aren't there drop out."""
    rest = [c for c in messages.columns if c != "dst"]
    mail = messages.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*rest)), asc=not newest_first).alias("mail"))
    return vertices.join(mail, "id")


def run_dynamic(graph: model.Graph, step: Callable[[int, model.Graph, DataFrame | None], Mutations], max_steps: int, derive: Callable[[DataFrame], DataFrame] | None = None) -> tuple[model.Graph, Stats]:
    """A graph that changes while it runs: ``step(k, graph, messages)`` sees the vertices created before step k and the
    messages of step k - 1; what it asks for is applied after it (deletes cascade to edges). ``derive`` makes the implicit
    edges of the new vertices. Ends when a step asks for nothing."""
    stats, mail = Stats(), None
    for k in range(max_steps):
        t = time.monotonic()
        m = step(k, graph, mail)
        if m.create is None and m.delete is None and m.edges is None and m.messages is None:
            stats.ended = "settled"
            break
        v, e = graph.vertices, graph.edges
        if m.create is not None:
            v = v.unionByName(m.create)
        graph = model.Graph(v, e)
        if m.delete is not None:
            graph = model.delete_vertices(graph, m.delete)
        if m.edges is not None:
            graph = model.add_explicit_edges(graph, m.edges)
        vertices = cut(graph.vertices)
        edges = graph.edges if derive is None else derive(vertices).unionByName(graph.edges.where(F.col("kind") == model.EXPLICIT))
        graph = model.Graph(vertices, cut(edges))
        mail = cut(m.messages) if m.messages is not None else None
        stats.steps.append((k, -1, time.monotonic() - t))
    else:
        stats.ended = "steps"
    return graph, stats


def update_in_pandas(vertices: DataFrame, adjacency: DataFrame, update: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The escape hatch for updates that columns can't express: ``update(vertex row, its neighbours)`` per vertex,
    the neighbours as rows of _at, dst, dir and their attributes with n_ before the name.

    Each vertex's neighbourhood must fit a task; aggregate with :func:`run_supersteps` where it may not."""
    names = [c for c in vertices.columns if c != "id"]
    near = adjacency.join(vertices.select(F.col("id").alias("dst"), *[F.col(c).alias(f"n_{c}") for c in names]), "dst").select(F.col("src").alias("_at"), "dst", "dir", *[f"n_{c}" for c in names])

    def apply(v: pd.DataFrame, neighbours: pd.DataFrame) -> pd.DataFrame:
        return update(v, neighbours)

    return vertices.groupBy("id").cogroup(near.groupBy("_at")).applyInPandas(apply, schema)

