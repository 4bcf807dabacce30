"""Neighbour lookups and aggregates over the adjacency view."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import cut, release


def neighbor_fetch(adjacency: DataFrame, vertices: DataFrame) -> DataFrame:
    """src, dir, n: every neighbour of every vertex with its attributes as a struct; ends that aren't there drop out."""
    n = vertices.select(F.col("id").alias("dst"), F.struct(*vertices.columns).alias("n"))
    return adjacency.join(n, "dst").select("src", "dir", "n")


def neighbor_min(adjacency: DataFrame, vertices: DataFrame, attribute: str, init: Column) -> DataFrame:
    """id, least: the least of ``init`` (over the vertex) and the attribute of all its neighbours, whatever the direction."""
    low = adjacency.join(vertices.select(F.col("id").alias("dst"), F.col(attribute).alias("_x")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("_x").alias("_x"))
    return vertices.withColumn("_i", init).join(low, "id", "left").select("id", F.least("_i", "_x").alias("least"))


def neighbor_any(adjacency: DataFrame, vertices: DataFrame, condition: Column, inbound_only: bool = False) -> DataFrame:
    """Vertices (id) with a neighbour for which ``condition`` holds."""
    edges = adjacency.where(F.col("dir").bitwiseAND(1) == 1) if inbound_only else adjacency
    return edges.join(vertices.where(condition).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def degrees(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_stats(adjacency: DataFrame) -> DataFrame:
    d = degrees(adjacency)
    return d.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"), F.count("*").alias("n"))


def max_degree_vertex(adjacency: DataFrame) -> DataFrame:
    """The vertex with most edges, ties to the least id: partial aggregation, no sort."""
    best = F.max(F.struct("degree", (-F.col("id")).alias("_neg")))
    return degrees(adjacency).agg(best.alias("b")).where("b is not null").select((-F.col("b._neg")).alias("id"), F.col("b.degree").alias("degree"))


def oriented(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., lo, hi: each edge of each graph (named by ``by``) once from the end of lower degree to that of higher (ties by
    id), self edges left out. A vertex has at most as many edges out as the square root of twice all edges, so paths through
    a hub stay few."""
    e = edges.where("src <> dst").select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = e.select(*by, F.explode(F.array("src", "dst")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("d"))
    ranked = e.join(both.select(*by, F.col("id").alias("src"), F.col("d").alias("ds")), [*by, "src"]).join(both.select(*by, F.col("id").alias("dst"), F.col("d").alias("dd")), [*by, "dst"])
    first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return ranked.select(*by, F.when(first, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("hi"))


def triangles(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., a < b < c of every triangle, once."""
    o = oriented(edges, by)
    wedges = o.select(*by, "lo", F.col("hi").alias("x")).join(o.select(*by, "lo", F.col("hi").alias("y")), [*by, "lo"]).where("x < y")
    closing = o.select(*by, F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"))
    closed = wedges.join(closing, [*by, "x", "y"])
    three = F.array_sort(F.array("lo", "x", "y"))
    return closed.select(*by, three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def wedge_closure(edges: DataFrame) -> DataFrame:
    """id, degree, wedges, closed: pairs of neighbours of each vertex, and how many of them are linked."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    deg = plain.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    closed = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("closed"))
    return deg.join(closed, "id", "left").select("id", "degree", F.expr("degree * (degree - 1) div 2").alias("wedges"), F.coalesce("closed", F.lit(0)).alias("closed"))


def two_hop(adjacency: DataFrame) -> DataFrame:
    """src, dst: vertices exactly two hops apart, once each."""
    a = adjacency.where("src <> dst").select("src", "dst").distinct()
    far = a.select("src", F.col("dst").alias("m")).join(a.select(F.col("src").alias("m"), "dst"), "m").where("src <> dst").select("src", "dst").distinct()
    return far.join(a, ["src", "dst"], "left_anti")


def khop(adjacency: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """id, dist: vertices within ``k`` hops of ``seeds`` (column id); only the frontier is joined."""
    a = adjacency.select("src", "dst")
    seen = cut(seeds.select("id").distinct().withColumn("dist", F.lit(0)))
    for hop in range(1, k + 1):
        front = seen.where(F.col("dist") == hop - 1).select(F.col("id").alias("src"))
        new = a.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(hop))
        before, seen = seen, cut(seen.unionByName(new))
        release(before)
        if seen.where(F.col("dist") == hop).isEmpty():
            break
    return seen


def halo(adjacency: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """owner, id, dist: the vertices of others that lie within ``k`` hops of an owner's own; of vertices (id, owner)."""
    a, own = adjacency.select("src", "dst").distinct(), vertices.select("owner", "id")
    seen = cut(own.withColumn("dist", F.lit(0)))
    for hop in range(1, k + 1):
        front = seen.where(F.col("dist") == hop - 1).select("owner", F.col("id").alias("src"))
        new = front.join(a, "src").select("owner", F.col("dst").alias("id")).distinct().join(seen, ["owner", "id"], "left_anti").withColumn("dist", F.lit(hop))
        before, seen = seen, cut(seen.unionByName(new))
        release(before)
    return seen.where("dist > 0").join(own.select("id"), "id", "left_semi").select("owner", "id", "dist")


def downstream(adjacency: DataFrame, changed: DataFrame) -> DataFrame:
    """id: vertices that become active when those of ``changed`` (column id) change: their neighbours over edges that
    aren't inbound only."""
    return adjacency.where("dir <> 1").join(changed.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def neighbor_sums(adjacency: DataFrame, vertices: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """id and the sum of each term over the neighbours' attributes (struct n): weighted sums, counts by class, forces."""
    return neighbor_fetch(adjacency, vertices).groupBy(F.col("src").alias("id")).agg(*[F.sum(t).alias(k) for k, t in terms.items()])


def partition_min_distance(vertices: DataFrame, distance: DataFrame) -> DataFrame:
    """part, dist: the least distance (id, dist) of each partition's vertices."""
    return vertices.join(distance, "id").groupBy("part").agg(F.min("dist").alias("dist"))


def latest_message(messages: DataFrame, to: str, order: list[str]) -> DataFrame:
    """The newest message of each receiver; older ones are flushed. Partial aggregation instead of a sort per receiver."""
    rest = [c for c in messages.columns if c != to and c not in order]
    return messages.groupBy(to).agg(F.max(F.struct(*order, *rest)).alias("m")).select(to, "m.*")


def previous_state(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``rows`` with ``prev``: the value of the same entity at the time before."""
    return rows.withColumn("prev", F.lag(value).over(Window.partitionBy(key).orderBy(time)))


def forward_fill(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``filled``: the last value that isn't null up to each row."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(upto))


def top_by_owner(rows: DataFrame, owner: str, score: str, tie: str, n: int) -> DataFrame:
    """The ``n`` best rows of each owner by score, ties by ``tie``, with their rank."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def aggregate_by(rows: DataFrame, key: str, **terms: Callable | Column) -> DataFrame:
    return rows.groupBy(key).agg(*[t.alias(k) for k, t in terms.items()])
