"""Queries of the sources and sinks: whole tables written in a format, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model
from graphweft.operators import bsp, neighbors
from graphweft.plans.graphs import _COMPONENTS, GRAPH, draw, trace_adjacency, trace_edges, trace_vertices
from graphweft.session import scratch, table
from graphweft.sources import readers, trace_parser, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_ACTORS = "SELECT c_custkey AS actor, (c_custkey * 7 % 1000) / 8 AS px, (c_custkey * 11 % 1000) / 8 AS py, (c_custkey * 13 % 1000) / 8 AS dst_x, (c_custkey * 17 % 1000) / 8 AS dst_y, (c_custkey % 9 = 0)::INTEGER AS infected FROM customer"


def _actors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    at = lambda k: c * k % 1000 / 8.0
    return table(spark, d, "customer").select(c.alias("actor"), at(7).alias("px"), at(11).alias("py"), at(13).alias("dst_x"), at(17).alias("dst_y"), (c % 9 == 0).cast("int").alias("infected"))


@query(_ACTORS)
def actor_file(spark: SparkSession, d: str) -> DataFrame:
    """Binary actors, written and read back."""
    folder = scratch(spark, "actors")
    readers.write_actors(_actors(spark, d), folder)
    return readers.read_actors(spark, folder)


@query(f"SELECT * FROM ({_ACTORS}) WHERE px >= 25 AND px < 100 AND py >= 25 AND py < 100")
def actor_file_cell(spark: SparkSession, d: str) -> DataFrame:
    """An owner's cell of a binary actor file."""
    folder = scratch(spark, "actors")
    readers.write_actors(_actors(spark, d), folder)
    return readers.read_actors(spark, folder, (25, 100, 25, 100))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey / 4 ELSE s_suppkey + 0.5 END::DOUBLE AS x, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_suppkey * 2.0 END::DOUBLE AS y, (s_suppkey * 100.0)::DOUBLE AS z FROM supplier")
def point_file(spark: SparkSession, d: str) -> DataFrame:
    """Points from lines of numbers, some written carelessly."""
    k = F.col("s_suppkey")
    x = F.when(k % 3 == 0, F.concat((k / 4).cast("string"), F.lit(".7x"))).otherwise((k + 0.5).cast("string"))
    y = F.when(k % 5 == 0, F.lit("none")).otherwise((k * 2).cast("string"))
    folder = scratch(spark, "points")
    table(spark, d, "supplier").select(F.concat_ws(",", x, y, F.concat(k.cast("string"), F.lit("e2")), k.cast("string"))).write.text(folder)
    return readers.read_points(spark, folder, 4).select("id", "x", "y", "z")


_PARTS = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"
_SIZE = 2_000_000


def _part_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


_OWNED = f"SELECT src, dst, (src // {_SIZE // 1000})::INTEGER AS src_owner, (dst // {_SIZE // 1000})::INTEGER AS dst_owner FROM ({_PARTS})"


@query(_OWNED)
def binary_graph(spark: SparkSession, d: str) -> DataFrame:
    """A whole graph in column-split binary files, with owners of equal ranges."""
    folder = scratch(spark, "graph")
    readers.write_binary_graph(_part_edges(spark, d), folder, _SIZE)
    return readers.read_binary_graph(spark, folder, owners=1000)


@query(_OWNED)
def narrow_binary_graph(spark: SparkSession, d: str) -> DataFrame:
    """The same with numbers of four bytes."""
    folder = scratch(spark, "graph")
    readers.write_binary_graph(_part_edges(spark, d), folder, _SIZE, int_width=4)
    return readers.read_binary_graph(spark, folder, int_width=4, owners=1000)


_FIRST = draw("src", "dst") + " < 0.5"


@query(f"SELECT CASE WHEN f THEN src ELSE dst END AS src, CASE WHEN f THEN dst ELSE src END AS dst, (CASE WHEN f THEN src ELSE dst END // 250)::INTEGER AS src_owner FROM (SELECT *, {_FIRST} AS f FROM ({_PARTS}))")
def partitioned_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges dealt to their ends' owners, in pairs of binary files."""
    folder = scratch(spark, "parts")
    readers.write_partitioned_graph(_part_edges(spark, d), folder, _SIZE, 8000)
    return readers.read_partitioned_graph(spark, f"{folder}/*", owners=8000).select("src", "dst", "src_owner")


@query(f"SELECT (CASE WHEN {_FIRST} THEN src ELSE dst END // 250)::INTEGER AS owner, count(*) AS edges FROM ({_PARTS}) GROUP BY 1")
def partition_balance(spark: SparkSession, d: str) -> DataFrame:
    """How many edges each owner gets."""
    return readers.balance_edges(_part_edges(spark, d), _SIZE, 8000).groupBy("owner").agg(F.count("*").alias("edges"))


@query(_PARTS)
def matrix_market(spark: SparkSession, d: str) -> DataFrame:
    """A Matrix Market file, counted from 1."""
    folder = scratch(spark, "market")
    readers.write_matrix_market(_part_edges(spark, d), folder, _SIZE)
    return readers.read_matrix_market(spark, folder)


@query(_PARTS)
def text_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges as lines of two numbers."""
    folder = scratch(spark, "edges")
    _part_edges(spark, d).select(F.concat_ws(" ", "src", "dst")).write.text(folder)
    return readers.read_text_edges(spark, folder)


_FIXED = "CASE WHEN {0} IS NULL OR isnan({0}) THEN NULL ELSE round({0}, 3) END"


@query("SELECT step, owner, vec_id, " + _FIXED.format("vec[2]") + " AS px, " + _FIXED.format("vec[3]") + " AS py FROM (SELECT DISTINCT step, owner, vec_id, vec FROM vertex_trace_a)")
def vertex_trace_dump(spark: SparkSession, d: str) -> DataFrame:
    """All vertices dumped as trace lines, parsed again."""
    v = table(spark, d, "vertex_trace_a").select("step", "owner", F.col("vec_id").alias("id"), F.get("vec", F.lit(1)).alias("px"), F.get("vec", F.lit(2)).alias("py"), "vec").distinct()
    folder = scratch(spark, "trace")
    traces.vertex_lines(v, ["px", "py"], F.col("step")).write.text(f"{folder}/vertices")
    got = trace_parser.vertices(trace_parser.parse_trace_lines(traces.read_trace_lines(spark, folder, "vertex")))
    fixed = lambda i: F.round(F.nanvl(F.col("vec")[i], F.lit(None).cast("double")), 3)
    return got.select("step", "owner", "vec_id", fixed(0).alias("px"), fixed(1).alias("py"))


@query(f"WITH {GRAPH} SELECT s AS id, list(dir || ':' || t ORDER BY dir, t) AS edges FROM adj GROUP BY s")
def edge_trace_dump(spark: SparkSession, d: str) -> DataFrame:
    """All edges dumped as trace lines in order, parsed again; step and id are one number here."""
    e = trace_edges(spark, d)
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("owner", F.lit(0))
    folder = scratch(spark, "trace")
    traces.edge_lines(v, e, 0).write.text(f"{folder}/edges")
    got = trace_parser.edges(trace_parser.parse_trace_lines(traces.read_trace_lines(spark, folder, "edge")))
    one = lambda x: F.concat(F.when(x["dir"] == "IN", "1").when(x["dir"] == "OUT", "2").otherwise("3"), F.lit(":"), model.make_id(x["pe"], x["offset"]).cast("string"))
    return got.select(F.col("vec_id").alias("id"), F.transform("edges", one).alias("edges"))


@query(_COMPONENTS + "SELECT component % 1000003 AS community, list_sort(list(v % 1000003)) AS supernodes FROM comp GROUP BY component")
def community_report(spark: SparkSession, d: str) -> DataFrame:
    """Components written as lines of text, summarised by community."""
    folder = scratch(spark, "report")
    short = lambda c: F.col(c) % 1000003
    bsp.connected_components(trace_edges(spark, d)).select(F.concat(F.lit("supernode "), short("v"), F.lit(" is in community "), short("component"))).write.text(folder)
    return traces.community_summary(spark.read.text(folder))


@query("WITH u AS (SELECT DISTINCT ON (record_id) total, metadata, edges FROM perf_records), s AS (SELECT * FROM u WHERE total BETWEEN 0 AND 1e6), l AS (SELECT unnest([{'metric': 'total', 'x': total}, {'metric': 'metadata', 'x': metadata}, {'metric': 'edges', 'x': edges}], recursive := true) FROM s) SELECT metric, round(avg(x), 2) AS mean, count(x) AS n FROM l WHERE x IS NULL OR (x BETWEEN 0 AND 1e6) GROUP BY metric")
def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means of metrics out of log lines."""
    once = table(spark, d, "perf_records").groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("total", "metadata", "edges")]).where("total between 0 and 1e6")
    said = [F.when(F.col(c).between(0, 1e6), F.format_string(f"{c} took %.6f ms", F.col(c))) for c in ("total", "metadata", "edges")]
    folder = scratch(spark, "log")
    once.select(F.explode(F.array(F.concat_ws(", ", F.lit("iteration"), *said), F.lit("another line")))).write.text(folder)
    got = traces.performance_records(spark.read.text(folder), {c: rf"\b{c} took ([\d.]+) ms" for c in ("total", "metadata", "edges")})
    return got.select("metric", F.round("mean", 2).alias("mean"), "n")


def _halo_sql(k: int) -> str:
    return f"""WITH RECURSIVE {GRAPH}, p AS (SELECT DISTINCT s, t FROM adj), r(owner, id, dist) AS (SELECT owner, id, 0 FROM vx UNION SELECT r.owner, p.t, r.dist + 1 FROM r JOIN p ON p.s = r.id WHERE r.dist < {k}),
    m AS (SELECT owner, id, min(dist) AS dist FROM r GROUP BY ALL) SELECT m.owner, m.id, m.dist FROM m JOIN vx USING (id) WHERE vx.owner <> m.owner"""


@query(_halo_sql(2))
def halo(spark: SparkSession, d: str) -> DataFrame:
    """What each owner sees of others' vertices within two hops."""
    return neighbors.halo(trace_adjacency(spark, d), trace_vertices(spark, d), 2)
