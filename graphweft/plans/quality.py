"""Queries of the data-quality operators (the pN_ queries of the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import drift, spikes, tablediff
from graphweft.session import table
from graphweft.sources import trace_parser, traces


def _traces(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("vertex_trace_a", "vertex_trace_b", "edge_trace_a", "edge_trace_b")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every missing vertex or edge row and every differing field of the two copies."""
    return tablediff.difference_fields(tablediff.trace_differences(*_traces(spark, d)))


def p1_differences(spark: SparkSession, d: str) -> DataFrame:
    """The same by row, with the array of (field, left value, right value)."""
    return tablediff.trace_differences(*_traces(spark, d))


def trace_copies(spark: SparkSession, d: str) -> DataFrame:
    """Three copies, the third as the first, each compared with each: differences by pair, kind of row and field."""
    va, vb, ea, eb = _traces(spark, d)
    every = tablediff.compare_many({"a": (va, ea), "b": (vb, eb), "c": (va, ea)})
    fields = F.when(F.col("status") == "differs", F.transform("diffs", lambda x: x["field"])).otherwise(F.array("status"))
    return every.select("left", "right", "record", F.explode(fields).alias("field")).groupBy("left", "right", "record", "field").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that are spikes, stuck or impossible."""
    return spikes.find_spikes(table(spark, d, "perf_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that can't be read, and why."""
    return trace_parser.failures(trace_parser.parse_trace_lines(table(spark, d, "trace_lines"))).select("file_id", "line_no", "reason")


def p3_raw(spark: SparkSession, d: str) -> DataFrame:
    """The lines of whole raw texts, quotes over line ends and all, that can't be read, and where in the line."""
    parsed = trace_parser.parse_texts(traces.joined_lines(table(spark, d, "trace_lines")))
    return parsed.where("reason is not null").select("file_id", "line_no", "kind", "reason", "error_at", "error", "lines")


def p3_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The valid vertex lines as typed rows."""
    return trace_parser.vertices(trace_parser.parse_trace_lines(table(spark, d, "trace_lines")))


def p3_edges(spark: SparkSession, d: str) -> DataFrame:
    """The valid edge lines as typed rows."""
    return trace_parser.edges(trace_parser.parse_trace_lines(table(spark, d, "trace_lines")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of schema from file to file."""
    return drift.schema_changes(table(spark, d, "perf_files"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All records of all files under one schema."""
    return drift.consistent_table(table(spark, d, "perf_files"))


QUERIES = {"trace_copies": trace_copies, "p1_found": p1_found, "p1_differences": p1_differences, "p2_found": p2_found, "p3_found": p3_found, "p3_raw": p3_raw, "p3_vertices": p3_vertices, "p3_edges": p3_edges, "p4_found": p4_found, "p4_table": p4_table}

_P1_COPY = """
v_{c} AS (SELECT step, vec_id, vec, vec[1]::BIGINT AS uid FROM (SELECT DISTINCT step, vec_id, vec FROM vertex_trace_{c})),
r_{c} AS (SELECT DISTINCT step, vec_id, edges FROM edge_trace_{c}),
x_{c} AS (SELECT step, vec_id, unnest(coalesce(edges, [])) AS e FROM r_{c}),
t_{c} AS (SELECT x.step, x.vec_id, coalesce(t.uid, -1 - (x.e.pe::BIGINT * 4294967296 + x.e.offset)) AS target,
    CASE WHEN x.e.dir = 'BIDIRECTIONAL' THEN 'BI' ELSE x.e.dir END AS dir
  FROM x_{c} x LEFT JOIN v_{c} t ON t.step = x.step AND t.vec_id = x.e.pe::BIGINT * 4294967296 + x.e.offset),
e_{c} AS (SELECT r.step, v.uid FROM r_{c} r JOIN v_{c} v USING (step, vec_id)),
p_{c} AS (SELECT t.step, v.uid, t.target, list_sort(list(DISTINCT t.dir)) AS dirs
  FROM t_{c} t JOIN v_{c} v USING (step, vec_id) GROUP BY ALL)
"""
SQL = {
    "p1_found": "WITH " + _P1_COPY.format(c="a") + "," + _P1_COPY.format(c="b") + """,
jv AS (SELECT coalesce(a.step, b.step) AS step, coalesce(a.uid, b.uid) AS uid, a.vec_id AS ia, b.vec_id AS ib, a.vec AS va, b.vec AS vb, a.uid AS ua, b.uid AS ub
  FROM v_a a FULL JOIN v_b b ON a.step = b.step AND a.uid = b.uid),
slots AS (SELECT step, uid, k, va[k + 1] AS x, vb[k + 1] AS y FROM jv, range(0, 64) s(k) WHERE k < len(va) AND k < len(vb)),
je AS (SELECT coalesce(a.step, b.step) AS step, coalesce(a.uid, b.uid) AS uid, a.uid AS ua, b.uid AS ub FROM e_a a FULL JOIN e_b b ON a.step = b.step AND a.uid = b.uid),
both_rows AS (SELECT step, uid FROM je WHERE ua IS NOT NULL AND ub IS NOT NULL),
jp AS (SELECT coalesce(a.step, b.step) AS step, coalesce(a.uid, b.uid) AS uid, a.dirs AS da, b.dirs AS db
  FROM p_a a FULL JOIN p_b b ON a.step = b.step AND a.uid = b.uid AND a.target = b.target)
SELECT 'vertex' AS record, step, uid, CASE WHEN ua IS NULL THEN 'missing_in_a' ELSE 'missing_in_b' END AS field FROM jv WHERE ua IS NULL OR ub IS NULL
UNION ALL SELECT 'vertex', step, uid, 'vec_id' FROM jv WHERE ua IS NOT NULL AND ub IS NOT NULL AND ia IS DISTINCT FROM ib
UNION ALL SELECT 'vertex', step, uid, 'nelements' FROM jv WHERE ua IS NOT NULL AND ub IS NOT NULL AND len(va) IS DISTINCT FROM len(vb)
UNION ALL SELECT 'vertex', step, uid, 'vec.' || k FROM slots WHERE x IS DISTINCT FROM y AND NOT coalesce(abs(x - y) <= 1e-6, false)
UNION ALL SELECT 'edge', step, uid, CASE WHEN ua IS NULL THEN 'missing_in_a' ELSE 'missing_in_b' END FROM je WHERE ua IS NULL OR ub IS NULL
UNION ALL SELECT DISTINCT 'edge', step, uid, CASE WHEN da IS NULL OR db IS NULL THEN 'edges' ELSE 'dir' END
  FROM jp SEMI JOIN both_rows USING (step, uid) WHERE da IS DISTINCT FROM db
""",
}
_SWAPPED = "CASE field WHEN 'missing_in_a' THEN 'missing_in_b' WHEN 'missing_in_b' THEN 'missing_in_a' ELSE field END"
SQL["trace_copies"] = f"WITH found AS ({SQL['p1_found']}) SELECT 'a' AS left, 'b' AS right, record, field, count(*) AS n FROM found GROUP BY record, field UNION ALL SELECT 'b', 'c', record, {_SWAPPED}, count(*) FROM found GROUP BY record, field"
