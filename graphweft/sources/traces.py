"""Trace sinks, and parsers of logs and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model

_DIRS = ("IN", "OUT", "BI")


def _step(step: int | Column) -> Column:
    return step.cast("string") if isinstance(step, Column) else F.lit(str(step))


def vertex_lines(vertices: DataFrame, attributes: list[str], step: int | Column) -> DataFrame:
    """value: step,owner,id,n,(slot,value)* per vertex, at one step or at that of a column; null attributes are written as nan."""
    pairs = [F.concat(F.lit(f"{i},"), F.when(F.col(a).isNull(), "nan").otherwise(F.format_string("%f", F.col(a).cast("double")))) for i, a in enumerate(attributes)]
    text = lambda c: F.lower(F.regexp_replace(c, "Infinity", "inf"))
    return vertices.select(text(F.concat_ws(",", _step(step), F.col("owner").cast("string"), F.col("id").cast("string"), F.lit(str(len(attributes))), *pairs)).alias("value"))


def edge_lines(vertices: DataFrame, edges: DataFrame, step: int | Column) -> DataFrame:
    """value: step,owner,id,(DIR:owner:offset)* per vertex, entries in order of direction and target."""
    names = F.element_at(F.array(*[F.lit(d) for d in _DIRS]), F.col("dir").cast("int"))
    adj = model.adjacency(edges).where("dir > 0").select(F.col("src").alias("id"), F.struct("dir", "dst", F.concat_ws(":", names, model.owner_of(F.col("dst")).cast("string"), model.offset_of(F.col("dst")).cast("string")).alias("t")).alias("e"))
    lists = adj.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias("l"))
    return vertices.join(lists, "id", "left").select(F.concat_ws(",", _step(step), F.col("owner").cast("string"), F.col("id").cast("string"), "l").alias("value"))


def dump_step(graph: model.Graph, attributes: list[str], step: int, folder: str) -> None:
    """Both traces of a step as text under <folder>/vertices/step=... and <folder>/edges/step=...; written again whole if a
    step is retried."""
    vertex_lines(graph.vertices, attributes, step).write.mode("overwrite").text(f"{folder}/vertices/step={step}")
    edge_lines(graph.vertices, graph.edges, step).write.mode("overwrite").text(f"{folder}/edges/step={step}")


def read_trace_lines(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """file_id, line_no (both long), kind, line of dumped traces, ready for the parser. A file's id is the hash of its path.
    Line numbers rise within a file and come once in the whole folder; they aren't dense."""
    sub = {"vertex": "vertices", "edge": "edges"}[kind]
    lines = spark.read.text(f"{folder}/{sub}")
    return lines.select(F.xxhash64(F.input_file_name()).alias("file_id"), F.monotonically_increasing_id().alias("line_no"), F.lit(kind).alias("kind"), F.col("value").alias("line"))


def joined_lines(lines: DataFrame, most: int = 500) -> DataFrame:
    """file_id, line_no, kind, text: the lines of each file and kind as raw text again, in blocks of up to ``most`` line
    numbers from the given line on, ready for ``parse_texts``. Rows repeated unchanged count once, missing numbers are empty
    lines."""
    at = F.col("line_no")
    block = (F.floor(at / most) * most).cast(lines.schema["line_no"].dataType)
    rows = lines.groupBy("file_id", "kind", block.alias("block")).agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("rows"))
    by_no = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["line_no"], r["line"])))
    first, last = F.col("rows")[0]["line_no"], F.element_at("rows", -1)["line_no"]
    text = F.array_join(F.transform(F.sequence(first, last), lambda n: F.coalesce(by_no[n], F.lit(""))), "\n")
    return rows.select("file_id", first.alias("line_no"), "kind", text.alias("text"))


def key_values(lines: DataFrame, names: dict[str, str], text: str = "value") -> DataFrame:
    """The lines with a column per name: the number behind the first match of its pattern, null without one."""
    return lines.select("*", *[F.regexp_extract(text, p, 1).try_cast("double").alias(n) for n, p in names.items()])


def performance_records(lines: DataFrame, metrics: dict[str, str], total: str = "total", text: str = "value") -> DataFrame:
    """metric, mean, n: means over the log lines that report an iteration (whose ``total`` pattern is found)."""
    read = key_values(lines, metrics, text).where(F.col(total).isNotNull())
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("e")
    return read.select(entries).groupBy("e.metric").agg(F.avg("e.x").alias("mean"), F.count("e.x").alias("n"))


def community_summary(lines: DataFrame, text: str = "value") -> DataFrame:
    """community, supernodes: from lines that name a supernode and its community (the first two whole numbers)."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    rows = lines.where(F.size(numbers) >= 2).select(numbers[0].cast("long").alias("supernode"), numbers[1].cast("long").alias("community"))
    return rows.groupBy("community").agg(F.array_sort(F.collect_set("supernode")).alias("supernodes"))
