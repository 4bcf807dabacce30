"""Readers and writers of the graph formats: binary actors, community CSV, binary graphs, Matrix Market, text edges.

Spark lists the files; binary ranges are read and written by the tasks through Arrow's file systems, by URI, so a file may
lie wherever both reach it. A large file is read in ranges by many tasks, and each partition writes a file of its own.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.scalars import uniform

#: Bytes of a file that a task reads at once.
PIECE = 64 << 20


def uri_of(path: str) -> str:
    """A path as a URI; one without a scheme is local."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    return path if "://" in path else "file://" + os.path.abspath(path)


def _read(uri: str, at: int, size: int) -> bytes:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def _numbers(uri: str, at: int, n: int, width: int) -> np.ndarray:
    return np.frombuffer(_read(uri, at, n * width), dtype=f"<i{width}").astype(np.int64)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path (a URI), length of the files at ``path``: a folder, file or glob."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")


def _pieces(files: DataFrame, n: str, unit: int) -> DataFrame:
    """The files' columns with start, stop: ranges of their ``n`` records of ``unit`` bytes, a row and a task each."""
    step = max(1, PIECE // unit)
    ranges = files.where(F.col(n) > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(step).cast("long"))))
    return ranges.withColumn("stop", F.least(F.col("start") + step, F.col(n))).repartition("path", "start")


def _with_header(files: DataFrame, names: list[str], width: int) -> DataFrame:
    """The files with the whole numbers at their beginning; files too short for them are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [(p, *_numbers(p, 0, len(names), width).tolist()) for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if size >= len(names) * width]
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*heads)], names=["path", *names])

    return files.mapInArrow(read, "path string, " + ", ".join(f"{n} long" for n in names))


def write_parts(rows: DataFrame, folder: str, encode: Callable[[pa.Table], dict[str, bytes]]) -> int:
    """Each partition as files <folder>/part-<number><suffix> of what ``encode`` makes of its rows (suffix -> bytes); the
    number of rows written. A partition must fit its task; a task that runs again writes the same files again."""
    uri = uri_of(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        n = sum(b.num_rows for b in got)
        if n:
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            fs.create_dir(path, recursive=True)
            for suffix, data in encode(pa.Table.from_batches(got)).items():
                with fs.open_output_stream(f"{path}/part-{TaskContext.get().partitionId():05d}{suffix}") as f:
                    f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_actors(spark: SparkSession, path: str, cell: tuple[float, float, float, float] | None = None) -> DataFrame:
    """actor, px, py, dst_x, dst_y, infected from records of six little-endian doubles (id, px, py, dst_x, dst_y,
    infected); ``cell`` (x0, x1, y0, y1) keeps those inside, lower bounds included. A torn last record is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, start, stop in zip(*(b.column(c).to_pylist() for c in ("path", "start", "stop"))):
                x = np.frombuffer(_read(p, start * 48, (stop - start) * 48), dtype="<f8").reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), *(pa.array(x[:, i]) for i in (1, 2, 3, 4)), pa.array(x[:, 5].astype(np.int32))], names=["actor", "px", "py", "dst_x", "dst_y", "infected"])

    files = _files(spark, path).withColumn("n", F.floor(F.col("length") / 48))
    rows = _pieces(files, "n", 48).mapInArrow(read, "actor long, px double, py double, dst_x double, dst_y double, infected int")
    if cell is None:
        return rows
    return rows.where((F.col("px") >= cell[0]) & (F.col("px") < cell[1]) & (F.col("py") >= cell[2]) & (F.col("py") < cell[3]))


def write_actors(actors: DataFrame, folder: str) -> int:
    """The actors as binary records, a file per partition; null attributes are written as NaN."""
    rows = actors.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("actor", "px", "py", "dst_x", "dst_y", "infected")])
    return write_parts(rows, folder, lambda t: {".bin": np.column_stack([t[c].to_numpy() for c in t.column_names]).astype("<f8").tobytes()})


def lenient_number(text: F.Column) -> F.Column:
    """The number a text begins with, 0 if it begins with none: what C's atof makes of it, exponents included."""
    head = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def read_points(spark: SparkSession, path: str, owners: int = 1) -> DataFrame:
    """id, owner, x, y, z from lines x,y,z,id. Empty lines are skipped, missing or unreadable fields are 0; lines are dealt
    to the owners by a hash of the line's place."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    f = F.split("value", ",")
    field = lambda i: F.coalesce(lenient_number(F.get(f, F.lit(i))), F.lit(0.0))
    return lines.select(field(3).cast("long").alias("id"), F.pmod(F.xxhash64("value"), F.lit(owners)).cast("int").alias("owner"), field(0).alias("x"), field(1).alias("y"), field(2).alias("z"))


def owner_of_vertex(v: F.Column, vertices: int, owners: int) -> F.Column:
    """The owner of a vertex when vertices are dealt out in equal ranges."""
    return F.floor(v / -(-vertices // owners)).cast("int")


def _read_edges(pieces: DataFrame, src: Callable[[dict], tuple[str, int]], dst: Callable[[dict], tuple[str, int]], width: int, vertices: str, owners: int) -> DataFrame:
    """k, src, dst and their owners of the ranges of ``pieces``, k being the place in the file; ``src`` and ``dst`` give the file and first byte of an end's
    numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ends = [_numbers(f, at + r["start"] * width, r["stop"] - r["start"], width) for f, at in (src(r), dst(r))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(r["start"], r["stop"])), *map(pa.array, ends), pa.array(np.full(len(ends[0]), r[vertices]))], names=["k", "src", "dst", "m"])

    pairs = pieces.mapInArrow(read, "k long, src long, dst long, m long")
    owner = lambda v: F.floor(F.col(v) / F.ceil(F.col("m") / owners)).cast("int")
    return pairs.select("k", "src", "dst", owner("src").alias("src_owner"), owner("dst").alias("dst_owner"))


def read_binary_graph(spark: SparkSession, path: str, int_width: int = 8, owners: int = 1) -> DataFrame:
    """src, dst, src_owner, dst_owner of whole graphs (a file, folder or glob of them): M, N, nz, then nz rows and nz columns.
    ``int_width``: 8, or 4 for files made from Matrix Market by the narrow writer."""
    files = _with_header(_files(spark, path), ["m", "n", "nz"], int_width)
    head = 3 * int_width
    return _read_edges(_pieces(files, "nz", int_width), lambda r: (r["path"], head), lambda r: (r["path"], head + r["nz"] * int_width), int_width, "m", owners).drop("k")


def write_binary_graph(edges: DataFrame, folder: str, vertices: int, int_width: int = 8) -> int:
    """Edges (src, dst) in the whole-graph format, a file per partition with the edges it has."""
    head = lambda t: np.array([vertices, vertices, t.num_rows], dtype=f"<i{int_width}").tobytes()
    return write_parts(edges.select("src", "dst"), folder, lambda t: {".graph": head(t) + b"".join(t[c].to_numpy().astype(f"<i{int_width}").tobytes() for c in ("src", "dst"))})


def read_partitioned_graph(spark: SparkSession, stem: str, owners: int = 1) -> DataFrame:
    """k, src, dst, src_owner, dst_owner of pairs of files <stem>_0 and <stem>_1 (a stem may be a glob), each M, N, nz, n, then n
    end points. Both files of a pair have the same n."""
    files = _with_header(_files(spark, f"{stem}_0"), ["m", "n", "nz", "here"], 8)
    return _read_edges(_pieces(files, "here", 8), lambda r: (r["path"], 32), lambda r: (r["path"][:-1] + "1", 32), 8, "m", owners)


def write_partitioned_graph(edges: DataFrame, folder: str, vertices: int, owners: int) -> int:
    """Edges dealt to the owners of their ends (:func:`balance_edges`) as pairs of files; a partition writes what it has of an
    owner, so an owner with many edges has several pairs."""
    total = edges.count()

    def encode(t: pa.Table) -> dict[str, bytes]:
        out, owner = {}, t["owner"].to_numpy()
        for k in np.unique(owner):
            mine = owner == k
            head = np.array([vertices, vertices, total, mine.sum()], dtype="<i8").tobytes()
            for i, c in enumerate(("local", "other")):
                out[f".npes={owners}.pe={k}_{i}"] = head + t[c].to_numpy()[mine].astype("<i8").tobytes()
        return out

    return write_parts(balance_edges(edges, vertices, owners), folder, encode)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, from 0, of coordinate pattern general matrices. Another kind of matrix is refused; lines that aren't two whole
    numbers are left out, as are comments and the size line."""

    def banners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [_read(p, 0, 256).split(b"\n")[0].decode("utf-8", "replace").lower().split()[:5] for p in b.column(0).to_pylist()]
            wrong = [p for p, h in zip(b.column(0).to_pylist(), heads) if h != ["%%matrixmarket", "matrix", "coordinate", "pattern", "general"]]
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string())], names=["path"])

    wrong = _files(spark, path).mapInArrow(banners, "path string").take(1)
    if wrong:
        raise ValueError(f"not a coordinate pattern general matrix: {os.path.basename(wrong[0][0])}")
    # the size line alone has three numbers
    f = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+\s*$"))
    return pairs.select((F.get(f, F.lit(0)).cast("long") - 1).alias("src"), (F.get(f, F.lit(1)).cast("long") - 1).alias("dst"))


def write_matrix_market(edges: DataFrame, folder: str, vertices: int) -> int:
    """Edges as coordinate pattern general matrices, a file per partition."""
    banner = "%%MatrixMarket matrix coordinate pattern general\n"
    lines = lambda t: "".join(f"{i + 1} {j + 1}\n" for i, j in zip(t["src"].to_pylist(), t["dst"].to_pylist()))
    return write_parts(edges.select("src", "dst"), folder, lambda t: {".mtx": f"{banner}% one edge a line\n{vertices} {vertices} {t.num_rows}\n{lines(t)}".encode()})


def read_text_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines "src dst"; other lines are left out."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+\s*$")).select(F.get(f, F.lit(0)).cast("long").alias("src"), F.get(f, F.lit(1)).cast("long").alias("dst"))


def balance_edges(edges: DataFrame, vertices: int, owners: int) -> DataFrame:
    """local, other, owner: each edge with one of its ends' owners, its end there first. Which end is a hash of the edge,
    so about half of each owner's edges go either way, without an order-dependent count."""
    a, b = owner_of_vertex(F.col("src"), vertices, owners), owner_of_vertex(F.col("dst"), vertices, owners)
    first = uniform("src", "dst") < 0.5
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return edges.select(pick(F.col("src"), F.col("dst")).alias("local"), pick(F.col("dst"), F.col("src")).alias("other"), pick(a, b).alias("owner"))
