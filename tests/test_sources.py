import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft import model
from graphweft.functions import scalars, sketches
from graphweft.sources import generators, readers, trace_parser, traces
from graphweft.streaming import ingest


def test_binary_actors_and_graphs(spark, tmp_path):
    np.array([[1, 2.5, 3, 4, 5, 1], [2, 50, 3, 4, 5, 0]], dtype="<f8").tofile(tmp_path / "actors")
    (tmp_path / "actors").open("ab").write(b"torn")
    assert readers.read_actors(spark, str(tmp_path / "actors")).count() == 2
    assert [tuple(r) for r in readers.read_actors(spark, str(tmp_path / "actors"), (0, 10, 0, 10)).collect()] == [(1, 2.5, 3.0, 4.0, 5.0, 1)]
    edges = spark.createDataFrame([(0, 3), (2, 1), (9, 5)], "src long, dst long")
    readers.write_binary_graph(edges, str(tmp_path / "g"), 10)
    back = readers.read_binary_graph(spark, str(tmp_path / "g"), owners=4)
    assert sorted(map(tuple, back.collect())) == [(0, 3, 0, 1), (2, 1, 0, 0), (9, 5, 3, 1)]
    np.array([10, 10, 3, 0, 2, 9, 3, 1, 5], dtype="<i4").tofile(tmp_path / "narrow")
    assert readers.read_binary_graph(spark, str(tmp_path / "narrow"), int_width=4).count() == 3
    for i, ends in enumerate(([0, 2], [3, 1])):
        np.array([10, 10, 3, 2, *ends], dtype="<i8").tofile(tmp_path / f"part_{i}")
    assert [(r["src"], r["dst"]) for r in readers.read_partitioned_graph(spark, str(tmp_path / "part")).orderBy("k").collect()] == [(0, 3), (2, 1)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "c.csv").write_text("0.0,1,2.5,7\n\n0.0.11,x,1e1,8\n")
    rows = {r["id"]: (r["x"], r["y"], r["z"]) for r in readers.read_points(spark, str(tmp_path / "c.csv")).collect()}
    assert rows == {7: (0.0, 1.0, 2.5), 8: (0.0, 0.0, 10.0)}
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n% note\n4 4 2\n1 2\n4 1\n")
    assert sorted(map(tuple, readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 1), (3, 0)]
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n")
    with pytest.raises(ValueError):
        readers.read_matrix_market(spark, str(tmp_path / "bad.mtx"))
    (tmp_path / "e.txt").write_text("1 2\n3 4\nx\n")
    assert readers.read_text_edges(spark, str(tmp_path / "e.txt")).count() == 2
    balanced = readers.balance_edges(generators.kronecker(spark, 6), 64, 4)
    assert balanced.count() == 1024 and balanced.select("owner").distinct().count() == 4


def test_generators_repeat(spark):
    a, b = (generators.kronecker(spark, 5).agg(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()[0] for _ in range(2))
    assert a == b
    act = generators.actors(spark, 50, (10.0, 20.0), infected=3)
    assert act.where("px < 0 or px >= 10 or py >= 20 or dst_x < 0 or dst_x >= 10").count() == 0 and act.agg(F.sum("infected")).first()[0] == 3
    v = generators.vertex_stream(spark, 4, 2, (3, 6), (100, 10, 10))
    assert v.select("id").distinct().count() == v.count() and v.where("owner = 1 and x < 50").count() == 0
    e = generators.edge_stream(spark, 3, 2, 5, 20)
    assert e.count() == 30 and e.where(model.owner_of(F.col("src")) != F.col("owner")).count() == 0
    assert generators.batches(spark.range(10), 4, "id").groupBy("batch").count().orderBy("batch").select("count").collect() == [(4,), (4,), (2,)]
    assert generators.ring(spark, 3).where("dst = 0").first()["id"] == 2


def test_traces_written_and_parsed_again(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 2.5, None), (2**32 + 3, 1, -1.0, float("nan"))], "id long, owner int, x double, y double")
    e = model.canonical_edges(spark.createDataFrame([(1, 2**32 + 3, 2)], "src long, dst long, dir tinyint"))
    traces.dump_step(model.Graph(v, e), ["x", "y"], 7, str(tmp_path))
    got = trace_parser.parse_trace_lines(traces.read_trace_lines(spark, str(tmp_path), "vertex")).orderBy("vec_id").collect()
    assert [(r["reason"], r["step"], r["owner"], r["vec"][0]) for r in got] == [(None, 7, 0, 2.5), (None, 7, 1, -1.0)] and got[0]["vec"][1] != got[0]["vec"][1]
    got = trace_parser.parse_trace_lines(traces.read_trace_lines(spark, str(tmp_path), "edge")).orderBy("vec_id").collect()
    assert [[tuple(x) for x in r["edges"]] for r in got] == [[("OUT", 1, 3)], [("IN", 0, 1)]]


def test_logs(spark):
    lines = spark.createDataFrame([("total 10.5 ms edges 2",), ("noise",), ("total 11.5 ms",)], "value string")
    got = {r["metric"]: (r["mean"], r["n"]) for r in traces.performance_records(lines, {"total": r"total ([\d.]+)", "edges": r"edges ([\d.]+)"}).collect()}
    assert got == {"total": (11.0, 2), "edges": (2.0, 1)}
    s = traces.community_summary(spark.createDataFrame([("node 5 in 1",), ("node 3 in 1",), ("x",)], "value string")).first()
    assert (s["community"], s["supernodes"]) == (1, [3, 5])


def test_scalars_and_sketches(spark):
    r = spark.range(1).select(scalars.djb2(F.lit("ab")).alias("h"), scalars.edge_key(F.lit(5).cast("long"), F.lit(2).cast("long")).alias("e"), scalars.pattern_distance(F.lit(5), F.lit(6)).alias("d"), F.size(scalars.moore_neighborhood(F.lit(0), F.lit(1), 4, 4)).alias("m"), scalars.wrap(F.lit(-1.0), 10).alias("w"), scalars.bites(F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert (r["h"], r["e"], r["d"], r["m"], r["w"], r["b"]) == ((5381 * 33 + 97) * 33 + 98, 3, 2, 6, 9.0, 0.0)
    items = spark.range(500).select((F.col("id") % 40).alias("x"))
    a, b = sketches.build(items, F.col("x")), sketches.build(items.where("x < 10"), F.col("x"))
    est = {r["x"]: r["estimate"] for r in sketches.estimate(sketches.merge(a, b), items.distinct(), "x").collect()}
    assert all(est[x] >= (12 + (x < 20)) + ((12 + (x < 20)) if x < 10 else 0) for x in est) and sketches.total(a).first()["total"] == 500


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "in"
    parts = [[(1, 2), (3, 4)], [(2, 3), (8, 9), (1, 2)], [(9, 10), (7, 7)]]
    for i, p in enumerate(parts):
        spark.createDataFrame([(a, b, 3) for a, b in p], "src long, dst long, dir tinyint").coalesce(1).write.parquet(str(folder / str(i)))
        time.sleep(0.05)
    stream = lambda: ingest.edge_file_stream(spark, str(folder / "*"), "src long, dst long, dir tinyint")
    ingest.stream_components(stream(), str(tmp_path / "cc"), str(tmp_path / "ck1")).awaitTermination()
    assert {r["v"]: r["component"] for r in ingest.current_components(spark, str(tmp_path / "cc")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, 7: 7}
    ingest.stream_graph(stream(), str(tmp_path / "g"), str(tmp_path / "ck2")).awaitTermination()
    assert ingest.current_edges(spark, str(tmp_path / "g")).count() == 6
    assert len(list((tmp_path / "cc/merged").iterdir())) == 2  # older versions are gone
    assert spark.read.parquet(str(tmp_path / "g/rates")).agg(F.sum("fresh")).first()[0] == 6
    ingest.stream_bursts(stream(), scalars.edge_key(F.col("src"), F.col("dst")), str(tmp_path / "b"), str(tmp_path / "ck3"), factor=1.0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b/alerts")).count() >= 1


def test_windowed_stream(spark, tmp_path):
    t = datetime.datetime(2030, 1, 1)
    spark.createDataFrame([(t + datetime.timedelta(seconds=40 * i), "a" if i % 2 else "b") for i in range(6)], "ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(s, "ts", "1 minute", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM windowed").first()["n"] == 6
