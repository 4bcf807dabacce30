import time

import pytest
from pyspark.sql import functions as F

from graphweft import model, session
from graphweft.analytics import bursts, communities, simulation
from graphweft.operators import bsp, coupling, neighbors, rangejoin, sets, similarity
from graphweft.plans import graphs
from graphweft.sources import generators


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edges_made_turned_and_removed(spark):
    edges = spark.createDataFrame([(1, 2, 3, 0), (1, 3, 1, 0), (2, 3, 2, 1)], "src long, dst long, dir tinyint, kind tinyint")
    # 2-1 as seen from 2 becomes inbound to 2; 1-3 goes; the explicit 2-3 stays; 4-5 is new; 6-7 isn't there and goes
    changes = spark.createDataFrame([(2, 1, 1), (1, 3, 0), (2, 3, 0), (4, 5, 2), (6, 7, 0)], "src long, dst long, dir tinyint")
    after, active = model.upsert_edges(edges, changes)
    assert rows(after) == [(1, 2, 2, 0), (2, 3, 2, 1), (4, 5, 2, 0)]
    # 1 loses an inbound edge twice, 5 gets one
    assert [r[0] for r in rows(active)] == [1, 5]
    assert model.upsert_edges(edges.limit(0), changes.limit(0))[0].count() == 0


def test_updates_are_merged(spark):
    v = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "id long, n string, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 0.0)], "id long, n string, x double")
    assert {tuple(r) for r in model.apply_updates(v, new).collect()} == {(1, "a", None), (2, None, 5.0), (3, "c", 0.0)}
    assert [r["x"] for r in model.map_vertices(v, x=F.col("x") + 1).orderBy("id").collect()] == [None, 2.0]


def test_relation_log(spark):
    log = spark.createDataFrame([(1, 1, 1, True), (1, 1, 3, False), (1, 2, 2, True), (2, 1, 5, True), (2, 1, 5, False), (3, 1, 4, True)], "i long, j long, seq long, on boolean")
    assert rows(sets.relation_at(log)) == [(1, 2, 2), (3, 1, 4)]
    assert rows(sets.relation_at(log, 2)) == [(1, 1, 1), (1, 2, 2)]
    assert rows(sets.row_versions(log)) == [(1, 3), (2, 5), (3, 4)]
    pairs = sets.pair_remove(log.select("i", "j").distinct(), spark.createDataFrame([(1,)], "i long"))
    assert rows(pairs) == [(2, 1), (3, 1)]


def test_lock_step_ends_by_cluster(spark):
    cluster = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "owner int, cluster int")
    owners = spark.createDataFrame([(0, 0), (1, 3), (2, 5)], "owner int, value long")
    got = coupling.run_lock_step(owners, cluster, lambda v, total, k: v + F.when(total > 100, 0).otherwise(1), lambda v: v >= 5)
    # owner 2 is there after one step; 0 and 1 wait for each other
    assert rows(got) == [(0, 0, 5, 5), (1, 0, 8, 5), (2, 2, 6, 1)]


def test_triggered_frozen_and_hung(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    state = spark.range(4).withColumn("n", F.lit(0).cast("long"))
    seven = lambda k: spark.createDataFrame([(0,), (0,)], "id long") if k == 2 else None
    out, stats = bsp.run_supersteps(state, links, F.lit(7), F.max, {"n": lambda m: F.coalesce(m, F.col("n"))}, max_steps=6, trigger=seven)
    assert rows(out) == [(0, 0), (1, 7), (2, 7), (3, 7)] and [s[1] for s in stats.steps] == [3, 0, 0] and stats.ended == "settled"
    still, _ = bsp.min_label(spark.range(4).select("id"), links, frozen=F.col("id") == 2)
    assert rows(still) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    began = time.monotonic()
    with pytest.raises(bsp.Hung):
        bsp.abort_after(spark, 1.0, lambda: spark.range(10**15).agg(F.sum(F.col("id") % 7)).collect())
    assert time.monotonic() - began < 20 and bsp.abort_after(spark, 60.0, lambda: spark.range(5).count()) == 5


def test_superseded_checkpoints_are_deleted(spark, tmp_path):
    import os

    df = session.cut(spark.range(10))
    folder = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder)
    session.release(df)
    session.release(spark.range(3))
    assert not os.path.isdir(folder)


def test_interacting_buckets(spark):
    v = spark.createDataFrame([(i, i % 6, "x") for i in range(12)] + [(99, None, "x")], "id long, b int, k string")
    one_way = rangejoin.bucket_join(v, v, lambda c: c("b"), lambda k: F.array(k, F.pmod(k + 1, F.lit(6))), F.col("a.id") < F.col("b.id")).select("a.id", "b.id")
    want = sorted((i, j) for i in range(12) for j in range(12) if i < j and (i - j) % 6 in (0, 1, 5))
    assert rows(one_way) == want


def test_things_and_places(spark):
    inside = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 1, 5)], "id long, t int, place int")
    places = spark.createDataFrame([(100, 0, 5), (101, 1, 5), (102, 2, 6)], "id long, t int, place int")
    assert rows(rangejoin.containment_edges(inside, places).select("src", "dst")) == [(1, 101), (1, 102), (100, 2)]


def test_halo(spark):
    v = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "id long, owner int")
    adj = model.adjacency(model.canonical_edges(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")))
    assert rows(neighbors.halo(adj, v, 1)) == [(0, 3, 1), (1, 2, 1), (1, 5, 1), (2, 4, 1)]
    assert (0, 4, 2) in rows(neighbors.halo(adj, v, 2))


def test_hubs_make_no_wedges(spark):
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    ring = spark.range(1, 11).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = star.unionByName(ring)
    began = time.monotonic()
    assert neighbors.triangles(edges).count() == 10
    hour = edges.withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    assert [r["triangles"] for r in bursts.window_triangles(hour, "ts", "1 hour").collect()] == [10]
    adj = model.adjacency(model.canonical_edges(edges))
    ones = spark.range(n + 1).select("id", F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    pooled = {r["id"]: round(r["pooled_0"], 6) for r in communities.convolve(adj, ones, ["x", "y", "z"]).where("id in (0, 5, 50)").collect()}
    # the hub's own row sums over all, a ring vertex's row i = 0 over itself, the hub and its two ring neighbours
    assert pooled == {0: round(0.1 * (n + 1), 6), 5: 0.4, 50: 0.2}
    assert time.monotonic() - began < 200


def test_convolution_of_vertices_without_features(spark):
    adj = model.adjacency(model.canonical_edges(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")))
    x = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (3, 2.0, 0.0, 0.0), (9, 5.0, 0.0, 0.0)], "id long, a double, b double, c double")
    got = {r["id"]: round(r["pooled_0"], 9) for r in communities.convolve(adj, x, ["a", "b", "c"]).collect()}
    assert got == {1: 0.3, 2: 0.3, 3: 0.3, 4: 0.2, 9: 0.5}


def test_ids_of_many_owners(spark):
    at = [(3, (o << 32) | f) for o, f in ((0, 5), (8191, 7), (8192, 7), (24_575, 1_000_000), (2**20 - 1, 2**26 - 1))]
    df = spark.createDataFrame(at, "step int, v long").select(graphs._id(F.col("v")).alias("id"))
    assert df.distinct().count() == len(at)
    with pytest.raises(Exception, match="beyond"):
        spark.createDataFrame([(3, 2**60)], "step int, v long").select(graphs._id(F.col("v"))).collect()


def test_radius_search_in_blocks(spark, monkeypatch):
    v = spark.range(60).select(F.col("id").alias("k"), F.array(F.col("id") * 1.0, F.lit(0.0)).alias("vec")).unionByName(spark.createDataFrame([(100, None), (101, [1.0]), (102, [float("nan"), 0.0])], "k long, vec array<double>"))
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "ROW_BLOCK", 7)
    got = rows(similarity.radius_search(v.where("k % 10 = 0"), v, "k", "vec", 1.0))
    assert got == sorted((q, r) for q in range(0, 60, 10) for r in (q - 1, q + 1) if 0 <= r < 60)
    assert similarity.radius_search(v.limit(0), v, "k", "vec", 1.0).count() == 0


def test_spreads_of_vertices(spark):
    point = generators.vertex_stream(spark, 3, 2, (5, 6), (100, 40, 10), spread="point")
    assert rows(point.select("owner", "x", "y").distinct()) == [(0, 25.0, 20.0), (1, 75.0, 20.0)]
    normal = generators.vertex_stream(spark, 50, 2, (20, 21), (100, 40, 10), spread="gaussian").where("owner = 0").agg(F.avg("x"), F.stddev("x"), F.min("x"), F.max("x")).first()
    assert abs(normal[0] - 24.5) < 1.5 and abs(normal[1] - 50 / 6) < 1 and normal[2] >= 0 and normal[3] < 50
    with pytest.raises(ValueError):
        generators.vertex_stream(spark, 1, 1, (1, 2), (1, 1, 1), spread="square")


def test_epidemic_spreads_both_ways(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1, 0.0, 0.0), (2, 0.5, 0.0, 0, 0.5, 0.0), (3, 1.2, 0.0, 0, 1.2, 0.0), (4, None, 0.0, 1, 0.0, 0.0)], "actor long, px double, py double, infected int, dst_x double, dst_y double")
    got = {(r["step"], r["actor"]): r["infected"] for r in simulation.epidemic(a, 2, 0.8).collect()}
    assert [got[1, 2], got[1, 3], got[2, 3]] == [1, 0, 1]
