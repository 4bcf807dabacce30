import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphweft import model
from graphweft.analytics import communities, simulation
from graphweft.operators import bsp, coupling, neighbors, rangejoin, sets


def edge_df(spark, pairs):
    return model.canonical_edges(spark.createDataFrame([(a, b, 3) for a, b in pairs], "src long, dst long, dir tinyint"))


def random_graph(n, p, seed):
    rnd = random.Random(seed)
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if rnd.random() < p]


def test_ids_and_packed_edges(spark):
    df = spark.createDataFrame([(3000, 2**32 - 1, 1), (0, 0, 3), (2**28, 7, 2)], "pe long, off long, d tinyint")
    v = model.make_id(F.col("pe"), F.col("off"))
    w = model.pack_edge(v, F.lit(1), F.col("d"))
    x, k, d = model.unpack_edge(w)
    for r in df.select(v.alias("v"), model.owner_of(v).alias("o"), model.offset_of(v).alias("f"), x.alias("x"), k.alias("k"), d.alias("r"), "pe", "off", "d", model.flip(F.col("d")).alias("flip")).collect():
        assert (r["o"], r["f"], r["x"], r["k"], r["r"]) == (r["pe"], r["off"], r["v"], 1, r["d"]) and r["flip"] == {1: 2, 2: 1, 3: 3}[r["d"]]


def test_canonical_edges_and_adjacency(spark):
    raw = spark.createDataFrame([(2, 1, 1, 1), (1, 2, 2, 2), (5, 5, 3, 1), (4, 3, 1, 1), (4, 3, 2, 9), (None, 1, 3, 1)], "src long, dst long, dir tinyint, t int")
    assert sorted((r["src"], r["dst"], r["dir"]) for r in model.canonical_edges(raw, "t").collect()) == [(1, 2, 2), (3, 4, 1), (5, 5, 3)]
    assert sorted((r["src"], r["dst"], r["dir"]) for r in model.adjacency(model.canonical_edges(raw, "t")).collect()) == [(1, 2, 2), (2, 1, 1), (3, 4, 1), (4, 3, 2), (5, 5, 3)]


def test_create_scan_delete(spark):
    v = model.create_vertices(spark.range(50).select((F.col("id") % 3).alias("o"), F.col("id").alias("x")), F.col("o"), created=4)
    rows = v.collect()
    assert sorted(r["id"] for r in rows if r["owner"] == 1) == [(1 << 32) + i for i in range(17)]
    assert model.vertices_before(v, 4).count() == 0 and model.vertices_before(v, 5).count() == 50
    g = model.Graph(spark.range(4).select("id", F.lit(0).alias("owner"), F.lit(None).cast("long").alias("part"), F.lit(0).alias("created")), edge_df(spark, [(0, 1), (1, 2), (2, 3)]))
    left = model.delete_vertices(g, spark.range(1, 2))
    assert [(r["src"], r["dst"]) for r in left.edges.collect()] == [(2, 3)] and left.vertices.count() == 3
    more = model.add_explicit_edges(g, spark.createDataFrame([(1, 0, 3), (3, 0, 3)], "src long, dst long, dir tinyint"))
    assert more.edges.count() == 4
    with pytest.raises(ValueError):
        model.add_explicit_edges(g.with_vertices(g.vertices.withColumn("part", F.lit(1).cast("long"))), spark.createDataFrame([(0, 3, 3)], "src long, dst long, dir tinyint"))


def test_graph_measures_against_brute_force(spark):
    pairs = random_graph(28, 0.25, 4)
    e = edge_df(spark, pairs)
    near = {v: set() for v in range(28)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    tri = {c for c in itertools.combinations(range(28), 3) if all(y in near[x] for x, y in itertools.combinations(c, 2))}
    assert {tuple(r) for r in neighbors.triangles(e).collect()} == tri
    four = sorted(list(c) for c in itertools.combinations(range(28), 4) if all(y in near[x] for x, y in itertools.combinations(c, 2)))
    assert sorted(r["members"] for r in communities.cliques(e, 4).collect()) == four
    two = {(a, c) for a in near for b in near[a] for c in near[b] if c != a and c not in near[a]}
    assert {tuple(r) for r in neighbors.two_hop(model.adjacency(e)).collect()} == two


def test_components_long_path_and_lone_vertices(spark):
    e = edge_df(spark, [(i, i + 1) for i in range(200)] + [(1000, 1001), (1002, 1001), (7, 7)])
    got = {r["v"]: r["component"] for r in bsp.connected_components(e, spark.createDataFrame([(5000,)], "id long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1002] == 1000 and got[5000] == 5000
    assert bsp.connected_components(e.limit(0)).count() == 0


def clique_at(points, r):
    return [(i, j) for (i, p), (j, q) in itertools.combinations(enumerate(points), 2) if sum((a - b) ** 2 for a, b in zip(p, q)) <= r * r]


def test_communities_of_squares(spark):
    square = lambda x: [(x, 0.0, 0.0), (x + 1, 0.0, 0.0), (x, 1.0, 0.0), (x + 1, 1.0, 0.0)]
    for points, n in ((square(0), 1), (square(0) + square(50), 2)):
        assert communities.communities(edge_df(spark, clique_at(points, 1.5)), 4).select("community").distinct().count() == n
        assert communities.cliques(edge_df(spark, clique_at(points, 1.0)), 4).count() == 0
    ring5 = list(itertools.combinations(range(5), 2)) + [(a, b) for a, b in itertools.combinations((3, 4, 5, 6), 2)]
    got = communities.communities(edge_df(spark, ring5), 4).collect()
    assert len({r["community"] for r in got}) == 2 and {r["size"] for r in got} == {5, 4}


def test_patterns_against_a_walk(spark):
    pairs = random_graph(9, 0.4, 2) + [(3, 3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    counts = {}

    def walk(v, code):
        counts[code] = counts.get(code, 0) + 1
        if len(v[0]) < 4:
            for t in near[v[1]]:
                w = v[0] if t in v[0] else (*v[0], t)
                i, j = w.index(v[1]), w.index(t)
                if not code >> (4 * i + j) & 1:
                    walk((w, t), code | 1 << (4 * i + j) | 1 << (4 * j + i))

    for s in near:
        walk(((s,), s), 0)
    got = {r["code"]: r["n"] for r in communities.pattern_histogram(model.adjacency(edge_df(spark, pairs))).collect()}
    assert got == counts


def test_range_joins_against_all_pairs(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50), i % 3) for i in range(120)] + [(200, math.nan, 0.0, 0), (201, None, 0.0, 0), (202, math.inf, 0.0, 0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, t int")
    want = {(a[0], b[0]) for a, b in itertools.combinations(pts[:120], 2) if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 100}
    assert {(r["src"], r["dst"]) for r in rangejoin.implicit_edges(df, ["x", "y"], 10.0).collect()} == want
    torus = lambda u, v: min(abs(u - v), 100 - abs(u - v))
    wrapped = rangejoin.range_join(df, df, ["x", "y"], 10.0, wrap=(100.0, 100.0)).where("a.id < b.id").select("a.id", "b.id").collect()
    assert sorted(map(tuple, wrapped)) == sorted((a[0], b[0]) for a, b in itertools.combinations(pts[:120], 2) if torus(a[1], b[1]) ** 2 + torus(a[2], b[2]) ** 2 <= 100)
    later = rangejoin.temporal_join(df, "t", ["x", "y"], 10.0).select("a.id", "b.id").collect()
    assert {tuple(r) for r in later} == {(a[0], b[0]) for a in pts[:120] for b in pts[:120] if b[3] == a[3] + 1 and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 100}
    assert rangejoin.band_join(df, df, "x", 3.0).where("a.id < b.id").count() == sum(abs(a[1] - b[1]) <= 3 for a, b in itertools.combinations(pts[:120], 2))


def test_incremental_equals_full(spark):
    rnd = random.Random(2)
    before = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(80)]
    after = [(i, x + (30 if i % 9 == 0 else 0), y) for i, x, y in before if i != 5] + [(99, 3.0, 3.0)]
    b, a = (spark.createDataFrame(r, "id long, x double, y double") for r in (before, after))
    moved = spark.createDataFrame([(i,) for i in range(80) if i % 9 == 0 or i == 5] + [(99,)], "id long")
    old = rangejoin.implicit_edges(b, ["x", "y"], 8.0).unionByName(spark.createDataFrame([(1, 70, 3, 1)], "src long, dst long, dir tinyint, kind tinyint"))
    fresh = {(r["src"], r["dst"]) for r in rangejoin.refresh_edges(old, a, moved, ["x", "y"], 8.0).collect()}
    assert fresh == {(r["src"], r["dst"]) for r in rangejoin.implicit_edges(a, ["x", "y"], 8.0).collect()} | {(1, 70)}


def test_supersteps(spark):
    adj = model.adjacency(edge_df(spark, [(0, 1), (1, 2), (2, 3)]))
    done, stats = bsp.min_label(spark.range(5), adj)
    assert {r["id"]: r["label"] for r in done.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4} and stats.ended == "settled" and stats.frame(spark).count() == len(stats.steps)
    path = spark.range(5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    state = spark.range(6).withColumn("x", F.col("id"))
    gathered, _ = bsp.gather_sum_apply(state, path, F.col("s.x"), F.min, {"x": lambda m: F.coalesce(m, F.col("x"))}, max_steps=1)
    assert {r["id"]: r["x"] for r in gathered.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 5}  # what it had is replaced
    frozen, _ = bsp.run_supersteps(state, adj, F.col("s.x"), F.min, {"x": lambda m: F.least("x", m)}, frozen=F.col("id") == 1)
    assert {r["id"]: r["x"] for r in frozen.collect()}[1] == 1


def test_dynamics_and_messages(spark):
    g = model.Graph(spark.range(1).select("id", F.lit(0).alias("owner"), F.lit(None).cast("long").alias("part"), F.lit(0).alias("created")), edge_df(spark, []))

    def step(k, graph, mail):
        if k == 3:
            return bsp.Mutations()
        new = graph.vertices.agg(F.max("id").alias("m")).select((F.col("m") + 1).alias("id"), F.lit(0).alias("owner"), F.lit(None).cast("long").alias("part"), F.lit(k).alias("created"))
        return bsp.Mutations(create=new, edges=new.select("id", (F.col("id") - 1).alias("dst"), F.lit(3).cast("tinyint").alias("dir")).withColumnRenamed("id", "src"), messages=new.select(F.col("id").alias("dst"), F.lit(k).alias("seq")))

    done, stats = bsp.run_dynamic(g, step, 10)
    assert done.vertices.count() == 4 and done.edges.count() == 3 and stats.ended == "settled"
    mail = bsp.deliver(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (9, 1, "c")], "dst long, seq int, text string"), spark.range(3))
    assert [(r["id"], [m["text"] for m in r["mail"]]) for r in mail.collect()] == [(1, ["b", "a"])]
    both = bsp.update_in_pandas(spark.range(3).withColumn("x", F.lit(2)), model.adjacency(edge_df(spark, [(0, 1), (1, 2)])), lambda v, n: v.assign(x=v["x"] + len(n)), "id long, x long")
    assert sorted(map(tuple, both.collect())) == [(0, 3), (1, 4), (2, 3)]


def test_coupling(spark):
    owners = spark.range(6).select(F.col("id").cast("int").alias("owner"))
    asks = spark.createDataFrame([(1, 2), (3, 2), (4, 5)], "owner int, other int")
    cl = coupling.clusters(owners, asks, spark.createDataFrame([(5,)], "owner int"))
    assert {r["owner"]: r["cluster"] for r in cl.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    v = owners.select(F.col("owner"), (F.col("owner") * 10).alias("x"))
    m = coupling.coupled_metrics(v, cl, {"x": F.sum("x")})
    assert {r["owner"]: r["all_x"] for r in m.collect()}[3] == 60
    assert {r["owner"] for r in coupling.terminating(m, F.col("x") >= 20, spark.createDataFrame([(1,)], "owner int")).collect()} == {2, 3, 4, 5}
    assert coupling.modulo_partners(owners, 6).count() == 3
    assert coupling.pending_messages(spark.createDataFrame([(1, 5, 3), (1, 0, 2)], "cluster int, sent int, received int")).first()["pending"] == 0


def test_sets(spark):
    r = spark.createDataFrame([([1, 2, 3], [3, 4])], "a array<bigint>, b array<bigint>").select(sets.union(F.col("a"), F.col("b")).alias("u"), sets.clear(F.col("a"), F.lit(2).cast("long")).alias("c"), sets.insert(F.col("a"), F.lit(1).cast("long")).alias("i"), sets.full(3).alias("f"), sets.equal(F.col("a"), F.lit(None).cast("array<bigint>")).alias("e")).first()
    assert (r["u"], r["c"], r["i"], r["f"], r["e"]) == ([1, 2, 3, 4], [1, 3], [1, 2, 3], [0, 1, 2], None)
    rel = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "i int, j int")
    assert sets.pair_remove(rel, spark.createDataFrame([(1,)], "j int")).count() == 1 and sets.pair_remove(rel, rel.where("i = 1 and j = 2")).count() == 2
    assert dict(map(tuple, sets.window_changes(rel.select("i").distinct(), spark.createDataFrame([(2,), (3,)], "i int")).collect())) == {1: "ended", 2: "continuing", 3: "new"}


def test_small_simulations(spark):
    assert {r["id"]: r["step"] for r in simulation.grid_epidemic(spark, 4).collect()} == {i: i // 4 + i % 4 for i in range(16)}
    assert simulation.chain_growth(spark, 9).groupBy("owner").count().collect() and simulation.chain_growth(spark, 9).count() == 9
    assert {r["actor"]: r["pos"] for r in simulation.pursuit(spark, 8).collect()} == {0: 6, 1: 7}
    p = [(0, 10.0, 10.0, 0.0, 0.0), (1, 12.0, 11.0, 0.0, 0.0), (2, 90.0, 99.9999, 0.0, 0.001)]
    rows = {(r["t"], r["id"]): r for r in simulation.nbody(spark.createDataFrame(p, "id long, px double, py double, vx double, vy double"), 1).collect()}
    size = math.hypot(1 / 2, 1 / 1)
    assert abs(rows[1, 0]["px"] - (10 + 0.001 * 0.5 / size)) < 1e-12 and abs(rows[1, 1]["vy"] + 0.001 / size) < 1e-12 and abs(rows[1, 2]["py"] - 0.0009) < 1e-9


def test_patches_keep_their_mosquitoes(spark):
    import numpy as np

    m = simulation.PatchModel()
    one = lambda x: np.array([x])
    s, e, i, n = simulation.mosquito_steps(one(900.0), one(0.0), one(100.0), one(1000.0), one(5.0), one(50.0), m)
    assert abs(n[0] - 1000) < 0.01 and e[0] > 0 and i[0] < 100  # at capacity births balance deaths
    s2, e2, *_ = simulation.mosquito_steps(one(900.0), one(0.0), one(100.0), one(1000.0), one(0.0), one(0.0), m)
    assert e2[0] == 0


def test_stale_edges_go_when_a_vertex_moves_away(spark):
    both = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0)], "id long, x double, y double")
    old = rangejoin.implicit_edges(both, ["x", "y"], 1.0)
    away = both.withColumn("x", F.when(F.col("id") == 2, 9.0).otherwise(F.col("x")))
    assert old.count() == 1 and rangejoin.refresh_edges(old, away, both.where("id = 2"), ["x", "y"], 1.0).count() == 0


def test_one_vertex_has_its_own_edge(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    e = rangejoin.implicit_edges(one, ["x", "y"], 1.0, self_edges=True)
    assert [(r["src"], r["dst"]) for r in e.collect()] == [(1, 1)] and neighbors.degrees(model.adjacency(e)).first()["degree"] == 1


def test_coupled_values_advance_in_lock_step(spark):
    owners = spark.range(4).select(F.col("id").cast("int").alias("owner"))
    cl = coupling.clusters(owners, owners.select("owner", F.lit(0).alias("other")))
    for step in range(2):
        v = owners.select("owner", F.lit(step + 1).alias("x"))
        rows = coupling.coupled_metrics(v, cl, {"x": F.max("x")}).collect()
        assert {r["members"] for r in rows} == {4} and {r["all_x"] for r in rows} == {4 * (step + 1)}


def test_delayed_pairs_need_both_flags(spark):
    owners = spark.createDataFrame([(i, i != 5) for i in range(6)], "owner int, flag boolean")
    assert sorted(map(tuple, coupling.modulo_partners(owners, 6, F.col("flag")).collect())) == [(0, 3), (1, 4)]


def test_inserted_and_deleted_vertices(spark):
    v = spark.range(4).select("id", F.lit(0).alias("owner"), F.lit(None).cast("long").alias("part"), F.lit(0).alias("created"))
    g = model.Graph(v, edge_df(spark, [(0, 1), (1, 2), (2, 3)]))

    def step(k, graph, _):
        if k == 2:
            return bsp.Mutations()
        if k == 0:
            new = spark.createDataFrame([(9, 0, None, 0)], v.schema)
            return bsp.Mutations(create=new, edges=spark.createDataFrame([(9, 0, 3)], "src long, dst long, dir tinyint"))
        return bsp.Mutations(delete=graph.vertices.where("id = 0"))

    done, _ = bsp.run_dynamic(g, step, 5)
    assert sorted(r["id"] for r in done.vertices.collect()) == [1, 2, 3, 9] and sorted((r["src"], r["dst"]) for r in done.edges.collect()) == [(1, 2), (2, 3)]
    assert neighbors.khop(done.adjacency(), done.vertices.where("id = 9"), 3).count() == 1
