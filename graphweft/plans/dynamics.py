"""Queries of supersteps, mutations, coupling and loop control, generators and streams, with the SQL of what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model
from graphweft.analytics import communities
from graphweft.operators import bsp, coupling, neighbors, rangejoin, sets
from graphweft.plans.graphs import _COMPONENTS, _GCN, _NEAR, _OWNERS, _PATTERNS, _TRIANGLES, GRAPH, RADIUS, _clusters, _pagerank_sql, _pooled, draw, trace_adjacency, trace_edges, trace_vertices
from graphweft.session import scratch, table
from graphweft.sources import generators
from graphweft.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# scans and lookups


@query(f"WITH {GRAPH} SELECT id, owner, step AS created FROM vx WHERE step < 100")
def old_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The vertices created before a step."""
    v = trace_vertices(spark, d).withColumnRenamed("step", "created")
    return model.vertices_before(v, 100).select("id", "owner", "created")


@query(f"WITH {GRAPH} SELECT id, owner, step, uid FROM vx WHERE id = (50::BIGINT << 45) | 62")
def vertex_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One vertex by its id."""
    return model.vertex_by_id(trace_vertices(spark, d), (50 << 45) | 62).select("id", "owner", "step", "uid")


@query("SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier WHERE floor(s_acctbal / 1000) = 4")
def partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of one bucket."""
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.floor(F.col("s_acctbal") / 1000).alias("part"))
    return model.vertices_in_part(v, 4).select("id", "balance")


@query("SELECT a.vec_id AS id, a.step, a.vec[2:] IS NOT DISTINCT FROM b.vec[2:] AND len(a.vec) = 6 AND len(b.vec) = 6 AS same FROM (SELECT DISTINCT step, vec_id, vec FROM vertex_trace_a) a JOIN (SELECT DISTINCT step, vec_id, vec FROM vertex_trace_b) b USING (step, vec_id) WHERE len(a.vec) = 6 AND len(b.vec) = 6")
def vertex_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether two copies of a vertex agree in all attributes."""
    names = ["px", "py", "infected", "dst_x", "dst_y"]

    def copy(c: str) -> DataFrame:
        v = table(spark, d, f"vertex_trace_{c}").select("step", "vec_id", "vec").distinct().where("size(vec) = 6")
        return v.select(F.struct("step", "vec_id").alias("id"), *[F.col("vec")[i + 1].alias(n) for i, n in enumerate(names)])

    return model.equal_vertices(copy("a"), copy("b"), names).select("id.step", F.col("id.vec_id").alias("id"), "same")


@query("SELECT p_partkey AS id, p_size + 1 AS size FROM part")
def map_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Q21: every vertex's value plus one."""
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return model.map_vertices(v, size=F.col("size") + 1)


@query(_GCN + "SELECT id, round(pooled_0, 6) AS pooled_0 FROM pooled ORDER BY id LIMIT 10")
def first_supernodes(spark: SparkSession, d: str) -> DataFrame:
    """T5: the first ten supernodes."""
    return _pooled(spark, d).orderBy("id").limit(10).select("id", F.round("pooled_0", 6).alias("pooled_0"))


# supersteps


def _labels_sql(steps: int, keep: str = "false") -> str:
    return f"""WITH RECURSIVE {GRAPH}, p AS (SELECT DISTINCT s, t FROM adj), ids AS (SELECT DISTINCT s AS id FROM p),
    r(k, id, l) AS (SELECT 0, id, id FROM ids UNION ALL SELECT k + 1, id, CASE WHEN {keep} THEN max(l) FILTER (own) ELSE min(l) END FROM (SELECT r.k, r.id, r.l, true AS own FROM r WHERE r.k < {steps} UNION ALL SELECT r.k, p.t, r.l, false FROM r JOIN p ON p.s = r.id WHERE r.k < {steps}) q GROUP BY k, id) """


@query(_labels_sql(40) + ", c AS (SELECT b.k - 1 AS step, count(*) FILTER (a.l <> b.l) AS changed FROM r a JOIN r b ON a.id = b.id AND b.k = a.k + 1 GROUP BY b.k) SELECT step::INTEGER AS step, changed FROM c WHERE step <= (SELECT min(step) FROM c WHERE changed = 0)")
def superstep_profile(spark: SparkSession, d: str) -> DataFrame:
    """What each superstep of label propagation changed, through the sink of the profile."""
    adj = trace_adjacency(spark, d)
    stats = bsp.min_label(adj.select(F.col("src").alias("id")).distinct(), adj)[1]
    folder = scratch(spark, "profile")
    stats.write(spark, folder)
    return spark.read.schema("step int, changed long, seconds double").json(folder).select("step", "changed")


@query(_labels_sql(3, "(id >> 32) % 4 = 0") + "SELECT id, l AS label FROM r WHERE k = 3")
def frozen_owners(spark: SparkSession, d: str) -> DataFrame:
    """Labels after three steps, where a quarter of the owners has terminated: read, but not updated."""
    adj = trace_adjacency(spark, d)
    return bsp.min_label(adj.select(F.col("src").alias("id")).distinct(), adj, max_steps=3, frozen=model.owner_of(F.col("id")) % 4 == 0)[0]


@query(f"WITH {GRAPH}, p AS (SELECT DISTINCT s, t FROM adj), l0 AS (SELECT DISTINCT s AS id, s AS l FROM p), l1 AS (SELECT p.s AS id, min(l0.l) AS l FROM p JOIN l0 ON l0.id = p.t GROUP BY p.s), l2 AS (SELECT p.s AS id, min(l1.l) AS l FROM p JOIN l1 ON l1.id = p.t GROUP BY p.s), l3 AS (SELECT p.s AS id, min(l2.l) AS l FROM p JOIN l2 ON l2.id = p.t GROUP BY p.s) SELECT id, l AS label FROM l3")
def gather_sum_apply(spark: SparkSession, d: str) -> DataFrame:
    """Q20: three rounds in which each vertex's value is replaced by the least of its neighbours'."""
    adj = trace_adjacency(spark, d).select("src", "dst").distinct()
    start = adj.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    return bsp.gather_sum_apply(start, adj, F.col("s.label"), F.min, {"label": lambda m: m}, max_steps=3, fixed_steps=True)[0]


@query(f"WITH {GRAPH}, p AS (SELECT DISTINCT s, t FROM adj), ill AS (SELECT id FROM vx WHERE infected = 1), deg AS (SELECT s AS id, count(*) AS n FROM p GROUP BY s), h AS (SELECT p.t AS id, count(*) AS n FROM p JOIN ill ON ill.id = p.s GROUP BY p.t) SELECT deg.id, coalesce(h.n, deg.n) AS heard FROM deg LEFT JOIN h USING (id)")
def trigger_update(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours each vertex last heard of: after all is settled, the infected ones are made to speak again."""
    adj = trace_adjacency(spark, d).select("src", "dst").distinct()
    ids = adj.select(F.col("src").alias("id")).distinct()
    ill = trace_vertices(spark, d).where("infected = 1").select("id")
    heard = lambda m: F.coalesce(m, F.col("heard"))
    one = bsp.run_supersteps(ids.withColumn("heard", F.lit(0).cast("long")), adj, F.lit(1), F.sum, {"heard": heard}, max_steps=3, trigger=lambda k: ill if k == 2 else None)
    return one[0]


@query("SELECT DISTINCT s_suppkey AS id, s_suppkey AS label FROM supplier")
def time_limit(spark: SparkSession, d: str) -> DataFrame:
    """A run whose time is over before its first step."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).distinct()
    ring = s.select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    return bsp.min_label(s, ring, max_seconds=-1.0)[0]


@query("SELECT true AS aborted")
def hang_abort(spark: SparkSession, d: str) -> DataFrame:
    """Work that would take for ever, stopped after two seconds."""
    try:
        bsp.abort_after(spark, 2.0, lambda: spark.range(10**15).agg(F.sum(F.col("id") % 7)).collect())
    except bsp.Hung:
        return spark.range(1).select(F.lit(True).alias("aborted"))
    return spark.range(1).select(F.lit(False).alias("aborted"))


@query(_pagerank_sql(30))
def pagerank30(spark: SparkSession, d: str) -> DataFrame:
    """Q22: the thirty supersteps of the comparator, in millionths."""
    out = trace_adjacency(spark, d).where("dir & 2 = 2 and src <> dst").select("src", "dst")
    return bsp.pagerank(out, 30).select("id", F.round(F.col("rank") * 1e6, 4).alias("rank"))


# coupling


@query(_OWNERS + ", s AS (SELECT cluster, max(owner % 5 + 1) AS steps FROM cl GROUP BY cluster) SELECT owner, cluster, (owner + steps)::BIGINT AS value, steps::INTEGER AS steps FROM cl JOIN s USING (cluster)")
def lock_step(spark: SparkSession, d: str) -> DataFrame:
    """Coupled owners whose values grow by one a step, until all of a cluster are at their mark."""
    cl = _clusters(spark, d)
    owners = cl.select("owner", F.col("owner").cast("long").alias("value"))
    marked = owners.withColumn("value", F.struct("value", (F.col("value") + F.col("owner") % 5 + 1).alias("mark")))
    step = lambda v, total, k: F.struct((v["value"] + 1).alias("value"), v["mark"].alias("mark"))
    state = coupling.run_lock_step(marked.withColumn("value", F.col("value")), cl, step, lambda v: v["value"] >= v["mark"], total=lambda v: v["value"])
    return state.select("owner", "cluster", F.col("value.value").alias("value"), "steps")


@query(_OWNERS + ", m AS (SELECT owner, count(*) AS n FROM vx GROUP BY owner), ok AS (SELECT cluster FROM cl JOIN m USING (owner) GROUP BY cluster HAVING min(n) >= 90) SELECT owner FROM cl JOIN ok USING (cluster)")
def terminating(spark: SparkSession, d: str) -> DataFrame:
    """Owners all of whose cluster have at least ninety vertices."""
    coupled = coupling.coupled_metrics(trace_vertices(spark, d), _clusters(spark, d), {"n": F.count("*")})
    return coupling.terminating(coupled, F.col("n") >= 90)


@query("SELECT user_id % 7 AS cluster, (sum(CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END) - sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END))::BIGINT AS pending FROM events GROUP BY 1")
def pending_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages sent and not yet received, by cluster."""
    e = table(spark, d, "events")
    sent, got = F.when(F.col("event_id") % 3 > 0, 1).otherwise(0), F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)
    return coupling.pending_messages(e.select((F.col("user_id") % 7).alias("cluster"), sent.alias("sent"), got.alias("received")))


@query("SELECT sum(l_quantity) AS total, max(l_extendedprice) AS most, count(*) AS n FROM lineitem")
def all_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Sums and maxima over all owners."""
    return coupling.all_reduce(table(spark, d, "lineitem"), total=F.sum("l_quantity"), most=F.max("l_extendedprice"), n=F.count("*"))


@query("WITH o AS (SELECT owner FROM vertex_trace_a GROUP BY owner HAVING count(*) % 2 = 0) SELECT x.owner AS a, y.owner AS b FROM o x JOIN o y ON x.owner % 8 = y.owner % 8 AND x.owner < y.owner")
def flagged_partners(spark: SparkSession, d: str) -> DataFrame:
    """Congruent owners that are both flagged."""
    owners = table(spark, d, "vertex_trace_a").groupBy("owner").agg(F.count("*").alias("n"))
    return coupling.modulo_partners(owners, 16, F.col("n") % 2 == 0)


# mutations


@query(f"""WITH {GRAPH}, c AS (SELECT s, t, dir AS old, (s // 7 + t) % 5 AS how FROM g),
n AS (SELECT s AS src, t AS dst, old, CASE how WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE old END AS dir FROM c) SELECT src, dst, dir::INTEGER AS dir FROM n WHERE dir > 0""")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Implicit edges of which a fifth goes and a fifth turns inbound."""
    edges = trace_edges(spark, d).withColumn("kind", F.lit(model.IMPLICIT).cast("tinyint"))
    how = F.expr("(src div 7 + dst) % 5")
    changes = edges.where(how < 2).select("src", "dst", F.when(how == 0, 0).otherwise(1).cast("tinyint").alias("dir"))
    return model.upsert_edges(edges, changes)[0].select("src", "dst", F.col("dir").cast("int").alias("dir"))


@query(f"""WITH {GRAPH}, n AS (SELECT s, t, dir AS old, CASE (s // 7 + t) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE dir END AS dir FROM g)
SELECT s AS id FROM n WHERE old & 1 <> dir & 1 UNION SELECT t FROM n WHERE old & 2 <> dir & 2""")
def edge_upsert_active(spark: SparkSession, d: str) -> DataFrame:
    """The vertices that these changes wake: those whose inbound edges changed."""
    edges = trace_edges(spark, d).withColumn("kind", F.lit(model.IMPLICIT).cast("tinyint"))
    how = F.expr("(src div 7 + dst) % 5")
    changes = edges.where(how < 2).select("src", "dst", F.when(how == 0, 0).otherwise(1).cast("tinyint").alias("dir"))
    return model.upsert_edges(edges, changes)[1]


@query("WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), g AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, bit_or(CASE WHEN a <= b THEN 2 ELSE 1 END) AS dir FROM e WHERE a % 2 = 0 GROUP BY ALL), n AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, bit_or(CASE WHEN a <= b THEN 1 ELSE 2 END) AS dir FROM e WHERE a % 3 = 0 GROUP BY ALL) SELECT src, dst, dir::INTEGER AS dir FROM g UNION ALL SELECT src, dst, dir::INTEGER FROM n ANTI JOIN g USING (src, dst)")
def explicit_edges(spark: SparkSession, d: str) -> DataFrame:
    """G1: explicit edges added to a graph; those there stay as they are."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    base = model.canonical_edges(e.where("src % 2 = 0").withColumn("dir", F.lit(model.OUT)))
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("part", F.lit(None).cast("long"))
    more = e.where("src % 3 = 0").withColumn("dir", F.lit(model.IN))
    return model.add_explicit_edges(model.Graph(ids, base), more).edges.select("src", "dst", F.col("dir").cast("int").alias("dir"))


@query("SELECT c_custkey AS id, c_acctbal AS x FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000000 END, -c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 6 = 3")
def update_merge(spark: SparkSession, d: str) -> DataFrame:
    """Vertices changed and added by an update."""
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    new = v.where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1_000_000_000)).alias("id"), (-F.col("x")).alias("x"))
    return model.apply_updates(v, new)


@query("WITH c AS (SELECT o, k FROM range(4) a(o), range(4) b(k)) SELECT o * 100 + k AS id, o::INTEGER AS owner FROM c WHERE k >= 2")
def insert_delete(spark: SparkSession, d: str) -> DataFrame:
    """Q8: each of four owners adds a vertex in each of four steps, then deletes its oldest in each of two."""
    start = spark.createDataFrame([], "id long, owner int")
    none = spark.createDataFrame([], "src long, dst long, dir tinyint, kind tinyint")

    def step(k: int, graph: model.Graph, mail: DataFrame | None) -> bsp.Mutations:
        if k < 4:
            return bsp.Mutations(create=spark.range(4).select((F.col("id") * 100 + k).alias("id"), F.col("id").cast("int").alias("owner")))
        return bsp.Mutations(delete=graph.vertices.groupBy("owner").agg(F.min("id").alias("id"))) if k < 6 else bsp.Mutations()

    return bsp.run_dynamic(model.Graph(start, none), step, 10)[0].vertices


@query(_NEAR + f"SELECT a.id AS src, b.id AS dst FROM ok a JOIN ok b ON a.step = b.step AND a.id < b.id AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= {RADIUS ** 2}")
def new_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Edges kept up to date when a tenth of the vertices comes in later; equals the full build."""
    v = trace_vertices(spark, d)
    before = rangejoin.implicit_edges(v.where("uid % 10 <> 0"), ["px", "py"], RADIUS, equal=["step"])
    return rangejoin.refresh_edges(before, v, v.where("uid % 10 = 0"), ["px", "py"], RADIUS, equal=["step"]).select("src", "dst")


@query(_NEAR + f"SELECT a.id AS src, b.id AS dst FROM ok a JOIN ok b ON a.step = b.step AND a.id < b.id AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= {RADIUS ** 2} WHERE a.uid % 10 <> 0 AND b.uid % 10 <> 0")
def stale_edges(spark: SparkSession, d: str) -> DataFrame:
    """Q16: a tenth of the vertices moves out of everyone's reach, and no edge to them stays."""
    v = trace_vertices(spark, d)
    before = rangejoin.implicit_edges(v, ["px", "py"], RADIUS, equal=["step"])
    gone = F.col("uid") % 10 == 0
    after = v.withColumn("px", F.when(gone, F.lit(1e7) + F.col("uid") * 1e4).otherwise(F.col("px")))
    return rangejoin.refresh_edges(before, after, v.where(gone), ["px", "py"], RADIUS, equal=["step"]).select("src", "dst")


# joins


@query(_NEAR + ", w AS (SELECT *, (floor(px / 500)::BIGINT % 16 + 16) % 16 AS k FROM ok) SELECT a.id AS src, b.id AS dst FROM w a JOIN w b ON a.step = b.step AND a.id < b.id AND abs(a.py - b.py) <= 100 AND ((a.k - b.k + 16) % 16 IN (0, 1, 15))")
def ring_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from buckets that lie side by side on a ring, as a user function says."""
    v = trace_vertices(spark, d).where(rangejoin.Grid(("px", "py"), 1.0).usable())
    ring = lambda k: F.array(k, F.pmod(k + 1, F.lit(16)))  # noqa: E731  named from one side only
    bucket = lambda c: F.pmod(F.floor(c("px") / 500), F.lit(16))
    near = (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.py") - F.col("b.py")) <= 100)
    return rangejoin.bucket_join(v, v, bucket, ring, near, [(F.col("a.step"), F.col("b.step"))]).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


@query(_NEAR + ", w AS (SELECT *, (floor(px / 500) * 1000 + floor(py / 500))::BIGINT AS place, step // 25 AS t FROM ok), p AS (SELECT DISTINCT t, place FROM w) SELECT w.id AS src, p.t * 100000000 + p.place AS dst FROM w JOIN p ON p.t = w.t + 1 AND p.place = w.place UNION ALL SELECT p.t * 100000000 + p.place, w.id FROM w JOIN p ON w.t = p.t + 1 AND p.place = w.place")
def containment(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and the cells they are in, a dump on."""
    v = trace_vertices(spark, d).where(rangejoin.Grid(("px", "py"), 1.0).usable())
    inside = v.select("id", F.expr("step div 25").alias("t"), (F.floor(F.col("px") / 500) * 1000 + F.floor(F.col("py") / 500)).alias("place"))
    places = inside.select("t", "place").distinct().withColumn("id", F.col("t") * 100_000_000 + F.col("place"))
    return rangejoin.containment_edges(inside, places).select("src", "dst")


@query("SELECT user_id AS i, length(event_type)::BIGINT AS j, max(event_id) AS seq FROM events GROUP BY ALL HAVING arg_max(value > 5, event_id)")
def versioned_relation(spark: SparkSession, d: str) -> DataFrame:
    """The pairs set after a log of settings and clearings, with the number of the last setting."""
    e = table(spark, d, "events")
    return sets.relation_at(e.select(F.col("user_id").alias("i"), F.length("event_type").cast("long").alias("j"), F.col("event_id").alias("seq"), (F.col("value") > 5).alias("on")))


@query("SELECT user_id AS i, max(event_id) AS seq, (user_id // 25)::INTEGER AS owner FROM events GROUP BY user_id")
def relation_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each row's last change, and the owner of its chunk."""
    e = table(spark, d, "events").select(F.col("user_id").alias("i"), F.col("event_id").alias("seq"))
    return sets.row_versions(e).withColumn("owner", sets.chunk_owner(F.col("i"), 200, 8))


# analytics


def _cpm4_sql() -> str:
    pad = lambda x: f"lpad({x}::VARCHAR, 19, '0')"
    key = " || '-' || ".join(pad(c) for c in "abcd")
    four = _TRIANGLES.replace("WITH", "WITH RECURSIVE", 1) + ", k4 AS (SELECT a, b, c, w.t AS d FROM tri JOIN p w ON w.s = tri.c JOIN p u ON u.s = tri.b AND u.t = w.t JOIN p v ON v.s = tri.a AND v.t = w.t)"
    subs = " UNION ALL ".join(f"SELECT key, {x} AS x, {y} AS y, {z} AS z FROM k" for x, y, z in (("a", "b", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "c", "d")))
    return four + f""", k AS (SELECT {key} AS key, a, b, c, d FROM k4), sub AS ({subs}), links AS (SELECT DISTINCT p1.key AS u, p2.key AS v FROM sub p1 JOIN sub p2 USING (x, y, z)),
    r(v, l) AS (SELECT key, key FROM k UNION SELECT links.v, r.l FROM r JOIN links ON links.u = r.v), lab AS (SELECT v AS key, min(l) AS community FROM r GROUP BY v),
    mem AS (SELECT DISTINCT unnest([a, b, c, d]) AS vertex, community FROM k JOIN lab USING (key)) SELECT vertex, community, count(*) OVER (PARTITION BY community) AS size FROM mem"""


@query(_cpm4_sql())
def cpm_communities4(spark: SparkSession, d: str) -> DataFrame:
    """Q3: communities of 4-cliques that hang together over three members."""
    return communities.communities(trace_edges(spark, d), 4)


@query(_PATTERNS.replace("st(v, code, last) AS (SELECT [s], 0::BIGINT, s FROM (SELECT DISTINCT s FROM p)", "st(o, v, code, last) AS (SELECT owner, [id], 0::BIGINT, id FROM vx WHERE id IN (SELECT s FROM p)").replace("SELECT v2, code |", "SELECT o, v2, code |").replace("SELECT code, t, v2,", "SELECT o, code, t, v2,").replace("SELECT code, last, p.t,", "SELECT o, code, last, p.t,") + ", ho AS (SELECT o AS owner, code, count(*) AS n FROM st GROUP BY ALL) SELECT owner, code, n FROM ho")
def patterns_by_owner(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's histogram of subgraph patterns, whose sums are that of all."""
    adj = trace_adjacency(spark, d)
    linked = trace_vertices(spark, d).join(adj.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    return communities.pattern_histogram(adj, owners=linked)


# generators


@query(f"SELECT range AS actor, {draw('range', '0', chr(39) + 'x' + chr(39))} * 100 AS px, {draw('range', '0', chr(39) + 'y' + chr(39))} * 200 AS py, (range < 5)::INTEGER AS infected FROM range(2000)")
def actor_generator(spark: SparkSession, d: str) -> DataFrame:
    """Random actors."""
    return generators.actors(spark, 2000, (100.0, 200.0), infected=5).select("actor", "px", "py", "infected")


@query(f"""WITH o AS (SELECT s, w, floor({draw('s', 'w', '123', "'n'")} * 7)::BIGINT + 3 AS n FROM range(20) a(s), range(4) b(w)), k AS (SELECT s, w, unnest(range(n)) AS k FROM o)
SELECT s::INTEGER AS step, w::INTEGER AS owner, (w << 32) | (s * 10 + k) AS id, floor(w * 25.0 + {draw('s', 'w', 'k', '123', "'x'")} * 25.0) AS x, floor({draw('s', 'w', 'k', '123', "'y'")} * 60) AS y FROM k""")
def vertex_stream(spark: SparkSession, d: str) -> DataFrame:
    """Random vertices by step and owner."""
    return generators.vertex_stream(spark, 20, 4, (3, 10), (100, 60, 10)).select("step", "owner", "id", "x", "y")


_LCG = "((({0}) * 214013 + 2531011) & 4294967295)"


def _lcg(state: str) -> tuple[str, str]:
    one = _LCG.format(state)
    two = _LCG.format(one)
    return f"(((({two}) >> 16) & 32767) << 32) + ((({one}) >> 16) & 32767)", two


def _edge_stream_sql() -> str:
    x1, s1 = _lcg("start")
    x2, s2 = _lcg("s1")
    x3, _ = _lcg("s2")
    return f"""WITH r AS (SELECT range AS id, (range // 200)::INTEGER AS step, (range // 50) % 4 AS owner FROM range(2000)), a AS (SELECT *, (id + 123 + owner) & 4294967295 AS start FROM r),
    b AS (SELECT *, {x1} AS x1, {s1} AS s1 FROM a), c AS (SELECT *, {x2} AS x2, {s2} AS s2 FROM b), e AS (SELECT *, {x3} AS x3 FROM c)
    SELECT step, owner::INTEGER AS owner, (owner << 32) | (x1 % 1000) AS src, ((x2 % 4) << 32) | (x3 % 1000) AS dst FROM e"""


@query(_edge_stream_sql())
def edge_stream(spark: SparkSession, d: str) -> DataFrame:
    """Random edges by step and owner, from the linear congruential generator."""
    return generators.edge_stream(spark, 10, 4, 50, 1000).select("step", "owner", "src", "dst")


@query("SELECT batch, count(*) AS edges, min(l_orderkey) AS first FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey) - 1) // 1000 AS batch FROM lineitem) GROUP BY batch")
def edge_replay(spark: SparkSession, d: str) -> DataFrame:
    """Edges replayed in batches of a thousand."""
    e = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return generators.batches(e, 1000, "l_orderkey").groupBy("batch").agg(F.count("*").alias("edges"), F.min("l_orderkey").alias("first"))


# streams


def _edge_files(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The edges of the traces as three files, and the stream that reads them one by one."""
    folder = scratch(spark, "stream")
    trace_edges(spark, d).select("src", "dst", "dir").repartition(3, "src").write.option("maxRecordsPerFile", 0).parquet(f"{folder}/in")
    return folder, ingest.edge_file_stream(spark, f"{folder}/in", "src long, dst long, dir tinyint")


@query(_COMPONENTS + "SELECT v, component FROM comp")
def streamed_components(spark: SparkSession, d: str) -> DataFrame:
    """Components kept up to date over three batches of edges; equals those of all edges."""
    folder, stream = _edge_files(spark, d)
    ingest.stream_components(stream, folder, f"{folder}/ck").awaitTermination()
    return ingest.current_components(spark, folder)


@query(f"WITH {GRAPH} SELECT s AS src, t AS dst, dir::INTEGER AS dir FROM g")
def streamed_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges kept once each over three batches."""
    folder, stream = _edge_files(spark, d)
    ingest.stream_graph(stream, folder, f"{folder}/ck").awaitTermination()
    return ingest.current_edges(spark, folder).select("src", "dst", F.col("dir").cast("int").alias("dir"))


@query(f"WITH {GRAPH} SELECT count(*) AS edges, count(*) AS fresh, true AS timed FROM g")
def ingest_rate(spark: SparkSession, d: str) -> DataFrame:
    """Q12: edges taken in, of which new, and that there is a rate."""
    folder, stream = _edge_files(spark, d)
    ingest.stream_graph(stream, folder, f"{folder}/ck").awaitTermination()
    r = spark.read.parquet(f"{folder}/rates")
    return r.agg(F.sum("edges").alias("edges"), F.sum("fresh").alias("fresh"), (F.min("edges_per_second") > 0).alias("timed"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over a stream of events."""
    folder = scratch(spark, "windows")
    table(spark, d, "events").select("ts", "event_type").write.parquet(f"{folder}/in")
    s = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(f"{folder}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    name = "windows_" + folder.rsplit("-", 1)[1]
    ingest.windowed_counts(s, "ts", "1 hour", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
