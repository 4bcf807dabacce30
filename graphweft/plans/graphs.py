"""Queries of the graph operators over the traces, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model
from graphweft.analytics import communities, simulation
from graphweft.operators import bsp, coupling, neighbors, rangejoin
from graphweft.session import table

#: Step and vec_id share a long: of up to 2^13 owners as they are, of up to 2^20 owners with up to 2^26 vertices each as a
#: negative number.
STEP_SHIFT = 45


def _id(vec_id) -> F.Column:
    step, owner, offset = F.col("step").cast("long"), F.shiftright(vec_id, 32), vec_id.bitwiseAND(F.lit(0xFFFFFFFF))
    wide = F.lit(-1) - F.shiftleft(step, 46).bitwiseOR(F.shiftleft(owner, 26)).bitwiseOR(offset)
    fits = (owner < 2**20) & (offset < 2**26) & (step < 2**17)
    return F.when(vec_id < 2**STEP_SHIFT, F.shiftleft(step, STEP_SHIFT).bitwiseOR(vec_id)).when(fits, wide).otherwise(F.raise_error(F.lit("a vec_id of an owner beyond 2^20, or beyond its 2^26th vertex")).cast("long"))


def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of copy a, all steps, canonical."""
    code = F.when(F.col("e.dir") == "IN", 1).when(F.col("e.dir") == "OUT", 2).otherwise(3).cast("tinyint")
    e = table(spark, d, "edge_trace_a").select("step", "vec_id", F.explode("edges").alias("e"))
    raw = e.select(_id(F.col("vec_id")).alias("src"), _id(F.col("e.pe").cast("long") * 2**32 + F.col("e.offset")).alias("dst"), code.alias("dir"))
    return model.canonical_edges(raw).withColumn("kind", F.lit(model.EXPLICIT).cast("tinyint"))


def trace_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return model.adjacency(trace_edges(spark, d))


def trace_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of copy a: id, owner, step, uid, px, py, infected, dst_x, dst_y."""
    v = table(spark, d, "vertex_trace_a").select("step", "owner", "vec_id", "vec").distinct()
    slot = lambda i: F.get("vec", F.lit(i))
    return v.select(_id(F.col("vec_id")).alias("id"), "owner", "step", slot(0).cast("long").alias("uid"), slot(1).alias("px"), slot(2).alias("py"), slot(3).alias("infected"), slot(4).alias("dst_x"), slot(5).alias("dst_y"))


GRAPH = f"""e0 AS (SELECT step, (step::BIGINT << {STEP_SHIFT}) | vec_id AS a, unnest(edges) AS e FROM edge_trace_a),
raw AS (SELECT a, (step::BIGINT << {STEP_SHIFT}) | (e.pe::BIGINT * 4294967296 + e.offset) AS b, CASE e.dir WHEN 'IN' THEN 1 WHEN 'OUT' THEN 2 ELSE 3 END AS dir FROM e0),
g AS (SELECT least(a, b) AS s, greatest(a, b) AS t, bit_or(CASE WHEN a <= b THEN dir ELSE (dir & 1) * 2 + (dir >> 1) END) AS dir FROM raw GROUP BY ALL),
adj AS (SELECT s, t, dir FROM g UNION SELECT t, s, (dir & 1) * 2 + (dir >> 1) FROM g),
vx AS (SELECT (step::BIGINT << {STEP_SHIFT}) | vec_id AS id, owner, step, vec[1]::BIGINT AS uid, vec[2] AS px, vec[3] AS py, vec[4] AS infected, vec[5] AS dst_x, vec[6] AS dst_y
  FROM (SELECT DISTINCT step, owner, vec_id, vec FROM vertex_trace_a))"""
_COMPONENTS = f"WITH RECURSIVE {GRAPH}, r(v, l) AS (SELECT DISTINCT s, s FROM adj UNION SELECT adj.t, r.l FROM r JOIN adj ON adj.s = r.v), comp AS (SELECT v, min(l) AS component FROM r GROUP BY v) "
_TRIANGLES = f"WITH {GRAPH}, p AS (SELECT s, t FROM g WHERE s < t), tri AS (SELECT x.s AS a, x.t AS b, y.t AS c FROM p x JOIN p y ON x.t = y.s JOIN p z ON z.s = x.s AND z.t = y.t) "
RADIUS = 300.0


def draw(*keys: str) -> str:
    """SQL of the number that ``scalars.uniform`` draws for these keys."""
    return f"(('0x' || substr(md5({' || $$|$$ || '.join(keys)}), 1, 13))::BIGINT / 4503599627370496.0)"



QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(_COMPONENTS + "SELECT v, component FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Q1: the least vertex each vertex is connected with."""
    return bsp.connected_components(trace_edges(spark, d))


@query(_COMPONENTS + "SELECT n AS size, count(*) AS components FROM (SELECT component, count(*) AS n FROM comp GROUP BY component) GROUP BY n")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


@query(_COMPONENTS + "SELECT v AS id, component AS label FROM comp")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Q1 / Q20 as supersteps: minimum labels along the frontier."""
    adj = trace_adjacency(spark, d)
    return bsp.min_label(adj.select(F.col("src").alias("id")).distinct(), adj)[0]


@query(_TRIANGLES + "SELECT a AS id, count(*) AS triangles FROM tri GROUP BY a")
def triangles_per_min_vertex(spark: SparkSession, d: str) -> DataFrame:
    """Q2: triangles by their least vertex."""
    return neighbors.triangles(trace_edges(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("triangles"))


@query(_TRIANGLES + "SELECT count(*) AS triangles, 2 * count(*) AS raw_count FROM tri")
def triangle_total(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.triangles(trace_edges(spark, d)).agg(F.count("*").alias("triangles"), (2 * F.count("*")).alias("raw_count"))


@query(_TRIANGLES + """, deg AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM p UNION ALL SELECT t FROM p) GROUP BY id),
closed AS (SELECT id, count(*) AS closed FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id)
SELECT id, degree, (degree * (degree - 1)) // 2 AS wedges, coalesce(closed, 0) AS closed FROM deg LEFT JOIN closed USING (id)""")
def wedge_closure(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.wedge_closure(trace_edges(spark, d))


@query(f"WITH {GRAPH} SELECT s AS id, count(*) AS degree FROM adj GROUP BY s")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.degrees(trace_adjacency(spark, d))


@query(f"WITH {GRAPH}, deg AS (SELECT s, count(*) AS n FROM adj GROUP BY s) SELECT min(n) AS min_degree, max(n) AS max_degree, avg(n) AS avg_degree, count(*) AS n FROM deg")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.degree_stats(trace_adjacency(spark, d))


@query(f"WITH {GRAPH}, deg AS (SELECT s AS id, count(*) AS degree FROM adj GROUP BY s) SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 1")
def max_degree_vertex(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.max_degree_vertex(trace_adjacency(spark, d))


@query(f"WITH {GRAPH}, p AS (SELECT s, t FROM adj WHERE s <> t) SELECT s AS src, t AS dst FROM (SELECT DISTINCT x.s, y.t FROM p x JOIN p y ON x.t = y.s WHERE x.s <> y.t) q ANTI JOIN p USING (s, t)")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.two_hop(trace_adjacency(spark, d))


@query(f"""WITH RECURSIVE {GRAPH}, seed AS (SELECT min(id) AS id FROM vx GROUP BY step), p AS (SELECT DISTINCT s, t FROM adj),
r(id, dist) AS (SELECT id, 0 FROM seed UNION SELECT p.t, r.dist + 1 FROM r JOIN p ON p.s = r.id WHERE r.dist < 6) SELECT id, min(dist) AS dist FROM r GROUP BY id""")
def khop_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Vertices within six hops of the least vertex of each step."""
    seeds = trace_vertices(spark, d).groupBy("step").agg(F.min("id").alias("id"))
    return neighbors.khop(trace_adjacency(spark, d), seeds, 6)


@query(f"WITH {GRAPH} SELECT v.id, least(v.id, (SELECT min(n.uid) FROM adj JOIN vx n ON n.id = adj.t WHERE adj.s = v.id)) AS least FROM vx v")
def neighbor_min(spark: SparkSession, d: str) -> DataFrame:
    """A1: the least actor number among the neighbours, seeded with the vertex's id."""
    return neighbors.neighbor_min(trace_adjacency(spark, d), trace_vertices(spark, d), "uid", F.col("id"))


@query(f"WITH {GRAPH} SELECT DISTINCT adj.s AS id FROM adj JOIN vx n ON n.id = adj.t WHERE n.infected = 1 AND adj.dir & 1 = 1")
def neighbor_any(spark: SparkSession, d: str) -> DataFrame:
    """A2: vertices with an infected inbound neighbour."""
    return neighbors.neighbor_any(trace_adjacency(spark, d), trace_vertices(spark, d), F.col("infected") == 1, inbound_only=True)


@query(f"WITH {GRAPH} SELECT adj.s AS id, count(*) AS n, sum(CASE WHEN n.infected = 1 THEN 1 ELSE 0 END)::BIGINT AS infected, sum(n.owner * 2 + CASE WHEN n.infected = 1 THEN 1 ELSE 0 END)::BIGINT AS weighted FROM adj JOIN vx n ON n.id = adj.t GROUP BY adj.s")
def neighbor_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours, infected neighbours and a weighted sum."""
    ill = F.when(F.col("n.infected") == 1, 1).otherwise(0)
    return neighbors.neighbor_sums(trace_adjacency(spark, d), trace_vertices(spark, d), {"n": F.lit(1), "infected": ill, "weighted": F.col("n.owner") * 2 + ill})


@query(f"WITH {GRAPH} SELECT a.s AS id, round(sum(CASE WHEN isfinite(n.px) AND isfinite(m.px) THEN n.px - m.px ELSE 0 END), 3) AS pull_x, round(sum(CASE WHEN isfinite(n.py) AND isfinite(m.py) THEN n.py - m.py ELSE 0 END), 3) AS pull_y FROM adj a JOIN vx n ON n.id = a.t JOIN vx m ON m.id = a.s GROUP BY a.s")
def neighbor_vector_sum(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the ways to the neighbours."""
    v = trace_vertices(spark, d)
    fetched = neighbors.neighbor_fetch(trace_adjacency(spark, d), v).join(v.select(F.col("id").alias("src"), F.col("px").alias("mx"), F.col("py").alias("my")), "src")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    way = lambda n, m: F.round(F.sum(F.when(sound(n) & sound(m), n - m).otherwise(0.0)), 3)
    return fetched.groupBy(F.col("src").alias("id")).agg(way(F.col("n.px"), F.col("mx")).alias("pull_x"), way(F.col("n.py"), F.col("my")).alias("pull_y"))


@query(f"WITH {GRAPH} SELECT dir, count(*) AS edges, count(DISTINCT s) AS sources FROM g GROUP BY dir")
def edge_dedup_flip(spark: SparkSession, d: str) -> DataFrame:
    """Edges once each, by direction."""
    return trace_edges(spark, d).groupBy(F.col("dir").cast("int").alias("dir")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@query(f"WITH {GRAPH} SELECT DISTINCT adj.t AS id FROM adj JOIN vx ON vx.id = adj.s WHERE vx.infected = 1 AND adj.dir <> 1")
def frontier_downstream(spark: SparkSession, d: str) -> DataFrame:
    """What becomes active if all infected vertices change."""
    return neighbors.downstream(trace_adjacency(spark, d), trace_vertices(spark, d).where("infected = 1"))


@query(f"WITH {GRAPH}, gone AS (SELECT id FROM vx WHERE infected = 1) SELECT s AS src, t AS dst, dir FROM g WHERE s NOT IN (SELECT id FROM gone) AND t NOT IN (SELECT id FROM gone)")
def vertex_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The edges left when all infected vertices are deleted."""
    v = trace_vertices(spark, d)
    left = model.delete_vertices(model.Graph(v, trace_edges(spark, d)), v.where("infected = 1"))
    return left.edges.select("src", "dst", F.col("dir").cast("int").alias("dir"))


@query(f"WITH {GRAPH} SELECT step, (floor(px / 500) * 1000000 + floor(py / 500))::BIGINT AS part, count(*) AS n FROM vx WHERE isfinite(px) AND isfinite(py) GROUP BY ALL")
def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Vertices by step and grid cell."""
    grid = rangejoin.Grid(("px", "py"), 500.0)
    return trace_vertices(spark, d).where(grid.usable()).groupBy("step", grid.part().alias("part")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {GRAPH}, seed AS (SELECT min(id) AS id FROM vx GROUP BY step), p AS (SELECT DISTINCT s, t FROM adj),
r(id, dist) AS (SELECT id, 0 FROM seed UNION SELECT p.t, r.dist + 1 FROM r JOIN p ON p.s = r.id WHERE r.dist < 6), dd AS (SELECT id, min(dist) AS dist FROM r GROUP BY id)
SELECT (floor(px / 500) * 1000000 + floor(py / 500))::BIGINT AS part, min(dist) AS dist FROM vx JOIN dd USING (id) WHERE isfinite(px) AND isfinite(py) GROUP BY 1""")
def partition_min_distance(spark: SparkSession, d: str) -> DataFrame:
    """How near each grid cell's vertices come to the seeds."""
    grid = rangejoin.Grid(("px", "py"), 500.0)
    v = trace_vertices(spark, d).where(grid.usable()).withColumn("part", grid.part())
    return neighbors.partition_min_distance(v, khop_bfs(spark, d))


_OWNERS = f"""WITH RECURSIVE {GRAPH}, o AS (SELECT DISTINCT owner FROM vx), q AS (SELECT DISTINCT a.owner AS x, b.owner AS y FROM g JOIN vx a ON a.id = g.s JOIN vx b ON b.id = g.t WHERE g.dir = 3 AND a.owner % 7 = b.owner % 7),
qq AS (SELECT x, y FROM q UNION SELECT y, x FROM q), r(v, l) AS (SELECT owner, owner FROM o UNION SELECT qq.y, r.l FROM r JOIN qq ON qq.x = r.v), cl AS (SELECT v AS owner, min(l) AS cluster FROM r GROUP BY v) """


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    v, e = trace_vertices(spark, d), trace_edges(spark, d).where("dir = 3")
    ends = e.join(v.select(F.col("id").alias("src"), F.col("owner").alias("owner")), "src").join(v.select(F.col("id").alias("dst"), F.col("owner").alias("other")), "dst")
    return coupling.clusters(v.select("owner").distinct(), ends.where("owner % 7 = other % 7").select("owner", "other").distinct())


@query(_OWNERS + "SELECT owner, cluster FROM cl")
def coupled_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Owners that share both-way edges and agree modulo 7 couple."""
    return _clusters(spark, d)


@query(_OWNERS + ", m AS (SELECT owner, count(*) AS n, sum(CASE WHEN infected = 1 THEN 1 ELSE 0 END)::BIGINT AS infected FROM vx GROUP BY owner) SELECT owner, cluster, n, infected, (sum(n) OVER (PARTITION BY cluster))::BIGINT AS all_n, (sum(infected) OVER (PARTITION BY cluster))::BIGINT AS all_infected, count(*) OVER (PARTITION BY cluster) AS members FROM cl JOIN m USING (owner)")
def coupled_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's metric and the sum over its cluster."""
    return coupling.coupled_metrics(trace_vertices(spark, d), _clusters(spark, d), {"n": F.count("*"), "infected": F.sum(F.when(F.col("infected") == 1, 1).otherwise(0))})


@query("WITH o AS (SELECT DISTINCT owner FROM vertex_trace_a) SELECT x.owner AS a, y.owner AS b FROM o x JOIN o y ON x.owner % 16 = y.owner % 16 AND x.owner < y.owner")
def modulo_partners(spark: SparkSession, d: str) -> DataFrame:
    """Owners congruent modulo half of 32."""
    return coupling.modulo_partners(table(spark, d, "vertex_trace_a").select("owner").distinct(), 32)


_NEAR = f"WITH {GRAPH}, ok AS (SELECT * FROM vx WHERE isfinite(px) AND isfinite(py)) "


@query(_NEAR + f"SELECT a.id AS src, b.id AS dst FROM ok a JOIN ok b ON a.step = b.step AND a.id < b.id AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= {RADIUS ** 2}")
def range_join_2d(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a step within a radius, as implicit edges."""
    return rangejoin.implicit_edges(trace_vertices(spark, d), ["px", "py"], RADIUS, equal=["step"]).select("src", "dst")


@query(_NEAR + ", o3 AS (SELECT * FROM ok WHERE isfinite(dst_x)) SELECT a.id AS src, b.id AS dst FROM o3 a JOIN o3 b ON a.step = b.step AND a.id < b.id AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 + (a.dst_x - b.dst_x) ^ 2 <= 360000")
def range_join_3d(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within a radius in three dimensions."""
    return rangejoin.implicit_edges(trace_vertices(spark, d), ["px", "py", "dst_x"], 600.0, equal=["step"]).select("src", "dst")


@query(_NEAR + "SELECT a.id AS src, b.id AS dst FROM ok a JOIN ok b ON a.step = b.step AND a.id < b.id AND a.infected = b.infected AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= CASE WHEN a.infected = 1 THEN 90000 ELSE 22500 END")
def range_join_typed(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one type within the type's own radius."""
    far = rangejoin.squared_distance(lambda c: F.col("a")[c], lambda c: F.col("b")[c], ["px", "py"])
    edge = F.when(far <= F.when(F.col("a.infected") == 1, 90000.0).otherwise(22500.0), model.BI).otherwise(model.NO_EDGE)
    return rangejoin.implicit_edges(trace_vertices(spark, d), ["px", "py"], 300.0, edge, equal=["step", "infected"]).select("src", "dst")


@query(_NEAR + f", n AS (SELECT DISTINCT step FROM vx), nx AS (SELECT step, lead(step) OVER (ORDER BY step) AS later FROM n) SELECT a.id AS src, b.id AS dst, 2 AS dir FROM ok a JOIN ok b ON b.step = a.step + 25 AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= {RADIUS ** 2}")
def temporal_join_step1(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges from a dump to the next one, 25 steps on."""
    near = rangejoin.temporal_join(trace_vertices(spark, d), "step", ["px", "py"], RADIUS, step=25)
    return near.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("dir").cast("int").alias("dir"))


@query(_NEAR + "SELECT count(*) AS self_edges FROM ok")
def self_edges(spark: SparkSession, d: str) -> DataFrame:
    """Q18: every vertex is within any radius of itself."""
    pairs = rangejoin.implicit_edges(trace_vertices(spark, d), ["px", "py"], RADIUS, equal=["step"], self_edges=True)
    return pairs.where("src = dst").agg(F.count("*").alias("self_edges"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 25")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose balances differ by at most 25."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return rangejoin.band_join(s, s, "s_acctbal", 25.0).where("a.s_suppkey < b.s_suppkey").select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query(f"WITH {GRAPH}, w AS (SELECT uid, step, lag(infected) OVER (PARTITION BY uid ORDER BY step) AS prev, infected FROM vx) SELECT uid, step, prev, infected FROM w WHERE prev IS NOT NULL AND prev IS DISTINCT FROM infected")
def prev_state_lag(spark: SparkSession, d: str) -> DataFrame:
    """Actors whose state differs from the dump before."""
    told = neighbors.previous_state(trace_vertices(spark, d), "uid", "step", "infected")
    return told.where(F.col("prev").isNotNull() & model.changed(F.col("prev"), F.col("infected"))).select("uid", "step", "prev", "infected")


@query(f"WITH {GRAPH} SELECT uid, step, last_value(CASE WHEN isnan(px) THEN NULL ELSE px END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY step ROWS UNBOUNDED PRECEDING) AS filled FROM vx")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Positions carried forward over unreadable ones."""
    v = trace_vertices(spark, d).withColumn("px", F.nanvl("px", F.lit(None).cast("double")))
    return neighbors.forward_fill(v, "uid", ["step"], "px").select("uid", "step", "filled")


@query(f"""WITH {GRAPH}, later AS (SELECT a.* REPLACE (b.px AS px, b.py AS py), (a.px IS DISTINCT FROM b.px OR a.py IS DISTINCT FROM b.py) AS moved FROM vx a JOIN vx b ON b.step = a.step + 25 AND b.uid = a.uid),
ok AS (SELECT * FROM later WHERE isfinite(px) AND isfinite(py)) SELECT a.id AS src, b.id AS dst FROM ok a JOIN ok b ON a.step = b.step AND a.id < b.id AND (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 <= {RADIUS ** 2}""")
def incremental_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Edges kept up to date when vertices move to where the next dump has them; equals the full build."""
    v = trace_vertices(spark, d)
    nxt = v.select((F.col("step") - 25).alias("step"), "uid", F.col("px").alias("nx"), F.col("py").alias("ny"))
    both = v.join(nxt, ["step", "uid"])
    before = rangejoin.implicit_edges(both, ["px", "py"], RADIUS, equal=["step"])
    moved = both.where(model.changed(F.col("nx"), F.col("px")) | model.changed(F.col("ny"), F.col("py")))
    after = both.withColumn("px", F.col("nx")).withColumn("py", F.col("ny"))
    return rangejoin.refresh_edges(before, after, moved, ["px", "py"], RADIUS, equal=["step"]).select("src", "dst")


def _pagerank_sql(steps: int) -> str:
    return f"""WITH RECURSIVE {GRAPH}, l AS (SELECT s, t FROM adj WHERE dir & 2 = 2 AND s <> t), ids AS (SELECT s AS id FROM l UNION SELECT t FROM l), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
    od AS (SELECT s, count(*) AS c FROM l GROUP BY s),
    r(k, id, x) AS (SELECT 0, id, 1 / n FROM ids, n UNION ALL
      SELECT k, id, 0.15 / n + 0.85 * sum(x) FROM (SELECT r.k + 1 AS k, l.t AS id, r.x / od.c AS x FROM r JOIN l ON l.s = r.id JOIN od ON od.s = r.id WHERE r.k < {steps} UNION ALL SELECT r.k + 1, r.id, 0.0 FROM r WHERE r.k < {steps}) q, n GROUP BY k, id, n)
    SELECT id, round(x * 1e6, 4) AS rank FROM r WHERE k = {steps}"""


@query(_pagerank_sql(10))
def pagerank10(spark: SparkSession, d: str) -> DataFrame:
    """Q22: ten supersteps of PageRank over the outbound edges, in millionths."""
    out = trace_adjacency(spark, d).where("dir & 2 = 2 and src <> dst").select("src", "dst")
    return bsp.pagerank(out, 10).select("id", F.round(F.col("rank") * 1e6, 4).alias("rank"))


@query("SELECT range AS id, 0::BIGINT AS value FROM range(24)")
def min_label_path(spark: SparkSession, d: str) -> DataFrame:
    """Q20: minima along a path."""
    path = spark.range(23).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return bsp.vertex_centric(spark.range(24).withColumn("value", F.col("id")), path, F.col("s.value"), F.min, {"value": lambda m: F.least("value", m)})[0]


@query("SELECT range AS id, (range // 10 + range % 10)::INTEGER AS step FROM range(100)")
def grid_epidemic_steps(spark: SparkSession, d: str) -> DataFrame:
    """Q7: when each cell of a grid is reached."""
    return simulation.grid_epidemic(spark, 10)


_CLIQUES = _TRIANGLES + ", k4 AS (SELECT a, b, c, w.t AS d FROM tri JOIN p w ON w.s = tri.c JOIN p u ON u.s = tri.b AND u.t = w.t JOIN p v ON v.s = tri.a AND v.t = w.t) "


@query(_CLIQUES + "SELECT a, b, c, d FROM k4")
def cliques4(spark: SparkSession, d: str) -> DataFrame:
    """Q3: the 4-cliques."""
    m = communities.cliques(trace_edges(spark, d), 4)
    return m.select(*[F.col("members")[i].alias(c) for i, c in enumerate("abcd")])


def _cpm_sql(k: int) -> str:
    pad = lambda x: f"lpad({x}::VARCHAR, 19, '0')"
    key = " || '-' || ".join(pad(c) for c in "abc")
    return _TRIANGLES.replace("WITH", "WITH RECURSIVE", 1) + f""", k AS (SELECT {key} AS key, a, b, c FROM tri), sub AS (SELECT key, a AS x, b AS y FROM k UNION ALL SELECT key, a, c FROM k UNION ALL SELECT key, b, c FROM k),
    links AS (SELECT DISTINCT p1.key AS u, p2.key AS v FROM sub p1 JOIN sub p2 USING (x, y)),
    r(v, l) AS (SELECT key, key FROM k UNION SELECT links.v, r.l FROM r JOIN links ON links.u = r.v), lab AS (SELECT v AS key, min(l) AS community FROM r GROUP BY v),
    mem AS (SELECT DISTINCT unnest([a, b, c]) AS vertex, community FROM k JOIN lab USING (key))
    SELECT vertex, community, count(*) OVER (PARTITION BY community) AS size FROM mem"""


@query(_cpm_sql(3))
def cpm_communities(spark: SparkSession, d: str) -> DataFrame:
    """Q3: communities of 3-cliques that hang together over two members."""
    return communities.communities(trace_edges(spark, d), 3)


_PATTERNS = f"""WITH RECURSIVE {GRAPH}, p AS (SELECT DISTINCT s, t FROM adj),
st(v, code, last) AS (SELECT [s], 0::BIGINT, s FROM (SELECT DISTINCT s FROM p) UNION ALL
  SELECT v2, code | (1::BIGINT << (4 * i + j)) | (1::BIGINT << (4 * j + i)), t FROM (
    SELECT code, t, v2, list_position(v2, last) - 1 AS i, list_position(v2, t) - 1 AS j FROM (
      SELECT code, last, p.t, CASE WHEN list_contains(v, p.t) THEN v ELSE list_append(v, p.t) END AS v2 FROM st JOIN p ON p.s = st.last WHERE len(v) < 4) q) z
  WHERE code & (1::BIGINT << (4 * i + j)) = 0),
hist AS (SELECT code, count(*) AS n FROM st GROUP BY code),
scored AS (SELECT code, n, bit_count(code & 36561)::INTEGER AS edges, n * bit_count(code & 36561) AS score FROM hist),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, code)::INTEGER AS rank FROM scored ORDER BY score DESC, code LIMIT 6) """
_PATTERNS = _PATTERNS.replace("36561", str(sum(1 << (i * 4 + j) for i in range(4) for j in range(i + 1))))


@query(_PATTERNS + "SELECT code, n FROM hist")
def pattern_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each subgraph pattern of up to four vertices comes up."""
    return communities.pattern_histogram(trace_adjacency(spark, d))


@query(_PATTERNS + "SELECT code, n, edges, score, rank FROM top")
def pattern_topk(spark: SparkSession, d: str) -> DataFrame:
    """The six best patterns by count times edges."""
    return communities.top_patterns(pattern_histogram(spark, d))


@query(_PATTERNS + ", near AS (SELECT h.code, h.n, t.rank, bit_count(xor(h.code, t.code))::INTEGER AS dist FROM hist h, top t) SELECT code, n, min(rank) FILTER (dist BETWEEN 1 AND 2) AS near_rank, arg_min(dist, rank) FILTER (dist BETWEEN 1 AND 2) AS distance FROM near GROUP BY code, n HAVING min(dist) > 0 AND min(rank) FILTER (dist BETWEEN 1 AND 2) IS NOT NULL")
def pattern_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Q4: patterns close to a frequent one that aren't frequent."""
    return communities.pattern_anomalies(pattern_histogram(spark, d))


_GCN = f"""WITH {GRAPH}, f AS (SELECT id, owner * 0.1e0 * 0.1e0 + CASE WHEN infected = 1 THEN 0.3e0 ELSE 0 END + (uid % 10) * 0.2e0 AS w0, owner * 0.1e0 * 0.02e0 + CASE WHEN infected = 1 THEN 0.4e0 ELSE 0 END + (uid % 10) * 0.1e0 AS w1 FROM vx),
c AS (SELECT s, t FROM adj WHERE s <> t UNION SELECT id, id FROM vx),
rw AS (SELECT vi.s AS v, vi.t AS i, sum(f.w0) AS w0, sum(f.w1) AS w1 FROM c vi JOIN c ik ON ik.s = vi.t JOIN c vk ON vk.s = vi.s AND vk.t = ik.t JOIN f ON f.id = ik.t GROUP BY ALL),
pooled AS (SELECT v AS id, max(w0) AS pooled_0, max(w1) AS pooled_1 FROM rw GROUP BY v) """


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    v = trace_vertices(spark, d)
    x = v.select("id", (F.col("owner") * 0.1).alias("x0"), F.when(F.col("infected") == 1, 1.0).otherwise(0.0).alias("x1"), (F.col("uid") % 10).cast("double").alias("x2"))
    return communities.convolve(trace_adjacency(spark, d), x, ["x0", "x1", "x2"])


@query(_GCN + "SELECT id, round(pooled_0, 6) AS pooled_0, round(pooled_1, 6) AS pooled_1 FROM pooled")
def gcn_pool(spark: SparkSession, d: str) -> DataFrame:
    """A10, Q10: the convolution of every vertex's neighbourhood."""
    return _pooled(spark, d).select("id", F.round("pooled_0", 6).alias("pooled_0"), F.round("pooled_1", 6).alias("pooled_1"))


@query(_GCN + "SELECT a.id FROM pooled a WHERE NOT EXISTS (SELECT 1 FROM pooled b WHERE b.id <> a.id AND (a.pooled_0 - b.pooled_0) ^ 2 + (a.pooled_1 - b.pooled_1) ^ 2 <= 0.007225)")
def gcn_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Q10: supernodes with no other near them."""
    return communities.lonely_supernodes(_pooled(spark, d), 0.085).select("id")


def _epidemic_sql(steps: int, r: float) -> str:
    parts = [f"WITH {GRAPH}, k0 AS (SELECT id AS actor, px, py, px AS qx, py AS qy, coalesce(infected::INTEGER, 0) AS infected, dst_x, dst_y, step FROM (SELECT * FROM vx WHERE isfinite(px) AND isfinite(py) AND isfinite(dst_x) AND isfinite(dst_y) AND isfinite(infected)))"]
    for t in range(steps):
        parts.append(f"""m{t} AS (SELECT a.*, CASE WHEN abs(px - dst_x) < 1e-9 OR abs(py - dst_y) < 1e-9 THEN dst_x ELSE px END AS ax, CASE WHEN abs(px - dst_x) < 1e-9 OR abs(py - dst_y) < 1e-9 THEN dst_y ELSE py END AS ay,
          EXISTS (SELECT 1 FROM k{t} b WHERE b.infected = 1 AND (a.px - b.qx) ^ 2 + (a.py - b.qy) ^ 2 <= {r * r}) AS hit FROM k{t} a),
        n{t} AS (SELECT *, sqrt((dst_x - ax) ^ 2 + (dst_y - ay) ^ 2) * 5 AS mag FROM m{t}),
        u{t} AS (SELECT *, CASE WHEN mag > 0 THEN (dst_x - ax) / mag ELSE 0 END AS ux, CASE WHEN mag > 0 THEN (dst_y - ay) / mag ELSE 0 END AS uy FROM n{t}),
        k{t + 1} AS (SELECT actor, ax + CASE WHEN abs(dst_x - ax) > abs(ux) THEN ux ELSE dst_x - ax END AS px, ay + CASE WHEN abs(dst_y - ay) > abs(uy) THEN uy ELSE dst_y - ay END AS py, px AS qx, py AS qy, greatest(infected, hit::INTEGER) AS infected, dst_x, dst_y, step FROM u{t})""")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {t} AS step, actor, round(px, 4) AS px, round(py, 4) AS py, infected FROM k{t}" for t in range(steps + 1))


@query(_epidemic_sql(3, 40.0))
def epidemic3(spark: SparkSession, d: str) -> DataFrame:
    """Q6: three steps of the epidemic over all dumped actors, each dump's vertices being actors of their own."""
    sound = rangejoin.Grid(("px", "py", "dst_x", "dst_y", "infected"), 1.0).usable()
    actors = trace_vertices(spark, d).where(sound).select(F.col("id").alias("actor"), "px", "py", "infected", "dst_x", "dst_y")
    out = simulation.epidemic(actors, 3, 40.0)
    return out.select("step", "actor", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), "infected")


@query(f"WITH {GRAPH} SELECT s * 2 + 1 AS src, t * 2 + 1 AS dst, dir FROM g")
def layered_graph(spark: SparkSession, d: str) -> DataFrame:
    """Q15: a layer whose edges mirror the base graph's."""
    e = trace_edges(spark, d)
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("layer_id", F.col("id") * 2 + 1)
    return simulation.layered_graph(v, e)[1].select("src", "dst", F.col("dir").cast("int").alias("dir"))


@query("SELECT range AS id, (range % 2)::INTEGER AS owner FROM range(20)")
def chain_growth(spark: SparkSession, d: str) -> DataFrame:
    """Q13: a chain that its last two actors extend."""
    return simulation.chain_growth(spark, 20)


@query("SELECT a::INTEGER AS actor, (10 + a)::BIGINT AS pos FROM range(2) t(a)")
def pursuit(spark: SparkSession, d: str) -> DataFrame:
    """Q14: two actors that move along a line together."""
    return simulation.pursuit(spark, 12)


def _nbody_sql(steps: int, r: float) -> str:
    parts = [f"WITH {GRAPH}, k0 AS (SELECT id, px / 120 AS px, py / 120 AS py, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM vx WHERE isfinite(px) AND isfinite(py))"]
    fold = "((({0}) % 100.0) + 100.0) % 100.0"
    for t in range(steps):
        pull = "sum(CASE WHEN b.{0} <> a.{0} THEN 1 / (b.{0} - a.{0}) ELSE 0 END)"
        parts.append(f"""f{t} AS (SELECT a.id, {pull.format("px")} AS fx, {pull.format("py")} AS fy FROM k{t} a JOIN k{t} b ON a.id <> b.id AND b.px BETWEEN a.px - {r} AND a.px + {r} AND b.py BETWEEN a.py - {r} AND a.py + {r}
          WHERE (a.px - b.px) ^ 2 + (a.py - b.py) ^ 2 < {r * r} GROUP BY a.id),
        c{t} AS (SELECT id, CASE WHEN m > 0.001 THEN fx * 0.001 / m ELSE fx END AS fx, CASE WHEN m > 0.001 THEN fy * 0.001 / m ELSE fy END AS fy FROM (SELECT *, sqrt(fx * fx + fy * fy) AS m FROM f{t})),
        w{t} AS (SELECT id, px, py, vx + coalesce(fx, 0) AS vx, vy + coalesce(fy, 0) AS vy FROM k{t} LEFT JOIN c{t} USING (id)),
        k{t + 1} AS (SELECT id, {fold.format("px + vx")} AS px, {fold.format("py + vy")} AS py, vx, vy FROM w{t})""")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {t} AS t, id, round(px, 7) AS px, round(py, 7) AS py, round(vx, 6) AS vx, round(vy, 6) AS vy FROM k{t}" for t in range(steps + 1))


@query(_nbody_sql(5, 0.25))
def nbody(spark: SparkSession, d: str) -> DataFrame:
    """Q9: five steps of the particles of all dumps, folded into the domain."""
    ok = rangejoin.Grid(("px", "py"), 1.0)
    p = trace_vertices(spark, d).where(ok.usable()).select("id", (F.col("px") / 120).alias("px"), (F.col("py") / 120).alias("py"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    return simulation.nbody(p, 5, radius=0.25).select("t", "id", F.round("px", 7).alias("px"), F.round("py", 7).alias("py"), F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


def _patch_sql(steps: int, m: simulation.PatchModel) -> str:
    """The epidemic of patches and agents, its substeps as a recursion."""
    w, h = m.width, m.height
    risk = "CASE activity " + " ".join(f"WHEN {i} THEN {a}e0" for i, a in enumerate(m.alpha)) + " END"
    parts = [f"WITH RECURSIVE p0 AS (SELECT range AS patch_id, 900e0 AS sv, 0e0 AS ev, 100e0 AS iv FROM range({w * h})), a0 AS (SELECT c_custkey AS agent_id, c_custkey * 7919 % {w * h} AS patch, c_custkey * 7919 % {w * h} AS home, CASE WHEN c_custkey % 50 = 0 THEN 2 ELSE 0 END AS health, c_custkey % 4 AS activity, 0.5e0 AS stay FROM customer)"]
    dt, mu, nu, r_v = m.dt_v, m.mu_v, m.nu_v, m.psi_v - m.mu_v
    for t in range(steps):
        u = lambda k: draw("agent_id", str(t), "0", f"'{k}'")  # noqa: B023, E731
        around = f"greatest(home // {w} - 1, 0) AS r0, least(home // {w} + 1, {h - 1}) AS r1, greatest(home % {w} - 1, 0) AS c0, least(home % {w} + 1, {w - 1}) AS c1"
        parts.append(f"""n{t} AS (SELECT patch AS patch_id, sum({risk}) AS nhh, sum(CASE WHEN health = 2 THEN {risk} ELSE 0e0 END) AS ihh FROM a{t} GROUP BY patch),
        q{t}(k, patch_id, s, e, i, n, nhh, ihh) AS (SELECT 0, patch_id, sv, ev, iv, sv + ev + iv, coalesce(nhh, 0e0), coalesce(ihh, 0e0) FROM p{t} LEFT JOIN n{t} USING (patch_id) UNION ALL
          SELECT k + 1, patch_id, sn, en, jn, sn + en + jn, nhh, ihh FROM (
          SELECT *, i + (j1 + 2 * (j2 + j3) + j4) / 6 AS jn FROM (SELECT *, {dt} * ({nu} * (en + e3) - {mu} * (i + j3)) AS j4 FROM (SELECT *, {dt} * ({nu} * (en + 0.5e0 * e2) - {mu} * (i + 0.5e0 * j2)) AS j3 FROM (
          SELECT *, {dt} * ({nu} * (en + 0.5e0 * e1) - {mu} * (i + 0.5e0 * j1)) AS j2 FROM (SELECT *, {dt} * ({nu} * en - {mu} * i) AS j1 FROM (
          SELECT *, e + (e1 + 2 * (e2 + e3) + e4) / 6 AS en FROM (SELECT *, {dt} * (f * (sn + k3) - {nu + mu} * (e + e3)) AS e4 FROM (SELECT *, {dt} * (f * (sn + 0.5e0 * k2) - {nu + mu} * (e + 0.5e0 * e2)) AS e3 FROM (
          SELECT *, {dt} * (f * (sn + 0.5e0 * k1) - {nu + mu} * (e + 0.5e0 * e1)) AS e2 FROM (SELECT *, {dt} * (f * sn - {nu + mu} * e) AS e1 FROM (
          SELECT *, s + (k1 + 2 * (k2 + k3) + k4) / 6 AS sn FROM (SELECT *, {dt} * (born - (f + {mu}) * (s + k3)) AS k4 FROM (SELECT *, {dt} * (born - (f + {mu}) * (s + 0.5e0 * k2)) AS k3 FROM (
          SELECT *, {dt} * (born - (f + {mu}) * (s + 0.5e0 * k1)) AS k2 FROM (SELECT *, {dt} * (born - (f + {mu}) * s) AS k1 FROM (
          SELECT *, ({m.psi_v}e0 - {r_v} * n / {m.k_v}e0) * n AS born, CASE WHEN n > 0 AND nhh > 0 THEN {m.sigma_v}e0 * n * {m.sigma_h}e0 * nhh / ({m.sigma_v}e0 * n + {m.sigma_h}e0 * nhh) / n * {m.beta_hv}e0 * (ihh / nhh) ELSE 0e0 END AS f
          FROM q{t} WHERE k < {m.substeps}))))))))))))))))),
        f{t} AS (SELECT *, CASE WHEN nhh > 0 AND n > 0 THEN {m.sigma_v}e0 * n * {m.sigma_h}e0 * nhh / ({m.sigma_v}e0 * n + {m.sigma_h}e0 * nhh) / nhh * {m.beta_vh}e0 * i / n ELSE 0e0 END AS lam FROM q{t} WHERE k = {m.substeps}),
        p{t + 1} AS (SELECT patch_id, s AS sv, e AS ev, i AS iv FROM f{t}),
        b{t} AS (SELECT a.*, {around}, {u("catch")} < 1 - exp(-coalesce(lam, 0) * {risk} * {m.dt_h}e0) AS caught, floor({u("where")} * ((r1 - r0 + 1) * (c1 - c0 + 1)))::BIGINT AS j FROM a{t} a LEFT JOIN f{t} ON patch_id = a.patch),
        a{t + 1} AS (SELECT agent_id, CASE WHEN stay <= {m.dt_h}e0 THEN (r0 + j // (c1 - c0 + 1)) * {w} + c0 + j % (c1 - c0 + 1) ELSE patch END AS patch, home,
          CASE WHEN health = 0 AND caught THEN 1 WHEN health = 1 AND {u("turn")} < 1 - exp(-{m.dt_h}e0 * {m.nu_h}e0) THEN 2 WHEN health = 2 AND {u("heal")} < 1 - exp(-{m.dt_h}e0 * {m.mu_h}e0) THEN 3 ELSE health END AS health,
          CASE WHEN stay <= {m.dt_h}e0 THEN floor({u("what")} * {len(m.alpha)})::BIGINT ELSE activity END AS activity, CASE WHEN stay <= {m.dt_h}e0 THEN -ln(1 - {u("stay")}) * {m.stay}e0 ELSE stay - {m.dt_h}e0 END AS stay FROM b{t})""")
    return ", ".join(parts) + f" SELECT health::INTEGER AS health, count(*) AS n, sum(patch)::BIGINT AS places, sum(activity)::BIGINT AS activities FROM a{steps} GROUP BY health"


_PATCHES = simulation.PatchModel(width=16, height=16)


@query(_patch_sql(5, _PATCHES))
def patch_epidemic(spark: SparkSession, d: str) -> DataFrame:
    """Q11: five steps of the vector-borne epidemic with every customer as an agent."""
    n = _PATCHES.width * _PATCHES.height
    patches = spark.range(n).select(F.col("id").alias("patch_id"), F.lit(900.0).alias("sv"), F.lit(0.0).alias("ev"), F.lit(100.0).alias("iv"))
    home = F.col("c_custkey") * 7919 % n
    agents = table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), home.alias("patch"), home.alias("home"), F.when(F.col("c_custkey") % 50 == 0, 2).otherwise(0).alias("health"), (F.col("c_custkey") % 4).cast("int").alias("activity"), F.lit(0.5).alias("stay"))
    return simulation.patch_epidemic(patches, agents, 5, _PATCHES)[1].groupBy("health").agg(F.count("*").alias("n"), F.sum("patch").alias("places"), F.sum("activity").alias("activities"))
