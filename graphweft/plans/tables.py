"""Queries of the aggregates, windows, sets, scalars and sketches over the driver's tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model
from graphweft.analytics import bursts, simulation
from graphweft.functions import scalars, sketches
from graphweft.operators import bsp, neighbors, sets, similarity
from graphweft.plans.graphs import GRAPH, draw, trace_adjacency, trace_edges, trace_vertices
from graphweft.session import table
from graphweft.sources import generators

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT user_id, event_type, date_trunc('day', ts) AS window_start, count(*) AS recent FROM events GROUP BY ALL),
h AS (SELECT *, coalesce(sum(recent) OVER (PARTITION BY user_id, event_type ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS history,
  date_diff('day', (SELECT min(window_start) FROM c), window_start) AS windows_before FROM c)
SELECT user_id, event_type, strftime(window_start, '%Y-%m-%d') AS day, recent, history, windows_before FROM h WHERE history > 0 AND recent * windows_before >= 2 * history""")
def burst_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Q5: users that do something much more often in a day than before."""
    found = bursts.bursts(table(spark, d, "events"), ["user_id", "event_type"], "ts")
    return found.select("user_id", "event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "recent", "history", "windows_before")


def _cms_sql() -> str:
    w, depth = sketches.size(0.01, 0.1)
    rows = " UNION ALL ".join(f"SELECT user_id, {j} AS r, (({a}::HUGEINT * user_id + {b}) % 4294967311) % {w} AS bucket, n FROM c" for j, (a, b) in enumerate(sketches.HASHES[:depth]))
    return f"WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), h AS ({rows}), s AS (SELECT r, bucket, sum(n) AS m FROM h GROUP BY ALL) SELECT user_id, n, min(m)::BIGINT AS estimate FROM h JOIN s USING (r, bucket) GROUP BY user_id, n"


@query(_cms_sql())
def cms_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Count-min estimates of events per user beside the true counts."""
    e = table(spark, d, "events").select("user_id")
    return sketches.estimate(sketches.build(e, F.col("user_id")), e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of an hour."""
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


@query("""WITH e AS (SELECT DISTINCT date_trunc('day', o.o_orderdate) AS w, l.l_suppkey AS a, 1000000 + l.l_partkey % 97 AS b FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
e2 AS (SELECT w, a, b FROM e UNION SELECT DISTINCT w, 1000000 + l_suppkey % 97, 1000000 + l_partkey % 97 FROM (SELECT date_trunc('day', o_orderdate) AS w, l_suppkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)),
u AS (SELECT DISTINCT w, least(a, b) AS a, greatest(a, b) AS b FROM e2 WHERE a <> b)
SELECT strftime(x.w, '%Y-%m-%d') AS day, count(*) AS triangles FROM u x JOIN u y ON x.w = y.w AND x.b = y.a JOIN u z ON z.w = x.w AND z.a = x.a AND z.b = y.b GROUP BY x.w""")
def window_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Triangles among each day's links of suppliers, supplier groups and part groups."""
    j = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts")), "l_orderkey")
    group = lambda c: F.lit(1000000) + F.col(c) % 97
    links = F.array(F.struct(F.col("l_suppkey").alias("src"), group("l_partkey").alias("dst")), F.struct(group("l_suppkey").alias("src"), group("l_partkey").alias("dst")))
    found = bursts.window_triangles(j.select("ts", F.explode(links).alias("e")).select("ts", "e.src", "e.dst"), "ts", "1 day")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "triangles")


@query("SELECT user_id, max(struct_pack(a := ts, b := event_id)).b AS event_id FROM events GROUP BY user_id")
def latest_message(spark: SparkSession, d: str) -> DataFrame:
    """Each user's newest event."""
    return neighbors.latest_message(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT owner, max(struct_pack(a := step, b := n)).b AS n, max(step) AS step FROM (SELECT owner, step, count(*) AS n FROM vertex_trace_a GROUP BY ALL) GROUP BY owner")
def latest_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of each owner's reports the one of the latest step."""
    reports = table(spark, d, "vertex_trace_a").groupBy("owner", "step").agg(F.count("*").alias("n"))
    return reports.groupBy("owner").agg(F.max_by("n", "step").alias("n"), F.max("step").alias("step"))


@query(f"WITH {GRAPH} SELECT owner, count(*) AS n, count_if(infected = 1)::BIGINT AS infected, count_if(infected = 1 AND step = (SELECT max(step) FROM vx))::BIGINT AS infected_last FROM vx GROUP BY owner")
def conditional_count(spark: SparkSession, d: str) -> DataFrame:
    """Vertices, infected ones, and infected ones of the last step, by owner."""
    by_step = trace_vertices(spark, d).groupBy("owner", "step").agg(F.count("*").alias("n"), F.count_if(F.col("infected") == 1).alias("infected"))
    last = by_step.agg(F.max("step").alias("last"))
    return by_step.join(F.broadcast(last)).groupBy("owner").agg(F.sum("n").alias("n"), F.sum("infected").alias("infected"), F.sum(F.when(F.col("step") == F.col("last"), F.col("infected")).otherwise(0)).alias("infected_last"))


@query("SELECT user_id, event_type, event_id, rank FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) WHERE rank <= 5")
def top5_per_owner(spark: SparkSession, d: str) -> DataFrame:
    """Each user's five greatest events."""
    return neighbors.top_by_owner(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), "user_id", "value", "event_id", 5).drop("value")


@query("""WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS a FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey % 100)) AS b FROM lineitem GROUP BY 1)
SELECT k, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_only, list_sort(a) = list_sort(b) AS same, list_contains(a, 7) AS has_7, list_min(a) AS least, list_max(b) AS greatest, array_to_string(a, ' ') AS text FROM s JOIN p USING (k)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Sets of suppliers and part numbers by order."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 100).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select("k", sets.cardinality(sets.union(a, b)).alias("n_union"), sets.cardinality(sets.intersect(a, b)).alias("n_both"), sets.cardinality(sets.difference(a, b)).alias("n_only"), sets.equal(a, b).alias("same"), sets.contains(a, F.lit(7).cast("long")).alias("has_7"), sets.least(a).alias("least"), sets.greatest(b).alias("greatest"), sets.text(a).alias("text"))


@query("SELECT i, array_to_string(list_sort(list(DISTINCT j)), ' ') AS row FROM (SELECT user_id AS i, day(ts) AS j, event_type FROM events) GROUP BY i")
def sparse_relation(spark: SparkSession, d: str) -> DataFrame:
    """The days of each user's events as rows of a sparse relation, pairs inserted one event type after another."""
    e = table(spark, d, "events").select(F.col("user_id").alias("i"), F.dayofmonth("ts").alias("j"), "event_type")
    r = sets.pair_insert(e.where("event_type = 'view'"), e.where("event_type <> 'view'"))
    return sets.pair_row(r).select("i", F.array_join(F.col("row").cast("array<string>"), " ").alias("row"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE day(ts) <= 15), b AS (SELECT DISTINCT user_id FROM events WHERE day(ts) > 15)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'ended' WHEN a.user_id IS NULL THEN 'new' ELSE 'continuing' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id""")
def window_changes(spark: SparkSession, d: str) -> DataFrame:
    """U8: users who stop, go on and begin between two halves of a month."""
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"))
    return sets.window_changes(e.where("day <= 15").select("user_id"), e.where("day > 15").select("user_id"))


@query("""SELECT p_partkey, list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295) AS hash FROM part""")
def djb2_hash(spark: SparkSession, d: str) -> DataFrame:
    """The string hash of the sketches."""
    return table(spark, d, "part").select("p_partkey", scalars.djb2(F.col("p_name")).alias("hash"))


@query("""WITH a AS (SELECT c_custkey, (c_custkey * 214013 + 2531011) & 4294967295 AS one FROM customer), b AS (SELECT *, (one * 214013 + 2531011) & 4294967295 AS two FROM a)
SELECT c_custkey, ((((two >> 16) & 32767) << 32) + ((one >> 16) & 32767))::BIGINT AS draw, two::BIGINT AS state FROM b""")
def lcg_random(spark: SparkSession, d: str) -> DataFrame:
    """The reproducible random numbers of the edge streams."""
    draw, state = scalars.lcg_draw(F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", draw.alias("draw"), state.alias("state"))


@query(f"WITH {GRAPH} SELECT s AS src, t AS dst, dir, 1 AS kind, (dir & 1) * 2 + (dir >> 1) AS flipped FROM g")
def edge_pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Edges through their packed form and back, and flipped."""
    word = trace_edges(spark, d).select("src", model.pack_edge(F.col("dst"), F.col("kind"), F.col("dir")).alias("w"))
    v, k, r = model.unpack_edge(F.col("w"))
    return word.select("src", v.alias("dst"), r.cast("int").alias("dir"), k.cast("int").alias("kind"), model.flip(r).cast("int").alias("flipped"))


@query("SELECT step, vec_id, vec_id >> 32 AS owner, vec_id & 4294967295 AS off, ((vec_id >> 32) << 32) | (vec_id & 4294967295) AS again FROM vertex_trace_a")
def id_parts(spark: SparkSession, d: str) -> DataFrame:
    """Ids apart into owner and offset, and together again."""
    v = F.col("vec_id")
    return table(spark, d, "vertex_trace_a").select("step", "vec_id", model.owner_of(v).alias("owner"), model.offset_of(v).alias("off"), model.make_id(model.owner_of(v), model.offset_of(v)).alias("again"))


@query(f"WITH {GRAPH} SELECT id, printf('0: %f, 1: %f', uid::DOUBLE, owner::DOUBLE) AS text FROM vx")
def vertex_text(spark: SparkSession, d: str) -> DataFrame:
    """Vertices as text."""
    return trace_vertices(spark, d).select("id", model.vertex_text(["uid", "owner"]).alias("text"))


@query(f"WITH {GRAPH}, w AS (SELECT DISTINCT step, vec_id FROM vertex_trace_b) SELECT count(*) AS n, sum(owner)::BIGINT AS owner, sum(uid)::BIGINT AS uid FROM vx")
def vertex_addition(spark: SparkSession, d: str) -> DataFrame:
    """P5: vertices added element by element over all."""
    v = trace_vertices(spark, d)
    one = v.select(F.lit(0).alias("id"), "owner", "uid", F.lit(1).alias("n"))
    return model.add_vertices(one, one.limit(0), ["n", "owner", "uid"]).drop("id")


@query("SELECT owner, count(*) AS n FROM (SELECT DISTINCT step, owner, vec_id, vec FROM vertex_trace_a) GROUP BY owner")
def count_by_owner(spark: SparkSession, d: str) -> DataFrame:
    """Vertices by owner."""
    return model.count_by_owner(trace_vertices(spark, d))


@query("SELECT owner, (owner::BIGINT << 32) | (row_number() OVER (PARTITION BY owner) - 1) AS id FROM (SELECT DISTINCT step, owner, vec_id, vec FROM vertex_trace_a)")
def create_vertices(spark: SparkSession, d: str) -> DataFrame:
    """New ids, dense within each owner."""
    rows = trace_vertices(spark, d).select(F.col("owner").alias("own"))
    return model.create_vertices(rows, F.col("own")).select("owner", "id")


@query("SELECT q.vec_id AS query, r.vec_id FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) <= 1.25")
def embedding_radius_search(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector against all, within a radius."""
    e = table(spark, d, "embeddings")
    return similarity.radius_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 1.25)


@query(f"WITH {GRAPH} SELECT adj.t AS id, (list(adj.s ORDER BY adj.s DESC))[1] AS newest, count(*) AS messages FROM adj GROUP BY adj.t")
def message_mail(spark: SparkSession, d: str) -> DataFrame:
    """Each vertex writes to its neighbours; mail comes newest first."""
    adj = trace_adjacency(spark, d)
    mail = adj.select("dst", F.col("src").alias("seq"), F.lit("hello").alias("text"))
    return bsp.deliver(mail, adj.select(F.col("src").alias("id")).distinct()).select("id", F.col("mail")[0]["seq"].alias("newest"), F.size("mail").alias("messages"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
od AS (SELECT src, count(*) AS out FROM l GROUP BY src), ids AS (SELECT src AS id FROM l UNION SELECT dst FROM l), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
r(k, id, x) AS (SELECT 0, id, 1 / n FROM ids, n UNION ALL SELECT k, id, 0.15e0 / n + 0.85e0 * sum(x) FROM (SELECT r.k + 1 AS k, l.dst AS id, r.x / od.out AS x FROM r JOIN l ON l.src = r.id JOIN od ON od.src = r.id WHERE r.k < 60 UNION ALL SELECT r.k + 1, r.id, 0e0 FROM r WHERE r.k < 60) q, n GROUP BY k, id, n),
moved AS (SELECT b.k, max(abs(b.x - a.x)) AS most FROM r a JOIN r b ON b.id = a.id AND b.k = a.k + 1 GROUP BY b.k), last AS (SELECT min(k) AS k FROM moved WHERE most <= 1e-4 / (SELECT count(*) FROM nation))
SELECT n_name, round(x, 6) AS rank FROM r JOIN last USING (k) JOIN nation ON n_nationkey = id""")
def rank_names(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over trade between nations, with their names, until none moves by more than 1e-4 of the mean rank (the
    tolerance for ranks of mean 1)."""
    t = lambda n: table(spark, d, n)
    trade = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rank = bsp.pagerank(trade.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")), 100, tolerance=1e-4 / max(t("nation").count(), 1))
    return t("nation").join(rank, F.col("n_nationkey") == F.col("id")).select("n_name", F.round("rank", 6).alias("rank"))


@query("WITH u AS (SELECT DISTINCT ON (record_id) * FROM perf_records WHERE total >= 0 AND total < 1e12), p AS (SELECT run_id, pe, max(struct_pack(a := timestep, b := total)).b AS last_total, sum(nneighbors) AS visits, count(*) AS n, sum(total) AS ms FROM u GROUP BY run_id, pe) SELECT run_id, round(sum(last_total), 4) AS last_total, sum(visits)::BIGINT AS visits, round(1000.0 * sum(n) / nullif(sum(ms), 0), 6) AS per_second FROM p GROUP BY run_id")
def throughput_summary(spark: SparkSession, d: str) -> DataFrame:
    """The last readings of all PEs of each run added up, its visits and its rate; totals that can't be read, are negative
    or of more than thirty years (1e12 ms) are left out."""
    p = table(spark, d, "perf_records").where("total >= 0 and total < 1e12")
    once = p.groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("run_id", "pe", "timestep", "total", "nneighbors")])
    by_pe = once.groupBy("run_id", "pe").agg(F.max(F.struct("timestep", "total"))["total"].alias("last_total"), F.sum("nneighbors").alias("visits"), F.count("*").alias("n"), F.sum("total").alias("ms"))
    rate = F.when(F.sum("ms") > 0, 1000.0 * F.sum("n") / F.sum("ms"))
    return by_pe.groupBy("run_id").agg(F.round(F.sum("last_total"), 4).alias("last_total"), F.sum("visits").alias("visits"), F.round(rate, 6).alias("per_second"))


@query("SELECT app, round(avg(total), 4) AS total, round(avg(edges), 4) AS edges, count(*) AS n FROM (SELECT DISTINCT ON (record_id) app, total, edges FROM perf_records) WHERE total BETWEEN 0 AND 1e6 AND edges BETWEEN 0 AND 1e6 GROUP BY app")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the metrics by application, unreadable ones left out."""
    once = table(spark, d, "perf_records").groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("app", "total", "edges")])
    return once.where("total between 0 and 1e6 and edges between 0 and 1e6").groupBy("app").agg(F.round(F.avg("total"), 4).alias("total"), F.round(F.avg("edges"), 4).alias("edges"), F.count("*").alias("n"))


@query("SELECT range AS id, (range + 1) % 1000 AS dst, range * 100 AS value FROM range(1000)")
def ring_input(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic input of the rank comparator."""
    return generators.ring(spark, 1000)


@query(f"""WITH u AS (SELECT id, bit, {draw("id", "bit", "2")} AS u FROM range(65536) e(id), range(12) b(bit)),
e AS (SELECT id, sum(CASE WHEN u >= 0.76 THEN 1 << (11 - bit) ELSE 0 END) AS src, sum(CASE WHEN (u >= 0.57 AND u < 0.76) OR u >= 0.95 THEN 1 << (11 - bit) ELSE 0 END) AS dst FROM u GROUP BY id),
g AS (SELECT src AS s, dst AS t FROM e UNION SELECT dst, src FROM e), d AS (SELECT s, count(*) AS degree FROM g GROUP BY s) SELECT degree, count(*) AS vertices FROM d GROUP BY degree""")
def kronecker(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic R-MAT graph, by degree."""
    return neighbors.degrees(model.adjacency(model.canonical_edges(generators.kronecker(spark, 12)))).groupBy("degree").agg(F.count("*").alias("vertices"))


@query(f"SELECT 4 * count(*) FILTER ({draw('range', '0', chr(39) + 'x' + chr(39))} ^ 2 + {draw('range', '0', chr(39) + 'y' + chr(39))} ^ 2 <= 1) / 1000000.0 AS pi FROM range(1000000)")
def pi(spark: SparkSession, d: str) -> DataFrame:
    """Q24: pi by hashed points."""
    return simulation.pi_estimate(spark, 1_000_000)


@query("SELECT owner, part, count(*) AS n FROM (SELECT (s_suppkey % 8)::INTEGER AS owner, floor(s_acctbal / 1000)::BIGINT AS part FROM supplier) GROUP BY ALL")
def owner_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by owner and bucket."""
    v = table(spark, d, "supplier").select((F.col("s_suppkey") % 8).cast("int").alias("owner"), F.floor(F.col("s_acctbal") / 1000).alias("part"))
    return v.groupBy("owner", "part").agg(F.count("*").alias("n"))
