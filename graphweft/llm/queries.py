"""Queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import bpe, lookalike, mixing, quantiles
from graphweft.session import table


P5_FIELDS, P5_AT, P5_ALPHA = ("metadata", "edges", "nquiets"), (0.01, 0.25, 0.5, 0.75, 0.9, 0.99), 0.01


def _once(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """run_id, pe, keep..., and each field's place in a sketch: every record once, however often it was delivered. Records lie
    together by PE and span of 4096 timesteps, so that sketches of a PE combine where they are and a PE with a third of all
    records is spread; what is shuffled is places, not values."""
    keys = ["record_id", "run_id", "pe", "timestep"]
    places = [quantiles.place_of(F.col(f).cast("double"), P5_ALPHA).alias(f) for f in P5_FIELDS]
    slots = table(spark, d, "perf_records").select(*keys, *keep, *places)
    placed = slots.repartition("run_id", "pe", F.shiftright("timestep", 12))
    return placed.withColumn("span", F.shiftright("timestep", 12)).groupBy(*keys, "span").agg(*[F.max(c).alias(c) for c in (*keep, *P5_FIELDS)])


def _sketch_of_pes(spark: SparkSession, d: str) -> DataFrame:
    """app, run_id, pe, field, sign, bucket, n: one sketch per PE, lying together by run, PE and field."""
    rows = quantiles.unpivot_fields(_once(spark, d, "app"), ("app", "run_id", "pe", "span"), P5_FIELDS, "long")
    parts = quantiles.sketch_places(rows, "value", ("app", "run_id", "pe", "span", "field"))
    return quantiles.merge(parts.repartition("run_id", "pe", "field"), ("app", "run_id", "pe", "field"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of metadata, edges and nquiets per run, app and PE, with their error bound: sketched once per PE, whose
    sketches are joined to those of runs and apps."""
    pes = _sketch_of_pes(spark, d)
    levels = (("run", ("run_id",), F.col("run_id").cast("string")), ("app", ("app",), F.col("app")), ("pe", ("run_id", "pe"), F.concat(F.col("run_id").cast("string"), F.lit("/"), F.col("pe").cast("string"))))
    found = None
    for level, keys, key in levels:
        by = (*keys, "field")
        one = quantiles.percentiles(quantiles.merge(pes, by), by, P5_AT, P5_ALPHA).select(F.lit(level).alias("level"), key.alias("key"), "field", "q", "value", "n", "n_unknown", "rel_error")
        found = one if found is None else found.unionByName(one)
    return found


def p5_daily_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same per app, from sketches made per day (of logging) and then joined to those of all days."""
    rows = quantiles.unpivot_fields(_once(spark, d, "logged_at", "app").withColumn("day", F.to_date("logged_at")), ("day", "app"), P5_FIELDS, "long")
    daily = quantiles.sketch_places(rows, "value", ("day", "app", "field"))
    return quantiles.percentiles(quantiles.merge(daily, ("app", "field")), ("app", "field"), P5_AT, P5_ALPHA)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_ids(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How many copies of every document the mixture takes."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches, by source."""
    return mixing.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but differ in characters."""
    return lookalike.same_look_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text, the class of texts that look like it, and how many writings that has."""
    return lookalike.look_members(table(spark, d, "documents"))


def p8_folded(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every document."""
    return lookalike.fold_column(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "folded")


QUERIES = {"p5_percentiles": p5_percentiles, "p5_daily_merge": p5_daily_merge, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_classes": p8_classes, "p8_folded": p8_folded}
_P5_TAIL = """
b AS (SELECT {by}, field, CASE WHEN value IS NULL OR isnan(value) THEN NULL WHEN value = 0 THEN 0 WHEN value > 0 THEN 1 ELSE -1 END AS sign,
    CASE WHEN value IS NULL OR isnan(value) THEN NULL WHEN value = 0 THEN 0 WHEN isinf(value) THEN 2000000000 ELSE ceil(ln(abs(value)) / ln(1.01e0 / 0.99e0))::INTEGER END AS bucket
  FROM x),
c AS (SELECT {by}, field, sign, bucket, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT *, sum(CASE WHEN bucket IS NULL THEN n ELSE 0 END) OVER (PARTITION BY {by}, field) AS n_unknown FROM c),
r AS (SELECT *, sum(n) OVER (PARTITION BY {by}, field ORDER BY sign * (bucket::BIGINT + 3000000000)) AS upto, sum(n) OVER (PARTITION BY {by}, field) AS total
  FROM w WHERE bucket IS NOT NULL)
SELECT {by}, field, q::DOUBLE AS q, CASE WHEN sign = 0 THEN 0.0 WHEN bucket = 2000000000 THEN sign * 'inf'::DOUBLE ELSE sign * 2 * pow(1.01e0 / 0.99e0, bucket) / (1.01e0 / 0.99e0 + 1) END AS value,
  total::BIGINT AS n, n_unknown::BIGINT AS n_unknown, 0.01::DOUBLE AS rel_error
FROM r, (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS q) qs
WHERE floor(q * (total - 1)) < upto AND floor(q * (total - 1)) >= upto - n
"""
_P5_ONCE = "u AS (SELECT DISTINCT ON (record_id) * FROM perf_records)"
_P5_FIELDS = "unnest([{'field': 'metadata', 'value': metadata}, {'field': 'edges', 'value': edges}, {'field': 'nquiets', 'value': nquiets::DOUBLE}], recursive := true)"
SQL = {
    "p5_percentiles": f"WITH {_P5_ONCE}, l AS (SELECT unnest([{{'level': 'run', 'key': run_id::VARCHAR}}, {{'level': 'app', 'key': app}}, {{'level': 'pe', 'key': run_id || '/' || pe}}], recursive := true), metadata, edges, nquiets FROM u), x AS (SELECT level, key, {_P5_FIELDS} FROM l)," + _P5_TAIL.format(by="level, key"),
    "p5_daily_merge": f"WITH {_P5_ONCE}, x AS (SELECT app, {_P5_FIELDS} FROM u)," + _P5_TAIL.format(by="app"),
}
