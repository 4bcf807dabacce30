"""Mixing sources to target weights, by soft membership.

Every document has a posterior over domains (the sources with a target, and one for all others): certain where its source
is known, predicted by a classifier trained on the labelled documents where it isn't. Document rates r, 0 <= r <= the
repeats of its domain, are fitted by distributed projected gradient so that the expected tokens of each targeted domain
meet its target in the least squares sense. A step moves a document by the domains' steps weighted by its posterior, and the
projection clips the sum of all steps so far to [0, cap] (lazy projection), so a document's rate is a closed form of one
number per domain: a round is one aggregation over the documents without a source, those with one being K totals, and only
K numbers go to the driver and back. Rates become whole copies by a hash threshold per source, set so that the tokens kept
are those asked for to within a document.

The corpus is read three times: to count tokens, to draw the training sample, and to predict where the source is missing.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import cut, spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Labelled documents the classifier is trained on, about (a hash sample by source, weighted back to the sources' sizes), and
#: of each source at least (all, if it has fewer); its hashed features; its iterations.
TRAIN_ROWS, TRAIN_LEAST, FEATURES, TRAIN_ITERATIONS = 20_000, 20, 4096, 25
#: Rounds of gradient steps at most, and the move of any domain's tokens, relative to all targets, that ends them.
ROUNDS, SETTLED = 60, 1e-4


@functools.cache
def _tokenizer(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(documents: DataFrame, key: str, text: str, keep: list[str], ranks: str = DEFAULT_RANKS) -> DataFrame:
    """key, keep..., tokens: the number of tokens of each whole text; 0 for empty and null ones."""
    kept = documents.select(key, *keep, text)
    schema = kept.drop(text).withColumn("tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(ranks).encode_ordinary_batch
        for b in batches:
            texts, sizes = b.column(b.num_columns - 1).fill_null(""), []
            for i in range(0, b.num_rows, 256):
                sizes += map(len, encode(texts.slice(i, 256).to_pylist(), num_threads=1))
            sizes = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sizes], names=schema.names)

    return kept.mapInArrow(count, schema)


def _sample_shares(counts: dict[str, int], train_rows: int) -> dict[str, float]:
    """The share of each source's rows to train on: small sources whole, the others the same number of rows."""
    left, shares = max(train_rows, TRAIN_LEAST * len(counts)), {}
    for i, (k, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left // (len(counts) - i))
        shares[k], left = take / n, left - take
    return shares


def posteriors(documents: DataFrame, key: str, text: str, source: str, train_rows: int = TRAIN_ROWS, counts: dict[str, int] | None = None) -> DataFrame:
    """key, guess (map of source to probability) for the documents without a source; no rows if none has one.

    A multinomial logistic regression on hashed words (log-scaled, weighted by rarity), trained on about ``train_rows``
    labelled documents, picked by hash within each source and weighted by how many they stand for. ``counts``: labelled
    documents with text by source, counted here if not given; sources are classes and of bounded number."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
    from pyspark.ml.functions import vector_to_array

    spark = documents.sparkSession
    usable = documents.where(F.length(text) > 0)
    if counts is None:
        counts = {r[0]: r[1] for r in usable.where(F.col(source).isNotNull()).groupBy(source).count().collect()}
    if not counts:
        return spark.createDataFrame([], f"`{key}` {documents.schema[key].dataType.simpleString()}, guess map<string,double>")
    unknown = usable.where(F.col(source).isNull()).select(key, text)
    if len(counts) == 1:
        return unknown.select(key, F.create_map(F.lit(next(iter(counts))), F.lit(1.0)).alias("guess"))
    share = F.create_map(*[F.lit(x) for pair in _sample_shares(counts, train_rows).items() for x in pair])[F.col(source)]
    drawn = usable.select(F.col(text).alias("text"), F.col(source).alias("source"), share.alias("share"), _unit_hash(key, "train").alias("u")).where("u < share")
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    hashed = HashingTF(inputCol="words", outputCol="hashed", numFeatures=FEATURES, binary=True)
    sample = cut(hashed.transform(words.transform(drawn)).select("hashed", "source", (1 / F.col("share")).alias("stands_for")))
    label = StringIndexer(inputCol="source", outputCol="label", stringOrderType="alphabetAsc").fit(sample)
    rarity = IDF(inputCol="hashed", outputCol="features").fit(sample)
    classifier = LogisticRegression(maxIter=TRAIN_ITERATIONS, regParam=0.02, family="multinomial", weightCol="stands_for").fit(rarity.transform(label.transform(sample)))
    predicted = classifier.transform(rarity.transform(hashed.transform(words.transform(unknown.withColumnRenamed(text, "text")))))
    return predicted.select(key, F.map_from_arrays(F.array(*[F.lit(x) for x in label.labels]), vector_to_array("probability")).alias("guess"))


def _rate(p: Column, cap: Column, pull: list[float]) -> Column:
    """The rate, from 1, after steps that add up to ``pull`` of the domains, kept within [0, cap]."""
    moved = F.aggregate(F.zip_with(p, F.array(*[F.lit(float(x)) for x in pull]), lambda a, g: a * g), F.lit(1.0), lambda s, x: s - x)
    return F.greatest(F.lit(0.0), F.least(cap, moved))


def fit_rates(soft: DataFrame, sure_tokens: np.ndarray, unsure_tokens: np.ndarray, caps: np.ndarray, goals: np.ndarray) -> list[float]:
    """The sum of all gradient steps of each domain. ``soft``: p, cap, tokens of documents of uncertain domain;
    ``sure_tokens``, ``unsure_tokens``: the tokens by domain, at rate 1, of the others and of these; a goal of NaN asks for
    nothing.

    Each domain's step is its excess over its tokens at rate 1. It stops when no total moves by more than ``SETTLED`` of all
    goals together."""
    k = len(goals)
    asked = ~np.isnan(goals)
    size = np.maximum(sure_tokens + unsure_tokens, 1.0)
    pull, before = np.zeros(k), None
    for _ in range(ROUNDS):
        total = sure_tokens * np.clip(1 - pull, 0.0, caps)
        if unsure_tokens.any():
            rated = soft.select((_rate(F.col("p"), F.col("cap"), pull.tolist()) * F.col("tokens")).alias("t"), "p")
            total = total + np.array([x or 0.0 for x in rated.agg(*[F.sum(F.col("t") * F.col("p")[i]) for i in range(k)]).first()], dtype=float)
        if before is not None and np.abs(total - before).max() <= SETTLED * max(np.nansum(goals), 1.0):
            break
        before = total
        pull = pull + np.where(asked, (total - np.nan_to_num(goals)) / size, 0.0)
    return pull.tolist()


def _unit_hash(key: str, salt: str = "copies") -> Column:
    return (F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(2**53)) + F.lit(0.5)) / F.lit(float(2**53))


def _by_stratum(values: dict, of: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[of] if values else F.lit(None).cast("double")


def _whole_copies(rated: DataFrame, key: str, stratum: Column) -> DataFrame:
    """copies: the whole part of the rate, and one more below a threshold on hash / fraction that is set per stratum so that
    the tokens of the fractions come out. Two histograms of bounded size find it: one over the range, one inside the step;
    a stratum's step and threshold are one number each."""
    v = rated.withColumn("stratum", stratum).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    v = v.withColumn("v", F.when((F.col("part") > 1e-9) & (F.col("tokens") > 0), _unit_hash(key) / F.col("part"))).withColumn("b", F.least(F.floor(F.col("v") * 512), F.lit(4095)).cast("int"))
    open_docs = v.where("v is not null")
    upto = Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum")
    coarse = open_docs.groupBy("stratum", "b").agg(F.sum("tokens").alias("t"), F.sum(F.col("part") * F.col("tokens")).alias("a"))
    summed = coarse.withColumn("upto", F.sum("t").over(upto)).withColumn("asked", F.sum("a").over(whole)).where("upto > asked")
    edges = {r[0]: (r[1], r[2]) for r in summed.groupBy("stratum").agg(F.min("b"), F.min_by(F.col("asked") - (F.col("upto") - F.col("t")), "b")).collect()}
    edge, left = (_by_stratum({k: float(e[i]) for k, e in edges.items()}, F.col("stratum")) for i in (0, 1))
    inside = open_docs.withColumn("edge", edge).where("b = edge").select("stratum", "tokens", F.least(F.floor((F.col("v") * 512 - F.col("edge")) * 65536), F.lit(65535)).cast("int").alias("b"))
    fine = inside.groupBy("stratum", "b").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(upto))
    # a step is taken whole if more than half of it is asked for
    last = {r[0]: r[1] for r in fine.withColumn("left", left).where("upto - t / 2 <= left").groupBy("stratum").agg(F.max("b")).collect()} if edges else {}
    limit = _by_stratum({k: (last.get(k, -1) + 1) / 65536 + e[0] for k, e in edges.items()}, F.col("stratum"))
    extra = F.col("v").isNotNull() & F.coalesce(F.col("v") * 512 < limit, F.lit(True))
    return v.withColumn("copies", (F.col("whole") + extra.cast("int")).cast("int"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source", train_rows: int = TRAIN_ROWS, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The mixture: key, source, tokens, rate, copies, membership (map of domain to posterior), target_share, target_tokens.

    ``targets``: source, target_weight, max_repeats; a bounded table (at most 10,000 rows, checked). ``total_tokens``: size
    of the mixture, by default that of all documents. Weights are relative among the sources that have tokens. Defined
    cases: a source without a target isn't mixed in (rate 0); a target without documents stays unmet; null, negative or
    NaN weights and repeats count as 0, repeated targets as the first by weight and repeats; a document without a source is
    mixed by its predicted domains, at most as often as the most likely of them may be (of equally likely ones, the least
    often), so not at all where that has no target; texts without tokens have copies 0. A source that falls short at its
    repeats keeps its full repeats, and the shares reached say so. ``target_share`` and ``target_tokens`` are those of the
    document's source, 0 without one.
    """
    wanted = targets.where(F.col("source").isNotNull()).select("source", "target_weight", "max_repeats").limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 targets")
    clean = lambda x: float(x) if x is not None and x == x and x > 0 else 0.0
    by_source: dict[str, tuple[float, float]] = {}
    for r in sorted(wanted, key=lambda r: (r["source"], -clean(r["target_weight"]), -clean(r["max_repeats"]))):
        by_source.setdefault(r["source"], (clean(r["target_weight"]), float(int(clean(r["max_repeats"])))))
    other = ""
    while other in by_source:
        other += "_"
    domains, k = [*by_source, other], len(by_source) + 1
    domain = F.when(F.col("source").isNotNull(), F.when(F.col("source").isin(*by_source), F.col("source")).otherwise(F.lit(other)) if by_source else F.lit(other))
    documents = spread(documents.select(key, F.col(source).alias("source"), F.col(text).alias("text")))
    sized = cut(count_tokens(documents, key, "text", ["source"], ranks).withColumn("domain", domain))
    found = {r[0]: (r[1], float(r[2] or 0)) for r in sized.groupBy("domain").agg(F.count_if(F.col("tokens") > 0), F.sum("tokens")).collect()}
    unsure = sized.where("source is null")
    if None in found and found[None][0]:
        guesses = posteriors(documents.withColumn("domain", domain), key, "text", "domain", train_rows, {d: n for d, (n, _) in found.items() if d is not None and n})
        p = F.array(*[F.coalesce(F.col("guess")[d], F.lit(0.0)) for d in domains])
        likely = unsure.join(guesses, key, "left").withColumn("p", F.when(F.col("guess").isNotNull(), p)).drop("guess")
    else:
        likely = unsure.withColumn("p", F.lit(None).cast("array<double>"))
    caps = np.array([by_source[d][1] for d in by_source] + [0.0])
    most = F.array_max("p")
    least_cap = F.array_min(F.filter(F.zip_with("p", F.array(*[F.lit(float(c)) for c in caps]), lambda a, c: F.when(a >= most, c)), lambda c: c.isNotNull()))
    nowhere = F.array(*[F.lit(float(d == other)) for d in domains])
    soft = cut(likely.withColumn("p", F.coalesce("p", nowhere)).withColumn("cap", least_cap))
    unsure_tokens = np.array([x or 0.0 for x in soft.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(k)]).first()], dtype=float)
    sure_tokens = np.array([found.get(d, (0, 0.0))[1] for d in domains])
    total = float(total_tokens if total_tokens is not None else sum(t for _, t in found.values()))
    have = (sure_tokens + unsure_tokens)[:-1] > 0
    weight = sum(by_source[d][0] for d, h in zip(by_source, have) if h)
    share = [by_source[d][0] / weight if h and weight else 0.0 for d, h in zip(by_source, have)]
    pull = fit_rates(soft, sure_tokens, unsure_tokens, caps, np.array([total * s for s in share] + [np.nan]))
    fixed = _by_stratum({d: float(np.clip(1 - g, 0.0, c)) for d, g, c in zip(domains, pull, caps)}, F.col("domain"))
    sure = sized.where("source is not null").withColumn("rate", fixed).withColumn("membership", F.create_map("domain", F.lit(1.0)))
    named = F.map_filter(F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), "p"), lambda _, x: x > 0)
    rated = sure.unionByName(soft.withColumn("rate", _rate(F.col("p"), F.col("cap"), pull)).withColumn("membership", named).drop("p", "cap"))
    # rates of sources without a target are whole (0): strata are the targeted sources and the documents without a source
    mixed = _whole_copies(rated, key, F.coalesce(F.concat(F.lit("s"), "domain"), F.lit("unknown")))
    target = F.coalesce(_by_stratum(dict(zip(by_source, share)), F.col("source")), F.lit(0.0))
    return mixed.select(key, "source", "tokens", "rate", F.when(F.col("tokens") > 0, F.col("copies")).otherwise(0).alias("copies"), "membership", target.alias("target_share"), (target * total).alias("target_tokens"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached: source, target_weight, max_repeats, target_share (among sources with documents), documents,
    tokens_available, tokens, share (by source as given), soft_share (by membership). Sources without a target, documents
    without a source (null) and targets without documents have rows too."""
    copied = F.col("copies") * F.col("tokens")
    hard = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_available"), F.sum(copied).alias("tokens"), F.max("target_share").alias("target_share"), F.max("copies").alias("most_copies"))
    soft = mixture.where("copies > 0").select(F.explode("membership").alias("source", "p"), copied.alias("t")).groupBy("source").agg(F.sum(F.col("p") * F.col("t")).alias("soft_tokens"))
    total = mixture.agg(F.sum(copied).alias("total"))
    rows = hard.join(targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats")), "source", "full_outer").join(soft, "source", "left").join(F.broadcast(total))
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = lambda c: F.round(F.when(F.col("total") > 0, nil(c) / F.col("total")).otherwise(0.0), 6)
    return rows.select("source", "target_weight", "max_repeats", F.round(F.coalesce("target_share", F.lit(0.0)), 6).alias("target_share"), nil("documents").alias("documents"), nil("tokens_available").alias("tokens_available"), nil("tokens").alias("tokens"), nil("most_copies").alias("most_copies"), part("tokens").alias("share"), part("soft_tokens").alias("soft_share"))
