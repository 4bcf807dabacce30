import random

import numpy as np

from graphweft.llm import mixing as M

TARGETS = "source string, target_weight double, max_repeats int"


def corpus(spark, n=600, seed=5):
    rnd = random.Random(seed)
    words = {s: [f"{s}{i}" for i in range(40)] for s in ("big", "mid", "tiny", "untargeted")}
    rows = []
    for i in range(n):
        s = rnd.choices(list(words), (60, 30, 3, 7))[0]
        text = " ".join(rnd.choices(words[s], k=rnd.randint(5, 80)))
        rows.append((i, text, None if i % 20 == 0 else s, s))
    rows += [(n, None, "big", "big"), (n + 1, "", None, "big"), (n + 2, "", "mid", "mid")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


def test_shares_caps_and_report(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 1.0, 1), ("mid", 1.0, 3), ("tiny", 1.0, 2), ("nowhere", 1.0, 5), (None, 1.0, 1)], TARGETS)
    mixed = M.mix(docs, targets).cache()
    rows = mixed.collect()
    assert len(rows) == docs.count()
    caps = {"big": 1, "mid": 3, "tiny": 2, "untargeted": 0}
    assert all(r["copies"] <= caps.get(r["source"], 3) for r in rows)
    assert all(r["copies"] == 0 for r in rows if r["tokens"] == 0 or r["source"] == "untargeted")
    total = sum(r["tokens"] for r in rows)
    got = {}
    for r in rows:
        for d, p in r["membership"].items():
            got[d] = got.get(d, 0) + p * r["copies"] * r["tokens"]
    biggest = max(r["tokens"] for r in rows)
    assert abs(got["mid"] - total / 3) < 0.03 * total  # reaches its share by repeating
    assert abs(got["big"] - total / 3) < 0.03 * total
    full = 2 * sum(r["tokens"] for r in rows if r["source"] == "tiny")
    assert full <= got["tiny"] <= full + 3 * biggest  # falls short: all of it, as often as it may
    shares = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert shares["nowhere"]["tokens"] == 0 and shares["nowhere"]["documents"] == 0 and shares["tiny"]["most_copies"] == 2 and abs(sum(r["share"] for r in shares.values()) - 1) < 1e-4


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    guess = M.posteriors(docs, "doc_id", "text", "source").collect()
    true = {r["doc_id"]: r["tokens"] for r in docs.collect()}
    assert len(guess) == 30 and sum(max(r["guess"], key=r["guess"].get) == true[r["doc_id"]] for r in guess) >= 27


def test_thresholds_keep_the_tokens_asked_for(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 37), "a") for i in range(2000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 4)], TARGETS)
    for total in (12_345.0, 60_000.0, 100_000.0):
        rows = M.mix(docs, targets, total_tokens=total).collect()
        assert abs(sum(r["copies"] * r["tokens"] for r in rows) - total) <= 80, total


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], TARGETS)
    assert [r["copies"] for r in M.mix(docs, none).collect()] == [0, 0]
    assert M.mix(docs.limit(0), spark.createDataFrame([("a", 1.0, 2), ("a", None, None), ("b", float("nan"), 1)], TARGETS)).count() == 0
    assert M.shares(M.mix(docs, none), none).count() == 1


def test_many_equal_domains_are_mixed_and_untargeted_ones_are_not(spark):
    # twelve domains with words of their own, and a text of none of them
    rows = [(i, f"w{i % 12} v{i % 12}", f"d{i % 12}") for i in range(240)] + [(1000 + i, "nothing of that", None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = M.mix(docs, spark.createDataFrame([(f"d{i}", 1.0, 2) for i in range(12)], TARGETS)).collect()
    assert all(r["rate"] > 0 for r in mixed if r["source"] is None)
    assert abs(sum(r["copies"] * r["tokens"] for r in mixed) - sum(r["tokens"] for r in mixed)) <= 12 * 5
    assert {round(r["target_tokens"], 6) for r in mixed if r["source"] == "d1"} == {round(sum(r["tokens"] for r in mixed) / 12, 6)}
    only = M.mix(docs, spark.createDataFrame([("nowhere", 1.0, 2)], TARGETS)).collect()
    assert len(only) == 270 and all(r["copies"] == 0 for r in only)


def test_training_sample_keeps_rare_sources():
    counts = {"big": 1_000_000, "mid": 5_000, "rare": 3}
    shares = M._sample_shares(counts, 20_000)
    assert shares["rare"] == 1.0 and shares["mid"] == 1.0 and round(shares["big"] * counts["big"]) == 20_000 - 5_003
    assert M._sample_shares({f"s{i}": 100 for i in range(1000)}, 20)["s1"] == 0.2


def test_rates_meet_feasible_targets(spark):
    rnd = random.Random(2)
    rows = [([a, b, 1 - a - b], 3.0, rnd.randint(1, 50)) for a, b in ((rnd.uniform(0, 0.5), rnd.uniform(0, 0.5)) for _ in range(300))]
    soft = spark.createDataFrame(rows, "p array<double>, cap double, tokens long")
    unsure = np.array([sum(r[0][i] * r[2] for r in rows) for i in range(3)])
    sure, caps = np.array([4000.0, 2000.0, 0.0]), np.array([3.0, 3.0, 3.0])
    goals = np.array([5000.0, 6000.0, 3000.0])
    pull = M.fit_rates(soft, sure, unsure, caps, goals)
    rate = [min(3.0, max(0.0, 1 - sum(p * g for p, g in zip(r[0], pull)))) for r in rows]
    total = sure * np.clip(1 - np.array(pull), 0, caps) + [sum(x * r[0][i] * r[2] for x, r in zip(rate, rows)) for i in range(3)]
    assert np.abs(total - goals).max() <= 0.01 * goals.sum()
