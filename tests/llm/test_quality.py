import random

import numpy as np

from codeloom.llm import quality

SCHEMA = "doc_id long, text string, votes string, score int"


def sentence(rng, n=60):
    return " ".join(rng.choice(["the", "ofan", "theri", "and", "nder", "ersted", "in", "aning"]) + str(rng.choice(["", "a", "in", "er", "on", "ti", "es"])) for _ in range(n)) + "."


def junk(rng, kind):
    words = sentence(rng).split()
    return [
        lambda: " ".join(w + rng.choice(["***", "$$$", "%%%", "&&&"]) for w in words),
        lambda: " ".join(w.upper() + "!!" for w in words),
        lambda: " | ".join(words) + " |",
        lambda: " ".join(w for w in words[:6] for _ in range(12)),
    ][kind]()


def fixture(count=400):
    rng = random.Random(2)
    rows = []
    for k in range(count):
        bad = k % 8 == 0
        rows.append((k, junk(rng, k // 8 % 4) if bad else sentence(rng, rng.randint(30, 300)), not bad))
    return rows


def test_finds_junk_and_keeps_clean_texts(spark):
    rows = fixture()
    frame = spark.createDataFrame([(a, b, "v", 1) for a, b, _ in rows], SCHEMA)
    kept = {r["doc_id"] for r in quality.good_only(frame).collect()}
    truth = {r[0] for r in rows if r[2]}
    assert len(truth - kept) <= 2 and len(kept - truth) <= 3
    assert quality.good_only(frame).columns == frame.columns


def test_null_empty_long_and_repeated_rows(spark):
    rows = [(a, b, "v", 1) for a, b, _ in fixture(160)]
    odd = [(None, None, None, None), (900, "", "", 0), (901, " \n", "", 0), (902, "word " * 90_000, "", 0), (5, rows[5][1], "x", 2)]
    got = quality.quality(spark.createDataFrame(rows + odd + odd, SCHEMA)).collect()
    assert len(got) == 170 and all(0 <= r["score"] <= 1 and 0 <= r["weak_label"] <= 1 for r in got)
    again = {(r["doc_id"], r["text_hash"]): r["score"] for r in got}
    assert all(abs(again[r["doc_id"], r["text_hash"]] - r["score"]) < 1e-12 for r in got)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert quality.quality(frame).count() == 0 and quality.good_only(frame).count() == 0


def test_expectation_maximisation_recovers_rates():
    rng = np.random.default_rng(1)
    m, n = len(quality.LABELLERS), 40_000
    bad = rng.random(n) < 0.2
    rate = np.where(bad[:, None], 0.4, 0.01)
    votes = np.where(rng.random((n, m)) < rate, quality.BAD, quality.GOOD)
    votes[rng.random((n, m)) < 0.1] = quality.NONE
    patterns, inverse, counts = np.unique((votes * 3 ** np.arange(m)).sum(axis=1), return_inverse=True, return_counts=True)
    share, table, good = quality.agreement(patterns, counts.astype(float))
    assert abs(share - 0.2) < 0.02
    assert np.abs(table[:, quality.BAD, quality.BAD] - 0.4).max() < 0.03
    assert np.abs(table[:, quality.GOOD, quality.BAD] - 0.01).max() < 0.005
    assert ((good[inverse] < 0.5) == bad).mean() > 0.95


def test_rates_are_learnt_from_the_votes():
    """Noisy, sharp and weak labellers, and one that tells nothing."""
    rng = np.random.default_rng(1)
    m, n = len(quality.LABELLERS), 40_000
    on_good = np.array([0.3, 0.001, 0.001, 0.05, 0.05, 0.05, 0.01, 0.01])
    on_bad = np.array([0.3, 0.8, 0.95, 0.6, 0.6, 0.05, 0.3, 0.3])
    bad = rng.random(n) < 0.2
    votes = np.where(rng.random((n, m)) < np.where(bad[:, None], on_bad, on_good), quality.BAD, quality.GOOD)
    votes[rng.random((n, m)) < 0.1] = quality.NONE
    patterns, inverse, counts = np.unique((votes * 3 ** np.arange(m)).sum(axis=1), return_inverse=True, return_counts=True)
    share, table, good = quality.agreement(patterns, counts.astype(float))
    assert abs(share - 0.2) < 0.02
    assert np.abs(table[:, quality.BAD, quality.BAD] - on_bad).max() < 0.03
    assert np.abs(table[:, quality.GOOD, quality.BAD] - on_good).max() < 0.015
    assert ((good[inverse] < 0.5) == bad).mean() > 0.97
    # The bad vote of the one that tells nothing moves no text.
    assert good[patterns == quality.BAD][0] > 0.95


def test_sample_is_bounded_with_copies_without_an_id(spark):
    rows = [(None, "copy of the one text " * 3)] * 300 + [(k, f"text number {k} of some more words") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    assert quality.sampled(frame, 20).count() == 20 and quality.sampled(frame, 1000).count() == 41
