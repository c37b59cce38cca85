import hashlib

import numpy as np
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.operators import retrieval as R

RNG = np.random.default_rng(4)


def vectors(spark, matrix, key="id", groups=None):
    rows = [(i, [float(x) for x in v], int(groups[i]) if groups is not None else 0)
            for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>, repository_id long")


def brute(queries, corpus, k, same=None):
    out = {}
    for q, point in enumerate(queries):
        d = [(round(float(((point - c) ** 2).sum()), 9), i) for i, c in enumerate(corpus)
             if same is None or same[0][q] == same[1][i]]
        out[q] = [i for _, i in sorted(d)[:k]]
    return out


def ranked(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def matrices():
    queries = RNG.integers(0, 3, (9, 4)).astype(np.float64)  # small integers: many ties
    corpus = RNG.integers(0, 3, (200, 4)).astype(np.float64)
    return queries, corpus


def test_top_k_with_ties_and_blocks(spark, monkeypatch):
    queries, corpus = matrices()
    expected = brute(queries, corpus, 5)
    left = vectors(spark, queries, "query_id")
    right = vectors(spark, corpus).repartition(7)
    assert ranked(R.top_k(left, right, 5)) == expected
    monkeypatch.setattr(R, "QUERY_ROWS", 2)
    monkeypatch.setattr(R, "CORPUS_ROWS", 30)
    assert ranked(R.top_k(left, right, 5)) == expected


def test_near_ties_are_ranked_unrounded(spark):
    """Far below the rounding of the matrix form around large vectors."""
    for base in (0.0, 1000.0):
        step = 2.0**-13 if base else 1e-5
        corpus = np.array([[base + 2 * step, base], [base + step, base], [base, base + 3 * step]])
        queries = np.array([[base, base]])
        hits = R.top_k(vectors(spark, queries, "query_id"), vectors(spark, corpus), 2)
        assert ranked(hits) == {0: [1, 0]}


def test_search_collects_nothing_to_the_driver(spark):
    queries, corpus = matrices()
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    R.top_k(vectors(spark, queries, "query_id"), vectors(spark, corpus), 5)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_top_k_inside_a_repository(spark):
    queries, corpus = matrices()
    a, b = RNG.integers(0, 4, 9), RNG.integers(0, 3, 200)
    hits = R.top_k(vectors(spark, queries, "query_id", a), vectors(spark, corpus, "id", b), 3, filtered=True)
    expected = {q: ids for q, ids in brute(queries, corpus, 3, (a, b)).items() if ids}
    assert ranked(hits) == expected


def test_more_wanted_than_there_is(spark):
    queries, corpus = matrices()
    assert len(ranked(R.top_k(vectors(spark, queries, "query_id"), vectors(spark, corpus[:3]), 5))[0]) == 3


def test_no_queries(spark):
    empty = vectors(spark, np.zeros((1, 2)), "query_id").filter("false")
    assert R.top_k(empty, vectors(spark, np.zeros((2, 2))), 2).count() == 0


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 0, 7, 2), (1, 0, 8, 1), (1, 1, 7, 1)],
                                 "query_id long, collection int, id long, rank int")
    texts = spark.createDataFrame([(0, 7, "second"), (0, 8, "first"), (1, 7, "code")],
                                  "collection int, id long, text string")
    contexts = R.context(hits, texts)
    assert contexts.first()["context"] == "first\n\nsecond\n\ncode"
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, question string")
    prompts = {r["query_id"]: r["prompt"] for r in R.prompts(asked, contexts).collect()}
    assert "Context:\nfirst\n\nsecond\n\ncode\n\nUser Question: why?" in prompts[1]
    assert prompts[2].startswith(rules.PROMPT_HEAD + rules.PROMPT_QUESTION + "how?")


def test_result_documents(spark):
    rows = spark.createDataFrame([(3, "a.go", "go", "{}")], "repo_id long, path string, language string, results string")
    row = R.result_documents(rows).first()
    assert row["text"] == "\nFile: a.go\nLanguage: go\nAnalysis Results: {}\n"
    assert row["metadata"] == {"repository_id": "3", "file_path": "a.go", "language": "go", "type": "code_analysis"}


def test_document_ids_are_dense_and_stable(spark):
    keys = [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["doc_id"] for r in R.document_ids(df.repartition(5), "c", "key", start=10).collect()}
    order = sorted(keys, key=lambda k: (hashlib.md5(k.encode()).hexdigest()[:3], k))
    assert got == {k: f"c_{10 + i}" for i, k in enumerate(order)}


def test_embed_uses_the_given_model(spark):
    texts = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    rows = R.embed(texts, "text", lambda batch: np.array([[len(t), 1.0] for t in batch])).collect()
    assert [r["embedding"] for r in rows] == [[2.0, 1.0], [4.0, 1.0]]


def test_approximate_neighbours_find_the_point_itself(spark):
    matrix = RNG.normal(size=(60, 8))
    df = vectors(spark, matrix).withColumn("embedding", F.col("embedding").cast("array<double>"))
    near = R.approximate_top_k(df, matrix[5].astype(np.float32).astype(float).tolist(), 3).collect()
    assert near[0]["id"] == 5
