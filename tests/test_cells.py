"""The inverted file against exact search."""

from __future__ import annotations

import numpy as np

from codeloom.operators import cells, retrieval

SCHEMA = "id long, embedding array<float>, note string"


def clustered(spark, rows=3000, width=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(25, width)) * 2
    # A third of all rows in one cluster, some rows equal.
    which = np.where(rng.random(rows) < 0.33, 0, rng.integers(0, 25, rows))
    points = (middles[which] + rng.normal(size=(rows, width))).astype(np.float32)
    points[20:40] = points[20]
    return spark.createDataFrame([(k, p.tolist(), "x") for k, p in enumerate(points)], SCHEMA)


def asked(corpus):
    return corpus.where("id % 30 = 0").selectExpr("id AS query_id", "embedding")


def test_recall_and_distances(spark):
    corpus = clustered(spark)
    index = cells.build(corpus)
    assert index.rows.count() == index.sizes.sum() == 3000 and len(index.sizes) == 54
    probes = cells.probes_for(index, 10)
    assert 1 <= probes < 40
    found = cells.approximate(index, asked(corpus), 10, probes)
    exact = retrieval.top_k(asked(corpus), corpus, 10)
    assert cells.recall_of(found, exact) >= 0.9
    got, best = ({(r.query_id, r.rank): (r.id, r.distance) for r in x.collect()} for x in (found, exact))
    assert got.keys() == best.keys()
    assert all(got[key][1] >= best[key][1] for key in best)


def test_all_cells_give_the_exact_answer(spark):
    corpus = clustered(spark, rows=400)
    index = cells.build(corpus, cells=7)
    found = cells.approximate(index, asked(corpus), 5, 7)
    order = ["query_id", "rank", "id", "distance"]
    assert sorted(map(tuple, found.select(order).collect())) == sorted(
        map(tuple, retrieval.top_k(asked(corpus), corpus, 5).select(order).collect())
    )


def test_queries_get_k_rows_from_small_cells(spark):
    corpus = clustered(spark, rows=60)
    index = cells.build(corpus, cells=20)
    found = cells.approximate(index, asked(corpus), 30, 1)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {30}
    more = cells.approximate(index, asked(corpus), 100, 1)
    assert {r["count"] for r in more.groupBy("query_id").count().collect()} == {60}


def test_nulls_few_rows_and_none(spark):
    rows = [(1, [0.0, 1.0], "x"), (2, None, "x"), (None, [1.0, 1.0], "x"), (3, [0.0, 1.0], None), (1, [0.0, 1.0], "x")]
    corpus = spark.createDataFrame(rows, SCHEMA)
    index = cells.build(corpus)
    queries = spark.createDataFrame([(7, [0.0, 0.0]), (8, None), (None, [0.0, 0.0])], "query_id long, embedding array<float>")
    found = cells.approximate(index, queries, 2, cells.probes_for(index, 2))
    assert [tuple(r) for r in found.select("query_id", "rank", "id", "distance").orderBy("rank").collect()] == [
        (7, 1, 1, 1.0), (7, 2, 1, 1.0)
    ]
    none = cells.build(corpus.limit(0))
    assert cells.probes_for(none, 3) == 1
    assert cells.approximate(none, queries, 3, 1).count() == 0
