"""Vector retrieval: top-k search, context, prompt, documents of results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import rules

#: Rows of a block of queries and of a block of the corpus.
QUERY_ROWS, CORPUS_ROWS = 512, 4_096
_HIT_SCHEMA = "query_id long, id long, distance double"


def _blocks(rows: DataFrame, key: str, size: int, *by: str) -> DataFrame:
    """``block`` for each row: about ``size`` rows of one value of ``by`` in each."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    # Without ``by`` the counts are one row.
    dealt = rows.join(counts, list(by)) if by else rows.crossJoin(F.broadcast(counts))
    return dealt.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks")


def _packed(rows: DataFrame, key: str, name: str, *by: str) -> DataFrame:
    """One row for each block, with arrays of keys and vectors."""
    return rows.groupBy(*by, "block").agg(
        F.collect_list(F.struct(F.col(key).alias("key"), F.col("embedding"))).alias(name)
    ).drop("block")


def nearest(points: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each point the names and squared distances of the k nearest rows.

    The matrix form chooses candidates with a margin for its rounding; these are
    ranked by the sum of squared differences, unrounded, ties by name.
    """
    square, others = (points**2).sum(axis=1), (rows**2).sum(axis=1)
    rough = square[:, None] - 2.0 * points @ rows.T + others[None, :]
    margin = 1e-12 * points.shape[1] * (square + others.max(initial=0.0)) + 1e-300
    found = []
    for q, row in enumerate(rough):
        limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
        near = np.flatnonzero(row <= limit + 2 * margin[q])
        exact = ((rows[near] - points[q]) ** 2).sum(axis=1)
        best = np.lexsort((names[near], exact))[:k]
        found.append((names[near][best], exact[best]))
    return found


def top_k(queries: DataFrame, corpus: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """The ``k`` nearest corpus rows of each query by squared L2 distance.

    ``queries``: ``query_id, embedding`` (and ``repository_id`` if ``filtered``);
    ``corpus``: ``id, embedding`` (and ``repository_id``).  Ties go to the lower
    id.  Exact, and one lazy plan: blocks of queries meet blocks of the corpus (of
    the same repository, if filtered) and give k rows per query, so the shuffle
    holds blocks x queries x k rows and never the pairs.  A hot repository is
    many blocks.
    """
    return search(queries, corpus, k, ["repository_id"] if filtered else [])


def search(queries: DataFrame, corpus: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``top_k`` among corpus rows with the values of ``by`` of the query; a query that has
    several rows gets the best of all of them."""
    asked = _packed(_blocks(queries.select("query_id", "embedding", *by), "query_id", QUERY_ROWS, *by), "query_id", "q", *by)
    kept = _packed(_blocks(corpus.select("id", "embedding", *by), "id", CORPUS_ROWS, *by), "id", "c", *by)
    # A stated set of queries against all rows, in blocks.
    pairs = (asked.join(kept, by) if by else asked.crossJoin(kept)).select("q", "c")

    def hits_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, c in zip(batch["q"], batch["c"], strict=True):
                points, rows = (np.array([x["embedding"] for x in side], dtype=np.float64) for side in (q, c))
                names = np.array([x["key"] for x in c])
                found = nearest(points, rows, names, k)
                yield pd.DataFrame({
                    "query_id": np.repeat([x["key"] for x in q], [len(ids) for ids, _ in found]),
                    "id": np.concatenate([ids for ids, _ in found]),
                    "distance": np.concatenate([far for _, far in found]),
                })

    hits = pairs.repartition(F.xxhash64(F.col("q")[0]["key"], F.col("c")[0]["key"])).mapInPandas(hits_of, _HIT_SCHEMA)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def context(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts of the hits of each query, in order, joined by a blank line.

    ``hits``: ``query_id, collection, id, rank`` where collection 0 comes before
    1; a query has a handful of hits, so each list is small.
    """
    # Only texts that were hit are shuffled.
    keys = ["collection", "id"]
    wanted = documents.select(*keys, "text").join(hits.select(*keys).distinct(), keys, "left_semi")
    texts = hits.join(wanted, keys)
    in_order = F.sort_array(F.collect_list(F.struct("collection", "rank", "text")))
    return texts.groupBy("query_id").agg(
        F.concat_ws("\n\n", F.transform(in_order, lambda h: h["text"])).alias("context")
    )


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The filled prompt of each question; the model call is not part of this."""
    joined = questions.join(contexts, "query_id", "left")
    return joined.select(
        "query_id",
        F.concat(
            F.lit(rules.PROMPT_HEAD),
            F.coalesce("context", F.lit("")),
            F.lit(rules.PROMPT_QUESTION),
            "question",
            F.lit(rules.PROMPT_TAIL),
        ).alias("prompt"),
    )


def result_documents(results: DataFrame) -> DataFrame:
    """Documents about analysis results: ``repo_id, path, language, results``."""
    text = F.concat(
        F.lit("\nFile: "),
        "path",
        F.lit("\nLanguage: "),
        "language",
        F.lit("\nAnalysis Results: "),
        "results",
        F.lit("\n"),
    )
    metadata = F.create_map(
        F.lit("repository_id"),
        F.col("repo_id").cast("string"),
        F.lit("file_path"),
        F.col("path"),
        F.lit("language"),
        F.col("language"),
        F.lit("type"),
        F.lit("code_analysis"),
    )
    return results.select("repo_id", "path", text.alias("text"), metadata.alias("metadata"))


def document_ids(documents: DataFrame, collection: str, key: str, start: int = 0) -> DataFrame:
    """Ids ``<collection>_<n>`` with n counting on from ``start``.

    A running number over everything would sort the collection in one task.
    Rows are dealt by the first hex digits of a hash of their key into 4,096
    buckets; a bucket is numbered on its own, after all rows of the buckets
    before it.
    """
    dealt = documents.withColumn("bucket", F.substring(F.md5(F.col(key).cast("binary")), 1, 3))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("bucket").orderBy(key)
    number = F.col("offset") + F.row_number().over(inside) - 1 + F.lit(start)
    return (
        dealt.join(F.broadcast(offsets), "bucket")  # 4,096 rows at most
        .withColumn("doc_id", F.concat(F.lit(f"{collection}_"), number.cast("string")))
        .drop("bucket", "offset")
    )


def embed(texts: DataFrame, column: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Add ``embedding``: ``encode`` maps a list of texts to a matrix of vectors.

    The model is the caller's; it runs on Arrow batches inside the tasks.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(batch.tolist()), dtype=np.float32)))

    return texts.withColumn("embedding", vectors(F.col(column)))


def approximate_top_k(
    corpus: DataFrame, query: list[float], k: int, bucket_length: float = 0.5, tables: int = 8
) -> DataFrame:
    """Approximate neighbours of one vector by random projections (Spark ML)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    vectors = corpus.select("id", array_to_vector("embedding").alias("features"))
    model = BucketedRandomProjectionLSH(
        inputCol="features",
        outputCol="hashes",
        bucketLength=bucket_length,
        numHashTables=tables,
        seed=1,
    ).fit(vectors)
    near = model.approxNearestNeighbors(vectors, Vectors.dense(query), k, distCol="l2")
    return near.select("id", (F.col("l2") * F.col("l2")).alias("distance"))
