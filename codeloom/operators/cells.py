"""Approximate top-k for batches of queries: an inverted file of cells around centres."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import retrieval
from codeloom.session import written

#: Bounds of what the centres are fitted on, of their number, and of what is searched
#: exactly to choose the number of probes.
SAMPLE_ROWS, MOST_CELLS, TUNING_ROWS = 65_536, 4_096, 256
_HASHES = 1 << 30


@dataclass(frozen=True)
class Index:
    """``centres``: one row for each cell; ``sizes``: rows in each cell; ``rows``: a stored
    table ``id, embedding, cell`` of every row of the corpus."""

    centres: np.ndarray
    sizes: np.ndarray
    rows: DataFrame


def _sample(corpus: DataFrame, rows: int, count: int, seed: int) -> DataFrame:
    """About ``rows`` of ``count`` rows, chosen by a hash of their id."""
    limit = math.ceil(_HASHES * min(1.0, rows / max(count, 1)))
    return corpus.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_HASHES)) < limit)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for the square of the point, which ranks no centre."""
    return (centres**2).sum(axis=1) - 2.0 * points @ centres.T


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def build(corpus: DataFrame, cells: int | None = None, rounds: int = 10, seed: int = 1) -> Index:
    """The index of ``corpus(id, embedding)``; rows without a vector are not in it.

    The centres are those of k-means on about ``SAMPLE_ROWS`` rows chosen by a hash of
    their id; by default there are as many cells as the square root of the rows, at most
    ``MOST_CELLS``.  Every row is put into the cell of its nearest centre, in one pass
    without a shuffle, and stored.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    kept = corpus.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    count = kept.count()
    schema = "id long, embedding array<float>, cell int"
    if not count:
        empty = kept.sparkSession.createDataFrame([], schema)
        return Index(np.zeros((0, 0)), np.zeros(0, dtype=np.int64), empty)
    wanted = min(cells or math.isqrt(count), MOST_CELLS)
    # A hash may leave out all rows of a tiny corpus.
    sample = kept if count <= SAMPLE_ROWS else _sample(kept, SAMPLE_ROWS, count, seed)
    features = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=max(wanted, 2), maxIter=rounds, seed=seed).fit(features)
    centres = np.array(model.clusterCenters(), dtype=np.float64)

    def dealt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=_distances(_matrix(batch["embedding"]), centres).argmin(axis=1).astype(np.int32))

    rows = written(kept.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>")).mapInPandas(dealt, schema))
    sizes = np.zeros(len(centres), dtype=np.int64)
    for cell, size in rows.groupBy("cell").count().collect():  # a row for each cell
        sizes[cell] = size
    return Index(centres, sizes, rows)


def probed(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``query_id, embedding, cell``: the ``probes`` nearest cells of each query, and as many
    more as it takes to hold ``k`` rows."""
    centres, sizes = index.centres, index.sizes

    def nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                order = _distances(_matrix(batch["embedding"]), centres).argsort(axis=1, kind="stable")
                full = sizes[order].cumsum(axis=1)
                needed = np.minimum((full < k).sum(axis=1) + 1, len(centres))
                yield batch.assign(cell=[list(cells[: max(probes, n)]) for cells, n in zip(order, needed, strict=True)])

    schema = "query_id long, embedding array<float>, cell array<int>"
    asked = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("query_id").cast("long"), F.col("embedding").cast("array<float>")
    )
    return asked.mapInPandas(nearest, schema).withColumn("cell", F.explode("cell"))


def approximate(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``query_id, id, distance, rank``: the ``k`` nearest rows of the probed cells.

    ``queries``: ``query_id, embedding``; those without a vector have no hits.  Distances
    are exact, ties go to the lower id.  Every query gets ``k`` rows if the corpus has
    them.  Queries of a cell meet its rows in blocks, so a large cell is many tasks, and
    the shuffle holds ``k`` rows for each query and block.
    """
    if not len(index.sizes):
        empty = "query_id long, id long, distance double, rank int"
        return queries.sparkSession.createDataFrame([], empty)
    return retrieval.search(probed(index, queries, k, probes), index.rows, k, ["cell"])


def probes_for(index: Index, k: int, recall: float = 0.95, seed: int = 2) -> int:
    """The fewest probes that find ``recall`` of the exact ``k`` nearest rows, measured on
    about ``TUNING_ROWS`` rows of the corpus as queries, each against all rows."""
    count = int(index.sizes.sum())
    if not count:
        return 1
    asked = written(
        _sample(index.rows, TUNING_ROWS, count, seed).select(F.col("id").alias("query_id"), "embedding")
    )
    hits = retrieval.top_k(asked, index.rows.select("id", "embedding"), k).select("query_id", "id")
    order = probed(index, asked, k, len(index.sizes)).groupBy("query_id").agg(
        F.collect_list("cell").alias("order")
    )
    # The place of a true neighbour's cell in the order of the query's cells.
    places = (
        hits.join(index.rows.select("id", "cell"), "id").join(order, "query_id")
        .groupBy(F.array_position("order", F.col("cell")).alias("place")).count().orderBy("place").collect()
    )
    total, seen = sum(row["count"] for row in places), 0
    for row in places:
        seen += row["count"]
        if seen >= recall * total:
            return int(row["place"])
    return len(index.sizes)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of ``exact(query_id, id)`` that ``found`` has too."""
    keys = ["query_id", "id"]
    marked = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    row = marked.agg(F.count("hit"), F.count("*")).first()
    return row[0] / row[1] if row[1] else 1.0
