"""Sorted streams of groups inside tasks, and connected components in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tables import stored


#: Rows for callers of ``whole_groups`` that have long rows.
GROUP_ROWS = 1024


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 20
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first ``keys`` columns, regrouped so that no group is
    cut: tables with the offsets of their groups.  At most ``rows`` rows of a batch
    are taken at a time, so what is copied beside the batch is these and a group."""
    held: list[pa.RecordBatch] = []

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in range(keys):
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        held.append(batch)
        last = [batch.column(k)[-1] for k in range(keys)]
        if [held[0].column(k)[0] for k in range(keys)] == last:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = edges(table)
        cut = int(starts[-1])
        yield table.slice(0, cut), starts
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(edges(table), table.num_rows)


def spanning_forest(count: int, near) -> list[tuple[int, int]]:
    """Edges that connect 0..count-1 as the graph does whose ``near(i, others)``
    says which of ``others`` are next to ``i``; at most ``count - 1``."""
    edges, left = [], np.arange(count)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            reached = left[hit]
            if len(reached):
                edges += [(at, int(x)) for x in reached]
                queue += reached.tolist()
                left = left[~hit]
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``edges(a, b)``: the smallest node of the component.

    Large-star and small-star steps in turn: each links the neighbours of a node
    to the smallest of them, so trees become stars in few rounds.  A step is a
    minimum by node, combined before its shuffle, and a join; a hub is a skewed
    key that a join can split.  Every round is stored.
    """
    # ``a > b`` throughout.
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.where("b > a").join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        small = small.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
