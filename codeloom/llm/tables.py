"""Spark helpers of this subpackage: tables in the shared folder, ranks, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs no more than the tasks that
    ran on it.  The files live as long as the folder.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition: the columns are equal, or both null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def text_name(text: Column, names: tuple[str, str] = ("t1", "t2")) -> list[Column]:
    """128 bits of hash that name a text."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def without_places(values: Column, places: Column) -> Column:
    """The array ``values`` without its elements at the ascending ``places``: the slices between them."""

    def between(k: Column) -> Column:
        first = F.coalesce(F.get(places, k - 1) + 1, F.lit(0))
        return F.slice(values, first + 1, F.coalesce(F.get(places, k), F.size(values)) - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), between))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df``, stored, with the global 0-based position of each row in ``order``.

    Ranges of the order are numbered apart and then shifted by the rows of the
    ranges before, so no task sees more than its range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    frozen = stored(
        dealt.withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)),
        "ranked",
    )
    sizes = frozen.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row for each range: as many as partitions.
    before = sizes.select(
        F.col("_range"),
        (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"),
    )
    return (
        frozen.join(before, "_range")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_range", "_place", "_before")
    )
