"""Stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from codeloom.operators.retrieval import document_ids


def _writer(rows: DataFrame, mode: str, partitions: tuple[str, ...]) -> DataFrameWriter:
    return rows.write.mode(mode).partitionBy(*partitions)


def file_results(stats: DataFrame, job_id: int, analysis_type: str) -> DataFrame:
    """Rows as stored: one per job, file and analysis, the counts as JSON."""
    keys = ("repo_id", "path", "language")
    counts = [c for c in stats.columns if c not in keys]
    return stats.select(
        F.lit(job_id).cast("long").alias("job_id"),
        F.col("path").alias("file_path"),
        F.lit(analysis_type).alias("analysis_type"),
        F.to_json(F.struct(*counts)).alias("results"),
        "language",
    )


def write_file_results(results: DataFrame, folder: str) -> None:
    """Parquet, one folder per job, analysis and language.

    Writing them again replaces these folders and no others, so a job that runs
    twice leaves its rows once.
    """
    _writer(results, "overwrite", ("job_id", "analysis_type", "language")).option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(folder)


def write_cross_dependencies(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Parquet, one folder per kind of dependency."""
    _writer(rows, mode, ("dependency_type",)).parquet(folder)


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a relational table; the driver jar is the caller's."""
    rows.write.mode(mode).options(**options).jdbc(url, table)


def append_documents(documents: DataFrame, folder: str, collection: str, key: str) -> DataFrame:
    """Append to a vector collection with ids that count on from its size."""
    spark = documents.sparkSession
    path = f"{folder.rstrip('/')}/{collection}"
    file_system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark._jsc.hadoopConfiguration()
    )
    exists = file_system.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    start = spark.read.parquet(path).count() if exists else 0
    numbered = document_ids(documents, collection, key, start)
    numbered.write.mode("append").parquet(path)
    return numbered


def write_dependency_map(edges: DataFrame, folder: str) -> None:
    """The dependency graph as JSON lines, one edge per line."""
    edges.select(F.to_json(F.struct(*edges.columns)).alias("value")).write.mode("overwrite").text(
        folder
    )
