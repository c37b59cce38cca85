"""The job operators as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeloom.operators import jobs


def task_stream(requests: DataFrame) -> DataFrame:
    """Tasks of a stream of requests; stateless."""
    return jobs.fan_out(requests)


def state_stream(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Partial state of every job and ``width`` of event time, for output mode ``update``.

    The state kept is one row of aggregates for each job with events in the last
    windows: a window goes when the watermark has passed it.  Events may come in
    any order, as the fold orders by event time; those later than ``late`` are
    dropped.  :func:`current_states` merges the windows of a job.
    """
    windows = F.window("ts", width).alias("w")
    folded = jobs.partial_state(events.withWatermark("ts", late), windows)
    return folded.withColumn("window_start", F.col("w.start")).drop("w")


def window_stream(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Status events per window; a window is final once the watermark passed it."""
    return jobs.jobs_per_window(events.withWatermark("ts", late), width)


def distinct_requests(requests: DataFrame, within: str = "1 hour") -> DataFrame:
    """Drop repeated requests (same ``job_id``) that arrive within the time."""
    return requests.withWatermark("requested_at", within).dropDuplicatesWithinWatermark(["job_id"])


def upsert_states(states: DataFrame, folder: str) -> DataStreamWriter:
    """Write each update of :func:`state_stream` as one Parquet batch.

    A batch is stored under its own number and overwritten when it is run again,
    so a restart repeats no row; readers take the last batch of each job with
    :func:`current_states`.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(store)


def current_states(stored: DataFrame) -> DataFrame:
    """The state of each job: the last batch of each of its windows, merged."""
    values = [c for c in stored.columns if c not in ("job_id", "window_start", "batch")]
    last = (
        stored.groupBy("job_id", "window_start")
        .agg(F.max_by(F.struct(*values), "batch").alias("last"))
        .select("job_id", "window_start", "last.*")
    )
    return jobs.merged_state(last)


def compact_states(stored: DataFrame, folder: str) -> None:
    """Write the last batch of each window as batch 0 of a new folder, which then
    takes the place of the many batches."""
    values = [c for c in stored.columns if c not in ("job_id", "window_start", "batch")]
    last = stored.groupBy("job_id", "window_start").agg(F.max_by(F.struct(*values), "batch").alias("last"))
    last.select("job_id", "window_start", "last.*").write.mode("overwrite").parquet(f"{folder}/batch=0")
