"""Analysis jobs: routing of requests, state of jobs, catalogue look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules

FAILED, COMPLETED = "failed", "completed"


def fan_out(requests: DataFrame) -> DataFrame:
    """Tasks of each request: ``job_id, repository_id, queue, analyser``.

    One task per analyser that handles a requested language, and one for the
    cross-language analysis when more than one language was asked for.  Names
    nobody handles give no task; no request is lost because the wrong worker
    took it.
    """
    aliases = F.create_map(*[F.lit(x) for pair in rules.LANGUAGE_ALIASES.items() for x in pair])
    handled = F.transform("languages", lambda name: F.element_at(aliases, name))
    analysers = F.array_distinct(F.array_compact(handled))

    def task(queue: str, analyser: Column) -> Column:
        return F.struct(F.lit(queue).alias("queue"), analyser.alias("analyser"))

    tasks = F.concat(
        F.transform(analysers, lambda a: task("analysis_queue", a)),
        F.when(
            F.size("languages") > 1,
            F.array(task("polyglot_analysis_queue", F.lit("polyglot"))),
        ).otherwise(F.array().cast("array<struct<queue:string,analyser:string>>")),
    )
    return requests.select("job_id", "repository_id", F.inline(tasks))


def partial_state(events: DataFrame, *by: Column | str) -> DataFrame:
    """Status events folded by job (and ``by``) into values that can be merged.

    Status, progress and error message keep the place ``(ts, event_id)`` they come
    from; null ones are skipped.  All are plain aggregates, so a job with very
    many events is combined before the shuffle, and the same fold runs on a stream.
    """

    def last(column: str) -> Column:
        # Structs order by their fields; null ones are skipped by max.
        found = F.struct("ts", "event_id", column)
        return F.max(found if column == "status" else F.when(F.col(column).isNotNull(), found)).alias(column)

    return events.groupBy("job_id", *by).agg(
        last("status"), last("progress"), last("error_message"),
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("status") == COMPLETED, F.col("ts"))).alias("completed_at"),
    )


def merged_state(partials: DataFrame) -> DataFrame:
    """One row per job from any number of partial states."""
    folded = partials.groupBy("job_id").agg(
        *[F.max(c).alias(c) for c in ("status", "progress", "error_message")],
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
    )
    values = [F.col(c)[c].alias(c) for c in ("status", "progress", "error_message")]
    return folded.select("job_id", *values, "started_at", "completed_at")


def latest_state(events: DataFrame) -> DataFrame:
    """Fold status events into one row per job.

    Events are ordered by ``(ts, event_id)``.  The last status wins, whatever was
    before it; progress and error message keep their last value where an event
    has none; a job is started with its first event and completed with its last
    completion.
    """
    return merged_state(partial_state(events))


def jobs_per_window(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Status events per tumbling window of event time."""
    counted = events.groupBy(F.window("ts", width).alias("w"), "status").agg(
        F.count("*").alias("events")
    )
    return counted.select(F.col("w.start").alias("window_start"), "status", "events")


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Files to analyse again: new or with another content hash.

    Only (repository, path, hash) is shuffled, never text.
    """

    def hashed(files: DataFrame) -> DataFrame:
        return files.select("repo_id", "path", F.sha2("content", 256).alias("content_hash"))

    return hashed(current).join(
        hashed(previous), ["repo_id", "path", "content_hash"], "left_anti"
    )


def file_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What became of each file: ``new``, ``changed`` or ``deleted``.

    Results of deleted files are to be dropped; their ``content_hash`` is null.
    Only (repository, path, hash) is shuffled, never text.
    """

    def hashed(files: DataFrame, name: str) -> DataFrame:
        return files.select("repo_id", "path", F.sha2("content", 256).alias(name), F.lit(True).alias(f"has_{name}"))

    both = hashed(current, "new").join(hashed(previous, "old"), ["repo_id", "path"], "full")
    change = (
        F.when(F.col("has_old").isNull(), "new")
        .when(F.col("has_new").isNull(), "deleted")
        .when(~F.col("new").eqNullSafe(F.col("old")), "changed")
    )
    return both.select("repo_id", "path", F.col("new").alias("content_hash"), change.alias("change")).filter(
        F.col("change").isNotNull()
    )


# ------------------------------------------------------------------ catalogue


def repositories_of(repositories: DataFrame, user_id: int) -> DataFrame:
    return repositories.filter(F.col("user_id") == user_id)


def repositories_by_owner(repositories: DataFrame) -> DataFrame:
    return repositories.groupBy("user_id").agg(
        F.count("*").alias("repositories"),
        F.max("repository_id").alias("newest_repository"),
    )


def owned_jobs(requests: DataFrame, jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Requests (``user_id, job_id``) for jobs of repositories the user owns."""
    owners = jobs.join(repositories.select("repository_id", "user_id"), "repository_id").select(
        "user_id", "job_id"
    )
    return requests.join(owners, ["user_id", "job_id"], "left_semi")


def job_status(jobs: DataFrame, job_id: int) -> DataFrame:
    """The six fields shown for one job, if it exists."""
    shown = ["job_id", "status", "progress", "started_at", "completed_at", "results"]
    return jobs.filter(F.col("job_id") == job_id).select(
        *[F.col(c) if c in jobs.columns else F.lit(None).alias(c) for c in shown]
    )


def dashboard_totals(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Repositories, analyses and running jobs, in one aggregation."""
    kind = F.col("kind")
    both = repositories.select(F.lit("repository").alias("kind"), F.lit("").alias("status"))
    both = both.unionByName(jobs.select(F.lit("job").alias("kind"), "status"))
    return both.agg(
        F.count_if(kind == "repository").alias("repositories"),
        F.count_if(kind == "job").alias("analyses"),
        F.count_if((kind == "job") & (F.col("status") == "running")).alias("running"),
    )


def recent_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` jobs started last (top-n per task, then merged)."""
    return jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(n)


def recent_analyses(jobs: DataFrame, requests: DataFrame, n: int = 20) -> DataFrame:
    """The jobs started last with the repository and languages asked for."""
    asked = requests.select("job_id", "repository_id", "languages")
    return recent_jobs(jobs, n).join(asked, "job_id", "left")


def job_summaries(jobs: DataFrame, tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """Start, end, language and number of files of each job and language analysed.

    ``tasks``: ``job_id, repository_id, analyser``; ``counts``: ``repository_id,
    language, files``.
    """
    analysed = tasks.select("job_id", "repository_id", F.col("analyser").alias("language"))
    return (
        jobs.join(analysed, "job_id")
        .join(counts, ["repository_id", "language"], "left")
        .select("job_id", "started_at", "completed_at", "language", F.coalesce("files", F.lit(0)).alias("files_analyzed"))
    )


def job_durations(jobs: DataFrame) -> DataFrame:
    """Finished jobs with their duration in seconds."""
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return jobs.filter(F.col("completed_at").isNotNull()).select(
        "job_id", "started_at", "completed_at", seconds.alias("seconds")
    )
