from datetime import datetime, timedelta

import pytest

from codeloom.operators import jobs
from codeloom.plans import fixture
from codeloom.sources import sinks
from codeloom.streaming import jobs as streams

START = datetime(2024, 1, 1)
EVENT_SCHEMA = ("job_id long, event_id long, ts timestamp, status string, progress int, "
                "error_message string")


def event(job, number, seconds, status, progress=None, error=None):
    return (job, number, START + timedelta(seconds=seconds), status, progress, error)


EVENTS = [
    event(1, 1, 0, "pending", 0), event(1, 2, 5, "running", 10), event(1, 3, 9, "running", 80),
    event(1, 4, 9, "completed", 100),
    event(2, 5, 0, "pending", 0), event(2, 7, 700, "failed", None, "boom"), event(2, 6, 3, "running", 30),
]


def test_latest_state(spark):
    rows = {r["job_id"]: r for r in jobs.latest_state(spark.createDataFrame(EVENTS, EVENT_SCHEMA)).collect()}
    assert (rows[1]["status"], rows[1]["progress"], rows[1]["error_message"]) == ("completed", 100, None)
    assert rows[1]["completed_at"] == START + timedelta(seconds=9)
    # A failure sets no progress: the last one stays.
    assert (rows[2]["status"], rows[2]["progress"], rows[2]["error_message"]) == ("failed", 30, "boom")
    assert rows[2]["started_at"] == START and rows[2]["completed_at"] is None


def test_fan_out(spark):
    requests = spark.createDataFrame(
        [(1, 9, ["c#", "csharp"]), (2, 9, ["ts", "go"]), (3, 9, ["cobol"]), (4, 9, ["C#"]), (5, 9, ["python"])],
        "job_id long, repository_id long, languages array<string>",
    )
    rows = sorted((r["job_id"], r["queue"], r["analyser"]) for r in jobs.fan_out(requests).collect())
    assert rows == [
        (1, "analysis_queue", "csharp"), (1, "polyglot_analysis_queue", "polyglot"),
        (2, "analysis_queue", "go"), (2, "analysis_queue", "javascript"),
        (2, "polyglot_analysis_queue", "polyglot"), (5, "analysis_queue", "python"),
    ]


def test_changed_files(corpus):
    before = corpus({"a": "1", "b": "2", "gone": "3"})
    after = corpus({"a": "1", "b": "changed", "new": "4"})
    assert sorted(r["path"] for r in jobs.changed_files(before, after).collect()) == ["b", "new"]


def test_catalogue(spark):
    repositories = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "repository_id long, user_id long")
    work = spark.createDataFrame([(10, 1), (11, 3)], "job_id long, repository_id long")
    asked = spark.createDataFrame([(5, 10), (5, 11), (6, 11)], "user_id long, job_id long")
    assert {r["repository_id"] for r in jobs.repositories_of(repositories, 5).collect()} == {1, 2}
    allowed = jobs.owned_jobs(asked, work, repositories).collect()
    assert sorted((r["user_id"], r["job_id"]) for r in allowed) == [(5, 10), (6, 11)]
    state = jobs.latest_state(spark.createDataFrame(EVENTS, EVENT_SCHEMA))
    assert jobs.job_status(state, 2).first()["status"] == "failed"
    assert jobs.job_status(state, 3).count() == 0
    assert jobs.dashboard_totals(repositories, state).first().asDict() == {
        "repositories": 3, "analyses": 2, "running": 0}
    assert [r["job_id"] for r in jobs.recent_jobs(state, 1).collect()] == [2]
    assert jobs.job_durations(state).first()["seconds"] == 9


# ------------------------------------------------------------------- streaming


@pytest.fixture
def event_stream(spark, tmp_path):
    """The same events as files, one per step, and as a stream over them."""
    folder = str(tmp_path / "events")
    for i, row in enumerate(EVENTS):
        spark.createDataFrame([row], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)
    return spark.read.schema(EVENT_SCHEMA).parquet(folder), stream


def run(writer, tmp_path, name):
    query = writer.option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True)
    started = query.start()
    started.awaitTermination(120)
    assert started.exception() is None


def test_state_stream_equals_batch(spark, tmp_path, event_stream):
    batch, stream = event_stream
    folder = str(tmp_path / "states")
    run(streams.upsert_states(streams.state_stream(stream), folder), tmp_path, "state")
    stored = streams.current_states(spark.read.parquet(folder))
    expected = jobs.latest_state(batch)
    names = sorted(expected.columns)
    compacted = str(tmp_path / "compacted")
    streams.compact_states(spark.read.parquet(folder), compacted)
    again = streams.current_states(spark.read.parquet(compacted))
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, expected.select(names).collect()))
    assert sorted(map(str, stored.select(names).collect())) == sorted(map(str, expected.select(names).collect()))


def test_window_stream_gives_finished_windows(spark, tmp_path, event_stream):
    batch, stream = event_stream
    # One far event moves the watermark over all others.
    far = spark.createDataFrame([event(9, 99, 90_000, "pending", 0)], EVENT_SCHEMA)
    far.write.mode("append").parquet(str(tmp_path / "events"))
    run(streams.window_stream(stream).writeStream.outputMode("append").format("memory").queryName("w"),
        tmp_path, "window")
    got = sorted(map(str, spark.table("w").collect()))
    assert got == sorted(map(str, jobs.jobs_per_window(batch).collect()))


def test_request_streams(spark, tmp_path):
    schema = "job_id long, repository_id long, languages array<string>, requested_at timestamp"
    folder = str(tmp_path / "requests")
    rows = [(1, 1, ["js", "go"], START), (2, 1, ["go"], START), (1, 1, ["js", "go"], START + timedelta(minutes=1))]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    tasks = streams.task_stream(streams.distinct_requests(stream))
    run(tasks.writeStream.outputMode("append").format("memory").queryName("t"), tmp_path, "tasks")
    assert sorted((r["job_id"], r["analyser"]) for r in spark.table("t").collect()) == [
        (1, "go"), (1, "javascript"), (1, "polyglot"), (2, "go")]


# ----------------------------------------------------------------------- sinks


def test_stored_results(spark, corpus, tmp_path):
    from codeloom.operators import crosslang, stats

    files = corpus({"a.go": "package a\nfunc F() {}", "b.js": "'/api/x'"})
    folder = str(tmp_path / "results")
    rows = sinks.file_results(stats.file_stats(files, "go"), 7, "syntax_analysis")
    sinks.write_file_results(rows, folder)
    row = spark.read.parquet(folder).first()
    assert (row["job_id"], row["file_path"], row["language"]) == (7, "a.go", "go")
    assert '"function_count":1' in row["results"]
    sinks.write_file_results(rows, folder)  # again: the same rows, once
    sinks.write_file_results(sinks.file_results(stats.file_stats(files, "go"), 8, "syntax_analysis"), folder)
    assert sorted(r["job_id"] for r in spark.read.parquet(folder).collect()) == [7, 8]
    folder = str(tmp_path / "cross")
    sinks.write_cross_dependencies(crosslang.polyglot_rows(crosslang.Extracts(files)), folder)
    assert spark.read.parquet(folder).first()["dependency_type"] == "api_call"


def test_collection_appends_go_on_counting(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "key string")
    more = spark.createDataFrame([("c",)], "key string")
    sinks.append_documents(docs, str(tmp_path), "public_docs", "key")
    sinks.append_documents(more, str(tmp_path), "public_docs", "key")
    stored = spark.read.parquet(str(tmp_path / "public_docs"))
    assert sorted(r["doc_id"] for r in stored.collect()) == [f"public_docs_{i}" for i in range(3)]


def test_dependency_map(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a", "b")], "repo_id long, src string, dst string")
    sinks.write_dependency_map(edges, str(tmp_path / "map"))
    assert spark.read.text(str(tmp_path / "map")).first()[0] == '{"repo_id":1,"src":"a","dst":"b"}'


def test_fixture_sql_has_no_substitution_marks():
    assert "${" not in fixture.files_sql()
