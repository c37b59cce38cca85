"""The registered queries: name -> function of (session, data folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.operators import (
    architecture,
    bridges,
    cells,
    complexity,
    crosslang,
    dependencies,
    impact as impacts,
    jobs,
    pyfacts,
    retrieval,
    routes,
    schemas,
    security,
    stats,
    symbols,
)
from codeloom.plans.inputs import Inputs
from codeloom.session import shared_folder
from codeloom.sources import corpus, logs, manifests, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, folder: build(Inputs(spark, folder))
    return build


def _on_files(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder).files())


def _on_facts(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Queries over the files and the facts of the Python ones."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        files = Inputs(spark, folder).files()
        return build(files, pyfacts.python_facts(files))

    _QUERIES[name] = run


def _on_scan(name: str, wanted: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Queries over one array of the cross-language scan."""
    _on_files(name, lambda files: build(crosslang.scan(files, wanted)))


def _on_extracts(
    name: str, build: Callable[[crosslang.Extracts], DataFrame], *wanted: str
) -> None:
    _on_files(name, lambda files: build(crosslang.Extracts(files, *wanted)))


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _long(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.col(n).cast("long") for n in names})


# -------------------------------------------------------------------- sources

_on_files("scan_by_language", lambda f: corpus.analysed_files(f, readable_only=False).select(
    "repo_id", "path", "language"))
_on_files("files_analyzed", corpus.language_counts)
_on_files("discover_languages", corpus.discovered_counts)
_on_files("resource_scan", corpus.resource_files)
for _name in ("npm_packages", "nuget_packages", "maven_packages", "gradle_packages", "go_modules",
              "package_inventory"):
    _on_files(_name, getattr(manifests, _name))


@_query
def build_log_errors(inputs: Inputs) -> DataFrame:
    return logs.build_errors(inputs.logs())


# ----------------------------------------------------------------- statistics

_on_files("loc_by_language", stats.lines_of_code)


def _declared(name: str, language: str, *kinds: str) -> None:
    _on_files(name, lambda f: stats.declarations(f, language, kinds=kinds))


_declared("js_declarations", "javascript", "function", "class")
_declared("js_imports", "javascript", "import")
_declared("js_exports", "javascript", "export")
_declared("csharp_declarations", "csharp", *rules.CSHARP_DECLARATIONS)
_declared("csharp_usings", "csharp", "using")
_declared("java_declarations", "java", *rules.JAVA_DECLARATIONS)
_declared("java_imports", "java", "import")
_declared("go_declarations", "go", *rules.GO_DECLARATIONS)
_declared("go_imports", "go", "import")
_SHORT = {"javascript": "js", "csharp": "csharp", "java": "java", "go": "go"}
for _name, _short in _SHORT.items():
    _on_files(f"{_short}_file_stats", lambda f, name=_name: stats.file_stats(f, name))
_on_facts("py_file_stats", pyfacts.file_stats)
_on_facts("py_declarations", lambda _, facts: pyfacts.declarations(facts).filter("kind <> 'import'"))
_on_facts("py_syntax_errors", lambda _, facts: _long("line")(
    pyfacts.errors(facts).select("repo_id", "path", "line")))


@_query
def valid_files(inputs: Inputs) -> DataFrame:
    files = inputs.files()
    errors = logs.build_errors(inputs.logs())
    return stats.valid_files(files, errors, pyfacts.python_facts(files))


# --------------------------------------------------------------- dependencies

_on_facts("py_import_edges", lambda _, facts: pyfacts.import_edges(facts))
_on_files("module_map", dependencies.module_map)
_on_facts("import_edges", dependencies.import_edges)
_on_facts("dependency_totals", dependencies.dependency_totals)
_on_facts("internal_edges", dependencies.internal_edges)
_on_facts("top_imports", lambda files, facts: _long("rank")(
    dependencies.top_imports(dependencies.import_edges(files, facts))))

# ----------------------------------------------------------------- complexity

_on_files("function_spans", lambda f: complexity.functions(f).select(
    "repo_id", "path", "language", "name", "fn_type",
    F.char_length("body").cast("long").alias("body_length"),
    F.md5(F.col("body").cast("binary")).alias("body_md5")))
for _name, _short in _SHORT.items():
    _on_files(f"{_short}_complexity", lambda f, name=_name: complexity.brace_function_complexity(f, name))
_on_facts("py_complexity", lambda _, facts: pyfacts.function_complexity(facts))
_on_facts("file_complexity", complexity.file_complexity)
_on_facts("repo_complexity", complexity.repo_complexity)
_on_facts("high_complexity", lambda files, facts: complexity.high_complexity(
    complexity.function_complexity(files, facts)))
_on_facts("complexity_buckets", lambda files, facts: complexity.complexity_buckets(
    complexity.function_complexity(files, facts)))
_on_facts("language_overview", lambda files, facts: complexity.language_overview(
    complexity.file_complexity(files, facts)))

# ------------------------------------------------------------------- security

_on_facts("security_findings", security.findings)
_on_facts("security_by_rule", lambda f, facts: security.by_rule(security.findings(f, facts)))
_on_facts("security_totals", lambda f, facts: security.totals(security.findings(f, facts)))

# --------------------------------------------------------------- architecture

for _name in ("package_structure", "mvc_by_name", "js_stack", "js_module_system",
              "csharp_namespaces", "csharp_arch", "java_packages", "go_packages", "java_arch",
              "go_arch"):
    _on_files(_name, getattr(architecture, _name))

# ------------------------------------------------------------- cross-language

_on_scan("api_endpoints", "endpoints", crosslang.api_endpoints)
_on_scan("config_deps", "configs", crosslang.config_deps)
_on_scan("http_apis", "routes", crosslang.http_apis)
_on_scan("mq_usage", "queues", crosslang.mq_usage)
_on_files("shared_resources", lambda f: crosslang.shared_resources(f, crosslang.scan(f, "name_ends")))
_on_files("build_deps", lambda f: crosslang.build_deps(
    f, crosslang.languages_present(corpus.discovered_files(f))))
_on_files("comm_catalogue", crosslang.comm_catalogue)
_GRAPH = crosslang.GRAPH_SCANS
_on_extracts("graph_edges", lambda e: e.edges(), *_GRAPH)
_on_extracts("graph_nodes", lambda e: crosslang.graph_nodes(e.edges()), *_GRAPH)
_on_extracts("graph_metrics", lambda e: crosslang.graph_metrics(e.edges()).withColumn(
    "density", F.round("density", 6)), *_GRAPH)
_on_extracts("hotspots", lambda e: crosslang.hotspots(e.edges()), *_GRAPH)


def _dependency_map(extracts: crosslang.Extracts) -> DataFrame:
    edges = extracts.edges()
    shared = shared_folder(edges.sparkSession)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = f"{shared}/map-{uuid.uuid4().hex}"
    sinks.write_dependency_map(edges, folder)
    return edges.sparkSession.read.text(folder)


_on_extracts("dependency_map", _dependency_map, *_GRAPH)
_on_extracts("arch_insights", lambda e: crosslang.insights(e.counts()))
_on_extracts("recommendations", lambda e: crosslang.recommendations(e.counts(), e.edges()))
_on_extracts("polyglot_rows", crosslang.polyglot_rows)
_on_extracts("polyglot_report", crosslang.polyglot_report)


_on_files("ffi_marks", bridges.ffi_marks)


def _bridges(files: DataFrame) -> DataFrame:
    scanned = crosslang.scan(files, "endpoints", "routes")
    return bridges.network_bridges(crosslang.http_apis(scanned), crosslang.api_endpoints(scanned))


_on_files("network_bridges", _bridges)


def _bridge_edges(files: DataFrame) -> DataFrame:
    scanned = crosslang.scan(files, "endpoints", "routes")
    return bridges.bridge_edges(crosslang.http_apis(scanned), crosslang.api_endpoints(scanned))


_on_files("bridge_edges", _bridge_edges)
_on_facts("typed_graph", lambda files, facts: bridges.typed_graph(
    dependencies.internal_edges(files, facts), crosslang.Extracts(files, *_GRAPH).edges()))


@_query
def blast_radius(inputs: Inputs) -> DataFrame:
    files = inputs.files()
    edges = dependencies.internal_edges(files, pyfacts.python_facts(files))
    changed = jobs.changed_files(inputs.previous_files(), files)
    return bridges.blast_radius(edges, changed)


@_query
def impact(inputs: Inputs) -> DataFrame:
    files = inputs.files()
    scanned = crosslang.scan(files, "endpoints", "routes")
    edges = impacts.uses(
        dependencies.internal_edges(files, pyfacts.python_facts(files)),
        bridges.bridge_edges(crosslang.http_apis(scanned), crosslang.api_endpoints(scanned)),
        crosslang.shared_resources(files, crosslang.scan(files, "name_ends")),
    )
    return impacts.impact(edges, jobs.changed_files(inputs.previous_files(), files))


@_query
def route_matches(inputs: Inputs) -> DataFrame:
    scanned = crosslang.scan(inputs.route_files(), "endpoints", "routes")
    return routes.route_matches(crosslang.http_apis(scanned), crosslang.api_endpoints(scanned))


@_query
def symbol_edges(inputs: Inputs) -> DataFrame:
    return symbols.symbol_edges(inputs.symbol_files())


@_query
def module_cycles(inputs: Inputs) -> DataFrame:
    files = inputs.cycle_files()
    return dependencies.module_cycles(dependencies.internal_edges(files, pyfacts.python_facts(files)))


@_query
def schema_messages(inputs: Inputs) -> DataFrame:
    return schemas.messages(inputs.schema_files())


@_query
def schema_bindings(inputs: Inputs) -> DataFrame:
    return schemas.schema_bindings(inputs.schema_files())


# --------------------------------------------------------- catalogue and jobs


@_query
def repos_by_owner(inputs: Inputs) -> DataFrame:
    return jobs.repositories_by_owner(inputs.repositories())


@_query
def repos_of_user(inputs: Inputs) -> DataFrame:
    return jobs.repositories_of(inputs.repositories(), 7)


@_query
def recent_analyses(inputs: Inputs) -> DataFrame:
    found = jobs.recent_analyses(jobs.latest_state(inputs.job_events()), inputs.requests())
    return found.select(
        "job_id", "status", _stamp("started_at"), "repository_id", F.concat_ws(",", "languages").alias("languages")
    ).withColumn("languages", F.nullif(F.col("languages"), F.lit("")))


@_query
def job_summaries(inputs: Inputs) -> DataFrame:
    tasks = jobs.fan_out(inputs.requests()).filter("analyser <> 'polyglot'")
    files = inputs.files()
    # Each repository asked for stands for one of the corpus, by the number of that one.
    known = files.select("repo_id").distinct()
    # One row for each repository; a catalogue would have these numbers.
    numbered = known.select("repo_id", (F.row_number().over(Window.orderBy("repo_id")) - 1).alias("number"))
    tasks = (
        tasks.crossJoin(F.broadcast(known.agg(F.count("*").alias("repositories"))))
        .withColumn("number", F.col("repository_id") % F.col("repositories")).drop("repository_id")
        .join(numbered, "number").withColumnRenamed("repo_id", "repository_id")
    )
    counts = corpus.analysed_files(files).groupBy(F.col("repo_id").alias("repository_id"), "language").agg(
        F.count("*").alias("files")
    )
    found = jobs.job_summaries(jobs.latest_state(inputs.job_events()), tasks, counts)
    return found.select("job_id", _stamp("started_at"), _stamp("completed_at"), "language", "files_analyzed")


@_query
def owned_jobs(inputs: Inputs) -> DataFrame:
    lines = inputs.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_orderkey").alias("repository_id"),
    )
    asked = lines.select("user_id", "job_id")
    return jobs.owned_jobs(asked, lines.drop("user_id"), inputs.repositories())


@_query
def stored_results(inputs: Inputs) -> DataFrame:
    """The results of one job, written twice as by a job that ran again, and read back."""
    shared = shared_folder(inputs.spark)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = f"{shared}/results-{uuid.uuid4().hex}"
    for language in ("go", "java"):
        rows = sinks.file_results(stats.file_stats(inputs.files(), language), 7, "syntax_analysis")
        for _ in range(2):
            sinks.write_file_results(rows, folder)
    schema = "file_path string, results string, job_id long, analysis_type string, language string"
    return inputs.spark.read.schema(schema).parquet(folder)


@_query
def job_lookup(inputs: Inputs) -> DataFrame:
    found = jobs.job_status(jobs.latest_state(inputs.job_events()), 7)
    return found.select(
        "job_id", "status", F.col("progress").cast("long").alias("progress"), _stamp("started_at"), _stamp("completed_at")
    )


@_query
def job_latest(inputs: Inputs) -> DataFrame:
    return jobs.latest_state(inputs.job_events()).select(
        "job_id",
        "status",
        F.col("progress").cast("long").alias("progress"),
        "error_message",
        _stamp("started_at"),
        _stamp("completed_at"),
    )


@_query
def dashboard_totals(inputs: Inputs) -> DataFrame:
    return jobs.dashboard_totals(inputs.repositories(), jobs.latest_state(inputs.job_events()))


@_query
def recent_jobs(inputs: Inputs) -> DataFrame:
    return jobs.recent_jobs(jobs.latest_state(inputs.job_events())).select(
        "job_id", "status", F.col("progress").cast("long").alias("progress"), _stamp("started_at")
    )


@_query
def job_durations(inputs: Inputs) -> DataFrame:
    return jobs.job_durations(jobs.latest_state(inputs.job_events())).select("job_id", "seconds")


@_query
def job_fanout(inputs: Inputs) -> DataFrame:
    return jobs.fan_out(inputs.requests())


@_query
def jobs_per_window(inputs: Inputs) -> DataFrame:
    return jobs.jobs_per_window(inputs.job_events()).select(
        _stamp("window_start"), "status", "events"
    )


@_query
def changed_files(inputs: Inputs) -> DataFrame:
    return jobs.changed_files(inputs.previous_files(), inputs.files())


@_query
def file_changes(inputs: Inputs) -> DataFrame:
    return jobs.file_changes(inputs.previous_files(), inputs.files())


# ------------------------------------------------------------------ retrieval


def _vectors(inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """Questions with a vector, and the corpus of vectors."""
    vectors = inputs.table("embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("repository_id")
    )
    asked = inputs.table("benchmark").select(F.col("item_id").alias("id"))
    questions = vectors.join(asked, "id").withColumnRenamed("id", "query_id")
    return questions, vectors


def _hits(inputs: Inputs, k: int, filtered: bool) -> DataFrame:
    questions, vectors = _vectors(inputs)
    return _long("rank")(retrieval.top_k(questions, vectors, k, filtered))


@_query
def vector_topk(inputs: Inputs) -> DataFrame:
    return _hits(inputs, rules.PUBLIC_HITS, False).withColumn("distance", F.round("distance", 6))


@_query
def vector_topk_filtered(inputs: Inputs) -> DataFrame:
    return _hits(inputs, rules.CODE_HITS, True).withColumn("distance", F.round("distance", 6))


def _approximate(inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """Approximate and exact hits of every vector whose id is divisible by 100."""
    vectors = inputs.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = cells.build(vectors)
    probes = cells.probes_for(index, rules.PUBLIC_HITS)
    found = cells.approximate(index, asked, rules.PUBLIC_HITS, probes)
    return found, retrieval.top_k(asked, vectors, rules.PUBLIC_HITS)


@_query
def vector_ann(inputs: Inputs) -> DataFrame:
    return _long("rank")(_approximate(inputs)[0]).withColumn("distance", F.round("distance", 6))


@_query
def vector_ann_recall(inputs: Inputs) -> DataFrame:
    """What the index must keep: all queries answered in full, nine of ten true neighbours."""
    found, exact = _approximate(inputs)
    keys = ["query_id", "id"]
    both = exact.select(*keys, F.lit(1).alias("wanted")).join(found.select(*keys, F.lit(1).alias("hit")), keys, "full")
    return both.agg(
        F.countDistinct("query_id").alias("queries"),
        F.count("hit").alias("hits"),
        (F.count_if(F.expr("hit + wanted = 2")) >= F.lit(0.9) * F.count("wanted")).alias("recalled"),
    )


@_query
def rag_context(inputs: Inputs) -> DataFrame:
    public = _hits(inputs, rules.PUBLIC_HITS, False).withColumn("collection", F.lit(0))
    code = _hits(inputs, rules.CODE_HITS, True).withColumn("collection", F.lit(1))
    texts = inputs.table("documents").select(
        F.lit(0).alias("collection"), F.col("doc_id").alias("id"), "text"
    )
    results = inputs.table("embeddings").select(
        F.lit(1).alias("collection"),
        F.col("vec_id").alias("id"),
        F.concat(
            F.lit("Result "), F.col("vec_id").cast("string"),
            F.lit(" of repository "), F.col("label").cast("string"),
        ).alias("text"),
    )
    context = retrieval.context(public.unionByName(code), texts.unionByName(results))
    questions = inputs.table("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return retrieval.prompts(questions, context)


@_query
def rag_documents(inputs: Inputs) -> DataFrame:
    results = stats.lines_of_code(inputs.files()).select(
        "repo_id", "path", "language", F.concat(F.lit("loc="), "loc").alias("results")
    )
    meta = F.col("metadata")
    return retrieval.result_documents(results).select(
        "repo_id",
        "path",
        "text",
        meta["repository_id"].alias("meta_repository"),
        meta["language"].alias("meta_language"),
        meta["type"].alias("meta_type"),
    )


@_query
def rag_doc_ids(inputs: Inputs) -> DataFrame:
    keys = inputs.table("documents").select(F.col("doc_id").cast("string").alias("key"))
    numbered = retrieval.document_ids(keys, "public_docs", "key")
    return numbered.select(F.col("key").cast("long").alias("doc_id"), F.col("doc_id").alias("id"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
