"""Cross-language analysis: endpoints, shared resources, graph, insights.

The text of a file is looked at once: :func:`scan` turns each source file of the
ten languages into one narrow row of arrays, and everything else starts there.
The reports use that table several times, so they cut the lineage behind it
(:class:`Extracts`) instead of reading the corpus again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.arrays import let, unnest, unnest_structs
from codeloom.functions.text import (
    basename,
    contains_any,
    ends_with_any,
    find_all_with,
    folded,
    found,
    lines,
    may_match,
    strip,
)
from codeloom.session import cut_lineage
from codeloom.sources.corpus import discovered_files

_TAIL = 4  # characters before the suffix that make the key of a name
_NAME_PARTS = 64  # parts into which the names of one key are dealt


def _text() -> Column:
    return F.col("content")


def _find(pattern: rules.Pattern, group: int = 0) -> Column:
    return find_all_with(F.col("low"), _text(), pattern, group)


# ------------------------------------------------- per-file arrays (one pass)


def _endpoints() -> Column:
    """Endpoint matches without quotes at their ends (backticks stay)."""
    matches = F.concat(*[_find(p) for p in rules.ENDPOINT_PATTERNS])
    return F.transform(matches, lambda m: F.btrim(m, F.lit("'\"")))


def _configs() -> Column:
    """Configuration matches with the first line on which their pattern matches.

    The line is found once per (file, pattern), and only if the file has a
    match; it is empty when a match runs over a line end.
    """

    def of(config_type: str, pattern: rules.Pattern) -> Column:
        first = F.get(F.filter(lines(_text()), lambda l: found(l, pattern)), F.lit(0))
        line = F.coalesce(strip(first), F.lit(""))

        def rows(matched: Column) -> Column:
            return let(
                F.when(F.size(matched) > 0, line),
                lambda context: F.transform(
                    matched,
                    lambda value: F.struct(
                        F.lit(config_type).alias("config_type"),
                        value.alias("config_value"),
                        context.alias("line_context"),
                    ),
                ),
            )

        return let(_find(pattern, 1), rows)

    return F.concat(*[of(*entry) for entry in rules.CONFIG_PATTERNS])


def _routes() -> Column:
    """Route marks; ``method`` is null unless the pattern names it."""

    def of(number: int, pattern: rules.Pattern, method: int | None, path: int) -> Column:
        def mark(route: Column, verb: Column) -> Column:
            return F.struct(
                F.lit(number).cast("long").alias("pattern_id"),
                verb.cast("string").alias("method"),
                route.alias("route"),
            )

        paths = _find(pattern, path)
        if method is None:
            return F.transform(paths, lambda p: mark(p, F.lit(None)))
        return F.zip_with(paths, _find(pattern, method), mark)

    return F.concat(*[of(i, *entry) for i, entry in enumerate(rules.HTTP_PATTERNS, 1)])


def _queues() -> Column:
    """The queue patterns that occur."""
    low = F.col("low")
    seen = [may_match(low, p) & found(_text(), p) for p in rules.QUEUE_PATTERNS]
    return F.array_compact(
        F.array(*[F.when(s, F.lit(p.text)) for s, p in zip(seen, rules.QUEUE_PATTERNS)])
    )


def _name_ends() -> Column:
    """The distinct ends of possible configuration names: each suffix that occurs,
    with up to ``_TAIL`` characters before it.  A dozen characters each."""
    suffix = "|".join(s.replace(".", r"\.") for s in rules.CONFIG_SUFFIXES)
    place = f"(?s)(?<=(.{{{_TAIL}}}|^.{{0,{_TAIL - 1}}}))({suffix})"
    ends = F.zip_with(
        F.regexp_extract_all(_text(), F.lit(place), 1), F.regexp_extract_all(_text(), F.lit(place), 2),
        lambda before, suffix: F.concat(before, suffix),
    )
    none = F.array().cast("array<string>")
    return F.when(contains_any(_text(), rules.CONFIG_SUFFIXES), F.array_distinct(ends)).otherwise(none)


_SCANS = {
    "endpoints": _endpoints,
    "configs": _configs,
    "routes": _routes,
    "queues": _queues,
    "name_ends": _name_ends,
}


GRAPH_SCANS = ("endpoints", "name_ends")


def scan(files: DataFrame, *wanted: str) -> DataFrame:
    """One row per source file with the wanted arrays (default: all)."""
    columns = [_SCANS[name]().alias(name) for name in wanted or _SCANS]
    return _with_low(files).select("repo_id", "path", "language", *columns)


def _with_low(files: DataFrame) -> DataFrame:
    """Source files with their folded text, made once for all patterns."""
    return discovered_files(files).select(
        "repo_id", "path", "language", "content", folded(_text()).alias("low")
    )


# ------------------------------------------------------------ exploded facts


def _sources() -> list[Column | str]:
    return ["repo_id", F.col("path").alias("source_file"), F.col("language").alias("source_language")]


def api_endpoints(scanned: DataFrame) -> DataFrame:
    return unnest(scanned, _sources(), "endpoints", "endpoint")


def config_deps(scanned: DataFrame) -> DataFrame:
    return unnest_structs(scanned, _sources(), "configs", "config_type")


def http_apis(scanned: DataFrame) -> DataFrame:
    return unnest_structs(scanned, _sources(), "routes", "pattern_id")


def mq_usage(scanned: DataFrame) -> DataFrame:
    """Which queue patterns occur in the sources of a repository."""
    return unnest(scanned, ["repo_id"], "queues", "pattern").distinct()


def comm_catalogue(files: DataFrame) -> DataFrame:
    """Matches of the communication catalogue, counted per family and pattern."""

    def entry(family: str, pattern: rules.Pattern) -> Column:
        return F.struct(
            F.lit(family).alias("family"),
            F.lit(pattern.text).alias("pattern"),
            F.size(_find(pattern)).cast("long").alias("n"),
        )

    counted = [
        entry(family, pattern)
        for family, patterns in rules.COMMUNICATION_CATALOGUE.items()
        for pattern in patterns
    ]
    hits = F.filter(F.array(*counted), lambda e: e["n"] > 0)
    return (
        unnest_structs(_with_low(files), ["repo_id", "language"], hits, "family")
        .groupBy("repo_id", "language", "family", "pattern")
        .agg(F.sum("n").alias("matches"), F.count("*").alias("files"))
    )


# ---------------------------------------------------------- shared resources


def _suffix_of(text: Column) -> Column:
    chosen = F.lit("")
    for suffix in rules.CONFIG_SUFFIXES:
        chosen = F.when(text.endswith(suffix), suffix).otherwise(chosen)
    return chosen


def _tail(text: Column, stem_part: int) -> Column:
    """The suffix and up to ``stem_part`` characters before it."""
    return F.right(text, F.char_length(_suffix_of(text)) + stem_part)


def shared_resources(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Configuration files whose name occurs in sources of two languages or more.

    Rows ``repo_id, resource_path, language``.  "The name is a substring of the
    text" is a theta join.  A name ends in a known suffix, so:

    1. The key of a name is its suffix and up to four characters before it.  The
       keys of a text are the ends that the scan found in it, each also cut to
       fewer characters, as a name may be shorter.
    2. Keys of texts and names are joined by repository.  What is left is a file
       with the names, of any length, that it may hold.
    3. These files' texts are read again and searched for the names, dealt in
       parts, so that no row grows with the number of names of a repository.

    Only keys, names and the texts of files with a known key are moved.
    """
    suffixes = rules.CONFIG_SUFFIXES
    configs = files.filter(ends_with_any(F.col("path"), suffixes)).select(
        "repo_id", F.col("path").alias("resource_path"), basename(F.col("path")).alias("name")
    )
    named = configs.select("repo_id", "name").distinct()
    part = F.pmod(F.xxhash64("name"), F.lit(_NAME_PARTS)).alias("part")
    names = (
        named.select("repo_id", _tail(F.col("name"), _TAIL).alias("key"), "name", part)
        .groupBy("repo_id", "key", "part").agg(F.collect_list("name").alias("names"))
    )
    ends = unnest(scanned, ["repo_id", "path", "language"], "name_ends", "end")
    shorter = F.array_distinct(F.array(*[_tail(F.col("end"), n) for n in range(_TAIL + 1)]))
    keys = unnest(ends, ["repo_id", "path", "language"], shorter, "key").distinct()
    tried = keys.join(names, ["repo_id", "key"]).select("repo_id", "path", "language", "part", "names")
    per_file = tried.groupBy("repo_id", "path", "language", "part").agg(
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")
    )
    texts = discovered_files(files).select("repo_id", "path", "content")
    held = F.filter("names", lambda n: F.contains(F.col("content"), n))
    searched = per_file.join(texts, ["repo_id", "path"]).select("repo_id", "language", held.alias("found"))
    by_name = (
        unnest(searched, ["repo_id", "language"], "found", "name").distinct()
        .groupBy("repo_id", "name").agg(F.collect_set("language").alias("languages"))
    )
    return (
        configs.join(by_name.filter(F.size("languages") > 1), ["repo_id", "name"])
        .select("repo_id", "resource_path", F.explode("languages").alias("language"))
    )


# -------------------------------------------------------------- build systems


def build_files(files: DataFrame) -> DataFrame:
    """Build files anywhere in the tree, by exact name."""
    name = basename(F.col("path"))
    system = F.lit(None).cast("string")
    for title, names in reversed(rules.BUILD_FILES.items()):
        system = F.when(name.isin(*names), title).otherwise(system)
    return files.select(
        "repo_id", F.col("path").alias("build_file"), system.alias("build_system")
    ).filter(F.col("build_system").isNotNull())


def languages_present(sources: DataFrame) -> DataFrame:
    """Languages of each repository, at most ten names per row, and its files."""
    return sources.groupBy("repo_id").agg(
        F.collect_set("language").alias("present"), F.count("*").alias("total_files")
    )


def build_deps(files: DataFrame, present: DataFrame) -> DataFrame:
    """Build files and the languages present that their system affects;
    ``language`` is null for a build file that affects none of them."""
    everything = tuple(rules.DISCOVERY_SUFFIXES)
    affected = F.lit(None).cast("array<string>")
    for title, names in rules.BUILD_LANGUAGES.items():
        listed = F.array(*[F.lit(n) for n in (names or everything)])
        affected = F.when(F.col("build_system") == title, listed).otherwise(affected)
    here = F.coalesce(F.col("present"), F.array().cast("array<string>"))
    return build_files(files).join(present, "repo_id", "left").select(
        "repo_id",
        "build_system",
        "build_file",
        F.explode_outer(F.array_intersect(affected, here)).alias("language"),
    )


# --------------------------------------------------------------------- graph


def graph_edges(endpoints: DataFrame, resources: DataFrame) -> DataFrame:
    """Distinct edges ``repo_id, src, dst, type``; files of one name merge."""
    calls = endpoints.select(
        "repo_id",
        F.concat("source_language", F.lit(":"), basename(F.col("source_file"))).alias("src"),
        F.concat(F.lit("api:"), F.col("endpoint")).alias("dst"),
        F.lit("api_call").alias("type"),
    )
    shared = resources.select(
        "repo_id",
        F.concat("language", F.lit(":component")).alias("src"),
        F.concat(F.lit("resource:"), basename(F.col("resource_path"))).alias("dst"),
        F.lit("shared_resource").alias("type"),
    )
    return calls.unionByName(shared).distinct()


def node_degrees(edges: DataFrame) -> DataFrame:
    """Degree (in + out) of every node; one row per node."""
    return (
        edges.select("repo_id", F.explode(F.array("src", "dst")).alias("node"))
        .groupBy("repo_id", "node")
        .agg(F.count("*").alias("degree"))
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    return node_degrees(edges).select("repo_id", "node")


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and strongly connected components.

    Every edge leads from a language node to an endpoint or resource node, so
    the graph has no cycle and each node is a component of its own.  The degrees
    of a repository add up to twice its edges: one aggregation gives all.
    """
    return (
        node_degrees(edges)
        .groupBy("repo_id")
        .agg(*_graph_sizes())
        .select(
            "*",
            _density().alias("density"),
            F.col("total_nodes").alias("strongly_connected_components"),
        )
    )


def _graph_sizes() -> list[Column]:
    return [
        F.count("*").alias("total_nodes"),
        (F.sum("degree") / 2).cast("long").alias("total_edges"),
    ]


def _density() -> Column:
    nodes = F.col("total_nodes")
    return F.when(nodes <= 1, 0.0).otherwise(F.col("total_edges") / (nodes * (nodes - 1)))


def hotspots(edges: DataFrame) -> DataFrame:
    degree = F.col("degree")
    return (
        node_degrees(edges)
        .filter(degree > rules.HOTSPOT_DEGREE)
        .select(
            "repo_id",
            F.col("node").alias("component"),
            F.lit("high_connectivity").alias("issue_type"),
            "degree",
            F.when(degree > rules.HOTSPOT_HIGH_DEGREE, "high").otherwise("medium").alias("severity"),
            F.format_string(
                "Component %s has %d connections, indicating potential architectural bottleneck",
                "node",
                "degree",
            ).alias("description"),
        )
    )


# ------------------------------------------------------------------ insights


class Extracts:
    """The extraction tables of one corpus, as used by the reports below.

    One pass over the text; the narrow result is checkpointed, because several
    branches read it, and so are the few shared resources.  The graph alone needs
    only ``GRAPH_SCANS``.  Names of configuration and build files come from the
    path column alone.
    """

    def __init__(self, files: DataFrame, *wanted: str) -> None:
        self.files = files
        self.scanned = cut_lineage(scan(files, *wanted))
        self.present = languages_present(self.scanned)
        self.endpoints = api_endpoints(self.scanned)
        self.resources = cut_lineage(shared_resources(files, self.scanned))

    def multi_language(self) -> DataFrame:
        return self.present.filter(F.size("present") > 1).select("repo_id")

    def edges(self) -> DataFrame:
        """Graph of the repositories with two languages or more."""
        found_edges = graph_edges(self.endpoints, self.resources)
        return found_edges.join(self.multi_language(), "repo_id", "left_semi")

    def counts(self) -> DataFrame:
        """Sizes of all lists, one row per discovered repository.

        Sizes are added up from the arrays in one aggregation; only
        (repository, number) rows are joined.
        """
        lists = self.scanned.groupBy("repo_id").agg(
            F.size(F.collect_set("language")).cast("long").alias("languages"),
            F.count("*").alias("total_files"),
            F.sum(F.size("endpoints")).alias("api_dependencies"),
            F.sum(F.size("configs")).alias("configuration_dependencies"),
            F.sum(F.size("routes")).alias("http_apis"),
            reduce(
                Column.__add__,
                [
                    F.max(F.array_contains("queues", p.text).cast("long"))
                    for p in rules.QUEUE_PATTERNS
                ],
            ).alias("message_queues"),
        )
        shared = (
            self.resources.select("repo_id", "resource_path")
            .distinct()
            .groupBy("repo_id")
            .agg(F.count("*").alias("shared_resources"))
        )
        builds = (
            build_files(self.files)
            .groupBy("repo_id")
            .agg(F.count("*").alias("build_dependencies"))
        )
        return (
            lists.join(shared, "repo_id", "left")
            .join(builds, "repo_id", "left")
            .na.fill(0, ["shared_resources", "build_dependencies"])
        )


def insights(counts: DataFrame) -> DataFrame:
    """Style, coupling, communication complexity and maintainability.

    Repositories of fewer than two languages get none.
    """
    languages = F.col("languages")
    style = (
        F.when(languages > rules.MICROSERVICES_ABOVE, "microservices")
        .when(languages == rules.HYBRID_LANGUAGES, "hybrid")
        .otherwise("monolithic")
    )
    links = F.col("cross_dependencies")
    coupling = (
        F.when(links == 0, "loose")
        .when(links / F.col("total_files") < rules.MODERATE_COUPLING_BELOW, "moderate")
        .otherwise("tight")
    )
    talk = F.col("communication_marks")
    communication = (
        F.when(talk > rules.COMMUNICATION_HIGH_ABOVE, "high")
        .when(talk > rules.COMMUNICATION_MEDIUM_ABOVE, "medium")
        .otherwise("low")
    )

    def points(column: str, table: dict[str, int]) -> Column:
        worth = F.lit(0)
        for level, value in table.items():
            worth = F.when(F.col(column) == level, value).otherwise(worth)
        return worth

    loose_services = (F.col("architecture_style") == "microservices") & (
        F.col("coupling_level") == "loose"
    )
    score = (
        F.lit(rules.SCORE_BASE)
        + points("coupling_level", rules.SCORE_COUPLING)
        + points("communication_complexity", rules.SCORE_COMMUNICATION)
        + F.when(loose_services, rules.SCORE_LOOSE_MICROSERVICES).otherwise(0)
    )
    return (
        counts.filter(languages >= 2)
        .withColumn(
            "cross_dependencies",
            F.col("api_dependencies")
            + F.col("shared_resources")
            + F.col("configuration_dependencies")
            + F.col("build_dependencies"),
        )
        .withColumn("communication_marks", F.col("http_apis") + F.col("message_queues"))
        .withColumn("architecture_style", style)
        .withColumn("coupling_level", coupling)
        .withColumn("communication_complexity", communication)
        .withColumn(
            "maintainability_score",
            F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("long"),
        )
        .select(
            "repo_id",
            "languages",
            "total_files",
            "cross_dependencies",
            "communication_marks",
            "architecture_style",
            "coupling_level",
            "communication_complexity",
            "maintainability_score",
        )
    )


def _general_advice() -> list[tuple[int, Column, str]]:
    """``(place, condition, advice)`` on the columns of :func:`insights`."""
    advice = rules.RECOMMENDATIONS
    tight = F.col("coupling_level") == "tight"
    chatty = F.col("communication_complexity") == "high"
    weak = F.col("maintainability_score") < rules.LOW_MAINTAINABILITY
    monolith = (F.col("architecture_style") == "monolithic") & (F.col("languages") > 2)
    return [
        (1, tight, advice["tight_interfaces"]),
        (2, tight, advice["tight_events"]),
        (3, monolith, advice["monolith"]),
        (5, chatty, advice["chatty_versioning"]),
        (6, chatty, advice["chatty_gateway"]),
        (7, weak, advice["low_refactor"]),
        (8, weak, advice["low_testing"]),
    ]


def recommendations(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Advice rows ``repo_id, ord, component, recommendation``, ordered by
    ``ord`` and, among hotspots (4), by component."""
    advice = rules.RECOMMENDATIONS
    entries = [
        F.when(
            test,
            F.struct(F.lit(order).cast("long").alias("ord"), F.lit(text).alias("recommendation")),
        )
        for order, test, text in _general_advice()
    ]
    no_component = F.lit("").alias("component")
    general = (
        insights(counts)
        .select("repo_id", F.inline(F.array_compact(F.array(*entries))))
        .select("repo_id", "ord", no_component, "recommendation")
    )
    single = counts.filter("languages < 2").select(
        "repo_id",
        F.lit(0).cast("long").alias("ord"),
        no_component,
        F.lit(rules.SINGLE_LANGUAGE_MESSAGE).alias("recommendation"),
    )
    refactor = (
        hotspots(edges)
        .filter("severity = 'high'")
        .join(counts.filter("languages >= 2").select("repo_id"), "repo_id", "left_semi")
        .select(
            "repo_id",
            F.lit(4).cast("long").alias("ord"),
            "component",
            F.concat(
                F.lit(advice["hotspot_prefix"]), "component", F.lit(advice["hotspot_suffix"])
            ).alias("recommendation"),
        )
    )
    return general.unionByName(single).unionByName(refactor)


def polyglot_rows(extracts: Extracts) -> DataFrame:
    """Rows as stored: endpoints, shared resources per language, configuration.

    ``metadata`` is the whole record as JSON; the target columns of the stored
    table are never known to these analyses.  Build dependencies are not stored.
    """

    def shaped(rows: DataFrame, file: str, language: str, kind: str, record: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(
            "repo_id",
            F.col(file).alias("source_file"),
            F.col(language).alias("source_language"),
            none.alias("target_file"),
            none.alias("target_language"),
            F.lit(kind).alias("dependency_type"),
            F.to_json(record).alias("metadata"),
        )

    source = ["source_file", "source_language"]
    # As many languages as there are at most; one row for each resource.
    languages = extracts.resources.groupBy("repo_id", "resource_path").agg(
        F.array_sort(F.collect_set("language")).alias("referring_languages")
    )
    resources = extracts.resources.join(languages, ["repo_id", "resource_path"])
    parts = [
        shaped(extracts.endpoints, *source, "api_call",
               F.struct(*source, "endpoint", F.lit("api_call").alias("type"))),
        shaped(resources, "resource_path", "language", "shared_resource",
               F.struct("resource_path", F.lit("configuration").alias("resource_type"),
                        "referring_languages", F.lit(True).alias("cross_language_usage"))),
        shaped(config_deps(extracts.scanned), *source, "configuration",
               F.struct(*source, "config_type", "config_value", "line_context")),
    ]
    stored = reduce(DataFrame.unionByName, parts)
    return stored.join(extracts.multi_language(), "repo_id", "left_semi")


def polyglot_report(extracts: Extracts) -> DataFrame:
    """One row per repository: list sizes, graph metrics, insights, advice.

    Repositories of one language have only their counts and one recommendation.
    """
    degree = F.col("degree")
    graph = (
        node_degrees(extracts.edges())
        .groupBy("repo_id")
        .agg(
            *_graph_sizes(),
            F.count_if(degree > rules.HOTSPOT_DEGREE).alias("hotspots"),
            F.count_if(degree > rules.HOTSPOT_HIGH_DEGREE).alias("high_hotspots"),
        )
    )
    counts = extracts.counts()
    derived = insights(counts).drop("languages", "total_files")
    joined = counts.join(derived, "repo_id", "left").join(graph, "repo_id", "left")
    several = F.col("languages") > 1

    def for_several(name: str, value: Column) -> Column:
        return F.when(several, value).alias(name)

    graph_counts = ["total_nodes", "total_edges", "hotspots", "high_hotspots"]
    lists = ["api_dependencies", "shared_resources", "configuration_dependencies",
             "build_dependencies", "http_apis", "message_queues"]
    general = [F.when(test, 1).otherwise(0) for _, test, _ in _general_advice()]
    return (
        joined.na.fill(0, graph_counts)
        .withColumn("recommendations", reduce(Column.__add__, general) + F.col("high_hotspots"))
        .select(
            "repo_id",
            "languages",
            "total_files",
            *[for_several(n, F.col(n)) for n in lists + graph_counts],
            for_several("strongly_connected_components", F.col("total_nodes")),
            for_several("density", F.round(_density(), 6)),
            "architecture_style",
            "coupling_level",
            "communication_complexity",
            "maintainability_score",
            F.when(several, F.col("recommendations")).otherwise(1).alias("recommendations"),
        )
    )
