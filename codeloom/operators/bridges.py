"""Links between languages beyond the report: native calls, routes, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.arrays import unnest
from codeloom.functions.text import contains_any, found
from codeloom.session import cut_lineage
from codeloom.sources.corpus import discovered_files


def ffi_marks(files: DataFrame) -> DataFrame:
    """Files with marks of a foreign-function interface: one row per rule."""
    text, language = F.col("content"), F.col("language")
    marks = F.array_compact(
        F.array(
            *[
                F.when(
                    language.isin(*languages) & contains_any(text, words) & found(text, pattern),
                    F.lit(rule_id),
                )
                for rule_id, languages, words, pattern in rules.FFI_RULES
            ]
        )
    )
    return unnest(discovered_files(files), ["repo_id", "path", "language"], marks, "rule_id")


def _route(text: Column) -> Column:
    """The path of a route or endpoint: no host, quotes, query or end slash."""
    path = F.regexp_replace(F.translate(text, "'\"`", ""), r"^[^/]*", "")
    return F.regexp_replace(path, r"[?#].*$|/+$", "")


def _route_files(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``repo_id, route, source_file, source_language, defines``, once per file.

    A route's own text also reads as an endpoint: a file is not a caller of what
    it defines.
    """
    defined = routes.select("repo_id", "source_file", "source_language", _route(F.col("route")).alias("route"), F.lit(True).alias("defines"))
    called = endpoints.select("repo_id", "source_file", "source_language", _route(F.col("endpoint")).alias("route"), F.lit(False).alias("defines"))
    return (
        defined.unionByName(called)
        .filter(F.col("route") != "")
        .groupBy("repo_id", "route", "source_file", "source_language")
        .agg(F.bool_or("defines").alias("defines"))
    )


def network_bridges(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Routes that one place defines and another one calls.

    One row per (repository, route) with the numbers of both; callers and
    definitions are counted, not paired, so a popular route costs no more than
    its rows.
    """
    defines = F.col("defines")
    return (
        _route_files(routes, endpoints).groupBy("repo_id", "route")
        .agg(
            F.count_if(defines).alias("definitions"),
            F.count_if(~defines).alias("callers"),
            F.size(F.collect_set("source_language")).cast("long").alias("languages"),
        )
        .filter("definitions > 0 AND callers > 0")
    )


def bridge_edges(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Edges from callers to routes and from routes to the files that define them.

    Two steps through the route say which file reaches which, in as many edges as
    there are marks; callers and definitions are not paired.
    """
    marks = _route_files(routes, endpoints)
    bridged = network_bridges(routes, endpoints).select("repo_id", "route")
    file = F.concat("source_language", F.lit(":"), "source_file")
    route, defines = F.concat(F.lit("route:"), "route"), F.col("defines")
    return marks.join(bridged, ["repo_id", "route"], "left_semi").select(
        "repo_id",
        F.when(defines, route).otherwise(file).alias("src"),
        F.when(defines, file).otherwise(route).alias("dst"),
        F.when(defines, "implements").otherwise("calls").alias("type"),
    )


def typed_graph(imports: DataFrame, cross: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Import edges between files, cross-language edges and, if given, the edges of
    ``symbols.symbol_edges`` as one edge table."""
    inner = imports.select(
        "repo_id",
        F.concat("source_language", F.lit(":"), "source_file").alias("src"),
        F.concat("target_language", F.lit(":"), "target_file").alias("dst"),
        F.col("dependency_type").alias("type"),
    )
    both = inner.unionByName(cross.select("repo_id", "src", "dst", "type"))
    return both if symbols is None else both.unionByName(symbols.select("repo_id", "src", "dst", "type"))


def blast_radius(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files that depend, directly or not, on the seeds, with the shortest distance.

    ``edges``: ``repo_id, source_file, target_file``; ``seeds``: ``repo_id, path``.
    Breadth first: a step joins only the files found last.  The files found so far
    are one checkpoint that each step replaces, so the plan has the same few scans
    at any depth.
    Every file is found once, which also ends cycles.
    """
    users = cut_lineage(
        edges.select("repo_id", F.col("target_file").alias("path"), F.col("source_file").alias("user"))
    )
    last = cut_lineage(seeds.select("repo_id", "path").distinct().withColumn("distance", F.lit(0).cast("long")))
    reached = last
    while not last.isEmpty():
        step = (
            last.join(users, ["repo_id", "path"])
            .select("repo_id", F.col("user").alias("path"), F.col("distance") + 1)
            .toDF("repo_id", "path", "distance")
            .distinct()
            .join(reached.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        )
        last = cut_lineage(step)
        reached = cut_lineage(reached.unionByName(last))
    return reached
