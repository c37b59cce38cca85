"""Import edges, module map, resolved file-to-file edges, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.text import find_all
from codeloom.operators import graphs, pyfacts, stats
from codeloom.sources.corpus import analysed_files, by_language, language_files
from codeloom.sources.manifests import package_inventory


def _targets(language: str) -> Column:
    text = F.col("content")
    names = {
        "javascript": stats.js_import_names,
        "csharp": lambda: find_all(text, rules.CSHARP_USING, 1),
        "java": lambda: find_all(text, rules.JAVA_IMPORT, 1),
        "go": stats.go_import_names,
    }[language]()
    return F.array_distinct(names)


# Languages whose graph also lists files without any import (target is null).
_KEEPS_EMPTY = ("javascript", "java")


def pattern_import_edges(files: DataFrame, *languages: str) -> DataFrame:
    """Distinct imports per file of the pattern-based languages.

    A file is one row, so "distinct per file" is an array operation and needs
    no shuffle.
    """

    wanted = languages or stats.PATTERN_LANGUAGES
    targets = by_language({name: _targets(name) for name in wanted})
    target, language = F.col("target"), F.col("language")
    return (
        analysed_files(files, *wanted)
        .select("repo_id", "path", "language", F.explode_outer(targets).alias("target"))
        .filter(target.isNotNull() | language.isin(*_KEEPS_EMPTY))
    )


def import_edges(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Import graph of all five languages."""
    return pattern_import_edges(files).unionByName(pyfacts.import_edges(facts))


def dependency_totals(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Import edges and distinct external packages per repository and language."""
    edges = (
        import_edges(files, facts)
        .groupBy("repo_id", "language")
        .agg(F.count("target").alias("total_dependencies"))
    )
    packages = (
        package_inventory(files)
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("total_packages"))
    )
    return edges.join(packages, ["repo_id", "language"], "full").na.fill(
        0, ["total_dependencies", "total_packages"]
    )


def module_map(files: DataFrame, strict: bool = False) -> DataFrame:
    """Python module name of each file.

    Every ``.py`` in the path is dropped, so ``src/pylib/x.py`` (dotted:
    ``src.pylib.x.py``) becomes ``srclib.x``; ``strict`` drops the suffix only.
    """
    dotted = F.replace("path", F.lit("/"), F.lit("."))
    module = (
        F.regexp_replace(dotted, r"\.py$", "")
        if strict
        else F.replace(dotted, F.lit(".py"), F.lit(""))
    )
    return language_files(files, "python", readable_only=False).select(
        "repo_id", "path", module.alias("module")
    )


def internal_edges(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Imports resolved to files of the same repository.

    A popular module makes a hot join key on the import side only; the module
    side holds one row per file, so AQE can split the hot partition freely.
    """
    modules = module_map(files).select(
        "repo_id", F.col("module").alias("target"), F.col("path").alias("target_file")
    )
    return (
        pyfacts.import_edges(facts)
        .join(modules, ["repo_id", "target"])
        .select(
            "repo_id",
            F.col("path").alias("source_file"),
            F.col("language").alias("source_language"),
            "target_file",
            F.lit("python").alias("target_language"),
            F.lit("import").alias("dependency_type"),
        )
    )


def module_cycles(edges: DataFrame) -> DataFrame:
    """``repo_id, path, component, members`` of the files that import each other in a
    circle: ``component`` is the first path of the circle, ``members`` its size."""

    def node(name: str) -> Column:
        return F.concat_ws(":", F.col("repo_id").cast("string"), name)

    found = graphs.strong_components(edges.select(node("source_file").alias("a"), node("target_file").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))

    def path(name: str) -> Column:
        return F.regexp_extract(name, r"^-?\d+:((?s).*)$", 1)

    return found.join(sizes, "component").select(
        F.substring_index("node", ":", 1).cast("long").alias("repo_id"), path("node").alias("path"),
        path("component").alias("component"), "members",
    )


def top_imports(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most imported targets of each language; ties by name."""
    counts = (
        edges.filter(F.col("target").isNotNull())
        .groupBy("language", "target")
        .agg(F.count("*").alias("importers"))
    )
    best = Window.partitionBy("language").orderBy(F.desc("importers"), "target")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
