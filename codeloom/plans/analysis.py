"""The five analyses of a language, and whole jobs, as named tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.operators import (
    architecture,
    complexity,
    crosslang,
    dependencies,
    jobs,
    pyfacts,
    security,
    stats,
)
from codeloom.sources import manifests

Tables = dict[str, DataFrame]
#: Stores a table that several results are made of, under a name, and reads it back.
Keep = Callable[[DataFrame, str], DataFrame]


def _syntax(files: DataFrame, facts: DataFrame, language: str, keep: Keep, errors: DataFrame | None) -> Tables:
    if language == "python":
        return {
            "file_stats": pyfacts.file_stats(files, facts),
            "declarations": pyfacts.declarations(facts),
            "errors": pyfacts.errors(facts),
            "valid_files": pyfacts.parsed_files(facts),
        }
    tables = {
        "file_stats": stats.file_stats(files, language),
        "declarations": stats.declarations(files, language),
    }
    if errors is not None:
        of_language = F.col("tool").isin(*_TOOLS[language])
        tables["errors"] = errors.filter(of_language)
        valid = stats.valid_files(files, errors, facts)
        tables["valid_files"] = valid.filter(F.col("language") == language)
    return tables


#: Build tools of each language, as build logs name them.
_TOOLS = {
    "javascript": ("tsc",), "csharp": ("dotnet",), "java": ("maven", "gradle"), "go": ("go build", "go vet"),
}


def _dependencies(files: DataFrame, facts: DataFrame, language: str, *_: object) -> Tables:
    if language == "python":
        return {
            "imports": pyfacts.import_edges(facts),
            "module_map": dependencies.module_map(files),
            "internal_edges": dependencies.internal_edges(files, facts),
        }
    sources = {
        "javascript": [manifests.npm_packages],
        "csharp": [manifests.nuget_packages],
        "java": [manifests.maven_packages, manifests.gradle_packages],
        "go": [manifests.go_modules],
    }[language]
    found = sources[0](files)
    for source in sources[1:]:
        found = found.unionByName(source(files))
    return {
        "imports": dependencies.pattern_import_edges(files, language),
        "packages": found.select("repo_id", "language", "package").distinct(),
    }


def _complexity(files: DataFrame, facts: DataFrame, language: str, keep: Keep, *_: object) -> Tables:
    if language == "python":
        functions, totals = pyfacts.function_complexity(facts), pyfacts.file_complexity(facts)
    else:
        scored = keep(complexity.scored_files(files, language), "scored")
        functions, totals = complexity.scored_functions(scored), complexity.scored_totals(scored)
    return {
        "functions": functions,
        "file_complexity": totals,
        "high_complexity": complexity.high_complexity(functions),
    }


def _security(files: DataFrame, facts: DataFrame, language: str, *_: object) -> Tables:
    if language == "python":
        return {"findings": pyfacts.dangerous_calls(facts)}
    return {"findings": security.pattern_findings(files, language)}


def _architecture(files: DataFrame, facts: DataFrame, language: str, *_: object) -> Tables:
    folders = architecture.package_structure(files)
    return {
        "python": lambda: {
            "package_structure": folders.filter("language = 'python'"),
            "mvc": architecture.mvc_by_name(files),
        },
        "javascript": lambda: {
            "file_structure": folders.filter("language = 'javascript'"),
            "stack": architecture.js_stack(files),
            "module_system": architecture.js_module_system(files),
        },
        "csharp": lambda: {
            "namespaces": architecture.csharp_namespaces(files),
            "patterns": architecture.csharp_arch(files),
        },
        "java": lambda: {
            "packages": architecture.java_packages(files),
            "features": architecture.java_arch(files),
        },
        "go": lambda: {
            "packages": architecture.go_packages(files),
            "indicators": architecture.go_arch(files),
        },
    }[language]()


_ANALYSES = dict(
    zip(rules.ANALYSIS_TYPES, (_syntax, _dependencies, _complexity, _security, _architecture))
)


def analyse(
    files: DataFrame,
    language: str,
    analysis_types: Iterable[str],
    build_errors: DataFrame | None = None,
    keep: Keep = lambda table, _: table,
) -> dict[str, Tables]:
    """Tables of each requested analysis of one language; unknown types give none.

    ``build_errors`` (``sources.logs.build_errors``) adds errors and valid files of
    compiled languages.  ``keep`` may store the facts of the Python files and the
    scored functions of the others, which several tables read.
    """
    facts = pyfacts.python_facts(files)
    if language == "python":
        facts = keep(facts, "facts")
    return {
        name: _ANALYSES[name](files, facts, language, keep, build_errors)
        for name in analysis_types
        if name in _ANALYSES
    }


def cross_language(files: DataFrame) -> Tables:
    """All tables of the cross-language analysis, for repositories of two languages or more."""
    extracts = crosslang.Extracts(files)
    edges, counts = extracts.edges(), extracts.counts()
    several = extracts.multi_language()

    def of_several(table: DataFrame) -> DataFrame:
        return table.join(several, "repo_id", "left_semi")

    return {
        "report": crosslang.polyglot_report(extracts),
        "dependencies": crosslang.polyglot_rows(extracts),
        "http_apis": of_several(crosslang.http_apis(extracts.scanned)),
        "message_queues": of_several(crosslang.mq_usage(extracts.scanned)),
        "build_dependencies": of_several(crosslang.build_deps(files, extracts.present)),
        "edges": edges,
        "metrics": crosslang.graph_metrics(edges),
        "hotspots": crosslang.hotspots(edges),
        "insights": crosslang.insights(counts),
        "recommendations": crosslang.recommendations(counts, edges),
    }


def run_request(
    files: DataFrame,
    languages: list[str],
    analysis_types: list[str],
    folder: str,
    build_errors: DataFrame | None = None,
) -> list[str]:
    """Run one request over a corpus and store every table as Parquet.

    A file is parsed once: the facts and scored functions that several tables are
    made of are stored first, under ``kept``.

    Languages are given as users write them; asking for more than one also runs
    the cross-language analysis.  Returns the folders written.
    """
    spark = files.sparkSession
    request = spark.createDataFrame(
        [(0, 0, languages)], "job_id long, repository_id long, languages array<string>"
    )
    written = []
    for task in jobs.fan_out(request).collect():  # at most six rows
        if task["analyser"] == "polyglot":
            results = {"cross_language": cross_language(files)}
        else:
            kept = f"{folder.rstrip('/')}/kept/{task['analyser']}"

            def keep(table: DataFrame, name: str, kept: str = kept) -> DataFrame:
                table.write.mode("overwrite").parquet(f"{kept}/{name}")
                return spark.read.schema(table.schema).parquet(f"{kept}/{name}")

            results = analyse(files, task["analyser"], analysis_types, build_errors, keep)
        for analysis, tables in results.items():
            for name, table in tables.items():
                target = f"{folder.rstrip('/')}/{task['analyser']}/{analysis}/{name}"
                table.write.mode("overwrite").parquet(target)
                written.append(target)
    return written
