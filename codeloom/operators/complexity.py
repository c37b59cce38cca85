"""Cyclomatic complexity of brace languages, and roll-ups for all five."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.arrays import unnest_structs
from codeloom.functions.braces import bodies, brace_chunks, brace_partners, headers
from codeloom.functions.text import count_matches
from codeloom.operators import pyfacts
from codeloom.sources.corpus import analysed_files, by_language

_KEYS = ("repo_id", "path", "language")
BRACE_LANGUAGES = ("javascript", "csharp", "java", "go")


def decision_count(text: Column, language: str) -> Column:
    """1 + the number of decision marks in a body."""
    counts = [count_matches(text, p) for p in rules.DECISIONS[language]]
    return (F.lit(1) + reduce(Column.__add__, counts)).cast("long")


def _headers(language: str) -> Column:
    """``name, fn_type, nr`` of each function header; ``nr`` is its brace."""
    found = [headers("content", *header) for header in rules.FUNCTION_HEADERS[language]]
    return F.concat(*found) if len(found) > 1 else found[0]


def _with_bodies(files: DataFrame, *languages: str) -> DataFrame:
    """Files with ``functions``: name, type and body of each function.

    All of it is a narrow projection of the file row; see
    :mod:`codeloom.functions.braces`.  The steps are separate selects only to
    name the arrays once.
    """
    found = by_language({name: _headers(name) for name in languages})
    # No filter on ``headers`` here: it would be pushed below the projection and
    # run the patterns twice.
    text = F.when(F.size("headers") > 0, F.col("content")).otherwise("")
    return (
        analysed_files(files, *languages)
        .select(*_KEYS, found.alias("headers"), "content")
        .select(*_KEYS, "headers", brace_chunks(text).alias("chunks"))
        .select("*", brace_partners("chunks").alias("partners"))
        .select(
            *_KEYS,
            bodies("headers", "chunks", "partners", "language <> 'csharp'").alias("functions"),
        )
    )


def functions(files: DataFrame, *languages: str) -> DataFrame:
    """One row per function with its body."""
    found = _with_bodies(files, *(languages or BRACE_LANGUAGES))
    return unnest_structs(found, _KEYS, "functions", "name")


def _with_scores(files: DataFrame, *languages: str) -> DataFrame:
    """Files with ``scored``: name, type and complexity of each function."""

    def score(language: str) -> Column:
        return F.transform(
            "functions",
            lambda f: F.struct(
                f["name"].alias("name"),
                f["fn_type"].alias("fn_type"),
                decision_count(f["body"], language).alias("complexity"),
            ),
        )

    scored = by_language({name: score(name) for name in languages})
    return _with_bodies(files, *languages).select(*_KEYS, scored.alias("scored"))


def scored_files(files: DataFrame, *languages: str) -> DataFrame:
    """Files of brace languages with the array of their scored functions."""
    return _with_scores(files, *(languages or BRACE_LANGUAGES)).select(*_KEYS, "scored")


def scored_functions(scored: DataFrame) -> DataFrame:
    return unnest_structs(scored, _KEYS, "scored", "name")


def brace_function_complexity(files: DataFrame, *languages: str) -> DataFrame:
    return scored_functions(scored_files(files, *languages))


def function_complexity(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Complexity of every function of the five languages."""
    return brace_function_complexity(files).unionByName(pyfacts.function_complexity(facts))


def scored_totals(scored: DataFrame) -> DataFrame:
    """1 + the sum over the functions of a file; files without functions give 1.

    A projection of the file row: no shuffle.
    """
    total = F.aggregate("scored", F.lit(1).cast("long"), lambda sum_, f: sum_ + f["complexity"])
    return scored.select(
        *_KEYS,
        total.alias("total_complexity"),
        F.size("scored").cast("long").alias("functions"),
    )


def brace_file_complexity(files: DataFrame, *languages: str) -> DataFrame:
    return scored_totals(scored_files(files, *languages))


def file_complexity(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Totals of the files of all five languages; Python files only if they parse."""
    return brace_file_complexity(files).unionByName(pyfacts.file_complexity(facts))


def repo_complexity(files: DataFrame, facts: DataFrame) -> DataFrame:
    return (
        file_complexity(files, facts)
        .groupBy("repo_id", "language")
        .agg(
            F.count("*").alias("files"),
            F.sum("total_complexity").alias("total_complexity"),
        )
    )


def high_complexity(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("complexity") > rules.HIGH_COMPLEXITY)


def bucket(complexity: Column) -> Column:
    """Label of the histogram bucket."""
    label = F.lit(None).cast("string")
    for name, lowest in reversed(rules.COMPLEXITY_BUCKETS):
        label = F.when(complexity >= lowest, name).otherwise(label)
    return label


def complexity_buckets(scored: DataFrame) -> DataFrame:
    """Functions per language and bucket, with sub-totals (null = all)."""
    return (
        scored.withColumn("bucket", bucket(F.col("complexity")))
        .rollup("language", "bucket")
        .agg(F.count("*").alias("functions"))
    )


def language_overview(totals: DataFrame) -> DataFrame:
    """Files and mean complexity per language, from :func:`file_complexity`."""
    return totals.groupBy("language").agg(
        F.count("*").alias("files"),
        F.round(F.avg("total_complexity"), 6).alias("mean_complexity"),
    )
