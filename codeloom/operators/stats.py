"""Per-file statistics: lines of code, declarations, imports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.arrays import unnest_structs
from codeloom.functions.text import code_lines, find_all, strip
from codeloom.sources.corpus import analysed_files, by_language, language_files

KEYS = ("repo_id", "path", "language")


def _content() -> Column:
    return F.col("content")


def lines_of_code(files: DataFrame) -> DataFrame:
    """Lines that are not blank and do not start with the line-comment mark."""
    loc = by_language(
        {name: code_lines(_content(), mark) for name, mark in rules.LINE_COMMENT.items()}
    )
    return analysed_files(files).select(*KEYS, loc.cast("long").alias("loc"))


def js_function_names() -> Column:
    """Distinct names over the four function patterns of one file."""
    return F.array_distinct(F.concat(*[find_all(_content(), p, 1) for p in rules.JS_FUNCTIONS]))


def js_import_names() -> Column:
    return F.array_distinct(F.concat(*[find_all(_content(), p, 1) for p in rules.JS_IMPORTS]))


def js_export_names() -> Column:
    """Distinct exported names of one file.

    Per pattern: when its first match holds a comma, only that match counts and
    is split; otherwise all matches count as they are.
    """

    def of(pattern: rules.Pattern) -> Column:
        names = find_all(_content(), pattern, 1)
        first = F.get(names, F.lit(0))
        listed = F.transform(F.split(first, ",", -1), strip)
        return F.when(first.contains(","), listed).otherwise(names)

    return F.array_distinct(F.concat(*[of(p) for p in rules.JS_EXPORTS]))


def go_import_names() -> Column:
    """Names in import blocks and single imports; aliased single ones do not match."""
    blocks = F.transform(
        find_all(_content(), rules.GO_IMPORT, 1), lambda b: find_all(b, rules.GO_QUOTED, 1)
    )
    singles = F.filter(find_all(_content(), rules.GO_IMPORT, 2), lambda n: n != "")
    return F.concat(F.flatten(blocks), singles)


def _kinds(language: str) -> dict[str, Column]:
    """kind -> names in one file."""
    text = _content()
    if language == "javascript":
        return {
            "function": js_function_names(),
            "class": find_all(text, rules.JS_CLASS, 1),
            "import": js_import_names(),
            "export": js_export_names(),
        }
    if language == "csharp":
        return {
            **{k: find_all(text, p, 1) for k, p in rules.CSHARP_DECLARATIONS.items()},
            "using": find_all(text, rules.CSHARP_USING, 1),
        }
    if language == "java":
        return {
            **{k: find_all(text, p, 1) for k, p in rules.JAVA_DECLARATIONS.items()},
            "import": find_all(text, rules.JAVA_IMPORT, 1),
        }
    if language == "go":
        return {
            **{k: find_all(text, p, 1) for k, p in rules.GO_DECLARATIONS.items()},
            "import": go_import_names(),
        }
    raise ValueError(f"no pattern-based declarations for {language}")


PATTERN_LANGUAGES = ("javascript", "csharp", "java", "go")


def declarations(files: DataFrame, *languages: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row per declared name: ``repo_id, path, language, kind, name``."""
    wanted = languages or PATTERN_LANGUAGES

    def labelled(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    def named(language: str) -> Column:
        every = _kinds(language)
        return F.concat(*[labelled(kind, every[kind]) for kind in every if kind in (kinds or every)])

    found = by_language({name: named(name) for name in wanted})
    return unnest_structs(analysed_files(files, *wanted), KEYS, found, "name")


def file_stats(files: DataFrame, language: str) -> DataFrame:
    """Counts per kind of declaration and lines of code, one row per file."""
    counts = [
        F.size(names).cast("long").alias(f"{kind}_count") for kind, names in _kinds(language).items()
    ]
    loc = code_lines(_content(), rules.LINE_COMMENT[language]).cast("long").alias("loc")
    return language_files(files, language).select(*KEYS, loc, *counts)


def valid_files(files: DataFrame, errors: DataFrame, python_facts: DataFrame) -> DataFrame:
    """Total and valid files per repository and analysed language.

    python: files that parse.  javascript: readable files.  csharp and go: all
    files when the build left no error line, else none.  java: readable files
    when neither build tool left one, else none.
    """
    totals = (
        analysed_files(files, readable_only=False)
        .groupBy("repo_id", "language")
        .agg(
            F.count("*").alias("total_files"),
            F.count_if("is_utf8").alias("readable"),
        )
    )
    broken = (
        errors.select(
            "repo_id",
            F.when(F.col("tool") == "dotnet", "csharp")
            .when(F.col("tool").isin("maven", "gradle"), "java")
            .when(F.col("tool") == "go build", "go")
            .alias("language"),
        )
        .filter(F.col("language").isNotNull())
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("errors"))
    )
    unparsed = (
        python_facts.filter("fact IN ('syntax_error', 'read_error')")
        .groupBy("repo_id", F.lit("python").alias("language"))
        .agg(F.countDistinct("path").alias("errors"))
    )
    language, errors_found = F.col("language"), F.coalesce(F.col("errors"), F.lit(0))
    valid = (
        F.when(language == "python", F.col("total_files") - errors_found)
        .when(language == "javascript", F.col("readable"))
        .when(errors_found > 0, 0)
        .when(language == "java", F.col("readable"))
        .otherwise(F.col("total_files"))
    )
    return totals.join(broken.unionByName(unparsed), ["repo_id", "language"], "left").select(
        "repo_id", "language", "total_files", valid.cast("long").alias("valid_files")
    )
