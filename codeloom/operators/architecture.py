"""Architecture markers per repository.

Tests over "the whole source of a repository" are per-file tests folded with
``bool_or``: no text is concatenated or shuffled, only flags are, and they are
pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.arrays import unnest
from codeloom.functions.text import (
    basename,
    contains_any,
    dirname,
    find_all,
    first_group,
    found,
)
from codeloom.sources.corpus import analysed_files, language_files, scan_condition
from codeloom.sources.manifests import package_json

_PATH = "path"


def _text() -> Column:
    return F.col("content")


def package_structure(files: DataFrame) -> DataFrame:
    """Files per directory (python, javascript); files at the root are left out."""
    folder = dirname(F.col(_PATH))
    return (
        analysed_files(files, "python", "javascript", readable_only=False)
        .select("repo_id", "language", folder.alias("dir"))
        .filter(F.col("dir") != "")
        .groupBy("repo_id", "language", "dir")
        .agg(F.count("*").alias("files"))
    )


def mvc_by_name(files: DataFrame) -> DataFrame:
    """Python repositories whose file names hold model, view and controller."""
    name = F.lower(basename(F.col(_PATH)))
    present = [F.bool_or(name.contains(part)) for part in rules.MVC_NAME_PARTS]
    mvc = present[0] & present[1] & present[2]
    return (
        language_files(files, "python", readable_only=False)
        .groupBy("repo_id")
        .agg(mvc.alias("mvc_pattern"))
    )


def _first_present(names: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    label = F.lit(None).cast("string")
    for title, packages in reversed(table):
        wanted = F.array(*[F.lit(p) for p in packages])
        label = F.when(F.arrays_overlap(names, wanted), title).otherwise(label)
    return label


def js_stack(files: DataFrame) -> DataFrame:
    """Framework, test framework and build tool named in the root package.json."""
    names = F.col("stack")
    return package_json(files).select(
        "repo_id",
        _first_present(names, rules.JS_FRAMEWORKS).alias("framework"),
        _first_present(names, rules.JS_TEST_FRAMEWORKS).alias("testing_framework"),
        _first_present(names, rules.JS_BUILD_TOOLS).alias("build_tool"),
    )


def js_module_system(files: DataFrame) -> DataFrame:
    """Module system of the first file, among the first ten by path, that shows one.

    Only the rank and the label travel; Spark keeps ten rows per repository and
    task before the shuffle (window group limit), so a hot repository is cheap.
    """
    label = F.lit(None).cast("string")
    for title, words in reversed(rules.JS_MODULE_SYSTEMS):
        label = F.when(contains_any(_text(), words), title).otherwise(label)
    # Unreadable files take a place among the ten but show nothing.
    label = F.when(F.col("is_utf8"), label)
    by_path = Window.partitionBy("repo_id").orderBy(_PATH)
    return (
        language_files(files, "javascript", readable_only=False)
        .select("repo_id", _PATH, label.alias("module_system"))
        .withColumn("place", F.row_number().over(by_path))
        .filter(F.col("place") <= rules.JS_MODULE_SAMPLE)
        .groupBy("repo_id")
        .agg(
            F.min_by(
                "module_system", F.when(F.col("module_system").isNotNull(), F.col("place"))
            ).alias("module_system")
        )
    )


def csharp_namespaces(files: DataFrame) -> DataFrame:
    """Entries per namespace: one per match, so a file may count twice."""
    return (
        unnest(
            language_files(files, "csharp"),
            ["repo_id"],
            find_all(_text(), rules.CSHARP_NAMESPACE, 1),
            "namespace",
        )
        .groupBy("repo_id", "namespace")
        .agg(F.count("*").alias("files"))
    )


def csharp_arch(files: DataFrame) -> DataFrame:
    """MVC, repository and injection marks; the two words of the repository
    pattern may be in different files."""

    def anywhere(*words: str) -> Column:
        return F.bool_or(contains_any(_text(), words))

    repository = [anywhere(word) for word in rules.CSHARP_REPOSITORY_WORDS]
    return (
        language_files(files, "csharp")
        .groupBy("repo_id")
        .agg(
            anywhere(*rules.CSHARP_MVC_WORDS).alias("mvc_pattern"),
            (repository[0] & repository[1]).alias("repository_pattern"),
            anywhere(*rules.CSHARP_INJECTION_WORDS).alias("dependency_injection"),
        )
    )


def _declared_packages(files: DataFrame, language: str, pattern: rules.Pattern) -> DataFrame:
    return (
        language_files(files, language)
        .select("repo_id", first_group(_text(), pattern).alias("package"))
        .filter(F.col("package").isNotNull())
        .groupBy("repo_id", "package")
        .agg(F.count("*").alias("files"))
    )


def java_packages(files: DataFrame) -> DataFrame:
    return _declared_packages(files, "java", rules.JAVA_PACKAGE)


def go_packages(files: DataFrame) -> DataFrame:
    return _declared_packages(files, "go", rules.GO_PACKAGE)


def _features(aggregated: DataFrame, flags: list[tuple[str, str, str]]) -> DataFrame:
    """Wide flags to rows ``repo_id, feature, value`` for the flags that hold."""
    entries = [
        F.when(
            F.col(column), F.struct(F.lit(feature).alias("feature"), F.lit(value).alias("value"))
        )
        for column, feature, value in flags
    ]
    return aggregated.select("repo_id", F.inline(F.array_compact(F.array(*entries))))


def java_arch(files: DataFrame) -> DataFrame:
    """Build tool, frameworks, design patterns and Spring annotations found.

    One aggregation; rows ``repo_id, feature, value``.
    """
    is_java = F.col("language") == "java"
    tests: list[tuple[str, str, Column]] = []
    for title, words in rules.JAVA_FRAMEWORKS:
        tests.append(("framework", title, contains_any(_text(), words)))
    for title, pattern in rules.JAVA_DESIGN_PATTERNS:
        tests.append(("design_pattern", title, found(_text(), pattern)))
    for name in rules.SPRING_ANNOTATIONS:
        tests.append(("spring_annotation", name, _text().contains("@" + name)))
    flags = [(f"t{i}", feature, value) for i, (feature, value, _) in enumerate(tests)]
    maven, gradle = F.col("maven"), F.col("gradle")
    folded = (
        _with_root_files(files, "java")
        .groupBy("repo_id")
        .agg(
            F.bool_or(is_java).alias("has_language"),
            F.bool_or(F.col(_PATH) == "pom.xml").alias("maven"),
            F.bool_or(F.col(_PATH) == "build.gradle").alias("gradle"),
            *[
                F.bool_or(is_java & F.col("is_utf8") & test).alias(f"t{i}")
                for i, (_, _, test) in enumerate(tests)
            ],
        )
        .filter("has_language")
        .withColumn("gradle", gradle & ~maven)
    )
    tools = [("maven", "build_tool", "Maven"), ("gradle", "build_tool", "Gradle")]
    return _features(folded, tools + flags)


def go_arch(files: DataFrame) -> DataFrame:
    """Go modules flag, service indicators, number of main packages, tests."""
    is_go = F.col("language") == "go"
    readable = is_go & F.col("is_utf8")
    at_root = ~F.col(_PATH).contains("/")
    lowered = F.lower(_text())

    def in_sources(test: Column) -> Column:
        return F.bool_or(readable & test)

    return (
        _with_root_files(files, "go")
        .groupBy("repo_id")
        .agg(
            F.bool_or(is_go).alias("has_language"),
            F.bool_or(F.col(_PATH) == "go.mod").alias("go_modules"),
            in_sources(contains_any(_text(), ("http.ListenAndServe", "gin.New"))).alias("http_server"),
            in_sources(lowered.contains("grpc")).alias("grpc_service"),
            (
                in_sources(lowered.contains("docker")) | F.bool_or(F.col(_PATH) == "Dockerfile")
            ).alias("containerized"),
            (
                in_sources(lowered.contains("kubernetes"))
                | F.bool_or(at_root & (F.col(_PATH).endswith(".yaml") | F.col(_PATH).endswith(".yml")))
            ).alias("kubernetes_ready"),
            F.count_if(
                readable & (first_group(_text(), rules.GO_PACKAGE) == "main")
            ).alias("main_packages"),
            F.bool_or(is_go & F.col(_PATH).endswith("_test.go")).alias("test_coverage"),
        )
        .filter("has_language")
        .drop("has_language")
    )


def _with_root_files(files: DataFrame, language: str) -> DataFrame:
    """Sources of one language, and the files at the repository root, in one pass."""
    is_source = scan_condition(language)
    return files.filter(is_source | ~F.col(_PATH).contains("/")).withColumn(
        "language", F.when(is_source, F.lit(language)).otherwise("")
    )
