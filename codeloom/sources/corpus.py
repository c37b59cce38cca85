"""The ``files`` table: one row per file of a repository.

Columns: ``repo_id``, ``path`` (relative to the repository root, ``/`` between
parts), ``content`` (text with ``\\n`` line ends), ``is_utf8`` and ``kind``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.text import basename, dirname, ends_with_any, unix_newlines

TREE_SCHEMA = "repo_id long, path string, bytes binary"
MANIFEST, CONFIGURATION, DATA, OTHER = "manifest", "configuration", "data", "other"
#: Manifests by exact name and by suffix.
MANIFEST_NAMES = ("package.json", "pom.xml", "build.gradle", "go.mod")
MANIFEST_SUFFIXES = (".csproj", ".sln")


def kind_of(path: Column) -> Column:
    """What an analysis could want a file for, by its name alone.

    A language (an analysed one first), else ``manifest``, ``configuration``,
    ``data`` or ``other``.  A corpus is stored in one partition for each kind, so
    that an analysis of one language reads no other text.
    """
    name = basename(path)
    branches = [(ends_with_any(path, suffixes), lang) for lang, (suffixes, _) in rules.LANGUAGE_SCANS.items()]
    branches += [(ends_with_any(path, suffixes), lang) for lang, suffixes in rules.DISCOVERY_SUFFIXES.items()]
    branches += [
        (name.isin(*MANIFEST_NAMES) | ends_with_any(path, MANIFEST_SUFFIXES), MANIFEST),
        (ends_with_any(name, rules.CONFIG_SUFFIXES), CONFIGURATION),
        (ends_with_any(name, rules.DATA_SUFFIXES), DATA),
    ]
    kind = F.lit(OTHER)
    for test, label in reversed(branches):
        kind = F.when(test, label).otherwise(kind)
    return kind


def of_kinds(files: DataFrame, *kinds: str) -> DataFrame:
    """The files of some kinds, without that column; a table without it is left as it is."""
    return files.filter(F.col("kind").isin(*kinds)).drop("kind") if "kind" in files.columns else files


def from_text(files: DataFrame) -> DataFrame:
    """Files whose text is already decoded (``repo_id, path, content``)."""
    return files.select(
        "repo_id",
        "path",
        unix_newlines(F.col("content")).alias("content"),
        F.lit(True).alias("is_utf8"),
        kind_of(F.col("path")).alias("kind"),
    )


def from_bytes(files: DataFrame) -> DataFrame:
    """Files as bytes (``repo_id, path, bytes``).

    Text that is not UTF-8 keeps its valid part, as the cross-language analyses
    read it; the language analyses leave such files out by ``is_utf8``.
    """
    raw = F.col("bytes").cast("string")
    valid = F.is_valid_utf8(raw)
    text = F.when(valid, raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")))
    return files.select(
        "repo_id", "path", unix_newlines(text).alias("content"), valid.alias("is_utf8"),
        kind_of(F.col("path")).alias("kind"),
    )


def read_trees(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """Read checked-out trees from a shared file system.

    ``roots`` has ``repo_id, root``.  Names are listed first and spread over the
    cluster by path, so that one huge repository is read by many tasks.  Unlike
    the file sources of Spark this keeps names that start with ``_`` or ``.``.
    Bytes are read of sources and manifests; of other files only names are known.
    """

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, root in zip(batch["repo_id"], batch["root"]):
                for folder, _, names in os.walk(root):
                    inside = os.path.relpath(folder, root).replace(os.sep, "/")
                    prefix = "" if inside == "." else inside + "/"
                    rows = [(repo_id, root, prefix + name) for name in names]
                    if rows:
                        yield pd.DataFrame(rows, columns=["repo_id", "root", "path"], dtype=object)

    wanted = tuple(
        x for group in (
            *(suffixes for suffixes, _ in rules.LANGUAGE_SCANS.values()), *rules.DISCOVERY_SUFFIXES.values(),
            MANIFEST_NAMES, MANIFEST_SUFFIXES,
        ) for x in group
    )

    def content(name: str) -> bytes | None:
        if not name.endswith(wanted):
            return None  # no analysis reads its text
        try:
            with open(name, "rb") as handle:
                return handle.read()
        except OSError:
            return None  # unreadable: kept as a name without text

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, root, path in zip(batch["repo_id"], batch["root"], batch["path"]):
                row = (repo_id, path, content(os.path.join(root, path)))
                yield pd.DataFrame([row], columns=["repo_id", "path", "bytes"], dtype=object)

    names = roots.select("repo_id", "root").mapInPandas(
        walk, "repo_id long, root string, path string"
    )
    spread = names.repartition(F.xxhash64("repo_id", "path"))
    return from_bytes(spread.mapInPandas(read, TREE_SCHEMA))


def _outside(directories: tuple[str, ...]) -> Column:
    """No directory on the way to the file is one of ``directories``."""
    parts = F.split(dirname(F.col("path")), "/")
    return ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in directories]))


def scan_condition(language: str) -> Column:
    """Suffix and directory test of one language."""
    suffixes, skipped = rules.LANGUAGE_SCANS[language]
    return ends_with_any(F.col("path"), suffixes) & _outside(skipped)


def language_files(files: DataFrame, language: str, readable_only: bool = True) -> DataFrame:
    """Files one language analysis works on."""
    keep = scan_condition(language)
    if readable_only:
        keep = keep & F.col("is_utf8")
    return of_kinds(files, language).filter(keep).withColumn("language", F.lit(language))


def analysed_files(files: DataFrame, *languages: str, readable_only: bool = True) -> DataFrame:
    """Files of several analysed languages (default: all five) in one pass.

    The suffixes do not overlap, so a file has at most one language.
    """
    wanted = languages or tuple(rules.LANGUAGE_SCANS)
    if len(wanted) == 1:
        return language_files(files, wanted[0], readable_only)
    language = F.lit(None).cast("string")
    for name in reversed(wanted):
        suffixes, skipped = rules.LANGUAGE_SCANS[name]
        language = F.when(
            ends_with_any(F.col("path"), suffixes), F.when(_outside(skipped), F.lit(name))
        ).otherwise(language)
    scanned = of_kinds(files, *wanted).withColumn("language", language).filter(F.col("language").isNotNull())
    return scanned.filter("is_utf8") if readable_only else scanned


def by_language(cases: dict[str, Column]) -> Column:
    """The expression of the row's own language; only that one is evaluated."""
    if len(cases) == 1:
        return next(iter(cases.values()))
    chosen = None
    for name, value in cases.items():
        test = F.col("language") == name
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen


def discovered_files(files: DataFrame) -> DataFrame:
    """Files of all ten languages of the cross-language analysis."""
    language = F.lit(None).cast("string")
    for name, suffixes in reversed(rules.DISCOVERY_SUFFIXES.items()):
        language = F.when(ends_with_any(F.col("path"), suffixes), F.lit(name)).otherwise(language)
    return (
        of_kinds(files, *rules.LANGUAGE_SCANS, *rules.DISCOVERY_SUFFIXES)
        .filter(_outside(rules.DISCOVERY_SKIP))
        .withColumn("language", language)
        .filter(F.col("language").isNotNull())
    )


def resource_files(files: DataFrame) -> DataFrame:
    """Configuration and data files anywhere in the tree, by name."""
    name = basename(F.col("path"))
    kind = F.when(ends_with_any(name, rules.CONFIG_SUFFIXES), "configuration").when(
        ends_with_any(name, rules.DATA_SUFFIXES), "data"
    )
    return (
        files.select("repo_id", "path", name.alias("basename"), kind.alias("resource_type"))
        .filter(F.col("resource_type").isNotNull())
    )


def language_counts(files: DataFrame) -> DataFrame:
    """Files per analysed language and repository, unreadable ones included."""
    return (
        analysed_files(files, readable_only=False)
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("files"))
    )


def discovered_counts(files: DataFrame) -> DataFrame:
    return (
        discovered_files(files)
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("files"))
    )
