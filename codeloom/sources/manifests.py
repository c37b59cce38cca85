"""External packages named in manifests: npm, NuGet, Maven, Gradle, Go modules."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import rules
from codeloom.functions.arrays import unnest
from codeloom.functions.text import find_all
from codeloom.sources.corpus import MANIFEST, of_kinds

def _npm_names(text: str) -> dict[str, list[str]]:
    """Package names of a ``package.json``, as its two readers see them.

    Only a whole, valid JSON object counts.  The packages are the keys of the
    sections in turn, up to the first section that is no object; the stack is
    all sections or, if one is no object, nothing.
    """
    found: dict[str, list[str]] = {"packages": [], "stack": []}
    try:
        manifest = json.loads(text)
    except (ValueError, RecursionError):
        return found
    if not isinstance(manifest, dict):
        return found
    for section in rules.NPM_SECTIONS:
        entries = manifest.get(section, {})
        if not isinstance(entries, dict):
            break
        found["packages"] += entries
    stack = [manifest.get(section, {}) for section in rules.JS_STACK_SECTIONS]
    if all(isinstance(entries, dict) for entries in stack):
        found["stack"] = [name for entries in stack for name in entries]
    return {reader: list(dict.fromkeys(names)) for reader, names in found.items()}


# from_json is laxer than a JSON parser: it takes single quotes, text after the
# object and objects that are cut off.
@F.pandas_udf(
    T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("packages", "stack")])
)
def _npm_manifest(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_npm_names(text or "") for text in texts], columns=["packages", "stack"])


def package_json(files: DataFrame) -> DataFrame:
    """``repo_id, path, packages, stack`` of the root ``package.json`` files."""
    chosen = _manifest(files, F.col("path") == "package.json")
    return chosen.select("repo_id", "path", _npm_manifest("content").alias("m")).select(
        "repo_id", "path", "m.packages", "m.stack"
    )


def npm_packages(files: DataFrame) -> DataFrame:
    return _packages(package_json(files), "javascript", F.col("packages"))


def _tree(text: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None


# Spark's xpath functions fail the query on malformed text and from_xml accepts
# text after the root element, so the few manifest rows go to Python in Arrow
# batches.
@F.pandas_udf(T.ArrayType(T.StringType()))
def _reference_includes(texts: pd.Series) -> pd.Series:
    """``Include`` of each un-namespaced PackageReference; null if not XML."""

    def includes(text: str) -> list[str] | None:
        tree = _tree(text)
        if tree is None:
            return None
        names = (node.get("Include") for node in tree.iter("PackageReference") if node is not tree)
        return [name for name in names if name]

    return texts.map(includes)


@F.pandas_udf(
    T.ArrayType(
        T.StructType([T.StructField(n, T.StringType()) for n in ("group", "artifact", "version")])
    )
)
def _pom_dependencies(texts: pd.Series) -> pd.Series:
    """Coordinates of each dependency element in the namespace of the root.

    A pom without a namespace is looked up in the default one and has none.
    """

    def coordinates(text: str) -> list[dict[str, str | None]]:
        tree = _tree(text)
        if tree is None or not tree.tag.startswith("{"):
            return []
        space = tree.tag[: tree.tag.index("}") + 1]
        return [
            {
                "group": node.findtext(f"{space}groupId"),
                "artifact": node.findtext(f"{space}artifactId"),
                "version": node.findtext(f"{space}version"),
            }
            for node in tree.iter(f"{space}dependency")
            if node is not tree
        ]

    return texts.map(coordinates)


def _manifest(files: DataFrame, where: Column) -> DataFrame:
    return of_kinds(files, MANIFEST).filter(where & F.col("is_utf8"))


def _packages(manifests: DataFrame, language: str, names: Column) -> DataFrame:
    keys = ["repo_id", F.lit(language).alias("language"), F.col("path").alias("manifest")]
    return unnest(manifests, keys, names, "package").distinct()


def nuget_packages(files: DataFrame) -> DataFrame:
    """``Include`` of every package reference in project and solution files.

    Text that is not XML (solution files never are) falls back to the pattern.
    """
    is_project = F.col("path").endswith(".csproj") | F.col("path").endswith(".sln")
    names = F.coalesce(
        _reference_includes("content"), find_all(F.col("content"), rules.NUGET_REFERENCE, 1)
    )
    return _packages(_manifest(files, is_project), "csharp", names)


def maven_packages(files: DataFrame) -> DataFrame:
    """``group:artifact[:version]`` of every dependency in the root ``pom.xml``."""
    complete = F.filter(
        _pom_dependencies("content"),
        lambda d: d["group"].isNotNull() & d["artifact"].isNotNull(),
    )
    names = F.transform(
        complete, lambda d: F.concat_ws(":", d["group"], d["artifact"], d["version"])
    )
    return _packages(_manifest(files, F.col("path") == "pom.xml"), "java", names)


def gradle_packages(files: DataFrame) -> DataFrame:
    names = F.concat(*[find_all(F.col("content"), p, 1) for p in rules.GRADLE_PATTERNS])
    return _packages(_manifest(files, F.col("path") == "build.gradle"), "java", names)


def go_modules(files: DataFrame, strict: bool = False) -> DataFrame:
    """``module@version`` from the root ``go.mod``.

    The fixed pattern reads ``require (`` as the module ``(`` and drops the rest
    of a block.  ``strict`` reads the entries of blocks instead.
    """
    text = F.col("content")
    if strict:
        blocks = F.array_join(find_all(text, r"require\s*\(([^)]*)\)", 1), "\n")
        entry = r"(?m)^\s*([^\s()/]\S*)[ \t]+(v\S+)"
        single = r"(?m)^require[ \t]+([^\s(]+)[ \t]+(\S+)"
        pairs = F.concat(
            *[
                F.arrays_zip(
                    find_all(source, pattern, 1).alias("module"),
                    find_all(source, pattern, 2).alias("version"),
                )
                for source, pattern in ((blocks, entry), (text, single))
            ]
        )
    else:
        pairs = F.arrays_zip(
            find_all(text, rules.GO_REQUIRE, 1).alias("module"),
            find_all(text, rules.GO_REQUIRE, 2).alias("version"),
        )
    names = F.transform(pairs, lambda p: F.concat(p["module"], F.lit("@"), p["version"]))
    return _packages(_manifest(files, F.col("path") == "go.mod"), "go", names)


def package_inventory(files: DataFrame) -> DataFrame:
    """Distinct external packages per repository and language, all manifests.

    Each source reads the manifests only, which are a partition of a stored corpus.
    """
    sources = (npm_packages, nuget_packages, maven_packages, gradle_packages, go_modules)
    found = reduce(DataFrame.unionByName, [source(files) for source in sources])
    return found.select("repo_id", "language", "package").distinct()
