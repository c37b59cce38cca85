"""Edges between symbols: calls, implements and inherits, resolved in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.arrays import unnest_structs
from codeloom.functions.text import find_all
from codeloom.sources.corpus import analysed_files, by_language

#: Comments and strings, which hold no symbols.
BRACE_NOISE = r"""\"[^\"\n]*+\"|'[^'\n]*+'|`[^`]*+`|//[^\n]*+|/\*(?s:.*?)\*/"""
PYTHON_NOISE = r"""\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"[^\"\n]*+\"|'[^'\n]*+'|#[^\n]*+"""
GENERIC = r"<[\w\s,.?\[\]]*+>"

#: What a file declares: (namespace, kind, pattern of the name).
DECLARED = {
    "python": (("type", "class", r"(?m)^class\s+(\w+)"), ("function", "function", r"(?m)^(?:async\s+)?def\s+(\w+)")),
    "javascript": (
        ("type", "class", r"\bclass\s+(\w+)"), ("type", "interface", r"\binterface\s+(\w+)"),
        ("function", "function", r"\bfunction\s+(\w+)"),
    ),
    "csharp": (("type", "class", r"\b(?:class|struct)\s+(\w+)"), ("type", "interface", r"\binterface\s+(\w+)")),
    "java": (("type", "class", r"\bclass\s+(\w+)"), ("type", "interface", r"\binterface\s+(\w+)")),
    "go": (
        ("type", "class", r"\btype\s+(\w+)\s+struct\b"), ("type", "interface", r"\btype\s+(\w+)\s+interface\b"),
        ("function", "function", r"(?m)^func\s+(\w+)"),
    ),
}
#: Lists of base types: (as written, pattern of kind, owner and list).
BASES = {
    "python": (("extends", r"(?m)^(class)\s+(\w+)\s*\(([^()]*)\)\s*:"),),
    "javascript": (
        ("extends", r"\b(class|interface)\s+(\w+)\s+extends\s+([\w.,\s]+?)(?=\s+implements\b|\s*\{)"),
        ("implements", r"\b(class)\s+(\w+)(?:\s+extends\s+[\w.]+)?\s+implements\s+([\w.,\s]+?)(?=\s*\{)"),
    ),
    "csharp": (("extends", r"\b(class|interface|struct)\s+(\w+)\s*:\s*([\w.,\s]+?)(?=\s+where\b|\s*\{)"),),
    "java": (
        ("extends", r"\b(class|interface)\s+(\w+)\s+extends\s+([\w.,\s]+?)(?=\s+implements\b|\s*\{)"),
        ("implements", r"\b(class)\s+(\w+)(?:\s+extends\s+[\w.]+)?\s+implements\s+([\w.,\s]+?)(?=\s*\{)"),
    ),
    "go": (),
}
_CALL = r"(?<![\w.$])(?<!\b(?:def|func|function|class|new)\s)(\w+)\s*\("
#: Calls of bare names; in Go a name after a receiver is a declaration.
CALLS = {"python": _CALL, "javascript": _CALL, "go": r"(?<!\)\s)" + _CALL}

_REFERENCES = "array<struct<what:string,how:string,owner_kind:string,owner:string,name:string>>"
_LOOKUPS = "array<struct<scope:string,level:int,only:string>>"
_PACKAGE = {"java": r"\bpackage\s+([\w.]+)\s*;", "csharp": r"\bnamespace\s+([\w.]+)"}


def _plain(language: str) -> Column:
    """The text without comments, strings and type arguments."""
    text = F.regexp_replace("content", PYTHON_NOISE if language == "python" else BRACE_NOISE, '""')
    if language in ("java", "csharp", "javascript"):
        text = F.regexp_replace(F.regexp_replace(text, GENERIC, ""), GENERIC, "")
    return text


def _declared(language: str) -> Column:
    def of(what: str, kind: str, pattern: str) -> Column:
        return F.transform(
            find_all(F.col("plain"), pattern, 1),
            lambda n: F.struct(F.lit(what).alias("what"), F.lit(kind).alias("kind"), n.alias("name")),
        )

    return F.array_distinct(F.concat(*[of(*entry) for entry in DECLARED[language]]))


def _bases(how: str, pattern: str) -> Column:
    kinds, owners, lists = (find_all(F.col("plain"), pattern, group) for group in (1, 2, 3))

    def named(head: Column, listed: Column) -> Column:
        names = F.filter(F.split(listed, ","), lambda n: ~n.contains("="))
        last = F.filter(F.transform(names, lambda n: F.regexp_extract(n, r"(\w+)\s*$", 1)), lambda n: n != "")
        return F.transform(
            last,
            lambda n: F.struct(
                F.lit("type").alias("what"), F.lit(how).alias("how"), head["kind"].alias("owner_kind"),
                head["owner"].alias("owner"), n.alias("name"),
            ),
        )

    heads = F.zip_with(kinds, owners, lambda k, o: F.struct(k.alias("kind"), o.alias("owner")))
    return F.flatten(F.zip_with(heads, lists, named))


def _references(language: str) -> Column:
    found = [_bases(*entry) for entry in BASES[language]]
    if language in CALLS:
        called = F.transform(
            F.array_distinct(find_all(F.col("plain"), CALLS[language], 1)),
            lambda n: F.struct(
                F.lit("function").alias("what"), F.lit("calls").alias("how"), F.lit("").alias("owner_kind"),
                F.lit("").alias("owner"), n.alias("name"),
            ),
        )
        found.append(called)
    return F.array_distinct(F.concat(*found, F.array().cast(_REFERENCES)))


def _folders() -> Column:
    parts = F.split("path", "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _up(levels: Column, rest: Column, mark: str) -> Column:
    """The names of ``rest`` below the folder ``levels`` above that of the file."""
    folders = _folders()
    kept = F.slice(folders, 1, F.greatest(F.size(folders) - levels, F.lit(0)))
    return F.array_join(F.filter(F.concat(kept, rest), lambda n: n != ""), mark)


def _look(scope: Column, level: int, only: Column | None = None) -> Column:
    return F.struct(
        scope.alias("scope"), F.lit(level).alias("level"), (F.lit(None) if only is None else only).cast("string").alias("only")
    )


def _imported(language: str) -> Column:
    """Scopes that the imports of a file open."""
    text = F.col("content")
    if language == "python":
        pattern = r"(?m)^\s*from\s+(\.*)([\w.]*)\s+import\b"

        def module(dots: Column, rest: Column) -> Column:
            below = _up(F.char_length(dots) - 1, F.split(rest, r"\."), ".")
            return _look(F.concat(F.lit("import:"), F.when(dots == "", rest).otherwise(below)), 1)

        return F.zip_with(find_all(text, pattern, 1), find_all(text, pattern, 2), module)
    if language == "javascript":
        names = find_all(text, r"""(?:\bfrom|\bimport|\brequire\s*\()\s*['"](\.{1,2}/[^'"\n]+)['"]""", 1)

        def stem(name: Column) -> Column:
            rest = F.regexp_replace(F.regexp_replace(name, r"^(\.{1,2}/)+", ""), r"(/index)?(\.\w+)?$", "")
            return _look(F.concat(F.lit("import:"), _up(F.regexp_count(name, F.lit(r"\.\./")), F.split(rest, "/"), "/")), 1)

        return F.transform(names, stem)
    if language == "csharp":
        return F.transform(find_all(text, r"\busing\s+([\w.]+)\s*;", 1), lambda n: _look(F.concat(F.lit("import:"), n), 1))
    if language == "java":
        def qualified(name: Column) -> Column:
            last = F.substring_index(name, ".", -1)
            package = F.regexp_replace(name, r"\.[^.]*$", "")
            return _look(F.concat(F.lit("import:"), package), 1, F.when(last != "*", last))

        return F.transform(find_all(text, r"\bimport\s+([\w.]+(?:\.\*)?)\s*;", 1), qualified)
    return F.array().cast(_LOOKUPS)


def _module(language: str) -> Column:
    """The name by which other files import this one."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    if language == "python":
        return F.translate(F.regexp_replace(stem, r"/__init__$", ""), "/", ".")
    if language == "javascript":
        return F.regexp_replace(stem, r"/index$", "")
    if language in _PACKAGE:
        return F.regexp_extract("content", _PACKAGE[language], 1)
    return F.lit("")


def _facts(files: DataFrame) -> DataFrame:
    """One row per source file: what it declares, refers to, belongs to and looks in."""
    def each(build) -> Column:
        return by_language({name: build(name) for name in DECLARED})

    folder = F.concat(F.lit("folder:"), F.array_join(_folders(), "/"))
    own, every = F.concat(F.lit("file:"), F.col("path")), F.lit("repository")
    module = each(_module)
    looks = F.concat(F.array(_look(own, 0), _look(folder, 2), _look(every, 3)).cast(_LOOKUPS), each(lambda n: _imported(n).cast(_LOOKUPS)))
    scopes = F.concat(F.array(own, folder, every), F.when(module != "", F.array(F.concat(F.lit("import:"), module))).otherwise(F.array().cast("array<string>")))
    return (
        analysed_files(files).withColumn("plain", each(_plain))
        .select("repo_id", "path", "language", each(_declared).alias("declared"), each(_references).alias("refers"),
                scopes.alias("scopes"), F.array_distinct(looks).alias("looks"))
    )


def symbol_edges(files: DataFrame) -> DataFrame:
    """``repo_id, src, dst, type``: resolved calls, implementations and inheritance.

    ``src`` is ``language:path#Type`` for types and ``language:path`` for calls, ``dst``
    is ``language:path#name``.  A name is looked for in the file itself, then in what the
    file imports, then in its folder, then in the repository, among declarations of its
    language.  The first of these that has the name decides: if one file declares it,
    that is the edge; if several do, the name is ambiguous and gives none.

    A class that names an interface ``implements`` it, however that is written; other
    base types are ``inherits``.  Calls are those of bare names of functions (Python,
    JavaScript, Go), not of methods; a method declared with a function's name reads as a
    call.  Qualified base types go by their last part.  Go types have no written bases.

    All of it is a projection of the file's row, and what is shuffled are names: the
    declarations, folded to the first and last file of each (scope, name), and the
    references once for each scope they look in.  A popular name is one row on the
    declaring side, so no pairs of users and declarations arise.
    """
    facts = _facts(files)
    keys = ["repo_id", "path", "language"]
    declared = unnest_structs(facts, [*keys, "scopes"], "declared", "name").select(
        "repo_id", "path", "language", "what", "kind", "name", F.explode("scopes").alias("scope")
    )
    index = declared.groupBy("repo_id", "language", "scope", "what", "name").agg(
        F.min("path").alias("low"), F.max("path").alias("high"), F.max("kind").alias("kind")
    )
    references = unnest_structs(facts, [*keys, "looks"], "refers", "name")
    looked = references.select(*keys, "what", "how", "owner_kind", "owner", "name", F.inline("looks")).where(
        "only IS NULL OR only = name"
    )
    level = F.col("level")
    found = (
        looked.join(index, ["repo_id", "language", "scope", "what", "name"])
        .groupBy(*keys, "what", "how", "owner_kind", "owner", "name")
        .agg(F.min(F.struct(level, "low", "kind")).alias("first"), F.max(F.struct((-level).alias("level"), "high")).alias("last"))
        .where("first.low = last.high")
    )
    place = F.concat_ws(":", "language", "path")
    implements = (F.col("how") == "implements") | ((F.col("first.kind") == "interface") & (F.col("owner_kind") != "interface"))
    return found.select(
        "repo_id",
        F.when(F.col("what") == "type", F.concat_ws("#", place, "owner")).otherwise(place).alias("src"),
        F.concat(F.col("language"), F.lit(":"), F.col("first.low"), F.lit("#"), F.col("name")).alias("dst"),
        F.when(F.col("how") == "calls", "calls").when(implements, "implements").otherwise("inherits").alias("type"),
    ).distinct()
