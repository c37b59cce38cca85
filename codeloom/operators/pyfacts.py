"""Facts from Python sources.

Python has a full grammar that no pattern covers, so this is the one job that
parses: files go through ``mapInPandas`` once and come back as narrow fact
rows.  Everything after that is DataFrame work, and every analysis of Python
sources shares this one pass.

Facts (``fact, name, line, n``):

* ``class`` / ``function``: a declaration (async functions are not counted);
* ``import``: one import statement;  ``import_name``: one imported name;
* ``depends_on``: one dependency of the file, given once per file;
* ``complexity``: ``n`` for the function ``name``;
* ``call``: a call of a bare ``name``, only of those asked for;
* ``parsed``: the file is valid;
* ``syntax_error`` (``name`` = message) and ``read_error``.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.text import code_lines
from codeloom.sources.corpus import language_files

FACT_SCHEMA = "repo_id long, path string, fact string, name string, line int, n long"

_ROWS_PER_FRAME = 20_000
_DECISIONS = (ast.If, ast.While, ast.For, ast.Try, ast.With)


def _decision_weight(node: ast.AST) -> int:
    if isinstance(node, _DECISIONS):
        return 1
    return len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0


def _file_facts(path: str, text: str, calls: frozenset[str]) -> Iterator[tuple]:
    """``(fact, name, line, n)`` rows of one file."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text, filename=path)
    except SyntaxError as error:
        yield "syntax_error", str(error), error.lineno, None
        return
    except (ValueError, RecursionError, MemoryError) as error:
        yield "read_error", str(error), None, None
        return

    yield "parsed", None, None, None
    dependencies: set[str] = set()
    order: list[tuple[ast.AST, int]] = [(tree, -1)]
    for place, (node, _) in enumerate(order):  # grows while it runs
        order.extend((child, place) for child in ast.iter_child_nodes(node))

    # Decisions of a subtree, summed from the leaves up: nested functions count
    # in their parents too.
    decisions = [_decision_weight(node) for node, _ in order]
    for place in range(len(order) - 1, 0, -1):
        decisions[order[place][1]] += decisions[place]

    for (node, _), total in zip(order, decisions):
        line = getattr(node, "lineno", None)
        if isinstance(node, ast.ClassDef):
            yield "class", node.name, line, None
        elif isinstance(node, ast.FunctionDef):
            yield "function", node.name, line, None
            yield "complexity", node.name, line, 1 + total
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            yield "import", None, line, None
            module = getattr(node, "module", None) or ""
            dotted = isinstance(node, ast.ImportFrom)
            targets = [module] if module else []
            for alias in node.names:
                yield "import_name", f"{module}.{alias.name}" if dotted else alias.name, line, None
                targets.append(f"{module}.{alias.name}" if module else alias.name)
            for target in targets:
                if target not in dependencies:
                    dependencies.add(target)
                    yield "depends_on", target, line, None
        elif isinstance(node, ast.Call) and getattr(node.func, "id", None) in calls:
            yield "call", node.func.id, line, None


def python_facts(files: DataFrame) -> DataFrame:
    """All facts of all Python files, one pass."""
    calls = frozenset(rules.PYTHON_DANGEROUS_CALLS)

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_id", "path", "fact", "name", "line", "n"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"line": "Int32", "n": "Int64"})

        rows: list[tuple] = []
        for batch in batches:
            for repo_id, path, text, ok in zip(
                batch["repo_id"], batch["path"], batch["content"], batch["is_utf8"]
            ):
                if ok:
                    rows.extend((repo_id, path, *f) for f in _file_facts(path, text, calls))
                else:
                    rows.append((repo_id, path, "read_error", "not UTF-8 text", None, None))
                if len(rows) >= _ROWS_PER_FRAME:
                    yield frame(rows)
                    rows = []
        yield frame(rows)

    sources = language_files(files, "python", readable_only=False)
    return sources.select("repo_id", "path", "content", "is_utf8").mapInPandas(parse, FACT_SCHEMA)


def file_stats(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts of declarations and imports and lines of code per valid file."""
    loc = code_lines(F.col("content"), rules.LINE_COMMENT["python"]).cast("long").alias("loc")
    sizes = language_files(files, "python").select("repo_id", "path", "language", loc)
    counts = (
        facts.filter("fact IN ('parsed', 'class', 'function', 'import')")
        .groupBy("repo_id", "path")
        .agg(
            F.count_if(F.col("fact") == "class").alias("class_count"),
            F.count_if(F.col("fact") == "function").alias("function_count"),
            F.count_if(F.col("fact") == "import").alias("import_count"),
        )
    )
    return sizes.join(counts, ["repo_id", "path"])


def declarations(facts: DataFrame) -> DataFrame:
    """Names of classes, functions and imports: ``repo_id, path, kind, name, line``."""
    kind = F.when(F.col("fact") == "import_name", "import").otherwise(F.col("fact"))
    return facts.filter("fact IN ('class', 'function', 'import_name')").select(
        "repo_id", "path", kind.alias("kind"), "name", F.col("line").cast("long").alias("line")
    )


def errors(facts: DataFrame) -> DataFrame:
    return facts.filter("fact IN ('syntax_error', 'read_error')").select(
        "repo_id", "path", "line", F.col("name").alias("message")
    )


def function_complexity(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'complexity'").select(
        "repo_id",
        "path",
        F.lit("python").alias("language"),
        "name",
        F.lit("function").alias("fn_type"),
        F.col("n").alias("complexity"),
    )


def file_complexity(facts: DataFrame) -> DataFrame:
    """Total and number of functions per valid file, from one read of the facts."""
    is_function = F.col("fact") == "complexity"
    return (
        facts.filter("fact IN ('parsed', 'complexity')")
        .groupBy("repo_id", "path", F.lit("python").alias("language"))
        .agg(
            F.sum(F.when(is_function, F.col("n")).otherwise(1)).alias("total_complexity"),
            F.count_if(is_function).alias("functions"),
        )
    )


def parsed_files(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'parsed'").select(
        "repo_id", "path", F.lit("python").alias("language")
    )


def dangerous_calls(facts: DataFrame) -> DataFrame:
    """Security findings; they carry no line of code."""
    return facts.filter("fact = 'call'").select(
        "repo_id",
        "path",
        F.lit("python").alias("language"),
        F.col("line").cast("long").alias("line"),
        F.concat(F.lit("py_"), F.col("name")).alias("rule_id"),
        F.concat(F.lit(rules.PYTHON_CALL_ISSUE), F.col("name")).alias("issue"),
        F.lit(rules.SEVERITY).alias("severity"),
        F.lit(None).cast("string").alias("code"),
    )


def import_edges(facts: DataFrame) -> DataFrame:
    """Distinct dependencies per file (made distinct where the file is parsed)."""
    return facts.filter("fact = 'depends_on'").select(
        "repo_id", "path", F.lit("python").alias("language"), F.col("name").alias("target")
    )
