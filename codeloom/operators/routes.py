"""Called paths and the parameterised routes that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.arrays import unnest
from codeloom.session import written

#: Kinds of a step, from the most to the least specific; the names stand in patterns.
STEPS = ("", "{int}", "{}", "{*}")


def _called_path(text: Column) -> Column:
    """The path of a call: no host, quotes, query or end slash."""
    path = F.regexp_replace(F.translate(text, "'\"`", ""), r"^[^/]*", "")
    return F.regexp_replace(path, r"[?#].*$|/+$", "")


def _defined_path(text: Column) -> Column:
    """The path of a definition: no verb, quotes or end slash, one slash in front.

    A ``?`` stays, as it marks a parameter that may be left out.
    """
    path = F.regexp_replace(F.translate(text, "'\"`", ""), r"^(?i)(GET|POST|PUT|DELETE|PATCH)\s+", "")
    return F.concat(F.lit("/"), F.regexp_replace(path, r"^/+|/+$", ""))


def _steps(path: Column) -> Column:
    """The segments of a path, without the empty one before the first slash."""
    return F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))


def _step(segment: Column, last: Column) -> Column:
    """What a segment of a definition stands for: its text or a kind of ``STEPS``."""
    return (
        F.when(last & segment.rlike(r"^(\{\*.*\}|<path:\w+>|\*.*|:\w+[*+])$"), STEPS[3])
        .when(segment.rlike(r"^(<int:\w+>|\{\w+:int\??\})$"), STEPS[1])
        .when(segment.rlike(r"^:\w|^\*|<\w+(:\w+)?>|\{.*\}"), STEPS[2])
        .otherwise(segment)
    )


def _patterns(path: Column) -> Column:
    """The patterns of a defined path as arrays of steps; two if its end may be left out."""
    segments = _steps(path)
    steps = F.transform(segments, lambda s, i: _step(s, i == F.size(segments) - 1))
    optional = path.rlike(r"/(:\w+|\{[\w:]+)\?\}?$")
    return F.when(optional, F.array(steps, F.slice(steps, 1, F.size(steps) - 1))).otherwise(F.array(steps))


def route_definitions(routes: DataFrame) -> DataFrame:
    """``repo_id, source_file, called, pattern``, once per file: the definitions.

    ``pattern`` is an array of steps, ``called`` the path as a call would read it.
    """
    found = unnest(
        routes, ["repo_id", "source_file", _called_path(F.col("route")).alias("called")],
        _patterns(_defined_path(F.col("route"))), "pattern",
    )
    return found.distinct()


def _trie(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``repo_id, level, node, step, next`` and leaves ``repo_id, node, definitions``.

    A node is named by the pattern up to it, so equal beginnings are one row; its level is
    the number of its steps.
    """
    def prefix(length: Column) -> Column:
        return F.array_join(F.transform(F.slice(F.col("pattern"), 1, length), lambda s: F.concat(F.lit("/"), s)), "")

    whole = F.size("pattern")
    ends = definitions.groupBy("repo_id", "pattern").agg(F.count_distinct("source_file").alias("definitions"))
    # The root path has no step and is its own node.
    places = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    at = F.transform(
        places,
        lambda i: F.struct(
            (i - 1).alias("level"), prefix(i - 1).alias("node"), F.get(F.col("pattern"), i - 1).alias("step"), prefix(i).alias("next")
        ),
    )
    edges = ends.select("repo_id", F.inline(at)).distinct()
    return edges, ends.select("repo_id", prefix(whole).alias("node"), "definitions")


def route_matches(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The most specific route that answers each called path of a repository.

    One row per (repository, path) that a route answers: ``pattern`` with ``{}`` for a
    parameter, ``{int}`` for one of digits and ``{*}`` for the rest of a path, the
    number of ``parameters``, of files that call (``callers``) and of files that define
    the pattern (``definitions``).

    Read from the left, a text goes before ``{int}``, that before ``{}`` and that before
    ``{*}``.  A segment of a call with a value filled in later (``${id}``, ``{id}``,
    ``%s``) is answered by parameters only.  A parameter at the end that may be left out
    gives two patterns.  A file does not call what it defines.  The root path is
    answered by nothing, as its calls name no path.

    The patterns are a trie, stored as a table of edges; the calls walk it together, a
    join for each level, and take the edge of their text and those of parameters.  Paths
    that many files call walk once.  A level's join reads the edges of that level only.  An
    edge that most calls take is one key of one row, so the calls at it can be split by
    AQE.  Edges and leaves are merged and never broadcast: their stored size, by which Spark
    would choose, is a small part of their size in memory.  There are as many rounds as
    the longest pattern has steps.
    """
    definitions = route_definitions(routes)
    edges, leaves = _trie(definitions)
    edges, leaves = written(edges), written(leaves)
    calls = (
        endpoints.select("repo_id", "source_file", _called_path(F.col("endpoint")).alias("called"))
        .where("called <> ''").distinct()
        .join(definitions.select("repo_id", "source_file", "called").distinct(), ["repo_id", "source_file", "called"], "left_anti")
        .groupBy("repo_id", F.col("called").alias("route")).agg(F.count("*").alias("callers"))
    )
    state = written(
        calls.select(
            "repo_id", "route", "callers", _steps(F.col("route")).alias("rest"), F.lit("").alias("node"), F.lit("").alias("rank"),
        )
    )
    segment = F.get("rest", F.lit(0))
    later = segment.rlike(r"\{|^%[sdv]$")
    tried = F.array_compact(
        F.array(
            F.when(~later, F.struct(segment.alias("step"), F.lit("0").alias("kind"))),
            F.when(later | segment.rlike("^[0-9]+$"), F.struct(F.lit(STEPS[1]).alias("step"), F.lit("1").alias("kind"))),
            F.when(segment != "", F.struct(F.lit(STEPS[2]).alias("step"), F.lit("2").alias("kind"))),
            F.struct(F.lit(STEPS[3]).alias("step"), F.lit("3").alias("kind")),
        )
    )
    done = []
    while True:
        open_ = state.where(F.size("rest") > 0)
        done.append(state.where(F.size("rest") == 0))
        if open_.isEmpty():
            break
        ahead = edges.where(F.col("level") == len(done) - 1).drop("level").hint("merge")
        kept = ["repo_id", "route", "callers", "rest", "node", "rank"]
        state = written(
            open_.select(*kept, F.inline(tried)).join(ahead, ["repo_id", "node", "step"]).select(
                "repo_id", "route", "callers",
                F.when(F.col("kind") == "3", F.array().cast("array<string>"))
                .otherwise(F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))).alias("rest"),
                F.col("next").alias("node"), F.concat("rank", "kind").alias("rank"),
            )
        )
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    # An end inside the trie is no answer; among the others the best rank is one node.
    return (
        ended.join(leaves.hint("merge"), ["repo_id", "node"])
        .groupBy("repo_id", "route").agg(F.min(F.struct("rank", "node", "callers", "definitions")).alias("best"))
        .select(
            "repo_id", "route", F.col("best.node").alias("pattern"),
            F.char_length(F.translate("best.rank", "0", "")).cast("long").alias("parameters"),
            F.col("best.callers").alias("callers"), F.col("best.definitions").alias("definitions"),
        )
    )
