"""Line dedup: lines that many documents share stay in one of them only.  Built-in
expressions only.

Texts are exploded into lines; a line's *key* is the line without blanks at its
ends, A-Z lower-cased.  Keys meet by 128 bits of hash.  The distinct documents of
a key are counted in two steps, first by (key, document), so a line that a third
of all documents hold is no hot spot.  Keys over the threshold return to their
lines: the most frequent ones, of a bounded number, by broadcast, the others by a
join in which no key has many rows.  What comes back to a document are the
positions of the lines it loses, and its text is joined anew from the slices
between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tables import same, stored, text_name, without_places

#: Code points of the shortest key, and documents from which on a key is common.
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Keys that are broadcast at most: those of more lines than this share of all,
#: and than ``HOT_LINES``.
BROADCAST_KEYS = 50_000
HOT_LINES = 1_000

_BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NAME = ("doc_id", "t1", "t2")


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _named(docs: DataFrame) -> DataFrame:
    """``row`` with the name of its text: equal rows have one name and one result."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.select(
        "row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), *text_name(F.col("row.text"))
    )


def _keys(named: DataFrame, least_chars: int) -> DataFrame:
    """``doc_id, t1, t2, place, h1, h2``: one row for each line with a key long enough."""
    # The outer form: for the plain one Catalyst infers a filter that splits twice.
    each = named.select(*_NAME, F.posexplode_outer(lines(F.col("text"))).alias("place", "line"))
    bare = each.select(*_NAME, "place", F.btrim("line", F.lit(_BLANKS)).alias("line"))
    lowered = F.translate("line", _UPPER, _UPPER.lower())
    return bare.where(F.char_length("line") >= least_chars).select(*_NAME, "place", *text_name(lowered, ("h1", "h2")))


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, t1, t2, places``: ascending places (from 0) of the lines that a
    document loses; ``t1, t2`` are hashes of its text.  Documents that lose none
    have no row, and equal rows of ``docs`` have one."""
    keys = stored(_keys(_named(docs), least_chars), "line-keys")
    # Rows with one ``doc_id`` are one document, and so are those without.
    common = stored(
        keys.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("docs") >= least_docs).drop("docs"),
        "common-lines",
    )
    total = common.agg(F.sum("n")).first()[0] or 0
    # Fewer than BROADCAST_KEYS keys can have more lines than this.
    limit = max(HOT_LINES, total // BROADCAST_KEYS)
    hot, usual = (common.where(c).drop("n") for c in (F.col("n") > limit, F.col("n") <= limit))
    found = keys.join(F.broadcast(hot), ["h1", "h2"]).unionByName(keys.join(usual, ["h1", "h2"]))
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy(*_NAME).agg(F.array_sort(F.collect_set("place")).alias("places"))


def _without(text: Column, places: Column) -> Column:
    """``text`` without the lines at the ascending ``places``."""
    # The lines are bound to a name, so that they are split once for each text.
    kept = F.transform(F.array(lines(text)), lambda every: F.array_join(without_places(every, places), "\n"))
    return F.get(kept, F.lit(0))


def _cleaned(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``row, places, kept``; ``places`` is null and ``kept`` the text where no line goes."""
    rows, lost = _named(docs), dropped_lines(docs, least_chars, least_docs)
    joined = rows.join(lost, same(rows, lost, *_NAME), "left").select("row", rows["text"], "places")
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(_without(F.col("text"), F.col("places")))
    return joined.select("row", "places", kept.alias("kept"))


def report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped, kept`` of every row of ``docs``.

    A key of at least ``least_chars`` code points that at least ``least_docs``
    documents hold loses all its lines but those in the largest ``doc_id`` that
    holds it.  Rows that share a ``doc_id`` are one document, as are all rows
    without one, which is smaller than any other; each row keeps its own result.
    A null or empty text is one empty line.  ``dropped`` are the places of the
    lines that go, ``kept`` the other lines joined by ``\\n``.  Other columns are
    ignored; an empty table gives an empty table.
    """
    found = _cleaned(docs.select("doc_id", "text"), least_chars, least_docs)
    places = F.coalesce("places", F.array().cast("array<int>"))
    n_lines = F.char_length("row.text") - F.char_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"),
        F.size(places).cast("long").alias("n_dropped"), places.alias("dropped"), "kept",
    )


def without_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the texts that :func:`report` keeps; all rows and other columns
    stay, whatever their names.  ``n_chars``, if there, follows the text."""
    found = _cleaned(docs, least_chars, least_docs)
    changed = F.col("places").isNotNull()
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == "text":
            value = F.when(changed, F.col("kept")).otherwise(value)
        elif name == "n_chars":
            value = F.when(changed, F.char_length("kept")).otherwise(value).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return found.select(*columns)
