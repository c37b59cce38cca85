"""Benchmark decontamination by a broadcast hash set of test n-grams.

Built-in expressions only.  A task splits each text once, hashes its windows, looks
each up in the broadcast sets, one for each length of windows, and compares the
words of what it finds.  What leaves the task, into a stored table, is one row for
each text and one for each occurrence; texts are not shuffled.  The items of a
window are joined to the occurrences, they are not broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tables import same, stored, text_name, without_places

#: Words of a window.
WINDOW = 10
#: Windows in one broadcast set.  A larger benchmark is looked up in parts, one
#: pass over the documents for each.
SET_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MIXED_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MIXED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BREAK), "")


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    """``item_id, length, window, phrase`` of all windows of all items."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words"))
    length = F.least(F.size("words"), F.lit(size))
    starts = F.when(length > 0, F.sequence(F.lit(1), F.size("words") - length + 1))
    each = items.select("item_id", "words", length.alias("length"), F.explode(starts).alias("start"))
    window = each.select("item_id", "length", F.slice("words", F.col("start"), F.col("length")).alias("window"))
    return window.withColumn("phrase", F.array_join("window", " "))


def _hash(hashed: Column, length: int, first: Column | int = 0) -> Column:
    """The hash of ``length`` elements of an array of word hashes."""
    return F.xxhash64(*[F.get(hashed, F.lit(first) + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``length, hash, phrase``: each distinct window once."""
    phrase = _items(benchmark, size).groupBy("length", "phrase").agg(F.min("window").alias("window"))
    hashed = phrase.select("length", "phrase", F.transform("window", lambda w: F.xxhash64(w)).alias("hashed"))
    by_length = F.coalesce(*[F.when(F.col("length") == n, _hash(F.col("hashed"), n)) for n in range(1, size + 1)])
    return hashed.select("length", by_length.alias("hash"), "phrase")


_NAME = ("doc_id", "t1", "t2")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, t1, t2, n_words, place, length, phrase``, stored: for each row of
    ``docs`` one without ``place``, and one for each occurrence of a window.

    ``t1, t2`` are hashes of the text; ``place`` and ``length`` are in words.
    """
    windows = benchmark_windows(benchmark, size)
    # At most ``size`` rows.
    counts = {row["length"]: row["n"] for row in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Passes over the documents: the sets of a pass hold SET_ROWS windows at most.
    parts = max(1, -(-sum(counts.values()) // SET_ROWS))
    split = docs.select("doc_id", *text_name(F.col("text")), words(F.col("text")).alias("words"))
    hashed = split.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    # The outer form: for the plain one Catalyst infers a filter that hashes all words twice.
    each = hashed.select(
        *_NAME, "words", F.size("words").cast("long").alias("n_words"), "hashed", F.posexplode_outer("hashed").alias("at", "h")
    ).drop("h")
    found = None
    for part in range(parts):
        rows, matches = each, []
        for length in sorted(counts):
            wanted = windows.where((F.col("length") == length) & (F.pmod("hash", F.lit(parts)) == part)).select(
                F.col("hash").alias(f"hash{length}"), F.col("phrase").alias(f"phrase{length}")
            )
            # The places are rows, so this is generated code.
            own = F.when(F.col("at") + length <= F.col("n_words"), _hash(F.col("hashed"), length, F.col("at")))
            seen = F.array_join(F.slice("words", F.col("at") + 1, F.lit(length)), " ")
            rows = rows.withColumn("own", own).join(
                F.broadcast(wanted), (F.col("own") == F.col(f"hash{length}")) & (seen == F.col(f"phrase{length}")), "left"
            )
            matches.append(F.struct(F.lit(length).alias("length"), F.col(f"phrase{length}").alias("phrase")))
        # One row of a text says how many words it has.
        first = F.lit(part == 0) & (F.coalesce("at", F.lit(0)) == 0)
        hit = F.coalesce(*[m["phrase"] for m in matches], F.lit(None).cast("string")).isNotNull()
        kept = rows.where(first | hit).select(
            *_NAME, "n_words", "at", first.alias("first"),
            F.filter(F.array(*matches), lambda m: m["phrase"].isNotNull()).alias("matches") if matches
            else F.array().cast("array<struct<length:int,phrase:string>>").alias("matches"),
        )
        found = kept if found is None else found.unionByName(kept)
    kept = stored(found, "occurrences")
    of_text = kept.where("first").select(
        *_NAME, "n_words", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("length"),
        F.lit(None).cast("string").alias("phrase"),
    )
    each = kept.select(*_NAME, "n_words", "at", F.explode("matches").alias("match"))
    return of_text.unionByName(
        each.select(*_NAME, "n_words", F.col("at").alias("place"), "match.length", "match.phrase")
    )


def _spans(found: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, n_words, rows, spans``: equal rows of the documents as one."""
    return found.groupBy(*_NAME).agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("place").isNull()).alias("rows"),
        # Equal rows find the same; a struct without place is no occurrence.
        F.collect_set(F.when(F.col("place").isNotNull(), F.struct("place", "length"))).alias("spans"),
    )


def hit_places(spans: Column) -> Column:
    """The ascending word places inside the spans; none for null."""
    each = F.transform(spans, lambda s: F.sequence(s["place"], s["place"] + s["length"] - 1))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(each))), F.array().cast("array<int>"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` of every row of ``docs``.

    A window is ``size`` consecutive words of an item; an item of fewer words is
    one window; one without words, or null, has none.  A null or empty document
    has no words.  Rows with a null or repeated ``doc_id`` keep their own result.
    """
    found = occurrences(docs, benchmark, size)
    rows = _spans(found)
    hit = found.where(F.col("place").isNotNull()).select(*_NAME, "length", "phrase").distinct()
    named = hit.join(_items(benchmark, size).select("item_id", "length", "phrase").distinct(), ["length", "phrase"])
    items = named.groupBy(*_NAME).agg(F.collect_set("item_id").alias("items"))
    joined = rows.join(items, same(rows, items, *_NAME), "left").select(
        rows["doc_id"], "n_words", "rows", F.size(hit_places(F.col("spans"))).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")
    return joined.select("doc_id", "n_words", "n_hit", "items", copies).drop("copy")


def without_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the words inside an occurrence.

    A hit word goes with the signs before it.  Documents of which no word is
    left go; all others, those without words included, stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), *text_name(F.col("row.text"))
    )
    found = _spans(occurrences(docs, benchmark, size).where(F.col("place").isNotNull()))
    joined = rows.join(found, same(rows, found, *_NAME), "left")
    text = F.col("row.text")
    parts = joined.select(
        "row", "spans",
        hit_places(F.col("spans")).alias("hit"),
        F.when(F.col("spans").isNotNull(), F.array_remove(F.split(text, _MIXED_BREAK), "")).alias("found_words"),
        F.when(F.col("spans").isNotNull(), F.split(text, _MIXED_WORD)).alias("gaps"),
    )
    shown = F.zip_with(F.slice("gaps", F.lit(1), F.size("found_words")), "found_words", lambda gap, w: F.concat(gap, w))
    # Bound to a name, so that the words are joined with their signs once for each text.
    kept = F.transform(F.array(shown), lambda each: F.array_join(without_places(each, F.col("hit")), ""))
    cleaned = F.concat(F.get(kept, F.lit(0)), F.element_at("gaps", -1))
    left = parts.where(F.col("spans").isNull() | (F.size("hit") < F.size("found_words")))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cleaned)
    columns = [
        text.alias(c) if c == "text"
        else F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text))
        .cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return left.select(*columns)
