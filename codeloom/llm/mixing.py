"""Mix sources to target weights by nested hash thresholds.

Each document has a 60-bit key, a hash of its id and text.  A source takes the
documents with the lowest keys until its target is met.  The threshold is found
from histograms: sums of sizes by source and the next twelve bits of the key,
then again only inside the bucket on the boundary.  Nothing is sorted and no
task holds more than a histogram.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.tables import ranked, stored

KEY_BITS = 60
LEVEL_BITS = 12
_LAST = (1 << KEY_BITS) - 1


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key() -> Column:
    """The key of a document: the first 60 bits of an MD5 of id and text."""
    digest = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("text")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], multiple: float, most: float) -> DataFrame:
    """``source, source_size, target`` for a table ``source, source_size``.

    Sources in code point order, null last, have ``weights`` in turn and share
    ``multiple`` times all sizes.  No target is above ``most`` times its source;
    the rest is shared by weight.  Each round caps the sources above their
    share at the current rate, until none is.
    """
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    table = ranked(sizes, order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(
        table.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap")),
        "mix-sources",
    )
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(rate) * F.col("weight")
        row = table.agg(
            F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, rate = row[0], (multiple * budget - (row[1] or 0.0)) / row[2]
    return table.select("source", "source_size", F.least("cap", F.lit(rate) * F.col("weight")).alias("target"))


def thresholds(keyed: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """``source, source_size, target, whole, last_key``: a source takes all its
    documents ``whole`` times, and those with a key up to ``last_key`` once more.

    ``keyed`` has ``source, size, key``.  The key at the boundary is taken if
    that brings the sum nearer to the target; equal keys go together.
    """
    times = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    open_ = stored(
        wanted.withColumn("whole", F.least(times, F.lit(math.ceil(most) - 1)))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")),
        "mix-open",
    )
    done = None
    for left in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        limits = open_.select(
            F.col("source").alias("edge_source"), F.col("prefix"), F.col("below"), F.col("budget")
        )
        inside = keyed.join(
            limits,
            F.col("source").eqNullSafe(F.col("edge_source"))
            & (F.shiftright("key", left + LEVEL_BITS) == F.col("prefix")),
        )
        sums = inside.groupBy("edge_source", "below", "budget", F.shiftright("key", left).alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        # At most 2 ** LEVEL_BITS rows for each source.
        running = F.sum("sum").over(Window.partitionBy("edge_source").orderBy("bucket"))
        state = (
            sums.withColumn("until", running)
            .where(F.col("below") + F.col("until") > F.col("budget"))
            .groupBy("edge_source")
            .agg(F.min_by(F.struct("bucket", "sum", "until", "low", "high"), F.col("bucket")).alias("edge"))
        )
        found = open_.join(state, F.col("source").eqNullSafe(F.col("edge_source")), "left")
        at = F.col("below") + F.col("edge.until") - F.col("edge.sum")
        single = F.col("edge.low") == F.col("edge.high")
        takes = 2 * at + F.col("edge.sum") <= 2 * F.col("budget")
        found = stored(
            found.select(
                "source", "source_size", "target", "whole", "budget",
                F.col("edge.bucket").alias("next_prefix"), at.alias("next_below"),
                F.when(F.col("edge").isNull(), F.lit(_LAST))
                .when(single, F.when(takes, F.col("edge.high")).otherwise(F.col("edge.low") - 1))
                .alias("last_key"),
            ),
            "mix-level",
        )
        settled = found.where(F.col("last_key").isNotNull()).select(
            "source", "source_size", "target", "whole", "last_key"
        )
        done = settled if done is None else done.unionByName(settled)
        rest = found.where(F.col("last_key").isNull())
        if rest.isEmpty():
            break
        open_ = rest.select(
            "source", "source_size", "target", "whole", "budget",
            F.col("next_prefix").alias("prefix"), F.col("next_below").alias("below"),
        )
    return done


#: Columns that ``mix`` adds.
ADDED = ("_size", "_source_size", "_target", "_copies")


def _taken(docs: DataFrame, weights: tuple[float, ...], multiple: float, most: float) -> DataFrame:
    """``row`` with all columns of ``docs``, and the columns of the mix beside it."""
    sized = docs.select(F.struct("*").alias("row"), F.col("source"), words(F.col("text")).alias("size"), key().alias("key"))
    keyed = stored(sized.select("source", "size", "key"), "mix-keys")
    sums = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = thresholds(keyed, targets(sums, weights, multiple, most), most).select(
        F.col("source").alias("limited"), "source_size", "target", "whole", "last_key"
    )
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("limited")))
    copies = F.col("whole") + (F.col("key") <= F.col("last_key")).cast("long")
    return joined.select(
        "row", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), copies.cast("int").alias("_copies"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    multiple: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _copies``.

    ``_copies`` says how often the mix takes a row: at most ``most`` rounded up,
    and by nested thresholds, so a row taken twice was taken once before others
    of its source.  A null source is a source of its own; a null text has size 0.
    Equal rows have equal keys and are taken together.  A single source is near
    its target by half the size of the document at the boundary.  Reruns agree,
    as keys depend on the rows alone.  Other columns of ``docs`` are kept, whatever
    their names; those named like an added column give way to it.
    """
    kept = [F.col("row").getField(name).alias(name) for name in docs.columns if name.lower() not in ADDED]
    return _taken(docs, weights, multiple, most).select(*kept, *ADDED)


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    multiple: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The rows that the mix takes, repeated as often as it takes them, with all columns
    of ``docs`` as they were, also those named like a column that ``mix`` adds."""
    taken = _taken(docs, weights, multiple, most).where(F.col("_copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
