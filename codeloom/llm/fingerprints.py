"""Document fingerprints by one-permutation MinHash.  Built-in expressions only.

Each shingle is hashed once; some bits of the hash choose one of ``BINS`` bins
and the rest is its value there, of which a bin keeps the smallest.  An empty
bin takes the value of the first bin that has one in a random order of its own
(optimal densification), so equal sets agree in it and the chance that two sets
agree stays their similarity.  The fingerprint holds the low eight bits of each
bin as two hex digits.  Two different values agree in eight bits by chance once
in 256 times; :func:`likeness` takes that out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a shingle, bins of a fingerprint, and bits kept of each bin.
WORDS = 5
BINS = 128
BITS = 8
#: Rows of a range of the order in :func:`with_next`, and ranges at most.
RANGE_ROWS = 4_000
RANGES = 4096
_BLOCK = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fingerprint(text: str, words: int = WORDS) -> Column:
    """The fingerprint of the column named ``text``, as hex digits.

    Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text of fewer
    than ``words`` words is one shingle; a null or empty text, or one without
    words, has the empty string.
    """
    step = ", ".join(f"get(h, i + {k})" for k in range(words))
    # Bin in the upper bits, value in the lower ones: sorting groups the bins.
    value_bits = 62 - (BINS - 1).bit_length()
    shingles = (
        f"if(size(h) < {words}, if(size(h) = 0, array(), array(xxhash64(h))), "
        f"transform(sequence(0, greatest(size(h) - {words}, 0)), i -> xxhash64({step})))"
    )
    hashed = (
        f"transform(array_remove(split(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), "
        f"'[\\\\x20\\\\x09-\\\\x0D]+'), ''), w -> xxhash64(w))"
    )
    short = "transform(s, x -> shiftrightunsigned(x, 2))"
    least = f"filter(o, (x, i) -> i = 0 OR shiftright(x, {value_bits}) <> shiftright(get(o, i - 1), {value_bits}))"
    # Of the bins that have a value, the first in the order of bin b.
    other = (
        f"array_min(transform(m, x -> named_struct('place', xxhash64(b, shiftright(x, {value_bits})), 'low', x & {2**BITS - 1}))).low"
    )
    own = "element_at(f, b)"
    digits = (
        f"aggregate(sequence(0, {BINS - 1}), '', (t, b) -> concat(t, "
        f"lpad(lower(hex(coalesce({own}, {other}))), {BITS // 4}, '0')))"
    )
    by_bin = f"map_from_arrays(transform(m, x -> cast(shiftright(x, {value_bits}) as int)), transform(m, x -> x & {2**BITS - 1}))"
    sql = _let("h", hashed, _let("s", shingles, _let(
        "o", f"sort_array({short})", _let("m", least, f"if(size(m) = 0, '', {_let('f', by_bin, digits)})")
    )))
    return F.expr(sql)


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the sets of two fingerprints, 0 to 1.

    Two empty fingerprints are alike, an empty and another one are not.
    """
    width = BITS // 4
    places = F.sequence(F.lit(1), F.lit(width * BINS), F.lit(width))
    agree = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(width)) == F.substring(b, i, F.lit(width))))
    chance = 2.0**-BITS
    share = (agree / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share))
    )


def _bounds_from(bounds: list[int], key: Column) -> Column:
    """How many of the descending ``bounds`` are at least ``key``: whole blocks first,
    then one by one in the next block."""

    def at_least(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b >= key))

    every = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    ends = F.array(*[F.lit(b) for b in bounds[_BLOCK - 1 :: _BLOCK]]).cast("array<bigint>")
    before = at_least(ends) * _BLOCK
    return before + at_least(F.slice(every, before + 1, F.lit(_BLOCK)))


def with_next(rows: DataFrame, key: str, values: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(rows)`` with ``next_<value>`` of the row after in descending ``key``;
    the last one's next is the first.

    The order is cut into ranges at quantiles of the key.  Each range is a window
    of its own, to which the first row of the next range is added.  Null keys
    come last; equal keys follow each other by ``values``.
    """
    count = rows.count()
    ranges = max(1, min(RANGES, count // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = []
    if shares:
        found = rows.agg(F.percentile_approx(key, shares, 10 * RANGES)).first()[0]
        bounds = sorted(set(found or []), reverse=True)
    # Ranges in the order of the result: the largest keys first, null last.
    place = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(_bounds_from(bounds, F.col(key)))
    dealt = rows.withColumn("_range", place)
    order = [F.col(key).desc_nulls_last(), *[F.col(v) for v in values]]
    # At most RANGES + 1 rows.
    tops = dealt.groupBy("_range").agg(F.max(key).alias("_top")).select(F.col("_range").alias("_of"), "_top")
    every = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.withColumn("_before", F.coalesce(F.lag("_of").over(Window.orderBy("_of")), F.max("_of").over(every)))
    heads = derive(dealt.join(F.broadcast(tops), (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_top"))))
    least = heads.groupBy("_before", key).agg(F.min(F.struct(*values)).alias("_row"))
    extra = least.select(
        key, *[F.col(f"_row.{v}").alias(v) for v in values], F.col("_before").alias("_range"), F.lit(1).alias("_extra")
    )
    own = derive(dealt).withColumn("_extra", F.lit(0))
    both = own.unionByName(extra, allowMissingColumns=True)
    window = Window.partitionBy("_range").orderBy("_extra", *order)
    found = both.select("*", *[F.lead(v).over(window).alias(f"next_{v}") for v in values])
    return found.where("_extra = 0").drop("_range", "_extra")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with the ``fingerprint`` of each text; ``doc_id`` may be null or repeated."""
    return docs.withColumn("fingerprint", fingerprint("text", words))
