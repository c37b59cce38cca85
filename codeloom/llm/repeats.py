"""Repeated passages: exact removal of every byte of a string of ``length`` bytes
that occurs more than once.

The work is dealt by content.  Of the 32-byte grams in a window of ``length``
bytes, the one with the smallest hash is the *anchor* of the window; equal
windows have equal anchors at equal distances.  The windows with one anchor form
a *piece* of text, all of them different.  Anchors whose hash occurs once can hold
no repeat and drop out after a count; the pieces of the others meet by the hash,
equal pieces as one with a weight.  Where all pieces of an anchor are equal, their
windows are repeated and there is nothing to tell apart.

A repeated window shares more than its anchor: all windows that begin far before
it share the bytes on its left, the others those on its right.  A piece is cut to
the half whose bytes another piece shares.

What is left meets in a sort: the suffixes of the pieces are sorted to a depth of ``length`` bytes, which
gives a Burrows-Wheeler transform.  Common prefixes between neighbours follow by
breadth-first backward extension: starting with the intervals of 16 bytes, which the
sort has told apart, each interval is extended to the left by every byte before its suffixes; the end
of an extended interval that no shorter string has marked is a place where the
common prefix has the length of the interval's string.  Intervals come by
increasing length and the search stops at ``length``.  Neighbours not marked by
then share ``length`` bytes, so a run of them is one repeated window.

A hash with very many different pieces is split: its windows become pieces of
their own, dealt by their content.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.bytewise import SpanHasher, chunks, expand, mix
from codeloom.llm.groups import whole_groups
from codeloom.llm.tables import text_name

#: Bytes of a gram.
GRAM = 32
#: Bytes of the shortest prefixes that the search for longer ones begins with.
_SEED = 16
#: Bytes of pieces that are compared at a time.
SORT_BYTES = 1 << 19
#: Different pieces of one anchor that are sorted together.
ANCHOR_PIECES = 16_384
#: Bytes of text taken at a time, also of a long one: few enough for the arrays to
#: stay in a core's cache; bits for a place in up to twice as many and more.
_SEGMENT = 1 << 16
_PLACES_MASK = np.uint64((1 << 23) - 1)
_GRAM_STEP = np.uint64(0x9E3779B97F4A7C15)
_NAME = ("id", "check")

# ------------------------------------------------------------------- anchors


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 32-byte grams that start at each byte but the last 31."""
    value, step, size = data.astype(np.uint64) + np.uint64(1), _GRAM_STEP, 1
    while size < GRAM:
        value = value[: len(value) - size] * step + value[size:]
        size *= 2
        with np.errstate(over="ignore"):
            step = step * step
    # The upper bits of the sums depend on all bytes; the anchors compare these.
    return (value ^ (value >> np.uint64(29))) * _GRAM_STEP


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``: of two halves that may overlap."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``row, start, windows, anchor`` of all runs of windows with one anchor.

    ``start`` is a byte of ``data``; ``anchor`` is a hash of the anchor's gram.
    """
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    grams = _gram_hashes(data)
    # The upper bits of the hash decide; of equal ones the rightmost gram.
    least = _window_minima((grams & ~_PLACES_MASK) | _backwards(len(grams)), length - GRAM + 1)
    # Runs of windows with one anchor, apart for each text; windows that would go
    # on into the next text are runs of their own.
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    for edge in (offsets[:-1], offsets[1:] - length + 1):
        new[edge[(edge >= 0) & (edge < len(new))]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(new)))
    row = np.searchsorted(offsets, start, side="right") - 1
    own = start + length <= offsets[row + 1]
    start, count, row = start[own], count[own], row[own]
    anchor = (_PLACES_MASK - (least[start] & _PLACES_MASK)).astype(np.int64)
    return row, start, count, grams[anchor]


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``row, start, windows, anchor, piece`` of all runs of windows with one anchor.

    ``start`` is a byte in the text; ``anchor`` and ``piece`` are hashes of the
    anchor's gram and of all bytes of the run.
    """
    row, start, count, anchor = anchored(data, offsets, length)
    if not len(start):
        return row, start, count, anchor, np.zeros(0, dtype=np.uint64)
    content = SpanHasher(data)(start, start + count + length - 1)
    return row, start - offsets[row], count, anchor, content


def _backwards(size: int) -> np.ndarray:
    return _backwards_from(1 << (size - 1).bit_length())[:size]


@functools.lru_cache(maxsize=2)
def _backwards_from(size: int) -> np.ndarray:
    return _PLACES_MASK - np.arange(size, dtype=np.uint64)


def _segments(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte, bytes, offsets): chunks, with a longer text cut into
    parts that overlap by a window less a byte."""
    for first, data, offsets in chunks(column, _SEGMENT):
        if len(offsets) > 2 or len(data) <= 2 * _SEGMENT:
            yield first, 0, data, offsets
            continue
        for at in range(0, len(data) - length + 1, _SEGMENT):
            part = data[at : at + _SEGMENT + length - 1]
            yield first, at, part, np.array([0, len(part)])


#: ``place`` holds the first byte of a piece and, in the low 8 bits, its windows.
#: Without nulls, so that no branch of the plan filters them and all share a shuffle.
_PLACES = "anchor long not null, piece long not null, id long not null, check long not null, place long not null"


def _places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, at, data, offsets in _segments(batch.column(2), length):
            row, start, count, anchor, piece = pieces(data, offsets, length)
            rows = pa.array(row + first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(piece.view(np.int64)),
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array((start + at) << 8 | count),
                ],
                names=[x.split()[0] for x in _PLACES.split(", ")],
            )


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in _segments(batch.column(0), length):
            anchor, count = np.unique(anchored(data, offsets, length)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count)], names=["anchor", "n"])


# ------------------------------------------------------- suffixes and intervals


def _sorted_places(key: np.ndarray, bits: int, place_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of ``key``, equal keys by place, and where a new key begins.

    Sorting numbers that hold key and place is much faster than an indirect sort.
    """
    if bits + place_bits <= 64:
        packed = np.sort(key << np.uint64(place_bits) | np.arange(len(key), dtype=np.uint64))
        order = (packed & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        ordered = packed >> np.uint64(place_bits)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, new


def _suffix_order(symbols: np.ndarray, rest: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``order, new, near``: suffixes sorted by their first ``depth`` symbols or more,
    by doubling; where one differs from the one before in the first ``_SEED``
    symbols; and where it does so in the last of these only.

    ``rest`` is the number of symbols to the end of the piece, which ends a suffix.
    """
    size = len(symbols)
    bits = max(int(size + 1).bit_length(), 1)
    key, known = np.zeros(size, dtype=np.uint64), 4
    for k in range(known):
        part = np.zeros(size, dtype=np.uint64)
        part[: max(size - k, 0)] = symbols[k:]
        part[rest <= k] = 0
        key = key << np.uint64(9) | part
    order, new = _sorted_places(key, 9 * known, bits)
    names: dict[int, np.ndarray] = {}
    while True:
        rank = np.empty(size, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        if known in (_SEED // 2, _SEED):
            names[known] = rank
        if known >= depth or (known >= _SEED and new.all()):
            break
        later = np.zeros(size, dtype=np.uint64)
        later[: max(size - known, 0)] = rank[known:]
        later[rest <= known] = 0
        order, new = _sorted_places(rank << np.uint64(bits) | later, 2 * bits, bits)
        known *= 2
    whole, half, shift = names[_SEED][order], names[_SEED // 2], _SEED // 2 - 1
    differs = np.ones(size, dtype=bool)
    differs[1:] = whole[1:] != whole[:-1]
    first, second = half[order], np.append(half[shift:], np.zeros(shift, dtype=np.uint64))[order]
    full = rest[order] >= _SEED
    near = np.zeros(size, dtype=bool)
    near[1:] = differs[1:] & (first[1:] == first[:-1]) & (second[1:] == second[:-1]) & full[1:] & full[:-1]
    return order, differs, near


def repeat_classes(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``order, new``: suffixes of at least ``length`` bytes in order, and where
    one differs from the one before in the first ``length`` bytes.

    ``text`` holds the pieces one after the other; piece ``i`` ends at ``ends[i]``;
    ``length`` is above ``_SEED``.
    """
    size = len(text)
    symbols = text.astype(np.uint64) + np.uint64(1)
    starts = np.concatenate(([0], ends[:-1]))
    rest = np.repeat(ends, ends - starts) - np.arange(size)
    order, differs, near = _suffix_order(symbols, rest, length)
    place = np.empty(size, dtype=np.int64)
    place[order] = np.arange(size)
    # The transform: the byte before each suffix, and the place of the suffix
    # that begins with it; a suffix that begins a piece has none.
    previous = np.full(size, -1, dtype=np.int64)
    previous[1:] = place[:-1]
    previous[starts[starts < size]] = -1
    step = previous[order]
    first_byte = text[order]

    # The sort tells apart all prefixes of fewer than _SEED bytes.  The search
    # begins with the intervals of _SEED bytes that end where the common prefix is
    # one byte shorter, and goes on by one byte a level.
    marked = np.append(differs, True)
    highs = np.flatnonzero(near)
    begins = np.flatnonzero(differs)
    lows = begins[np.searchsorted(begins, highs) - 1] if len(highs) else highs
    for _ in range(_SEED, length):
        # All suffixes of the intervals at hand, moved one byte to the left.
        which = np.repeat(np.arange(len(lows)), highs - lows)
        target = step[expand(lows, highs - lows)]
        has = target >= 0
        target, which = target[has], which[has]
        if not len(target):
            break
        packed = np.sort(target.astype(np.uint64) << np.uint64(32) | which.astype(np.uint64))
        target, which = (packed >> np.uint64(32)).astype(np.int64), packed & np.uint64(0xFFFFFFFF)
        # Within an interval the targets with one byte are neighbours.
        byte = first_byte[target]
        begin = np.ones(len(target), dtype=bool)
        begin[1:] = (which[1:] != which[:-1]) | (byte[1:] != byte[:-1])
        low = target[begin]
        high = target[np.append(np.flatnonzero(begin)[1:] - 1, len(target) - 1)] + 1
        fresh = ~marked[high]
        lows, highs = low[fresh], high[fresh]
        marked[highs] = True
    chosen = np.flatnonzero(rest[order] >= length)
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = marked[chosen[1:]] | (chosen[1:] != chosen[:-1] + 1)
    return order[chosen], new


def repeated(texts: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``piece, first, last``: the runs of windows that occur more than once in all
    pieces, in the order of these."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    order, new = repeat_classes(text, ends, length)
    alone = new & np.append(new[1:], True)
    flags = np.repeat(weights > 1, sizes)
    # No window starts in the last bytes of a piece, so no run crosses pieces.
    within = np.zeros(len(text), dtype=bool)
    within[order] = ~alone | flags[order]
    first, last = _spans(within)
    piece = np.searchsorted(ends, first, side="right")
    begin = (ends - sizes)[piece]
    return piece, first - begin, last - begin


def _halves(
    text: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, group: np.ndarray, weights: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """``low, high``: the windows of each piece to be compared with those of others.

    Equal windows begin equally far before their anchor.  Those that begin
    ``reach`` bytes before it or more hold these bytes, the others as many after
    it or more.  Where no other piece of the anchor has a half's bytes, its windows
    occur as often as the piece does; where all that have them weigh more than one,
    that is known too.  Unequal bytes with equal hashes are compared in vain.
    """
    ends = np.cumsum(sizes)
    windows = sizes - (length - 1)
    grams = _gram_hashes(text)
    hits = np.flatnonzero(grams == np.repeat(anchors.view(np.uint64), sizes)[: len(grams)])
    owner = np.searchsorted(ends, hits, side="right")
    inside = hits + GRAM <= ends[owner]
    # The anchor is the last gram with its hash: an earlier one was not chosen.
    place = np.full(len(sizes), -1, dtype=np.int64)
    place[owner[inside]] = hits[inside]
    found = np.flatnonzero(place >= 0)
    reach = (length - GRAM) // 2
    # Names that are no gram of the piece leave all its windows on one side.
    left = windows.copy()
    left[found] = np.clip(place[found] - (ends - sizes)[found] - reach + 1, 0, windows[found])
    low, high = left.copy(), left.copy()
    for side, offsets in ((low, range(-reach, 0, GRAM)), (high, range(length + 1 - reach - GRAM, 0, -GRAM))):
        own = left > 0 if side is low else left < windows
        key = group.astype(np.uint64) + np.uint64(1)
        hashed = np.flatnonzero(own & (place >= 0))
        for offset in offsets:
            key[hashed] = mix(key[hashed]) + grams[place[hashed] + offset]
        own = np.flatnonzero(own)
        _, which, count = np.unique(key[own], return_inverse=True, return_counts=True)
        light = np.bincount(which[weights[own] == 1], minlength=len(count)) > 0
        needed = own[(light & (count > 1))[which]]
        side[needed] = 0 if side is low else windows[needed]
    return low, high


def _repeats_of_groups(
    texts: list[bytes], anchors: np.ndarray, group: np.ndarray, weights: np.ndarray, length: int
) -> tuple[np.ndarray, ...]:
    """``piece, first, last``: the runs of windows that occur more than once, by piece."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    low, high = _halves(np.frombuffer(b"".join(texts), dtype=np.uint8), sizes, anchors, group, weights, length)
    # All windows of a piece that occurs more than once do.
    heavy = np.flatnonzero(weights > 1)
    runs = [(heavy, np.zeros(len(heavy), dtype=np.int64), sizes[heavy] - (length - 1))]
    compared = np.flatnonzero(low < high)
    if len(compared):
        bounds = zip(compared.tolist(), low[compared].tolist(), high[compared].tolist(), strict=True)
        parts = [texts[k][a : b + length - 1] for k, a, b in bounds]
        piece, first, last = repeated(parts, weights[compared], length)
        piece = compared[piece]
        light = weights[piece] == 1
        runs.append((piece[light], (first + low[piece])[light], (last + low[piece])[light]))
    piece, first, last = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(piece, kind="stable")
    return piece[order], first[order], last[order]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_RUNS = "anchor long not null, piece long not null, runs array<struct<first:int,last:int>>"


def _repeated_pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_groups(batches, 1):
        # Equal rows of the input give a piece twice.
        anchors, names = (table.column(k).to_numpy() for k in (0, 1))
        once = np.ones(len(names), dtype=bool)
        once[1:] = (anchors[1:] != anchors[:-1]) | (names[1:] != names[:-1])
        starts = np.concatenate(([0], np.cumsum(once)))[starts]
        anchors, names, weights = anchors[once], names[once], table.column(2).to_numpy()[once]
        texts = table.column(3).take(pa.array(np.flatnonzero(once))).to_pylist()
        sizes = np.cumsum([0, *map(len, texts)])[starts]
        at = 0
        while at < len(starts) - 1:
            # As many whole groups as the limit allows, one at least.
            upto = int(np.searchsorted(sizes, sizes[at] + SORT_BYTES, side="right")) - 1
            upto = min(max(upto, at + 1), len(starts) - 1)
            first, last = starts[at], starts[upto]
            group = np.repeat(np.arange(upto - at), np.diff(starts[at : upto + 1]))
            found, *ends = _repeats_of_groups(
                texts[first:last], anchors[first:last], group, weights[first:last], length
            )
            if len(found):
                kept, counts = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors[first:last][kept]),
                        pa.array(names[first:last][kept]),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)),
                            pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in ends], names=["first", "last"]),
                        ),
                    ],
                    names=["anchor", "piece", "runs"],
                )
            at = upto


# -------------------------------------------------------------------- documents

_CUT = (
    "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, "
    "kept_sha256 string, kept binary"
)


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the windows that start in the runs."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        size, removed, spans, digest, kept = [], [], [], [], []
        texts = batch.column(1).cast(pa.large_binary())
        for text, firsts, lasts in zip(texts, batch.column(2), batch.column(3), strict=True):
            data = text.as_py() or b""
            size.append(len(data))
            if not firsts.is_valid:
                removed.append(0)
                spans.append([])
                digest.append(hashlib.sha256(data).hexdigest())
                kept.append(None)
                continue
            mark = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(mark, firsts.values.to_numpy(), 1)
            np.add.at(mark, lasts.values.to_numpy() + length - 1, -1)
            begin, end = _spans(np.cumsum(mark[:-1]) > 0)
            edges = [0, *np.stack((begin, end), axis=1).ravel().tolist(), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(data) - len(left))
            spans.append([{"first": a, "last": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left if with_bytes else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(size, type=pa.int64()), pa.array(removed, type=pa.int64()),
                pa.array(spans, type=kind), pa.array(digest, type=pa.string()), pa.array(kept, type=pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
        )


#: The upper 16 bits of a number.
_UPPER_BITS = -(1 << 48)


def _texts(docs: DataFrame) -> DataFrame:
    """``id, check, text``: ``id, check`` name a text and are never null.

    Texts of one ``doc_id`` are told apart by 79 bits of hash, 16 of them in ``id``,
    and texts without one by 127: a name is in every place, so its bytes count.
    The lowest bit of ``check`` says that there is no ``doc_id``.
    """
    check, other = text_name(F.col("text"), ("check", "other"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", check, other)
    spread = F.col("doc_id").bitwiseXOR(F.col("other").bitwiseAND(F.lit(_UPPER_BITS)))
    marked = F.col("check").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return named.select(F.coalesce(spread, F.col("other")).alias("id"), marked.alias("check"), "text")


def _doc_id() -> Column:
    """The ``doc_id`` in the name of a text.  It is no column of its own, so that all
    joins use the same columns of the texts and share their shuffle."""
    _, other = text_name(F.col("text"))
    return F.when(
        F.col("check").bitwiseAND(F.lit(1)) == 0, F.col("id").bitwiseXOR(other.bitwiseAND(F.lit(_UPPER_BITS)))
    ).alias("doc_id")


def _contents(texts: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """``anchor, piece, weight, content``: the bytes of pieces, cut from one text each."""
    of_text = distinct.groupBy("at.id", "at.check").agg(
        F.collect_list(F.struct("anchor", "piece", "weight", "at.place")).alias("pieces")
    )
    cut = F.transform(
        "pieces",
        lambda p: F.struct(
            p["anchor"].alias("anchor"), p["piece"].alias("piece"), p["weight"].alias("weight"),
            F.substring(
                F.col("bytes"),
                (F.shiftright(p["place"], 8) + 1).cast("int"),
                (p["place"].bitwiseAND(F.lit(255)) + (length - 1)).cast("int"),
            ).alias("content"),
        ),
    )
    body = texts.join(of_text, list(_NAME))
    return body.withColumn("bytes", F.col("text").cast("binary")).select(F.inline(cut))


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """``id, check, first, last``: runs of starts of repeated windows, by text.

    One lazy plan: the places by anchor and the texts by name are each shuffled
    once and read twice.
    """
    shared = (
        texts.select("text").mapInArrow(lambda b: _anchors(b, length), "anchor long not null, n long not null")
        .groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    )
    found = texts.select(*_NAME, "text").mapInArrow(lambda b: _places(b, length), _PLACES)
    places = found.join(shared, "anchor")
    distinct = places.groupBy("anchor", "piece").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct(*_NAME, "place")).alias("at")
    ).withColumn("different", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
    usual = (
        _contents(texts, distinct.where(F.col("different") <= ANCHOR_PIECES), length)
        .repartition("anchor").sortWithinPartitions("anchor", "piece")
        .mapInArrow(lambda b: _repeated_pieces(b, length), _RUNS)
    )
    # A window of a split anchor is dealt by its content and weighs what all its pieces do.
    split = _contents(texts, distinct.where(F.col("different") > ANCHOR_PIECES), length).dropDuplicates(["anchor", "piece"])
    at = F.posexplode(F.sequence(F.lit(1), F.octet_length("content") - (length - 1))).alias("first", "byte")
    windows = split.select("anchor", "piece", "weight", "content", at)
    windows = windows.select(
        "anchor", "piece", "weight", "first", F.substring("content", F.col("byte"), F.lit(length)).alias("window")
    ).withColumn("name", F.xxhash64("window"))
    often = (
        windows.groupBy("name", "window").agg(F.sum("weight").alias("weight"))
        .select(F.col("name").alias("anchor"), F.lit(0).cast("long").alias("piece"), "weight", "window")
        .repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(lambda b: _repeated_pieces(b, length), _RUNS)
    ).select(F.col("anchor").alias("name"))
    first = F.col("first").cast("int")
    of_split = windows.join(often.distinct(), "name").select(
        "anchor", "piece", F.array(F.struct(first.alias("first"), (first + 1).alias("last"))).alias("runs")
    )
    runs = places.join(usual.unionByName(of_split), ["anchor", "piece"])
    start = F.shiftright("place", 8)
    return runs.select(*_NAME, start.alias("start"), F.explode("runs").alias("run")).select(
        *_NAME, (F.col("start") + F.col("run.first")).alias("first"), (F.col("start") + F.col("run.last")).alias("last")
    )


def without_repeats(docs: DataFrame, length: int = 200, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256, kept`` of every row of ``docs``.

    Every byte inside a string of ``length`` bytes (more than a gram's, at most
    255 more) that also starts elsewhere, in this or another text, goes; strings
    are judged on the input.  ``spans`` are the maximal removed ranges of bytes,
    ``kept`` the remaining bytes (null where nothing was removed, or without
    ``with_bytes``).  A null or short text holds no string.  Equal rows are copies
    of each other; a null ``doc_id`` stays null.  Other columns are ignored.
    """
    if not GRAM <= length < GRAM + 255:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 254}")
    texts = _texts(docs)
    runs = repeated_windows(texts, length).groupBy(*_NAME).agg(
        F.collect_list(F.struct("first", "last")).alias("runs")
    )
    # The same projection of the texts as above, so that its shuffle is read again.
    joined = texts.join(runs, list(_NAME), "left")
    return joined.select(_doc_id(), "text", "runs.first", "runs.last").mapInArrow(
        lambda b: _cut(b, length, with_bytes), _CUT
    )
