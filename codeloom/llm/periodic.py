"""Periodic runs of words, found in a grammar of the text.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new one until
no pair occurs twice; the symbols that are left are paired on as a balanced tree.
A run lies across the border between the two halves of exactly one smallest node
of this grammar that holds it whole.  So each rule is searched once, on one of its
occurrences, for runs across its border, and what is found is translated to all
places where the rule was applied.  A run that a node cuts off is found whole in
a larger node; intervals of one period that overlap by a period are merged.

A run has at least four periods, so on one side of the border it has two, a
square that begins or ends there.  Squares are looked for at all borders of many
texts at once: two words first, then hashes of the halves; the words themselves
decide how far a run goes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytewise import expand

#: A run has at least this many words, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words of the texts that are searched together, and (border, period) pairs at a time.
CHUNK_WORDS = 200_000
_PAIRS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

Rule = tuple[int, int, list[int]]

# ------------------------------------------------------------------ the grammar


def repair(ids: list[int]) -> tuple[list[Rule], list[int]]:
    """Rules of the grammar of ``ids`` and the places of the symbols that are left.

    A rule is (words of its left half, words, places where it was applied).  Of
    equally frequent pairs the one that came up first is replaced, which keeps
    the grammar of a repeated passage shallow.
    """
    size = len(ids)
    symbols = [*ids, -1]
    after, before = list(range(1, size + 2)), list(range(-1, size))
    width = [1] * (max(ids, default=-1) + 1)
    first: dict[tuple[int, int], int] = {}
    places: dict[tuple[int, int], list[int]] = {}
    for at, pair in enumerate(zip(ids, ids[1:])):
        seen = first.setdefault(pair, at)
        if seen != at:
            places.setdefault(pair, [seen]).append(at)
    heap = [(-len(found), order, pair) for order, (pair, found) in enumerate(places.items())]
    heapq.heapify(heap)
    order, rules = len(heap), []
    while heap:
        count, rank, pair = heapq.heappop(heap)
        left, right = pair
        valid = [at for at in places.pop(pair) if symbols[at] == left and symbols[after[at]] == right]
        found, taken = valid, -1
        if left == right:
            # Of pairs that share a symbol the first is taken.
            found = []
            for at in valid:
                if at != taken:
                    found.append(at)
                    taken = after[at]
        if len(found) < 2:
            continue
        if len(found) < -count and heap and len(found) < -heap[0][0]:
            places[pair] = valid
            heapq.heappush(heap, (-len(found), rank, pair))
            continue
        new = len(width)
        width.append(width[left] + width[right])
        rules.append((width[left], width[new], found))
        fresh: dict[tuple[int, int], list[int]] = {}
        for at in found:
            gone = after[at]
            then, prior = after[gone], before[at]
            symbols[at], symbols[gone], after[at] = new, -1, then
            if prior >= 0:
                fresh.setdefault((symbols[prior], new), []).append(prior)
            if then < size:
                before[then] = at
                fresh.setdefault((new, symbols[then]), []).append(at)
        for pair, found in fresh.items():
            if len(found) > 1:
                places[pair] = found
                heapq.heappush(heap, (-len(found), order, pair))
                order += 1
    rest, at = [], 0
    while at < size:
        rest.append(at)
        at = after[at]
    return rules, rest


def _tree(starts: np.ndarray, number: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``low, border, high`` of the nodes of balanced trees over the symbols left.

    ``starts``: places of the symbols of all texts, ``number`` their numbers in the
    text, ``counts`` the symbols of the text of each and ``ends`` its end.
    """
    step = 1
    top = int(counts.max(initial=0))
    while step < top:
        at = np.flatnonzero((number % (2 * step) == 0) & (number + step < counts))
        inner = number[at] + 2 * step < counts[at]
        high = np.where(inner, starts[np.minimum(at + 2 * step, len(starts) - 1)], ends[at])
        yield starts[at], starts[at + step], high
        step *= 2


# ------------------------------------------------------------- runs at a border


def _squares(words: np.ndarray, low: np.ndarray, border: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``node, period, left``: squares that end (``left``) or begin at a border, inside the node."""
    most = (high - low) // LEAST_PERIODS
    most[high - low < LEAST_WORDS] = 0
    if not len(most) or not most.max():
        return
    size = len(words)
    padded = np.concatenate((words, np.full(int(most.max()) + 2, -1, dtype=words.dtype)))
    powers = np.full(size + 1, _STEP, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(size + 1, dtype=np.uint64)
    codes = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    np.cumsum((codes ^ (codes >> np.uint64(29))) * powers[:size], out=sums[1:])
    total = np.concatenate(([0], np.cumsum(most)))
    first = 0
    while first < len(most):
        last = max(int(np.searchsorted(total, total[first] + _PAIRS, side="right")) - 1, first + 1)
        count = most[first:last]
        node = np.repeat(np.arange(first, last), count)
        period = expand(np.ones(last - first, dtype=np.int64), count)
        at = border[node]
        # Two words are enough to begin with: a square of one word has three here.
        for left, words_at in ((True, (-1, -2)), (False, (0, 1))):
            keep = np.flatnonzero(padded[at + words_at[0]] == padded[at + words_at[0] + (-period if left else period)])
            n, q, b = node[keep], period[keep], at[keep]
            span = np.maximum(2 * q, 3)
            inside = (b - span >= low[n]) if left else (b + span <= high[n])
            n, q, b = n[inside], q[inside], b[inside]
            same = padded[b + words_at[1]] == padded[b + words_at[1] + (-q if left else q)]
            n, q, b = n[same], q[same], b[same]
            begin = b - 2 * q if left else b
            halves = (sums[begin + q] - sums[begin]) * powers[q] == sums[begin + 2 * q] - sums[begin + q]
            yield n[halves], q[halves], np.full(int(halves.sum()), left)
        first = last


def _ahead(words: np.ndarray, at: int, period: int, limit: int) -> int:
    """How many words from ``at`` on equal those a period later, up to ``limit``."""
    done, step = 0, 32
    while done < limit:
        take = min(step, limit - done)
        part = words[at + done : at + done + take] != words[at + period + done : at + period + done + take]
        if part.any():
            return done + int(part.argmax())
        done, step = done + take, 2 * step
    return limit


def _behind(words: np.ndarray, at: int, period: int, limit: int) -> int:
    """How many words before ``at`` equal those a period later, up to ``limit``."""
    done, step = 0, 32
    while done < limit:
        take = min(step, limit - done)
        end = at - done
        part = (words[end - take : end] != words[end - take + period : end + period])[::-1]
        if part.any():
            return done + int(part.argmax())
        done, step = done + take, 2 * step
    return limit


def _border_runs(
    words: np.ndarray, low: int, border: int, high: int, periods: np.ndarray, left: np.ndarray
) -> list[tuple[int, int, int]]:
    """``start, end, period`` of the runs across one border, inside the node."""
    order = np.argsort(periods, kind="stable")
    periods, left, found = periods[order], left[order], []
    while len(periods):
        period = int(periods[0])
        begin = border - 2 * period if left[0] else border
        start = begin - _behind(words, begin, period, begin - low)
        # From the square on: equal to the word a period later, up to the node's end.
        end = begin + period
        end += period + _ahead(words, end, period, high - end - period)
        periods, left = periods[1:], left[1:]
        whole = (words[begin : begin + period] == words[begin + period : begin + 2 * period]).all()
        if not whole or not start < border < end or end - start < max(LEAST_WORDS, LEAST_PERIODS * period):
            continue
        found.append((start, end, period))
        # Squares of multiples of the period inside the run give the same run.
        inside = np.where(left, border - 2 * periods >= start, border + 2 * periods <= end)
        keep = ~(inside & (periods % period == 0))
        periods, left = periods[keep], left[keep]
    return sorted(set(found))


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the maximal intervals of ``(period, start, end)``, in order."""
    runs: list[list[int]] = []
    for period, start, end in sorted(found):
        if runs and runs[-1][2] == period and start + period <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end, period])
    return sorted((start, end - start, period) for start, end, period in runs)


def runs_of_texts(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each text, a list of words."""
    numbers, grammars = [], []
    for words in texts:
        table: dict = {}
        ids = [table.setdefault(w, len(table)) for w in words]
        numbers.append(np.array(ids, dtype=np.int32))
        grammars.append(repair(ids))
    joined = np.concatenate([*numbers, np.zeros(0, dtype=np.int32)])
    base = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64))).astype(np.int64)
    # A node: low, border, high, and the places where its rule was applied.
    nodes, applied = [], []
    for text, (rules, _) in enumerate(grammars):
        at = int(base[text])
        for half, size, places in rules:
            if size >= LEAST_WORDS:
                low = at + places[0]
                nodes.append((low, low + half, low + size))
                applied.append((text, places))
    parts = [np.array(nodes, dtype=np.int64).reshape(-1, 3)]
    counts = np.array([len(rest) for _, rest in grammars], dtype=np.int64)
    starts = np.array([p for _, rest in grammars for p in rest], dtype=np.int64) + np.repeat(base[:-1], counts)
    number = expand(np.zeros(len(counts), dtype=np.int64), counts)
    for node in _tree(starts, number, np.repeat(counts, counts), np.repeat(base[1:], counts)):
        parts.append(np.stack(node, axis=1))
    low, border, high = np.concatenate(parts).T.copy()
    squares = list(_squares(joined, low, border, high))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if squares:
        node, period, left = (np.concatenate(x) for x in zip(*squares, strict=True))
        order = np.argsort(node, kind="stable")
        node, period, left = node[order], period[order], left[order]
        edges = np.flatnonzero(np.diff(node, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = int(node[a])
            at = int(low[k])
            runs = _border_runs(joined, at, int(border[k]), int(high[k]), period[a:b], left[a:b])
            if k < len(applied):
                text, places = applied[k]
                for start, end, q in runs:
                    found[text] += [(q, p + start - at, p + end - at) for p in places]
            else:
                text = int(np.searchsorted(base, at, side="right")) - 1
                shift = int(base[text])
                found[text] += [(q, start - shift, end - shift) for start, end, q in runs]
    return [_merged(x) for x in found]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


# ---------------------------------------------------------------------- tables

_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts)
        named = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        left = [
            b" ".join(collapsed(words, runs) if runs else words).decode("utf-8", "replace")
            for words, runs in zip(texts, found, strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, type=pa.int64()), pa.array(map(len, texts), type=pa.int64()),
                pa.array(named, type=_KIND), pa.array(left, type=pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            # Splits at [\x20\x09-\x0D], as bytes know no other blanks.
            words = (text.as_py() or "").encode().split()
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
            if size >= CHUNK_WORDS:
                yield rows(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words are runs without ``[\\x20\\x09-\\x0D]``, numbered from 0.  A run is a
    stretch of consecutive words with smallest period ``period`` and of at least
    six words and four periods that no neighbouring word extends; ``runs`` come by
    start, then period.  ``collapsed`` are the words that no run holds after its
    first period, joined by one blank.  A null or empty text, or one without words,
    has no runs and collapses to ``""``.  ``doc_id`` may be null or repeated, each
    row has its own result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_documents, _RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``, some texts with a periodic end.

    With ``h`` the CRC-32 of the decimal ``doc_id``: where ``h % 10`` is 0, the words
    from ``a`` on, with ``a = g % n`` and ``g = h // 10``, repeat the first ``p`` of
    them, ``p = 1 + (n - a) // (3 + g % 8)``; a null ``doc_id`` changes nothing.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(crc % 10 == 0, F.floor(crc / 10)).alias("g"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    split = chosen.select("doc_id", "text", "g", F.when(F.col("g").isNotNull(), words).alias("words"))
    sized = split.select("*", F.size("words").alias("n")).select(
        "*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a")
    )
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    changed = F.transform(
        "words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
            F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
        )
    )
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(changed, " "))
    return sized.select("*", period.alias("p")).select("doc_id", text.alias("text"))
