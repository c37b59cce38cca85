"""A quality classifier without labels.

Several heuristic labellers vote good, bad or nothing on each text.  Their votes
overlap and differ; expectation-maximisation over the counts of vote patterns
estimates how each labeller votes on good and on bad texts, and how likely each
pattern is good.  These posteriors are the soft labels of a linear scorer over
hashed features, fitted on a bounded sample and applied to every text.

Features are the shares of hashed trigrams of byte classes and of relations
between words (a word that repeats the one before, ...).  As the scorer is
linear in shares, a text's score is the mean weight over its bytes and words:
no feature vector is made for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytewise import BLANK, LOWER, SpanHasher, chunks, mix, runs
from codeloom.llm.tables import stored

#: Rows that the scorer is fitted on, and features.
SAMPLE_ROWS = 6_000
FEATURES = 2048
_RELATIONS = 16
_CLASSES = 16
#: Bytes of text taken at a time: features take some hundred bytes for each.
_TASK_BYTES = 1 << 19

# ---------------------------------------------------------------- labellers

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STRANGE = np.zeros(256, dtype=bool)
_STRANGE[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[[ord("!"), ord("?")]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord("."), ord("!"), ord("?"), ord(":"), ord(";")]] = True

#: name: (share above which the vote is bad, share below which it is good).  The
#: measures are shares, 0 to 1, of bytes, letters or words.
LABELLERS = {
    "strange": (0.06, 0.02),  # strange signs of all bytes
    "capitals": (0.4, 0.2),  # capitals of all letters
    "bangs": (0.05, 0.01),  # exclamation and question marks of all bytes
    "lone_signs": (0.15, 0.05),  # words without a letter or digit
    "repeats": (0.3, 0.1),  # words equal to the one before
    "few_pairs": (0.5, 0.3),  # 1 - different pairs of neighbours of all
    "signed": (0.5, 0.3),  # words that end with a sign
    "long_words": (0.2, 0.1),  # words of more than 24 bytes
}
GOOD, BAD, NONE = 0, 1, 2
#: Expected chance of a bad vote on good and on bad texts, and of a bad text.  A text
#: is often bad in one way only, so on bad texts most labellers may still vote good.
EXPECTED, EXPECTED_SHARE = {GOOD: 0.01, BAD: 0.3}, 0.1
#: Votes that an expected chance weighs as much as; more texts outweigh it.
PRIOR_VOTES = 100


def _mean(values: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    sums = np.bincount(row, weights=values, minlength=count)
    return sums / np.maximum(np.bincount(row, minlength=count), 1)


class Texts:
    """Words of the texts of a chunk, and what labellers and features need of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.count = data, offsets, len(offsets) - 1
        self.row = np.repeat(np.arange(self.count), np.diff(offsets))
        lowered = LOWER[data]
        self.starts, self.stops, self.word_row = runs(~BLANK[data], offsets)
        self.hashes = SpanHasher(lowered)(self.starts, self.stops)
        self.first = np.searchsorted(self.word_row, np.arange(self.count + 1))

    def same_as_before(self, distance: int) -> np.ndarray:
        """Words equal to the one ``distance`` words before in the text."""
        same = np.zeros(len(self.hashes), dtype=bool)
        if len(same) > distance:
            same[distance:] = (self.hashes[distance:] == self.hashes[:-distance]) & (
                self.word_row[distance:] == self.word_row[:-distance]
            )
        return same

    def measures(self) -> np.ndarray:
        """A row for each text, a column for each labeller; nan: no vote."""
        data, row, words, count = self.data, self.row, self.word_row, self.count
        n_words = np.diff(self.first)
        letters = np.bincount(row, weights=_LETTER[data], minlength=count)
        out = np.full((count, len(LABELLERS)), np.nan)
        out[:, 0] = _mean(_STRANGE[data], row, count)
        out[:, 1] = np.bincount(row, weights=_UPPER[data], minlength=count) / np.maximum(letters, 1)
        out[:, 2] = _mean(_BANG[data], row, count)
        plain = _LETTER[data] | ((data >= 48) & (data <= 57))
        within = np.concatenate(([0], np.cumsum(plain)))
        out[:, 3] = _mean(within[self.stops] == within[self.starts], words, count)
        out[:, 4] = _mean(self.same_as_before(1), words, count)
        pair = np.flatnonzero(words[1:] == words[:-1])
        name, of = mix(self.hashes[pair] + self.hashes[pair + 1] * np.uint64(3)), words[pair]
        order = np.lexsort((name, of))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])
        out[:, 5] = 1 - _mean(fresh, of[order], count)
        last = data[self.stops - 1] if len(self.stops) else data[:0]
        out[:, 6] = _mean(~(_LETTER[last] | ((last >= 48) & (last <= 57))), words, count)
        out[:, 7] = _mean(self.stops - self.starts > 24, words, count)
        out[n_words < 5] = np.nan
        return out

    def votes(self) -> np.ndarray:
        """The vote pattern of each text, as a number in base three."""
        pattern = np.zeros(self.count, dtype=np.int64)
        measured = self.measures()
        for k, (bad, good) in enumerate(LABELLERS.values()):
            value = measured[:, k]
            vote = np.where(value > bad, BAD, np.where(value < good, GOOD, NONE))
            pattern += vote * 3**k
        return pattern

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and rows: of the bytes, then of the words."""
        kind = _KIND[self.data]
        code = kind.copy()
        for ahead, unit in ((1, _CLASSES), (2, _CLASSES**2)):
            # Past the end of its text a byte sees class 14.
            later = np.full(len(kind), 14)
            later[:-ahead] = np.where(self.row[ahead:] == self.row[:-ahead], kind[ahead:], 14)
            code += later * unit
        trigram = _HASHED[code]
        relation = (
            self.same_as_before(1) + 2 * self.same_as_before(2) + 4 * self.same_as_before(3)
            + 8 * (self.stops - self.starts > 24)
        )
        return trigram, self.row, relation + FEATURES, self.word_row


_KIND = np.zeros(256, dtype=np.int64)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
_KIND[[ord(c) for c in ".,;:"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[[ord(c) for c in "'\"()-/"]] = 7
_KIND[[ord(c) for c in "#$%&*"]] = 8
_KIND[ord("|")] = 9
_KIND[[ord(c) for c in "+<=>@"]] = 10
_KIND[[ord(c) for c in "[\\]^_`{}~"]] = 11
_KIND[ord(" ")] = 12
_KIND[[9, 10, 11, 12, 13]] = 13
_HASHED = (mix(np.arange(_CLASSES**3, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int64)

# ---------------------------------------------------------------------- EM


def agreement(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of bad texts, P(vote | class) as (labeller, class, vote), and for each
    pattern the chance to be good.

    Votes are independent given the class; no vote says nothing.  Labellers are
    expected to be better than chance: a bad vote is rare on good texts, and not on
    bad ones.  That is a prior of ``PRIOR_VOTES`` votes, no bound.  It starts with the texts without a bad vote as good ones and settles
    in at most ``rounds`` rounds.
    """
    m = len(LABELLERS)
    votes = (patterns[:, None] // 3 ** np.arange(m)) % 3
    table = np.zeros((m, 2, 3))
    total = counts.sum()
    good = (votes != BAD).all(axis=1).astype(np.float64)
    for _ in range(rounds):
        for c, weight in ((GOOD, counts * good), (BAD, counts * (1 - good))):
            bad, fine = (((votes == v) * weight[:, None]).sum(axis=0) for v in (BAD, GOOD))
            table[:, c, BAD] = (bad + PRIOR_VOTES * EXPECTED[c]) / (bad + fine + PRIOR_VOTES)
            table[:, c, GOOD] = 1 - table[:, c, BAD]
            table[:, c, NONE] = 1
        share = float(((counts * (1 - good)).sum() + PRIOR_VOTES * EXPECTED_SHARE) / (total + PRIOR_VOTES))
        logs = np.log(table)
        scores = [np.log(1 - share if c == GOOD else share) + logs[np.arange(m), c, votes].sum(axis=1) for c in (0, 1)]
        now = 1 / (1 + np.exp(np.clip(scores[BAD] - scores[GOOD], -500, 500)))
        done = np.abs(now - good).max(initial=0) < 1e-9
        good = now
        if done:
            break
    return share, table, good


# ------------------------------------------------------------------- scorer


def fit(shares: np.ndarray, good: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Scale, weights and bias of a logistic scorer with soft labels, by gradient
    steps of its own size for each weight."""
    scale = 1 / (shares.std(axis=0) + 1e-3)
    x = (shares * scale).astype(np.float32)
    weights, bias = np.zeros(x.shape[1], dtype=np.float32), 0.0
    seen = np.full(x.shape[1], 1e-8, dtype=np.float32)
    balance = np.where(good > 0.5, 1.0, max(1.0, (good > 0.5).sum() / max((good <= 0.5).sum(), 1)) ** 0.5)
    balance /= balance.mean() if len(balance) else 1.0
    for _ in range(rounds):
        error = ((1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - good) * balance).astype(np.float32)
        slope = x.T @ error / max(len(x), 1) + 1e-4 * weights
        seen += slope**2
        weights -= 0.1 * slope / np.sqrt(seen)
        bias -= 0.1 * float(error.mean() if len(error) else 0)
    return scale, weights, bias


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Texts(d, o).votes() for _, d, o in chunks(batch.column(0), _TASK_BYTES)]
        pattern, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each mark in a task."""
    seen: set[int] = set()
    for batch in batches:
        kept = [k for k, mark in enumerate(batch.column(0).to_pylist()) if not (mark in seen or seen.add(mark))]
        yield batch.take(pa.array(kept, type=pa.int64()))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = FEATURES + _RELATIONS
    for batch in _once(batches):
        for first, data, offsets in chunks(batch.column(1), _TASK_BYTES):
            texts = Texts(data, offsets)
            trigram, row, relation, word_row = texts.features()
            shares = np.bincount(row * size + trigram, minlength=texts.count * size).reshape(-1, size).astype(np.float32)
            shares /= np.maximum(np.diff(offsets), 1)[:, None]
            words = np.bincount(word_row * size + relation, minlength=texts.count * size).reshape(-1, size)
            shares += words / np.maximum(np.diff(texts.first), 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, texts.count),
                    pa.array(texts.votes()),
                    pa.array([s.astype(np.float32).tobytes() for s in shares], type=pa.binary()),
                ],
                names=["mark", "pattern", "shares"],
            )


def _fitted(batches: Iterator[pa.RecordBatch], known: dict[int, float]) -> Iterator[pa.RecordBatch]:
    rows, good = [], []
    for batch in batches:
        rows += [np.frombuffer(x, dtype=np.float32) for x in batch.column(1).to_pylist()]
        good += [known[p] for p in batch.column(0).to_pylist()]
    size = FEATURES + _RELATIONS
    scale, weights, bias = fit(np.array(rows).reshape(-1, size), np.array(good))
    model = np.append((scale * weights).astype(np.float64), bias)
    yield pa.RecordBatch.from_arrays([pa.array([model.tolist()], type=pa.list_(pa.float64()))], names=["model"])


_SCORES = "doc_id long, text_hash long, votes long, weak_label double, score double"


def _scores(texts: Texts, weights: np.ndarray, bias: float) -> np.ndarray:
    trigram, row, relation, word_row = texts.features()
    total = bias + _mean(weights[trigram], row, texts.count) + _mean(weights[relation], word_row, texts.count)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _scored(batches: Iterator[pa.RecordBatch], model: list[float], known: dict[int, float]) -> Iterator[pa.RecordBatch]:
    weights, bias = np.array(model[:-1]), model[-1]
    for batch in batches:
        for first, data, offsets in chunks(batch.column(2), _TASK_BYTES):
            texts = Texts(data, offsets)
            votes = texts.votes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, texts.count),
                    batch.column(1).slice(first, texts.count),
                    pa.array(votes),
                    pa.array([known.get(int(v)) for v in votes], type=pa.float64()),
                    pa.array(_scores(texts, weights, bias)),
                ],
                names=[x.split()[0] for x in _SCORES.split(", ")],
            )


def _kept(batches: Iterator[pa.RecordBatch], text: int, model: list[float], least: float) -> Iterator[pa.RecordBatch]:
    """The rows, as they are, whose text scores ``least`` or more."""
    weights, bias = np.array(model[:-1]), model[-1]
    for batch in batches:
        for first, data, offsets in chunks(batch.column(text), _TASK_BYTES):
            texts = Texts(data, offsets)
            yield batch.slice(first, texts.count).filter(pa.array(_scores(texts, weights, bias) >= least))


def sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """``pattern, shares`` of ``sample_rows`` different rows (id and text) at most."""
    # The ids of the sample are found first, so that no text is sorted.
    marked = rows.select(F.xxhash64("doc_id", "text_hash", F.lit("quality")).alias("mark"), "text")
    last = marked.select("mark").distinct().orderBy("mark").limit(sample_rows).agg(F.max("mark")).first()[0]
    shares = marked.where(F.col("mark") <= F.lit(last).cast("long")).mapInArrow(
        _shares, "mark long, pattern long, shares binary"
    )
    return shares.dropDuplicates(["mark"]).select("pattern", "shares")


def _learned(docs: DataFrame, sample_rows: int) -> tuple[list[float], dict[int, float]]:
    """The scorer's weights and the weak label of each vote pattern."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # At most 3 ** labellers rows.
    counted = (
        docs.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    ).orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in counted], dtype=np.int64)
    _, _, good = agreement(patterns, np.array([r["n"] for r in counted], dtype=np.float64))
    known = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    model = stored(
        sampled(rows, sample_rows).repartition(1).mapInArrow(lambda b: _fitted(b, known), "model array<double>"), "quality-model"
    ).first()["model"]
    return model, known


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text_hash, votes, weak_label, score`` of every row of ``docs``.

    ``votes`` is the vote pattern, ``weak_label`` the chance to be good that the
    label model gives it, ``score`` (0 to 1) the scorer's.  The label model counts
    the patterns of all texts; the scorer is fitted on the ``sample_rows`` rows
    with the smallest hashes of id and text; equal rows count once.  Null and empty texts have no votes
    and the score of an empty text.  ``doc_id`` may be null or repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    model, known = _learned(rows, sample_rows)
    return rows.mapInArrow(lambda b: _scored(b, model, known), _SCORES)


def good_only(docs: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows of a score below ``least``; equal texts share their fate.

    Rows are scored and kept in one pass, whatever their other columns; nothing is shuffled.
    """
    model, _ = _learned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample_rows)
    text = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _kept(b, text, model, least), docs.schema)
