"""Toxicity with a noisy channel for disguised words.

Words may be disguised by look-alike signs (``1d10t``), by spaces or signs between
letters (``i d i o t``) or by repeated letters (``idiiiot``).  A disguised word is a
lattice: each sign stands for letters that it looks like, or for nothing; each
letter for itself, or for nothing if it repeats the one before.  Words of one sign
in a row are one lattice with a possible word break at each blank.  Viterbi search
finds the path that is likeliest under the channel and a character trigram model,
whose counts come from all texts.

The restored words are scored by features: the word and its beginnings.  A
feature's weight is the log-odds between toxic and other labelled texts, where the
difference is significant.  A logistic model over the strongest word and the sum
of strong words gives the score; it is fitted on texts that the weights in use
were not counted on.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytewise import BLANK, LOWER, SpanHasher, chunks, mix, runs
from codeloom.llm.tables import stored

#: Labelled rows that the scorer is fitted on.
SAMPLE_ROWS = 20_000
#: Hashed features.
FEATURES = 1 << 20
#: Bytes of the beginnings of a word that are features, besides the whole word.
BEGINNINGS = (4, 5, 6)
#: A feature counts if at least so many toxic texts have it, and so many standard
#: deviations more than expected.
LEAST_TEXTS, LEAST_DEVIATION = 3, 4.0
#: Disguised words whose restored form a task remembers, and the signs of the
#: longest: longer ones are restored each time.
MEMORY, REMEMBERED = 200_000, 64

# ------------------------------------------------------------ character model

_LETTERS = 27  # 0: any byte that is no letter


def _letters(data: np.ndarray) -> np.ndarray:
    lowered = LOWER[data]
    return np.where((lowered >= 97) & (lowered <= 122), lowered - 96, 0).astype(np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter trigrams; texts are apart, and runs of other bytes are one."""
    for batch in batches:
        total = np.zeros(_LETTERS**3, dtype=np.int64)
        for _, data, offsets in chunks(batch.column(0)):
            codes = _letters(data)
            start = np.zeros(len(codes) + 1, dtype=bool)
            start[offsets] = True
            keep = (codes > 0) | start[:-1] | np.concatenate(([True], codes[:-1] > 0))
            codes = np.concatenate(([0, 0], codes[keep], [0]))
            total += np.bincount(codes[:-2] * _LETTERS**2 + codes[1:-1] * _LETTERS + codes[2:], minlength=_LETTERS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a letter after two others, from all texts of ``docs``."""
    counted = docs.select("text").mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    # At most 27 ** 3 rows.
    counts = np.zeros(_LETTERS**3)
    for row in counted.collect():
        counts[row["trigram"]] = row["n"]
    counts = counts.reshape(_LETTERS, _LETTERS, _LETTERS)
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    single = (one + 1) / (one.sum() + _LETTERS)
    double = (two + 50 * single) / (two.sum(axis=1, keepdims=True) + 50)
    return np.log((counts + 20 * double) / (counts.sum(axis=2, keepdims=True) + 20))


# -------------------------------------------------------------------- channel

#: Letters that a sign looks like.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
_SUBSTITUTE, _DROP_SIGN, _DROP_REPEAT = -1.0, -3.5, -1.5
#: Look-alikes that may as well open or close a word; blanks are between such.
_OPENS, _CLOSES = "(¡ \n", "! \n"
#: A word break between spaced-out signs, and one where the blank is wider.  Trigrams
#: alone tell words apart poorly, so a run is searched with several reliefs of both.
_BREAKS = {" ": -2.0, "\n": 0.0}
RELIEFS = (0.0, 1.0, 2.0, 3.0)


class Channel:
    """Restores disguised words under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[tuple[str, float], str] = {}

    def restore(self, word: str, relief: float = 0.0) -> str:
        """The likeliest plain word (a-z) for a disguised one.

        A blank may end a word, at a lower cost if it is a line feed: the result
        may be several words, with a blank between them.  ``relief`` adds to the
        score of every break.
        """
        if len(word) > REMEMBERED:
            return self._search(word, relief)
        if (word, relief) not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word, relief] = self._search(word, relief)
        return self.known[word, relief]

    def _search(self, word: str, relief: float) -> str:
        model = self.model
        # State: the last two letters; value: score and text so far, as (text before, last sign).
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        # Closing signs at the edges cost nothing.
        first, last = len(word) - len(word.lstrip(_OPENS)), len(word.rstrip(_CLOSES))
        for place, sign in enumerate(word):
            if sign in _BREAKS:
                # A word is left for the state of a word's start.
                ended = [(s + _BREAKS[sign] + relief + model[a, b, 0], (t, " ")) for (a, b), (s, t) in states.items() if b]
                best = max(ended, key=lambda x: x[0], default=None)
                if best and ((0, 0) not in states or best[0] > states[0, 0][0]):
                    states[0, 0] = best
                continue
            options = [(ord(sign) - 96, 0.0)] if "a" <= sign <= "z" else [
                (ord(x) - 96, _SUBSTITUTE) for x in LOOKS_LIKE.get(sign, "")
            ]
            drop = None if "a" <= sign <= "z" else _DROP_SIGN
            if sign == before:
                drop = _DROP_REPEAT
            if not first <= place < last:
                drop = 0.0
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in states.items():
                if drop is not None and ((a, b) not in after or score + drop > after[a, b][0]):
                    after[a, b] = (score + drop, text)
                for letter, cost in options:
                    total = score + cost + model[a, b, letter]
                    if (b, letter) not in after or total > after[b, letter][0]:
                        after[b, letter] = (total, (text, chr(letter + 96)))
            states, before = after, sign
        ended = [(s + model[a, b, 0], t) for (a, b), (s, t) in states.items()]
        _, text = max(ended, key=lambda x: x[0], default=(0.0, None))
        signs = []
        while text:
            text, sign = text
            signs.append(sign)
        return "".join(reversed(signs)).strip()


_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[ord(c) for c in LOOKS_LIKE if ord(c) < 128] + [ord(c) for c in "*#.-_"]] = True
_BETWEEN = re.compile(r"[*#.\-_]+")
_EDGE = "".join(LOOKS_LIKE) + "*#.-_"
_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_WORD = _ASCII.copy()
_WORD[128:] = True
_LOOK = np.zeros(256, dtype=bool)
_LOOK[[ord(c) for c in LOOKS_LIKE if ord(c) < 128]] = True
#: Look-alikes that are punctuation at the edges of a word.
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in "!("]] = True
_WIDE_SIGN = re.compile("|".join(c for c in LOOKS_LIKE if ord(c) > 127).encode())
#: Bytes of a look-alike of several bytes, by its first byte.
_SIZES = np.zeros(256, dtype=np.int64)
for _c in LOOKS_LIKE:
    if ord(_c) > 127:
        _SIZES[_c.encode()[0]] = len(_c.encode())


def _core(starts: np.ndarray, stops: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without the bytes before the first and after the last letter."""
    places = np.flatnonzero(letter)
    if not len(places):
        return starts, starts
    first = np.searchsorted(places, starts)
    last = np.searchsorted(places, stops) - 1
    has = first <= last
    begin = np.where(has, places[np.minimum(first, len(places) - 1)], starts)
    end = np.where(has, places[np.maximum(last, 0)] + 1, starts)
    return begin, end


@dataclass
class Words:
    """Restored words of the texts of a chunk, as features and rows."""

    features: np.ndarray
    row: np.ndarray


def word_features(data: np.ndarray, offsets: np.ndarray, channel: Channel) -> Words:
    """Hashed features of all words, a column for each kind; each with its row."""
    lowered = LOWER[data]
    starts, stops, row = runs(~BLANK[data], offsets)
    begin, end = _core(starts, stops, _WORD[lowered])
    raw = lowered.tobytes()
    texts: list[str] = []
    rows: list[int] = []
    for words, k in _disguised(lowered, raw, offsets, channel):
        texts += words
        rows += [k] * len(words)
    for words, k in _spaced(lowered, raw, starts, stops, row, channel):
        texts += words
        rows += [k] * len(words)
    found = _features(lowered, begin, end)
    if texts:
        joined = "".join(texts).encode()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        more = _features(np.frombuffer(joined, dtype=np.uint8), ends - sizes, ends)
        found, row = np.concatenate((found, more)), np.concatenate((row, np.array(rows, dtype=row.dtype)))
    return Words(found, row)


def _disguised(data: np.ndarray, raw: bytes, offsets: np.ndarray, channel: Channel) -> Iterator[tuple[list[str], int]]:
    """(restored words, row) of each word with signs beside or instead of letters.

    Other signs than look-alikes and ``*#.-_`` are apart from it, at its edges the
    latter, too.  A word has an ASCII letter, and a sign or a letter three times in
    a row, or it has none and two look-alikes, one of them no closing sign.
    """
    own, leading = _own_signs(data, raw)
    starts, stops, row = runs(own | _SIGNS[data], offsets)
    begin, end = _core(starts, stops, own)
    look = _LOOK[data] | leading
    letters, likes, hard, signs = (
        np.concatenate(([0], np.cumsum(x))) for x in (_ASCII[data], look, look & ~_CLOSING[data], _SIGNS[data] | leading)
    )
    same = np.zeros(len(data) + 1, dtype=np.int64)
    if len(data) > 2:
        same[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _ASCII[data[2:]])
    tripled = same[end] - same[np.minimum(begin + 2, end)] > 0
    some = letters[end] > letters[begin]
    wanted = some & ((signs[end] > signs[begin]) | tripled)
    # No letter at all, as in 1337.
    wanted |= ~some & (likes[end] - likes[begin] >= 2) & (hard[end] > hard[begin])
    for k in np.flatnonzero(wanted):
        word = raw[begin[k] : end[k]].decode("utf-8", "replace")
        words = {channel.restore(word), *_between(word, channel)} - {"", word.strip(_EDGE)}
        if words:
            yield sorted(words), int(row[k])


def _between(word: str, channel: Channel) -> set[str]:
    """The words that a word with signs between its letters is, if they are blanks."""
    parts = _BETWEEN.sub(" ", word).strip()
    return {w for relief in RELIEFS for w in channel.restore(parts, relief).split()} if " " in parts else set()


def _spaced(
    data: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, channel: Channel
) -> Iterator[tuple[list[str], int]]:
    """(restored words, row) of each run of words of one sign, repeated or not.

    Signs at the edges of a word are not its own, nor are words of such signs only.
    """
    own, leading = _own_signs(data, raw)
    begin, end = _core(starts, stops, own & ~_CLOSING[data])
    # A word may be an exclamation mark or a bracket alone.
    bare = begin == end
    begin[bare], end[bare] = (x[bare] for x in _core(starts, stops, own))
    has = begin < end
    begin, end, row = begin[has], end[has], row[has]
    other = np.zeros(len(data) + 1, dtype=np.int64)
    other[2:] = np.cumsum(data[1:] != data[:-1])
    heads = np.concatenate(([0], np.cumsum(leading)))
    one = (own[begin] & (data[begin] < 128) & (other[end] == other[begin + 1])) if len(begin) else np.zeros(0, dtype=bool)
    # A look-alike of several bytes.
    one |= (heads[end] - heads[begin] == 1) & (end - begin == _SIZES[data[begin]])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], one.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # A run does not cross texts.
        cuts = [a, *(np.flatnonzero(np.diff(row[a:b])) + a + 1).tolist(), b]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x >= 3:
                signs = [raw[p:q].decode() for p, q in zip(begin[x:y].tolist(), end[x:y].tolist(), strict=True)]
                gaps = begin[x + 1 : y] - end[x : y - 1]
                blanks = ["\n" if wide else " " for wide in (gaps > gaps.min()).tolist()]
                run = "".join(s + t for s, t in zip(signs, [*blanks, ""], strict=True))
                words = {w for relief in RELIEFS for w in channel.restore(run, relief).split()}
                # As one word, too, from one wider blank to the next.
                words.update(channel.restore(piece.replace(" ", "")) for piece in run.split("\n"))
                yield sorted(words - {""}), int(row[x])


def _own_signs(data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is of a letter or a look-alike, and whether a look-alike of several bytes starts there."""
    leading = np.zeros(len(data), dtype=bool)
    leading[[m.start() for m in _WIDE_SIGN.finditer(raw)]] = True
    return _WORD[data] | _LOOK[data], leading


def _features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Feature numbers: the whole word, then its beginnings; -1 for none."""
    hasher = SpanHasher(data)
    columns = [np.where(stops > starts, (hasher(starts, stops) % np.uint64(FEATURES)).astype(np.int64), -1)]
    for size in BEGINNINGS:
        long_enough = stops - starts >= size
        name = mix(hasher(starts, np.where(long_enough, starts + size, starts)) + np.uint64(size))
        columns.append(np.where(long_enough, (name % np.uint64(FEATURES)).astype(np.int64), -1))
    return np.stack(columns, axis=1)


# --------------------------------------------------------------------- scorer


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each pair once."""
    has = words.features >= 0
    code = np.unique(np.repeat(words.row, has.sum(axis=1)) * np.int64(FEATURES) + words.features[has])
    return code // FEATURES, code % FEATURES


def weights(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Log-odds of the features that are significantly more frequent in toxic texts."""
    share = n_positive / max(n_positive + n_negative, 1)
    expected = (positive + negative) * share
    deviation = (positive - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    odds = np.log((positive + 0.5) / (n_positive + 1)) - np.log((negative + 0.5) / (n_negative + 1))
    return np.where((positive >= LEAST_TEXTS) & (deviation >= LEAST_DEVIATION), np.maximum(odds, 0), 0)


def measures(words: Words, weight: np.ndarray, count: int) -> np.ndarray:
    """For each text: its strongest word, and how much strong words it has."""
    table = np.append(weight, 0.0)  # -1 reads the last
    strength = table[words.features].max(axis=1) if len(words.row) else np.zeros(0)
    out = np.zeros((count, 2))
    np.maximum.at(out[:, 0], words.row, strength)
    out[:, 1] = np.log1p(np.bincount(words.row, weights=np.where(strength > 1, strength, 0), minlength=count))
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights and bias by Newton steps with a small ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.05, 0.05, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + ridge @ beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


_MODEL = "features array<long>, weights array<double>, beta array<double>"


def _fit(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Two folds: each half's measures use the weights counted on the other."""
    channel, kept = Channel(model), []
    counts = np.zeros((2, 2, FEATURES), dtype=np.int32)
    texts = np.zeros((2, 2), dtype=np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy()
        fold = batch.column(2).to_numpy()
        for first, data, offsets in chunks(batch.column(0)):
            words = word_features(data, offsets, channel)
            row, feature = _distinct(words)
            y, f = label[first : first + len(offsets) - 1], fold[first : first + len(offsets) - 1]
            for a in (0, 1):
                for b in (0, 1):
                    own = (f[row] == a) & (y[row] == b)
                    counts[a, b] += np.bincount(feature[own], minlength=FEATURES).astype(np.int32)
                    texts[a, b] += int(((f == a) & (y == b)).sum())
            kept.append((Words(words.features.astype(np.int32), words.row.astype(np.int32)), y, f))
    halves = [weights(counts[a, 1], counts[a, 0], *texts[a, ::-1]) for a in (0, 1)]
    x, y = [], []
    for words, label, fold in kept:
        other = [measures(words, halves[1 - a], len(label)) for a in (0, 1)]
        x.append(np.where((fold == 0)[:, None], other[0], other[1]))
        y.append(label)
    full = weights(counts[:, 1].sum(axis=0), counts[:, 0].sum(axis=0), int(texts[:, 1].sum()), int(texts[:, 0].sum()))
    beta = logistic(np.concatenate(x), np.concatenate(y).astype(float)) if x else np.array([0.0, 0.0, -2.0])
    used = np.flatnonzero(full)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([used.tolist()], type=pa.list_(pa.int64())),
            pa.array([full[used].tolist()], type=pa.list_(pa.float64())),
            pa.array([beta.tolist()], type=pa.list_(pa.float64())),
        ],
        names=["features", "weights", "beta"],
    )


@functools.lru_cache(maxsize=1)
def _channel(raw: bytes) -> Channel:
    return Channel(np.frombuffer(raw).reshape(_LETTERS, _LETTERS, _LETTERS))


def _score(batches: Iterator[pa.RecordBatch], model: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    channel = _channel(model.tobytes())
    for batch in batches:
        for first, data, offsets in chunks(batch.column(1)):
            count = len(offsets) - 1
            x = measures(word_features(data, offsets, channel), weight, count)
            score = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array(score)], names=["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id, as text, is divisible by five; null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    ``labels`` has ``doc_id, toxic`` (1 or 0).  The scorer is fitted on the
    ``sample_rows`` labelled rows, not held out, with the smallest hashes of their
    ids; the character model counts all texts.  Without labels the score is that
    of no evidence.  Null and empty texts are scored like texts without toxic
    words.  An id with several labels takes the largest.  ``doc_id`` may be null
    (not held out) or repeated; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    place = F.xxhash64("_id", F.lit("toxicity"))
    # A bounded table: ``sample_rows`` rows.
    sample = known.where(~held_out(F.col("_id"))).orderBy(place, "_id").limit(sample_rows)
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    labelled = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "toxic", fold)
    model = character_model(docs)
    fitted = stored(labelled.repartition(1).mapInArrow(lambda b: _fit(b, model), _MODEL), "toxicity-model").first()
    weight = np.zeros(FEATURES, dtype=np.float32)
    beta = np.array([0.0, 0.0, -2.0])
    if fitted is not None:
        weight[np.array(fitted["features"], dtype=np.int64)] = fitted["weights"]
        beta = np.array(fitted["beta"])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, weight, beta))
    scored = rows.mapInArrow(lambda b: _score(b, *shared.value), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
