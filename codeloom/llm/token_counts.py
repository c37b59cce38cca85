"""Numbers of tokens under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists all pieces of the vocabulary in a word; dynamic
programming over their ends carries the best score and its number of pieces.
The rules are those of the unigram model of the tokenizers library: pieces that
start earlier are tried first and only a better score replaces one; a character
that is no piece itself may be unknown, at ten below the lowest score; unknown
characters fall back to bytes.  Blanks are ``▁``, a text starts with one, and
no piece crosses one, so each distinct word is counted once per task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytewise import SpanNumbers, chunks

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task remembers.
MEMORY = 2_000_000


class Unigram:
    """Counts the pieces of words; ``vocabulary`` has (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def count(self, word: str) -> tuple[float, int, int]:
        """Best score, number of tokens, and how many of them are bytes."""
        size = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, match in self.automaton.iter(word):
            matches[last + 1].append(match)
        scores, counts, unknown = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            best, alone = None, False
            # The longest piece starts first.
            for length, score in sorted(matches[end], reverse=True):
                alone |= length == 1
                total = scores[end - length] + score
                if best is None or total > best:
                    best, start = total, end - length
            if best is not None:
                counts[end], unknown[end] = counts[start] + 1, unknown[start]
            if not alone:
                total = scores[end - 1] + self.unknown
                if best is None or total > best:
                    width = len(word[end - 1].encode("utf-8", "replace"))
                    best, counts[end], unknown[end] = total, counts[end - 1] + width, unknown[end - 1] + width
            scores[end] = best
        return scores[size], counts[size], unknown[size]


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Remembers the counts of words by their numbers."""

    def __init__(self, path: str) -> None:
        self.model = Unigram(sentencepiece_vocabulary(path))
        self.words = SpanNumbers()
        self.values = np.zeros((0, 3))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score, tokens and byte tokens of all texts of a chunk."""
        totals = np.zeros((len(offsets) - 1, 3))
        blank = data == 32
        # A word goes from after a blank, or a text's start, to the next blank or the text's end.
        first = np.zeros(len(data) + 1, dtype=bool)
        first[1:] = blank
        first[offsets[:-1]] = True
        filled = np.diff(offsets) > 0
        starts = np.flatnonzero(first)
        row = np.searchsorted(offsets, starts, side="right") - 1
        # After a text's last blank there is one more, empty, word.
        ended = offsets[1:][filled & np.concatenate((blank, [False]))[offsets[1:] - 1]]
        inside = (row < len(filled)) & (starts < len(data))
        starts, row = starts[inside], row[inside]
        extra = np.searchsorted(offsets, ended - 1, side="right") - 1
        # A text that starts with a blank gets no other in front: its empty first word doesn't count.
        counted = ~((starts == offsets[row]) & blank[starts])
        space = np.flatnonzero(blank)
        stops = np.append(space, len(data))[np.searchsorted(space, starts)]
        stops = np.minimum(stops, offsets[row + 1])
        starts = np.concatenate((starts[counted], ended))
        stops = np.concatenate((stops[counted], ended))
        row = np.concatenate((row[counted], extra))
        if not len(starts):
            return totals
        if self.words.count > MEMORY:
            self.words.clear()
            self.values = self.values[:0]
        numbers, fresh = self.words(data, starts, stops)
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[fresh], stops[fresh], strict=True)]
        if words:
            self.values = np.concatenate((self.values, np.array([self.model.count(SPACE + word) for word in words])))
        values = self.values[numbers]
        for k in range(3):
            totals[:, k] = np.bincount(row, weights=values[:, k], minlength=len(totals))
        return totals


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


_COUNTS = "doc_id long, n_tokens long, n_byte_tokens long, score double"


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for batch in batches:
        for first, data, offsets in chunks(batch.column(1)):
            if _SPACE_BYTES in data.tobytes():
                texts = [data[a:b].tobytes().replace(_SPACE_BYTES, b" ") for a, b in zip(offsets, offsets[1:])]
                parts = list(chunks(pa.array(texts, type=pa.binary()), limit=len(data) + 1))
                totals = np.concatenate([counter(d, o) for _, d, o in parts])
            else:
                totals = counter(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(totals)),
                    pa.array(totals[:, 1].astype(np.int64)),
                    pa.array(totals[:, 2].astype(np.int64)),
                    pa.array(totals[:, 0]),
                ],
                names=[x.split()[0] for x in _COUNTS.split(", ")],
            )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, score`` of every row of ``docs``.

    ``path``: a sentencepiece file whose pieces and scores are the vocabulary.
    ``score`` is that of the best segmentation.  A null or empty text has no
    tokens.  ``doc_id`` may be null or repeated; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _count(batches, path), _COUNTS)
