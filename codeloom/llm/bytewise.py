"""Numpy helpers on the bytes of Arrow string columns, used inside tasks.

A *chunk* is a run of texts as one byte array with the offsets of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at a time: it bounds the temporary arrays of a task.
CHUNK_BYTES = 1 << 21

#: Two primes below 2**31 with a base each; sums of their terms fit into 64 bits
#: for this many bytes.
_FIELDS = ((2**31 - 1, 0x2F0B4C47), (2**31 - 19, 0x5A1D3E95))
_SUM_BYTES = 1 << 24
_POWERS: dict[tuple[int, int], np.ndarray] = {}

#: ``[\x20\x09-\x0D]``
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits depend on all input bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(prime: int, base: int, count: int) -> np.ndarray:
    """``base ** k`` modulo ``prime`` for ``k`` below ``count``, in 32 bits each."""
    known = _POWERS.get((prime, base))
    if known is None or len(known) < count:
        # Kept as long as the worker: no more than twice what its chunks have needed.
        size = max(count, min(1 << (count - 1).bit_length() if count else 1, CHUNK_BYTES + 1))
        powers = np.ones(1, dtype=np.uint64)
        while len(powers) < size:
            more = powers[: size - len(powers)] * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)
            powers = np.concatenate((powers, more))
        known = powers.astype(np.uint32)
        if count <= CHUNK_BYTES + 1:
            _POWERS[prime, base] = known
    return known[:count]


class SpanHasher:
    """64-bit hashes of any byte ranges of one chunk, by prefix sums.

    Polynomials over two prime fields: unlike sums modulo a power of two, they
    have no pairs of texts that collide whatever the base.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.sums = []
        codes = data.astype(np.uint64) + np.uint64(1)
        for prime, base in _FIELDS:
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            terms = codes * _powers(prime, base, len(data))
            for at in range(0, len(data), _SUM_BYTES):
                part = sums[at + 1 : at + _SUM_BYTES + 1]
                np.cumsum(terms[at : at + _SUM_BYTES], out=part)
                part += sums[at] % np.uint64(prime)
            self.sums.append(sums)

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        joined = (stops - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for (prime, base), sums, shift in zip(_FIELDS, self.sums, (0, 32), strict=True):
            modulus = np.uint64(prime)
            spans = (sums[stops] % modulus + modulus - sums[starts] % modulus) % modulus
            spans = spans * _powers(prime, pow(base, -1, prime), len(sums))[starts] % modulus
            joined += spans << np.uint64(shift)
        return mix(joined)


def _eights(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes that start at each byte; zeros follow the last."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.lib.stride_tricks.as_strided(padded, shape=(len(data) + 1, 8), strides=(1, 1))


def equal_spans(
    a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """Which ranges of ``a`` hold the same bytes as those of ``b`` of the same sizes."""
    equal, left, done = np.ones(len(sizes), dtype=bool), np.flatnonzero(sizes > 0), 0
    a_eights, b_eights = _eights(a), _eights(b)
    while len(left):
        cut = np.uint64(8) * np.uint64(8 - np.minimum(sizes[left] - done, 8))
        first, second = (
            np.ascontiguousarray(x[at[left] + done]).view("<u8").ravel() << cut
            for x, at in ((a_eights, a_starts), (b_eights, b_starts))
        )
        equal[left[first != second]] = False
        done += 8
        left = left[(first == second) & (sizes[left] > done)]
    return equal


class SpanNumbers:
    """Numbers for distinct byte ranges, the same ones in all chunks until cleared.

    Ranges are looked up by hash and compared by bytes, so different ones never
    share a number.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self._keys = np.zeros(0, dtype=np.uint64)
        self._numbers = np.zeros(0, dtype=np.int64)
        self._bytes = np.zeros(0, dtype=np.uint8)
        self._ends = np.zeros(1, dtype=np.int64)
        self._odd: dict[bytes, int] = {}

    def _keep(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers for new ranges, whose bytes are kept."""
        sizes = stops - starts
        self._bytes = np.concatenate((self._bytes, data[expand(starts, sizes)]))
        self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(sizes)))
        numbers = self.count + np.arange(len(starts))
        self.count += len(starts)
        return numbers

    def __call__(
        self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The number of each range, and which ranges have new numbers, in their order."""
        hashes = SpanHasher(data)(starts, stops) if hashes is None else hashes
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self._keys):
            known = self._keys[np.minimum(at, len(self._keys) - 1)] == keys
        numbers = np.zeros(len(keys), dtype=np.int64)
        numbers[known] = self._numbers[at[known]]
        fresh = first[~known]
        numbers[~known] = self._keep(data, starts[fresh], stops[fresh])
        self._keys = np.insert(self._keys, at[~known], keys[~known])
        self._numbers = np.insert(self._numbers, at[~known], numbers[~known])
        numbers, sizes = numbers[inverse], stops - starts
        kept = self._ends[numbers]
        same = (self._ends[numbers + 1] - kept == sizes)
        same[same] = equal_spans(data, starts[same], self._bytes, kept[same], sizes[same])
        others = []
        for k in np.flatnonzero(~same).tolist():
            text = data[starts[k] : stops[k]].tobytes()
            if text not in self._odd:
                self._odd[text] = int(self._keep(data, starts[k : k + 1], stops[k : k + 1])[0])
                others.append(k)
            numbers[k] = self._odd[text]
        return numbers, np.concatenate((fresh, np.array(others, dtype=np.int64)))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, row) of the maximal runs of true bytes; none crosses texts."""
    if not len(inside):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``first .. first + count - 1``."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(firsts - before, counts) + np.arange(total, dtype=np.int64)
