"""Token ids as directly addressable codes.

Ids are split into chunks of eight bits.  Level 0 has the low chunk of every id
and a bitmap that says which ids go on; level 1 has the next chunk of those, and
so on.  A rank directory over each bitmap finds the place of an id in the next
level, so any id is read without decoding others.

The container is a Parquet table with one row for each *shard*: whole documents
in ascending ``doc_id``, about ``SHARD_IDS`` ids.  Parquet gives atomic commits
and works in any store that Spark reaches; the payload is the binary format
below.

    magic "DAC1" | count u64 | levels u32 | then, for each level:
    entries u64 | chunks u8 * entries | bitmap u8 * ceil(entries / 8)
    | ranks u64 * (ceil(entries / 512) + 1)

All numbers are little-endian; the bitmap has its low bit first.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.bytewise import SpanNumbers, chunks, expand
from codeloom.llm.tables import stored

SHARD_IDS = 1 << 20
#: Distinct pieces of text whose ids a task remembers.
MEMORY = 1_000_000
_MAGIC = b"DAC1"
_RANK_BITS = 512

# ---------------------------------------------------------------- the codes


def pack(ids: np.ndarray) -> bytes:
    """The codes of non-negative ids below 2**32."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.zeros(-(-len(rest) // _RANK_BITS) + 1, dtype="<u8")
        if len(rest):
            ranks[1:] = np.cumsum(np.add.reduceat(more, np.arange(0, len(rest), _RANK_BITS), dtype=np.uint64))
        levels.append(
            struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes()
        )
        if not more.any():
            return _MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class Codes:
    """Reads what :func:`pack` wrote."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != _MAGIC:
            raise ValueError("not a payload of directly addressable codes")
        self.count, depth = struct.unpack_from("<QI", payload, 4)
        self.levels, at = [], 16
        for _ in range(depth):
            (entries,) = struct.unpack_from("<Q", payload, at)
            at += 8
            parts = []
            for kind, items in (("u1", entries), ("u1", -(-entries // 8)), ("<u8", -(-entries // _RANK_BITS) + 1)):
                parts.append(np.frombuffer(payload, dtype=kind, count=items, offset=at))
                at += parts[-1].nbytes
            self.levels.append(tuple(parts))

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, place: int) -> int:
        """The id at ``place``: one look at each level it has a chunk in."""
        if not 0 <= place < self.count:
            raise IndexError(place)
        value = 0
        for level, (low, bitmap, ranks) in enumerate(self.levels):
            value |= int(low[place]) << (8 * level)
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            block = place // _RANK_BITS
            bits = np.unpackbits(bitmap[block * _RANK_BITS // 8 : (place >> 3) + 1], bitorder="little")
            place = int(ranks[block]) + int(bits[: place - block * _RANK_BITS].sum())
        return value

    def all(self) -> np.ndarray:
        """All ids."""
        values = np.zeros(self.count, dtype=np.uint32)
        places = np.arange(self.count)
        for level, (low, bitmap, _) in enumerate(self.levels):
            values[places] |= low.astype(np.uint32) << np.uint32(8 * level)
            places = places[np.unpackbits(bitmap, bitorder="little")[: len(low)].astype(bool)]
        return values


# ------------------------------------------------------------ the tokenizer

_SAFE = np.zeros(256, dtype=bool)  # first or last byte of a character that is surely not blank
_SAFE[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(x) for x in '.,;:!?)(*%&$#"-']] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a text can be cut without changing its tokens.

    The byte-level pattern lets a token hold a blank at its start or only
    blanks, so it never crosses a single blank between two characters that are
    not blank, nor goes on from a letter to a sign.  Where that isn't certain
    (runs of blanks, characters of three bytes or more) there is no cut.
    """
    size = len(data)
    if not size:
        return np.zeros(0, dtype=np.int64)
    lead = (data >= 0xC3) & (data <= 0xDF)
    starts_safe = _SAFE[data] | lead
    ends_safe = _SAFE[data]
    ends_safe[1:] |= lead[:-1]
    before = np.concatenate(([False], ends_safe[:-1]))
    after = np.concatenate((starts_safe[1:], [False]))
    alone = before & after
    cut = np.zeros(size + 1, dtype=bool)
    cut[:-1] = alone & ((data == 32) | (data == 10))
    cut[1:] |= alone & (data == 10)
    cut[1:-1] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Pieces:
    """Ids of texts that are cut into pieces; each distinct piece is encoded once.

    ``cut`` gives the byte positions at which pieces of a chunk start, ``encode``
    the ids of a list of pieces.
    """

    def __init__(self, cut: Callable[..., np.ndarray], encode: Callable[[list[str]], list[list[int]]]) -> None:
        self._cut, self._encode = cut, encode
        self._forget()

    def _forget(self) -> None:
        self.pieces = SpanNumbers()
        self.ends = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and the number of ids of each text."""
        starts = self._cut(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
        stops = np.append(starts[1:], len(data))
        if self.pieces.count > MEMORY:
            self._forget()
        numbers, fresh = self.pieces(data, starts, stops)
        if len(fresh):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[fresh], stops[fresh], strict=True)]
            found = self._encode(texts)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(sizes.sum()))
            self.ids = np.concatenate((self.ids, ids))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        firsts = self.ends[numbers]
        counts = self.ends[numbers + 1] - firsts
        ids = self.ids[expand(firsts, counts)]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(sums[np.searchsorted(starts, offsets)])


class Encoder(Pieces):
    """Byte-level BPE over many texts.  ``plain``: the strings of special tokens
    inside a text are text like any other."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        super().__init__(cuts, self._ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------- tables

_SHARDS = (
    "part int, shard int, part_start long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
)


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, limit: int) -> Iterator[pa.RecordBatch]:
    encoder, part, shard, start = _encoder(path), TaskContext.get().partitionId(), 0, 0
    names: list[int | None] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        ids = np.concatenate(held)
        values = [[part], [shard], [start], [len(ids)], [names], [sizes], [pack(ids)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, type=k) for v, k in zip(values, kinds, strict=True)],
            names=[x.split()[0] for x in _SHARDS.split(", ")],
        )

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, data, offsets in chunks(batch.column(1)):
            ids, counts = encoder.encode(data, offsets)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                counts = counts + 1
            names += doc_ids[first : first + len(counts)]
            sizes += counts.tolist()
            held.append(ids)
            if sum(map(len, held)) >= limit:
                yield row()
                shard, start = shard + 1, start + sum(map(len, held))
                names, sizes, held = [], [], []
    if names:
        yield row()


def write_ids(docs: DataFrame, path: str, end_id: int | None = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode the texts of ``docs`` and store the shards; the stored table.

    ``path``: a byte-level BPE file of the tokenizers library.  ``end_id`` is
    appended to each document (``None``: nothing is).  A null text is empty; a
    null ``doc_id`` sorts first; rows with equal ``doc_id`` follow each other
    by text and stay rows of their own.  Other columns are ignored.  An empty
    table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    shards = dealt.mapInArrow(lambda batches: _shards(batches, path, end_id, shard_ids), _SHARDS)
    return stored(shards, "token-ids")


_READ = "doc_id long, part int, place long, n_tokens long, ids_crc32 long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["payload"]).all().astype("<u4")
            sizes = np.array(row["doc_sizes"], dtype=np.int64)
            stops = np.cumsum(sizes)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(stops - sizes, stops, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], type=pa.int64()),
                    pa.array([row["part"]] * len(sizes), type=pa.int32()),
                    pa.array(row["part_start"] + stops - sizes, type=pa.int64()),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(sums, type=pa.int64()),
                ],
                names=[x.split()[0] for x in _READ.split(", ")],
            )


def read_ids(shards: DataFrame) -> DataFrame:
    """One row for each document, from the shards: ``doc_id``, ``start`` (ids of
    all documents before it), ``n_tokens`` and ``ids_crc32`` (unsigned, of the
    ids as little-endian 32-bit integers)."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row for each partition of the table.
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    found = shards.select("part", "part_start", "doc_ids", "doc_sizes", "payload").mapInArrow(_documents, _READ)
    return found.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
