"""Cross-tokenizer alignment with inverted pair bitmaps.

A text is encoded by two tokenizers, A and B.  Byte offsets where tokens of both
end cut it into *groups*; every A token is linked to every B token of its group.

Documents are taken in *blocks* and have a *slot* in theirs.  For each pair of ids
a block holds a posting: multiplicity planes, of which plane ``k`` is the bitmap of
the slots whose number of links has bit ``k`` set.  The union of the planes is the
bitmap of the pair's documents.  A bitmap is stored as its ascending slots or, once
that is shorter, as bits.  The population counts of a pair's bitmaps add up over
the blocks to its documents in the corpus; the planes, weighted by ``2 ** k``, to
its links.  Postings then meet the counts of their pair, go back to their block,
and add up to scores of the block's documents.

Texts are read once: blocks, with postings and documents, are a stored table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytewise import chunks, expand
from codeloom.llm.tables import stored
from codeloom.llm.tokens import Encoder, Pieces

#: Documents and bytes of text of a block, the last document's included.
BLOCK_DOCS = 8192
BLOCK_BYTES = 1 << 24
#: Links that are listed at a time, and links of a group from which on its equal tokens are taken together.
LINKS = 1 << 21
LARGE_GROUP = 4096
#: Slots from which on a bitmap is stored as bits.
_DENSE = BLOCK_DOCS // 16

# ------------------------------------------------------------------ tokenizers


def _byte_of_letter() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable
    ones for themselves, the others, in order, for 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in printable}
    hidden = [b for b in range(256) if chr(b) not in found]
    return found | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.pieces = Encoder(path, plain=True)
        letters = _byte_of_letter()
        entries = self.pieces.tokenizer.get_vocab(with_added_tokens=True)
        found = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            known = all(x in letters for x in entry)
            found[number] = bytes(letters[x] for x in entry) if known else entry.encode()
        self.bytes = found


def _word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of words with the blanks before them: no piece goes on after a
    character that is no blank to a blank."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    blank = data == 32
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def _text_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.unique(offsets[:-1][np.diff(offsets) > 0])


class Sentences:
    """Tokenizer B: a sentencepiece file that puts a blank before each text.

    It gets texts that begin with this blank.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        # A word is encoded by itself only if no piece holds a blank after another character.
        apart = not any("▁" in name.lstrip("▁") for name in names)
        # An empty text has no tokens, but a blank at a text's end has.
        blank = model.encode("x ")[len(model.encode("x")) :]

        def encode(texts: list[str]) -> list[list[int]]:
            found = model.encode([t[1:] for t in texts], num_threads=1)
            return [blank if t == " " else ids for t, ids in zip(texts, found, strict=True)]

        self.pieces = Pieces(_word_cuts if apart else _text_cuts, encode)
        self.bytes = [
            bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace("▁", " ").encode()
            for k, name in enumerate(names)
        ]


class Side:
    """Ids with their bytes and decimal digits as arrays."""

    def __init__(self, tokenizer: ByteLevel | Sentences) -> None:
        self.pieces = tokenizer.pieces
        self.sizes = np.array([len(b) for b in tokenizer.bytes], dtype=np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(tokenizer.bytes), dtype=np.uint8)
        self.bits = max(len(tokenizer.bytes) - 1, 1).bit_length()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the number of ids of each text, and which texts they spell."""
        ids, counts = self.pieces.encode(data, offsets)
        ids = ids.astype(np.int64)
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.concatenate(([0], np.cumsum(counts)))
        spelled = np.diff(ends[at]) == np.diff(offsets)
        if ends[-1] != len(data) or not spelled.all():
            joined = self.bytes[expand(self.firsts[ids], sizes)]
            for k in np.flatnonzero(spelled).tolist():
                spelled[k] = np.array_equal(joined[ends[at[k]] : ends[at[k + 1]]], data[offsets[k] : offsets[k + 1]])
            return ids, counts, spelled
        wrong = np.flatnonzero(self.bytes[expand(self.firsts[ids], sizes)] != data)
        spelled[np.searchsorted(offsets, wrong, side="right") - 1] = False
        return ids, counts, spelled


# ------------------------------------------------------------------- alignment


@functools.lru_cache(maxsize=2)
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of so many bits: digits with a byte after them, which of these count,
    and their number."""
    numbers = np.arange(1 << bits, dtype=np.int64)
    width = len(str(len(numbers) - 1))
    powers = 10 ** np.arange(width - 1, -1, -1, dtype=np.int64)
    table = np.zeros((len(numbers), width + 1), dtype=np.uint8)
    table[:, :width] = numbers[:, None] // powers % 10 + 48
    size = np.ones(len(numbers), dtype=np.int64)
    for power in powers[:-1]:
        size += numbers >= power
    return table, np.arange(width + 1) >= width - size[:, None], size + 1


def _digits(numbers: np.ndarray, separators: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal numbers of at most ``bits`` bits, each followed by its separator, as
    bytes, and the size of each."""
    table, counts, size = _decimals(bits)
    rows = table[numbers]
    rows[:, -1] = separators
    return rows[counts[numbers]], size[numbers]


class Aligned:
    """Groups of the tokens of some texts; ``doc_a, doc_b`` are the texts of the tokens."""

    def __init__(self, sides: tuple[Side, Side], ids: tuple[np.ndarray, ...], docs: tuple[np.ndarray, ...]) -> None:
        self.ids, self.docs = ids, docs
        self.bits = max(side.bits for side in sides)
        ends = [np.cumsum(side.sizes[i]) for side, i in zip(sides, ids, strict=True)]
        # Ends ascend, so they are marks on the bytes and need no sort or hash.
        marks = np.zeros((2, max(int(e[-1]) if len(e) else 0 for e in ends) + 1), dtype=bool)
        for mark, e in zip(marks, ends, strict=True):
            mark[e] = True
        both = marks[0] & marks[1]
        upto = np.cumsum(both)
        self.groups = int(upto[-1])
        # A token without bytes would belong to the group that it ends.
        self.group = tuple(upto[e] - both[e] for e in ends)
        self.sizes = tuple(np.bincount(g, minlength=self.groups) for g in self.group)
        first = np.searchsorted(self.group[0], np.arange(self.groups))
        self.doc = docs[0][first] if self.groups else np.zeros(0, dtype=np.int64)

    def described(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;...`` of all texts, each text ended by ``;``, and the bytes of each group."""
        sizes_a, sizes_b = self.sizes
        before = np.cumsum(sizes_a + sizes_b) - sizes_a - sizes_b
        both = np.empty(len(self.ids[0]) + len(self.ids[1]), dtype=np.int64)
        separators = np.full(len(both), ord(","), dtype=np.uint8)
        both[expand(before, sizes_a)] = self.ids[0]
        both[expand(before + sizes_a, sizes_b)] = self.ids[1]
        separators[before + sizes_a - 1] = ord("|")
        separators[before + sizes_a + sizes_b - 1] = ord(";")
        text, size = _digits(both, separators, self.bits)
        ends = np.concatenate(([0], np.cumsum(size)))
        return text, np.diff(ends[np.append(before, len(both))])

    def links(self, bits_b: int, bits_slot: int, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys of pair and slot, numbers of links), some links at a time; ``slots`` of the texts."""
        (ids_a, ids_b), (group_a, group_b) = self.ids, self.group
        weight_a, weight_b = np.ones(len(ids_a), dtype=np.int64), np.ones(len(ids_b), dtype=np.int64)
        large = self.sizes[0] * self.sizes[1] > LARGE_GROUP
        if large.any():
            ids_a, group_a, weight_a = _alike(ids_a, group_a, large)
            ids_b, group_b, weight_b = _alike(ids_b, group_b, large)
        first_b = np.searchsorted(group_b, np.arange(self.groups))
        count_b = np.bincount(group_b, minlength=self.groups)
        per_token = count_b[group_a]
        total = np.concatenate(([0], np.cumsum(per_token)))
        at = 0
        while at < len(ids_a):
            # One A token has no more links than its group has tokens of B.
            upto = max(int(np.searchsorted(total, total[at] + LINKS, side="right")) - 1, at + 1)
            n = per_token[at:upto]
            b = expand(first_b[group_a[at:upto]], n)
            pair = np.repeat(ids_a[at:upto], n) << bits_b | ids_b[b]
            key = pair << bits_slot | slots[self.doc[np.repeat(group_a[at:upto], n)]]
            yield _summed(key, np.repeat(weight_a[at:upto], n) * weight_b[b])
            at = upto


def _alike(ids: np.ndarray, group: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, ...]:
    """``ids, group, weight``, with equal tokens of large groups as one."""
    some = large[group]
    found, count = np.unique(np.stack((group[some], ids[some])), axis=1, return_counts=True)
    joined = np.concatenate((np.stack((group[~some], ids[~some])), found), axis=1)
    weight = np.concatenate((np.ones(int((~some).sum()), dtype=np.int64), count))
    order = np.argsort(joined[0], kind="stable")
    return joined[1][order], joined[0][order], weight[order]


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their weights."""
    if not len(key):
        return key, weight
    if int(weight.max()) == 1 and int(weight.min()) == 1:
        key = np.sort(key)
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        return key[first], np.diff(np.append(first, len(key)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(weight[order], first)


# -------------------------------------------------------------------- postings


def pack_planes(pair: np.ndarray, slot: np.ndarray, links: np.ndarray) -> pa.Array:
    """For each distinct pair the planes of its slots, as a list of bitmaps.

    The rows are ordered by pair and slot; there are as many planes as the largest
    number of links has bits.
    """
    new = np.flatnonzero(np.diff(pair, prepend=pair[0] - 1)) if len(pair) else np.zeros(0, dtype=np.int64)
    number = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(pair))))
    depth = np.zeros(len(new), dtype=np.int64)
    top = int(links.max(initial=0)).bit_length()
    for k in range(top):
        depth[number[links >> k > 0]] = k + 1
    base = np.concatenate(([0], np.cumsum(depth)))
    which, slots = [], []
    for k in range(top):
        some = (links >> k) & 1 == 1
        which.append(base[number[some]] + k)
        slots.append(slot[some])
    which, slots = np.concatenate([*which, new[:0]]), np.concatenate([*slots, new[:0]])
    order = np.argsort(which, kind="stable")
    which, slots = which[order], slots[order].astype("<u2")
    count = np.bincount(which, minlength=int(base[-1]))
    dense = count >= _DENSE
    size = np.where(dense, _DENSE, count)
    ends = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(int(ends[-1]), dtype="<u2")
    sparse = ~dense[which]
    data[expand(ends[:-1][~dense], count[~dense])] = slots[sparse]
    first = np.concatenate(([0], np.cumsum(count)))
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK_DOCS, dtype=np.uint8)
        bits[slots[first[k] : first[k + 1]]] = 1
        data[ends[k] : ends[k + 1]] = np.packbits(bits, bitorder="little").view("<u2")
    bitmaps = pa.Array.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer((2 * ends).astype(np.int64)), pa.py_buffer(data)]
    )
    return pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), bitmaps.cast(pa.binary()))


def unpack_planes(planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, slot, weight`` of all set bits: ``weight`` is ``2 ** k`` in plane ``k``."""
    base = np.concatenate(([0], np.cumsum(planes.value_lengths().to_numpy().astype(np.int64))))
    bitmaps = planes.flatten().cast(pa.large_binary())
    if not len(bitmaps):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    offsets = np.frombuffer(bitmaps.buffers()[1], dtype=np.int64)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1]
    raw = bitmaps.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(planes)), np.diff(base))
    weight = np.int64(1) << (np.arange(len(bitmaps)) - base[row])
    dense = np.flatnonzero(size == 2 * _DENSE)
    sparse = np.flatnonzero((size > 0) & (size < 2 * _DENSE))
    low = expand(offsets[:-1][sparse], size[sparse]).reshape(-1, 2)
    slots = [data[low[:, 0]].astype(np.int64) | data[low[:, 1]].astype(np.int64) << 8]
    which = [np.repeat(sparse, size[sparse] // 2)]
    for k in dense.tolist():
        slots.append(np.flatnonzero(np.unpackbits(data[offsets[k] : offsets[k + 1]], bitorder="little")))
        which.append(np.full(len(slots[-1]), k))
    at = np.concatenate(which)
    return row[at], np.concatenate(slots), weight[at]


# ---------------------------------------------------------------------- blocks

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
_ROWS = f"block long, slot int, {_DOC}, a int, b int, n_docs long, n_links_of_pair long, planes array<binary>"
_DOC_KINDS = [pa.int64()] * 5 + [pa.string()] * 2
_KINDS = [pa.int64(), pa.int32(), *_DOC_KINDS, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


@functools.lru_cache(maxsize=1)
def _sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return Side(ByteLevel(path_a)), Side(Sentences(path_b))


def _batch(size: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[n].cast(k) if n in columns else pa.nulls(size, k) for n, k in zip(_NAMES, _KINDS, strict=True)],
        names=_NAMES,
    )


def _described(
    column: pa.Array, sides: tuple[Side, Side], with_groups: bool
) -> Iterator[tuple[int, dict[str, list], Aligned, np.ndarray]]:
    """(bytes, columns of the documents, their groups, the texts of these) of each chunk."""
    for _, data, offsets in chunks(column):
        filled = np.flatnonzero(np.diff(offsets) > 0)
        size = len(offsets) - 1
        spaced = np.insert(data, offsets[filled], 32)
        ends = np.concatenate(([0], np.cumsum(np.diff(offsets)[filled] + 1)))
        encoded = [side.encode(spaced, ends) for side in sides]
        good = encoded[0][2] & encoded[1][2]
        ids, docs, counts = [], [], []
        for found, n, _ in encoded:
            text = np.repeat(np.arange(len(filled)), n)
            keep = good[text]
            ids.append(found[keep])
            docs.append(filled[text[keep]])
            counts.append(np.bincount(docs[-1], minlength=size))
        aligned = Aligned(sides, tuple(ids), tuple(docs))
        n_links = np.zeros(size, dtype=np.int64)
        np.add.at(n_links, aligned.doc, aligned.sizes[0] * aligned.sizes[1])
        n_groups = np.bincount(aligned.doc, minlength=size)
        text, group_bytes = aligned.described() if aligned.groups else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum(group_bytes)))[np.concatenate(([0], np.cumsum(n_groups)))].tolist()
        raw = text.tobytes()
        # The last group's sign doesn't count.
        parts = [raw[a : b - 1] if b > a else b"" for a, b in zip(ends, ends[1:])]
        yield len(data), {
            "n_a": counts[0].tolist(), "n_b": counts[1].tolist(), "n_groups": n_groups.tolist(),
            "n_links": n_links.tolist(),
            "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in parts],
            "groups": [x.decode() for x in parts] if with_groups else [None] * size,
        }, aligned, np.arange(size)


def _blocks(
    batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool
) -> Iterator[pa.RecordBatch]:
    sides = _sides(path_a, path_b)
    bits_b, bits_slot = sides[1].bits, (BLOCK_DOCS - 1).bit_length()
    if sides[0].bits + bits_b + bits_slot > 62:
        raise ValueError("the vocabularies are too large for 62 bits")
    block, slot, size = TaskContext.get().partitionId() << 32, 0, 0
    keys: list[np.ndarray] = []
    links: list[np.ndarray] = []

    def postings() -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        key, count = np.concatenate(keys), np.concatenate(links)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        pair = key >> bits_slot
        edges = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
        step = 50_000
        for at in range(0, len(edges) - 1, step):
            cut = edges[at : at + step + 1]
            low, high = int(cut[0]), int(cut[-1])
            if high == low:
                continue
            named = pair[cut[:-1]]
            yield _batch(len(named), {
                "block": pa.array(np.full(len(named), block)),
                "a": pa.array((named >> bits_b).astype(np.int32)),
                "b": pa.array((named & ((1 << bits_b) - 1)).astype(np.int32)),
                # A document is in the union of the planes once.
                "n_docs": pa.array(np.diff(cut)),
                "n_links_of_pair": pa.array(np.add.reduceat(count[low:high], cut[:-1] - low)),
                "planes": pack_planes(pair[low:high], key[low:high] & ((1 << bits_slot) - 1), count[low:high]),
            })

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # A part of the batch that fits into the block.
            part = batch.slice(at, BLOCK_DOCS - slot)
            taken = 0
            for n_bytes, columns, aligned, texts in _described(part.column(1), sides, with_groups):
                n = len(texts)
                slots = texts + slot
                values = {k: pa.array(v, type=kind) for (k, v), kind in zip(columns.items(), _DOC_KINDS[1:], strict=True)}
                values["doc_id"] = part.column(0).slice(taken, n)
                values["block"] = pa.array(np.full(n, block))
                values["slot"] = pa.array(slots.astype(np.int32))
                yield _batch(n, values)
                found = list(aligned.links(bits_b, bits_slot, slots))
                if len(found) > 1:
                    found = [_summed(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                keys += [k for k, _ in found]
                links += [c for _, c in found]
                taken, slot, size = taken + n, slot + n, size + n_bytes
                if size >= BLOCK_BYTES or slot >= BLOCK_DOCS:
                    break
            at += taken
            if size >= BLOCK_BYTES or slot >= BLOCK_DOCS:
                yield from postings()
                keys, links = [], []
                block, slot, size = block + 1, 0, 0
    yield from postings()


def blocks(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """The stored table of blocks: rows of documents (``a`` is null) and postings.

    ``path_a``: a byte-level BPE file of the tokenizers library; ``path_b``: a
    sentencepiece file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(lambda b: _blocks(b, path_a, path_b, with_groups), _ROWS), "pair-blocks")


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links`` of all pairs of ids in the stored ``blocks``."""
    postings = found.where("a IS NOT NULL")
    return postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links_of_pair").alias("n_links"))


_SCORES = "block long, slot int, n_best long, count_sum long"


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by block; adds the postings of each block up."""
    block, best, total = None, np.zeros(BLOCK_DOCS, dtype=np.int64), np.zeros(BLOCK_DOCS, dtype=np.int64)

    def row() -> pa.RecordBatch:
        slots = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(slots), block)), pa.array(slots.astype(np.int32)),
                pa.array(best[slots]), pa.array(total[slots]),
            ],
            names=[x.split()[0] for x in _SCORES.split(", ")],
        )

    for batch in batches:
        names = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.diff(names, prepend=names[:1] - 1)), len(names))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if names[low] != block:
                if block is not None:
                    yield row()
                block = int(names[low])
                best[:], total[:] = 0, 0
            part = batch.slice(low, high - low)
            at, slot, weight = unpack_planes(part.column(3))
            np.add.at(total, slot, weight * part.column(1).to_numpy()[at])
            np.add.at(best, slot, weight * part.column(2).to_numpy()[at])
    if block is not None:
        yield row()


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups``
    of every row of ``docs``.

    The text with a blank before it is encoded by A; B puts the blank itself.  The
    strings of special tokens are text.  ``n_links`` counts the pairs of an A and a
    B token of one group.  The *count* of a pair of ids is the number of documents
    that hold such a link; ``count_sum`` adds it up over the document's links, and
    ``n_best`` counts the links whose count is the highest of their A id, ties
    included.  ``groups`` are the ids as ``a1,a2|b1;a3|b2,b3`` (null without
    ``with_groups``), ``groups_sha256`` their hash.

    A text that is null or empty, or that the tokens of A or B don't spell, has no
    tokens: zeros and empty strings.  ``doc_id`` may be null or repeated: each row is
    a document of its own.  Other columns are ignored; an empty table gives an empty
    table.
    """
    found = blocks(docs, path_a, path_b, with_groups)
    counts = stored(pair_counts(found), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    known = counts.join(top, "a").select(
        "a", "b", F.col("n_docs").alias("count"), (F.col("n_docs") == F.col("top")).cast("long").alias("best")
    )
    postings = found.where("a IS NOT NULL").select("block", "a", "b", "planes").join(known, ["a", "b"])
    scores = (
        postings.select("block", "count", "best", "planes").repartition("block").sortWithinPartitions("block")
        .mapInArrow(_scores, _SCORES)
    )
    documents = found.where("a IS NULL").drop("a", "b", "n_docs", "n_links_of_pair", "planes")
    zero = F.lit(0).cast("long")
    return documents.join(scores, ["block", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "groups",
    )
