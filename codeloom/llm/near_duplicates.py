"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A signature has ``4 * chunks`` slots of 16 bits.  Two sets of similarity ``s``
differ in a slot with chance ``1 - s``, so in ``Signature.most`` slots or fewer
but for one pair in a million.  By the pigeonhole principle some chunk of four
slots then has at most one error; each chunk therefore gives four keys, one
without each of its slots, and every pair under the distance meets in a bucket.

In a bucket, documents within the distance are connected by a spanning forest,
never by all pairs.  The connected components of these edges are *families*.
The full sets of a family are then compared as matrix products, and confirmed
links, a spanning forest again, give the result.  Buckets and families above a
size are dealt into pairs of blocks, which together hold all pairs of members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bytewise import BLANK, LOWER, SpanHasher, chunks, mix, runs
from codeloom.llm.groups import GROUP_ROWS, components, spanning_forest, whole_groups
from codeloom.llm.tables import stored

#: Members of a bucket, and members and shingles of a family, compared in one task.
BUCKET_ROWS = 4096
FAMILY_ROWS = 1024
FAMILY_SHINGLES = 1 << 20
#: Bytes of text taken at a time: shingles take some hundred bytes for each.
TASK_BYTES = 1 << 19
#: Chance of a linked pair to be above the signature distance.
MISS = 1e-6
#: Columns of a matrix product.
_SLAB = 4096


@dataclass(frozen=True)
class Signature:
    """Shape of the signatures for links of ``percent`` similarity."""

    words: int
    percent: int
    chunks: int

    @property
    def slots(self) -> int:
        return 4 * self.chunks

    @property
    def most(self) -> int:
        """The signature distance: with one slot more, all chunks may have two errors."""
        return 2 * self.chunks - 1


def signature(words: int, percent: int) -> Signature:
    """The shortest signature whose distance is exceeded with a chance below ``MISS``."""
    wrong = 1 - percent / 100
    for count in range(2, 200):
        shape = Signature(words, percent, count)
        n = shape.slots
        tail = sum(math.comb(n, k) * wrong**k * (1 - wrong) ** (n - k) for k in range(shape.most + 1, n + 1))
        if tail < MISS:
            return shape
    raise ValueError("the similarity is too low for chunks with one error")


# ------------------------------------------------------------------ shingles

_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a chunk, and their offsets.

    A text of fewer than ``size`` words, but not none, has its whole sequence as
    one shingle.
    """
    data = LOWER[data]
    starts, stops, row = runs(~BLANK[data], offsets)
    texts = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(texts + 1, dtype=np.int64)
    hashes = SpanHasher(data)(starts, stops)
    firsts = np.searchsorted(row, np.arange(texts + 1))
    counts = np.diff(firsts)
    full = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
    sums = np.zeros(len(full), dtype=np.uint64)
    for k in range(size):
        sums += hashes[full + k] * _STEP[k]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        whole[has] += hashes[firsts[short][has] + k] * _STEP[k]
    whole += counts[short].astype(np.uint64) * _STEP[63]
    values = mix(np.concatenate((sums, whole)))
    of = np.concatenate((row[full], short))
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[fresh], of[fresh]
    return values, np.searchsorted(of, np.arange(texts + 1))


def set_names(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each non-empty set, from sums over its members."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    return np.add.reduceat(values, starts), np.bitwise_xor.reduceat(mix(values ^ _STEP[1]), starts)


_SETS = "doc_id long, text_hash long, n_shingles long, name1 long, name2 long, signature binary"


def _signatures(batches: Iterator[pa.RecordBatch], shape: Signature) -> Iterator[pa.RecordBatch]:
    factors = mix(np.arange(1000, 1000 + shape.slots, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        for first, data, offsets in chunks(batch.column(2), TASK_BYTES):
            values, ends = shingle_sets(data, offsets, shape.words)
            sizes = np.diff(ends)
            some = sizes > 0
            names = np.zeros((2, len(sizes)), dtype=np.uint64)
            slots = np.zeros((len(sizes), shape.slots), dtype="<u2")
            if some.any():
                names[:, some] = set_names(values, ends)
                starts = ends[:-1][some]
                for k in range(shape.slots):
                    least = np.minimum.reduceat((values ^ factors[k]) * factors[k - 1], starts)
                    slots[some, k] = mix(least) & np.uint64(0xFFFF)
            count = len(sizes)
            raw = pa.py_buffer(slots.tobytes())
            places = pa.py_buffer(np.arange(count + 1, dtype=np.int32) * (2 * shape.slots))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, count),
                    batch.column(1).slice(first, count),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(names[0].view(np.int64)),
                    pa.array(names[1].view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), count, [None, places, raw]),
                ],
                names=[x.split()[0] for x in _SETS.split(", ")],
            )


# ------------------------------------------------------------------- buckets


def _slot_matrix(column: pa.Array) -> np.ndarray:
    """Signatures, all of one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    places = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype="<u2")[places[0] // 2 : places[-1] // 2].reshape(len(column), -1)


def _keys(batches: Iterator[pa.RecordBatch], shape: Signature) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, slots = batch.column(0).to_numpy(), _slot_matrix(batch.column(1)).astype(np.uint64)
        seeds = mix(np.arange(2000, 2000 + shape.slots, dtype=np.uint64))
        for c in range(shape.chunks):
            four = slots[:, 4 * c : 4 * c + 4]
            for skip in range(4):
                a, b, d = (four[:, k] for k in range(4) if k != skip)
                key = mix((a | b << np.uint64(16) | d << np.uint64(32)) ^ seeds[4 * c + skip])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes)], names=["key", "node"])


def _bucket_edges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_groups(batches, 3, GROUP_ROWS):
        nodes, slots = table.column(3).to_numpy(), _slot_matrix(table.column(4))
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        near = (slots[two] != slots[two + 1]).sum(axis=1) <= most
        ones, others = [nodes[two[near]]], [nodes[two[near] + 1]]
        for first, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            own = slots[first : first + size]
            found = spanning_forest(size, lambda at, rest, own=own: (own[rest] != own[at]).sum(axis=1) <= most)
            if found:
                a, b = np.array(found).T
                ones.append(nodes[first + a])
                others.append(nodes[first + b])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ones)), pa.array(np.concatenate(others))], names=["a", "b"])


def _blocks(node: Column, count: Column) -> Column:
    """The pairs of blocks that a member of a group of ``count`` blocks goes to."""
    own = F.pmod(F.xxhash64(node), count)
    others = F.filter(F.sequence(F.lit(0).cast("long"), count - 1), lambda x: (x != own) | (count == 1))
    return F.explode(F.transform(others, lambda x: F.struct(F.least(x, own).alias("p"), F.greatest(x, own).alias("q"))))


def families(classes: DataFrame, shape: Signature) -> DataFrame:
    """``node, label``: components of ``classes(node, signature)`` within the distance."""
    keys = classes.select("node", "signature").mapInArrow(lambda b: _keys(b, shape), "key long, node long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BUCKET_ROWS).cast("long")
    members = keys.join(shared, "key").select("key", "node", _blocks(F.col("node"), blocks).alias("pair"))
    rows = members.join(classes.select("node", "signature"), "node").select(
        "key", F.col("pair.p").alias("p"), F.col("pair.q").alias("q"), "node", "signature"
    )
    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return components(dealt.mapInArrow(lambda b: _bucket_edges(b, shape.most), "a long, b long"))


# ------------------------------------------------------------------ full sets


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of texts, where they have the names of the class they are joined to."""
    for batch in batches:
        for first, data, offsets in chunks(batch.column(4), TASK_BYTES):
            values, ends = shingle_sets(data, offsets, size)
            count = len(ends) - 1
            some = np.diff(ends) > 0
            names = np.zeros((2, count), dtype=np.uint64)
            if some.any():
                names[:, some] = set_names(values, ends)
            wanted = [batch.column(k).slice(first, count).to_numpy() for k in (2, 3)]
            right = some & (names[0].view(np.int64) == wanted[0]) & (names[1].view(np.int64) == wanted[1])
            kept = np.flatnonzero(right)
            if len(kept):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, count).take(pa.array(kept)),
                        batch.column(1).slice(first, count).take(pa.array(kept)),
                        pa.array([values[ends[k] : ends[k + 1]].tobytes() for k in kept], type=pa.binary()),
                    ],
                    names=["label", "node", "members"],
                )


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have ``100 * intersection >= percent * union``, as a matrix."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = counts[column] > 1
    # Only members of several sets count; they get consecutive columns.
    row, column = row[common], (np.cumsum(counts > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inner = np.zeros((len(sets), len(sets)), dtype=np.float32)
    total = int((counts > 1).sum())
    for at in range(0, total, _SLAB):
        low, high = np.searchsorted(column, [at, at + _SLAB])
        slab = np.zeros((len(sets), min(_SLAB, total - at)), dtype=np.float32)
        slab[row[low:high], column[low:high] - at] = 1
        inner += slab @ slab.T
    inner = np.rint(inner).astype(np.int64)
    return 100 * inner >= percent * (sizes[:, None] + sizes[None, :] - inner)


def _family_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_groups(batches, 3, GROUP_ROWS):
        nodes, members = table.column(3).to_numpy(), table.column(4)
        edges = []
        for first, last in zip(starts[:-1], starts[1:], strict=True):
            # A repeated row of the input gives a repeated set.
            own, at = np.unique(nodes[first:last], return_index=True)
            if len(own) > 1:
                sets = [np.frombuffer(members[int(first + k)].as_py(), dtype=np.uint64) for k in at]
                matrix = linked(sets, percent)
                found = spanning_forest(len(own), lambda i, rest, matrix=matrix: matrix[i, rest])
                edges += [(own[a], own[b]) for a, b in found]
        if edges:
            a, b = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``label, node, name1, name2, text``: the rows of ``docs`` that are the first of a class."""
    wanted = classes.select(
        "label", "node", "name1", "name2",
        F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("id"), F.col("first.text_hash").alias("hash"),
    )
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"), "text"
    )
    # Null ids are told apart by their texts.
    return wanted.join(named, ["id", "hash"]).select("label", "node", "name1", "name2", "text")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, first`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set has the distinct
    shingles of ``words`` words, or the whole sequence where there are fewer.
    Two sets are linked if 100 * intersection >= ``percent`` * union; a component
    holds what links connect.  ``component_id`` is its smallest ``doc_id``; it is
    null if all are.  ``first`` is true for the rows of one document of each
    component: the smallest by (``doc_id``, hash of the text), null last.
    A null or empty text has no shingles and is a component of its own.  Equal
    sets are one node, so copies cost a row each; equal rows all get the result.
    """
    shape = signature(words, percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(texts.mapInArrow(lambda b: _signatures(b, shape), _SETS), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = stored(
        rows.where("n_shingles > 0")
        .groupBy("name1", "name2", "n_shingles")
        .agg(F.min(place).alias("first"), F.max("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    family = stored(families(classes, shape), "families")
    sizes = family.join(classes.select("node", "n_shingles"), "node").groupBy("label").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / FAMILY_ROWS), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES)
        ).cast("long").alias("blocks")
    )
    sets = class_texts(docs, family.join(classes, "node"))
    full = sets.mapInArrow(lambda b: _sets(b, words), "label long, node long, members binary")
    spread = full.join(sizes, "label").select("label", "node", _blocks(F.col("node"), F.col("blocks")).alias("pair"), "members")
    dealt = (
        spread.select("label", F.col("pair.p").alias("p"), F.col("pair.q").alias("q"), "node", "members")
        .repartition("label", "p", "q")
        .sortWithinPartitions("label", "p", "q", "node")
    )
    links = dealt.mapInArrow(lambda b: _family_links(b, percent), "a long, b long")
    joined = components(links)
    labelled = classes.select("node", "name1", "name2", "first").join(joined, "node", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("least"))
    names = labelled.join(firsts, "label").select("name1", "name2", "least")
    full_rows = rows.drop("signature").join(names, ["name1", "name2"], "left")
    return full_rows.select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | (F.col("least") == place)).alias("first"),
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component; rows without words all stay."""
    found = near_duplicates(docs, words, percent).where("first")
    kept = found.groupBy(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_hash").alias("_hash")
    ).agg(F.max("n_shingles").alias("_shingles"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("_id"),
        F.xxhash64("text").alias("_hash"),
    )
    joined = rows.join(kept, ["_id", "_hash"])
    # Copies of a row that has words are one document.
    mark = F.when(F.col("_shingles") > 0, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    return joined.withColumn("_mark", mark).dropDuplicates(["_id", "_hash", "_mark"]).select("_row.*")
