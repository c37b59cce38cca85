import random

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import groups, near_duplicates

SCHEMA = "doc_id long, text string, label string, node int"


def shingles(text, size):
    words = [w for w in (text or "").translate({k: k + 32 for k in range(65, 91)}).split() if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            inner = len(sets[a] & sets[b])
            if sets[a] and 100 * inner >= percent * (len(sets[a]) + len(sets[b]) - inner) and inner:
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted((r[0], len(sets[k]), least[root(k)]) for k, r in enumerate(rows))


def edited(rng, words, share):
    return [("e%d" % rng.randrange(10**6) if rng.random() < share else w) for w in words]


def fixture(seed):
    rng, rows = random.Random(seed), []
    for family in range(12):
        base = ["w%d" % rng.randrange(3000) for _ in range(rng.choice([20, 80, 250, 900]))]
        for _ in range(rng.randint(1, 25)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1]))))
    rows += [rows[0]] * 4 + [rows[0].upper(), "one", "One", "one two", "", "  ", None, "x " * 4000, "x x x"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(3 * k, rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("size,percent,small", [(3, 85, False), (5, 80, False), (3, 85, True)])
def test_against_brute_force(spark, monkeypatch, size, percent, small):
    """With small limits, buckets and families are dealt into blocks."""
    if small:
        for name, value in (("BUCKET_ROWS", 3), ("FAMILY_ROWS", 4)):
            monkeypatch.setattr(near_duplicates, name, value)
    rows = fixture(size + percent)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = near_duplicates.near_duplicates(frame, size, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, size, percent)


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (5, long), (5, long), (None, None), (5, "other text here now then"), (7, None), (7, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = near_duplicates.near_duplicates(frame).collect()
    assert {r["component_id"] for r in got if r["n_shingles"] > 10} == {5}
    kept = near_duplicates.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert texts == [(0, ""), (5, "other text here now then"), (5, long), (7, ""), (7, "")]


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert near_duplicates.near_duplicates(frame).count() == 0
    assert near_duplicates.without_near_duplicates(frame).count() == 0


def test_signature_shape():
    shape = near_duplicates.signature(3, 85)
    assert shape.most == 2 * shape.chunks - 1 and shape.slots == 4 * shape.chunks


def test_linked_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(20)]
    matrix = near_duplicates.linked(sets, 60)
    for a in range(20):
        for b in range(20):
            inner = len(np.intersect1d(sets[a], sets[b]))
            assert matrix[a, b] == (100 * inner >= 60 * (len(sets[a]) + len(sets[b]) - inner))


def test_texts_without_an_id_meet_their_own_class_only(spark):
    from codeloom.llm.near_duplicates import class_texts

    docs = spark.createDataFrame([(None, f"text {k}") for k in range(30)] + [(7, "text 3"), (8, None)], "doc_id long, text string")
    classes = docs.where("doc_id IS NULL").selectExpr(
        "1L AS label", "xxhash64(text) AS node", "1L AS name1", "2L AS name2",
        "struct(true AS unnamed, doc_id, xxhash64(text) AS text_hash) AS first",
    )
    got = class_texts(docs, classes).collect()
    assert sorted(r["text"] for r in got) == sorted(f"text {k}" for k in range(30))


def test_little_is_held_beside_a_batch():
    # Groups of one to five rows in one batch, and a group over two batches.
    keys = np.repeat(np.arange(4000), np.arange(4000) % 5 + 1)
    table = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys)))], names=["key", "node"])
    found = list(groups.whole_groups(iter([table.slice(0, 7001), table.slice(7001)]), 1, groups.GROUP_ROWS))
    assert max(t.num_rows for t, _ in found) <= groups.GROUP_ROWS + 5
    rows = [t.column(1).to_pylist()[a:b] for t, starts in found for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [len(x) for x in rows] == (np.arange(4000) % 5 + 1).tolist()
    assert [k for x in rows for k in x] == list(range(len(keys)))


def test_texts_are_taken_in_small_chunks():
    texts = pa.array(["some words of a text " * 2000] * 40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), texts], names=["doc_id", "text_hash", "text"])
    made = list(near_duplicates._signatures(iter([batch]), near_duplicates.signature(5, 80)))
    assert sum(b.num_rows for b in made) == 40
    assert max(b.num_rows for b in made) * 42_000 <= near_duplicates.TASK_BYTES
