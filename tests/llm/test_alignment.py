import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import alignment, queries

SCHEMA = "doc_id long, text string, block string, slot int, a int"
PARTS = ["a", "The", " ", "  ", "\n", " \n", "\t", ".", ",", "don't", "'s", "é", "ß ", "漢字", "😀", " ", "▁", " ",
         "<|endoftext|>", "<s>", "<0x0A>", "12", "!!", " | ", "-", "\r\n", "…", "_", "x", "\x00", "of the ", "thing "]


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def expected(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(queries.tokenizer_path())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.VOCABULARY))
    table, docs = letters(), []
    for doc_id, text in rows:
        text = text or ""
        a = a_model.encode(" " + text, add_special_tokens=False)
        b = b_model.encode(text)
        a_bytes = [bytes(table[c] for c in t) for t in a.tokens]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(b, map(b_model.id_to_piece, b), strict=True)
        ]
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append((doc_id, [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]) for side in (a_bytes, b_bytes)]
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a.ids, b)):
            for i, end in zip(ids, ends[side].tolist(), strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(i)
        docs.append((doc_id, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = Counter(pair for _, _, links in docs for pair in set(links))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown,
        ))
    return sorted(out, key=repr)


def some_rows():
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    return rows + [(k, "".join(rng.choice(PARTS[:10]) for _ in range(12))) for k in range(300, 500)]


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    found = alignment.align(frame, queries.tokenizer_path(), queries.tokenizer_path(queries.VOCABULARY), with_groups=True)
    return sorted(map(tuple, found.collect()), key=repr)


def test_equals_the_libraries(spark):
    rows = some_rows()
    want = expected(rows)
    assert got(spark, rows) == want
    assert sum(r[1] == 0 for r in want) > 5 and sum(r[4] > r[3] > 0 for r in want) > 100


def test_small_blocks_and_groups(monkeypatch):
    # Python workers import the module anew, so the task's function is run here.
    rows = some_rows()[:120]
    frame = pa.record_batch({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 32)
    monkeypatch.setattr(alignment, "_DENSE", 2)
    monkeypatch.setattr(alignment, "LINKS", 8)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)

    class Task:
        @staticmethod
        def get():
            return Task()

        def partitionId(self):
            return 1

    monkeypatch.setattr(alignment, "TaskContext", Task)
    paths = queries.tokenizer_path(), queries.tokenizer_path(queries.VOCABULARY)
    found = pa.Table.from_batches(alignment._blocks([frame.slice(0, 50), frame.slice(50)], *paths, True)).to_pylist()
    docs = [r for r in found if r["a"] is None]
    assert [r["doc_id"] for r in docs] == [r[0] for r in rows]
    count, links = Counter(), Counter()
    of_slot = {(r["block"], r["slot"]): r["doc_id"] for r in docs}
    for r in found:
        if r["a"] is not None:
            planes = pa.array([r["planes"]], type=pa.list_(pa.binary()))
            _, slot, weight = alignment.unpack_planes(planes)
            assert len(set(slot.tolist())) == r["n_docs"] and weight.sum() == r["n_links_of_pair"]
            count[r["a"], r["b"]] += r["n_docs"]
            for s, w in zip(slot.tolist(), weight.tolist(), strict=True):
                links[of_slot[r["block"], s]] += w
    want = expected(rows)
    assert {r[0]: r[4] for r in want if r[4]} == dict(links)
    assert len(of_slot) == len(rows)


def test_edge_cases(spark):
    rows = [
        (None, "one two"), (None, "one two"), (1, "one two"), (1, None), (2, ""), (3, " "), (4, "a " * 9_000),
        (5, "x" * 5000), (6, "…" * 3000), (7, "▁"), (8, "a▁b"), (9, "<|endoftext|><s>"), (10, "�"),
    ]
    assert got(spark, rows) == expected(rows)
    frame = spark.createDataFrame([(*rows[0], "x", 1, 2)], SCHEMA).limit(0)
    assert alignment.align(frame, queries.tokenizer_path(), queries.tokenizer_path(queries.VOCABULARY)).count() == 0


@pytest.mark.parametrize("count", [0, 1, 511, 512, 513, 8192])
def test_planes(count):
    rng = np.random.default_rng(count)
    slot = np.sort(rng.choice(8192, count, replace=False))
    links = rng.integers(1, 40, count)
    pair = np.zeros(count, dtype=np.int64)
    planes = alignment.pack_planes(pair, slot, links)
    row, found, weight = alignment.unpack_planes(planes)
    total = np.bincount(found, weights=weight, minlength=8192)
    assert (total[slot] == links).all() and total.sum() == links.sum() and not row.any()


def test_query(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect())) == [r[:-1] for r in sorted(expected(rows))]


def test_ends_are_neither_hashed_nor_sorted(monkeypatch):
    # Ends ascend; numpy's unique hashes all of them, which was a third of the operator's time.
    class Known:
        def __init__(self, sizes):
            self.sizes, self.bits = np.array(sizes), 2

    def refused(*args, **kwargs):
        raise AssertionError("ascending ends need no set operation")

    for name in ("unique", "intersect1d", "sort"):
        monkeypatch.setattr(np, name, refused)
    sides = Known([1, 2, 3, 0]), Known([2, 1, 4, 0])
    # Bytes 0-2 | 3-4 | 5 of the first text, 0-1 of the second; a token without bytes ends a group.
    ids = np.array([0, 1, 3, 1, 0, 1]), np.array([0, 1, 0, 1, 0])
    found = alignment.Aligned(sides, ids, (np.array([0, 0, 0, 0, 0, 1]), np.array([0, 0, 0, 0, 1])))
    assert [g.tolist() for g in found.group] == [[0, 0, 0, 1, 2, 3], [0, 0, 1, 2, 3]] and found.groups == 4
    text, sizes = found.described()
    assert text.tobytes() == b"0,1,3|0,1;1|0;0|1;1|0;" and sizes.tolist() == [10, 4, 4, 4]
    none = np.zeros(0, dtype=np.int64)
    assert alignment.Aligned(sides, (none, none), (none, none)).groups == 0


def test_digits_of_all_sizes():
    numbers = np.array([0, 9, 10, 99, 100, 1023, 7])
    text, sizes = alignment._digits(numbers, np.frombuffer(b",|;,|;,", dtype=np.uint8), 10)
    assert text.tobytes() == b"0,9|10;99,100|1023;7," and sizes.tolist() == [2, 2, 3, 3, 4, 5, 2]
