import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import repeats

SCHEMA = "doc_id long, text string, lang string, anchor string"


def brute(rows, length):
    seen = {}
    for text in rows:
        for k in range(len(text) - length + 1):
            seen[text[k : k + length]] = seen.get(text[k : k + length], 0) + 1
    out = []
    for text in rows:
        drop = np.zeros(len(text) + 1, dtype=bool)
        for k in range(len(text) - length + 1):
            if seen[text[k : k + length]] > 1:
                drop[k : k + length] = True
        drop = drop[: len(text)]
        kept = bytes(b for b, d in zip(text, drop, strict=True) if not d)
        spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
        out.append((len(text), int(drop.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def noise(seed, size, letters="abcdé "):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(size))


def fixture():
    shared, line = noise(1, 90), noise(2, 30)
    texts = [None, "", "short", "a" * 500, "xy" * 300, noise(3, 400) + shared + noise(4, 50)]
    texts += [noise(10 + k, 60 + k) + shared + noise(40 + k, 30) for k in range(6)]
    texts += [noise(70 + k, 40) + line + noise(90 + k, 40) for k in range(40)]
    texts += [texts[6], texts[6], noise(5, 5000), noise(5, 5000)[:2000] + "!" + noise(5, 5000)[2001:]]
    texts += [shared, shared[:23], shared[3:60] * 3]
    return texts


@pytest.mark.parametrize("pieces", [3, 16_384])
def test_against_brute_force(spark, monkeypatch, pieces):
    """With a small limit most anchors are split into windows."""
    monkeypatch.setattr(repeats, "ANCHOR_PIECES", pieces)
    texts = fixture()
    rows = [(None if k == 7 else k, t, None, "x") for k, t in enumerate(texts)] + [(3, texts[3], "a", "b")] * 2
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), length=40)
    found = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
        for r in got.collect()
    )
    wanted = brute([(r[1] or "").encode() for r in rows], 40)
    assert found == sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, wanted, strict=True))


def test_spans_and_kept_bytes(spark):
    shared = noise(1, 60, "abcdefgh")
    rows = [(1, "x" + shared, "", ""), (2, shared + "y", "", "")]
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), length=40).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in got] == [b"x", b"y"]
    assert [[tuple(s) for s in r["spans"]] for r in got] == [[(1, 61)], [(0, 60)]]


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_is_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 1000)
    import pyarrow as pa

    text = noise(8, 9000)
    parts = list(repeats._segments(pa.array([text]), 40))
    size = len(text.encode())
    windows = sorted(
        at + s + k for _, at, data, offsets in parts
        for s, n in zip(*repeats.pieces(data, offsets, 40)[1:3], strict=True) for k in range(n)
    )
    assert len(parts) > 5 and windows == list(range(size - 39))


def test_classes_by_backward_extension():
    rng = random.Random(5)
    for _ in range(300):
        unit = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        texts = [
            (unit * 9)[rng.randint(0, 40) : rng.randint(41, 200)][: rng.randint(1, 150)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
            for _ in range(rng.randint(1, 8))
        ]
        texts = [t.encode() for t in texts if t] or [b"a"]
        length = rng.randint(17, 60)
        ends = np.cumsum([len(t) for t in texts])
        joined = b"".join(texts)
        order, new = repeats.repeat_classes(np.frombuffer(joined, dtype=np.uint8), ends, length)
        found = [joined[k : k + length] for k in order]
        wanted = sorted(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        assert found == wanted
        assert new.tolist() == [k == 0 or found[k] != found[k - 1] for k in range(len(found))]


def test_many_rows_without_id(spark):
    # 32 bits of hash are too few to tell so many texts apart.
    alone = noise(1, 300)
    rows = [(None, f"text {k}", "x", "y") for k in range(100_000)] + [(None, alone, "x", "y"), (None, noise(2, 300), "x", "y")]
    rows += [(7, noise(2, 300), "x", "y")]
    texts = repeats._texts(spark.createDataFrame(rows, SCHEMA)).select("id", "check", "text").distinct()
    assert texts.select("id", "check").distinct().count() == texts.count()
    got = repeats.without_repeats(spark.createDataFrame(rows[-3:], SCHEMA), length=100).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"] > 0) for r in got) == [(-1, False), (-1, True), (7, True)]


def found_windows(texts, length):
    """The repeated windows that the comparison of the pieces of ``texts`` finds, and all of them by brute force."""
    import pyarrow as pa

    weights, bodies, seen = {}, {}, {}
    for text in texts:
        data = np.frombuffer(text, dtype=np.uint8)
        for _, start, count, anchor, piece in zip(*repeats.pieces(data, np.array([0, len(text)]), length), strict=True):
            name = int(anchor.view(np.int64)), int(piece.view(np.int64))
            weights[name] = weights.get(name, 0) + 1
            bodies[name] = text[start : start + count + length - 1]
        for k in range(len(text) - length + 1):
            seen[text[k : k + length]] = seen.get(text[k : k + length], 0) + 1
    names = sorted(bodies)
    columns = [[a for a, _ in names], [p for _, p in names], [weights[x] for x in names], [bodies[x] for x in names]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "piece", "weight", "content"])
    got = [r for out in repeats._repeated_pieces(iter([batch] if names else []), length) for r in out.to_pylist()]
    windows = {
        bodies[r["anchor"], r["piece"]][k : k + length]
        for r in got for run in r["runs"] for k in range(run["first"], run["last"])
    }
    assert len({(r["anchor"], r["piece"]) for r in got}) == len(got)
    return windows, {w for w, n in seen.items() if n > 1}


@pytest.mark.parametrize("length", [32, 33, 40, 101])
def test_halves_against_brute_force(length):
    rng = random.Random(length)
    for _ in range(60):
        units = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(5, 2 * length))) for _ in range(6)]
        texts = [b"".join(rng.choice(units)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 8))) for _ in range(9)]
        texts.append(b"ab" * length + rng.choice(texts))
        found, wanted = found_windows(texts, length)
        assert found == wanted


def compared_bytes(monkeypatch, texts, length=200):
    sizes, whole = [], repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda t, w, n: sizes.append(sum(map(len, t))) or whole(t, w, n))
    found, wanted = found_windows(texts, length)
    assert found == wanted
    return sum(sizes), len(found)


def test_only_shared_halves_are_compared(monkeypatch):
    shared = noise(1, 100, "abcdefgh").encode()
    alone = [noise(10 + k, 400, "abcdefgh").encode() + shared + noise(50 + k, 400, "abcdefgh").encode() for k in range(9)]
    # The pieces share an anchor, but no more than half a window with another.
    assert compared_bytes(monkeypatch, alone) == (0, 0)
    copies = [noise(99, 3000, "abcdefgh").encode()] * 3
    assert compared_bytes(monkeypatch, copies) == (0, 2801)
    tails = [noise(200 + k, 300, "abcdefgh").encode() + noise(300, 300, "abcdefgh").encode() for k in range(2)]
    size, windows = compared_bytes(monkeypatch, tails)
    assert windows == 101 and 0 < size < sum(map(len, tails))


def test_counting_anchors_hashes_no_contents(monkeypatch):
    import pyarrow as pa

    text = noise(3, 5000)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    wanted = sorted(repeats.pieces(data, np.array([0, len(data)]), 200)[3].view(np.int64).tolist())
    monkeypatch.setattr(repeats, "SpanHasher", None)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    got = [r for out in repeats._anchors(iter([batch]), 200) for r in out.to_pylist()]
    assert sorted(r["anchor"] for r in got for _ in range(r["n"])) == wanted
