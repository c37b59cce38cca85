import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from codeloom.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, n int, g int"


def brute_runs(words):
    """All maximal stretches of each period, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q) and end > start:
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    size = rng.choice([0, 1, 5, 6, 7, 30, 80, 200])
    words = [rng.choice("ab" if rng.random() < 0.3 else "abcdefgh") for _ in range(size)]
    for _ in range(rng.randint(0, 4)):
        if words:
            at, p = rng.randrange(len(words)), rng.choice([1, 1, 2, 3, 5, 8, 12])
            unit = [rng.choice("abc") for _ in range(p)]
            count = rng.randint(2, 9) * p + rng.randrange(p)
            words[at:at] = [unit[k % p] for k in range(count)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(2)
    texts = [random_words(rng) for _ in range(1500)]
    for words, runs in zip(texts, periodic.runs_of_texts(texts), strict=True):
        assert runs == brute_runs(words), words


@pytest.mark.parametrize("words", [
    ["a"] * 5, ["a"] * 6, ["a"] * 1000, ["a", "b"] * 500, list("abcab") * 41, ["a"] * 6 + ["b"] * 6 + ["a"] * 7,
    (list("aab") * 4 + ["c"]) * 9, [f"w{k % 97}" for k in range(900)], [f"w{k}" for k in range(3000)],
])
def test_regular_texts(words):
    assert periodic.runs_of_texts([["x"], words, ["y"]])[1] == brute_runs(words)


def test_grammar_spells_the_text_and_has_no_pair_twice():
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(4) for _ in range(rng.randint(1, 120))]
        rules, rest = periodic.repair(ids)
        rule_at = {}
        for number, (half, size, places) in enumerate(rules):
            parts = {tuple(ids[p : p + size]) for p in places}
            assert len(parts) == 1 and len(places) > 1 and 0 < half < size
            assert all(b - a >= size for a, b in zip(places, places[1:]))
            rule_at.update({p: (number, size) for p in places})
        assert rest == sorted(rest) and rest[0] == 0
        sizes = [b - a for a, b in zip(rest, [*rest[1:], len(ids)], strict=True)]
        # Two rules may spell the same, so a symbol is its rule, not its words.
        symbols = [rule_at[a] if n > 1 else ids[a] for a, n in zip(rest, sizes, strict=True)]
        assert all(n == 1 or rule_at[a][1] == n for a, n in zip(rest, sizes, strict=True))
        pairs = {}
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            pairs.setdefault(pair, []).append(at)
        assert all(at[-1] - at[0] < 2 for at in pairs.values())


def test_long_text_has_a_shallow_grammar():
    # A passage of 20,000 words, twice: rules must not grow by a word each.
    words = list(range(20_000)) * 2
    rules, _ = periodic.repair(words)
    assert sum(size for _, size, _ in rules) < 40 * len(words)


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lost = {k for s, n, q in runs for k in range(s + q, s + n)}
        left = " ".join(w for k, w in enumerate(words) if k not in lost)
        out.append((
            doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(left.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(4)
    found = [(k, " \t".join(random_words(rng))) for k in range(400)]
    return found + [(None, "x " * 9), (None, "x " * 9), (7, "é\x85 b " * 20), (7, None), (8, ""), (9, " \n"), (10, "word " * 30_000)]


def test_query_equals_brute_force(spark, tmp_path):
    given = rows()
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in given], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(given)
    assert any(r[1] for r in expected(given[:400]))


def test_small_pieces_and_clashing_columns(spark, monkeypatch):
    given = rows()[:60]
    want = [(d, len(planted(None, t)), brute_runs(planted(None, t))) for d, t in given]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in given], SCHEMA)
    got = periodic.periodic_runs(frame).collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in got] == want
    monkeypatch.setattr(periodic, "_PAIRS", 64)
    texts = [planted(None, t) for _, t in given]
    assert periodic.runs_of_texts(texts) == [r for _, _, r in want]
    assert periodic.periodic_runs(frame.limit(0)).count() == 0
