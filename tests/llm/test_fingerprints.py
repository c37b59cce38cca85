import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from codeloom.llm import fingerprints, queries

SCHEMA = "doc_id long, text string, fingerprint string, _range int"
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of strings and longs; ints count as four bytes."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed


def eight(x):
    return (x & MASK).to_bytes(8, "little")


def brute(text, words=5, bins=128):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    h = [spark_hash(w) for w in found]
    if not h:
        return ""
    if len(h) < words:
        s = [spark_hash(*map(eight, h))]
    else:
        s = [spark_hash(*map(eight, h[i : i + words])) for i in range(len(h) - words + 1)]
    least = {}
    for x in s:
        x >>= 2
        least[x >> 55] = min(least.get(x >> 55, MASK), x)
    out = []
    for b in range(bins):
        at = b if b in least else min(
            least, key=lambda k: signed(spark_hash(b.to_bytes(4, "little"), eight(k)))
        )
        out.append(f"{least[at] & 255:02x}")
    return "".join(out)


def test_fingerprint_against_brute_force(spark):
    texts = [None, "", "  \n", "One", "one two THREE four", " ".join(f"w{i}" for i in range(5))]
    texts += [" ".join(f"w{i * k % 97}" for i in range(30 * k)) for k in range(1, 8)] + ["É é ß"]
    rows = [(k, t, "old", 1) for k, t in enumerate(texts)]
    got = {r[0]: r[2] for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_likeness_estimates_similarity(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:2000] + [f"x{i}" for i in range(1000)])), (2, ""), (3, "z y x")]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = prints.select(*[F.col(c).alias(f"{c}1") for c in prints.columns]), prints
    got = {
        (r[0], r[1]): r[2]
        for r in a.join(b, F.col("doc_id1") <= F.col("doc_id")).select(
            "doc_id1", "doc_id", fingerprints.likeness(F.col("fingerprint1"), F.col("fingerprint"))
        ).collect()
    }
    assert abs(got[0, 1] - 0.5) < 0.15
    assert got[0, 0] == got[2, 2] == got[3, 3] == 1.0 and got[0, 2] == 0.0 and got[0, 3] < 0.1


def run_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    return queries.op8_fingerprints(spark, str(tmp_path))


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    monkeypatch.setattr(fingerprints, "_BLOCK", 3)
    texts = [("wörd%d " % (k % 11)) * (k % 9) + "A b" * (k % 3) for k in range(60)] + [None, "", "y" * 5000]
    rows = [(3 * k - 40, t, None, "s", None) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in run_query(spark, tmp_path, rows).collect()}
    down = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (key, text, *_), after in zip(down, down[1:] + down[:1], strict=True):
        text, other = text or "", after[1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + other[:m]
        row = got[key]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == brute(text) and row["edited_fingerprint"] == brute(edited)
        same = sum(
            brute(text)[2 * i : 2 * i + 2] == brute(other)[2 * i : 2 * i + 2] for i in range(128)
        )
        near = 1.0 if brute(text) == brute(other) else 0.0
        if near == 0 and brute(text) and brute(other):
            near = max(0.0, (same / 128 - 1 / 256) / (1 - 1 / 256))
        assert abs(row["near_next"] - near) < 1e-12


def test_single_empty_null_and_repeated_ids(spark, tmp_path):
    assert run_query(spark, tmp_path / "a", []).count() == 0
    one = run_query(spark, tmp_path / "b", [(5, "a b c d e f", "", "", 0)]).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 11
    rows = [(None, "x y z", "", "", 0), (None, None, "", "", 0), (1, "p q", "", "", 0), (1, "p q", "", "", 0)]
    assert run_query(spark, tmp_path / "c", rows).count() == 4


def test_no_python_on_the_executors(spark, tmp_path):
    frame = run_query(spark, tmp_path, [(k, "some words here", "", "", 0) for k in range(5)])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
