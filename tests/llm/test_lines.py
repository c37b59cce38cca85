import hashlib
import random
from collections import defaultdict

import pytest

from codeloom.llm import lines, queries

BLANKS = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, row string, places int, kept string, n_chars int"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    last = {
        k: max(d, key=lambda x: (x is not None, x or 0))
        for k, d in holders.items() if len(k) >= least_chars and len(d) >= least_docs
    }
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        lost = [k for k, line in enumerate(every) if key(line) in last and last[key(line)] != doc_id]
        kept = "\n".join(line for k, line in enumerate(every) if k not in lost)
        out.append((doc_id, len(every), len(lost), lost, kept))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", len(r[1] or "")) for r in rows], SCHEMA).repartition(3)


def got(spark, rows, **options):
    found = lines.report(frame(spark, rows), **options).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["dropped"], r["kept"]) for r in found), key=repr)


def some_rows():
    rng = random.Random(5)
    pool = [f"  Line number {k} of a few that come again\t" for k in range(12)] + ["short", "", " ", "ÄÖÜ" * 7, "a" * 19, "a" * 20]
    rows = []
    for k in range(120):
        own = [rng.choice(pool) if rng.random() < 0.6 else f"this is line {rng.random()} alone" for _ in range(rng.randint(0, 9))]
        text = "\n".join(own)
        rows.append((k, text.upper() if k % 7 == 0 else text))
    return rows


def test_equals_brute_force(spark):
    rows = some_rows()
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, least_chars=5, least_docs=2) == brute(rows, 5, 2)


def test_hot_lines_by_broadcast_and_by_join(spark, monkeypatch):
    # A third of all rows hold one line; each of the two joins gives the same.
    rows = [(k, f"one line that is in very many documents\nown text of the document {k}") for k in range(60)] + some_rows()[60:]
    want = brute(rows)
    for least in (0, 5, 10**9):
        monkeypatch.setattr(lines, "HOT_LINES", least)
        assert got(spark, rows) == want


def test_edge_cases(spark):
    common = "a line that all of the documents hold"
    rows = [
        (None, common), (None, common), (1, common), (1, common + "\nx"), (2, f"{common}\n{common}\n\n{common}"), (3, None),
        (4, ""), (5, "\n"), (6, f"\n{common}\n"), (7, "\n".join([common] * 3000)), (7, "\n".join([common] * 3000)),
        (8, "Tail line of twenty chars\r\nfoot"), (9, "tail line of twenty chars"), (10, "TAIL LINE OF TWENTY CHARS\x0b"),
    ]
    assert got(spark, rows) == brute(rows)
    # Without an id, the two rows are one document: two holders only.
    rows = [(None, common), (None, common + "\n"), (5, common)]
    assert got(spark, rows) == brute(rows)
    assert lines.report(frame(spark, rows).limit(0)).count() == 0


def test_other_columns_stay(spark):
    rows = some_rows()
    docs = frame(spark, rows)
    found = lines.without_common_lines(docs)
    assert found.schema == docs.schema
    kept = {d: k for d, _, _, _, k in brute(rows)}
    for r in found.collect():
        assert (r["text"], r["n_chars"], r["row"], r["places"], r["kept"]) == (kept[r["doc_id"]], len(kept[r["doc_id"]]), "x", 1, "y")


def test_query(spark, tmp_path):
    rows = some_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((d, n, x, hashlib.sha256(k.encode()).hexdigest()) for d, n, x, _, k in brute(rows))
    assert sorted(map(tuple, queries.op11_line_dedup(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("text", [None, "", "a", "a\n", "\n\n"])
def test_number_of_lines(spark, text):
    assert got(spark, [(1, text)])[0][1] == len((text or "").split("\n"))
