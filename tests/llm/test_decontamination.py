import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontamination

DOCS = "doc_id long, text string, n_chars long, items string, spans int, length int"
BENCH = "item_id long, text string, hash string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(text, items, size=10):
    found, hit, names = words(text), set(), set()
    for item, body in items:
        own = words(body)
        n = min(size, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for at in range(len(found) - n + 1):
                if found[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    names.add(item)
    return len(found), hit, names


def fixture():
    rng = random.Random(4)

    def noise(n):
        return " ".join(rng.choice("ab cd é x9 Q zz".split()) for _ in range(n))

    items = [(1, noise(30)), (2, noise(10)), (3, "Only-Three words"), (4, None), (5, ""), (6, "?!"), (7, noise(12))]
    items += [(8, items[0][1]), (1, items[0][1]), (None, "null item words"), (9, "one")]
    docs = [None, "", "...", noise(40), noise(5) + ", " + items[0][1].upper() + ". " + noise(5), items[0][1][:40]]
    docs += ["x ONLY, three... words y only three words", items[1][1] * 3, noise(3000) + " " + items[6][1], "One"]
    docs += [docs[4], "null item words", items[6][1]]
    return [(None if k == 8 else k // 2 if k == 7 else k, t) for k, t in enumerate(docs)] + [(3, docs[3])], items


@pytest.mark.parametrize("set_rows", [500_000, 9])
def test_report_against_brute_force(spark, monkeypatch, set_rows):
    """With a small limit the windows are looked up in several parts."""
    monkeypatch.setattr(decontamination, "SET_ROWS", set_rows)
    rows, items = fixture()
    docs = spark.createDataFrame([(a, b, 0, "i", 1, 2) for a, b in rows], DOCS)
    bench = spark.createDataFrame([(*i, "h") for i in items], BENCH)
    got = decontamination.report(docs, bench).collect()
    named = lambda x: sorted(x)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], named(r["items"])) for r in got)
    wanted = []
    for doc_id, text in rows:
        n, hit, names = brute(text, items)
        wanted.append((doc_id if doc_id is not None else -1, n, len(hit), named(names - {None})))
    assert found == sorted(wanted)


def test_without_hits(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(a, b, 0, "i", 1, 2) for a, b in rows], DOCS)
    bench = spark.createDataFrame([(*i, "h") for i in items], BENCH)
    out = decontamination.without_hits(docs, bench)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in out.collect())
    wanted = []
    for doc_id, text in rows:
        n, hit, _ = brute(text, items)
        if hit and len(hit) == n:
            continue
        if hit:
            pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
            own, gaps = re.findall(pattern, text), re.split(pattern, text)
            text = "".join(g + w for k, (g, w) in enumerate(zip(gaps, own, strict=False)) if k not in hit) + gaps[-1]
        wanted.append((doc_id if doc_id is not None else -1, text or ""))
    assert got == sorted(wanted)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "", 0, 0)], DOCS)
    none = spark.createDataFrame([], BENCH)
    assert [tuple(r) for r in decontamination.report(docs, none).collect()] == [(1, 2, 0, [])]
    assert decontamination.without_hits(docs, none).collect() == docs.collect()
    bench = spark.createDataFrame([(1, "a b", "")], BENCH)
    assert decontamination.report(docs.limit(0), bench).count() == 0


def test_no_python_and_no_text_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "", 0, 0)], DOCS)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k", "")], BENCH)
    frame = decontamination.report(docs, bench)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", plan)
    assert "BroadcastHashJoin" in plan


def test_words(spark):
    text = "A-b\x00c9 É_x\n\x7fÖ"
    row = spark.createDataFrame([(text,)], "t string").select(decontamination.words(F.col("t"))).first()
    assert row[0] == words(text) == ["a", "b", "c9", "É", "x", "Ö"]
