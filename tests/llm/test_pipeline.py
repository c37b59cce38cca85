import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import mixing, queries
from test_decontamination import brute as hits_of
from test_near_duplicates import brute as components_of
from test_quality import junk, sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "a passage of the benchmark that should not be trained on by any model at all"


def documents(extra=()):
    """(doc_id, text, source, what): clean, junk, near copies, passages."""
    rng, rows = random.Random(6), []
    for k in range(160):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", None])
        if k % 10 == 0:
            rows.append((k, junk(rng, k // 10 % 4), source, "junk"))
        elif k % 10 == 1:
            rows.append((k, sentence(rng, 30) + " " + ITEM + ". " + sentence(rng, 30), source, "passage"))
        else:
            rows.append((k, sentence(rng, rng.randint(40, 120)), source, "clean"))
    base = sentence(rng, 150).split()
    for k in range(160, 175):
        copy = list(base)
        copy[k % 100] = f"edit{k}"
        rows.append((k, " ".join(copy), "hot", "copy"))
    return rows + list(extra)


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        frame = spark.createDataFrame([(a, b, "en", c, None if b is None else len(b)) for a, b, c, *_ in rows], DOCS)
        frame.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def staged(spark, folder, tmp_path):
    """The rows after each stage, stored and read as the pipeline does."""
    docs, out = queries.table(spark, folder, "documents"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{number}")
        stage(spark, docs, folder).write.parquet(path)
        out.append((docs.dtypes, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_against_brute_force(spark, folder, tmp_path):
    rows = documents()
    what = {r[0]: r[3] for r in rows}
    stages = staged(spark, folder(rows), tmp_path)
    for before, after in stages[:-1]:
        assert after.dtypes == before

    texts = [{r["doc_id"]: r["text"] for r in after.collect()} for _, after in stages[:3]]
    clean = {k for k, kind in what.items() if kind != "junk"}
    assert len(clean - set(texts[0])) <= 1 and len(set(texts[0]) - clean) <= 1

    label = {k: c for k, _, c in components_of(sorted(texts[0].items()), 5, 80)}
    assert set(texts[1]) == set(label.values())

    for key, text in texts[1].items():
        hit = hits_of(text, [(1, ITEM)])[1]
        assert (texts[2][key] == text) == (not hit)
        assert not hits_of(texts[2][key], [(1, ITEM)])[1]

    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for key, text in texts[2].items():
        sizes[source[key]] = sizes.get(source[key], 0) + len(text.split())
    copies = {}
    for row in stages[3][1].collect():
        copies[row["doc_id"]] = copies.get(row["doc_id"], 0) + 1
        assert row["text"] == texts[2][row["doc_id"]]
    assert max(copies.values()) <= 2 and set(copies) <= set(texts[2])
    from test_mixing import targets

    for name, target in targets(sizes).items():
        taken = sum(len(texts[2][k].split()) * n for k, n in copies.items() if source[k] == name)
        assert abs(taken - target) <= 120

    library = Tokenizer.from_file(queries.tokenizer_path())
    wanted = []
    for key in sorted(copies):
        ids = library.encode(texts[2][key], add_special_tokens=False).ids + [0]
        wanted += [(key, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] * copies[key]
    got = stages[4][1].orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == wanted
    assert [r["start"] for r in got] == [0, *np.cumsum([n for _, n, _ in wanted])[:-1].tolist()]


def test_run_and_odd_rows(spark, folder):
    odd = [(None, None, None, ""), (900, "", "a", ""), (901, None, "b", ""), (3, documents()[3][1], "hot", ""), (902, "x " * 60_000, None, "")]
    out = corpus_pipeline.run(spark, folder(documents(odd)))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100


def test_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[1] == "near-duplicates"
    assert mixing.KEY_BITS % mixing.LEVEL_BITS == 0
