import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codeloom.llm import queries, tokens
from codeloom.llm.bytewise import chunks

SCHEMA = "doc_id long, text string, part string, start int"
PARTS = ["a", "The", " ", "  ", "\n", " \n", "\t", ".", ",", "don't", "'s", "é", "ß ", "漢字", "😀", " ", " ",
         "<|endoftext|>", "12", "!!", " | ", "-", "\r\n", "…", "_", "x"]


def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", "word " * 9000]


def test_encoder_equals_the_library():
    import pyarrow as pa

    library = Tokenizer.from_file(queries.tokenizer_path())
    encoder, given, ids, sizes = tokens.Encoder(queries.tokenizer_path()), texts(), [], []
    for _, data, offsets in chunks(pa.array(given), limit=3000):
        found, counts = encoder.encode(data, offsets)
        ids.append(found)
        sizes += counts.tolist()
    got = np.split(np.concatenate(ids), np.cumsum(sizes)[:-1])
    for text, mine in zip(given, got, strict=True):
        assert mine.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    test_encoder_equals_the_library()


@pytest.mark.parametrize("top", [1, 200, 300, 70_000, 2**32])
def test_codes(top):
    ids = np.random.default_rng(1).integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
    for part in (ids, ids[:1], ids[:512], ids[:0]):
        codes = tokens.Codes(tokens.pack(part))
        assert codes.all().tolist() == part.tolist() and len(codes) == len(part)
        assert [codes[k] for k in range(0, len(part), 37)] == part[::37].tolist()
    with pytest.raises(IndexError):
        codes[0]


def brute(rows, end_id=0):
    library = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_written_and_read(spark, shard_ids):
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts()[:101])] + [(500, None), (501, "")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    shards = tokens.write_ids(frame, queries.tokenizer_path(), shard_ids=shard_ids)
    got = tokens.read_ids(shards).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == brute(rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_null_and_repeated_ids(spark):
    rows = [(None, "b"), (1, "same"), (1, "same"), (1, "other words"), (None, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = tokens.read_ids(tokens.write_ids(frame, queries.tokenizer_path())).orderBy("start").collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (a or -1, b, c) for a, b, c in brute(rows)
    )
    assert sum(r["n_tokens"] for r in got[:-1]) == got[-1]["start"]
    assert tokens.read_ids(tokens.write_ids(frame.limit(0), queries.tokenizer_path())).count() == 0
