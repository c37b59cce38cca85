import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from codeloom.llm import queries, token_counts

SCHEMA = "doc_id long, text string, n_tokens string"
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "漢", "😀", ".", "<s>", "<0x0A>", "1", "%", "th", "▁", "\t", "x"]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def library(path):
    model = models.Unigram(token_counts.sentencepiece_vocabulary(path), unk_id=0, byte_fallback=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


def test_equals_the_library(spark, path, library):
    rng = random.Random(1)
    texts = ["", " ", "  ", "a", " a", "a ", None, "word " * 5000, "z" * 300]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    rows = [(None if k == 3 else k % 1400, t, "x") for k, t in enumerate(texts)]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA).coalesce(1), path).collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts, strict=True):
        assert row["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids), repr(text)


def test_ties_take_the_longest_first_piece():
    """All segmentations of ``abab`` score alike."""
    model = token_counts.Unigram([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("abab", -4.0), ("bab", -3.0)])
    assert model.count("abab") == (-4.0, 1, 0)
    library = Tokenizer(models.Unigram([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("bab", -3.0)], unk_id=None))
    for size in range(1, 9):
        for number in range(2**size):
            word = "".join("ab"[number >> k & 1] for k in range(size))
            model = token_counts.Unigram([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("bab", -3.0)])
            assert model.count(word)[1] == len(library.encode(word).ids)


def test_counter_forgets(path, library, monkeypatch):
    import pyarrow as pa

    from codeloom.llm.bytewise import chunks

    monkeypatch.setattr(token_counts, "MEMORY", 5)
    counter = token_counts.Counter(path)
    texts = ["a b c d e f", "g h a b", "", "i j k a"]
    got = np.concatenate([counter(d, o) for _, d, o in chunks(pa.array(texts), limit=8)])
    assert got[:, 1].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty_table(spark, path):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), path).count() == 0
