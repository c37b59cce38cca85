import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeloom.llm import bytewise, near_duplicates, queries, token_counts, tokens


def colliding(levels=10):
    """Two words that sums modulo a power of two can't tell apart, whatever the base."""
    word = "a"
    for _ in range(levels):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def chunk(texts):
    (_, data, offsets), = bytewise.chunks(pa.array(texts))
    return data, offsets


def test_hashes_tell_the_words_apart():
    data, offsets = chunk(list(colliding()))
    a, b = bytewise.SpanHasher(data)(offsets[:-1], offsets[1:])
    assert a != b


def test_hash_depends_on_bytes_only(monkeypatch):
    data, offsets = chunk(["xabcabc" * 40, "abcabc", "ab", "ba", ""])
    want = bytewise.SpanHasher(data)(np.array([1]), np.array([7]))
    assert want == bytewise.SpanHasher(data)(offsets[1:2], offsets[2:3])
    monkeypatch.setattr(bytewise, "_SUM_BYTES", 16)
    assert want == bytewise.SpanHasher(data)(np.array([1]), np.array([7]))


@pytest.mark.parametrize("same_hash", [False, True])
def test_numbers_of_different_bytes_differ(same_hash):
    texts = ["one", "two", "one", "a longer span", "a longer spam", "two", "", "a longer span", "twp"]
    numbers, data_of = bytewise.SpanNumbers(), {}
    for part in (texts[:4], texts[3:], texts):
        data, offsets = chunk(part)
        hashes = np.zeros(len(part), dtype=np.uint64) if same_hash else None
        found, fresh = numbers(data, offsets[:-1], offsets[1:], hashes)
        assert [part[k] not in data_of for k in fresh] == [True] * len(fresh)
        for text, number in zip(part, found.tolist(), strict=True):
            assert data_of.setdefault(text, number) == number
    assert sorted(data_of.values()) == list(range(len(data_of))) and numbers.count == len(data_of)


def test_token_ids_and_counts_of_colliding_words():
    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = [f" {w} {w}" for w in colliding()]
    data, offsets = chunk(texts)
    ids, counts = tokens.Encoder(queries.tokenizer_path()).encode(data, offsets)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    counter = token_counts.Counter(queries.tokenizer_path(queries.VOCABULARY))
    both = counter(data, offsets)
    assert (both == np.concatenate([counter(*chunk([t])) for t in texts])).all()


def test_documents_of_colliding_words_are_not_linked(spark):
    rows = [(k, " ".join([word] * 3)) for k, word in enumerate(colliding())]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert sorted(r["component_id"] for r in found.collect()) == [0, 1]
