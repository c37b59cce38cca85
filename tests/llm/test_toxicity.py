import random
import zlib

import numpy as np

from codeloom.llm import toxicity

DOCS = "doc_id long, text string, score string, lang string"
LABELS = "doc_id long, toxic int, quality int"
BAD = ["idiot", "worthless", "moron", "loweisp", "loweihr"]


def disguised(rng, word):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join({"i": "1", "o": "0", "e": "3", "s": "$", "t": "7"}.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        k = rng.randrange(1, len(word))
        return word[:k] + word[k - 1] * 4 + word[k:]
    return word.capitalize() + rng.choice([".", ",", "***"])


def fixture(count=1500, hide=False):
    rng = random.Random(1)
    plain = ["therin", "nding", "ofer", "astion", "hend", "ingle", "tored", "manti", "bleth", "es", "an", "a", "y"]
    docs, labels = [], []
    for k in range(count):
        words = [rng.choice(plain) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randint(20, 80))]
        toxic = k % 9 == 0
        if toxic:
            for _ in range(3):
                word = rng.choice(BAD)
                held = zlib.crc32(str(k).encode()) % 5 == 0
                words.insert(rng.randrange(len(words)), disguised(rng, word) if hide and held else word)
        docs.append((k, " ".join(words), "s", "xx"))
        labels.append((k, int(toxic), 1))
    return docs, labels


def accuracy(spark, hide):
    docs, labels = fixture(hide=hide)
    truth = {k: t for k, t, _ in labels}
    got = toxicity.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    return np.mean([p for p, t in held if t]), np.mean([p for p, t in held if not t])


def test_held_out_texts(spark):
    found, wrong = accuracy(spark, hide=False)
    assert found >= 0.95 and wrong <= 0.02


def test_disguised_words_are_restored(spark):
    """The labelled words are plain; the held-out ones are disguised."""
    found, wrong = accuracy(spark, hide=True)
    assert found >= 0.85 and wrong <= 0.02


def channel():
    rng = random.Random(2)
    counts = np.zeros((27, 27, 27)) + 0.01
    for word in ["idiot", "stupid", "moron", "worthless", "thing", "of", "that"] * 20:
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1 + rng.random() / 100
    return toxicity.Channel(np.log(counts / counts.sum(axis=2, keepdims=True)))


def test_channel():
    given = {"1d10t": "idiot", "stup1d": "stupid", "m0r0n": "moron", "i.d.i.o.t": "idiot", "idiiiot": "idiot", "w0rthle$$": "worthless"}
    restored = channel()
    assert {k: restored.restore(k) for k in given} == given


def test_channel_search_is_exhaustive():
    """Against the best of all paths."""
    import itertools

    c = channel()
    for word in ["1d10t", "st0pp", "i!i", "aab"]:
        choices, before = [], ""
        for sign in word:
            if sign.isalpha():
                own = [(sign, 0.0)]
            else:
                own = [(x, -1.0) for x in toxicity.LOOKS_LIKE.get(sign, "")] + [("", -3.5)]
            if sign == before:
                own = [o for o in own if o[0]] + [("", -1.5)]
            choices.append(own)
            before = sign

        def value(path):
            codes = [0, 0, *(ord(x) - 96 for x, _ in path if x), 0]
            return sum(p for _, p in path) + sum(c.model[a, b, d] for a, b, d in zip(codes, codes[1:], codes[2:]))

        best = max(itertools.product(*choices), key=value)
        assert c.restore(word) == "".join(x for x, _ in best)


def test_odd_rows(spark):
    docs, labels = fixture(300)
    odd = [(None, None, "", ""), (None, "", "", ""), (7, "", "", ""), (7, "x" * 100_000, "", ""), (8, docs[8][1], "", "")]
    more = [(None, 1, 0), (3, None, 1), (4, 1, 1), (4, 0, 0), (99_999, 1, 1)]
    got = toxicity.toxicity(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS)).collect()
    assert len(got) == 305 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False, False]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "", "")], DOCS), spark.createDataFrame([], LABELS)
    assert [r["predicted"] for r in toxicity.toxicity(docs, labels).collect()] == [0]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def english():
    rng = random.Random(3)
    counts = np.zeros((27, 27, 27)) + 0.01
    for word in ["idiot", "stupid", "moron", "worthless", "you", "i", "a", "the", "an", "am", "is"] * 20:
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1 + rng.random() / 100
    return toxicity.Channel(np.log(counts / counts.sum(axis=2, keepdims=True)))


def holds(text, word, channel):
    """Whether the whole ``word`` is a feature of ``text``, between two other texts."""
    texts = [b"x y", text.encode(), b"a n"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    found = toxicity.word_features(data, np.cumsum([0, *map(len, texts)]), channel)
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    wanted = toxicity._features(raw, np.array([0]), np.array([len(raw)]))[0, 0]
    return bool((found.features[found.row == 1, 0] == wanted).any())


def test_spaced_words_are_one_lattice():
    c = english()
    for text in ["i d i o t", "i d 1 o t", "1 D 1 0 T", "i i d i o t", "i dd i oo t", "i d ¡ o t", "a i d i o t", "I i d i o t",
                 "y o u i d i o t", "y o u  i d i o t", "so i  d  i  o  t", "i, d, i, o, t", "i - d - i - o - t", "i d ! o t !"]:
        assert holds(text, "idiot", c), text
    assert holds("m 0 r 0 n", "moron", c) and holds("y o u m 0 r o n", "you", c)
    assert not holds("i d i", "idiot", c) and not holds("o t", "idiot", c)


def test_word_breaks_of_the_channel():
    c = english()
    assert c.restore("y o u\ni d 1 o t", 1.0) == "you idiot"
    assert c.restore("i d i o t") == "idiot" == c.restore("idiot")


def test_disguises_of_any_length():
    c = english()
    assert holds("i" * 40 + "diot", "idiot", c) and holds(("." * 12).join("idiot"), "idiot", c)
    passage = "   ".join(" ".join(w) for w in ["you", "idiot", "moron", "stupid"] * 30)
    assert all(holds(passage, w, c) for w in ["you", "idiot", "moron", "stupid"])
    assert holds(".".join("youidiotmoron" * 5), "idiot", c)
    assert holds(" ".join("youidiot" * 40), "idiot", c)
    assert c.restore("i" * 200_000 + "diot") == "idiot"


def test_look_alikes_beside_or_instead_of_letters():
    c = english()
    for text in ["1diot!!!", '"1diot",', "(1d10t)", "!d!ot!", "¡diot", "¡d¡ot!", "so,1d10t/you", "1diot...", "1d10+", "id10t;"]:
        assert holds(text, "idiot", c), text
    assert holds("57up1d", "stupid", c) and holds("w0rth1€ss", "worthless", c) and holds("wor7h£e$$!!", "worthless", c)
    # Without a letter.
    assert c.restore("15") == "is" and holds("15", "is", c) and holds("!5!!", "is", c)
    assert not holds("!!!", "i", c)


def leet():
    rng = random.Random(4)
    counts = np.zeros((27, 27, 27)) + 0.01
    for word in ["leet", "tea"] * 20:
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1 + rng.random() / 100
    return toxicity.Channel(np.log(counts / counts.sum(axis=2, keepdims=True)))


def test_words_of_look_alikes_only():
    assert holds("1337", "leet", leet()) and holds("1337!!", "leet", leet()) and holds("(7€4)", "tea", leet())
