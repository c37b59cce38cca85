import random

import pytest

from codeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, key string"


def docs(spark, rows):
    return spark.createDataFrame([(a, b, c, 1, "k") for a, b, c in rows], SCHEMA)


def targets(sizes, weights=(3, 1, 2), multiple=1.5, most=2.0):
    """Share by weight, cap, and share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while open_:
        rest = multiple * sum(sizes.values()) - sum(target[s] for s in order if s not in open_)
        rate = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > most * sizes[s]}
        for s in open_:
            target[s] = most * sizes[s] if s in over else weight[s] * rate
        if not over:
            break
        open_ -= over
    return target


def rows_of(seed, count):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "z", "hot"]
    return [
        (k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), rng.choice([*names, "hot", "hot"]))
        for k in range(count)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    rows = rows_of(seed, 600) + [(1000, None, "a"), (1001, "", None), (1002, " \t\n", "empty")]
    got = mixing.mix(docs(spark, rows)).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = {}
    for doc_id, _, source in rows:
        total[source] = total.get(source, 0) + size[doc_id]
    wanted = targets(total)
    taken = dict.fromkeys(total, 0)
    for row in got:
        assert row["_size"] == size[row["doc_id"]] and row["_source_size"] == total[row["source"]]
        assert abs(row["_target"] - wanted[row["source"]]) < 1e-6
        assert 0 <= row["_copies"] <= 2
        taken[row["source"]] += row["_size"] * row["_copies"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 30
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((r["doc_id"], r["_copies"]) for r in got) == sorted((r["doc_id"], r["_copies"]) for r in again)


def test_levels_are_refined(spark, monkeypatch):
    """Two bits of the key at a time: many levels, the same choice."""
    rows = rows_of(5, 300)
    whole = sorted((r["doc_id"], r["_copies"]) for r in mixing.mix(docs(spark, rows)).collect())
    monkeypatch.setattr(mixing, "LEVEL_BITS", 4)
    assert whole == sorted((r["doc_id"], r["_copies"]) for r in mixing.mix(docs(spark, rows)).collect())


def test_equal_rows_go_together_and_null_ids(spark):
    rows = [(1, "a b c", "s")] * 5 + [(None, "x y", "t"), (None, None, None), (2, "q", "s")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 8 and len({r["_copies"] for r in got if r["doc_id"] == 1}) == 1


def test_mixed_repeats_rows(spark):
    rows = rows_of(7, 200)
    frame = docs(spark, rows)
    copies = {r["doc_id"]: r["_copies"] for r in mixing.mix(frame).collect()}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    found = {}
    for row in out.collect():
        found[row["doc_id"]] = found.get(row["doc_id"], 0) + 1
    assert found == {k: v for k, v in copies.items() if v}


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_clashing_names(spark):
    names = ["_key", "_source", "_whole", "_last_key", "row", "limited", "whole", "a.b", "_Copies", "_size", "_target"]
    rows = [(k, f"w{k} " * (k % 5 + 1), "ab"[k % 2], *([str(k)] * len(names))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    plain = {r.doc_id: (r._size, r._source_size, r._target, r._copies) for r in mixing.mix(docs(spark, [r[:3] for r in rows])).collect()}
    got = mixing.mix(frame)
    assert got.columns == ["doc_id", "text", "source", *names[:8], *mixing.ADDED]
    for row in got.collect():
        assert set(row[3:11]) == {str(row.doc_id)} and tuple(row[11:]) == plain[row.doc_id]
    taken = mixing.mixed(frame)
    assert taken.columns == frame.columns
    assert sorted(tuple(r) for r in taken.collect()) == sorted(r for r in rows for _ in range(plain[r[0]][3]))
