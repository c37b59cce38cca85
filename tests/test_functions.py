import random

from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import braces, text
from codeloom.functions.arrays import running_sum
from codeloom.session import cut_lineage


def column(spark, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, v {kind}")


def collect(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_running_sum(spark):
    rng = random.Random(1)
    lists = [[rng.randint(-3, 3) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 64, 1000)]
    expected = [[sum(v[: k + 1]) for k in range(len(v))] for v in lists]
    assert collect(column(spark, lists, "array<int>"), running_sum("v")) == expected


def scan_partner(string):
    """number of each opening brace -> number of its partner, by direct scan."""
    places = [i for i, c in enumerate(string) if c in "{}"]
    out = {}
    for a, start in enumerate(places):
        if string[start] != "{":
            continue
        depth = 0
        for b in range(a, len(places)):
            depth += 1 if string[places[b]] == "{" else -1
            if depth == 0:
                out[a + 1] = b + 1
                break
    return out


def test_brace_partners_on_random_text(spark):
    rng = random.Random(2)
    strings = ["".join(rng.choice("{}x") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = column(spark, strings).withColumn("chunks", braces.brace_chunks(F.col("v")))
    got = collect(df, braces.brace_partners("chunks"))
    for string, pairs in zip(strings, got):
        assert [p["nr"] for p in pairs] == list(range(1, len(pairs) + 1))
        assert {p["nr"]: p["close"] for p in pairs if p["close"]} == scan_partner(string), string


def test_strip_is_that_of_python(spark):
    values = [" a ", "\t\x0b\x0c\r\n a b \x1c 　", "\xa0x\x85", "", "  ", "​z"]
    assert collect(column(spark, values), text.strip(F.col("v"))) == [v.strip() for v in values]


def test_code_lines(spark):
    values = ["", "\n", "a", " # x\n#y\n z # w\n\n\t\n", "// a\n /b\n//\n  //\nx", "\x1c\n a\n"]

    def count(value, mark):
        return len([
            line for line in value.split("\n")
            if line.strip() and not line.strip().startswith(mark)
        ])

    for mark in ("#", "//"):
        assert collect(column(spark, values), text.code_lines(F.col("v"), mark)) == [
            count(v, mark) for v in values
        ]


def test_paths(spark):
    values = ["a.py", "a/b.py", "a/b/.env", "a/b/c"]
    df = column(spark, values)
    assert collect(df, text.basename(F.col("v"))) == ["a.py", "b.py", ".env", "c"]
    assert collect(df, text.dirname(F.col("v"))) == ["", "a", "a/b", "a/b"]


def test_unicode_names(spark):
    assert collect(column(spark, ["class Größe"]), text.find_all(F.col("v"), r"class\s+(\w+)", 1)) == [
        ["Größe"]
    ]


def test_cut_lineage_keeps_rows(spark):
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert cut.agg(F.sum("x")).first()[0] == 90


def test_folded_meets_what_matches_without_case(spark):
    values = ["REDİS KAFKA", "ſqſ redıs", "\u212aafka", "Ärger", ""]
    assert collect(column(spark, values), text.folded(F.col("v"))) == [
        "redis kafka", "sqs redis", "kafka", "ärger", "",
    ]
    words = rules.QUEUE_PATTERNS[0]
    hits = collect(column(spark, values), text.found(F.col("v"), words))
    low = collect(column(spark, values), text.may_match(text.folded(F.col("v")), words))
    assert [a or not b for a, b in zip(low, hits)] == [True] * 5 and low == [True, True, True, False, False]
