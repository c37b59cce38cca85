import datetime
import random
import re

from codeloom.llm import url_lists

CAPTURES = "page_id long, url string, fetched date, month string"
ENTRIES = "entry_id long, pattern string, rule string, day date, host string"
DAY = datetime.date(2024, 1, 30)


def patterns(url):
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    if not found:
        return []
    name = found[1].lower()
    labels = name.split(".")
    path = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", url)
    parts = [x for x in (path[1] if path else "").split("/") if x]
    return [".".join(labels[k:]) for k in range(max(len(labels) - 1, 1))] + [
        name + "/" + "/".join(parts[: k + 1]) for k in range(len(parts))
    ]


def brute(capture, entries):
    _, url, fetched = capture
    best = None
    for pattern in patterns(url) if fetched else ():
        own = [e for e in entries if e[1] == pattern and e[2] and e[3] and e[3] <= fetched]
        if own:
            last = max(own, key=lambda e: (e[3], e[0] is not None, e[0] or 0, e[2]))
            if last[2] != "end" and (best is None or len(pattern) > len(best[0])):
                later = [e[3] for e in entries if e[1] == pattern and e[2] and e[3] and e[3] > last[3]]
                best = (pattern, last[2], last[3], min(later, default=None))
    return best or (None,) * 4


def fixture(seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.z.org", "localhost", "HOT.Example.net"]
    urls = [f"http://u@{rng.choice([*hosts, *['hot.example.net'] * 4])}{rng.choice(['', '/', '/en/1', '/en//2?q#f', ':80/en'])}" for _ in range(200)]
    urls += [None, "", "nothing", "http://", "https://a.example.com/" + "p/" * 300]
    day = lambda: DAY + datetime.timedelta(days=rng.randrange(90))
    captures = [(k, u, day()) for k, u in enumerate(urls)] + [(None, urls[0], None), (3, urls[3], DAY), (3, urls[3], DAY)]
    known = sorted({p for u in urls for p in patterns(u)})[:40]
    entries = [(k, rng.choice([*known, *known[:3], None]), rng.choice(["block", "allow", "end", None]), day()) for k in range(300)]
    return captures, [*entries, (500, known[0], "block", None), entries[0]]


def test_against_brute_force(spark):
    for seed in (1, 2):
        captures, entries = fixture(seed)
        frame = spark.createDataFrame([(*c, "m") for c in captures], CAPTURES)
        listed = spark.createDataFrame([(*e, "h") for e in entries], ENTRIES)
        got = url_lists.judge(frame, listed)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((*c, "m", *brute(c, entries)) for c in captures), key=key)


def test_clashing_names(spark):
    names = ["_url", "_fetched", "entry", "row", "a.b", "until", "pattern", "Rule"]
    frame = spark.createDataFrame(
        [(1, "http://a.b/c", DAY, *"12345678")], "page_id long, url string, fetched date, " + ", ".join(f"`{n}` string" for n in names)
    )
    entries = spark.createDataFrame([(1, "a.b", "block", DAY, "h")], ENTRIES)
    got = url_lists.judge(frame, entries)
    assert got.columns == ["page_id", "url", "fetched", *names[:6], *url_lists.ADDED]
    assert tuple(got.first()) == (1, "http://a.b/c", DAY, *"123456", "a.b", "block", DAY, None)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/c", DAY)], "page_id long, url string, fetched date")
    none = spark.createDataFrame([], ENTRIES)
    assert [tuple(r) for r in url_lists.judge(captures, none).collect()] == [(1, "http://a.b/c", DAY, None, None, None, None)]
    assert url_lists.judge(captures.limit(0), none).count() == 0


def test_no_python(spark):
    captures, entries = fixture(1)
    frame = spark.createDataFrame([(*c, "m") for c in captures], CAPTURES)
    got = url_lists.judge(frame, spark.createDataFrame([(*e, "h") for e in entries], ENTRIES))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("MapInArrow|MapInPandas|EvalPython|NestedLoop|Cartesian", plan)
