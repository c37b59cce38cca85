"""Parameterised routes against matching of all pairs."""

from __future__ import annotations

import random
import re

import pytest

from codeloom.operators import routes


def matched(spark, defined, called):
    """``{(repo, path): (pattern, parameters, callers, definitions)}``."""
    d = spark.createDataFrame(
        [(r, f, "python", 1, None, t) for r, f, t in defined],
        "repo_id long, source_file string, source_language string, pattern_id long, method string, route string",
    )
    c = spark.createDataFrame(
        [(r, f, "java", t) for r, f, t in called],
        "repo_id long, source_file string, source_language string, endpoint string",
    )
    rows = routes.route_matches(d, c).collect()
    return {(r.repo_id, r.route): (r.pattern, r.parameters, r.callers, r.definitions) for r in rows}


def test_most_specific_route_answers(spark):
    defined = [
        (1, "a", "/users/:id"), (1, "b", "/users/{uid}"), (1, "c", "/users/me"), (1, "d", "/users/<int:id>"),
        (1, "e", "/files/<path:rest>"), (1, "e", "files/{id}/raw"), (2, "x", "/users/:id"),
    ]
    called = [
        (1, "p", "'/users/42'"), (1, "q", "'/users/42?full=1'"), (1, "p", "'/users/me/'"), (1, "p", "'/users/ann'"),
        (1, "p", "`/users/${id}`"), (1, "p", "localhost:80/files/a/b/c"), (1, "p", "'/files/a/raw'"),
        (1, "p", "'/users'"), (1, "p", "'/nowhere/1'"), (2, "p", "'/users/42'"), (2, "p", "'/users/42/x'"),
    ]
    assert matched(spark, defined, called) == {
        (1, "/users/42"): ("/users/{int}", 1, 2, 1),
        (1, "/users/me"): ("/users/me", 0, 1, 1),
        (1, "/users/ann"): ("/users/{}", 1, 1, 2),
        (1, "/users/${id}"): ("/users/{int}", 1, 1, 1),
        (1, "/files/a/b/c"): ("/files/{*}", 1, 1, 1),
        (1, "/files/a/raw"): ("/files/{}/raw", 1, 1, 1),
        (2, "/users/42"): ("/users/{}", 1, 1, 1),
    }


def test_a_wrong_turn_is_taken_back(spark):
    # The text "b" leads nowhere, the parameter beside it does.
    defined = [(1, "a", "/x/b/c"), (1, "a", "/x/:p/d")]
    assert matched(spark, defined, [(1, "z", "'/x/b/d'")]) == {(1, "/x/b/d"): ("/x/{}/d", 1, 1, 1)}


def test_optional_ends_own_texts_and_empty_tables(spark):
    defined = [(1, "a", "/u/:id?"), (1, "a", "GET '/v/{id?}'"), (1, "a", "/w/<int:n>")]
    called = [(1, "z", "'/u'"), (1, "z", "'/u/1'"), (1, "z", "'/v'"), (1, "a", "'/w/<int:n>'"), (1, "a", "'/u/:id?'")]
    assert matched(spark, defined, called) == {
        (1, "/u"): ("/u", 0, 1, 1), (1, "/u/1"): ("/u/{}", 1, 1, 1), (1, "/v"): ("/v", 0, 1, 1),
    }
    assert matched(spark, [], called) == {}
    assert matched(spark, defined, []) == {}


def test_the_trie_is_not_broadcast(spark):
    # Stored edges are far smaller than in memory; Spark would send all of them through the driver.
    defined = [(1, "a", f"/p{k}/:x/q{k}") for k in range(50)]
    d = spark.createDataFrame(
        [(r, f, "python", 1, None, t) for r, f, t in defined],
        "repo_id long, source_file string, source_language string, pattern_id long, method string, route string",
    )
    c = spark.createDataFrame([(1, "z", "java", "'/p7/1/q7'")], "repo_id long, source_file string, source_language string, endpoint string")
    plans = []
    listened = routes.written
    try:
        routes.written = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or listened(df)
        result = routes.route_matches(d, c)
    finally:
        routes.written = listened
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    walks = [p for p in plans if "step#" in p and "Join" in p] + plans[-1:]
    assert len(walks) > 2 and not any("Broadcast" in p for p in walks)
    assert [r.pattern for r in result.collect()] == ["/p7/{}/q7"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, seed):
    draw = random.Random(seed)
    words = ["a", "b", "7", "42"]
    steps = words + [":p", "{q}", "<int:n>", "{k:int}"]
    ends = steps + ["{*rest}", "<path:p>"]
    defined = list({
        (draw.randrange(2), f"f{draw.randrange(3)}",
         "/" + "/".join([draw.choice(steps) for _ in range(draw.randrange(3))] + [draw.choice(ends)]))
        for _ in range(60)
    })
    called = list({
        (draw.randrange(2), f"g{draw.randrange(3)}", "'/" + "/".join(draw.choice([*words, "${v}", "zz"]) for _ in range(draw.randrange(1, 5))) + "'")
        for _ in range(120)
    })

    def kind(text):
        if text.startswith(("{*", "<path:")):
            return 3, "{*}", ".+"
        if text.startswith("<int") or text.endswith(":int}"):
            return 1, "{int}", r"([0-9]+|[^/]*\{[^/]*)"
        if text[0] in ":{<":
            return 2, "{}", "[^/]+"
        return 0, text, re.escape(text)

    expected = {}
    for repo, path in {(r, t.strip("'")) for r, _, t in called}:
        found = {}
        for owner, file, text in defined:
            kinds = [kind(s) for s in text.split("/")[1:]]
            if owner == repo and re.fullmatch("".join("/" + k[2] for k in kinds), path):
                key = (tuple(k[0] for k in kinds), "".join("/" + k[1] for k in kinds))
                found.setdefault(key, set()).add(file)
        if found:
            (ranks, pattern), files = min(found.items())
            callers = len({f for r, f, t in called if (r, t.strip("'")) == (repo, path)})
            expected[repo, path] = (pattern, sum(k > 0 for k in ranks), callers, len(files))
    assert matched(spark, defined, called) == expected
