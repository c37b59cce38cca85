"""Impact of many seeds against a walk from each."""

from __future__ import annotations

import random

import pytest

from codeloom.operators import impact

EDGES = "repo_id long, src string, dst string"


def walk(edges, seeds):
    users = {}
    for repo, src, dst in edges:
        if None not in (repo, src, dst):
            users.setdefault((repo, dst), set()).add((repo, src))
    found = set()
    for repo, path in seeds:
        if repo is None or path is None:
            continue
        start = (repo, f"file:{path}")
        seen, rest = {start}, [start]
        while rest:
            for user in users.get(rest.pop(), ()):
                if user not in seen:
                    seen.add(user)
                    rest.append(user)
        kinds = [name.split(":", 1)[0] for _, name in seen]
        found.add((repo, path, kinds.count("file") - 1, kinds.count("route"), kinds.count("component")))
    return found


def counted(spark, edges, seeds):
    rows = impact.impact(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "repo_id long, path string")).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_circles_and_a_hub(spark, seed):
    rng = random.Random(seed)

    def name():
        kind = rng.choice(["file", "file", "file", "route", "component"])
        return f"{kind}:n{rng.randrange(60)}:x" if kind == "route" else f"{kind}:n{rng.randrange(60)}"

    edges = [(rng.choice([0, 0, 1]), name(), name()) for _ in range(130)]
    edges += [(0, f"file:user{k}", "file:hub") for k in range(100)] + [(0, "file:hub", "file:n1")]
    seeds = [(r, f"n{k}") for r in (0, 1) for k in range(60)] + [(0, f"user{k}") for k in range(100)] + [(0, "hub"), (0, "lost"), (7, "n1")]
    assert counted(spark, edges, seeds) == walk(edges, seeds)


def test_a_chain_with_a_circle_at_its_end(spark):
    edges = [(1, f"file:c{k}", f"file:c{k + 1}") for k in range(12)] + [(1, "file:c12", "file:c9")]
    seeds = [(1, f"c{k}") for k in range(13)]
    assert counted(spark, edges, seeds) == walk(edges, seeds)
    assert (1, "c12", 12, 0, 0) in counted(spark, edges, seeds)


def test_nulls_repeats_and_nothing(spark):
    edges = [(1, "file:a", "file:b"), (1, "file:a", "file:b"), (1, "file:b", "file:b"), (None, "file:a", "file:b"), (1, None, "file:b"), (1, "file:a", None)]
    seeds = [(1, "b"), (1, "b"), (None, "b"), (1, None), (2, "b"), (1, "")]
    assert counted(spark, edges, seeds) == {(1, "b", 1, 0, 0), (2, "b", 0, 0, 0), (1, "", 0, 0, 0)}
    assert counted(spark, [], [(1, "b")]) == {(1, "b", 0, 0, 0)}
    assert counted(spark, edges, []) == set()


def test_uses_joins_languages(spark):
    imports = spark.createDataFrame([(1, "u/x.py", "u/a.py")], "repo_id long, source_file string, target_file string")
    bridges = spark.createDataFrame(
        [(1, "javascript:web/c.ts", "route:/api/x", "calls"), (1, "route:/api/x", "python:u/x.py", "implements")],
        "repo_id long, src string, dst string, type string",
    )
    resources = spark.createDataFrame([(1, "cfg/db.json", "go"), (1, "cfg/db.json", None)], "repo_id long, resource_path string, language string")
    symbols = spark.createDataFrame([(1, "java:q/I.java#I", "java:p/B.java#B", "inherits")], "repo_id long, src string, dst string, type string")
    edges = impact.uses(imports, bridges, resources, symbols)
    seeds = spark.createDataFrame([(1, p) for p in ("u/a.py", "cfg/db.json", "p/B.java", "web/c.ts")], "repo_id long, path string")
    assert {tuple(r) for r in impact.impact(edges, seeds).collect()} == {
        (1, "u/a.py", 2, 1, 0), (1, "cfg/db.json", 0, 0, 1), (1, "p/B.java", 1, 0, 0), (1, "web/c.ts", 0, 0, 0)
    }
