import random

from codeloom.operators import graphs


def brute(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for e in edges for x in e}
    all_reach = {n: reach(n) for n in nodes}
    out = {}
    for n in nodes:
        same = {m for m in all_reach[n] if n in all_reach[m]} | {n}
        if len(same) > 1:
            out[n] = min(same)
    return out


def got(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long").repartition(2)
    return {r["node"]: r["component"] for r in graphs.strong_components(frame).collect()}


def ring(nodes):
    return list(zip(nodes, nodes[1:] + nodes[:1]))


GRAPHS = {
    "chain": [(k, k + 1) for k in range(700)],
    "ring": ring(list(range(50, 900))),
    "ring with a tail in and out": [(1, 2), *ring([2, 3, 4]), (4, 9), (9, 10)],
    "chain from a node to itself": [(7, 1), (1, 2), (2, 7), (7, 20), (20, 21), (21, 7), (30, 7), (7, 31)],
    "line of rings": [e for r in range(12) for e in ring([5 * r, 5 * r + 1, 5 * r + 2]) + [(5 * r, 5 * r + 2), (5 * r + 2, 5 * r + 5)]],
    "two rings by a chain": ring([1, 2, 3, 4]) + ring([50, 51, 52]) + [(2, 4), (3, 10), (10, 11), (11, 50), (52, 51)],
    "loops and repeats": [(1, 1), (1, 2), (1, 2), (3, 3), (2, 4)],
    "pairs": [(1, 2), (2, 1), (3, 2), (4, 3), (3, 4)],
    "long ring with chords": ring(list(range(300))) + [(k, k + 7) for k in range(0, 280, 20)] + [(299, 400), (400, 401)],
}


def random_graph(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 30, 60])
    return [(rng.randrange(size), rng.randrange(size)) for _ in range(int(size * rng.choice([1.0, 1.3, 2.0])))]


def test_all_shapes_as_one_graph(spark):
    # Apart from each other, so that all take the rounds of one search.
    shapes = [*GRAPHS.values(), *map(random_graph, range(12))]
    edges = [(10_000 * k + a, 10_000 * k + b) for k, shape in enumerate(shapes) for a, b in shape]
    assert got(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert graphs.strong_components(spark.createDataFrame([], "a string, b string")).count() == 0
