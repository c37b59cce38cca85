"""Strongly connected components of large directed graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import written

#: Rounds of trimming before colours are spread.
TRIMS = 3


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("a", "b").distinct()


def _chain_ends(steps: DataFrame, rounds: int) -> DataFrame:
    """``way, node, end, low, open`` for ``steps(way, node, to)``, one of each way and node.

    Pointer doubling: each round a node looks as far again as the node that it has
    reached.  ``end`` is the first node that has no step; ``open`` nodes are on a
    cycle of steps, of which ``low`` is then the smallest node.
    """
    state = written(
        steps.select("way", "node", F.col("to").alias("end"), F.col("node").alias("low"), F.lit(True).alias("open"))
    )
    for _ in range(rounds):
        ahead = state.select("way", F.col("node").alias("end"), F.col("end").alias("next"), F.col("low").alias("next_low"))
        state = written(
            state.join(ahead, ["way", "end"], "left").select(
                "way", "node", F.coalesce("next", "end").alias("end"),
                F.least("low", F.coalesce("next_low", "low")).alias("low"), F.col("next").isNotNull().alias("open"),
            )
        )
        if state.where("open").isEmpty():
            break
    return state


def _without_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges`` with an edge in place of each chain; ``node, head, tail`` of the nodes of
    chains; and ``node, component`` of cycles of such nodes alone.

    A node with one edge in and one out is in a component with others only if the
    nodes before and after its chain are in that component.
    """
    ins, outs = edges.groupBy("b").agg(F.count("*").alias("n")), edges.groupBy("a").agg(F.count("*").alias("n"))
    single = written(
        ins.where("n = 1").select(F.col("b").alias("node")).join(outs.where("n = 1").select(F.col("a").alias("node")), "node")
    )
    rounds = math.ceil(math.log2(max(single.count(), 1))) + 2
    ahead = edges.select(F.lit(1).alias("way"), F.col("a").alias("node"), F.col("b").alias("to"))
    back = edges.select(F.lit(-1).alias("way"), F.col("b").alias("node"), F.col("a").alias("to"))
    ends = _chain_ends(ahead.unionByName(back).join(single, "node", "left_semi"), rounds)
    cycles = ends.where("open AND way = 1").select("node", F.col("low").alias("component"))
    chains = written(
        ends.where("NOT open").groupBy("node").agg(
            F.max(F.when(F.col("way") == -1, F.col("end"))).alias("head"),
            F.max(F.when(F.col("way") == 1, F.col("end"))).alias("tail"),
        )
    )
    rest = edges.join(single, F.col("a") == F.col("node"), "left_anti").join(single, F.col("b") == F.col("node"), "left_anti")
    short = chains.select(F.col("head").alias("a"), F.col("tail").alias("b"))
    return written(_links(rest.unionByName(short))), chains, cycles


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those of nodes that have none in or none out."""
    for _ in range(TRIMS):
        left = written(
            edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            .join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        )
        if left.count() == edges.count():
            return left
        edges = left
    return edges


def _spread(edges: DataFrame, phase: int) -> DataFrame:
    """``node, colour``: of the nodes from which a node can be reached, the first in a
    random order of the phase."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    own = F.struct(F.xxhash64("node", F.lit(phase)).alias("rank"), F.col("node").alias("root"))
    state = written(nodes.select("node", own.alias("colour"), F.lit(True).alias("new")))
    while not state.where("new").isEmpty():
        # Only what changed last is sent on, at its smallest.
        changed = state.where("new").select(F.col("node").alias("a"), "colour")
        sent = edges.join(changed, "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("sent"))
        better = F.coalesce(F.col("sent") < F.col("colour"), F.lit(False))
        state = written(
            state.select("node", "colour").join(sent, "node", "left")
            .select("node", F.when(better, F.col("sent")).otherwise(F.col("colour")).alias("colour"), better.alias("new"))
        )
    return state.select("node", F.col("colour.root").alias("colour"))


def _reaching_roots(inside: DataFrame) -> DataFrame:
    """``node, colour`` of the nodes that reach the root of their colour by edges ``inside`` it."""
    roots = inside.where("b = colour").select(F.col("colour").alias("node"), "colour").distinct()
    before = inside.select(F.col("a").alias("before"), F.col("b").alias("node"), "colour")
    state = written(roots.withColumn("new", F.lit(True)))
    while not state.where("new").isEmpty():
        found = (
            state.where("new").join(before, ["node", "colour"]).select(F.col("before").alias("node"), "colour").distinct()
            .join(state, ["node", "colour"], "left_anti")
        )
        # Dealt anew, as a union has the partitions of both.
        both = state.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True)))
        state = written(both.repartition("node"))
    return state.select("node", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes on cycles of ``edges(a, b)``; a component is named
    by its smallest node.  Nodes on no cycle have no row, loops are no cycles.

    Each phase contracts chains by pointer doubling, in rounds that grow with the
    logarithm of their length, trims nodes without edges in or out, and spreads
    colours forward, of which the first in a random order wins.  The nodes with the
    colour of a root that reach it, found by spreading back within the colour, are its
    component; components of one phase are found together, and only edges inside a
    colour go to the next, which cuts a line of components at random.  Rounds of
    spreading are as many as the longest shortest path between what is left.
    """
    edges = written(_links(edges))
    found, chains = None, []
    while not edges.isEmpty():
        edges, chain, cycles = _without_chains(edges)
        chains.append(chain)
        found = cycles if found is None else found.unionByName(cycles)
        edges = _trimmed(edges)
        if edges.isEmpty():
            break
        colours = _spread(edges, len(chains))
        inside = written(
            edges.join(colours.select(F.col("node").alias("a"), "colour"), "a")
            .join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b")
            .where("colour = other").select("a", "b", "colour")
        )
        reached = _reaching_roots(inside)
        found = found.unionByName(reached.select("node", F.col("colour").alias("component")))
        done = reached.select("node")
        edges = written(
            inside.join(done, F.col("a") == F.col("node"), "left_anti").join(done, F.col("b") == F.col("node"), "left_anti").select("a", "b")
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Chains of later phases lie in the contracted graph of earlier ones.
    for chain in reversed(chains):
        head = found.select(F.col("node").alias("head"), "component")
        tail = found.select(F.col("node").alias("tail"), F.col("component").alias("other"))
        # A chain that comes back to where it began makes a component with that node.
        closed = chain.where("head = tail").select("node", F.col("head"), F.col("tail"))
        found = written(
            found.unionByName(
                chain.where("head <> tail").join(head, "head").join(tail, "tail").where("component = other").select("node", "component")
            ).unionByName(
                closed.join(head, "head", "left").select("node", F.coalesce("component", "head").alias("component"))
            ).unionByName(
                closed.select(F.col("head").alias("node")).distinct()
                .join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
            )
        )
    sizes = found.groupBy("component").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    return found.join(sizes, "component").select("node", F.col("low").alias("component"))
