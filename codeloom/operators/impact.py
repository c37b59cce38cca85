"""Impact of many changes at once, across languages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graphs import strong_components
from codeloom.session import shared_folder, written

#: Seeds that share a word of bits.
WORD = 64
FILE, ROUTE, COMPONENT = "file", "route", "component"


def _file(path: str) -> Column:
    return F.concat(F.lit(f"{FILE}:"), F.col(path))


def uses(imports: DataFrame, bridges: DataFrame, resources: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``repo_id, src, dst``: what uses what, for files of all languages.

    ``imports``: ``repo_id, source_file, target_file``.  ``bridges``: the edges of
    ``bridges.bridge_edges``, by which a caller uses a route and a route the file that
    defines it.  ``resources``: ``repo_id, resource_path, language``, by which the part of
    a repository in a language uses the resource file.  ``symbols``: the edges of
    ``symbols.symbol_edges``, by which a file uses the one that declares a name.
    """
    plain = imports.select("repo_id", _file("source_file").alias("src"), _file("target_file").alias("dst"))

    def bridged(end: str) -> Column:
        is_route = F.col(end).startswith("route:")
        return F.when(is_route, F.col(end)).otherwise(F.regexp_replace(end, r"^[^:]*:", f"{FILE}:"))

    routed = bridges.select("repo_id", bridged("src").alias("src"), bridged("dst").alias("dst"))
    shared = resources.where("language IS NOT NULL").select(
        "repo_id", F.concat(F.lit(f"{COMPONENT}:"), "language").alias("src"), _file("resource_path").alias("dst")
    )
    found = plain.unionByName(routed).unionByName(shared)
    if symbols is not None:
        def declaring(end: str) -> Column:
            return F.regexp_replace(F.regexp_replace(end, r"#\w+$", ""), r"^[^:]*:", f"{FILE}:")

        found = found.unionByName(symbols.select("repo_id", declaring("src").alias("src"), declaring("dst").alias("dst")))
    return found.distinct()


def _in(components: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of their node ``name`` in its place; a node on no cycle
    is its own component."""
    known = components.select(F.col("node").alias(name), "component")
    return rows.join(known, name, "left").withColumn(name, F.coalesce("component", name)).drop("component")


def _numbered(seeds: DataFrame) -> DataFrame:
    """``node, word, bit``: neighbours in order share a word; numbers are stored, so that
    they are the same for all readers."""
    dealt = seeds.select("node").distinct().repartitionByRange("node").sortWithinPartitions("node")
    numbers = written(dealt.select("node", F.monotonically_increasing_id().alias("number")))
    return numbers.select("node", F.shiftright("number", 6).alias("word"), (F.col("number") % WORD).cast("int").alias("bit"))


def _spread(own: DataFrame, users: DataFrame) -> DataFrame:
    """``node, word, bits, level``: the seeds that each node depends on, directly or not.

    ``own(node, word, bits)`` is level 0.  Level by level: what is new is sent to users,
    combined by node and word, and what a node has had before is taken off.  A level is
    written once, into its own folder of one table; the bits of a node on all levels are
    disjoint, so what is written grows with the answer and not with the depth.  Plans have
    the same few scans at any depth.
    """
    spark = own.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    table, level, schema = f"{folder}/levels-{uuid.uuid4().hex}", 0, own.schema
    own.write.parquet(f"{table}/level=0")
    while True:
        last = spark.read.schema(schema).parquet(f"{table}/level={level}")
        if last.isEmpty():
            return spark.read.schema(schema).option("basePath", table).parquet(table)
        known = spark.read.schema(schema).parquet(table).groupBy("node", "word").agg(F.bit_or("bits").alias("known"))
        sent = last.join(users, "node").groupBy(F.col("user").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        new = sent.join(known, ["node", "word"], "left").select(
            "node", "word", F.expr("bits & ~coalesce(known, 0L)").alias("bits")
        )
        level += 1
        new.where("bits <> 0").write.parquet(f"{table}/level={level}")


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``repo_id, path, files, routes, components``: for each seed, how many other files
    depend on it, directly or not, and how many routes and parts of its repository in a
    language do.

    ``edges``: those of ``uses``; ``seeds``: ``repo_id, path``, as many as there are.  Each
    seed counts once; one that nothing uses, or that is in no edge, has zeros.  Rows with a
    null are no seeds and no edges.

    Circles are one node each (strongly connected components), so what reaches one of
    their files reaches all.  Seeds are bits of words that travel together: a node that 64
    neighbouring seeds reach is one row, not 64, and the counts are added up by word and
    bits before bits become rows.  Rounds are as many as the longest shortest path of the
    condensed graph.
    """
    def key(name: Column) -> Column:
        return F.concat(F.col("repo_id").cast("string"), F.lit(":"), name)

    links = written(
        edges.where("repo_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
        .select(key(F.col("src")).alias("a"), key(F.col("dst")).alias("b")).distinct()
    )
    asked = seeds.where("repo_id IS NOT NULL AND path IS NOT NULL").select(
        "repo_id", "path", key(_file("path")).alias("node")
    ).distinct()
    components = strong_components(links)
    users = written(
        _in(components, _in(components, links, "a"), "b").where("a <> b")
        .select(F.col("b").alias("node"), F.col("a").alias("user")).distinct()
    )
    numbered = _numbered(asked)
    own = _in(components, numbered, "node").groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    reached = _spread(own, users)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).union(asked.select("node")).distinct()
    kind = F.split_part("name", F.lit(":"), F.lit(2))
    counted = [F.count_if(kind == name).alias(f"{name}s") for name in (FILE, ROUTE, COMPONENT)]
    totals = ["files", "routes", "components"]
    members = _in(components, nodes.select(F.col("node").alias("name"), "node"), "node").groupBy("node").agg(*counted)
    words = reached.join(members, "node").groupBy("word", "bits").agg(*[F.sum(n).alias(n) for n in totals])
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1)
    by_seed = words.select("word", F.explode(bits).alias("bit"), *totals).groupBy("word", "bit").agg(
        *[F.sum(n).alias(n) for n in totals]
    )
    found = numbered.join(by_seed, ["word", "bit"]).select("node", *totals)
    return asked.join(found, "node").select("repo_id", "path", (F.col("files") - 1).alias("files"), "routes", "components")
