"""Interface schemas (Protocol Buffers, Thrift) and the code generated from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.arrays import unnest

SCHEMA_FILE = r"\.(proto|thrift)$"
#: Comments and strings; what is left of a schema has only real braces.
SCHEMA_NOISE = r'//[^\n]*|#[^\n]*|/\*(?s:.*?)\*/|"[^"\n]*"'
#: Options, openings of blocks, other braces, and the numbers of fields.
SCHEMA_TOKEN = (
    r"\boption\b[^;{}]*;|\b(?:message|struct|union|exception|enum|service|oneof)\s+\w+[^{};]*\{"
    r"|\{|\}|=\s*\d+\s*(?:\[[^\]]*\]\s*)?;|\b\d+\s*:"
)
#: Blocks that are messages.
MESSAGES = ("message", "struct", "union", "exception")
SCHEMA_PACKAGE = r"\b(?:package|namespace\s+\S+)\s+([\w.]+)"
#: A generated file says so.
GENERATED = "enerated by"


@dataclass(frozen=True)
class Convention:
    """How a generator names files and symbols.

    ``file`` has the stem of the schema's file as its group; an empty group says
    nothing of the schema.  ``form``: the symbol is the message's name with its
    outer messages joined by ``.`` or ``_``, the package before it or not, or the
    message's own name only (``last``).
    """

    name: str
    schema: str
    file: str
    symbol: str
    form: str


CONVENTIONS = (
    Convention("proto-python", "proto", r"([^/]+)_pb2\.py$", r"message_types_by_name\['(\w+)'\]", "last"),
    Convention("proto-go", "proto", r"([^/]+)\.pb\.go$", r"\btype (\w+) struct\b", "underscore"),
    Convention("proto-java", "proto", r"()\.java$", r"\bclass (\w+) extends\s+com\.google\.protobuf\.GeneratedMessage", "last"),
    Convention("proto-csharp", "proto", r"()\.cs$", r"\bpartial class (\w+) : pb::IMessage<", "last"),
    Convention("proto-js", "proto", r"([^/]+)_pb\.js$", r"\bproto\.([\w.]+) = function\(", "package"),
    Convention("thrift-python", "thrift", r"()/ttypes\.py$", r"\bclass (\w+)\(", "last"),
    Convention("thrift-go", "thrift", r"([^/]+)\.go$", r"\btype (\w+) struct\b", "last"),
    Convention("thrift-java", "thrift", r"()\.java$", r"\bclass (\w+) implements org\.apache\.thrift\.TBase<", "last"),
)


def messages(files: DataFrame) -> DataFrame:
    """``repo_id, path, schema, package, message, n_fields`` of all messages of schema files.

    ``message`` has the names of the outer messages before its own, joined by ``.``.
    Fields count for the message that they stand in, those of a ``oneof`` too.
    Comments and strings are no text; an open block ends with the file.

    The tokens of a file are rows.  A running sum of the braces gives the level of
    each, and the last block opened at a level is what holds the tokens of the next.
    """
    text = F.regexp_replace("content", SCHEMA_NOISE, " ")
    schemas = files.filter(F.col("path").rlike(SCHEMA_FILE)).select(
        "repo_id", "path", F.regexp_extract("path", SCHEMA_FILE, 1).alias("schema"),
        F.regexp_extract(text, SCHEMA_PACKAGE, 1).alias("package"),
        F.posexplode_outer(F.regexp_extract_all(text, F.lit(SCHEMA_TOKEN), F.lit(0))).alias("place", "token"),
    )
    file = ("repo_id", "path")
    opens, token = F.col("token").endswith("{"), F.col("token")
    before = Window.partitionBy(*file).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(opens, 1).when(token == "}", -1).otherwise(0)
    levelled = schemas.filter(token.isNotNull()).select(
        *file, "schema", "package", "place", "token", opens.alias("opens"),
        F.coalesce(F.sum(step).over(before), F.lit(0)).alias("level"),
        # The number of the block that a token opens.
        F.coalesce(F.count_if(opens).over(before), F.lit(0)).cast("int").alias("block"),
    )
    # An opening stands at its own level and, as the holder of the tokens, at the next.
    twice = F.explode(F.when(F.col("opens"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("inner")
    held = Window.partitionBy(*file, "at").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    marked = levelled.select("*", twice).withColumn("at", F.col("level") + F.col("inner"))
    holder = F.last(F.when(F.col("inner") == 1, F.col("block")), ignorenulls=True).over(held)
    tokens = marked.withColumn("holder", holder).filter("inner = 0")
    kind = F.regexp_extract("token", r"^(\w+)\s", 1)
    name = F.regexp_extract("token", r"^\w+\s+(\w+)", 1)
    is_field = ~F.col("opens") & token.rlike(r"^=|:$")
    # One row for each file: its blocks in order, and the blocks that its fields stand in.
    grouped = tokens.groupBy(*file, "schema", "package").agg(
        F.array_sort(F.collect_list(F.when(F.col("opens"), F.struct(
            F.col("block"), F.col("holder"), kind.alias("kind"), F.when(kind.isin(*MESSAGES), name).alias("name")
        )))).alias("blocks"),
        F.collect_list(F.when(is_field, F.col("holder"))).alias("fields"),
    )

    def owner(blocks: Column, at: Column) -> Column:
        block = F.get(blocks, at)
        return F.when(block["kind"] == "oneof", block["holder"]).otherwise(at)

    rows = grouped.select(
        *file, "schema", "package", "blocks", F.explode(F.filter("blocks", lambda b: b["name"].isNotNull())).alias("own")
    )
    start = F.struct(F.col("own.holder").alias("at"), F.col("own.name").alias("name"))

    def outward(state: Column, _: Column) -> Column:
        block = F.get("blocks", state["at"])
        named = F.coalesce(F.concat(block["name"], F.lit("."), state["name"]), state["name"])
        return F.when(state["at"].isNull(), state).otherwise(F.struct(block["holder"].alias("at"), named.alias("name")))

    # No block has more outer blocks than blocks before it.
    named = rows.select(
        *file, "schema", "package", F.col("own.block").alias("block"),
        F.aggregate(F.sequence(F.lit(0), F.col("own.block")), start, outward)["name"].alias("message"),
    )
    counted = (
        grouped.select(*file, F.explode(F.transform("fields", lambda at: owner(F.col("blocks"), at))).alias("block"))
        .groupBy(*file, "block").agg(F.count("*").alias("n_fields"))
    )
    return named.join(counted, [*file, "block"], "left").select(
        *file, "schema", "package", "message", F.coalesce("n_fields", F.lit(0)).cast("long").alias("n_fields")
    )


def generated_symbols(files: DataFrame) -> DataFrame:
    """``repo_id, generated_file, convention, stem, symbol``: what generated files declare."""
    kind = "array<struct<convention:string,stem:string,symbol:string>>"

    def declared(c: Convention) -> Column:
        symbols = F.array_distinct(F.regexp_extract_all("content", F.lit(c.symbol), F.lit(1)))
        stem = F.regexp_extract("path", c.file, 1)
        rows = F.transform(symbols, lambda s: F.struct(F.lit(c.name).alias("convention"), stem.alias("stem"), s.alias("symbol")))
        return F.when(F.col("path").rlike(c.file), rows).otherwise(F.array().cast(kind))

    marks = F.flatten(F.array(*map(declared, CONVENTIONS)))
    found = files.filter(F.col("content").contains(GENERATED))
    rows = unnest(found, ["repo_id", F.col("path").alias("generated_file")], marks, "mark").filter("mark IS NOT NULL")
    return rows.select("repo_id", "generated_file", "mark.convention", "mark.stem", "mark.symbol")


def schema_bindings(files: DataFrame) -> DataFrame:
    """``repo_id, message, n_fields, schema_file, convention, generated_file``: messages
    and the generated files of their repository that declare them.

    Each message gives one name for each convention of its schema language, so the
    join is an equality of names.  Some conventions have no stem of the schema in the
    file's name or use the last part of a message's name only; a name that stands for
    several messages of a repository by its convention binds none of them, so a symbol
    gives one row at most.
    """
    dotted = F.col("message")
    forms = {
        "last": F.regexp_extract(dotted, r"(\w+)$", 1),
        "underscore": F.replace(dotted, F.lit("."), F.lit("_")),
        "package": F.concat_ws(".", F.nullif(F.col("package"), F.lit("")), dotted),
    }
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    names = F.array(*[
        F.struct(
            F.lit(c.name).alias("convention"), F.lit(c.schema).alias("of"),
            (F.lit("") if "()" in c.file else stem).alias("stem"), forms[c.form].alias("symbol"),
        )
        for c in CONVENTIONS
    ])
    named = messages(files).select(
        "repo_id", "message", "n_fields", F.col("path").alias("schema_file"),
        F.explode(F.filter(names, lambda n: n["of"] == F.col("schema"))).alias("name"),
    ).select("repo_id", "message", "n_fields", "schema_file", "name.convention", "name.stem", "name.symbol")
    key = ["repo_id", "convention", "stem", "symbol"]
    wanted = (
        named.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("message", "n_fields", "schema_file")).alias("of"))
        .filter("n = 1").select(*key, "of.message", "of.n_fields", "of.schema_file")
    )
    return wanted.join(generated_symbols(files), key).select(
        "repo_id", "message", "n_fields", "schema_file", "convention", "generated_file"
    )
