"""Inputs of the registered queries, read from a folder of Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans import fixture
from codeloom.session import shared_folder
from codeloom.sources.corpus import from_text

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Fixed schemas: reading needs no job to infer them.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}


def as_source(derived: DataFrame) -> DataFrame:
    """Let derived columns behave like stored ones.

    A corpus would be stored; here its columns are long expressions, which
    Catalyst would copy into every filter and projection above them.  It does
    not merge expressions across a generator.
    """
    row = F.struct(*[F.col(name) for name in derived.columns])
    return derived.select(F.inline(F.array(row)))


FILES_SCHEMA = "repo_id long, path string, content string, is_utf8 boolean, kind string"
_STORED: dict[tuple[str, str, str], str] = {}
#: Tables of which a corpus is made: short rows that become a text, and texts.
SHORT_TABLES, TEXT_TABLES = ("part", "customer"), ("documents", "pages")
#: Short rows that become files in one task.
SPREAD_ROWS = 25_000
#: Files that a task may write at a time, more than there are kinds, and bytes of their row groups.
OPEN_FILES, KINDS = "spark.sql.maxConcurrentOutputFileWriters", 32
ROW_GROUP = 32 << 20


class Inputs:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def _spread(self, name: str) -> DataFrame:
        """A table dealt by key, so that what is derived from its short rows is derived in
        many tasks, however few files and row groups it is stored in."""
        rows = self.table(name)
        return rows.repartition(-(-max(rows.count(), 1) // SPREAD_ROWS), rows.columns[0])

    def _sql(self, text: str, *names: str, spread: tuple[str, ...] = ()) -> DataFrame:
        for name in names:
            self.table(name).createOrReplaceTempView(name)
        for name in spread:
            self._spread(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def files(self) -> DataFrame:
        return self._corpus("files", fixture.files_sql())

    def previous_files(self) -> DataFrame:
        return self._corpus("previous", fixture.previous_files_sql())

    def schema_files(self) -> DataFrame:
        return self._corpus("schemas", fixture.schema_files_sql())

    def route_files(self) -> DataFrame:
        return self._corpus("routes", fixture.route_files_sql())

    def symbol_files(self) -> DataFrame:
        return self._corpus("symbols", fixture.symbol_files_sql())

    def cycle_files(self) -> DataFrame:
        return self._corpus("cycles", fixture.cycle_files_sql())

    def _corpus(self, name: str, sql: str) -> DataFrame:
        """A corpus, stored once per application and data folder as a table.

        The queries then read a ``files`` table as they would in use, with only
        the columns they need.  Without a shared folder it is derived each time.
        """
        spark = self.spark
        key = (spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            shared = shared_folder(spark)
            if shared is None:
                return as_source(from_text(self._sql(sql, *SHORT_TABLES, *TEXT_TABLES)))
            target = f"{shared}/corpus-{name}-{uuid.uuid4().hex}"
            self._store(self._derived(sql), target)
            _STORED[key] = target
        return spark.read.schema(FILES_SCHEMA).parquet(_STORED[key])

    def _derived(self, sql: str) -> DataFrame:
        """The files to store: short rows are dealt before texts are made of them, long
        texts stay in the parts in which they are read, so no text is shuffled."""
        return from_text(self._sql(sql, *TEXT_TABLES, spread=SHORT_TABLES))

    def _store(self, derived: DataFrame, target: str) -> None:
        """One partition for each kind of file.

        A task has a file open for each kind, so that it need not sort texts by kind; row
        groups are small for that, and for readers that share a large file.
        """
        before = self.spark.conf.get(OPEN_FILES, None)
        self.spark.conf.set(OPEN_FILES, KINDS)
        try:
            derived.write.partitionBy("kind").option("parquet.block.size", ROW_GROUP).parquet(target)
        finally:
            if before is None:
                self.spark.conf.unset(OPEN_FILES)
            else:
                self.spark.conf.set(OPEN_FILES, before)

    def logs(self) -> DataFrame:
        return as_source(self._sql(fixture.LOG_SQL, "lineitem"))

    def job_events(self) -> DataFrame:
        return self._sql(fixture.JOB_EVENT_SQL, "events")

    def repositories(self) -> DataFrame:
        """Repositories and their owners: one per order."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("repository_id"), F.col("o_custkey").alias("user_id")
        )

    def requests(self) -> DataFrame:
        listed = self._sql(fixture.REQUEST_SQL, "orders")
        return listed.withColumn("languages", F.split("languages", ",")).withColumn(
            "analysis_types", F.split("analysis_types", ",")
        )
