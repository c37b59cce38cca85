"""The stored corpus of the registered queries."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from check_oracles import DATA
from codeloom.plans import fixture, inputs
from codeloom.plans.inputs import OPEN_FILES, Inputs
from codeloom.sources.corpus import from_text


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test data")
def test_texts_are_neither_shuffled_nor_sorted(spark, tmp_path, monkeypatch):
    folder = f"{DATA}/sf0.001"
    given = Inputs(spark, folder)
    monkeypatch.setattr(inputs, "SPREAD_ROWS", 7)
    derived = given._derived(fixture.files_sql())
    # One file of rows becomes many tasks, however few groups of rows it has.
    assert derived.where("kind = 'python'").rdd.getNumPartitions() >= given.table("part").count() // 7
    plan = derived._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2 and all("p_partkey" in x or "c_custkey" in x for x in exchanges)

    plain = from_text(given._sql(fixture.files_sql(), *inputs.SHORT_TABLES, *inputs.TEXT_TABLES))
    before = spark.conf.get(OPEN_FILES, None)
    given._store(derived, f"{tmp_path}/corpus")
    assert spark.conf.get(OPEN_FILES, None) == before
    stored = spark.read.schema(inputs.FILES_SCHEMA).parquet(f"{tmp_path}/corpus")
    both = [x.select("repo_id", "path", F.sha2("content", 256), "is_utf8", "kind") for x in (stored, plain)]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
    # A task writes the kinds as they come: no file more than tasks and kinds.
    assert all(name.startswith("kind=") or name.startswith(("_", ".")) for name in os.listdir(f"{tmp_path}/corpus"))
