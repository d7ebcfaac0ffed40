"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from check_oracle import compare, connect
from workload import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    _, n_rows, problem = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert problem is None
    assert n_rows >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_module():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_changed_edits_of_all_types(spark):
    """Drafts of every line number and type are compared: some of each are changed, and some are not."""
    all_lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_linenumber").count().collect()
    changed = dict(QUERIES["h09_changed_edits_all_types"](spark, SF_DIR).groupBy("l_linenumber").count().collect())
    assert set(changed) == set(range(1, 8)) and all(0 < changed[r.l_linenumber] < r["count"] for r in all_lines)


def test_changed_edits_of_lists(spark):
    from pyspark.sql import functions as F

    from docweft.operators import review as rv
    from docweft.schema import value_struct

    stored = F.when(F.col("id") < 3, value_struct(items=F.array(F.lit("a"), F.lit("b"))))
    rows = spark.createDataFrame([(1, "c"), (2, ""), (3, ""), (4, "c")], "id int, draft string").select(
        "id", F.lit("Tags").alias("label"), F.lit("list").alias("data_type"), "draft", F.lit(None).cast("string").alias("existing_currency"),
        stored.alias("normalized_value"), F.lit(None).cast("string").alias("extracted_value"))
    assert sorted(r.id for r in rv.changed_edits(rv.typed_edit_values(rows)).collect()) == [1, 2, 4]
