"""Every registered query that has SQL agrees with it; the others return rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyrine.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_agrees_with_sql(name, agrees):
    assert agrees(Q.QUERIES[name], Q.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_has_rows(name, spark, sf):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["files", "succeeded", "failed", "characters", "first_characters"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pdf_parts_of_one_small_file_are_read_in_many_tasks(spark, sf, tmp_path, duck):
    """12,000 rows in one row group of one file, of which Spark makes one task by bytes."""
    duck.sql(f"copy (select p_partkey * 60 + i as p_partkey, p_name, p_brand, p_type, p_size from part, range(60) r(i) limit 12000) to '{tmp_path}/part.parquet' (row_group_size 20000)")
    out = Q.QUERIES["x8_x9_pdf_parts"](spark, str(tmp_path))
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) == 3 and sum(tasks) == 96_000 and max(tasks) < 40_000
