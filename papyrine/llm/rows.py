"""Rows of any table with a number of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def _scanned(df: DataFrame) -> bool:
    """Whether each row of df is one row of a file that a reader knows the place of: a scan, narrowed at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in df.columns and "parquet" in plan.simpleString(100).lower()


def numbered(df: DataFrame) -> DataFrame:
    """uid long, row struct (the columns of df): a number for each row that is the same whenever it is asked for.

    A scan's rows are numbered by file and place in it. Other tables are written to the shared folder first, as
    their rows might come in another order when a lost task runs again.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    if not _scanned(df):
        return stored(df.select(F.monotonically_increasing_id().alias("uid"), row), "numbered")
    at = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), row)
    # as many rows as the scan has files; the driver has listed them already
    files = sorted(r[0] for r in at.select("file").distinct().collect())
    names = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "file string, base long")
    return at.join(F.broadcast(names), "file").select((F.col("base") + F.col("at")).alias("uid"), "row")
