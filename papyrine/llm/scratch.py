"""Tables and folders in the store that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a local one is set only where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        root = "file://" + tempfile.mkdtemp(prefix="papyrine-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new place in the shared folder; deleted at exit, or by release unless it is to be kept till then."""
    path = f"{shared_root(spark)}/papyrine/{name}-{uuid.uuid4().hex}"
    (_kept if kept else _made).append((spark, path))
    return path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what ``stored`` has written; only for callers whose results no longer read it."""
    for s, path in _made:
        try:
            _delete(s, path)
        except Exception as e:  # noqa: BLE001 - a session that has ended takes its store's connection with it
            print(f"scratch folder stays: {path}: {type(e).__name__}")
    _made.clear()


@atexit.register
def _at_exit() -> None:
    for s, path in _made + _kept:
        try:
            if s.sparkContext._jsc is not None:
                _delete(s, path)
        except Exception:  # noqa: BLE001, PERF203 - the JVM may be gone already
            return
