"""Documents that arrive in a directory, extracted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.extraction import ExtractionConfig, extract
from ..sources.files import SCHEMA


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files under path as rows of a stream."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)


def index_stream(spark: SparkSession, path: str, out: str, checkpoint: str, config: ExtractionConfig | None = None, once: bool = True):  # noqa: ANN201
    """Extracts new files and appends the results as Parquet at out; with once it ends when all that is there is done.

    The checkpoint remembers what was read, so a run that is started again goes on where the last one ended.
    """
    rows = extract(stream_files(spark, path).drop("length"), config or ExtractionConfig(content=True))
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    return (writer.trigger(availableNow=True) if once else writer).start()
