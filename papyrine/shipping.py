"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
#: Spark's own number of rows in an Arrow batch, and the one used instead: texts and files are long.
_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session's Python files, once for each application.

    Arrow batches get 1,000 rows where the session has Spark's default, so that batches of texts stay small.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ROWS[0], _ROWS[1]) == _ROWS[1]:
        spark.conf.set(_ROWS[0], _ROWS[2])
    if sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="papyrine-src-")
        path = os.path.join(folder, "papyrine_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(_HERE):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(_HERE)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
