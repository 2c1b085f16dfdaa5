"""This package for the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Arrow batches for Python workers: rows and bytes at most, where the session sets neither (Spark's own: 10,000 rows of
#: any length). Batches of long texts would otherwise fill the memory beside the executors' heaps. They are set for the
#: session, as Spark reads them when a plan runs; a session that sets its own keeps them.
BATCH_ROWS, BATCH_BYTES = "2000", "8388608"


def _smaller_batches(spark: SparkSession) -> None:
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; Spark serves the archive itself."""
    _smaller_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_veilspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    fd, archive = tempfile.mkstemp(prefix="veilspark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "veilspark").rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    context.addPyFile(archive)
    atexit.register(lambda: Path(archive).unlink(missing_ok=True))
    context._veilspark_shipped = True
