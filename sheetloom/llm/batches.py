"""What a Python task of this subpackage needs of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sheetloom.session import ship_package

ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ready_workers(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches small: texts are long, and a batch is in memory several times."""
    ship_package()
    if int(spark.conf.get(ROWS_KEY, "10000")) > BATCH_ROWS:
        spark.conf.set(ROWS_KEY, str(BATCH_ROWS))
