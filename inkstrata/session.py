"""Making the package known to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each context; workers then import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_inkstrata_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="inkstrata-")) / "inkstrata.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, str(Path(ROOT.name) / file.relative_to(ROOT)))
    context.addPyFile(str(path))
    context._inkstrata_shipped = True
    return spark


#: Rows in a batch that goes to a Python worker, where the session has Spark's default of 10,000: texts are long.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers and of the buffers beside them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
