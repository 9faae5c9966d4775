"""What a Spark session needs before plans with Python functions run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_ATTACHED: set[str] = set()
#: What an Arrow batch may hold on its way to and from Python workers, where the session leaves it at Spark's defaults:
#: ten thousand long texts at a time would take hundreds of megabytes of each task, in the JVM and beside it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{8 << 20}b")}


def _bound_batches(spark: SparkSession) -> None:
    for name, (default, value) in BATCHES.items():
        try:
            given = spark.conf.get(name)
        except PySparkException:  # an older Spark does not know it
            continue
        if given == default:
            spark.conf.set(name, value)


def attach(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once per application, bounds the batches that they get,
    and returns the session."""
    _bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app not in _ATTACHED:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="mnemora-")
        archive = os.path.join(folder, "mnemora.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(here.rglob("*.py")):
                out.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(archive)
        _ATTACHED.add(app)
    return spark
