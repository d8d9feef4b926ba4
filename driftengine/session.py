"""A local session for tests, benches and notebooks; clusters bring their own."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker, in place of Spark's default: several are under way.
ARROW_BATCH, ARROW_DEFAULT = "4m", "67108864b"
PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers: its source goes to the executors once per
    session, as a zip. Not needed where the package is installed on them. Batches sent to the workers
    are bounded in bytes, unless the session has a bound of its own."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == ARROW_DEFAULT:
        spark.conf.set(BATCH_SETTING, ARROW_BATCH)
    if getattr(sc, "_driftengine_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="driftengine-")
    path = os.path.join(folder, "driftengine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._driftengine_shipped = True
    return spark


def local_session(cpus: int | None = None, app: str = "driftengine") -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
