"""Session helper. On a cluster the session comes from the outside; this only fills gaps."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", partitions: int = 8, app: str = "gridleaf") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver found it: once per Spark context, as a zip of its modules."""
    context = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_gridleaf_shipped", False) or not os.path.isdir(home):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="gridleaf-"), "gridleaf_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    context._gridleaf_shipped = True
