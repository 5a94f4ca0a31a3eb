"""Spark sessions for tests, the bench and the smoke check."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session. On a cluster, submit with your own settings instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stemline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions or cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of a session, wherever they run; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="spark-stemline-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/stemline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, f"stemline/{file.relative_to(package)}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
