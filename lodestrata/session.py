"""Session construction for local work; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "lodestrata", cores: int | str | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is written for: UTC, AQE and few shuffle partitions."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    partitions = cores if str(cores).isdigit() else str(os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context, so that they need no path of the driver's."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    package = Path(__file__).parent
    folder = Path(tempfile.mkdtemp(prefix="lodestrata-"))  # the driver's own: what is sent from it is copied by Spark
    atexit.register(shutil.rmtree, folder, True)
    target = folder / "lodestrata_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*")):
            if file.is_file() and "__pycache__" not in file.parts:
                z.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    context._lodestrata_shipped = True
