"""Spark session helpers.

Library code never creates its own cluster settings; it only reads what the
session already has.  ``local_session`` is for tests, the bench and ad-hoc
runs on one machine.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SHIPPED = "textlab_code.zip"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "textlab") -> SparkSession:
    """A single-JVM session sized for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # one-file tables: deal their texts out to all threads (off unless asked for)
        .config("textlab.scan.partitions", str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        # local runs only: catalog tables (bucketed layout tests) go to a temp folder
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="textlab-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``.  Only a single-machine
    master (``local[..]``: tests, bench) may fall back to a local folder; any
    other session without the setting is refused, because its executors would
    each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textlab-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return "/".join((ensure_checkpoint_dir(spark).rstrip("/"), "textlab-io", f"{name}-{uuid.uuid4().hex}"))


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors where their path does not hold it."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or _SHIPPED in sc._python_includes:
        return
    file = Path(tempfile.mkdtemp(prefix="textlab-code-")) / _SHIPPED
    with zipfile.ZipFile(file, "w") as z:
        for source in root.rglob("*.py"):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(file))
