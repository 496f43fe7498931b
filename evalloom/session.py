"""Getting a session and this package to where the work runs."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .sources.files import delete

_MADE: set[tuple[SparkSession, str]] = set()
_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch to Python, where the session has Spark's own 64 MB: a batch is held on both sides.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of ``spark``, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches of a session that has Spark's own bound. This changes the session: callers ask for it."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, or below a temporary one where that is unset and Spark is local.
    It goes when the driver's Python ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='evalloom-')}"
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_delete_made)
    _MADE.add((spark, path))
    return path


def _delete_made() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
