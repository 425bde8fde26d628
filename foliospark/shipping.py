"""Sends this package to the executors' Python workers, and them their rows in small batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows of one Arrow batch sent to Python; texts are long, so Spark's own default of 10,000 is too many.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20
#: So many rows of a batch are Python objects at a time.
PIECE = 64


def ship(spark: SparkSession) -> None:
    """Once per application: Spark's file server hands the package to every executor, so none needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="foliospark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder, "foliospark.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix != ".pyc":
                out.write(p, Path("foliospark", p.relative_to(root)))
    context.addPyFile(str(to))
    _sent.add(context.applicationId)


def arrow_rows(spark: SparkSession) -> None:
    """Keeps Arrow batches small, unless the session names a size of its own; the workers get this package."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def pieces(*columns: pa.Array):
    """The columns of a batch as lists, PIECE rows at a time, so what a worker holds doesn't grow with the batch."""
    for at in range(0, len(columns[0]), PIECE):
        yield tuple(c.slice(at, PIECE).to_pylist() for c in columns)
