"""Written intermediate tables, id-preserving chunk tables and Arrow helpers shared by the operators."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.shipping import arrow_rows as arrow_rows

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    folder = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001 the session is going away; a left-over table does no harm
            return


atexit.register(_clean)


class Written:
    """A DataFrame written to the shared folder and read back: lineage ends here, and a lost executor costs one read."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _written.append((self.spark, self.path))

    def drop(self) -> None:
        """For tables that no returned DataFrame reads any more."""
        delete_path(self.spark, self.path)
        _written.remove((self.spark, self.path))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` through a reliable checkpoint in the shared folder. How its rows are partitioned stays known to the planner, so
    a repartitioned `df` is planned without adaptive execution, which would hide that."""
    spark = df.sparkSession
    context, folder = spark.sparkContext, shared_folder(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: A key that holds over 1 / HOT of all rows is hot; there are fewer than HOT such keys, whatever the table's size.
HOT = 2000
#: So few rows are no burden to a task.
LEAST = 100


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str = "n_") -> DataFrame:
    """Inner join with a `table` of one row a key that says in `count` how many of the `total` rows have it. Its hot keys,
    fewer than HOT of them, are named on the driver and broadcast, so no task gets all rows of one; the others meet in a
    shuffle join."""
    hot = [r[0] for r in table.filter(F.col(count) * HOT > total).filter(F.col(count) > LEAST).select(keys[0]).distinct().collect()]
    if not hot:
        return rows.join(table.hint("merge"), keys)
    named = F.col(keys[0]).isin(hot)
    usual = rows.filter(~named).join(table.filter(~named).hint("merge"), keys)
    return usual.unionByName(rows.filter(named).join(F.broadcast(table.filter(named)), keys))


def strings(column: pa.Array) -> pa.Array:
    """A string column as 64-bit offset strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Cuts a batch so that a slice holds about `limit` bytes of the text column; a longer text is a slice of its own."""
    at, texts = 0, strings(batch.column(column))
    import numpy as np

    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
