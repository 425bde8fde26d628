"""Continuous extraction of a folder: new files become Markdown rows as they arrive.

Each file stands for itself, so no state and no watermark is needed; the checkpoint remembers which files are done, which is
what skipping existing outputs does for a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark.config import Config
from foliospark.functions.text import file_extension, file_stem
from foliospark.operators.epub import extract_books
from foliospark.operators.extract import extract_documents
from foliospark.sources.files import BINARY, as_text


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.{html,xml,epub}").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return as_text(found.select("path", file_stem("path").alias("id"), file_extension("path").alias("ext"), "length", "content"))


def extract_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Appends each batch of new files to a Parquet table. A batch that is tried again replaces its own rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        books = extract_books(batch.filter("ext = 'epub'").select("id", "content"), config)
        extract_documents(batch.filter("ext <> 'epub'"), config).unionByName(books).write.mode("overwrite").parquet(f"{table.rstrip('/')}/epoch={epoch}")

    return arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
