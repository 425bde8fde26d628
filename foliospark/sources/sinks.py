"""Where results go: one file for each document or chapter, in a folder that all executors reach, or a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.errors import EngineError
from foliospark.functions.text import file_stem


def existing(df: DataFrame, outdir: str) -> DataFrame:
    """Stems of the files that a folder holds already; their contents aren't read."""
    spark = df.sparkSession
    from foliospark.sources.files import exists

    if not exists(spark, outdir):
        return spark.createDataFrame([], "id string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(outdir).select(file_stem("path").alias("id"))


def pending(docs: DataFrame, outdir: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to do, to skip), before any content is parsed."""
    if force:
        return docs, docs.limit(0)
    have = existing(docs, outdir)
    return docs.join(have, "id", "left_anti"), docs.join(have, "id", "left_semi")


def write_files(files: DataFrame, force: bool = False) -> None:
    """(path, content): each is written beside its place and moved there, so a retried task leaves no half file. Without
    force, all targets are checked before the first is written."""
    jvm_check = files.select("path")

    def clash(paths):
        import os

        return [r.path for r in paths if os.path.exists(r.path)]

    if not force:
        found = jvm_check.rdd.mapPartitions(clash).take(1)
        if found:
            raise EngineError("output_exists", f"{found[0]} exists; use force to overwrite")

    def write(rows):
        import os
        import uuid

        for r in rows:
            os.makedirs(os.path.dirname(r.path) or ".", exist_ok=True)
            part = f"{r.path}.{uuid.uuid4().hex}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r.content)
            os.replace(part, r.path)

    files.select("path", "content").foreachPartition(write)


def write_table(extracted: DataFrame, path: str, mode: str = "error") -> None:
    extracted.write.mode(mode).partitionBy("source_format").parquet(path)


def output_path(outdir: str, id_col: str = "id"):
    return F.concat(F.lit(outdir.rstrip("/") + "/"), F.col(id_col), F.lit(".md"))
