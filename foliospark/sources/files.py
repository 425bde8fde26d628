"""Where documents come from: folders and files through Spark's readers, or any DataFrame of (id, ext, text or content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.errors import EngineError
from foliospark.functions.text import file_extension, file_stem

EXTENSIONS = ("xml", "html", "epub")  # in the order in which an id is looked up
BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def raw(spark: SparkSession, paths: list[str], scan: bool = True) -> DataFrame:
    """path, id, ext, length, content; a scan lists folders without their subfolders and keeps the known extensions."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if scan:
        reader = reader.option("pathGlobFilter", "*.{html,xml,epub}")
    found = reader.load(paths)
    out = found.select("path", file_stem("path").alias("id"), file_extension("path").alias("ext"), "length", "content")
    return out.filter(F.col("ext").isin(*EXTENSIONS)) if scan else out


def directory(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    if not exists(spark, path):
        if required:
            raise EngineError("not_found", f"{path} does not exist", "name an existing folder")
        return spark.createDataFrame([], "path string, id string, ext string, length long, content binary")
    return raw(spark, [path])


def as_text(files: DataFrame) -> DataFrame:
    """Adds text (null if the bytes are not UTF-8) and reason; ePubs keep their bytes only."""
    good = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when((F.col("ext") != "epub") & good, F.expr("cast(content as string)"))
    return files.withColumns({"text": text, "reason": F.when((F.col("ext") != "epub") & ~good, "not UTF-8")})


def lookup(ids: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) against (id, ext, path): for each id its first file by extension, and the ids without any."""
    rank = F.array_position(F.lit(list(EXTENSIONS)), F.col("ext"))
    known = listing.filter(F.col("ext").isin(*EXTENSIONS)).withColumn("rank", rank)
    first = Window.partitionBy("id").orderBy("rank", "path")
    best = known.join(ids.distinct(), "id", "left_semi").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")
    return best, ids.distinct().join(known.select("id").distinct(), "id", "left_anti")


def one_per_id(files: DataFrame, force: bool = False) -> DataFrame:
    """Files that share a stem write one output: the first by path wins, with force the last."""
    order = F.desc("path") if force else F.asc("path")
    return files.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("n = 1").drop("n")


def markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """book, markdown of Markdown files."""
    found = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markdown"))
    return found.select(file_stem("path").alias("book"), "markdown")
