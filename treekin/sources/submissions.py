"""Sources of submissions: rows, JSON files, folders of C files; and what is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.functions.scalar import strip, upload_reject

JSON = "name string, filename string, source_code string"
# Fixed limits of a request's fields, in characters; all need one at least.
LENGTHS = {"name": 255, "filename": 512, "source_code": None}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON objects, checked."""
    return check_requests(spark.read.schema(JSON).json(path))


def request_reason() -> Column:
    """The first field of a request that is missing, empty or too long, or null."""
    reason = None
    for name, most in LENGTHS.items():
        size = F.coalesce(F.char_length(name), F.lit(0))
        for wrong, why in ((size == 0, "is missing"), *([(size > most, "is too long")] if most else [])):
            reason = F.when(wrong, f"{name} {why}") if reason is None else reason.when(wrong, f"{name} {why}")
    return reason


def check_requests(rows: DataFrame) -> DataFrame:
    """rows with the column reject_reason: why a request is rejected, or null."""
    return rows.withColumn("reject_reason", request_reason())


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files without a byte below a folder: Spark's reader leaves them out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            out.append(f.getPath().getName())
    return out


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, checked; those without a byte come as empty ones."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    empty = spark.createDataFrame([(name, bytearray()) for name in _empty_files(spark, path)], "filename string, content binary")
    return check_uploads(rows.union(empty))


def check_uploads(rows: DataFrame) -> DataFrame:
    """rows: (filename, content).  (name, filename, source_code, reject_reason); rejected files have no source."""
    rows = rows.select(F.when(F.col("filename") == "", "submission.c").otherwise(F.col("filename")).alias("filename"), "content", upload_reject(F.col("filename"), F.col("content")).alias("reject_reason"))
    source = F.when(F.col("reject_reason").isNull(), F.decode("content", "UTF-8"))
    return rows.select(F.col("filename").alias("name"), "filename", source.alias("source_code"), "reject_reason")


def file_names(uploads: DataFrame, typed: str, batch: str = "batch") -> DataFrame:
    """Names of uploaded files: the typed one for a lone file of a batch, else each file's own."""
    n = uploads.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    return uploads.join(n, batch).withColumn("name", F.when((F.col("_n") == 1) & (F.col(typed) != ""), F.col(typed)).otherwise(F.col("filename"))).drop("_n")


def reject_reason(source: Column, n_functions: Column) -> Column:
    """Why a source is rejected, or null."""
    return F.when(source.isNull() | (strip(source) == ""), "empty source").when(F.coalesce(n_functions, F.lit(0)) == 0, "no functions")


def accepted(rows: DataFrame) -> DataFrame:
    """rows: (source_code, n_functions, ...)."""
    return rows.where(reject_reason(F.col("source_code"), F.col("n_functions")).isNull())


def rejected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", reject_reason(F.col("source_code"), F.col("n_functions"))).where("reject_reason IS NOT NULL")
