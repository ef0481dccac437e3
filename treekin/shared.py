"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a
temporary folder of this machine is made and used.  A table written here survives the loss of executors and cuts the
lineage of what follows.  Results may read such tables lazily, so a caller that is done with its results calls ``drop_all``.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one of this machine where a local session has none.  On a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="treekin-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: One folder for each Python process, so that drop_all leaves other programs' tables alone.
_RUN = uuid.uuid4().hex


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/treekin/{_RUN}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more; a missing one is no error."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables and token files that this process has put into the shared folder, those that results still read included."""
    _delete(spark, f"{shared_dir(spark)}/treekin/{_RUN}")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for as long as the block runs; then it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores at least: a small file is one task, however much there is to do for each row.
    Larger inputs have more partitions than that, and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows and 16 MB at most, unless the session has smaller ones: texts are long, and both the executor
    and its Python worker hold a batch and what is made of it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) > 16 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def _bytes(size: str) -> int:
    number, unit = size.rstrip("bB"), 1
    if number and number[-1].lower() in "kmgt":
        number, unit = number[:-1], 1024 ** (" kmgt".index(number[-1].lower()))
    return int(number) * unit if int(number) > 0 else 1 << 62
