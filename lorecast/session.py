"""Session helpers: table access, and the shared folder where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a session within one machine (``local[...]``) may leave it unset; then a folder is made there. On a cluster a folder
    of one machine would scatter the files over the executors' disks, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as compressed Parquet in the shared folder and read back.

    The files survive a lost executor, and what reads them runs nothing of ``df`` again. They stay until ``release_shared``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shared(spark: SparkSession) -> int:
    """Deletes what ``write_shared`` wrote in this session, once the results that read it are written or collected."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
