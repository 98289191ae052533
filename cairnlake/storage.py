"""Tables in the folder that driver and executors share: they cut lineage and outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark setting: shuffle files go as soon as the job that wrote them has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="cairnlake-")
        shared_dir.own = folder
    return folder.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write and read again: lineage ends at the files, and the shuffles that led there are dropped."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
