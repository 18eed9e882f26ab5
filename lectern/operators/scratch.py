"""Tables in the cluster's shared folder that cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``); where that is unset below a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the shared folder and must be set on a cluster")
        found = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/lectern-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; ``scratch`` is its path."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing will read again, and lets Spark drop shuffles nobody refers to."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(conf).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
