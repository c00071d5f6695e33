"""Tables that cut a job's lineage, in the folder that all of a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode a temporary one where that is unset, else an error.

    Executors on other machines could not read a temporary folder of the driver's.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quern.scratch", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = tempfile.mkdtemp(prefix="spark-quern-")
        spark.conf.set("quern.scratch", top)
    return f"{top.rstrip('/')}/quern-{uuid.uuid4().hex}"


def staged(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    ``narrow``: in four partitions a core at most, for tables much smaller than the input.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.quern_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
