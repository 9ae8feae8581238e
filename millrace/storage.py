"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none, a temporary folder is made, which serves only a session whose driver and executors are one machine:
    on any other master this raises.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise RuntimeError(f"{KEY} is unset, and on {master} intermediate tables need a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application alone writes to."""
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


#: Folders of the tables written, in order.
_made: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back, so its lineage ends there."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a table; the tables that it wrote on the way are deleted."""
    begin = len(_made)
    out = materialise(make(), name)
    for path in _made[begin:-1]:
        delete(out.sparkSession, path)
    _made[begin:-1] = []
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete every table that this application has materialised: for callers who have read all their results."""
    delete(spark, own_dir(spark))
