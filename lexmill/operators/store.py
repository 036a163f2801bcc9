"""Intermediate tables: results that several later steps read are written once and read again, which cuts their lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's name in the folder that spark.checkpoint.dir names; in one of this machine only in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or 'file:///tmp/checkpoints'}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a written table, read again; `forget` deletes it. Joins with it are by shuffles unless the caller asks for a broadcast:
    Spark takes the size of compressed files for the size of the rows, and would gather relations of 40 times that on the driver."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
