"""The streaming twin of keyed upsert: a log of runs, each the last row of every key in some consecutive batches.

A batch writes one run of its own keys and nothing else. Runs that have grown to like sizes are then merged, so that a row is rewritten
about as often as the table doubles, and the runs that a reader merges are few (about log2 of the table). A run counts
once Spark's commit mark is in it; of runs that cover the same batches the widest counts, so a merge that broke off, or a
batch that is replayed, changes nothing that is read. Late rows lose by `order`, in a batch, in a merge and in a reading.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest

#: A run is merged with the one before it when that one has at most so many times its bytes.
LIKE = 2


class Run(NamedTuple):
    """Batches first to last in one folder."""

    first: int
    last: int
    path: str
    size: int


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def runs(spark: SparkSession, target: str) -> list[Run]:
    """Committed runs that no wider one covers, in order."""
    root, fs = _fs(spark, target)
    found = []
    for f in (fs.listStatus(root) if fs.exists(root) else []) or []:
        name = re.fullmatch(r"run-(\d+)-(\d+)", f.getPath().getName())
        if name and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found.append(Run(int(name[1]), int(name[2]), f.getPath().toString(), fs.getContentSummary(f.getPath()).getLength()))
    return sorted(r for r in found if not any(w.first <= r.first and r.last <= w.last and w[:2] != r[:2] for w in found))


def upsert_stream(spark: SparkSession, events: DataFrame, key: str, order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Folds what is there into target, batch by batch; state() reads the result. `order` decides between rows of a key; rows that are
    equal in it may go either way."""

    def fold(batch: DataFrame, n: int) -> None:
        if not any(r.first <= n <= r.last and r.last > r.first for r in runs(spark, target)):  # else it is merged already
            latest(batch, key, *order).write.mode("overwrite").parquet(f"{target}/run-{n}-{n}")
        compact(spark, target, batch.schema, key, order)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, target: str, schema, key: str, order: list[str]) -> None:
    """Merges the newest runs while they are of like sizes, and removes what is covered."""
    now = runs(spark, target)
    while len(now) > 1 and now[-2].size <= LIKE * now[-1].size:
        a, b = now[-2:]
        latest(spark.read.schema(schema).parquet(a.path, b.path), key, *order).write.mode("overwrite").parquet(f"{target}/run-{a.first}-{b.last}")
        now = runs(spark, target)
        for old in (a, b):
            p, fs = _fs(spark, old.path)
            fs.delete(p, True)


def state(spark: SparkSession, target: str, schema, key: str, order: list[str]) -> DataFrame:
    """The last row of every key."""
    paths = [r.path for r in runs(spark, target)]
    return latest(spark.read.schema(schema).parquet(*paths), key, *order) if paths else spark.createDataFrame([], schema)
