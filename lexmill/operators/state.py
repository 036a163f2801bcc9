"""Keyed state: last write wins, compare and swap, resume, ordered gates, shard descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by a partial aggregation."""
    cols = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def compare_and_swap(stored: DataFrame, changes: DataFrame, key: str, versions: list[str], value: str) -> DataFrame:
    """stored with `value` of changes where all versions are unchanged (null equals null); `swapped` tells."""
    c = changes.select(F.col(key).alias("_k"), *(F.col(v).alias(f"_{v}") for v in versions), F.col(value).alias("_new"))
    met = F.col(key) == F.col("_k")
    for v in versions:
        met &= F.col(v).eqNullSafe(F.col(f"_{v}"))
    out = stored.join(c, met, "left")
    return out.select(*(F.when(F.col("_k").isNotNull(), F.col("_new")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in stored.columns), F.col("_k").isNotNull().alias("swapped"))


def pending(jobs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def descriptors(rows: DataFrame, shard: str, key: str) -> DataFrame:
    """First and last key and the number of rows of each shard."""
    return rows.groupBy(shard).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("entries"))


def overlapping(shards: DataFrame, order: str) -> DataFrame:
    """Shards that begin at or before the end of the one before them; the table of descriptors is small."""
    return shards.withColumn("before", F.lag("last").over(Window.orderBy(order))).where(F.col("before") >= F.col("first"))


def upserted(stored: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """stored with the last of changes for each key in its place; put of a cache, a snapshot or a metadata value."""
    new = latest(changes, key, *order)
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def removed(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def cleared(stored: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return stored.limit(0)


def value_of(stored: DataFrame, key: str, wanted: str) -> DataFrame:
    return stored.where(F.col(key) == wanted)


def only_version(stored: DataFrame, version: str, active: str) -> DataFrame:
    """Rows of the active version; the rest is evicted."""
    return stored.where(F.col(version) == active)


def by_version(stored: DataFrame, version: str) -> DataFrame:
    return stored.groupBy(version).agg(F.count("*").alias("n"))


def progress(required: DataFrame, stored: DataFrame, key: str, size: str) -> DataFrame:
    """files, bytes, done_files, done_bytes, complete: of the required keys, what is stored; complete only if every key is."""
    s = stored.select(F.col(key).alias("_k")).distinct()
    met = required.join(s, F.col(key) == F.col("_k"), "left")
    has = F.col("_k").isNotNull()
    out = met.agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"), F.count("_k").alias("done_files"), F.coalesce(F.sum(F.when(has, F.col(size))), F.lit(0)).cast("long").alias("done_bytes"))
    return out.withColumn("complete", F.col("files") == F.col("done_files"))


def cached(queries: DataFrame, cache: DataFrame, key: str, version: str, wanted: str | None) -> DataFrame:
    """Cache rows of the asked keys, of the wanted version if one is named."""
    hits = cache.join(queries.select(key).distinct(), key, "left_semi")
    return hits if wanted is None else hits.where(F.col(version) == wanted)


def refreshed(saved: DataFrame, entries: DataFrame, key: str, versions: dict[str, str], meaning: str) -> DataFrame:
    """saved rows with the meaning of entries and the new versions where their versions are old; a row that would lose a meaning it
    has, or has no entry, stays as it is. `fresh` tells which ones were refreshed."""
    old = F.lit(False)
    for c, v in versions.items():
        old |= ~F.col(c).eqNullSafe(F.lit(v))
    e = entries.select(F.col(key).alias("_k"), F.col(meaning).alias("_m"))
    met = saved.join(e, F.col(key) == F.col("_k"), "left")
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    fresh = old & F.col("_k").isNotNull() & ~(some(meaning) & ~some("_m"))
    new = {meaning: F.col("_m")} | {c: F.lit(v) for c, v in versions.items()}
    met = met.withColumn("fresh", fresh)
    return met.select(*(F.when(F.col("fresh"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in saved.columns), "fresh")


def newest_answer(answers: DataFrame, by: str, seq: str) -> DataFrame:
    """The answer to the last request of each caller: earlier ones that come late are left out."""
    return latest(answers, by, seq)
