"""Lexicon operators: counts, ranks, keyed upsert, layers, overlays, attribution. All are DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LETTERS
from .ranges import numbered


#: Bytes of a scan under which its rows are dealt anew to all cores.
SMALL_SCAN = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan is so small that it would use fewer; by the optimizer's estimate, no job is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_SCAN else df


def tokens(docs: DataFrame, text: str = "text", pattern: str = LETTERS, *keep: str) -> DataFrame:
    """One row for each lower-case token, with the columns to keep."""
    docs = spread(docs.select(*dict.fromkeys([*keep, text])))
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("token"))


def token_frequency(docs: DataFrame) -> DataFrame:
    return tokens(docs).groupBy("token").agg(F.count("*").alias("n"))


def global_rank(rows: DataFrame, descending: dict[str, Column], key: str, name: str = "rank") -> DataFrame:
    """rows with a number from 1 by the `descending` columns, then length of the key, then the key. No task sorts all rows: they are
    numbered range by range."""
    return numbered(rows, name, *(c.desc() for c in descending.values()), F.length(key), F.col(key))


def ranked(counts: DataFrame, key: str = "token", n: str = "n", k: int | None = None) -> DataFrame:
    """Rank by count, length, key. With k, a top-k without a global sort; without, global_rank()."""
    if k is not None:
        order = [F.col(n).desc(), F.length(key), F.col(key)]
        return counts.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return global_rank(counts.select(key, n), {"n": F.col(n)}, key)


def upsert(rows: DataFrame, key: str, value: Column, *order: Column) -> DataFrame:
    """One row a key: the value of the least order, first wins."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("value"), F.count("*").alias("n"))


def merge_layers(rows: DataFrame, key: str, value: str, priority: str, ordinal: str, cap: int | None = None) -> DataFrame:
    """Values of a key in layer order, first occurrences only, and how many layers have it."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(priority, ordinal)).alias("at"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value])
    merged = first.groupBy(key).agg((items if cap is None else F.slice(items, 1, cap)).alias("items"))
    return merged.join(rows.groupBy(key).agg(F.countDistinct(priority).alias("layers")), key)


def overlay(base: DataFrame, over: DataFrame, key: str, value: str, new: str) -> DataFrame:
    """base with `value` filled from `new` only where it is missing: an existing value always wins."""
    o = over.select(F.col(key).alias("over_key"), F.col(new).alias("over_value"))
    return base.join(o, F.col(key) == F.col("over_key"), "left").withColumn(value, F.coalesce(value, "over_value")).drop("over_key", "over_value")


def unique_attribution(pairs: DataFrame, surface: str, lemma: str) -> DataFrame:
    """Surfaces with exactly one lemma."""
    return pairs.groupBy(surface).agg(F.min(lemma).alias(lemma), F.max(lemma).alias("other")).where(F.col(lemma) == F.col("other")).drop("other")


def capped(rows: DataFrame, key: str, cap: int, *order: Column) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= cap)


def missing(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key has no match: a gate wants none."""
    return rows.join(other.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def expand_paradigms(stems: DataFrame, variants: DataFrame) -> DataFrame:
    """Surfaces of stems (lemma, stem, paradigm) under variants (paradigm, suffix, label)."""
    return stems.join(variants, "paradigm").select("lemma", F.concat("stem", "suffix").alias("surface"), "label")


def state_lines(rows: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """Each line with the last heading at or before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(heading, ignorenulls=True).over(w))


def present(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key has a match."""
    return rows.join(other.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def both(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that are in both."""
    return rows.intersect(other)


def precedence(rows: DataFrame, overlays: list[DataFrame], key: str, name: str) -> DataFrame:
    """rows with the value of the first of `overlays` (key, value) that has their key, null without one; one pass for any number."""
    stacked = None
    for i, o in enumerate(overlays):
        part = o.select(key, F.lit(i).alias("_i"), F.col("value").alias("_v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    first = stacked.groupBy(key).agg(F.min_by("_v", "_i").alias(name))
    return rows.join(first, key, "left")


def presence(rows: DataFrame, by: str, total: str, **checks: Column) -> DataFrame:
    """Rows of each group, and of these how many pass each check."""
    return rows.groupBy(by).agg(F.count("*").alias(total), *(F.count(F.when(c, 1)).alias(k) for k, c in checks.items()))
