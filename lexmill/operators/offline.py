"""What is there without the full data: core tables, candidates of a result, fallbacks, and whether the answer may be short.

Tables are those of lookup.py and search.py; core is a table (n). Nothing here asks where a table is stored: a caller that
has only the core's passes that, and `short_of` tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty


def core_only(rows: DataFrame, core: DataFrame, lemma: str = "lemma") -> DataFrame:
    """Rows whose lemma is in the core: postings of keys that then have none go, and so do surfaces without an analysis."""
    return rows.join(core.select(F.col("n").alias("_core")).distinct(), F.col(lemma) == F.col("_core"), "left_semi")


def probe(queries: DataFrame, core: DataFrame) -> DataFrame:
    """q and the entry of the core (its columns) with that key, null where there is none."""
    q = queries.select("q").distinct()
    return q.join(core, F.col("q") == F.col("n"), "left")


def enriched(entries: DataFrame, core: DataFrame, *fields: str) -> DataFrame:
    """entries with empty `fields` filled from the core's entry, where there is one."""
    c = core.select(F.col("n").alias("_n"), *(F.col(f).alias(f"_{f}") for f in fields)).dropDuplicates(["_n"])
    met = entries.join(c, F.col("n") == F.col("_n"), "left")
    return met.select(*(F.coalesce(F.when(nonempty(F.col(x)), F.col(x)), F.col(f"_{x}"), F.col(x)).alias(x) if x in fields else F.col(x) for x in entries.columns))


def selected_candidate(results: DataFrame, choices: DataFrame) -> DataFrame:
    """results (q, pos, n, ...) with `selected`: of each query the candidate that choices (q, n) names, if it is one of the query's own,
    else the first; of equal pos the one of the least n."""
    c = choices.select(F.col("q").alias("_q"), F.col("n").alias("_n")).distinct()
    met = results.join(c, (F.col("q") == F.col("_q")) & (F.col("n") == F.col("_n")), "left")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("_n").isNull(), "pos", "n"))
    return met.withColumn("selected", best == 1).select(*results.columns, "selected")


def alternatives(results: DataFrame) -> DataFrame:
    """The candidates of selected_candidate() that are other entries than the selected one, in their order, equal pos by n."""
    chosen = results.where("selected").select(F.col("q").alias("_q"), F.col("n").alias("_n"))
    rest = results.join(chosen, (F.col("q") == F.col("_q")) & (F.col("n") == F.col("_n")), "left_anti")
    return rest.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("pos", "n"))).drop("selected")


def shown_gloss(d_ca: Column, d_en: Column, machine: Column, zh: Column, es: Column) -> Column:
    """English glosses, where there is no Catalan definition and the meaning is a machine's or there is none in Chinese or Spanish."""
    bare = ~nonempty(zh) & ~nonempty(es)
    return F.when(~nonempty(d_ca) & (F.coalesce(machine, F.lit(False)) | bare), d_en)


def short_of(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """limited, missing: whether pieces (path, sha256) that a manifest names are not installed as it names them, and how many."""
    left = wanted.select("path", "sha256").distinct().join(installed.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")
    return left.agg((F.count("*") > 0).alias("limited"), F.count("*").alias("missing"))


def unbound_aliases(aliases: DataFrame, values: DataFrame) -> DataFrame:
    """aliases (lemma, term, layer, field, text) whose text is not a value (n, layer, field, value) of the layer and field they name."""
    v = values.select(F.col("n").alias("lemma"), "layer", "field", F.col("value").alias("text")).distinct()
    return aliases.join(v, ["lemma", "layer", "field", "text"], "left_anti")


def value_key(value: Column) -> Column:
    """Text that is equal for equal values of any type: fields of structs in their order."""
    return F.to_json(F.struct(value.alias("v")))


def millis(time: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, and `from_millis` back."""
    return F.unix_millis(time)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)
