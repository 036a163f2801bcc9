"""Sources and sinks: JSON lines, JSON arrays, tables of tab-separated values, XML, immutable versioned output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """# begins a comment; a row with another number of fields fails."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def route_forms(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records all of whose senses are forms of another word, the others)."""
    form = (F.size("senses") > 0) & F.forall("senses", lambda s: (F.size(s["form_of"]) > 0) | F.array_contains(s["tags"], "form-of"))
    form = F.coalesce(form, F.lit(False))
    return records.where(form), records.where(~form)


def section(text, level: str = "==", title: str = ""):
    """What stands between a heading and the next one of its level."""
    return F.regexp_extract(text, rf"(?s){level}\s*{title}\s*{level}\n(.*?)(?=\n{level}[^=]|$)", 1)


def strip_markup(text):
    """References, tags, link targets, and templates however deep inside each other, removed."""
    t = F.regexp_replace(text, r"(?s)<ref[^>]*>.*?</ref>|<[^>]+>", "")
    # a template inside h others stands behind h open braces or more, and has two: h + 1 passes change all there is
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(acc, c):
        at = F.greatest(F.lit(0), acc["at"] + F.when(c == "{", 1).otherwise(-1))
        return F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"))

    deep = F.aggregate(F.regexp_extract_all(t, F.lit("[{}]"), F.lit(0)), start, step, lambda acc: acc["most"] - 1)
    t = F.when(deep > 0, F.aggregate(F.sequence(F.lit(1), deep), t, lambda acc, _: F.regexp_replace(acc, r"\{\{[^{}]*\}\}", ""))).otherwise(t)
    t = F.regexp_replace(t, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "'{2,}", ""), r"(?U)\s+", " "))


def write_version(df: DataFrame, root: str, version: str, key: str, rows: int = 5000) -> str:
    """An immutable output, ranges of keys in order; an existing version fails."""
    path = f"{root}/{version}"
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(path)
    return path
