"""One acceptance run over a built dictionary: every gate of gates.py, with each table read once.

All figures that a row tells by itself (counts, shares, blank keys, wrong prefix keys) are observed while the table's keys
are written; the gates that join tables then read those narrow keys. The result is a row a gate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import fold, nonempty, normalize
from .gates import ATTRIBUTED, LEMMAS, SHARES, form_round_trip, has, round_trip
from .store import forget, stored

GATE = "gate string, value double, least double, most double, ok boolean"


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("double")


def _share(c: Column) -> Column:
    return F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(1.0))


def observed(rows: DataFrame, keep: list, *figures: Column) -> tuple[dict[str, float], DataFrame]:
    """The figures of rows, and `keep` columns of them as a written table: one scan."""
    seen = Observation(uuid.uuid4().hex)
    kept = stored(rows.observe(seen, *figures).select(*keep))
    return seen.get, kept


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def run(
    entries: DataFrame, morphology: DataFrame, prefixes: DataFrame, core: DataFrame, sources: DataFrame, frequent: DataFrame | None = None, *, lemmas: int = LEMMAS, picks: int = 100, seed: str = "seed", lookup: DataFrame | None = None,
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """GATE rows of entries (n, p, s, es, zh, d), analyses (surface, lemma), prefix rows (key, lemma), core (n), sources (source).

    lookup: rows (n) that an exact lookup finds, else the entries. frequent: keys (n) that have to be covered by `shares`.
    A gate with `least` fails below it, one with `most` above it; a table without rows fails no share.
    """
    content = has()
    e, keys = observed(entries, ["n", "s", *(c.alias(f"_{k}") for k, c in content.items())], F.count("*").cast("double").alias("lemmas"), _count(blank("n")).alias("blank lemmas"), _share(nonempty(F.col("s"))).alias("attributed"), *(_share(c).alias(f"share {k}") for k, c in content.items()))
    m, forms = observed(morphology, ["surface", "lemma"], F.count("*").cast("double").alias("analyses"), _count(blank("surface") | blank("lemma")).alias("blank analyses"))
    p, starts = observed(prefixes, ["key", "lemma"], F.count("*").cast("double").alias("prefix rows"), _count(blank("key") | blank("lemma")).alias("blank prefixes"), _count(fold(F.col("lemma")) != F.col("key")).alias("wrong prefix keys"))
    heads = keys.select(F.col("n").alias("_n"))
    lost = lambda d, c: d.join(heads, F.col(c) == F.col("_n"), "left_anti").count()
    one = keys.groupBy("n").agg(F.count("*").alias("count"), *(F.max(f"_{k}").alias(f"_{k}") for k in content))
    figures: list[tuple] = [("lemmas", e["lemmas"], lemmas, None), ("attributed", e["attributed"], ATTRIBUTED, None)]
    figures += [(k, e[k], None, 0) for k in ("blank lemmas",)] + [(k, m[k], None, 0) for k in ("blank analyses",)] + [(k, p[k], None, 0) for k in ("blank prefixes", "wrong prefix keys")]
    figures += [(f"share {k}", e[f"share {k}"], None, None) for k in content] + [("analyses", m["analyses"], None, None), ("prefix rows", p["prefix rows"], None, None)]
    figures.append(("repeated lemmas", one.where("count > 1").count(), None, 0))
    figures += [("dangling analyses", lost(forms, "lemma"), None, 0), ("dangling prefixes", lost(starts, "lemma"), None, 0), ("dangling core", lost(core, "n"), None, 0)]
    figures.append(("unknown sources", keys.select(F.explode("s").alias("source")).join(sources.select("source"), "source", "left_anti").count(), None, 0))
    inner = forms.join(core.select(F.col("n").alias("surface")), "surface", "left_semi")
    figures.append(("core analyses out of the core", inner.join(core.select(F.col("n").alias("_n")), F.col("lemma") == F.col("_n"), "left_anti").count(), None, 0))
    if frequent is not None:
        met = frequent.select(normalize(F.col("n")).alias("_w")).distinct().join(one, F.col("_w") == F.col("n"), "left")
        got = met.agg(_share(F.col("n").isNotNull()).alias("found"), *(_share(F.coalesce(F.col(f"_{k}"), F.lit(False))).alias(k) for k in content)).first()
        figures += [(f"frequent {k}", got[k], least, None) for k, least in {"found": 1.0, **(shares or SHARES)}.items()]
    whole = min(picks, int(e["lemmas"]))
    trip = round_trip(keys.select("n"), lookup if lookup is not None else keys, whole, seed).first()
    figures.append(("lemmas found again", trip["found"], whole, None))
    surfaces = forms.select("surface").distinct().count()
    trip = form_round_trip(forms, forms, min(picks, surfaces), seed).first()
    figures.append(("forms found again", trip["found"], min(picks, surfaces), None))
    forget(keys, forms, starts)
    rows = [(k, float(v), None if lo is None else float(lo), None if hi is None else float(hi), (lo is None or v >= lo) and (hi is None or v <= hi)) for k, v, lo, hi in figures]
    return entries.sparkSession.createDataFrame(rows, GATE)


def failed(gates: DataFrame) -> DataFrame:
    return gates.where("not ok")
