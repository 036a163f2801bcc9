"""Entries: accumulation of facts by lemma and layer, packing, merging by layer priority.

An entry row has the columns of ENTRY; missing lists are null. `layer` and `priority` (least wins) tell where it is from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING_RANK, clean_text, nonempty, normalize, or_empty, valid_term
from .lexicon import global_rank

ENTRY = (
    "n string, l string, p array<string>, g string, pl array<string>, zh array<string>, es array<string>, d struct<ca:array<string>,en:array<string>,es:array<string>,zh:array<string>>,"
    " ex array<struct<ca:string,es:string,zh:string>>, f array<string>, ipa string, s array<string>, pv array<struct<sourceId:string,sourceEntryId:string,fields:array<string>>>,"
    " r long, zhMachine boolean, zhReference boolean, zhHeadword boolean"
)
LISTS = ("p", "pl", "zh", "es", "f", "s")
LANGUAGES = ("ca", "en", "es", "zh")
STRUCTS = {"ex": "array<struct<ca:string,es:string,zh:string>>", "pv": "array<struct<sourceId:string,sourceEntryId:string,fields:array<string>>>"}
FLAGS = ("zhMachine", "zhReference", "zhHeadword")
#: Word classes; most items of a packed list; the size of the core.
POS = ("adjective", "adverb", "article", "conjunction", "contraction", "determiner", "expression", "interjection", "noun", "numeral", "particle", "preposition", "pronoun", "proper-name", "verb")
MOST = {"zh": 12, "es": 12, "pl": 24, "f": 24, "ex": 4, "d": 8}
CORE = 5000
#: Layers from the strongest on.
PRIORITY = {"seed": 0, "curated": 1, "lex": 2, "freedict": 3, "wiktionary": 4}


def has_chinese(zh: Column, d_zh: Column) -> Column:
    return F.exists(F.concat(or_empty(zh), or_empty(d_zh)), lambda t: t.rlike(r"\p{IsHan}"))


def is_verb(p: Column) -> Column:
    return F.coalesce(F.array_contains(p, "verb"), F.lit(False))


def gender(genders: Column) -> Column:
    """One gender of a set: common if it is in there, or both others are."""
    has = lambda g: F.coalesce(F.array_contains(genders, g), F.lit(False))
    return F.when(has("common") | (has("masculine") & has("feminine")), "common").when(has("masculine"), "masculine").when(has("feminine"), "feminine")


def headwords(facts: DataFrame) -> DataFrame:
    """n, l, sources, p of facts (lemma, source, pos, priority, ordinal): one row a key, spelled as the fact of least priority
    (then ordinal) spells it. Facts with an invalid lemma or an unknown class are left out."""
    lemma = clean_text(F.col("lemma"), 120)
    f = facts.select("source", "pos", "priority", "ordinal", lemma.alias("l")).withColumn("n", normalize(F.col("l"), "build"))
    f = f.where(valid_term(F.col("n")) & (F.col("pos").isNull() | F.col("pos").isin(*POS)))
    return f.groupBy("n").agg(F.min_by("l", F.struct("priority", "ordinal")).alias("l"), F.array_sort(F.collect_set("source")).alias("s"), F.array_sort(F.collect_set("pos")).alias("p"))


def accumulate(facts: DataFrame, ordered: Sequence[str] = ("d_ca", "d_en", "ipa", "ex"), caps: dict[str, int] | None = None) -> DataFrame:
    """n, layer, field, items of facts (n, layer, field, value, ordinal): distinct values, those of `ordered` fields in order of
    their first ordinal and with a cap, the others sorted. Values are counted once before any list is made."""
    caps = caps or {"d_ca": MOST["d"], "d_en": MOST["d"], "ipa": 3, "ex": MOST["ex"]}
    first = facts.where(F.col("value") != "").groupBy("n", "layer", "field", "value").agg(F.min("ordinal").alias("at"))
    rows = first.groupBy("n", "layer", "field").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("field").isin(*ordered), F.col("at")).otherwise(0).alias("at"), "value"))).alias("x"))
    items = F.transform("x", lambda x: x["value"])
    most = F.create_map(*(F.lit(v) for pair in caps.items() for v in pair))[F.col("field")]
    return rows.select("n", "layer", "field", F.when(most.isNotNull(), F.slice(items, F.lit(1), F.coalesce(most, F.lit(1)))).otherwise(items).alias("items"))


def pack_layer(accumulated: DataFrame, names: DataFrame) -> DataFrame:
    """ENTRY rows with layer of accumulate() rows and names (n, l, r); lists have their caps."""
    fields = ("p", "g", "pl", "zh", "es", "d_ca", "d_en", "ex", "f", "ipa", "s")
    wide = accumulated.groupBy("n", "layer").agg(*(F.max(F.when(F.col("field") == k, F.col("items"))).alias(f"_{k}") for k in fields)).join(names, "n")
    cut = lambda k: F.slice(f"_{k}", 1, MOST[k])
    d = F.struct(F.col("_d_ca").alias("ca"), F.col("_d_en").alias("en"), F.lit(None).cast("array<string>").alias("es"), F.lit(None).cast("array<string>").alias("zh"))
    return wide.select(
        "n", "l", "layer", F.col("_p").alias("p"), gender(F.col("_g")).alias("g"), cut("pl").alias("pl"), cut("zh").alias("zh"), cut("es").alias("es"),
        F.when(F.col("_d_ca").isNotNull() | F.col("_d_en").isNotNull(), d).alias("d"), F.transform("_ex", lambda x: F.from_json(x, "ca string, es string, zh string")).alias("ex"), cut("f").alias("f"),
        F.array_join("_ipa", " · ").alias("ipa"), F.col("_s").alias("s"), F.col("r").cast("long").alias("r"),
    )


def by_words(items: Column) -> Column:
    """Fewest words first, then shortest, then by value."""
    key = lambda x: F.struct(F.size(F.split(x, " ")).alias("a"), F.length(x).alias("b"), x.alias("c"))
    return F.transform(F.array_sort(F.transform(items, key)), lambda k: k["c"])


def pack(entries: DataFrame) -> DataFrame:
    """entries (lists as sets) with sorted and capped lists; Spanish by words; plurals and forms without the key; empty lists null."""
    own = lambda k: F.filter(F.array_sort(k), lambda v: v != F.col("n"))
    some = lambda c: F.when(F.size(c) > 0, c)
    out = {"p": F.array_sort("p"), "s": F.array_sort("s"), "zh": F.slice(F.array_sort("zh"), 1, MOST["zh"]), "es": F.slice(by_words(F.col("es")), 1, MOST["es"])}
    out |= {k: F.slice(own(k), 1, MOST[k]) for k in ("pl", "f")} | {"ex": F.slice("ex", 1, MOST["ex"])}
    return entries.withColumns({k: some(c) for k, c in out.items() if k in entries.columns})


def unpack(entries: DataFrame) -> DataFrame:
    """Long names; a verb has no plural."""
    names = {
        "l": "lemma", "n": "normalizedLemma", "p": "partOfSpeech", "g": "gender", "pl": "plural", "zh": "chinese", "es": "spanish", "d": "definitions", "ex": "examples", "f": "forms",
        "ipa": "pronunciation", "s": "source", "pv": "provenance", "r": "frequencyRank", "zhMachine": "chineseMachine", "zhReference": "chineseReference", "zhHeadword": "chineseHeadword",
    }
    return entries.select(*((F.when(~is_verb(F.col("p")), F.col("pl")) if c == "pl" else F.col(c)).alias(names.get(c, c)) for c in entries.columns))


def merge(layers: DataFrame, build: bool = False) -> DataFrame:
    """One ENTRY row a key of rows ENTRY with `priority`: lists are united in order of priority, first occurrences only;
    the first spelling, gender and pronunciation that is there; the least rank (null if none has one). The flags of
    Chinese come from the first layer that has Chinese (with `build`: from any layer).

    Every value is counted once by key, field and value before lists are made, so a key with very many rows costs no
    more than its distinct values.
    """
    text = lambda field, c: F.transform(or_empty(c), lambda v, i: F.struct(F.lit(field).alias("field"), i.alias("ord"), v.alias("value")))
    parts = [text(k, F.col(k)) for k in LISTS] + [text(f"d.{k}", F.col(f"d.{k}")) for k in LANGUAGES]
    for k in STRUCTS:
        json = F.coalesce(F.transform(k, lambda v: F.to_json(v)), F.expr("cast(array() as array<string>)"))
        parts.append(text(k, json))
    stacked = layers.select("n", "priority", F.inline(F.concat(*parts)))
    values = stacked.groupBy("n", "field", "value").agg(F.min(F.struct("priority", "ord")).alias("at"))
    items = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == k, F.struct("at", "value")))), lambda x: x["value"])
    wide = values.groupBy("n").agg(*(items(k).alias(f"_{k}") for k in (*LISTS, *(f"d.{x}" for x in LANGUAGES), *STRUCTS)))
    chinese = has_chinese(F.col("zh"), F.col("d.zh")) if build else nonempty(F.col("zh")) | nonempty(F.col("d.zh"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("priority"))).alias(c)
    flag = lambda c: F.max(c).alias(c) if build else F.coalesce(F.min_by(F.struct(c), F.when(chinese, F.col("priority"))), F.max_by(F.struct(c), "priority"))[c].alias(c)
    scalars = layers.groupBy("n").agg(first("l"), first("g"), first("ipa"), F.min("r").alias("r"), *(flag(c) for c in FLAGS))
    some = lambda c: F.when(F.size(c) > 0, c)
    caps = {"ex": MOST["ex"], "f": MOST["f"]}
    d = F.struct(*(some(F.col(f"`_d.{k}`")).alias(k) for k in LANGUAGES))
    out = {k: some(F.slice(f"_{k}", 1, caps[k]) if k in caps else F.col(f"_{k}")) for k in LISTS}
    parsed = lambda c, t: F.from_json(F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")), t)
    out |= {k: some(parsed(F.slice(f"_{k}", 1, caps.get(k, 1 << 30)), t)) for k, t in STRUCTS.items()}
    out["d"] = F.when(sum((F.size(f"`_d.{k}`") for k in LANGUAGES), F.lit(0)) > 0, d)
    joined = scalars.join(wide, "n", "left")
    order = [c.split()[0] for c in ("n", "l", "p", "g", "pl", "zh", "es", "d", "ex", "f", "ipa", "s", "pv", "r", *FLAGS)]
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in order))


def least_rank(*ranks: Column) -> Column:
    """The least of ranks, a missing one counting as the largest whole number of a double."""
    return F.least(*(F.coalesce(r, F.lit(MISSING_RANK)) for r in ranks))


def fill_chinese(entries: DataFrame, overlays: DataFrame) -> DataFrame:
    """entries with Chinese, its flags, sources and provenance of overlays (ENTRY rows) where they have none themselves."""
    o = overlays.select(F.col("n").alias("_n"), *(F.col(c).alias(f"_{c}") for c in ("zh", "s", "pv", *FLAGS)))
    take = F.col("_n").isNotNull() & ~has_chinese(F.col("zh"), F.col("d.zh"))
    both = lambda c: F.when(take, F.array_distinct(F.concat(F.coalesce(c, F.slice(f"_{c}", 1, 0)), F.coalesce(f"_{c}", F.slice(c, 1, 0))))).otherwise(F.col(c))
    out = {"zh": F.when(take, F.col("_zh")).otherwise(F.col("zh")), "s": both("s"), "pv": both("pv")} | {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in FLAGS}
    return entries.join(o, F.col("n") == F.col("_n"), "left").withColumns(out).select(entries.columns)


def clean_morphology(rows: DataFrame, lexicon: DataFrame, cap: int = 16) -> DataFrame:
    """surface, lemma, label, pos, ord of distinct analyses whose lemma the lexicon (n, freq) has and whose blanks and hyphens
    are as many as the surface's; at most `cap` a surface, the most frequent lemmas first."""
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    same = (count("lemma", " ") == count("surface", " ")) & (count("lemma", "-") == count("surface", "-"))
    met = rows.where((F.col("surface") != F.col("lemma")) & same).select("surface", "lemma", "label", "pos").distinct().join(lexicon.select(F.col("n").alias("lemma"), "freq"), "lemma")
    order = Window.partitionBy("surface").orderBy(F.col("freq").desc(), "lemma", "label", "pos")
    return met.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= cap).select("surface", "lemma", "label", "pos", "ord")


def attribute_frequency(counts: DataFrame, lexicon: DataFrame, morphology: DataFrame) -> DataFrame:
    """n, freq: counts (token, n) summed by lemma: a token that is a headword counts for itself, else for the lemma of its
    analyses if they lead to one headword only, else for none."""
    heads = lexicon.select(F.col("n").alias("head"))
    c = counts.select("token", F.col("n").alias("count")).join(heads, F.col("token") == F.col("head"), "left")
    own = c.where("head is not null").select(F.col("head").alias("n"), "count")
    one = morphology.join(heads, F.col("lemma") == F.col("head"), "left_semi").groupBy("surface").agg(F.min("lemma").alias("n"), F.max("lemma").alias("last")).where("n = last")
    other = c.where("head is null").select("token", "count").join(one, F.col("token") == F.col("surface")).select("n", "count")
    return own.unionByName(other).groupBy("n").agg(F.sum("count").alias("freq"))


def quality_rank(lexicon: DataFrame, freq: str = "freq", quality: str = "quality", name: str = "rank") -> DataFrame:
    """lexicon with `rank` from 1: frequency, then quality, then length, then key."""
    return global_rank(lexicon, {"freq": F.col(freq), "quality": F.col(quality)}, "n", name)
