"""Lexical sources: TEI, JSON and JSON-lines dictionaries, wiki dumps, morphological and bilingual XML, word nets.

Each reader gives facts: (lemma, source, layer, pos, priority, ordinal) with (field, value) for entries.accumulate(), and
morphology rows (surface, lemma, label, pos, layer). `ordinal` is the place in the file, never a partition's.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.labels import APERTIUM_POS, FREEDICT_POS, KAIKKI_POS, NO_FORMS, PARADIGM, conjugation_label, heading_pos, kaikki_label, lookup, tag_label, tag_pos
from ..functions.text import clean_text, fold, normalize, or_empty, valid_term
from ..operators.entries import POS
from ..operators.store import stored
from .elements import elements, in_order

#: Priorities of the spelling of a headword, by source.
SPELLING = {"curated": 0, "wiki": 0, "freedict": 1, "kaikki": 2, "apertium": 3}


def _facts(rows: DataFrame, source: str, layer: str, fields: dict[str, Column]) -> DataFrame:
    """One row for each value of each list of `fields`; rows have lemma, pos, ordinal."""
    named = lambda k, v: F.transform(or_empty(v), lambda x, i: F.struct(F.lit(k).alias("field"), i.alias("i"), x.alias("value")))
    some = [named(k, v) for k, v in fields.items()]
    out = rows.select("lemma", F.lit(source).alias("source"), F.lit(layer).alias("layer"), "pos", F.lit(SPELLING[source]).alias("priority"), "ordinal", F.inline(F.concat(*some)))
    return out.where(F.col("value").isNotNull() & (F.col("value") != "")).select("lemma", "source", "layer", "pos", "priority", (F.col("ordinal") * 4096 + F.col("i")).alias("ordinal"), "field", "value")


def tei(spark: SparkSession, path: str) -> DataFrame:
    """Facts of TEI entries: every spelling gets the class, genders, definitions, translations and pronunciations of its entry;
    entries of an unknown class are left out."""
    ortho = "struct<orth:array<string>,pron:array<string>>"
    text = "struct<_VALUE:string,_type:string>"
    schema = (
        f"form array<{ortho}>, gramGrp struct<pos:string,gen:array<string>>, sense array<struct<def:array<string>,usg:array<{text}>,cit:array<struct<_type:string,quote:array<string>>>,"
        "gramGrp:struct<gen:array<string>>>>"
    )
    e = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    e = in_order(e)
    clean = lambda c, most=500: F.transform(or_empty(c), lambda v: _clean(v, most))
    flat = lambda f: F.flatten(F.transform("sense", f))
    pos = lookup(FREEDICT_POS, F.lower(_clean(F.col("gramGrp.pos"), 500)))
    genders = F.concat(or_empty(F.col("gramGrp.gen")), F.coalesce(flat(lambda s: or_empty(s["gramGrp"]["gen"])), F.array().cast("array<string>")))
    named = F.transform(genders, lambda g: F.when(F.lower(F.trim(g)).isin("f", "fem", "feminine"), "feminine").when(F.lower(F.trim(g)).isin("m", "masc", "masculine"), "masculine"))
    quotes = flat(lambda s: F.flatten(F.transform(F.filter(F.coalesce(s["cit"], F.array().cast("array<struct<_type:string,quote:array<string>>>")), lambda c: c["_type"] == "trans"), lambda c: or_empty(c["quote"]))))
    rows = e.select("ordinal", pos.alias("pos"), F.explode(F.flatten(F.transform("form", lambda f: or_empty(f["orth"])))).alias("lemma"), named.alias("g"), clean(flat(lambda s: or_empty(s["def"]))).alias("d_ca"), F.filter(clean(quotes), lambda v: valid_term(v)).alias("es"), clean(F.flatten(F.transform("form", lambda f: or_empty(f["pron"]))), 120).alias("ipa"))
    return _facts(rows.where("pos is not null"), "freedict", "freedict", {"p": F.array("pos"), "s": F.array(F.lit("freedict")), "g": F.col("g"), "d_ca": F.col("d_ca"), "es": F.col("es"), "ipa": F.col("ipa")})


def _clean(text: Column, most: int) -> Column:
    return clean_text(text, most, composed=True)


def curated(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a JSON array of authored records; classes that are not allowed go, and records without any."""
    schema = "lemma string, partOfSpeech array<string>, chinese array<string>, spanish array<string>, definitions struct<ca:array<string>,en:array<string>>, examples array<struct<ca:string,es:string,zh:string>>"
    r = in_order(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path))
    r = r.withColumn("p", F.filter(or_empty(F.col("partOfSpeech")), lambda x: x.isin(*POS))).where(F.size("p") > 0).withColumn("pos", F.element_at("p", 1))
    ok = lambda c: F.transform(F.filter(or_empty(F.col(c)), lambda v: valid_term(v)), lambda v: _clean(v, 500))
    ex = F.transform(F.filter("examples", lambda x: F.coalesce(x["ca"], F.lit("")) != ""), lambda x: F.to_json(F.struct(*(F.when(x[k] != "", _clean(x[k], 240)).alias(k) for k in ("ca", "es", "zh")))))
    return _facts(r, "curated", "curated", {"p": F.col("p"), "s": F.array(F.lit("curated")), "zh": ok("chinese"), "es": ok("spanish"), "d_ca": F.transform(or_empty(F.col("definitions.ca")), lambda v: _clean(v, 500)), "d_en": F.transform(or_empty(F.col("definitions.en")), lambda v: _clean(v, 500)), "ex": ex})


KAIKKI = (
    "lang_code string, word string, pos string, senses array<struct<glosses:array<string>,tags:array<string>,form_of:array<struct<word:string>>,examples:array<struct<text:string>>>>,"
    " sounds array<struct<ipa:string>>, forms array<struct<form:string,tags:array<string>>>"
)


def kaikki(spark: SparkSession, path: str, language: str = "ca") -> tuple[DataFrame, DataFrame]:
    """(facts, morphology) of a JSON-lines dictionary in one language; a line that is no JSON fails. A record all of whose senses
    are forms gives morphology only."""
    r = in_order(spark.read.schema(KAIKKI).option("mode", "FAILFAST").json(path).where(F.col("lang_code") == language))
    r = r.select("ordinal", _clean(F.col("word"), 120).alias("lemma"), lookup(KAIKKI_POS, F.col("pos")).alias("pos"), "senses", "sounds", "forms")
    form = lambda s: (F.coalesce(F.size(s["form_of"]), F.lit(0)) > 0) | F.coalesce(F.array_contains(s["tags"], "form-of"), F.lit(False))
    only = F.coalesce((F.size("senses") > 0) & F.forall("senses", form), F.lit(False))
    words, forms = r.where(~only & F.col("pos").isNotNull()), r.where(only)
    lexical = F.filter("senses", lambda s: F.coalesce(F.size(s["form_of"]), F.lit(0)) < 1)
    texts = lambda pick, most: F.transform(F.flatten(F.transform(lexical, pick)), lambda v: _clean(v, most))
    tags = F.flatten(F.transform("senses", lambda s: or_empty(s["tags"])))
    has = lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False))
    gender = F.when(has("masculine") & has("feminine"), "common").when(has("masculine"), "masculine").when(has("feminine"), "feminine")
    ex = F.transform(texts(lambda s: F.coalesce(F.transform(s["examples"], lambda x: x["text"]), F.array().cast("array<string>")), 240), lambda t: F.when(t != "", F.to_json(F.struct(t.alias("ca")))))
    usable = F.filter(F.coalesce("forms", F.array().cast("array<struct<form:string,tags:array<string>>>")), lambda f: valid_term(f["form"]) & ~F.arrays_overlap(or_empty(f["tags"]), F.array(*map(F.lit, NO_FORMS))))
    noun = lambda keep: F.when(F.col("pos") != "verb", F.transform(F.filter(usable, keep), lambda f: normalize(f["form"], "build", composed=True)))
    fields = {
        "p": F.array("pos"), "s": F.array(F.lit("kaikki")), "d_en": texts(lambda s: or_empty(s["glosses"]), 500), "ex": ex, "g": F.array(gender), "ipa": F.transform("sounds", lambda s: _clean(s["ipa"], 500)),
        "f": noun(lambda f: F.lit(True)), "pl": noun(lambda f: F.coalesce(F.array_contains(f["tags"], "plural"), F.lit(False))),
    }
    of = forms.select("lemma", "pos", F.explode("senses").alias("s")).select("lemma", "pos", kaikki_label(or_empty(F.col("s.tags"))).alias("label"), F.explode("s.form_of").alias("t"))
    a = morphology(of.select(F.col("lemma").alias("surface"), F.col("t.word").alias("lemma"), "label", F.coalesce("pos", F.lit("")).alias("pos")), "wiktionary")
    b = words.select(F.col("lemma").alias("word"), "pos", F.explode(usable).alias("x")).select(F.col("x.form").alias("surface"), F.col("word").alias("lemma"), kaikki_label(or_empty(F.col("x.tags"))).alias("label"), "pos")
    return _facts(words, "kaikki", "wiktionary", fields), a.unionByName(morphology(b, "wiktionary"))


def morphology(rows: DataFrame, layer: str) -> DataFrame:
    """surface, lemma, label, pos, layer: distinct analyses of valid terms; a word is no form of itself."""
    key = lambda c: normalize(F.col(c), "build").alias(c)
    m = rows.select(key("surface"), key("lemma"), _clean(F.col("label"), 180).alias("label"), F.coalesce("pos", F.lit("")).alias("pos"), F.lit(layer).alias("layer"))
    return m.where(valid_term(F.col("surface")) & valid_term(F.col("lemma")) & (F.col("surface") != F.col("lemma"))).distinct()


def pages(spark: SparkSession, path: str) -> DataFrame:
    """title, text of wiki pages of an XML dump (compressed dumps are split by the codec); titles with a colon are no words."""
    schema = "title string, revision struct<text:struct<_VALUE:string>>"
    p = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return p.where(~F.col("title").contains(":")).select("title", F.col("revision.text._VALUE").alias("text"))


def section(text: Column, headings: tuple[str, ...] = ("ca", "catala")) -> Column:
    """The first level-two section whose heading, folded, without braces and hyphens, is one of `headings`; empty without one."""
    # each part begins with its heading's text and line end
    parts = F.split(F.concat(F.lit("\n"), text), r"\n==(?!=)[ \t]*")
    fits = lambda p: fold(F.lower(F.trim(F.regexp_replace(F.regexp_extract(p, r"^(.*?)[ \t]*==[ \t]*(?:\n|$)", 1), r"[{}\-]", "")))).isin(*headings)
    hit = F.get(F.filter(F.slice(parts, 2, 1 << 30), fits), 0)
    return F.coalesce(F.regexp_replace(hit, r"^.*?==[ \t]*", ""), F.lit(""))


def _template(body: Column) -> Column:
    """What a template without inner ones leaves."""
    parts = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
    name, n = fold(F.lower(F.element_at(parts, 1))), F.size(parts)
    return F.when(name.isin("m", "terme", "enllac", "l") & (n >= 3), F.get(parts, 2)).when(name.isin("glossa", "sense", "text", "plural", "femeni", "masculi") & (n >= 2), F.element_at(parts, -1)).otherwise("")


def clean_wikitext(text: Column) -> Column:
    """References, links, templates, tags and quotes of wiki text rewritten as what they show. Templates are rewritten from the
    inside out, until none is left: as many passes as braces are deep."""
    t = F.regexp_replace(text, r"(?is)<ref\b[^>]*>.*?</ref>|<ref\b[^>]*/>", "")
    t = F.regexp_replace(t, r"\[\[([^\]|#]+)(?:#[^\]|]*)?\|([^\]]+)\]\]", "$2")
    t = F.regexp_replace(t, r"\[\[([^\]|#]+)(?:#[^\]]*)?\]\]", "$1")

    def once(x):
        pieces = F.split(x, r"\{\{[^{}]*\}\}", -1)
        bodies = F.transform(F.regexp_extract_all(x, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1)), lambda body: _template(body))
        shown = F.zip_with(pieces, F.concat(bodies, F.array(F.lit(""))), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.array_join(shown, "")

    depth = F.size(F.regexp_extract_all(t, F.lit(r"\{\{"), F.lit(0)))
    t = F.aggregate(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), t, lambda acc, _: F.when(acc.rlike(r"\{\{[^{}]*\}\}"), once(acc)).otherwise(acc))
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), "'{2,5}", "")
    return _clean(F.regexp_replace(t, r"\[(?:https?://\S+)\s+([^\]]+)\]", "$1"), 500)


CONJ, FORM = r"(?i)\{\{ca-forma-conj\|([^{}]+)\}\}", r"(?i)\{\{(?:forma-p|forma-f)\|ca\|([^|}]+)"
ANY_FORM = r"(?i)\{\{(?:ca-forma-conj|forma-p|forma-f|forma-flexionada|ca-(?:verb|nom|adj)-forma)\b"
TRANSLATION = r"(?i)\{\{trad(?:\+|-)?\|(es|zh)\|([^|}]+)"


def wiki(dump: DataFrame, last_pos: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts, morphology) of pages (title, text). A level-three heading sets the word class, lines with # are definitions, form
    templates are morphology, translations count where a definition is there. Forms get the class in force at their line, or
    with `last_pos` that of the page's last heading."""
    s = dump.select("title", section(F.col("text")).alias("section")).where("section <> ''")
    lines = s.select("title", F.posexplode(F.split("section", "\n")).alias("line", "text"))
    heading = F.regexp_extract(F.trim("text"), r"^===(?!=)\s*(.*?)\s*===\s*$", 1)
    is_heading = F.trim("text").rlike(r"^===(?!=)\s*(.*?)\s*===\s*$")
    lines = lines.withColumn("_h", F.when(is_heading, F.struct(heading_pos(heading).alias("pos"))))
    upto = Window.partitionBy("title").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("pos", F.last("_h", ignorenulls=True).over(upto)["pos"])
    ends = lines.groupBy("title").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("line")))["pos"].alias("end_pos"))
    raw = F.regexp_extract("text", r"^#(?![:*#])\s*(.+)$", 1)
    d = lines.where("_h is null and pos is not null").withColumn("raw", raw).where("raw <> ''")
    conj = F.transform(F.regexp_extract_all("raw", F.lit(CONJ), F.lit(1)), lambda b: F.transform(F.split(b, r"\|"), lambda p: _clean(p, 500)))
    forms = F.concat(
        F.transform(conj, lambda p: F.struct(F.element_at(p, 1).alias("lemma"), conjugation_label(F.slice(p, 2, 1 << 20)).alias("label"))),
        F.transform(F.regexp_extract_all("raw", F.lit(FORM), F.lit(1)), lambda t: F.struct(_clean(t, 500).alias("lemma"), F.lit("inflected nominal/adjectival form").alias("label"))),
    )
    found = d.join(ends, "title").select(F.col("title").alias("surface"), (F.col("end_pos") if last_pos else F.col("pos")).alias("pos"), F.inline(forms)).where("lemma <> ''")
    text = d.where(~F.col("raw").rlike(ANY_FORM)).withColumn("value", clean_wikitext(F.col("raw"))).where((F.length("value") >= 2) & F.col("pos").isin(*POS))
    ordinal = F.col("line").cast("long")
    definitions = _facts(text.select(F.col("title").alias("lemma"), "pos", ordinal.alias("ordinal"), "value"), "wiki", "wiktionary", {"p": F.array("pos"), "s": F.array(F.lit("wiki")), "d_ca": F.array("value")})
    defined = text.groupBy("title").agg(F.min("pos").alias("pos"))
    kinds, terms = (F.regexp_extract_all("section", F.lit(TRANSLATION), F.lit(k)) for k in (1, 2))
    pairs = s.join(defined, "title").select("title", "pos", F.explode(F.arrays_zip(kinds.alias("k"), terms.alias("t"))).alias("x"))
    pairs = pairs.select(F.col("title").alias("lemma"), "pos", F.lit(1 << 20).cast("long").alias("ordinal"), F.lower("x.k").alias("k"), clean_wikitext(F.col("x.t")).alias("t")).where(valid_term(F.col("t")))
    of = lambda k: F.when(F.col("k") == k, F.array("t"))
    return definitions.unionByName(_facts(pairs, "wiki", "wiktionary", {"es": of("es"), "zh": of("zh")})), morphology(found, "wiktionary")


def _side(node: ET.Element | None) -> str:
    """Text of a node with its inner parts: <b/> is a blank, <s>, <j> and <a> say nothing, what follows them stays."""
    if node is None:
        return ""
    out = [node.text or ""]
    for child in node:
        name = child.tag.rpartition("}")[2]
        out.append(" " if name == "b" else "" if name in ("s", "j", "a") else _side(child))
        out.append(child.tail or "")
    return "".join(out)


#: What surrounds the elements of these dictionaries, and the section of the words.
CONTEXTS, MAIN = {"pardef": "n", "section": "id"}, "section:main"
_PARTS = ("lm", "restriction", "name", "left", "right", "own", "pairs", "regex", "joined", "tags", "right_tags", "pars")


@F.pandas_udf(StructType([StructField(k, ArrayType(StringType()) if k in ("tags", "right_tags", "pars") else StringType()) for k in _PARTS]))
def side_text(x: pd.Series) -> pd.DataFrame:
    """The parts of an element <e>: attributes, texts of both sides (<p><l>, <p><r>) and of <i>, tags, names of paradigms."""

    def parts(raw: str) -> tuple:
        e = ET.fromstring(raw)
        names = lambda path: [n.get("n") or "" for n in e.findall(path)]
        flag = lambda path: "yes" if e.find(path) is not None else None
        text = lambda path: None if e.find(path) is None else _side(e.find(path))
        return e.get("lm"), e.get("r"), e.get("n"), text("./p/l"), text("./p/r"), text("./i"), flag("./p"), flag(".//re"), flag(".//j"), names(".//s"), names("./p/r/s"), names("./par")

    return pd.DataFrame([parts(v) for v in x], columns=_PARTS)


def metadix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, morphology) of a morphological dictionary: entries of the main section joined with the variants of their paradigm.
    Variants for generation only, with a regular expression or a joined word have no part."""
    every = stored(elements(spark, path, "e", CONTEXTS).where(F.col("context").startswith("pardef:") | (F.col("context") == MAIN)).select("context", "ordinal", side_text("xml").alias("x")))
    v = every.where(F.col("context") != MAIN).select(F.expr("substring(context, 8)").alias("paradigm"), "x")
    v = v.where("coalesce(x.restriction, '') <> 'RL' and x.regex is null and x.joined is null")
    v = v.select("paradigm", F.coalesce("x.left", "x.own", F.lit("")).alias("suffix"), tag_label(F.col("x.right_tags")).alias("label"), F.coalesce(tag_pos(F.col("x.right_tags")), F.lit("")).alias("variant_pos"))
    e = every.where(F.col("context") == MAIN).select("ordinal", "x")
    paradigm = F.get(F.filter("x.pars", lambda p: p.rlike(PARADIGM)), 0)
    pos = F.coalesce(tag_pos(F.col("x.tags")), lookup(APERTIUM_POS, F.regexp_extract(paradigm, "__([^/]+)$", 1)))
    trim = lambda c: _clean(F.col(c), 160)
    lemma = F.coalesce(*(F.when(c != "", c) for c in (_clean(F.col("x.lm"), 120), trim("x.right"), trim("x.own"))))
    e = e.select("ordinal", lemma.alias("lemma"), pos.alias("pos"), paradigm.alias("paradigm"), F.coalesce("x.own", "x.left", F.lit("")).alias("base"), F.col("x.left").alias("left"), F.col("x.right_tags").alias("tags"), (F.coalesce("x.restriction", F.lit("")) == "RL").alias("rl"), F.col("x.pairs").isNotNull().alias("paired"))
    e = e.where(F.col("pos").isin(*POS) & F.col("lemma").isNotNull())
    grown = e.where("paradigm is not null and not rl").join(v, "paradigm").select("ordinal", "lemma", "pos", F.concat("base", "suffix").alias("surface"), "label", F.coalesce(F.when(F.col("variant_pos") != "", F.col("variant_pos")), F.col("pos")).alias("form_pos"))
    alone = e.where("paradigm is null and paired and not rl").select("ordinal", "lemma", "pos", _clean(F.col("left"), 160).alias("surface"), tag_label(F.col("tags")).alias("label"), F.col("pos").alias("form_pos"))
    facts = _facts(e, "apertium", "apertium", {"p": F.array("pos"), "s": F.array(F.lit("apertium"))})
    nouns = grown.where("pos <> 'verb'").withColumn("k", normalize(F.col("surface"), "build", composed=True))
    facts = facts.unionByName(_facts(nouns, "apertium", "apertium", {"f": F.array("k"), "pl": F.when(F.col("label").contains("plural"), F.array("k"))}))
    both = grown.unionByName(alone).select("surface", "lemma", "label", F.col("form_pos").alias("pos"))
    return facts, morphology(both, "apertium")


def bilingual(spark: SparkSession, path: str, lexicon: DataFrame) -> DataFrame:
    """n, es: Spanish of a bilingual dictionary for keys that the lexicon (n) has. Pairs for one direction only and proper names
    have no part; an identity stands for both sides."""
    e = elements(spark, path, "e", CONTEXTS).where(F.col("context") == MAIN).select(side_text("xml").alias("x"))
    e = e.where("coalesce(x.restriction, '') <> 'LR'").where(F.col("x.pairs").isNull() | ~F.array_contains("x.right_tags", "np"))
    side = lambda c: _clean(F.when(F.col("x.pairs").isNotNull(), F.col(c)).otherwise(F.col("x.own")), 160)
    p = e.select(side("x.left").alias("es"), side("x.right").alias("ca")).where(valid_term(F.col("es")) & valid_term(F.col("ca")))
    return p.select(normalize(F.col("ca"), "build").alias("n"), "es").join(lexicon.select("n"), "n", "left_semi").distinct()


def wordnet(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """synset, lang, term of a table of tabs (synset, lang:lemma, term); rows of definitions and examples are left out, any other
    row is an error, and so is a synset of another shape."""
    rows = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    synset, kind = F.get("f", 0), F.get("f", 1)
    fault = F.when(~synset.rlike(r"^\d{8}-[anrv]$"), F.raise_error(F.concat(F.lit("invalid synset: "), synset)))
    fault = fault.when(~((kind == f"{lang}:lemma") & (F.size("f") == 3)) & ~kind.isin(f"{lang}:def", f"{lang}:exe"), F.raise_error(F.concat(F.lit("unexpected row: "), synset)))
    return rows.withColumn("_f", fault.cast("boolean")).where("_f is null").where(kind == f"{lang}:lemma").select(synset.alias("synset"), F.lit(lang).alias("lang"), F.get("f", 2).alias("term")).distinct()


def conversion_table(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a table of tabs: the first of the alternatives between blanks; # begins a comment."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t", 2).alias("f"))
    return rows.select(F.get("f", 0).alias("key"), F.get(F.split(F.get("f", 1), " "), 0).alias("value"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """n, l, p, zh, es, ex of authored records in JSON lines (key, lemma, partOfSpeech, zh, es, examples): Chinese is split at ；, Spanish
    at /; the first record of a key counts."""
    schema = "key string, lemma string, partOfSpeech string, zh string, es string, examples array<struct<ca:string,es:string,zh:string>>"
    r = in_order(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    parts = lambda c, mark: F.filter(F.transform(F.split(or_empty_text(c), mark), lambda x: F.trim(x)), lambda x: x != "")
    first = r.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("ordinal"))).where("_k = 1")
    return first.select(F.col("key").alias("n"), F.col("lemma").alias("l"), F.array("partOfSpeech").alias("p"), parts(F.col("zh"), "；").alias("zh"), parts(F.col("es"), "/").alias("es"), F.col("examples").alias("ex"))


def or_empty_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def reviewed_forms(spark: SparkSession, path: str) -> DataFrame:
    """surface, lemma, label, pos, ord, confidence of a table of tabs (surface, lemma, class, label, confidence); # begins a comment. The
    analyses of a surface keep their order; a confidence outside 0 to 1 is an error."""
    rows = in_order(spark.read.text(path)).where((F.col("value") != "") & ~F.col("value").startswith("#")).select("ordinal", F.split("value", "\t").alias("f"))
    sure = F.get("f", 4).cast("double")
    fault = F.when((F.size("f") != 5) | ~F.coalesce(sure.between(0, 1), F.lit(False)), F.raise_error(F.concat(F.lit("invalid form: "), F.get("f", 0)))).cast("boolean")
    good = rows.withColumn("_f", fault).where("_f is null")
    order = F.row_number().over(Window.partitionBy(F.get("f", 0)).orderBy("ordinal"))
    return good.select(normalize(F.get("f", 0), "build").alias("surface"), normalize(F.get("f", 1), "build").alias("lemma"), F.get("f", 3).alias("label"), F.get("f", 2).alias("pos"), order.alias("ord"), sure.alias("confidence"))
