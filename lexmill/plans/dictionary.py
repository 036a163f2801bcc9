"""Registered queries of the dictionary operators over the driver's tables, each with its SQL where SQL can express it.

Documents stand for sources: tokens are headwords, their counts give ranks; a word that ends in -en or -er counts as a
verb, -s as a plural, -t as the third person of -en. Orders, events and customers stand for keyed records.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import han as H
from ..functions import labels as B
from ..functions import text as T
from ..operators import acceptance as A
from ..operators import entries as E
from ..operators import evidence as V
from ..operators import gates as G
from ..operators import lexicon as L
from ..operators import lookup as U
from ..operators import offline as O
from ..operators import sample as M
from ..operators import search as R
from ..operators import state as S
from ..operators.store import stored
from ..sources import lexical as X
from .queries import COUNTS, LATIN, RANKED, query, table, values


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(quoted, v)) + "]"
    if isinstance(v, int) and abs(v) >= 1 << 31:
        return f"CAST({v} AS BIGINT)"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


# --- headwords and morphology of the documents

KIND = "CASE WHEN {0} LIKE '%en' OR {0} LIKE '%er' THEN ['verb'] ELSE ['noun'] END"
LEX = f"(SELECT token AS n, token AS l, {KIND.format('token')} AS p, rank AS r FROM {RANKED})"
MORPH = f"""(SELECT s.token AS surface, t.token AS lemma, 'plural' AS label, 'noun' AS pos, 1 AS ord FROM {COUNTS} s JOIN {COUNTS} t ON s.token = t.token || 's'
 UNION ALL SELECT s.token, t.token, 'present indicative third person', 'verb', 2 FROM {COUNTS} s JOIN {COUNTS} t ON ends_with(t.token, 'en') AND length(t.token) > 2 AND s.token = substr(t.token, 1, length(t.token) - 2) || 't')"""


def lexicon(spark, sf) -> DataFrame:
    ranks = L.ranked(L.token_frequency(table(spark, sf, "documents")))
    verb = F.col("token").endswith("en") | F.col("token").endswith("er")
    words = ranks.select(F.col("token").alias("n"), F.col("token").alias("l"), F.when(verb, F.array(F.lit("verb"))).otherwise(F.array(F.lit("noun"))).alias("p"), F.col("rank").alias("r"), F.col("n").alias("freq"))
    return stored(words)  # every tier reads it


def morphology(words: DataFrame) -> DataFrame:
    """Analyses among the words (n)."""
    known = words.select(F.col("n").alias("lemma"))
    plural = words.where(F.col("n").endswith("s")).select(F.col("n").alias("surface"), F.expr("substring(n, 1, length(n) - 1)").alias("lemma"))
    third = words.where(F.col("n").endswith("t")).select(F.col("n").alias("surface"), F.expr("concat(substring(n, 1, length(n) - 1), 'en')").alias("lemma"))
    one = lambda d, label, pos, n: d.join(known, "lemma").select("surface", "lemma", F.lit(label).alias("label"), F.lit(pos).alias("pos"), F.lit(n).alias("ord"))
    return one(plural, "plural", "noun", 1).unionByName(one(third, "present indicative third person", "verb", 2))


CORE_SQL = f"(SELECT n, l, r FROM {LEX} WHERE r <= 5000)"
ASKED_CASCADE = ("the", " THE ", "qzx", "l'the", "ein-me", "machen-me", "thw", "eint", "einx", "comx", "unds", "...", "")
SQL_ASKED = "(SELECT unnest(" + quoted(list(ASKED_CASCADE)) + ") AS q)"
FOLD = "translate(strip_accents({}), 'ßœæ', 'ABC')"
CASCADE = f"""
WITH lex AS MATERIALIZED {LEX}, morph AS MATERIALIZED {MORPH}, core AS MATERIALIZED {CORE_SQL},
asked AS (SELECT q, regexp_replace(trim(lower(q)), '\\s+', ' ', 'g') AS key FROM {SQL_ASKED}),
fit AS (SELECT * FROM asked WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]')),
keys AS (SELECT DISTINCT key FROM fit),
t0 AS (SELECT k.key, CASE WHEN trim(k.q) = k.key THEN 'exact' ELSE 'normalized-exact' END AS source, k.q, n, l FROM fit k JOIN lex ON k.key = lex.n),
missed AS (SELECT key FROM keys WHERE key NOT IN (SELECT n FROM lex)),
an AS (SELECT key, m.lemma AS n, min(struct_pack(a := CASE WHEN label LIKE '%indicative%' THEN 1 ELSE 4 END, o := ord, label := label)) AS b FROM missed JOIN morph m ON m.surface = key GROUP BY ALL),
t1 AS (SELECT key, 'morphology' AS source, row_number() OVER (PARTITION BY key ORDER BY lex.r) AS pos, an.n, lex.l, b.label AS label FROM an JOIN lex ON an.n = lex.n),
m2 AS (SELECT key FROM missed WHERE key NOT IN (SELECT key FROM t1)),
host AS (SELECT key, substr(key, 1, length(key) - 3) AS h FROM m2 WHERE ends_with(key, '-me')),
t2 AS (SELECT key, 'clitic' AS source, 1 AS pos, n, l, 'verb + clitic me' AS label FROM host JOIN lex ON h = n WHERE list_contains(p, 'verb')),
h2 AS (SELECT key, m.lemma AS n, min(struct_pack(a := CASE WHEN label LIKE '%indicative%' THEN 1 ELSE 4 END, o := ord, label := label)) AS b FROM host JOIN morph m ON m.surface = h WHERE key NOT IN (SELECT key FROM t2) GROUP BY ALL),
t2b AS (SELECT * FROM (SELECT key, 'clitic' AS source, row_number() OVER (PARTITION BY key ORDER BY lex.r) AS pos, h2.n, lex.l, b.label || ' + clitic me' AS label FROM h2 JOIN lex ON h2.n = lex.n WHERE list_contains(lex.p, 'verb')) WHERE pos <= 4),
t3 AS (SELECT key, 'clitic' AS source, 1 AS pos, n, l, 'elided l'' + lemma' AS label FROM m2 JOIN lex ON starts_with(key, 'l''') AND substr(key, 3) = n WHERE key NOT IN (SELECT key FROM t2) AND key NOT IN (SELECT key FROM t2b)),
found AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t2b UNION ALL SELECT * FROM t3),
m3 AS (SELECT key FROM missed WHERE key NOT IN (SELECT key FROM found)),
pre AS (SELECT * FROM (SELECT key, l, n, r, strip_accents(n) = strip_accents(key) AND n <> key AS accent, row_number() OVER (PARTITION BY key ORDER BY r) AS pos FROM m3 JOIN lex ON starts_with(strip_accents(n), strip_accents(key))) WHERE pos <= 8),
pre2 AS (SELECT key, l, max(accent) OVER (PARTITION BY key) AS any_accent, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN pos = first THEN 0 ELSE pos END) AS pos FROM (SELECT *, min(CASE WHEN accent THEN pos END) OVER (PARTITION BY key) AS first FROM pre)),
m4 AS (SELECT key FROM m3 WHERE key NOT IN (SELECT key FROM pre)),
fz AS (SELECT * FROM (SELECT key, l, row_number() OVER (PARTITION BY key ORDER BY d, r) AS pos FROM (SELECT key, l, r, levenshtein({FOLD.format('key')}, {FOLD.format('n')}) AS d, CASE WHEN length(key) <= 4 THEN 1 WHEN length(key) <= 8 THEN 2 ELSE 3 END AS most FROM m4 CROSS JOIN core) WHERE d <= most) WHERE pos <= 8),
rest AS (
 SELECT key, 'found' AS status, source, pos, n, l, label FROM found
 UNION ALL SELECT key, 'not-found', CASE WHEN any_accent THEN 'fuzzy' ELSE 'prefix' END, pos, NULL, l, NULL FROM pre2
 UNION ALL SELECT key, 'not-found', 'fuzzy', pos, NULL, l, NULL FROM fz
 UNION ALL SELECT key, 'not-found', 'none', NULL, NULL, NULL, NULL FROM m4 WHERE key NOT IN (SELECT key FROM fz))
SELECT q, 'found' AS status, source, CAST(1 AS INTEGER) AS pos, n, l, CAST(NULL AS VARCHAR) AS label FROM t0
UNION ALL SELECT f.q, status, source, CAST(coalesce(pos, 0) AS INTEGER), n, l, label FROM fit f JOIN rest USING (key)
UNION ALL SELECT q, 'not-found', 'none', 0, NULL, NULL, NULL FROM asked WHERE NOT regexp_matches(key, '[\\p{{L}}\\p{{N}}]')"""


#: Every step is kept, so that no engine evaluates a pairing twice.
CASCADE = re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", CASCADE)


@query("catalan_cascade", CASCADE)
def _(spark, sf):
    lex = lexicon(spark, sf)
    core = lex.where("r <= 5000")
    return U.catalan(values(spark, ASKED_CASCADE), lex, morphology(lex), core).select("q", "status", "source", F.coalesce("pos", F.lit(0)).alias("pos"), "n", "l", "label")


@query("morphology_lookup", f"SELECT surface AS q, CAST(row_number() OVER (PARTITION BY surface ORDER BY r) AS INTEGER) AS pos, lemma AS n, label FROM {MORPH} m JOIN {LEX} x ON m.lemma = x.n")
def _(spark, sf):
    lex = lexicon(spark, sf)
    m = morphology(lex)
    forms = m.select(F.col("surface").alias("q"), F.col("surface").alias("form")).distinct()
    return U.analyses(forms, m, lex).select("q", "pos", "n", "label")


@query("frequency_attribution", f"WITH lex AS (SELECT token FROM {COUNTS} WHERE NOT ends_with(token, 's')), m AS (SELECT s.token AS surface, t.token AS lemma FROM {COUNTS} s JOIN lex t ON s.token = t.token || 's') SELECT n, CAST(sum(c) AS BIGINT) AS freq FROM (SELECT token AS n, n AS c FROM {COUNTS} WHERE token IN (FROM lex) UNION ALL SELECT lemma, n FROM {COUNTS} JOIN m ON token = surface WHERE token NOT IN (FROM lex)) GROUP BY n")
def _(spark, sf):
    counts = L.token_frequency(table(spark, sf, "documents"))
    lex = counts.where(~F.col("token").endswith("s")).select(F.col("token").alias("n"))
    plurals = counts.where(F.col("token").endswith("s")).select(F.col("token").alias("surface"), F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return E.attribute_frequency(counts, lex, plurals.join(lex, F.col("lemma") == F.col("n"), "left_semi"))


@query("morphology_cap", f"SELECT surface, lemma, label, CAST(ord AS INTEGER) AS ord FROM (SELECT surface, lemma, label, row_number() OVER (PARTITION BY surface ORDER BY c.n DESC, lemma, label, pos) AS ord FROM {MORPH} m JOIN {COUNTS} c ON m.lemma = c.token) WHERE ord <= 16")
def _(spark, sf):
    lex = lexicon(spark, sf)
    return E.clean_morphology(morphology(lex).drop("ord"), lex).select("surface", "lemma", "label", "ord")


@query("quality_rank", f"SELECT token AS n, row_number() OVER (ORDER BY n DESC, (length(token) % 3) DESC, length(token), token) AS rank FROM {COUNTS}")
def _(spark, sf):
    c = L.token_frequency(table(spark, sf, "documents")).select(F.col("token").alias("n"), F.col("n").alias("freq"))
    return E.quality_rank(c.withColumn("quality", F.length("n") % 3)).select("n", "rank")


@query("core_morphology", f"SELECT surface, lemma FROM {MORPH} WHERE lemma IN (SELECT token FROM {RANKED} WHERE rank <= 5000)")
def _(spark, sf):
    lex = lexicon(spark, sf)
    return O.core_only(morphology(lex), lex.where("r <= 5000")).select("surface", "lemma")


ASKED_ES = ("th", "the", "teh", "ein", "comn", "a", "Él")


ES_KEY = "replace(strip_accents(replace({}, 'ñ', '~')), '~', 'ñ')"
ONE_LETTER = "translate({}, '" + LATIN + "', '" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[: len(LATIN)] + "')"


def spanish_sql(words) -> str:
    return f"""
WITH k AS MATERIALIZED (SELECT q, k, CASE WHEN length(k) < 6 THEN 1 ELSE 2 END AS most FROM (SELECT q, {ES_KEY.format("lower(q)")} AS k FROM (SELECT unnest({quoted(list(words))}) AS q)) WHERE length(k) BETWEEN 2 AND 64),
w AS MATERIALIZED (SELECT token AS term, rank, {ES_KEY.format("token")} AS key FROM {RANKED}),
m AS (SELECT q, term, rank, key, CASE WHEN key = k THEN 0 WHEN starts_with(key, k) THEN 1 ELSE 2 END AS score FROM k JOIN w ON contains(key, k)
 UNION ALL SELECT q, term, rank, key, d + 3 FROM (SELECT *, damerau_levenshtein({ONE_LETTER.format("k")}, {ONE_LETTER.format("key")}) AS d FROM k JOIN w ON length(k) >= 3 AND abs(length(key) - length(k)) <= most AND NOT contains(key, k)) WHERE d <= most)
SELECT q, CAST(pos AS INTEGER) AS pos, term, term AS lemma, CASE score WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'contains' ELSE 'fuzzy' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, rank, length(key), term) AS pos FROM m) WHERE pos <= 8"""


LITERAL_ES = ("th", "ein", "co", "Él")


@query("suggest_literal", spanish_sql(LITERAL_ES))
def _(spark, sf):
    rows = lexicon(spark, sf).select(T.spanish_key(F.col("n")).alias("key"), F.col("n").alias("term"), F.col("n").alias("lemma"), F.col("r").alias("rank"))
    return R.suggest_spanish(values(spark, LITERAL_ES), rows)


@query("suggest_spanish", spanish_sql(ASKED_ES))
def _(spark, sf):
    rows = lexicon(spark, sf).select(T.spanish_key(F.col("n")).alias("key"), F.col("n").alias("term"), F.col("n").alias("lemma"), F.col("r").alias("rank"))
    return R.suggest_spanish(values(spark, ASKED_ES), rows)


TERMS = "(SELECT CAST(p_partkey AS VARCHAR) AS lemma, p_name AS term, CASE WHEN p_size % 3 = 0 THEN 'alias' ELSE 'translation' END AS kind, CASE WHEN p_size % 5 = 0 THEN 1 END AS priority, p_partkey AS rank FROM part)"


def terms(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("lemma"), F.col("p_name").alias("term"), F.when(F.col("p_size") % 3 == 0, "alias").otherwise("translation").alias("kind"), F.when(F.col("p_size") % 5 == 0, 1).alias("priority"), F.col("p_partkey").cast("long").alias("rank"))


@query("reverse_index", f"SELECT lower(term) AS key, lemma, term, kind, CAST(coalesce(priority, 0) AS INTEGER) AS priority FROM {TERMS}")
def _(spark, sf):
    return R.build_index(terms(spark, sf), "es").select("key", "lemma", "term", "kind", F.coalesce("priority", F.lit(0)).alias("priority"))


@query("reverse_postings", f"SELECT q, CAST(pos AS INTEGER) AS pos, lemma, kind, exact FROM (SELECT q, lemma, kind, term = lower(q) AS exact, row_number() OVER (PARTITION BY q ORDER BY term = lower(q) DESC, coalesce(priority, 0) DESC, rank, lemma, term, kind) AS pos FROM (SELECT DISTINCT upper(p_name) AS q FROM part) JOIN {TERMS} ON lower(q) = lower(term)) WHERE pos <= 32")
def _(spark, sf):
    asked = table(spark, sf, "part").select(F.upper("p_name").alias("q")).distinct()
    return R.reverse(asked, R.build_index(terms(spark, sf), "es"), "es").select("q", "pos", "lemma", "kind", "exact")


@query("suggestion_catalogue", f"SELECT lower(term) AS key, arg_min(term, (-coalesce(priority, 0), rank, lemma, term, kind)) AS term, CAST(min(9007199254740991) AS BIGINT) AS rank FROM {TERMS} GROUP BY 1")
def _(spark, sf):
    none = spark.createDataFrame([], "n string, l string, r long")
    return R.catalogue(R.build_index(terms(spark, sf), "es"), none, "es").select("key", "term", "rank")


# --- entries

LAYER = "(SELECT 'k' || (doc_id % 97) AS n, CASE WHEN doc_id % 3 = 0 THEN upper(lang) END AS l, doc_id % 5 AS priority, doc_id, source, lang, n_chars FROM documents)"


def layers(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    none = lambda t: F.lit(None).cast(t)
    flag = F.col("doc_id") % 7 == 0
    return d.select(
        F.concat(F.lit("k"), (F.col("doc_id") % 97).cast("string")).alias("n"), F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).alias("l"), F.array("lang").alias("p"), none("string").alias("g"), none("array<string>").alias("pl"),
        F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("zh"), F.array("source", "lang").alias("es"),
        F.struct(F.array(F.col("lang")).alias("ca"), none("array<string>").alias("en"), none("array<string>").alias("es"), none("array<string>").alias("zh")).alias("d"),
        F.array(F.struct(F.col("source").alias("ca"), none("string").alias("es"), none("string").alias("zh"))).alias("ex"), F.array("source").alias("f"), none("string").alias("ipa"), F.array("lang").alias("s"),
        none("array<struct<sourceId:string,sourceEntryId:string,fields:array<string>>>").alias("pv"), F.col("n_chars").cast("long").alias("r"), F.when(flag, True).alias("zhMachine"), none("boolean").alias("zhReference"), none("boolean").alias("zhHeadword"),
        F.col("doc_id").alias("priority"), "doc_id",
    )


MERGED = """
WITH x AS (SELECT 'k' || (doc_id % 97) AS n, * FROM documents),
 v AS (SELECT n, v, min((doc_id, o)) AS first_at FROM (SELECT n, doc_id, unnest([source, lang]) AS v, unnest([0, 1]) AS o FROM x) GROUP BY ALL),
 es AS (SELECT n, string_agg(v, ',' ORDER BY first_at) AS es FROM v GROUP BY n),
 f AS (SELECT n, string_agg(source, ',' ORDER BY k) AS f FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY first_at) AS k FROM (SELECT n, source, min(doc_id) AS first_at FROM x GROUP BY ALL)) WHERE k <= 24 GROUP BY n),
 ex AS (SELECT n, CAST(least(count(DISTINCT source), 4) AS INTEGER) AS examples FROM x GROUP BY n),
 s AS (SELECT n, arg_min(upper(lang), doc_id) FILTER (doc_id % 3 = 0) AS l, min(n_chars) AS r, arg_min(CASE WHEN doc_id % 7 = 0 THEN 'yes' ELSE 'no' END, doc_id) FILTER (doc_id % 2 = 0) AS machine, arg_max(CASE WHEN doc_id % 7 = 0 THEN 'yes' ELSE 'no' END, doc_id) AS last_machine FROM x GROUP BY n)
SELECT n, l, CAST(r AS BIGINT) AS r, es, f, examples, coalesce(machine, last_machine) = 'yes' AS machine FROM s JOIN es USING (n) JOIN f USING (n) JOIN ex USING (n)"""


@query("entry_merge", MERGED)
def _(spark, sf):
    m = E.merge(layers(spark, sf))
    return m.select("n", "l", "r", F.array_join("es", ",").alias("es"), F.array_join("f", ",").alias("f"), F.size("ex").alias("examples"), F.coalesce("zhMachine", F.lit(False)).alias("machine"))


@query("entry_pack", "SELECT n, array_to_string(list_slice(list_transform(list_sort(list_transform(es, lambda v: {'a': len(string_split(v, ' ')), 'b': length(v), 'c': v})), lambda z: z.c), 1, 12), ',') AS es FROM (SELECT 'k' || (doc_id % 97) AS n, list_distinct(list(source || CASE WHEN doc_id % 2 = 0 THEN ' ' || lang ELSE '' END)) AS es FROM documents GROUP BY 1)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    e = d.groupBy(F.concat(F.lit("k"), (F.col("doc_id") % 97).cast("string")).alias("n")).agg(F.collect_set(F.concat("source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("lang"))).otherwise(F.lit("")))).alias("es"))
    none = F.array().cast("array<string>")
    full = e.withColumns({k: none for k in ("p", "s", "zh", "pl", "f", "ex")})
    return E.pack(full).select("n", F.array_join("es", ",").alias("es"))


@query("entry_unpack", "SELECT CAST(p_partkey AS VARCHAR) AS normalizedLemma, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_name END AS plural FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("n"), F.array(F.when(F.col("p_size") % 2 == 0, "verb").otherwise("noun")).alias("p"), F.array("p_name").alias("pl"))
    return E.unpack(p).select("normalizedLemma", F.array_join("plural", ",").alias("plural"))


@query("headword_upsert", "SELECT lower(source) AS n, arg_min(source, (doc_id % 4, doc_id)) AS l, string_agg(DISTINCT lang, ',' ORDER BY lang) AS s FROM documents GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents")
    f = d.select(F.col("source").alias("lemma"), F.col("lang").alias("source"), F.lit(None).cast("string").alias("pos"), (F.col("doc_id") % 4).alias("priority"), F.col("doc_id").alias("ordinal"))
    return E.headwords(f).select("n", "l", F.array_join("s", ",").alias("s"))


@query("layer_accumulate", "SELECT n, layer, string_agg(v, ',' ORDER BY first_at) AS items FROM (SELECT *, row_number() OVER (PARTITION BY n, layer ORDER BY first_at, v) AS k FROM (SELECT 'k' || (doc_id % 31) AS n, lang AS layer, source AS v, min(doc_id) AS first_at FROM documents GROUP BY ALL)) WHERE k <= 8 GROUP BY ALL")
def _(spark, sf):
    f = table(spark, sf, "documents").select(F.concat(F.lit("k"), (F.col("doc_id") % 31).cast("string")).alias("n"), F.col("lang").alias("layer"), F.lit("d_ca").alias("field"), F.col("source").alias("value"), F.col("doc_id").alias("ordinal"))
    return E.accumulate(f).select("n", "layer", F.array_join("items", ",").alias("items"))


@query("fill_chinese", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '字' ELSE CASE WHEN quality IS NOT NULL THEN '新' END END AS zh FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    none = lambda t: F.lit(None).cast(t)
    pv = none("array<struct<sourceId:string,sourceEntryId:string,fields:array<string>>>").alias("pv")
    d = none("struct<ca:array<string>,en:array<string>,es:array<string>,zh:array<string>>").alias("d")
    flags = [none("boolean").alias(c) for c in E.FLAGS]
    e = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("n"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("字"))).alias("zh"), d, F.array("lang").alias("s"), pv, *flags)
    o = table(spark, sf, "labels").where("quality is not null").select(F.col("doc_id").cast("string").alias("n"), F.array(F.lit("新")).alias("zh"), F.array(F.lit("o")).alias("s"), pv, *flags)
    return E.fill_chinese(e, o).select(F.col("n").cast("long").alias("doc_id"), F.array_join("zh", ",").alias("zh"))


# --- evidence

def evidence_layers(spark, sf) -> DataFrame:
    """Documents as layers of 61 lemmas, with English, Catalan and Spanish texts."""
    d = table(spark, sf, "documents")
    none = F.lit(None).cast("array<string>")
    text = F.concat_ws(" ", "lang", "source")
    ca = F.when(F.col("doc_id") % 3 == 1, F.array(F.concat(text, F.lit(" tercera"))))
    return d.select(
        F.concat(F.lit("k"), (F.col("doc_id") % 61).cast("string")).alias("n"), F.when(F.col("doc_id") % 2 == 0, "lex").otherwise("wiktionary").alias("layer"), F.col("doc_id").alias("ordinal"), F.array("source").alias("s"), F.array(F.lit("noun")).alias("p"),
        F.struct(ca.alias("ca"), F.when(F.col("doc_id") % 3 == 0, F.array(text)).alias("en"), none.alias("es"), none.alias("zh")).alias("d"), F.when(F.col("doc_id") % 3 == 2, F.array("lang")).alias("es"), F.col("lang").alias("l"),
    )


EVIDENCE = """(SELECT n, layer, kind, language, text, source, 'e' || format('{:03d}', row_number() OVER (PARTITION BY n ORDER BY first_at)) AS id FROM (
 SELECT n, layer, kind, language, text, arg_min(source, doc_id) AS source, min(doc_id) AS first_at FROM (
  SELECT 'k' || (doc_id % 61) AS n, CASE WHEN doc_id % 2 = 0 THEN 'lex' ELSE 'wiktionary' END AS layer, doc_id, source, CASE WHEN doc_id % 3 = 2 THEN 'translation_hint' ELSE 'definition' END AS kind,
   CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ca' ELSE 'es' END AS language, CASE doc_id % 3 WHEN 0 THEN lang || ' ' || source WHEN 1 THEN lang || ' ' || source || ' tercera' ELSE lang END AS text FROM documents) GROUP BY ALL))"""


@query("evidence_rows", f"SELECT n, id, kind, language, text, layer, source FROM {EVIDENCE}")
def _(spark, sf):
    return V.evidence(evidence_layers(spark, sf)).select("n", "id", "kind", "language", "text", "layer", F.element_at("sources", 1).alias("source"))


@query("job_identity", f"""SELECT id, n, sha256(text) AS sourceHash, sha256('{{"kind":"' || kind || '","layer":"' || layer || '","normalizedLemma":"' || n || '","sourceIds":["' || source || '"],"sourceLanguage":"' || language || '","sourcePartOfSpeech":["noun"],"sourceText":"' || text || '"}}') AS jobId FROM {EVIDENCE}""")
def _(spark, sf):
    rows = V.evidence(evidence_layers(spark, sf))
    jobs = V.evidence_jobs(rows)
    keys = ["normalizedLemma", "kind", "sourceLanguage", "sourceText", "layer"]
    ids = rows.select("id", *(F.col(a).alias(b) for a, b in zip(("n", "kind", "language", "text", "layer"), keys, strict=True)))
    return jobs.join(ids, keys).select("id", F.col("normalizedLemma").alias("n"), "sourceHash", "jobId")


@query("evidence_selection", f"""WITH e AS {EVIDENCE}, s AS (SELECT n, bool_or(kind = 'definition' AND language = 'en') AS en, bool_or(kind = 'definition' AND language = 'ca') AS ca FROM e GROUP BY n)
SELECT n, language, text FROM (SELECT e.n, language, text, row_number() OVER (PARTITION BY e.n ORDER BY first) AS k FROM (SELECT n, kind, language, text, min(id) AS first, bool_or(layer = 'lex') AS sure FROM e WHERE kind = 'definition' OR layer = 'lex' GROUP BY ALL) e JOIN s USING (n)
 WHERE CASE WHEN s.en AND NOT s.ca THEN kind = 'definition' AND language = 'en' WHEN s.ca THEN kind = 'definition' AND language = 'ca' ELSE kind = 'translation_hint' END) WHERE k <= 3
UNION ALL SELECT 'k' || (doc_id % 61), 'ca', min(lang) FROM documents WHERE 'k' || (doc_id % 61) NOT IN (SELECT e.n FROM e JOIN s USING (n) WHERE s.en OR s.ca OR layer = 'lex') GROUP BY 1""")
def _(spark, sf):
    lay = evidence_layers(spark, sf)
    heads = lay.groupBy("n").agg(F.min("l").alias("l"), F.first("p").alias("p"))
    return V.selected(V.evidence(lay), heads, lay).select(F.col("normalizedLemma").alias("n"), F.col("sourceLanguage").alias("language"), F.col("sourceText").alias("text"))


@query("evidence_unbound", f"SELECT n, text FROM {EVIDENCE} WHERE layer = 'lex'")
def _(spark, sf):
    rows = V.evidence(evidence_layers(spark, sf))
    return V.unbound(rows, rows.where("layer = 'wiktionary'")).select("n", "text")


@query("bound_jobs", f"SELECT n, count(*) AS jobs FROM {EVIDENCE} GROUP BY n")
def _(spark, sf):
    jobs = V.evidence_jobs(V.evidence(evidence_layers(spark, sf)))
    return V.bound(jobs, jobs).groupBy(F.col("normalizedLemma").alias("n")).agg(F.count("*").alias("jobs"))


@query("trusted_corroboration", "WITH h AS (SELECT DISTINCT 'k' || (doc_id % 61) AS n, lang, doc_id % 2 = 0 AS sure FROM documents WHERE doc_id % 3 = 2) SELECT n, lang AS text, bool_or(sure) AS corroborated FROM h GROUP BY ALL HAVING bool_or(NOT sure)")
def _(spark, sf):
    return V.corroborated(evidence_layers(spark, sf)).distinct()


@query("queue_routing", "SELECT CAST(doc_id AS VARCHAR) AS n, coalesce(toxic = 1, false) AS core, n_chars AS r, CASE WHEN quality = 1 THEN 'definitions' WHEN quality = 0 THEN 'spanish-hints' ELSE 'needs-source' END AS route FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    none = lambda t: F.lit(None).cast(t)
    e = d.select(F.col("doc_id").cast("string").alias("n"), none("array<string>").alias("zh"), none("struct<zh:array<string>>").alias("d"), F.col("n_chars").cast("long").alias("r"))
    rows = lab.where("quality is not null").select(F.col("doc_id").cast("string").alias("n"), F.when(F.col("quality") == 1, "definition").otherwise("translation_hint").alias("kind"), F.lit("ca").alias("language"), F.when(F.col("quality") == 0, True).alias("verified"))
    return V.queue(e, rows, lab.where("toxic = 1").select(F.col("doc_id").cast("string").alias("n")))


@query("correction_order", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '改' WHEN o_orderkey % 3 = 0 THEN '法' WHEN o_orderkey % 2 = 0 THEN '机' END AS translation, CASE WHEN o_orderkey % 5 = 0 THEN 'correction' WHEN o_orderkey % 3 = 0 THEN 'grammar' WHEN o_orderkey % 2 = 0 THEN 'machine' END AS origin FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("jobId"), F.col("o_orderkey").cast("string").alias("normalizedLemma"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sourceHash"))
    c = o.where("jobId % 5 = 0").withColumn("translation", F.lit("改"))
    r = o.where("jobId % 2 = 0").withColumn("translation", F.lit("机"))
    return V.decide(o, r, c, F.when(F.col("jobId") % 3 == 0, "法")).select(F.col("jobId").alias("o_orderkey"), "translation", "origin")


@query("retry_jobs", "SELECT o_orderkey, o_orderkey % 7 = 0 AS pivoted FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 5 <> 0")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("jobId"))
    pivots = o.where("jobId % 7 = 0").select("jobId", F.lit("en").alias("language"), F.lit("t").alias("text"))
    return V.retry(o, o.where("jobId % 2 = 0"), o.where("jobId % 5 = 0"), pivots).select(F.col("jobId").alias("o_orderkey"), F.col("pivot").isNotNull().alias("pivoted"))


@query("pending_per_lemma", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3 AND event_id % 3 <> 0")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("n"), "event_id")
    return V.pending(rows, rows.where("event_id % 3 = 0"), ["n", "event_id"], "event_id").select(F.col("n").alias("user_id"), "event_id")


# --- gates

@query("build_summary", f"""WITH f AS (SELECT surface, count(*) AS n FROM {MORPH} GROUP BY surface) SELECT unnest(['forms', 'analyses', 'ambiguous', 'lemmas', 'pos', 'source', 'spanish', 'chinese', 'catalanDefinitions', 'englishGlosses', 'meaning']) AS name, unnest([(SELECT count(*) FROM f), (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM f), (SELECT count(*) FROM f WHERE n > 1), (SELECT count(*) FROM {COUNTS}), (SELECT count(*) FROM {COUNTS}), 0, 0, 0, 0, 0, 0]) AS value""")
def _(spark, sf):
    lex = lexicon(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    e = lex.withColumns({"s": none("array<string>"), "es": none("array<string>"), "zh": none("array<string>"), "d": none("struct<ca:array<string>,en:array<string>>")})
    return G.summary(e, morphology(lex))


@query("pos_histogram", f"SELECT unnest({KIND.format('token')}) AS value, count(*) AS n FROM {COUNTS} GROUP BY 1")
def _(spark, sf):
    return G.histogram(lexicon(spark, sf), "p")


def covered(spark, sf) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(F.col("doc_id").cast("string").alias("n"), F.array("lang").alias("p"), F.when(F.col("source") != "src3", F.array("source")).alias("s"), F.when(F.col("quality") == 1, F.array("lang")).alias("es"), none("array<string>").alias("zh"), F.struct(F.when(F.col("toxic") == 1, F.array("lang")).alias("ca"), none("array<string>").alias("en")).alias("d"))


@query("coverage_ratios", "WITH r AS (SELECT avg(1.0) AS found, avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0 END) AS pos, avg(CASE WHEN source <> 'src3' THEN 1.0 ELSE 0 END) AS source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS spanish, avg(CASE WHEN quality = 1 OR toxic = 1 THEN 1.0 ELSE 0 END) AS meaning, avg(0.0) AS chinese, avg(0.0) AS \"englishGlosses\", avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END) AS \"catalanDefinitions\" FROM documents LEFT JOIN labels USING (doc_id)) SELECT name, round(share, 9) AS share FROM r UNPIVOT (share FOR name IN (found, pos, source, spanish, meaning, chinese, \"englishGlosses\", \"catalanDefinitions\"))")
def _(spark, sf):
    return G.coverage(covered(spark, sf)).select("name", F.round("share", 9).alias("share"))


@query("high_frequency_gate", "WITH r AS (SELECT avg(CASE WHEN d.doc_id IS NOT NULL THEN 1.0 ELSE 0 END) AS found, avg(CASE WHEN d.source <> 'src3' THEN 1.0 ELSE 0 END) AS source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS spanish, avg(CASE WHEN d.lang IS NOT NULL THEN 1.0 ELSE 0 END) AS pos, avg(0.0) AS chinese, avg(0.0) AS \"englishGlosses\", avg(CASE WHEN d.doc_id IS NOT NULL AND toxic = 1 THEN 1.0 ELSE 0 END) AS \"catalanDefinitions\", avg(CASE WHEN d.doc_id IS NOT NULL AND (quality = 1 OR toxic = 1) THEN 1.0 ELSE 0 END) AS meaning FROM (SELECT unnest(range(0, 300)) AS w) LEFT JOIN documents d ON d.doc_id = w LEFT JOIN labels USING (doc_id)) SELECT name, round(share, 9) AS share FROM r UNPIVOT (share FOR name IN (found, source, spanish, pos, chinese, \"englishGlosses\", \"catalanDefinitions\", meaning))")
def _(spark, sf):
    wanted = spark.range(300).select(F.col("id").cast("string").alias("n"))
    return G.coverage(covered(spark, sf), wanted).select("name", F.round("share", 9).alias("share"))


@query("source_attribution", "SELECT round(avg(CASE WHEN source = 'src3' THEN 0.0 ELSE 1.0 END), 9) AS share, avg(CASE WHEN source = 'src3' THEN 0.0 ELSE 1.0 END) >= 0.99 AS ok FROM documents")
def _(spark, sf):
    return G.attributed(covered(spark, sf)).select(F.round("share", 9).alias("share"), "ok")


@query("unknown_source_gate", "SELECT CAST(doc_id AS VARCHAR) AS n, source FROM documents WHERE source IN ('src1', 'src2')")
def _(spark, sf):
    known = table(spark, sf, "documents").select("source").distinct().where("source not in ('src1', 'src2')")
    return G.unknown_sources(covered(spark, sf), known)


@query("dangling_targets", f"SELECT gate, key, target FROM (SELECT 'morphology' AS gate, surface AS key, lemma AS target FROM {MORPH} UNION ALL SELECT 'prefix', strip_accents(token), token FROM {COUNTS} UNION ALL SELECT 'core', token, token FROM {RANKED} WHERE rank <= 5000) WHERE ends_with(target, 'e') UNION ALL SELECT 'prefix-key', strip_accents(token), token FROM {COUNTS} WHERE false")
def _(spark, sf):
    lex = lexicon(spark, sf)
    prefixes = lex.select(T.fold(F.col("n")).alias("key"), F.col("n").alias("lemma"))
    return G.dangling(lex.where(~F.col("n").endswith("e")), morphology(lex), prefixes, lex.where("r <= 5000"))


@query("shard_bounds", "SELECT shard FROM (SELECT o_orderkey // 1000 AS shard, min(o_orderkey) AS first FROM orders GROUP BY 1) WHERE shard % 2 = 0")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("shard", F.expr("o_orderkey div 1000"))
    d = S.descriptors(o, "shard", "o_orderkey").withColumn("last", F.when(F.col("shard") % 2 == 0, F.col("last") + 1).otherwise(F.col("last")))
    return G.out_of_bounds(o, d, "shard", "o_orderkey")


@query("shard_order", "SELECT o_orderkey FROM (SELECT *, lag(o_custkey) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS before FROM orders) WHERE before >= o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderkey div 1000").alias("shard"))
    return G.unsorted(o, "shard", "o_orderkey", "o_custkey").select("o_orderkey")


#: The seeded generator and the whole shuffle in SQL, over the rows numbered from 0.
def shuffle_sql(rows: str, key: str, seed: str) -> str:
    hashed = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('{seed}', ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: CAST(CAST(xor(h, c) AS HUGEINT) * 16777619 % 4294967296 AS BIGINT))"
    times = lambda a, b: f"CAST(CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT) % 4294967296 AS BIGINT)"
    return f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT list({key} ORDER BY {key}) AS v FROM {rows}),
seed AS (SELECT {hashed} AS s),
t AS (SELECT i, (s + CAST(i AS HUGEINT) * 1831565813) % 4294967296 AS a FROM seed, (SELECT unnest(range(1, len(v))) AS i FROM k)),
u AS (SELECT i, {times("xor(CAST(a AS BIGINT), CAST(a AS BIGINT) >> 15)", "CAST(a AS BIGINT) | 1")} AS a FROM t),
w AS (SELECT i, xor(a, (a + {times("xor(a, a >> 7)", "a | 61")}) % 4294967296) AS a FROM u),
x AS MATERIALIZED (SELECT i, xor(a, a >> 14) / 4294967296.0::DOUBLE AS a FROM w),
f AS (
  SELECT 0 AS i, range(0, len(v)) AS p, len(v) - 1 AS top FROM k
  UNION ALL
  SELECT f.i + 1, list_transform(p, lambda y, n: CASE n - 1 WHEN top THEN p[CAST(floor(x.a * (top + 1)) AS BIGINT) + 1] WHEN CAST(floor(x.a * (top + 1)) AS BIGINT) THEN p[top + 1] ELSE y END), top - 1
  FROM f JOIN x ON x.i = f.i + 1
)
SELECT unnest(p[1:100]) AS place, unnest(range(0, 100)) AS pick FROM f WHERE top = 0"""


@query("round_trip", f"SELECT CAST(100 AS BIGINT) AS tested, count(*) FILTER (WHERE CAST(key AS INTEGER) % 3 <> 0) AS found FROM ({shuffle_sql('customer', 'CAST(c_custkey AS VARCHAR)', 'seed:lemmas')}) JOIN (SELECT CAST(c_custkey AS VARCHAR) AS key, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS place FROM customer) USING (place)")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("n"))
    return G.round_trip(c, c.where("n % 3 <> 0"))


@query("seeded_sample", f"SELECT c_custkey, CAST(pick AS INTEGER) AS pick FROM ({shuffle_sql('customer', 'c_custkey', 'seed')}) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) USING (place)")
def _(spark, sf):
    return M.sample(table(spark, sf, "customer").select("c_custkey"), 100, "seed", F.col("c_custkey")).select("c_custkey", F.col("_pick").alias("pick"))


@query("packet_fold", """
WITH RECURSIVE j AS MATERIALIZED (SELECT lang, CAST(doc_id AS VARCHAR) AS id, length(text) + 40 AS size, row_number() OVER (ORDER BY lang, CAST(doc_id AS VARCHAR)) AS i FROM documents),
f AS (
  SELECT i, lang, id, 1 AS n, size, CAST(0 AS BIGINT) AS packet FROM j WHERE i = 1
  UNION ALL
  SELECT j.i, j.lang, j.id, CASE WHEN j.lang <> f.lang OR f.n >= 40 OR f.size + j.size > 2600 THEN 1 ELSE f.n + 1 END,
    CASE WHEN j.lang <> f.lang OR f.n >= 40 OR f.size + j.size > 2600 THEN j.size ELSE f.size + j.size END,
    f.packet + CASE WHEN j.lang <> f.lang OR f.n >= 40 OR f.size + j.size > 2600 THEN 1 ELSE 0 END
  FROM f JOIN j ON j.i = f.i + 1
) SELECT id, packet FROM f""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("jobId"), F.col("lang").alias("sourceLanguage"), F.col("text").alias("sourceText"))
    return V.packets(d).select(F.col("jobId").alias("id"), "packet")


@query("acceptance_run", f"""
WITH e AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS n, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
m AS MATERIALIZED (SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS surface, CAST(l_partkey AS VARCHAR) AS lemma FROM lineitem),
p AS MATERIALIZED (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS key, CAST(p_partkey AS VARCHAR) AS lemma FROM part),
c AS MATERIALIZED (SELECT CAST(c_custkey AS VARCHAR) AS n FROM customer),
v AS (SELECT unnest(['lemmas', 'attributed', 'share source', 'share spanish', 'share meaning', 'wrong prefix keys', 'dangling analyses', 'dangling prefixes', 'dangling core', 'unknown sources', 'repeated lemmas', 'forms found again']) AS gate,
 unnest([(SELECT count(*) FROM e), (SELECT avg(CASE WHEN source = 'src3' THEN 0.0 ELSE 1.0 END) FROM e), (SELECT avg(CASE WHEN source = 'src3' THEN 0.0 ELSE 1.0 END) FROM e), (SELECT avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) FROM e),
  (SELECT avg(CASE WHEN quality = 1 OR toxic = 1 THEN 1.0 ELSE 0.0 END) FROM e), (SELECT count(*) FROM p WHERE key <> lemma), (SELECT count(*) FROM m WHERE lemma NOT IN (SELECT n FROM e)), (SELECT count(*) FROM p WHERE lemma NOT IN (SELECT n FROM e)), (SELECT count(*) FROM c WHERE n NOT IN (SELECT n FROM e)),
  (SELECT count(*) FROM e WHERE source IN ('src1', 'src2')), 0, 100]) AS value)
SELECT gate, round(CAST(value AS DOUBLE), 9) AS value, CASE gate WHEN 'lemmas' THEN value >= 1000 WHEN 'attributed' THEN value >= 0.99 WHEN 'share source' THEN true WHEN 'share spanish' THEN true WHEN 'share meaning' THEN true WHEN 'forms found again' THEN true ELSE value = 0 END AS ok FROM v""")
def _(spark, sf):
    known = table(spark, sf, "documents").select("source").distinct().where("source not in ('src1', 'src2', 'src3')").unionByName(spark.createDataFrame([("src3",)], "source string"))
    text = lambda c: F.col(c).cast("string")
    m = table(spark, sf, "lineitem").select(F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("surface"), text("l_partkey").alias("lemma"))
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 50 == 0, "x").otherwise(text("p_partkey")).alias("key"), text("p_partkey").alias("lemma"))
    out = A.run(covered(spark, sf), m, p, table(spark, sf, "customer").select(text("c_custkey").alias("n")), known, lemmas=1000)
    wanted = ("lemmas", "attributed", "share source", "share spanish", "share meaning", "wrong prefix keys", "dangling analyses", "dangling prefixes", "dangling core", "unknown sources", "repeated lemmas", "forms found again")
    return out.where(F.col("gate").isin(*wanted)).select("gate", F.round("value", 9).alias("value"), "ok")


@query("label_selects_lemma", f"""
WITH t AS MATERIALIZED {TERMS}, first AS (SELECT lower(term) AS key, arg_min(lemma, (-coalesce(priority, 0), rank, lemma, term, kind)) AS first FROM t GROUP BY 1)
SELECT lemma AS id, term AS label, lemma, first FROM t JOIN first ON key = lower(term) WHERE first <> lemma""")
def _(spark, sf):
    t = terms(spark, sf)
    return R.misleading_labels(t.select(F.col("lemma").alias("id"), F.col("term").alias("label"), "lemma"), R.build_index(t, "es"))


@query("duplicate_key_gate", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))  # 256 bits move, not texts
    return L.upsert(d, "key", F.col("doc_id"), F.col("doc_id")).where("n > 1").select(F.col("value").alias("first_id"), "n")


@query("ambiguous_surface", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def _(spark, sf):
    return G.duplicates(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey")


@query("near_repetition", r"SELECT doc_id, CAST(coalesce(max(n), 0) AS INTEGER) AS most FROM documents LEFT JOIN (SELECT doc_id, p, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[，,、;；\s\x0b\x{85}\p{Z}]+')) AS p FROM documents) WHERE p <> '' GROUP BY ALL) USING (doc_id) GROUP BY doc_id")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(T.most_repeated(T.phrases(F.col("text"))), F.lit(0)).alias("most"))


# --- sets, overlays and state

@query("set_intersect_corroborate", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return L.both(table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("set_except_missing", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_orderkey % 16 = 0")
def _(spark, sf):
    return L.missing(table(spark, sf, "part").select("p_partkey"), "p_partkey", table(spark, sf, "lineitem").where("l_orderkey % 16 = 0"), "l_partkey").distinct()


@query("corroboration_semi", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def _(spark, sf):
    return L.present(table(spark, sf, "documents").select("doc_id"), "doc_id", table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("held_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    return L.missing(table(spark, sf, "documents").select("doc_id"), "doc_id", table(spark, sf, "labels"), "doc_id")


@query("overlay_precedence", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'held' WHEN l.quality = 1 THEN 'reviewed' WHEN l.quality = 0 THEN 'machine' ELSE 'base' END AS layer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    mark = lambda rows, name: rows.select("doc_id", F.lit(name).alias("value"))
    over = [mark(lab.where("toxic = 1"), "held"), mark(lab.where("quality = 1"), "reviewed"), mark(lab.where("quality = 0"), "machine")]
    return L.precedence(table(spark, sf, "documents").select("doc_id"), over, "doc_id", "layer").select("doc_id", F.coalesce("layer", F.lit("base")).alias("layer"))


@query("coverage_report", "SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("has")), "doc_id", "left")
    return L.presence(d, "lang", "docs", labelled=F.col("has"), good=F.col("quality") == 1)


@query("evidence_pick3", "SELECT source, doc_id, CAST(rn AS INTEGER) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang = 'es' THEN 1 ELSE 2 END, doc_id) AS rn FROM documents) x WHERE rn <= 3")
def _(spark, sf):
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "es", 1).otherwise(2)
    return L.capped(table(spark, sf, "documents").select("source", "doc_id", "lang"), "source", 3, lang, F.col("doc_id")).select("source", "doc_id", "rn")


EV = "(SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE {} GROUP BY user_id)"


@query("kv_put", f"SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_id, a.event_id) AS event_id FROM {EV.format('event_id % 2 = 0')} a FULL JOIN {EV.format('event_id % 2 = 1')} b ON a.user_id = b.user_id")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    stored = S.latest(e.where("event_id % 2 = 0"), "user_id", "ts", "event_id")
    return S.upserted(stored, e.where("event_id % 2 = 1"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("kv_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def _(spark, sf):
    return S.removed(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("version_eviction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return S.only_version(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F").select("o_orderkey")


@query("version_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    return S.by_version(table(spark, sf, "orders"), "o_orderstatus")


@query("install_progress", "SELECT count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)) AS done_files, CAST(sum(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30) THEN p_size ELSE 0 END) AS BIGINT) AS done_bytes, bool_and(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)) AS complete FROM part")
def _(spark, sf):
    stored = table(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return S.progress(table(spark, sf, "part").select("p_partkey", "p_size"), stored, "p_partkey", "p_size")


@query("cache_probe", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, sf):
    asked = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.cached(asked, table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", "O").select("o_orderkey")


@query("saved_refresh", "SELECT d.doc_id, CASE WHEN d.doc_id % 3 <> 0 AND l.doc_id IS NOT NULL AND NOT (l.toxic = 1) THEN 'v2' ELSE CASE WHEN d.doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END END AS version, d.doc_id % 3 <> 0 AND l.doc_id IS NOT NULL AND NOT (l.toxic = 1) AS fresh FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    saved = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1").alias("version"), F.lit("old").alias("meaning"))
    new = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "").otherwise("new").alias("meaning"))
    return S.refreshed(saved, new, "doc_id", {"version": "v2"}, "meaning").select("doc_id", "version", "fresh")


@query("newest_answer", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    return S.newest_answer(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


#: Letters of more than one byte, for callers that compare bytes.
MULTIBYTE = LATIN
