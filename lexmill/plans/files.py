"""Registered queries of sources and of core tables: source files are written from the given tables, then read by the source's reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import offline as O
from ..operators import search as R
from ..operators.store import folder
from ..sources import lexical as X
from .dictionary import TERMS, terms
from .queries import query, table

LETTERS = "abdefgijko"
W = "translate(CAST(p_partkey AS VARCHAR), '0123456789', '" + LETTERS + "')"
V = "translate(CAST(p_size AS VARCHAR), '0123456789', '" + LETTERS + "')"


def word(column: str) -> Column:
    return F.translate(F.col(column).cast("string"), "0123456789", LETTERS)


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_name", word("p_partkey").alias("w"), word("p_size").alias("v"))


def written(lines: DataFrame, text: Column) -> str:
    """A folder of text files with a line a row."""
    path = folder(lines.sparkSession)
    lines.select(text.alias("value")).write.text(path)
    return path


def enclosed(lines: DataFrame, text: Column, before: str, behind: str) -> str:
    """A folder with one file: a line before, a line a row, a line behind."""
    spark, path = lines.sparkSession, folder(lines.sparkSession)
    ends = spark.createDataFrame([(0, before), (2, behind)], "_o int, value string")
    lines.select(F.lit(1).alias("_o"), text.alias("value")).unionByName(ends).coalesce(1).sortWithinPartitions("_o").select("value").write.text(path)
    return path


def text_of(*pieces) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


w, v, name = (lambda: F.col("w")), (lambda: F.col("v")), (lambda: F.col("p_name"))


@query("tei_source", f"SELECT 'q' || {W} AS lemma, field, value FROM (SELECT p_partkey, unnest(['p', 's', 'd_ca', 'es', 'g']) AS field, unnest(['noun', 'freedict', p_name, 'e' || {V}, 'masculine']) AS value FROM part) JOIN part USING (p_partkey) WHERE p_partkey % 3 <> 0")
def _(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "zzz").otherwise("n")
    path = enclosed(parts(spark, sf), text_of("<entry><form><orth>q", w(), "</orth></form><gramGrp><pos>", kind, "</pos><gen>m</gen></gramGrp><sense><def>", name(), '</def><cit type="trans"><quote>e', v(), "</quote></cit></sense></entry>"), "<TEI>", "</TEI>")
    return X.tei(spark, path).select("lemma", "field", "value")


@query("kaikki_source", f"SELECT 'q' || {W} AS lemma, 'd_en' AS field, p_name AS value FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'q' || {W}, 'f', 'q' || {W} || 's' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'q' || {W}, 'p', 'noun' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'q' || {W}, 's', 'kaikki' FROM part WHERE p_size % 2 = 0")
def _(spark, sf):
    sense = F.when(F.col("p_size") % 2 == 0, text_of('{"glosses":["', name(), '"]}')).otherwise(text_of('{"tags":["form-of"],"form_of":[{"word":"x', w(), '"}]}'))
    path = written(parts(spark, sf), text_of('{"lang_code":"ca","word":"q', w(), '","pos":"noun","senses":[', sense, '],"forms":[{"form":"q', w(), 's","tags":["singular"]}]}'))
    return X.kaikki(spark, path)[0].select("lemma", "field", "value")


@query("kaikki_forms", f"SELECT 'q' || {W} AS surface, 'x' || {W} AS lemma, 'plural' AS label FROM part WHERE p_size % 2 = 1 UNION ALL SELECT 'q' || {W} || 's', 'q' || {W}, 'singular' FROM part WHERE p_size % 2 = 0")
def _(spark, sf):
    sense = F.when(F.col("p_size") % 2 == 0, text_of('{"glosses":["', name(), '"]}')).otherwise(text_of('{"tags":["form-of","plural"],"form_of":[{"word":"x', w(), '"}]}'))
    path = written(parts(spark, sf), text_of('{"lang_code":"ca","word":"q', w(), '","pos":"noun","senses":[', sense, '],"forms":[{"form":"q', w(), 's","tags":["singular"]}]}'))
    return X.kaikki(spark, path)[1].select("surface", "lemma", "label")


@query("curated_source", f"SELECT 'q' || {W} AS lemma, unnest(['p', 's', 'es', 'd_ca']) AS field, unnest(['noun', 'curated', 'e' || {V}, p_name]) AS value FROM part WHERE p_partkey % 5 <> 0")
def _(spark, sf):
    kind = F.when(F.col("p_partkey") % 5 == 0, "zzz").otherwise("noun")
    path = enclosed(parts(spark, sf), text_of(',{"lemma":"q', w(), '","partOfSpeech":["', kind, '"],"spanish":["e', v(), '"],"definitions":{"ca":["', name(), '"]}}'), '[{"lemma":"none"}', "]")
    return X.curated(spark, path).select("lemma", "field", "value")


@query("wiki_source", f"SELECT 'q' || {W} AS lemma, 'd_ca' AS field, 'Un ' || p_name AS value FROM part UNION ALL SELECT 'q' || {W}, 'es', 'e' || {V} FROM part UNION ALL SELECT 'q' || {W}, 'p', 'noun' FROM part UNION ALL SELECT 'q' || {W}, 's', 'wiki' FROM part")
def _(spark, sf):
    page = text_of("<page><title>q", w(), "</title><revision><text>==Anglès==&#10;# no&#10;== {{-ca-}} ==&#10;=== Nom ===&#10;# Un [[", name(), "]]&#10;{{trad|es|e", v(), "}}&#10;==Francès==&#10;# no</text></revision></page>")
    other = text_of("<page><title>Ajuda:q", w(), "</title><revision><text>== Català ==&#10;=== Nom ===&#10;# no</text></revision></page>")
    path = enclosed(parts(spark, sf), F.concat(page, F.lit("\n"), other), "<mediawiki>", "</mediawiki>")
    return X.wiki(X.pages(spark, path))[0].select("lemma", "field", "value")


@query("metadix_source", f"SELECT DISTINCT 'q' || {W} || {V} || 's' AS surface, 'q' || {W} AS lemma, 'plural' AS label, 'noun' AS pos FROM part")
def _(spark, sf):
    p = parts(spark, sf)
    defs = p.select("v").distinct().select(text_of('<dictionary><pardefs><pardef n="p', v(), '__n"><e><p><l>', v(), 's</l><r><s n="n"/><s n="pl"/></r></p></e><e r="RL"><p><l>z</l><r/></p></e></pardef></pardefs></dictionary>').alias("t"))
    words = p.select(text_of('<section id="main"><e lm="q', w(), '"><i>q', w(), '</i><par n="p', v(), '__n"/></e></section>').alias("t"))
    return X.metadix(spark, written(defs.unionByName(words), F.col("t")))[1].select("surface", "lemma", "label", "pos")


@query("bilingual_source", f"SELECT DISTINCT 'q' || {W} AS n, 'e' || {V} AS es FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0")
def _(spark, sf):
    p = parts(spark, sf)
    way = F.when(F.col("p_partkey") % 4 == 0, ' r="LR"').otherwise("")
    path = written(p, text_of('<section id="main"><e', way, "><p><l>e", v(), '<s n="n"/></l><r>q', w(), '<s n="n"/></r></p></e></section>'))
    return X.bilingual(spark, path, p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("q"), "w").alias("n")))


@query("wordnet_source", f"SELECT DISTINCT printf('%08d-n', p_partkey) AS synset, 'cat' AS lang, 'q' || {W} AS term FROM part")
def _(spark, sf):
    key = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return X.wordnet(spark, written(parts(spark, sf), F.concat(F.lit("# c\n"), key, F.lit("-n\tcat:lemma\tq"), w(), F.lit("\n"), key, F.lit("-n\tcat:def\t0\t"), name())), "cat")


@query("conversion_source", f"SELECT 'q' || {W} AS key, 'e' || {V} AS value FROM part")
def _(spark, sf):
    return X.conversion_table(spark, written(parts(spark, sf), text_of("q", w(), "\te", v(), " x", w())))


@query("seed_source", f"SELECT 'q' || {W} AS n, p_name AS l, 'a|b' || {V} AS zh, p_name || '|e' || {V} AS es FROM part")
def _(spark, sf):
    path = written(parts(spark, sf), text_of('{"key":"q', w(), '","lemma":"', name(), '","partOfSpeech":"noun","zh":"a； b', v(), '","es":"', name(), " / e", v(), '","examples":[]}'))
    return X.seeds(spark, path).select("n", "l", F.array_join("zh", "|").alias("zh"), F.array_join("es", "|").alias("es"))


@query("reviewed_forms", f"SELECT 'q' || {V} AS surface, 'q' || {W} AS lemma, p_name AS label, 'verb' AS pos, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INTEGER) AS ord, round((p_partkey % 100) / 100.0, 2)::DOUBLE AS confidence FROM part")
def _(spark, sf):
    p = parts(spark, sf).coalesce(1).sortWithinPartitions("p_partkey")
    sure = F.format_string("0.%02d", F.col("p_partkey") % 100)
    return X.reviewed_forms(spark, written(p, F.concat(F.lit("q"), v(), F.lit("\tq"), w(), F.lit("\tverb\t"), name(), F.lit("\t"), sure)))


# --- the core, candidates, fallbacks


@query("core_postings", f"SELECT lower(term) AS key, lemma, term FROM {TERMS} WHERE rank % 3 = 0")
def _(spark, sf):
    t = terms(spark, sf)
    return O.core_only(R.build_index(t, "es"), t.where("rank % 3 = 0").select(F.col("lemma").alias("n"))).select("key", "lemma", "term")


@query("core_probe", "SELECT DISTINCT o_custkey AS q, CASE WHEN c_nationkey < 10 THEN c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    core = table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("name"))
    return O.probe(table(spark, sf, "orders").select(F.col("o_custkey").alias("q")), core).select("q", "name")


@query("core_enrichment", "SELECT doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN source WHEN quality = 1 THEN 'core' END AS zh FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    e = table(spark, sf, "documents").select(F.col("doc_id").alias("n"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("zh"))
    core = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("n"), F.array(F.lit("core")).alias("zh"))
    return O.enriched(e, core, "zh").select("n", F.get("zh", 0).alias("zh"))


RESULTS = "(SELECT DISTINCT l_orderkey AS q, l_linenumber * 1000000 + l_partkey AS pos, l_partkey AS n FROM lineitem)"
CHOSEN = f"(SELECT q, pos, n, row_number() OVER (PARTITION BY q ORDER BY n % 7 <> 0, pos) = 1 AS selected FROM {RESULTS})"


def chosen(spark, sf) -> DataFrame:
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("n")).distinct()
    every = table(spark, sf, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("n"))
    own = r.join(every, "n").select("q", "n")
    return O.selected_candidate(r, own.unionByName(own.select("q", (-F.col("n") - 1).alias("n"))))


@query("candidate_selection", f"SELECT q, pos, n, selected FROM {CHOSEN}")
def _(spark, sf):
    return chosen(spark, sf)


@query("candidate_alternatives", f"SELECT a.q, CAST(row_number() OVER (PARTITION BY a.q ORDER BY a.pos) AS INTEGER) AS pos, a.n FROM {CHOSEN} a WHERE a.n NOT IN (SELECT n FROM {CHOSEN} b WHERE b.q = a.q AND b.selected)")
def _(spark, sf):
    return O.alternatives(chosen(spark, sf))


@query("gloss_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND (coalesce(toxic, 0) = 1 OR coalesce(quality, 0) <> 1) THEN source END AS gloss FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    none = F.lit(None).cast("array<string>")
    gloss = O.shown_gloss(F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(none), F.array("source"), F.col("toxic") == 1, none, F.when(F.col("quality") == 1, F.array("lang")).otherwise(none))
    return d.select("doc_id", F.get(gloss, 0).alias("gloss"))


@query("offline_limited", "SELECT count(*) > 0 AS limited, count(*) AS missing FROM (SELECT o_orderkey // 100 AS s, sum(o_totalprice) FROM orders GROUP BY 1) WHERE s % 5 = 0 OR s % 7 = 0")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 100").alias("s")).agg(F.count("*").alias("n"))
    wanted = o.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("path"), F.md5(F.col("s").cast("string")).alias("sha256"), "s")
    here = wanted.where("s % 5 <> 0").select("path", F.when(F.col("s") % 7 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return O.short_of(wanted, here)


@query("unbound_aliases", "SELECT p_partkey AS lemma, p_name AS text FROM part WHERE p_size % 4 = 0")
def _(spark, sf):
    p = table(spark, sf, "part")
    values = p.select(F.col("p_partkey").alias("n"), F.lit("lex").alias("layer"), F.lit("zh").alias("field"), F.when(F.col("p_size") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("value"))
    aliases = p.select(F.col("p_partkey").alias("lemma"), F.lit("t").alias("term"), F.lit("lex").alias("layer"), F.lit("zh").alias("field"), F.col("p_name").alias("text"))
    return O.unbound_aliases(aliases, values).select("lemma", "text")


@query("value_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT p_size, p_brand FROM part)")
def _(spark, sf):
    key = O.value_key(F.struct("p_size", F.array("p_brand").alias("b")))
    return table(spark, sf, "part").select(key.alias("k")).distinct().agg(F.count("*").alias("n"))


@query("event_millis", "SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS same FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ms", O.millis(F.col("ts").cast("timestamp")))
    return e.select("event_id", "ms", (O.millis(O.from_millis(F.col("ms"))) == F.col("ms")).alias("same"))
