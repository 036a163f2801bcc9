"""Registered queries of operators over the given tables: order of units, tokens, languages, overlays, gates, sets, state, meanings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import han as H
from ..functions import text as T
from ..operators import entries as E
from ..operators import evidence as V
from ..operators import gates as G
from ..operators import lexicon as L
from ..operators import lookup as U
from ..operators import search as R
from ..operators import state as S
from ..operators.index import deletions
from ..operators.ranges import numbered
from ..sources import readers as D
from .derived import HAN_KEY, SCRIPT, han_key, script_sql, text_column
from .dictionary import KIND, covered, lexicon
from .files import W, parts, text_of, written
from .queries import RANKED, query, table


@query("utf16_order", "SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, p_name, p_partkey) AS place FROM part")
def _(spark, sf):
    mark = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "😀").otherwise("￥")  # by code points the last two change places
    p = table(spark, sf, "part").select("p_partkey", F.concat(mark, "p_name").alias("t"))
    return numbered(p, "place", T.utf16_key(F.col("t")), F.col("p_partkey")).select("p_partkey", "place")


@query("word_tokens", r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' l''' || p_brand || '-' || p_name || ' ''x'' '), '\p{L}+(?:[''’·-]\p{L}+)*')) AS token FROM part) GROUP BY token")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_name", F.lit(" l'"), "p_brand", F.lit("-"), "p_name", F.lit(" 'x' ")).alias("text"))
    return L.tokens(p, "text", T.WORD).groupBy("token").agg(F.count("*").alias("n"))


@query("query_language", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'zh' ELSE 'es' END AS language FROM part")
def _(spark, sf):
    q = F.when(F.col("p_partkey") % 2 == 0, text_column("{w} {h}")).otherwise(text_column("{w} {n}"))
    return table(spark, sf, "part").select("p_partkey", T.search_language(q).alias("language"))


@query("json_lines_source", "SELECT p_partkey AS k, p_name AS name FROM part")
def _(spark, sf):
    return D.json_lines(spark, written(parts(spark, sf), text_of('{"k":', F.col("p_partkey").cast("string"), ',"name":"', F.col("p_name"), '"}')), "k long, name string")


@query("tab_separated_source", "SELECT p_partkey AS k, p_name AS name FROM part")
def _(spark, sf):
    return D.tab_separated(spark, written(parts(spark, sf), text_of("# ", F.col("p_name"), "\n", F.col("p_partkey").cast("string"), "\t", F.col("p_name"))), "k long, name string")


@query("route_forms", "SELECT p_partkey, p_size % 3 = 0 AS form FROM part")
def _(spark, sf):
    of = F.array(F.struct(F.array(F.struct(F.col("p_name").alias("word"))).alias("form_of"), F.array(F.lit("x")).alias("tags")))
    plain = F.array(F.struct(F.expr("cast(array() as array<struct<word:string>>)").alias("form_of"), F.array(F.lit("x")).alias("tags")))
    forms, words = D.route_forms(table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, of).otherwise(plain).alias("senses")))
    return forms.select("p_partkey", F.lit(True).alias("form")).unionByName(words.select("p_partkey", F.lit(False).alias("form")))


@query("flag_counts", r"""
WITH f AS (SELECT list_filter([CASE WHEN length(p_name) < 9 THEN 'short-ambiguous-source' END, CASE WHEN p_size % 3 = 0 THEN 'url' END, CASE WHEN p_size % 5 = 0 THEN 'markup' END], lambda x: x IS NOT NULL) AS f FROM part)
SELECT flag, count(*) AS n FROM (SELECT unnest(f) AS flag FROM f) GROUP BY flag UNION ALL SELECT 'needs-review', count(*) FROM f WHERE len(list_filter(f, lambda x: x <> 'short-ambiguous-source')) > 0""")
def _(spark, sf):
    flags = T.flags((F.length("p_name") < 9, "short-ambiguous-source"), (F.col("p_size") % 3 == 0, "url"), (F.col("p_size") % 5 == 0, "markup"))
    return G.flag_histogram(table(spark, sf, "part").select(flags.alias("flags")))


@query("lemma_minimum", "SELECT count(*) AS n FROM documents")
def _(spark, sf):
    return G.at_least(table(spark, sf, "documents"), 100)


@query("file_checksums", "SELECT p_partkey AS path, CASE p_partkey % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'checksum' END AS problem FROM part WHERE p_partkey % 4 <> 0")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.encode("p_name", "UTF-8").alias("content"))
    wanted = p.select("path", (F.length("content") + F.when(F.col("path") % 4 == 2, 1).otherwise(0)).cast("long").alias("bytes"), F.when(F.col("path") % 4 == 3, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return G.checksums(p.where("path % 4 <> 1"), wanted)


@query("machine_job_gate", "SELECT p_partkey AS number, CASE p_partkey % 5 WHEN 1 THEN 'missing or empty evidenceId' WHEN 2 THEN 'unsupported source language' WHEN 3 THEN 'sourceIds must contain source identifiers' WHEN 4 THEN 'sourceHash does not match exact sourceText' END AS problem FROM part WHERE p_partkey % 5 <> 0")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("number"), F.col("p_name").alias("normalizedLemma"), F.when(k == 1, " ").otherwise("e001").alias("evidenceId"), F.col("p_name").alias("sourceText"), F.when(k == 2, "de").otherwise("en").alias("sourceLanguage"),
        F.when(k == 3, F.array(F.lit(""))).otherwise(F.array(F.lit("s"))).alias("sourceIds"), F.when(k == 4, "0").otherwise(F.sha2("p_name", 256)).alias("sourceHash"),
    )
    return G.invalid_jobs(rows)


@query("reviewed_overlay", "SELECT CAST(p_size AS VARCHAR) AS n, count(DISTINCT p_name) AS meanings FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part")
    e = p.select(F.col("p_size").cast("string").alias("n"), F.when(F.col("p_size") % 2 == 1, F.array(F.lit("字"))).alias("zh")).distinct().withColumn("d", F.lit(None).cast("struct<zh:array<string>>"))
    b = p.select(F.col("p_size").cast("string").alias("n"), F.lit("b").alias("batch"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("translation"), F.array("p_name").alias("aliases"), F.array(F.lit("s")).alias("sources"))
    return V.reviewed_overlays(b, e).select("n", F.size("zh").cast("long").alias("meanings"))


MACHINE = f"(SELECT CAST(p_size AS VARCHAR) AS n, p_partkey, {HAN_KEY} AS t FROM part)"


@query("machine_overlay", f"SELECT n, string_agg(t, '|' ORDER BY p_partkey) AS zh FROM {MACHINE} WHERE CAST(n AS INTEGER) % 2 = 0 AND CAST(n AS INTEGER) % 3 <> 0 GROUP BY n")
def _(spark, sf):
    return machine(spark, sf)[0].select("n", F.array_join("zh", "|").alias("zh"))


@query("machine_counters", f"""SELECT count(*) AS "inputSenses", count(*) FILTER (WHERE done) AS "preservedExistingChineseSenses", count(*) FILTER (WHERE NOT done) AS "importedSenses", count(DISTINCT n) FILTER (WHERE NOT done) AS "importedLemmas" FROM (SELECT *, CAST(n AS INTEGER) % 2 = 1 OR CAST(n AS INTEGER) % 3 = 0 AS done FROM {MACHINE})""")
def _(spark, sf):
    return machine(spark, sf)[1]


def machine(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size").cast("string").alias("n")
    e = p.select(n, F.when(F.col("p_size") % 2 == 1, F.array(F.lit("字"))).alias("zh")).distinct().withColumn("d", F.lit(None).cast("struct<zh:array<string>>"))
    rows = p.select(n, F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("text"), han_key().alias("translation"), F.array(F.lit("s")).alias("sources"))
    return V.machine_overlays(rows, e, p.where("p_size % 3 = 0").select(n))


@query("evidence_kinds", "SELECT kind, language, count(DISTINCT lemma) AS lemmas FROM (SELECT o_custkey AS lemma, arg_min(o_orderpriority, o_orderkey) AS kind, arg_min(o_orderstatus, o_orderkey) AS language FROM orders GROUP BY 1) GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return V.kinds(o.select(F.col("o_custkey").alias("normalizedLemma"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("sourceLanguage"), F.col("o_orderkey").alias("jobId")))


@query("core_union", "SELECT p_partkey AS n FROM part WHERE p_size < 9 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    a = table(spark, sf, "part").where("p_size < 9").select(F.col("p_partkey").alias("n"))
    return a.unionByName(table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("n"))).distinct()


@query("reference_subset", "SELECT o_orderkey, CASE WHEN bool_or(l_linenumber > 4) THEN 'refs: is not evidence in this input record' ELSE '' END AS errors FROM (SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def _(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("r"))
    return r.select("o_orderkey", F.array_join(G.refs(F.col("r"), F.array(*(F.lit(str(i)) for i in range(5))), "refs", True), ";").alias("errors"))


@query("history_clear", "SELECT event_id FROM events WHERE false")
def _(spark, sf):
    return S.cleared(table(spark, sf, "events").select("event_id"))


@query("metadata_get", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    return S.value_of(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("verb_entries", f"SELECT token AS n, list_contains({KIND.format('token')}, 'verb') AS verb FROM {RANKED}")
def _(spark, sf):
    return lexicon(spark, sf).select("n", E.is_verb(F.col("p")).alias("verb"))


@query("catalan_completions", f"""
WITH w AS MATERIALIZED (SELECT token, strip_accents(token) AS folded, rank FROM {RANKED}), q AS MATERIALIZED (SELECT DISTINCT substr(folded, 1, 2) AS q FROM w WHERE length(folded) >= 2),
m AS (SELECT q, token, rank, row_number() OVER (PARTITION BY q ORDER BY rank) AS pos, folded = q AND token <> q AS accent FROM q JOIN w ON starts_with(folded, q) QUALIFY pos <= 3),
f AS (SELECT *, min(CASE WHEN accent THEN pos END) OVER (PARTITION BY q) AS first FROM m)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN pos = first THEN 0 ELSE pos END) AS INTEGER) AS pos, token AS term, CASE WHEN starts_with(token, q) THEN 'prefix' ELSE 'fuzzy' END AS kind FROM f""")
def _(spark, sf):
    lex = lexicon(spark, sf)
    q = lex.select(F.substring(T.fold(F.col("n")), 1, 2).alias("q")).where("length(q) >= 2").distinct()
    return U.completions(q, lex, lex.where("r <= 5000")).select("q", "pos", "term", "kind")


@query("script_index", f"SELECT DISTINCT key, lemma FROM (SELECT {HAN_KEY} AS key, CAST(p_partkey AS VARCHAR) AS lemma FROM part UNION ALL SELECT {script_sql(HAN_KEY)}, CAST(p_partkey AS VARCHAR) FROM part)")
def _(spark, sf):
    p = table(spark, sf, "part")
    t = p.select(F.col("p_partkey").cast("string").alias("lemma"), han_key().alias("term"), F.lit("translation").alias("kind"), F.lit(None).cast("int").alias("priority"), F.col("p_partkey").cast("long").alias("rank"))
    return R.build_index(t, "zh", H.converter(SCRIPT)).select("key", "lemma").distinct()


@query("semantic_lookup", f"SELECT h AS q, CAST(row_number() OVER (PARTITION BY h ORDER BY rank, lemma) AS INTEGER) AS pos, lemma FROM (SELECT translate(CAST(p_size AS VARCHAR), '0123456789', '天地人日月山水火木金') AS h, {W} AS lemma, p_partkey AS rank FROM part) QUALIFY pos <= 32")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.translate(F.col("p_size").cast("string"), "0123456789", "天地人日月山水火木金").alias("key"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abdefgijko").alias("lemma"), F.col("p_partkey").cast("long").alias("rank"))
    rows = p.select("key", F.col("key").alias("expression"), "lemma", F.col("key").alias("label"), "rank", F.lit("c").alias("concept"), F.lit(None).cast("string").alias("pos_class"))
    return R.expressions(p.select(F.concat(F.lit("「"), "key", F.lit("」")).alias("q")).distinct(), rows).select(F.regexp_replace("q", "[「」]", "").alias("q"), "pos", "lemma")


@query("attribution_share", "SELECT name, round(share, 9) AS share FROM (SELECT 'source' AS name, avg(CASE WHEN source <> 'src3' THEN 1.0 ELSE 0 END) AS share FROM documents) WHERE share < 1")
def _(spark, sf):
    return G.below(G.coverage(covered(spark, sf)), {"source": 1.0}).select("name", F.round("share", 9).alias("share"))


@query("shared_forms", "SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS a FROM part) JOIN (SELECT DISTINCT p_name AS b FROM part) ON a < b AND levenshtein(a, b) <= 2")
def _(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    form = lambda side: names.select(F.col("p_name").alias(side), F.explode(deletions(F.col("p_name"), 2)).alias("form"))
    met = form("a").join(form("b"), "form").where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", 2)).where("distance >= 0")
