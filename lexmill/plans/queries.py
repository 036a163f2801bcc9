"""Registered queries over the driver's tables: name -> (DataFrame function, SQL of the same rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import lexicon as L
from ..operators import state as S

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: Literal words, for queries that are stated.
ASKED = ("the", "und", "de")
PREFIXES = ("th", "ein", "co")
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(spark: SparkSession, words, name: str = "q") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def sql_values(words, name: str = "q") -> str:
    return "(SELECT unnest([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"]) AS {name})"


def query(name: str, sql: str | None = None):
    def put(f):
        REGISTRY[name] = f, sql
        return f

    return put


TOKENS = r"(SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents)"
COUNTS = f"(SELECT token, count(*) AS n FROM {TOKENS} GROUP BY token)"
RANKED = f"(SELECT token, n, row_number() OVER (ORDER BY n DESC, length(token), token) AS rank FROM {COUNTS})"
#: Letters of more than one byte in the tables.
LATIN = "àáâäãåèéêëìíîïòóôöõùúûüçñýÿßœæ"


@query("token_frequency", f"SELECT token, n FROM {COUNTS}")
def _(spark, sf):
    return L.token_frequency(table(spark, sf, "documents"))


@query("headword_rank", f"SELECT token, n, row_number() OVER (ORDER BY n DESC, length(token), token) AS rank FROM {COUNTS}")
def _(spark, sf):
    return L.ranked(L.token_frequency(table(spark, sf, "documents"))).select("token", "n", "rank")


@query("core_headwords", f"SELECT token, rank FROM (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, length(token), token) AS INTEGER) AS rank FROM {COUNTS}) WHERE rank <= 5000")
def _(spark, sf):
    return L.ranked(L.token_frequency(table(spark, sf, "documents")), k=5000).select("token", "rank")


@query("inverted_index", f"SELECT token, doc_id, count(*) AS tf FROM {TOKENS} GROUP BY ALL")
def _(spark, sf):
    return I.postings(L.tokens(table(spark, sf, "documents"), "text", T.LETTERS, "doc_id"))


@query("reverse_lookup", f"SELECT token, doc_id, tf, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY tf DESC, doc_id) AS pos FROM (SELECT token, doc_id, count(*) AS tf FROM {TOKENS} WHERE token IN {ASKED} GROUP BY ALL)) WHERE pos <= 3")
def _(spark, sf):
    idx = I.postings(L.tokens(table(spark, sf, "documents"), "text", T.LETTERS, "doc_id"))
    return I.reverse_lookup(idx, values(spark, ASKED, "token")).select("token", "doc_id", "tf", "pos")


@query("accent_fold", f"SELECT DISTINCT token, strip_accents(token) AS key FROM {TOKENS}")
def _(spark, sf):
    return L.tokens(table(spark, sf, "documents")).distinct().select("token", T.fold(F.col("token")).alias("key"))


@query("spanish_key", f"SELECT DISTINCT token, replace(strip_accents(replace(token, 'ñ', '~')), '~', 'ñ') AS key FROM {TOKENS}")
def _(spark, sf):
    return L.tokens(table(spark, sf, "documents")).distinct().select("token", T.spanish_key(F.col("token")).alias("key"))


@query("valid_term_filter", r"SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 120 AND regexp_matches(p_name, '\p{L}') AND NOT regexp_matches(p_name, '\{\{|\}\}|\[\[|\]\]|<|>')")
def _(spark, sf):
    return table(spark, sf, "part").where(T.valid_term(F.col("p_name"))).select("p_partkey", "p_name")


@query("searchable_turns", r"SELECT conv_id, turn, regexp_matches(text, '[\p{L}\p{N}]') AS ok FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.searchable(F.col("text")).alias("ok"))


@query("prefix_index", f"SELECT key, string_agg(token, ',' ORDER BY rank, token) AS lemmas FROM (SELECT strip_accents(token) AS key, token, rank FROM (SELECT token, row_number() OVER (ORDER BY n DESC, length(token), token) AS rank FROM {COUNTS})) GROUP BY key")
def _(spark, sf):
    ranks = L.ranked(L.token_frequency(table(spark, sf, "documents")))
    return I.prefix_index(ranks, "token", "rank").select("key", F.array_join("lemmas", ",").alias("lemmas"))


@query("prefix_lookup", f"SELECT q, CAST(pos AS INTEGER) AS pos, token FROM (SELECT q, token, row_number() OVER (PARTITION BY q ORDER BY rank, token) AS pos FROM {sql_values(PREFIXES)} JOIN (SELECT token, row_number() OVER (ORDER BY n DESC, length(token), token) AS rank FROM {COUNTS}) ON starts_with(strip_accents(token), q)) WHERE pos <= 8")
def _(spark, sf):
    return I.prefix_lookup(values(spark, PREFIXES), L.ranked(L.token_frequency(table(spark, sf, "documents"))), "token", "rank", 8)


@query("suggest_exact_prefix_contains", f"SELECT q, CAST(pos AS INTEGER) AS pos, term, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, rank, length(term), term) AS pos FROM (SELECT q, term, rank, CASE WHEN term = q THEN 0 WHEN starts_with(term, q) THEN 1 ELSE 2 END AS score FROM {sql_values(PREFIXES)} JOIN (SELECT token AS term, row_number() OVER (ORDER BY n DESC, length(token), token) AS rank FROM {COUNTS}) ON contains(term, q))) WHERE pos <= 8")
def _(spark, sf):
    terms = L.ranked(L.token_frequency(table(spark, sf, "documents"))).select(F.col("token").alias("term"), "rank")
    return I.complete(values(spark, PREFIXES), terms, 8)


#: The SQL engine's distance counts bytes: in its SQL each accented letter is one byte.
ONE_BYTE = "translate({}, '" + LATIN + "', '" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[: len(LATIN)] + "')"
TYPOS = ("teh", "adn", "dei", "thr")


@query("fuzzy_osa_k1", f"SELECT q, term, CAST(damerau_levenshtein(q, {ONE_BYTE.format('term')}) AS INTEGER) AS distance FROM {sql_values(TYPOS)} JOIN (SELECT token AS term FROM {COUNTS}) ON damerau_levenshtein(q, {ONE_BYTE.format('term')}) <= 1")
def _(spark, sf):
    terms = L.token_frequency(table(spark, sf, "documents")).select(F.col("token").alias("term"))
    return I.fuzzy(values(spark, TYPOS), terms)


@query("fuzzy_levenshtein", "SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS a FROM part) JOIN (SELECT DISTINCT p_name AS b FROM part) ON a < b AND levenshtein(a, b) <= 3")
def _(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    # names within k edits share a form with up to k characters left out
    form = lambda side: names.select(F.col("p_name").alias(side), F.explode(I.deletions(F.col("p_name"), 3)).alias("form"))
    met = form("a").join(form("b"), "form").where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", 3)).where("distance >= 0")


@query("layer_merge", "SELECT lang, string_agg(source, ',' ORDER BY p, o) AS items, CAST(any_value(layers) AS BIGINT) AS layers FROM (SELECT lang, source, min(p) AS p, min(doc_id) AS o, any_value(layers) AS layers FROM (SELECT lang, source, doc_id, length(source) AS p, count(DISTINCT length(source)) OVER (PARTITION BY lang) AS layers FROM documents) GROUP BY lang, source) GROUP BY lang")
def _(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", F.length("source").alias("p"), "doc_id")
    return L.merge_layers(d, "lang", "source", "p", "doc_id").select("lang", F.array_join("items", ",").alias("items"), "layers")


@query("display_lemma_priority", "SELECT source AS key, arg_min(doc_id, (length(text), doc_id)) AS value, count(*) AS n FROM documents GROUP BY source")
def _(spark, sf):
    return L.upsert(table(spark, sf, "documents"), "source", F.col("doc_id"), F.length("text"), F.col("doc_id")).withColumnRenamed("source", "key")


@query("overlay_coalesce", "SELECT l.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, lang) AS mark FROM labels l LEFT JOIN documents USING (doc_id)")
def _(spark, sf):
    base = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("mark"))
    return L.overlay(base, table(spark, sf, "documents"), "doc_id", "mark", "lang")


@query("unique_attribution", "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def _(spark, sf):
    return L.unique_attribution(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("analysis_cap", "SELECT l_partkey, l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 16")
def _(spark, sf):
    out = L.capped(table(spark, sf, "lineitem"), "l_partkey", 16, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "rn")


@query("referential_integrity", "SELECT 'order' AS gate, count(*) AS bad FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'small part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    gates = (("order", "l_orderkey", "orders", "o_orderkey"), ("part", "l_partkey", "part", "p_partkey"), ("supplier", "l_suppkey", "supplier", "s_suppkey"), ("small part", "l_partkey", "part", "p_partkey"))
    out = None
    for gate, key, other, other_key in gates:
        target = table(spark, sf, other)
        n = L.missing(li.select(key), key, target.where("p_size < 25") if gate == "small part" else target, other_key).agg(F.count("*").alias("bad")).select(F.lit(gate).alias("gate"), "bad")
        out = n if out is None else out.unionByName(n)
    return out


SUFFIXES = (("a", "s", "plural"), ("a", "eta", "diminutive"), ("b", "s", "plural"))


@query("paradigm_expansion", "SELECT p_partkey, p_name AS lemma, p_name || suffix AS surface, label FROM part JOIN (VALUES ('a', 's', 'plural'), ('a', 'eta', 'diminutive'), ('b', 's', 'plural')) v(paradigm, suffix, label) ON (CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END) = paradigm")
def _(spark, sf):
    stems = table(spark, sf, "part").select(F.struct("p_partkey", "p_name").alias("lemma"), F.col("p_name").alias("stem"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("paradigm"))
    out = L.expand_paradigms(stems, spark.createDataFrame(list(SUFFIXES), "paradigm string, suffix string, label string"))
    return out.select("lemma.p_partkey", F.col("lemma.p_name").alias("lemma"), "surface", "label")


@query("line_state_machine", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def _(spark, sf):
    return L.state_lines(table(spark, sf, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "heading")


REPEATED_SQL = " OR ".join(f"len(list_filter(range(1, length(text) - {4 * w} + 2), lambda i: substr(text, i, {4 * w}) = repeat(substr(text, i, {w}), 4) AND NOT contains(substr(text, i, {w}), chr(10)))) > 0" for w in range(2, 9))


@query("quality_flag_list", rf"SELECT conv_id, turn, concat_ws(',', CASE WHEN length(text) < 50 THEN 'short' END, CASE WHEN {REPEATED_SQL} THEN 'repeated' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'url' END, CASE WHEN regexp_matches(text, '[{{}}<>\[\]]') THEN 'markup' END, CASE WHEN NOT regexp_matches(text, '\p{{L}}') THEN 'no_letters' END) AS flags FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.quality_flags(F.col("text")), ",").alias("flags"))


@query("content_identity", "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS id FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.identity("source", "lang", "doc_id").alias("id"))


@query("tiered_lookup", f"SELECT q, tier, token FROM (SELECT q, tier, token, min(tier) OVER (PARTITION BY q) AS first FROM (SELECT q, 0 AS tier, token FROM {sql_values(ASKED + TYPOS)} JOIN (SELECT token FROM {COUNTS}) ON q = token UNION ALL SELECT q, 1, token FROM {sql_values(ASKED + TYPOS)} JOIN (SELECT token FROM {COUNTS}) ON damerau_levenshtein(q, {ONE_BYTE.format('token')}) = 1)) WHERE tier = first")
def _(spark, sf):
    terms = L.token_frequency(table(spark, sf, "documents")).select(F.col("token").alias("term"))
    q = values(spark, ASKED + TYPOS)
    exact = q.join(terms, F.col("q") == F.col("term")).select("q", "term")
    fuzzy = I.fuzzy(q.join(exact, "q", "left_anti"), terms).where("distance = 1").select("q", "term")
    return I.tiered(exact, fuzzy).select("q", "tier", F.col("term").alias("token"))


@query("kv_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, sf):
    return S.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("history_top20", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, sf):
    return S.newest(table(spark, sf, "events"), 20, "ts", "event_id").select("event_id", "user_id")


@query("cas_refresh", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_nationkey % 2 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, c_acctbal < 0 AND c_nationkey % 2 = 0 AS swapped FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    changes = c.where("c_acctbal < 0").select("c_custkey", (F.col("c_nationkey") + F.col("c_nationkey") % 2).alias("c_nationkey"), F.lit("moved").alias("new"))
    out = S.compare_and_swap(c, changes.withColumnRenamed("new", "c_mktsegment"), "c_custkey", ["c_nationkey"], "c_mktsegment")
    return out.select("c_custkey", "c_mktsegment", "swapped")


@query("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.pending(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("shard_descriptors", "SELECT o_orderkey // 1000 AS shard, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS entries FROM orders GROUP BY 1")
def _(spark, sf):
    return S.descriptors(table(spark, sf, "orders").withColumn("shard", F.expr("o_orderkey div 1000")), "shard", "o_orderkey")


@query("range_order_gate", "SELECT count(*) AS bad FROM (SELECT first, lag(last) OVER (ORDER BY shard) AS before FROM (SELECT o_orderkey // 1000 AS shard, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1)) WHERE before >= first")
def _(spark, sf):
    shards = S.descriptors(table(spark, sf, "orders").withColumn("shard", F.expr("o_orderkey div 1000")), "shard", "o_orderkey")
    return S.overlapping(shards, "shard").agg(F.count("*").alias("bad"))
