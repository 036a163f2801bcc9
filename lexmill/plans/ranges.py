"""Registered queries of the range operators: shards, prefix ranges, core words, distances, numbers; over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import lexicon as L
from ..operators import lookup as U
from ..operators.ranges import numbered
from ..operators.store import folder
from ..sources import shards as P
from .queries import COUNTS, LATIN, RANKED, query, table

#: Records of the documents: keys that begin with many prefixes, texts as hexadecimal bytes.
RECORDS = """(SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) || '-' || doc_id AS key, '{"d":' || doc_id || ',"t":"' || hex(text) || '"}' AS json FROM documents)"""


def records(spark, sf):
    d = table(spark, sf, "documents")
    key = F.concat(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), F.lit("-"), F.col("doc_id").cast("string"))
    return d.select(key.alias("key"), F.concat(F.lit('{"d":'), F.col("doc_id").cast("string"), F.lit(',"t":"'), F.hex("text"), F.lit('"}')).alias("json"))


def fold_sql(target: str, limit: str, by_prefix: bool) -> str:
    """The sequential fold, record after record: open size, prefix, shard."""
    own = "CASE WHEN n.i = 1 THEN n.size ELSE n.size + 1 END" if by_prefix else "n.size + 1"
    full = f"f.size + {own} > {limit}" + (f" OR (f.size >= {target} AND n.prefix <> f.prefix)" if by_prefix else "")
    return f"""
n AS MATERIALIZED (SELECT *, octet_length(encode(json)) AS size, substr(key, 1, 2) AS prefix, row_number() OVER (ORDER BY key) AS i FROM {RECORDS}),
f AS (
  SELECT n.i, n.key, {"n.size" if by_prefix else "n.size + 1"} + 2 AS size, n.prefix, CAST(0 AS BIGINT) AS piece FROM n WHERE i = 1
  UNION ALL
  SELECT n.i, n.key, CASE WHEN {full} THEN 2 ELSE f.size END + n.size + 1, n.prefix, f.piece + CASE WHEN {full} THEN 1 ELSE 0 END FROM f JOIN n ON n.i = f.i + 1
)"""


@query("shard_pieces", f"WITH RECURSIVE {fold_sql('196608', '262144', True)} SELECT key, piece FROM f")
def _(spark, sf):
    return P.sharded(records(spark, sf)).select("key", "piece")


@query("search_shard_pieces", f"WITH RECURSIVE {fold_sql('', '196608', False)} SELECT key, piece FROM f")
def _(spark, sf):
    return P.sharded(records(spark, sf), by_prefix=False).select("key", "piece")


@query("shard_files", f"""WITH RECURSIVE {fold_sql('196608', '262144', True)}
SELECT printf('lex-%04d', piece) AS id, min(key) AS first, max(key) AS last, count(*) AS entries, CAST(sum(n.size) + count(*) + 1 AS BIGINT) AS "rawBytes" FROM f JOIN n USING (i, key) GROUP BY piece""")
def _(spark, sf):
    return P.write_shards(records(spark, sf), folder(spark), "lex").select("id", "first", "last", "entries", "rawBytes")


@query("shard_round_trip", f"SELECT json FROM {RECORDS}")
def _(spark, sf):
    root = folder(spark)
    return P.read_packs(spark, root, P.write_shards(records(spark, sf), root, "search", by_prefix=False)).select("json")


@query("token_numbers", f"SELECT token, lang, row_number() OVER (ORDER BY lang DESC, token) AS place FROM (SELECT DISTINCT token, lang FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents))")
def _(spark, sf):
    t = L.tokens(table(spark, sf, "documents"), "text", T.LETTERS, "lang").distinct()
    return numbered(t, "place", F.col("lang").desc(), F.col("token")).select("token", "lang", "place")


STARTS = f"(SELECT DISTINCT substr(token, 1, k) AS q FROM {COUNTS}, range(1, 5) r(k) WHERE length(token) >= k)"


@query("prefix_ranges", f"""
WITH t AS MATERIALIZED (SELECT token, strip_accents(token) AS folded, rank FROM {RANKED}), q AS MATERIALIZED (SELECT q, strip_accents(q) AS key FROM {STARTS})
SELECT q, CAST(pos AS INTEGER) AS pos, token FROM (
  SELECT q, token, row_number() OVER (PARTITION BY q ORDER BY rank) AS pos
  FROM q JOIN (SELECT token, rank, substr(folded, 1, k) AS key FROM t, range(1, 9) r(k) WHERE length(folded) >= k) USING (key)
) WHERE pos <= 8""")
def _(spark, sf):
    ranks = L.ranked(L.token_frequency(table(spark, sf, "documents")))
    q = ranks.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("token"))), lambda n: F.substring("token", F.lit(1), n))).alias("q")).distinct()
    return I.prefix_lookup(q, ranks, "token", "rank", 8)


#: The SQL engine's distances count bytes: in its SQL each letter of more than one byte is another of one.
ONE_BYTE = "translate({}, '" + LATIN + "', '" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[: len(LATIN)] + "')"
#: Words of the parts, from their keys, and each as it may be mistyped: with a letter more.
WORDS = "(SELECT 'q' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abdefgijko') AS n, p_partkey AS r FROM part)"


def words_of(spark, sf):
    n = F.concat(F.lit("q"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abdefgijko"))
    return table(spark, sf, "part").select(n.alias("n"), n.alias("l"), F.col("p_partkey").cast("long").alias("r"))


@query("fuzzy_core", f"""
WITH core AS MATERIALIZED (SELECT n AS l, r FROM {WORDS} WHERE r < 5000), q AS MATERIALIZED (SELECT substr(n, 1, 2) || 'z' || substr(n, 3) AS q FROM {WORDS}),
m AS (SELECT q, l, r, levenshtein(q, l) AS d FROM q JOIN core ON abs(length(q) - length(l)) <= 2)
SELECT q, CAST(pos AS INTEGER) AS pos, l FROM (SELECT q, l, row_number() OVER (PARTITION BY q ORDER BY d, r) AS pos FROM m WHERE d <= CASE WHEN length(q) <= 4 THEN 1 WHEN length(q) <= 8 THEN 2 ELSE 3 END) WHERE pos <= 8""")
def _(spark, sf):
    words = words_of(spark, sf)
    typed = words.select(F.concat(F.substring("n", 1, 2), F.lit("z"), F.expr("substring(n, 3)")).alias("q"))
    return U.fuzzy_core(typed, words.where("r < 5000"))


SWAPPED = "substr(token, 1, 1) || substr(token, 3, 1) || substr(token, 2, 1) || substr(token, 4)"


@query("swapped_letters", f"SELECT token AS n, CAST(damerau_levenshtein({ONE_BYTE.format('token')}, {ONE_BYTE.format('(' + SWAPPED + ')')}) AS INTEGER) AS distance FROM {COUNTS}")
def _(spark, sf):
    t = L.token_frequency(table(spark, sf, "documents"))
    q = F.concat(F.substring("token", 1, 1), F.substring("token", 3, 1), F.substring("token", 2, 1), F.expr("substring(token, 4)"))
    return t.select(F.col("token").alias("n"), T.osa_distance("token", q, F.lit(64)).alias("distance"))
