"""Indexes and lookups: prefix and inverted indexes, tiered lookup, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, osa_distance
from .ranges import numbered, prefix_top
from .store import stored


def prefix_index(lemmas: DataFrame, lemma: str, rank: str) -> DataFrame:
    """Folded key to lemmas by rank."""
    by = F.array_sort(F.collect_set(F.struct(F.col(rank).alias("r"), F.col(lemma).alias("l"))))
    return lemmas.groupBy(fold(F.col(lemma)).alias("key")).agg(F.transform(by, lambda x: x["l"]).alias("lemmas"))


#: Stated queries up to this number are broadcast (the number is counted first); more are joined by a key.
FEW_QUERIES = 1000


def few(queries: DataFrame) -> bool:
    return queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES


def prefix_lookup(queries: DataFrame, lemmas: DataFrame, lemma: str, rank: str, k: int) -> DataFrame:
    """The k best lemmas of each query prefix. Few queries meet all lemmas in one pass, without a shuffle; many are merged with the
    sorted lemmas range by range. Each query keeps its best k before rows are shuffled."""
    q = queries.select("q", fold(F.lower("q")).alias("key"))
    keyed = lemmas.select(lemma, rank, fold(F.col(lemma)).alias("folded"))
    if not few(q):
        placed = stored(numbered(keyed, "place", F.col(rank), F.col(lemma)))
        best = prefix_top(q, placed.select(F.col("folded").alias("key"), "place"), k)
        return best.join(placed.select("place", lemma), "place").select("q", "pos", lemma)
    met = keyed.join(F.broadcast(q), F.startswith("folded", "key"))
    w = Window.partitionBy("q").orderBy(rank, lemma)
    return met.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("q", "pos", lemma)


def postings(tokens: DataFrame, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """The inverted index, long form: key, document, occurrences."""
    return tokens.groupBy(key, doc).agg(F.count("*").alias("tf"))


def reverse_lookup(index: DataFrame, keys: DataFrame, key: str = "token", doc: str = "doc_id", k: int = 3) -> DataFrame:
    """The k best postings of each asked key."""
    w = Window.partitionBy(key).orderBy(F.col("tf").desc(), doc)
    return index.join(F.broadcast(keys) if few(keys) else keys, key).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def tiered(*tiers: DataFrame, query: str = "q") -> DataFrame:
    """Rows of the first tier that has any, for each query."""
    out = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        out = t if out is None else out.unionByName(t)
    w = Window.partitionBy(query)
    return out.withColumn("first", F.min("tier").over(w)).where(F.col("tier") == F.col("first")).drop("first")


def deletions(text, k: int = 1):
    """The text and all its forms with up to k characters left out: two texts within k edits or swaps share a form."""
    without = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
    out = F.array_union(F.array(text), without(text)) if k else F.array(text)
    for _ in range(k - 1):
        out = F.array_union(out, F.flatten(F.transform(out, without)))
    return out


def fuzzy(queries: DataFrame, terms: DataFrame, most: int = 1) -> DataFrame:
    """q, term, distance for terms within `most` edits or adjacent swaps. Few queries meet all terms of nearly their length in one
    pass, the built-in distance (at most twice the other) rules out most; many meet by deletion neighbourhoods."""
    q, t = queries.select("q"), terms.select("term")
    if few(q):
        near = (F.abs(F.length("q") - F.length("term")) <= most) & (F.levenshtein("q", "term") <= 2 * most)
        pairs = t.join(F.broadcast(q.distinct()), near)
    else:
        a = q.select("q", F.explode(deletions(F.col("q"), most)).alias("form"))
        b = t.select("term", F.explode(deletions(F.col("term"), most)).alias("form"))
        pairs = a.join(b, "form").select("q", "term").distinct()
    return pairs.select("q", "term", osa_distance("q", "term", F.lit(most)).alias("distance")).where(F.col("distance") <= most)


def complete(queries: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Exact, prefix and contained matches, in that order, then rank, length, term."""
    met = terms.withColumn("key", F.col("term"))
    met = paired(queries.select("q", F.col("q").alias("k")), met, F.lit(False))
    score = F.when(F.col("term") == F.col("q"), 0).when(F.startswith("term", "q"), 1).otherwise(2)
    best = met.withColumn("score", score).groupBy("q", "term").agg(F.min(F.struct("score", "rank")).alias("s"))
    w = Window.partitionBy("q").orderBy("s", F.length("term"), "term")
    return best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("q", "pos", "term", F.col("s.score").alias("score"))


def paired(queries: DataFrame, rows: DataFrame, near: Column) -> DataFrame:
    """Pairs of queries (key `k`) and rows (key) of which the key contains k or is `near`. Few queries meet all rows in one pass
    without a shuffle. Many meet the rows that share a pair of neighbours with them, the ends counting as characters:
    whatever contains k has one of its pairs, and so has whatever is within osa_threshold() of it, since an edit or swap
    changes three pairs at most. A query of one character meets the rows that have it.
    """
    if few(queries):
        return rows.join(F.broadcast(queries), F.contains("key", "k") | near)
    ended = lambda c: F.concat(F.lit("\u0002"), c, F.lit("\u0003"))
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(ended(F.col(c)), i, F.lit(2))))
    asked = queries.withColumn("gram", F.explode(F.when(F.length("k") == 1, F.array("k")).otherwise(pairs("k"))))
    held = rows.withColumn("gram", F.explode(F.array_union(pairs("key"), F.split("key", ""))))
    return asked.join(held, "gram").where(F.contains("key", "k") | near).drop("gram").distinct()
