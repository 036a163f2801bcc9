"""Reverse search: inverted index of terms, exact lookup with order, suggestions for Spanish and Chinese, expressions.

Tables: postings (key, lemma, term, kind, priority, rank), suggestion rows (key, term, lemma, rank), expressions (key,
expression, lemma, label, rank, concept, pos). Queries are rows (q). Lists of postings are never collected: a lookup keeps
the best k rows of each query before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.han import matching_key
from ..functions.text import HAN, MISSING_RANK, chinese_key, osa_distance, osa_threshold, search_input, search_key, utf16_key
from .index import deletions, paired
from .store import stored

Convert = Callable[[Column], Column] | None


def posting_order() -> list[Column]:
    return [F.coalesce("priority", F.lit(0)).desc(), F.coalesce("rank", F.lit(MISSING_RANK)), utf16_key(F.col("lemma")), utf16_key(F.col("term")), F.col("kind")]


def build_index(terms: DataFrame, language: str, simplify: Convert = None, traditional: Convert = None) -> DataFrame:
    """Distinct postings of terms (lemma, term, kind, priority, rank) under their keys; Chinese ones under the key as it is
    written and under those of both scripts, and a key also has the postings of its simplified form."""
    if language == "es":
        keyed = terms.withColumn("key", search_key(F.col("term"), "es"))
        return keyed.where("key <> ''").select("key", "lemma", "term", "kind", "priority", "rank").distinct()
    same = lambda c: c
    simplify, traditional = simplify or same, traditional or same
    simple = terms.withColumn("_raw", chinese_key(F.col("term"))).withColumn("_s", simplify(F.col("term")))
    keys = F.array_distinct(F.array("_raw", chinese_key(F.col("_s")), chinese_key(traditional(F.col("_s")))))
    index = simple.where("_raw <> ''").withColumn("key", F.explode(keys)).select("key", "lemma", "term", "kind", "priority", "rank").distinct()
    other = index.select("key").distinct().withColumn("_simple", chinese_key(simplify(F.col("key")))).where("key <> _simple")
    shared = other.join(index.withColumnRenamed("key", "_simple"), "_simple").select(index.columns)
    return index.unionByName(shared).distinct()


def catalogue(index: DataFrame, entries: DataFrame, language: str) -> DataFrame:
    """Suggestion rows: the first posting of each key, with spelling and rank of its entry (n, l, r)."""
    first = index.groupBy("key").agg(F.min_by(F.struct("lemma", "term"), F.struct(*_ascending())).alias("p"))
    e = entries.select("n", "l", F.col("r").alias("rank"))
    joined = first.join(e, F.col("p.lemma") == F.col("n"), "left")
    return joined.select("key", (F.col("key") if language == "zh" else F.col("p.term")).alias("term"), F.coalesce("l", "p.lemma").alias("lemma"), F.coalesce("rank", F.lit(MISSING_RANK)).alias("rank"))


def _ascending() -> list[Column]:
    return [(-F.coalesce("priority", F.lit(0))).alias("a"), F.coalesce("rank", F.lit(MISSING_RANK)).alias("b"), utf16_key(F.col("lemma")).alias("c"), utf16_key(F.col("term")).alias("d"), F.col("kind").alias("e")]


def reverse(queries: DataFrame, index: DataFrame, language: str, k: int = 32, simplify: Convert = None) -> DataFrame:
    """q, pos, lemma, term, kind, priority, exact: the first k postings of each query: terms spelled as the query first, then by
    priority, then in index order. A Chinese query that has no postings is looked up by its matching key."""
    q = queries.select("q").distinct().withColumn("_exact", search_input(F.col("q"), language))
    if language == "zh":
        q = q.withColumn("_match", matching_key(F.col("q"), simplify))
        keys = q.withColumn("tier", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", F.when(F.col("tier") == 0, search_key(F.col("q"), "zh")).otherwise(F.col("_match")))
        hits = keys.join(index, "key")
        hits = hits.join(hits.groupBy("q").agg(F.min("tier").alias("tier")), ["q", "tier"])
        same = (search_input(F.col("term"), "zh") == F.col("_exact")) | (matching_key(F.col("term"), simplify) == F.col("_match"))
    else:
        hits = q.withColumn("key", search_key(F.col("q"), "es")).join(index, "key")
        same = search_input(F.col("term"), "es") == F.col("_exact")
    order = Window.partitionBy("q").orderBy(F.col("exact").desc(), *posting_order())
    return hits.withColumn("exact", same).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("q", "pos", "lemma", "term", "kind", "priority", "exact")


def expressions(queries: DataFrame, rows: DataFrame, k: int = 32, simplify: Convert = None) -> DataFrame:
    """q, pos, lemma, label, expression, concept, sense_pos of expressions whose key the query has; one row a lemma."""
    q = queries.select("q").distinct().withColumn("key", matching_key(F.col("q"), simplify)).where((F.col("key") != "") & (F.length("key") <= 64))
    met = q.join(rows, "key")
    order = [F.coalesce("rank", F.lit(MISSING_RANK)), utf16_key(F.col("lemma")), F.col("concept")]
    one = met.withColumn("_n", F.row_number().over(Window.partitionBy("q", "lemma").orderBy(*order))).where("_n = 1")
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("pos") <= k).select("q", "pos", "lemma", "label", "expression", "concept", F.col("pos_class").alias("sense_pos"))


def hydrate(reverse_hits: DataFrame, semantic_hits: DataFrame | None, lexicon: DataFrame) -> DataFrame:
    """q, pos, n, l, match, kind, confidence, priority, sense_pos, concept: hits bound to entries (n, l, p, r), one row a lemma.
    The first hit of a lemma stays; a semantic one adds its concept and word class. Hits of a query none of which has an
    entry are an error: the lexicon is not complete."""
    kind = F.col("kind")
    hits = reverse_hits.select("q", F.col("pos").alias("seq"), "lemma", F.col("term").alias("match"), "kind", F.when(F.col("exact"), 1.0).otherwise(0.95).alias("confidence"), F.coalesce("priority", F.lit(0)).alias("priority"), F.lit(None).cast("string").alias("sense_pos"), F.lit(None).cast("string").alias("concept"))
    if semantic_hits is not None:
        hits = hits.unionByName(semantic_hits.select("q", (F.col("pos") + (1 << 20)).alias("seq"), "lemma", F.col("label").alias("match"), F.lit("semantic").alias("kind"), F.lit(0.87).alias("confidence"), F.lit(0).alias("priority"), "sense_pos", "concept"))
    bound = hits.join(lexicon.select("n", "l", "p", "r"), F.col("lemma") == F.col("n"), "left")
    found = bound.where("n is not null").groupBy("q", "n").agg(
        F.min_by(F.struct("l", "p", "r", "match", "kind", "confidence", "priority"), "seq").alias("first"), F.max_by(F.struct("sense_pos", "concept"), F.when(kind == "semantic", F.col("seq"))).alias("sense")
    )
    flat = found.select("q", "n", "first.*", "sense.*")
    order = [F.col("confidence").desc(), F.col("priority").desc(), F.col("r").asc_nulls_last(), F.collate("l", "ca")]
    out = flat.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    out = out.select("q", "pos", "n", "l", "match", "kind", "confidence", "priority", F.coalesce("sense_pos", F.element_at("p", 1)).alias("pos_class"), "sense_pos", "concept", "p", "r")
    lost = bound.groupBy("q").agg(F.max(F.col("n").isNotNull()).alias("any"))
    fault = F.raise_error(F.concat(F.lit("a matched entry is not in the lexicon: "), F.col("q"))).cast("boolean")
    lost = lost.where(F.when(F.col("any"), F.lit(False)).otherwise(fault))  # one filter: a fault alone would be tested before the groups are made
    return out.unionByName(lost.select("q"), allowMissingColumns=True)


def matches_class(sense_pos: Column, p: Column, preference: Column) -> Column:
    """The class of the sense decides; without one, the entry's class if it has just one."""
    return F.coalesce(F.when(sense_pos.isNotNull(), sense_pos == preference).otherwise((F.size(p) == 1) & (F.element_at(p, 1) == preference)), F.lit(False))


def prefer_class(candidates: DataFrame, preference: str = "preference") -> DataFrame:
    """candidates with a new `pos`: those of the preferred class first (by their sense before by their entry), else in order."""
    want = F.col(preference)
    score = F.when(matches_class(F.col("sense_pos"), F.col("p"), want), F.when(F.col("sense_pos") == want, 2).otherwise(1)).otherwise(0)
    return candidates.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(score.desc(), "pos")))


def suggest_spanish(queries: DataFrame, rows: DataFrame, k: int = 8) -> DataFrame:
    """q, pos, term, lemma, kind: exact, prefix, contained, then misspelled keys (within osa_threshold(), from 3 characters on), by
    score, rank, length, term; one row a term. Queries under 2 or over 64 characters have none."""
    q = queries.select("q").distinct().withColumn("k", search_key(F.col("q"), "es")).where(F.length("k").between(2, 64)).withColumn("most", osa_threshold(F.col("k")))
    edits = F.levenshtein("key", "k")
    near = (F.length("k") >= 3) & (F.abs(F.length("key") - F.length("k")) <= F.col("most")) & (edits <= 2 * F.col("most"))
    met = paired(q, rows.select("key", "term", "lemma", "rank"), near)
    literal = F.when(F.col("key") == F.col("k"), 0).when(F.startswith("key", "k"), 1).when(F.contains("key", "k"), 2)
    met = met.withColumn("literal", literal)
    sure = met.where("literal is not null").withColumn("score", F.col("literal"))
    fuzzy = met.where("literal is null").withColumn("score", osa_distance("k", "key", "most") + 3).where(F.col("score") <= F.col("most") + 3)
    best = sure.unionByName(fuzzy).groupBy("q", "term").agg(F.min(F.struct("score", "rank", F.length("key").alias("len"), "lemma")).alias("b"))
    order = Window.partitionBy("q").orderBy("b.score", "b.rank", "b.len", "term")
    kind = F.element_at(F.array(*map(F.lit, ("exact", "prefix", "contains", "fuzzy"))), F.least(F.col("b.score"), F.lit(3)) + 1)
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("q", "pos", "term", F.col("b.lemma").alias("lemma"), kind.alias("kind"))


#: What an edit must not change: a leading negation, a leading number.
NEGATION, NUMBER = "^(?:不|没|无|未|非|别)", "^(?:第)?[0-9一二三四五六七八九十百千万亿两零〇]+"


def prepare_chinese(rows: DataFrame, simplify: Convert = None) -> DataFrame:
    """key, lemma, term (simplified, or spelled as the key if a row is), rank, traditional of suggestion rows: one row a key and lemma."""
    simplify = simplify or (lambda c: c)
    r = rows.withColumn("k", matching_key(F.col("key"), simplify)).withColumn("s", simplify(F.col("term")))
    order = F.struct(F.col("rank"), F.col("term"))
    spelled = F.max(F.when(F.col("term") == F.col("k"), F.col("term")))
    return r.groupBy(F.col("k").alias("key"), "lemma").agg(F.coalesce(spelled, F.min_by("s", order)).alias("term"), F.min("rank").alias("rank"), F.max(F.when(F.col("s") != F.col("term"), F.col("term"))).alias("traditional"))


def suggest_chinese(queries: DataFrame, rows: DataFrame, k: int = 8, simplify: Convert = None, read: Convert = None) -> DataFrame:
    """q, pos, term, lemma, kind. Exact keys, keys without a final 的, prefixes, contained keys (those of long prose behind),
    then keys that sound alike and misspelled ones, by score, length, rank, term; one row a lemma.

    Which rows stay depends on all rows of a query: with a direct hit (exact, without 的, or a prefix that is no prose)
    nothing misspelled or alike in sound, with a contained key that is no prose nothing misspelled, and beside keys that
    sound alike nothing misspelled. So the literal rows are found first, and only queries that they leave open meet keys by
    their readings, and then by forms with characters left out. `read` gives the readings of a key.
    """
    simple = simplify or (lambda c: c)
    q = queries.select("q").distinct().withColumn("k", matching_key(F.col("q"), simplify)).where((F.col("k") != "") & (F.length("k") <= 64))
    q = q.withColumn("n", F.length("k")).withColumn("most", osa_threshold(F.col("k"))).withColumn("in_traditional", simple(F.col("q")) != F.col("q"))
    q = q.withColumn("bare", F.when((F.col("n") >= 3) & F.col("k").endswith("的"), F.substring(F.col("k"), F.lit(1), F.col("n") - 1)))
    q = stored(q.withColumn("sounds", read(F.col("k"))) if read else q)
    cat = prepare_chinese(rows, simplify)
    cat = stored((cat.withColumn("key_sounds", read(F.col("key"))) if read else cat).withColumn("len", F.length("key")))
    prose = ((F.col("len") > 8) & F.col("key").rlike("[,，;；。:：]")) | (F.col("len") > F.greatest(F.lit(12), F.col("n") + 8))
    late = F.when(prose, 1.5).otherwise(0.0)
    score = F.when(F.col("key") == F.col("k"), 0.0).when(F.col("key") == F.col("bare"), 0.5).when(F.startswith("key", "k"), 1 + late).otherwise(2 + late)
    literal = contained(q, cat).unionByName(q.join(cat, F.col("key") == F.col("bare"))).withColumn("score", score)
    lit = F.col("score")  # 0 exact, 0.5 without 的, 1 prefix, 2 contained; 2.5 and 3.5 the latter two in prose
    kind = F.when(lit == 0, "exact").when(lit == 0.5, "related").when(lit.isin(1.0, 2.5), "prefix").otherwise("contains")
    columns = ["q", "lemma", "term", "traditional", "in_traditional", "rank", "len", "score", "kind"]
    sure = stored(literal.withColumn("kind", kind).select(columns))
    least = sure.groupBy("q").agg(F.min("score").alias("least"))
    left = stored(q.join(least, "q", "left").where((F.col("n") >= 2) & F.coalesce(F.col("least") > 1, F.lit(True))))
    kept = (F.col("k").rlike(NEGATION) == F.col("key").rlike(NEGATION)) & (F.regexp_extract("k", NUMBER, 0) == F.regexp_extract("key", NUMBER, 0)) & ~F.contains("key", "k")
    both = F.arrays_zip(F.split("k", "").alias("a"), F.split("key", "").alias("b"))
    changed = F.size(F.filter(both, lambda x: x["a"] != x["b"]))
    han = F.exists(both, lambda x: (x["a"] == x["b"]) & x["a"].rlike(HAN))
    every = sure
    if read:
        same = left.join(cat, (F.col("sounds") == F.col("key_sounds")) & (F.col("len") == F.col("n"))).where(kept)
        alike = same.withColumn("changed", changed).where(F.col("changed").between(1, 2) & (F.col("changed") <= F.when(F.col("n") >= 5, 2).otherwise(1)) & han)
        alike = stored(alike.withColumn("score", 1.75 + F.col("changed") * 0.1).withColumn("kind", F.lit("fuzzy")).select(columns))
        every, left = every.unionByName(alike), left.join(alike.select("q"), "q", "left_anti")
    missed = left.where("least is null or least > 2")
    edited = misspelled(missed, cat, kept).withColumn("edits", osa_distance("k", "key", "most")).where(F.col("edits") <= F.col("most"))
    fuzzy = edited.withColumn("score", 4 + F.col("edits") * 0.25 + F.abs(F.col("len") - F.col("n")) * 0.15).withColumn("kind", F.lit("fuzzy"))
    term = F.when(F.col("in_traditional") & F.col("traditional").isNotNull(), F.col("traditional")).otherwise(F.col("term"))
    best = every.unionByName(fuzzy.select(columns)).withColumn("shown", term).groupBy("q", "lemma").agg(F.min(F.struct("score", "len", "rank", F.col("shown").alias("term"), "kind")).alias("b"))
    order = Window.partitionBy("q").orderBy("b.score", "b.len", "b.rank", F.collate("b.term", "zh"))
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("q", "pos", F.col("b.term").alias("term"), "lemma", F.col("b.kind").alias("kind"))


#: Keys are met by their pieces of up to this length: a longer query by its beginning.
PIECE_MOST = 16


def _sizes(rows: DataFrame, size: Column) -> list[int]:
    """The lengths that occur, each once: of checked queries 64 at most."""
    return sorted(x.n for x in rows.select(size.alias("n")).distinct().collect())


def contained(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of queries (k, its length n) and rows (key, its length len) of which the key contains k, each once: rows are dealt out by
    their pieces of the lengths asked for."""
    size = F.least(F.col("n"), F.lit(PIECE_MOST))
    sizes = F.array(*map(F.lit, _sizes(queries, size))).cast("array<int>")
    of = lambda m: F.transform(F.sequence(F.lit(1), F.col("len") - m + 1), lambda i: F.substring(F.col("key"), i, m))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda m: m <= F.col("len")), of)))
    asked = queries.withColumn("piece", F.substring(F.col("k"), F.lit(1), size))
    return rows.withColumn("piece", F.explode(pieces)).join(asked, "piece").where(F.contains("key", "k")).drop("piece")


def misspelled(queries: DataFrame, rows: DataFrame, kept: Column) -> DataFrame:
    """Pairs of queries (k, n, most: edits and swaps allowed, 1 or 2) and rows (key, len) that may be that near, each once, and are `kept`:
    they share a form with up to `most` characters left out."""
    forms = lambda c, most: F.transform(deletions(F.col(c), most), lambda f: F.xxhash64(f))
    asked = queries.where("most = 1").withColumn("form", F.explode(forms("k", 1))).unionByName(queries.where("most = 2").withColumn("form", F.explode(forms("k", 2))))
    met = None
    for most in (1, 2):
        near = {n + d for n in _sizes(queries.where(F.col("most") == most), F.col("n")) for d in range(-most, most + 1)}
        held = rows.where(F.col("len").isin(*near) if near else F.lit(False)).withColumn("most", F.lit(most)).withColumn("form", F.explode(forms("key", most)))
        met = held if met is None else met.unionByName(held)
    close = F.abs(F.col("len") - F.col("n")) <= F.col("most")
    return met.join(asked, ["most", "form"]).where(close & kept).drop("form").distinct()


#: Classes of concepts, where evidence may stand, layers whose Spanish is trusted, the longest label and expression.
CONCEPT_CLASSES, EVIDENCE_FIELDS, TRUSTED_SPANISH = ("noun", "verb", "adjective", "adverb"), ("zh", "d.zh", "es", "d.ca", "d.en", "l"), ("lex", "freedict", "curated", "seed")
LABEL_MOST, EXPRESSION_MOST = 24, 64
CONCEPT_ID = "^[a-z0-9][a-z0-9-]{1,79}$"


def first_postings(index: DataFrame, keys: DataFrame) -> DataFrame:
    """key, first: the lemma that each of the keys selects, which is the first of its postings in index order."""
    met = index.join(keys.select("key").distinct(), "key", "left_semi")
    return met.groupBy("key").agg(F.min_by("lemma", F.struct(*_ascending())).alias("first"))


def misleading_labels(concepts: DataFrame, index: DataFrame, simplify: Convert = None) -> DataFrame:
    """id, label, lemma, first: concepts whose label, looked up, does not select their own lemma first (first: null if none)."""
    simple = simplify or (lambda c: c)
    c = concepts.select("id", "label", "lemma", chinese_key(simple(F.col("label"))).alias("key"))
    return c.join(first_postings(index, c), "key", "left").where(~F.col("first").eqNullSafe(F.col("lemma"))).select("id", "label", "lemma", "first")


def concept_problems(concepts: DataFrame, entries: DataFrame, layers: DataFrame, index: DataFrame, simplify: Convert = None) -> DataFrame:
    """id, problem of concepts (id, lemma, label, part, evidence array<struct<layer, field, text>>, expressions array<string>).

    entries (n, p); layers: values of each layer (n, layer, p, field, value), a row a text. A concept is right if its id
    is well-formed and its own; its class is one of its entry's and borne out by evidence; its label is Chinese, short and
    selects its lemma; each evidence stands in the layer it names; its expressions are Chinese, short, distinct, and of
    one class with the same expression and lemma elsewhere.
    """
    simple = simplify or (lambda c: c)
    one = concepts.join(entries.select(F.col("n").alias("_n"), F.col("p").alias("_p")), F.col("lemma") == F.col("_n"), "left")
    twice = concepts.groupBy("id").agg(F.count("*").alias("_times"))
    one = one.join(twice, "id")
    holds = lambda c: F.coalesce(c, F.lit(False))
    x = F.col("expressions")
    checks = [
        (~holds(F.col("id").rlike(CONCEPT_ID)) | (F.col("_times") > 1), "invalid or repeated id"),
        (F.col("_n").isNull() | ~holds(F.col("label").rlike(HAN)) | ~holds(F.length("label") <= LABEL_MOST), "invalid lemma or label"),
        (F.col("part").isNotNull() & ~(holds(F.col("part").isin(*CONCEPT_CLASSES)) & holds(F.array_contains("_p", F.col("part")))), "class is not the entry's"),
        (~holds(F.size("evidence") > 0), "no evidence"),
        (~holds(F.size(x) > 0) | (F.size(F.array_distinct(x)) < F.size(x)), "no or repeated expressions"),
        (holds(F.exists(x, lambda e: ~holds(e.rlike(HAN)) | (F.length(e) > EXPRESSION_MOST) | e.rlike("[\n\t;；<>]"))), "invalid expression"),
        (holds(F.exists("evidence", lambda e: ~e["field"].isin(*EVIDENCE_FIELDS))), "unknown evidence field"),
        (holds(F.exists("evidence", lambda e: (e["field"] == "es") & ~e["layer"].isin(*TRUSTED_SPANISH))), "unverified Spanish evidence"),
    ]
    own = one.select("id", F.explode(F.filter(F.array(*(F.when(c, F.lit(what)) for c, what in checks)), lambda w: w.isNotNull())).alias("problem"))
    labels = misleading_labels(concepts, index, simplify).select("id", F.lit("label does not select its lemma").alias("problem"))
    said = concepts.select("id", "lemma", "part", F.inline("evidence"))
    held = layers.select(F.col("n").alias("lemma"), "layer", "field", F.col("value").alias("text"), F.col("p").alias("_p")).groupBy("lemma", "layer", "field", "text").agg(F.flatten(F.collect_set("_p")).alias("_p"))
    bound = said.join(held.withColumn("_held", F.lit(True)), ["lemma", "layer", "field", "text"], "left")
    differs = bound.where("_held is null").select("id", F.lit("evidence is not in its layer").alias("problem"))
    backed = bound.groupBy("id").agg(F.max("part").alias("part"), F.max(holds(F.array_contains("_p", F.col("part")))).alias("ok"))
    unbacked = backed.where("part is not null and not ok").select("id", F.lit("evidence does not support its class").alias("problem"))
    spoken = concepts.where("part is not null").select("id", "lemma", "part", F.explode(x).alias("expression")).withColumn("key", chinese_key(simple(F.col("expression"))))
    mixed = spoken.groupBy("key", "lemma").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key", "lemma")
    conflict = spoken.join(mixed, ["key", "lemma"], "left_semi").select("id", F.lit("conflicting classes of an expression").alias("problem"))
    return own.unionByName(labels).unionByName(differs).unionByName(unbacked).unionByName(conflict).distinct()


def expression_rows(concepts: DataFrame, entries: DataFrame, simplify: Convert = None) -> DataFrame:
    """The rows that `expressions` reads (key, expression, lemma, label, rank, concept, pos_class) of concepts without problems."""
    simple = simplify or (lambda c: c)
    rows = concepts.join(entries.select(F.col("n").alias("lemma"), F.col("r").alias("rank")), "lemma").select("lemma", "label", F.coalesce("rank", F.lit(MISSING_RANK)).alias("rank"), F.col("id").alias("concept"), F.col("part").alias("pos_class"), F.posexplode("expressions").alias("_i", "expression"))
    keyed = rows.withColumn("key", chinese_key(simple(F.col("expression"))))
    first = F.row_number().over(Window.partitionBy("key", "lemma", "label").orderBy("concept", "_i"))
    return keyed.withColumn("_k", first).where("_k = 1").select("key", "expression", "lemma", "label", "rank", "concept", "pos_class")
