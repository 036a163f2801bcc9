"""Lookup of words: morphology, attached pronouns, periphrases, prefixes and misspellings, tier by tier, for tables of queries.

Tables: lexicon (n, l, p, r), morphology (surface, lemma, label, pos, ord). Queries are rows (q). A later tier sees only what
the earlier ones have missed. Candidates are rows (q, pos, n, l, pos_class, label, confidence, r, p).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.han import intent
from ..functions.text import HAN, enclitic, fold, label_priority, normalize, periphrastic, proclitic, searchable, strip_enclitic, strip_proclitic
from .entries import is_verb
from .fuzzy import core_near
from .index import few
from .ranges import numbered, prefix_top
from .search import expressions, hydrate, matches_class, prefer_class, reverse, suggest_chinese, suggest_spanish
from .store import stored

CANDIDATE = ("q", "pos", "n", "l", "pos_class", "label", "confidence", "r", "p")
#: How sure a kind of resolution is.
SURE = {"periphrastic": 0.99, "first": 0.98, "least": 0.90, "elided": 0.97, "clitic": 0.95, "host": 0.94, "homograph": 0.86}


def _as(rows: DataFrame, pos, pos_class, label, confidence) -> DataFrame:
    return rows.select("q", F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.alias("pos"), "n", "l", pos_class.alias("pos_class"), label.alias("label"), confidence.cast("double").alias("confidence"), "r", "p")


def analyses(forms: DataFrame, morphology: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates of forms (q, form): analyses whose lemma has an entry, one a lemma (best label, then first), by frequency rank,
    then in Catalan order; each is a little less sure than the one before."""
    met = forms.join(morphology, F.col("form") == F.col("surface")).withColumn("key", normalize(F.col("lemma"), composed=True)).drop("lemma").join(lexicon.select("n", "l", "p", "r"), F.col("key") == F.col("n"))
    one = met.groupBy("q", "n").agg(F.min_by(F.struct("l", "p", "r", "label", F.coalesce(F.when(F.col("pos") != "", F.col("pos")), F.element_at("p", 1)).alias("pos_class")), F.struct(label_priority(F.col("label")), "ord")).alias("c"))
    flat = one.select("q", "n", "c.*")
    pos = F.row_number().over(Window.partitionBy("q").orderBy(F.col("r").asc_nulls_last(), F.collate("l", "ca"))).cast("int")
    ranked = flat.withColumn("pos", pos)
    return _as(ranked, F.col("pos"), F.col("pos_class"), F.col("label"), F.greatest(F.lit(SURE["least"]), F.round(F.lit(SURE["first"]) - 0.01 * (F.col("pos") - 1), 2)))


def _first_tier(*tiers: DataFrame) -> DataFrame:
    """Rows of the first tier in which a query has any, with its number."""
    every = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        every = t if every is None else every.unionByName(t)
    every = stored(every)
    best = every.groupBy("q").agg(F.min("tier").alias("tier"))
    return every.join(best, ["q", "tier"])


def _hosts(forms: DataFrame, mark: Column, host: Column, morphology: DataFrame, lexicon: DataFrame, label, exact: Column | None, exact_label, confidence: float, exact_class) -> DataFrame:
    """Candidates of the word without a pronoun: its own entry where `exact` allows that, else its verb analyses, 4 at most."""
    f = forms.select("q", host.alias("form"), mark.alias("mark")).where(F.col("mark").isNotNull() & (F.col("form") != "") & searchable(F.col("form")))
    own = f.join(lexicon, F.col("form") == F.col("n")).where(exact)
    own = stored(_as(own, 1, exact_class, exact_label(F.col("mark")), F.lit(confidence)))
    rest = analyses(f.join(own.select("q"), "q", "left_anti").select("q", "form"), morphology, lexicon).where(is_verb(F.col("p")))
    rest = rest.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("pos")).cast("int")).where("pos <= 4").join(f.select("q", "mark"), "q")
    rest = _as(rest, F.col("pos"), F.col("pos_class"), label(F.col("mark"), F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("inflected verb"))), F.least("confidence", F.lit(SURE["host"])))
    return own.unionByName(rest)


def resolve(queries: DataFrame, morphology: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates with `tier` of normalized queries: 0 'auxiliary + infinitive', 1 analyses, 2 the host of an attached pronoun,
    3 the host of an elided word before it; only the first tier that has any."""
    forms = queries.select("q").distinct().where((F.col("q") != "") & searchable(F.col("q")))
    person, word = periphrastic(F.col("q"))
    past = forms.withColumn("person", person).withColumn("word", word).where("word is not null").join(lexicon, F.col("word") == F.col("n")).where(is_verb(F.col("p")))
    past = _as(past, 1, F.lit("verb"), F.concat(F.lit("passat perifràstic · "), F.col("person")), F.lit(SURE["periphrastic"]))
    direct = analyses(forms.select("q", F.col("q").alias("form")), morphology, lexicon)
    bare = lambda m: F.regexp_replace(m, "^[-']", "")
    after = _hosts(
        forms, enclitic(F.col("q")), strip_enclitic(F.col("q")), morphology, lexicon, lambda m, x: F.concat(x, F.lit(" + clitic "), bare(m)), is_verb(F.col("p")),
        lambda m: F.concat(F.lit("verb + clitic "), bare(m)), SURE["clitic"], F.lit("verb"),
    )
    before = _hosts(
        forms, proclitic(F.col("q")), strip_proclitic(F.col("q")), morphology, lexicon, lambda m, x: F.concat(F.lit("proclitic "), m, F.lit(" + "), x), F.col("mark").isin("l'", "d'"),
        lambda m: F.concat(F.lit("elided "), m, F.lit(" + lemma")), SURE["elided"], F.element_at("p", 1),
    )
    return _first_tier(past, direct, after, before)


def prefix_suggestions(queries: DataFrame, lexicon: DataFrame, k: int = 8) -> DataFrame:
    """q, pos, l: lemmas whose folded key begins with the folded query, by rank, then in Catalan order; one that is the query but for
    its accents stands first (`accent`). Few queries (a checked bound) meet all lemmas in one pass, many are merged with the sorted keys."""
    q = queries.select("q").distinct().withColumn("_f", fold(F.col("q")))
    lex = lexicon.select("n", "l", "r").withColumn("_k", fold(F.col("n")))
    best = [F.col("r").asc_nulls_last(), F.collate("l", "ca")]
    if few(q):
        met = lex.join(F.broadcast(q), F.startswith("_k", "_f"))
        top = met.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(*best))).where(F.col("pos") <= k)
    else:
        placed = stored(numbered(lex, "place", *best, F.col("n")))
        found = prefix_top(q.select("q", F.col("_f").alias("key")), placed.select(F.col("_k").alias("key"), "place"), k)
        top = found.join(placed, "place").join(q, "q")
    accent = (F.col("_k") == F.col("_f")) & (F.col("n") != F.col("q"))
    first = F.min(F.when(accent, F.col("pos"))).over(Window.partitionBy("q"))
    top = top.withColumn("_first", first)
    moved = F.when(F.col("pos") == F.col("_first"), 0).otherwise(F.col("pos"))
    return top.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(moved)).cast("int")).select("q", "pos", "l", F.col("_first").isNotNull().alias("accent"))


def fuzzy_core(queries: DataFrame, core: DataFrame, k: int = 8) -> DataFrame:
    """q, pos, l: lemmas of the core (n, l, r) within edit_threshold() of the query, both folded, by distance, rank, Catalan order. The
    queries walk the core as automata where they are; the core's size is checked."""
    q = queries.select("q").distinct().withColumn("_f", fold(F.col("q")))
    return core_near(q, core, fold(F.col("n")), k, F.col("r").asc_nulls_last(), F.collate("l", "ca"))


def catalan(queries: DataFrame, lexicon: DataFrame, morphology: DataFrame, core: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """q, key, status, source, pos, n, l, label, confidence: what each query finds, tier by tier.

    exact (normalized-exact if only the key is spelled so); of `reviewed` forms (rows of morphology) a more frequent other
    verb in the first person of the present, or a past participle of the 500 most frequent, goes before the exact word;
    then resolve() (source morphology or clitic); then suggestions, status not-found: prefix (fuzzy if an accent
    equivalent leads), else fuzzy; else one row of source none.
    """
    asked = queries.select("q").distinct().withColumn("key", normalize(F.col("q")))
    fit = asked.where((F.col("key") != "") & searchable(F.col("key")))
    keys = fit.select(F.col("key").alias("q")).distinct()
    exact = fit.join(lexicon.select("n", "l", "p", "r"), F.col("key") == F.col("n"))
    spelled = F.when(F.trim("q") == F.col("key"), "exact").otherwise("normalized-exact")
    found = exact.select("q", "key", F.lit("found").alias("status"), spelled.alias("source"), F.lit(1).alias("pos"), "n", "l", F.lit(None).cast("string").alias("label"), F.when(F.trim("q") == F.col("key"), 1.0).otherwise(0.98).alias("confidence"))
    if reviewed is not None:
        found = _homographs(found, exact, reviewed, lexicon)
    missed = stored(keys.join(lexicon.select(F.col("n").alias("q")), "q", "left_anti"))
    resolved = stored(resolve(missed, morphology, lexicon))
    source = F.when(F.first("label").over(Window.partitionBy("q").orderBy("pos")).rlike("clitic|elided"), "clitic").otherwise("morphology")
    resolved = resolved.withColumn("source", source).select(F.col("q").alias("key"), F.lit("found").alias("status"), "source", "pos", "n", "l", "label", "confidence")
    left = stored(missed.join(resolved.select(F.col("key").alias("q")), "q", "left_anti"))
    prefix = stored(prefix_suggestions(left, lexicon))
    left = stored(left.join(prefix.select("q"), "q", "left_anti"))
    fuzzy = stored(fuzzy_core(left, core))
    none = left.join(fuzzy.select("q"), "q", "left_anti")
    null = lambda t="string": F.lit(None).cast(t)
    said = lambda rows, source: rows.select(F.col("q").alias("key"), F.lit("not-found").alias("status"), source.alias("source"), "pos", null().alias("n"), "l", null().alias("label"), null("double").alias("confidence"))
    rest = resolved.unionByName(said(prefix, F.when(F.col("accent"), "fuzzy").otherwise("prefix"))).unionByName(said(fuzzy, F.lit("fuzzy")))
    rest = rest.unionByName(said(none.withColumn("pos", null("int")).withColumn("l", null()), F.lit("none")))
    unfit = asked.join(fit.select("q"), "q", "left_anti").select("q", "key", F.lit("not-found").alias("status"), F.lit("none").alias("source"), null("int").alias("pos"), null().alias("n"), null().alias("l"), null().alias("label"), null("double").alias("confidence"))
    return found.unionByName(fit.join(rest, "key").select(found.columns)).unionByName(unfit)


def _homographs(found: DataFrame, exact: DataFrame, reviewed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`found` with verb readings of reviewed forms before the exact word, where they are preferred."""
    forms = exact.select(F.col("key").alias("q"), F.col("key").alias("form")).distinct()
    c = analyses(forms, reviewed, lexicon).withColumnRenamed("q", "key")
    rank = lambda r: F.coalesce(r, F.lit(2**53 - 1))
    own = exact.select("key", F.col("n").alias("own_n"), F.col("l").alias("own_l"), F.col("r").alias("own_r")).distinct()
    label = F.lower(F.coalesce("label", F.lit("")))
    verbs = c.join(own, "key").where(is_verb(F.col("p")) & (F.col("n") != F.col("own_n")))
    first = verbs.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("_n = 1")
    speaks = label.rlike("first person|1st person") & label.contains("present")
    led = first.where((rank(F.col("r")) < rank(F.col("own_r"))) & (speaks | (label.contains("past participle") & (rank(F.col("r")) <= 500)))).select("key", F.col("n").alias("lead"), "own_n", "own_l")
    others = c.join(led, "key").withColumn("_o", F.when(F.col("n") == F.col("lead"), 0).otherwise(F.col("pos")))
    rows = others.select("key", "n", "l", "label", "confidence", "_o").unionByName(
        led.select("key", F.col("own_n").alias("n"), F.col("own_l").alias("l"), F.lit("exact lexical homograph").alias("label"), F.lit(SURE["homograph"]).alias("confidence"), F.lit(1 << 20).alias("_o"))
    )
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("_o")).cast("int"))
    swapped = found.select("q", "key").distinct().join(placed, "key").select("q", "key", F.lit("found").alias("status"), F.lit("morphology").alias("source"), "pos", "n", "l", "label", "confidence")
    return found.join(led.select("key"), "key", "left_anti").select(found.columns).unionByName(swapped)


def completions(queries: DataFrame, lexicon: DataFrame, core: DataFrame, k: int = 3) -> DataFrame:
    """q, pos, term, kind: prefix suggestions, or misspelled words of the core for queries that have none; none under two characters."""
    q = queries.select("q").distinct().withColumn("key", normalize(F.col("q"))).where(F.length("key") >= 2)
    keys = q.select(F.col("key").alias("q")).distinct()
    prefix = stored(prefix_suggestions(keys, lexicon, k).drop("accent"))
    fuzzy = fuzzy_core(keys.join(prefix.select("q"), "q", "left_anti"), core, k)
    kind = F.when(F.startswith(normalize(F.col("l")), "key"), "prefix").otherwise("fuzzy")
    both = prefix.unionByName(fuzzy).withColumnRenamed("q", "key")
    return q.join(both, "key").select("q", "pos", F.col("l").alias("term"), kind.alias("kind"))


def candidates(queries: DataFrame, index: DataFrame, lexicon: DataFrame, language: str, meanings: DataFrame | None = None, simplify=None) -> DataFrame:
    """Entries that queries of a language lead to (as hydrate()): through its postings, and for Chinese through `meanings` (expressions)."""
    hits = reverse(queries, index, language, simplify=simplify)
    meant = None if language != "zh" or meanings is None else expressions(queries, meanings, simplify=simplify)
    return hydrate(hits, meant, lexicon)


RESULT = ("q", "pos", "n", "l", "language", "match", "kind", "confidence", "pos_class", "sense_pos", "p")


def lookup(queries: DataFrame, lexicon: DataFrame, morphology: DataFrame, core: DataFrame, spanish: DataFrame, chinese: DataFrame | None = None, meanings: DataFrame | None = None, simplify=None) -> DataFrame:
    """RESULT rows of each query, by the language it is written in. With Han: the entries of its Chinese postings and of the
    expressions that mean something (`meanings`). Without: the Catalan reading first, then the entries of its Spanish
    postings. One row an entry; kind tells what led to it."""
    zh = F.col("q").rlike(HAN)
    ca = catalan(queries.where(~zh), lexicon, morphology, core).where("status = 'found'")
    null = F.lit(None).cast("string")
    ca = ca.join(lexicon.select("n", "p"), "n").select("q", F.lit(0).alias("tier"), "pos", "n", "l", F.lit("ca").alias("language"), F.trim("q").alias("match"), F.col("source").alias("kind"), "confidence", F.element_at("p", 1).alias("pos_class"), null.alias("sense_pos"), "p")
    found = lambda hits, language: hits.select("q", F.lit(1).alias("tier"), "pos", "n", "l", F.lit(language).alias("language"), "match", "kind", "confidence", "pos_class", "sense_pos", "p")
    every = ca.unionByName(found(candidates(queries.where(~zh), spanish, lexicon, "es"), "es"))
    if chinese is not None:
        every = every.unionByName(found(candidates(queries.where(zh), chinese, lexicon, "zh", meanings, simplify), "zh"))
    rest = [c for c in every.columns if c not in ("q", "n")]
    one = every.groupBy("q", "n").agg(F.min_by(F.struct(*rest), F.struct("tier", "pos")).alias("b")).select("q", "n", "b.*")
    place = F.row_number().over(Window.partitionBy("q").orderBy("tier", "pos", "n"))
    return one.withColumn("pos", place).select(*RESULT)


def with_intents(queries: DataFrame, look, simplify=None) -> DataFrame:
    """look(queries) of each query as it is written, or of the word that a Chinese question asks for where that finds nothing; the
    class that the question names comes first. `asked` is what was looked up."""
    asked = queries.select("q").distinct()
    literal = stored(look(asked))
    missed = stored(asked.join(literal.select("q").distinct(), "q", "left_anti").where(F.col("q").rlike(HAN)))  # intent() is a large expression: a stage of its own
    terms = stored(missed.select("q", intent(F.col("q"), simplify).alias("i"))).where("i is not null").select(F.col("q").alias("question"), F.col("i.term").alias("q"), F.col("i.pos").alias("preference"))
    meant = look(terms.select("q").distinct()).join(terms, "q").withColumn("asked", F.col("q")).withColumn("q", F.col("question")).drop("question")
    preferred = prefer_class(meant.where("preference is not null"))
    rest = meant.where("preference is null")
    return literal.withColumn("asked", F.col("q")).unionByName(rest.unionByName(preferred).select(*literal.columns, "asked"))


def suggest(queries: DataFrame, spanish: DataFrame, chinese: DataFrame, lexicon: DataFrame, core: DataFrame, k: int = 8, *, look=None, meanings: DataFrame | None = None, simplify=None, read=None) -> DataFrame:
    """q, pos, term, lemma, language, kind. Queries without Han: Spanish suggestions, filled up with Catalan completions. With Han:
    Chinese suggestions of the query, or of the word that a question asks for unless one is exact; of these the exact
    ones, then `meanings` of the word, then those that are not misspelled, one a lemma. A question for a word class gives
    the first entry of that class that look() finds for its word, or nothing.
    """
    fit = stored(queries.select("q").distinct().where(F.length("q") <= 64))
    zh = F.col("q").rlike(HAN)
    latin = fit.where(~zh)
    b = suggest_spanish(latin, spanish, k).select("q", F.lit(0).alias("tier"), "pos", "term", "lemma", F.lit("es").alias("language"), "kind")
    c = completions(latin, lexicon, core, k).select("q", F.lit(1).alias("tier"), "pos", "term", F.col("term").alias("lemma"), F.lit("ca").alias("language"), "kind")
    asked = stored(fit.where(zh).select("q", intent(F.col("q"), simplify).alias("i"))).select("q", F.col("i.term").alias("term"), F.col("i.pos").alias("preference"))
    plain = asked.where("preference is null")
    own = stored(suggest_chinese(plain.select("q"), chinese, k, simplify, read))
    exact = own.where("kind = 'exact'").select("q").distinct()
    again = plain.where("term is not null").join(exact, "q", "left_anti").select("q", F.col("term").alias("word"))
    other = suggest_chinese(again.select(F.col("word").alias("q")).distinct(), chinese, k, simplify, read).withColumnRenamed("q", "word").join(again, "word")
    found = own.join(again.select("q"), "q", "left_anti").unionByName(other.select(own.columns))
    rows = found.select("q", F.when(F.col("kind") == "exact", 0).otherwise(2).alias("tier"), "pos", "term", "lemma", F.lit("zh").alias("language"), "kind")
    if meanings is not None:
        words = plain.select("q", F.coalesce("term", "q").alias("word"))
        meant = expressions(words.select(F.col("word").alias("q")).distinct(), meanings, k, simplify).withColumnRenamed("q", "word").join(words, "word")
        meant = stored(meant.select("q", F.lit(1).alias("tier"), "pos", F.col("label").alias("term"), "lemma", F.lit("zh").alias("language"), F.lit("semantic").alias("kind")))
        with_meaning = meant.select("q").distinct().withColumn("_m", F.lit(True))
        rows = rows.join(with_meaning, "q", "left").where("_m is null or kind <> 'fuzzy'").drop("_m").unionByName(meant)
        first = F.row_number().over(Window.partitionBy("q", "lemma").orderBy("tier", "pos"))
        rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    if look is not None:
        named = asked.where("preference is not null")
        hit = look(named.select(F.col("term").alias("q")).distinct()).withColumnRenamed("q", "term").join(named, "term")
        best = prefer_class(hit).where("pos = 1").where(matches_class(F.col("sense_pos"), F.col("p"), F.col("preference")))
        semantic = F.col("kind") == "semantic"
        rows = rows.unionByName(best.select("q", F.lit(0).alias("tier"), "pos", F.when(semantic, F.col("match")).otherwise(F.col("q")).alias("term"), F.col("l").alias("lemma"), F.lit("zh").alias("language"), F.when(semantic, "semantic").otherwise("related").alias("kind")))
    order = Window.partitionBy("q").orderBy("tier", "pos")
    every = b.unionByName(c).unionByName(rows)
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("q", F.col("place").alias("pos"), "term", "lemma", "language", "kind")


def first_catalogue(full: DataFrame | None, core: DataFrame | None) -> DataFrame:
    """The suggestion rows to use: the full catalogue where it is there, else the core's; `limited` tells that only the core was."""
    if full is None and core is None:
        raise ValueError("no catalogue")
    rows, limited = (core, True) if full is None else (full, False)
    return rows.withColumn("limited", F.lit(limited))


def intent_lookup(queries: DataFrame, found: DataFrame, intents: DataFrame) -> DataFrame:
    """Rows of `found` (by q) of each query, or of the term it asks for (intents: q, term) where the query itself finds nothing."""
    literal = queries.select("q").distinct().join(found, "q").withColumn("asked", F.col("q"))
    missed = queries.select("q").distinct().join(found.select("q").distinct(), "q", "left_anti").join(intents, "q").where("term is not null")
    meant = missed.select("q", F.col("term").alias("asked")).join(found.withColumnRenamed("q", "asked"), "asked")
    return literal.unionByName(meant.select(literal.columns))
