"""Evidence, jobs, overlays and corrections: what a meaning rests on, and what is done about lemmas without one.

Layer rows are those of entries.ENTRY with `layer` and `ordinal` (order of the layers of a lemma). Evidence is one row for
each text of a layer; a job is identified by the hash of its fields. Violations raise an error when they are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.han import HAN_RANGES, clean_chinese, short_terms
from ..functions.text import HAN, MISSING_RANK, PLACEHOLDER, canonical_json, normalize, or_empty, spanish_fold, utf16_length
from .entries import has_chinese
from .ranges import ranged
from .store import stored

#: Layers whose Spanish is Spanish; fields that identify a job.
TRUSTED = ("lex", "freedict", "curated", "seed")
JOB = ("kind", "layer", "normalizedLemma", "sourceIds", "sourceLanguage", "sourcePartOfSpeech", "sourceText")
POS_SYNSET = {"noun": "n", "verb": "v", "adjective": "a", "adverb": "r"}


def evidence(layers: DataFrame) -> DataFrame:
    """n, id (e001 ... in order of layers, then ca, en, es definitions, then hints), kind, language, text, sources, p, layer,
    verified (of hints: the layer is trusted). A text counts once a layer."""

    def texts(kind: str, language: str, order: int, items: Column) -> Column:
        return F.transform(or_empty(items), lambda t, i: F.struct(F.lit(kind).alias("kind"), F.lit(language).alias("language"), F.lit(order).alias("o"), i.alias("i"), t.alias("text")))

    parts = [texts("definition", k, o, F.col(f"d.{k}")) for o, k in enumerate(("ca", "en", "es"))] + [texts("translation_hint", "es", 3, F.col("es"))]
    rows = layers.select("n", "layer", "ordinal", F.col("s").alias("sources"), "p", F.inline(F.concat(*parts)))
    one = rows.groupBy("n", "layer", "kind", "language", "text").agg(F.min_by(F.struct("ordinal", "o", "i", "sources", "p"), F.struct("ordinal", "o", "i")).alias("x")).select("n", "layer", "kind", "language", "text", "x.*")
    number = F.row_number().over(Window.partitionBy("n").orderBy("ordinal", "o", "i"))
    verified = F.when(F.col("kind") == "translation_hint", F.col("layer").isin(*TRUSTED))
    return one.withColumn("id", F.format_string("e%03d", number)).select("n", "id", "kind", "language", "text", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("p", F.array().cast("array<string>")).alias("p"), "layer", verified.alias("verified"))


def identified(jobs: DataFrame) -> DataFrame:
    """jobs with sourceHash (of the text) and jobId (of the fields JOB, as canonical JSON)."""
    return jobs.withColumn("sourceHash", F.sha2("sourceText", 256)).withColumn("jobId", F.sha2(canonical_json(*JOB), 256))


def evidence_jobs(rows: DataFrame) -> DataFrame:
    return identified(rows.select(F.col("n").alias("normalizedLemma"), "kind", F.col("language").alias("sourceLanguage"), F.col("text").alias("sourceText"), F.col("sources").alias("sourceIds"), F.col("p").alias("sourcePartOfSpeech"), "layer"))


def headword_jobs(entries: DataFrame, layers: DataFrame) -> DataFrame:
    """One job an entry that asks for the headword itself, with the sources of all its layers."""
    sources = layers.select("n", F.explode_outer("s").alias("v")).groupBy("n").agg(F.array_sort(F.collect_set("v")).alias("ids"))
    e = entries.select("n", "l", "p").join(sources, "n", "left")
    none = F.array().cast("array<string>")
    return identified(e.select(F.col("n").alias("normalizedLemma"), F.lit("headword").alias("kind"), F.lit("ca").alias("sourceLanguage"), F.col("l").alias("sourceText"), F.coalesce("ids", none).alias("sourceIds"), F.coalesce("p", none).alias("sourcePartOfSpeech"), F.lit("merged-headword").alias("layer")))


def selected(rows: DataFrame, entries: DataFrame, layers: DataFrame, holds: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Jobs of entries: English definitions, unless all of them have at most four words and a Catalan one has three or more; else
    Catalan ones; else verified hints; else the headword. At most `most` distinct texts each. Held (n, text) take no part."""
    r = rows if holds is None else rows.join(holds.select("n", "text"), ["n", "text"], "left_anti")
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    definition = F.col("kind") == "definition"
    r = r.withColumns({"en": definition & (F.col("language") == "en"), "ca": definition & (F.col("language") == "ca"), "hint": F.coalesce(F.col("verified"), F.lit(False))})
    seen = r.groupBy("n").agg(F.max("en").alias("any_en"), F.max("ca").alias("any_ca"), F.max(F.col("en") & (words > 4)).alias("long_en"), F.max(F.col("ca") & (words >= 3)).alias("rich_ca"))
    choice = F.when(F.col("any_en") & (F.col("long_en") | ~F.col("rich_ca")), "en").when(F.col("any_ca"), "ca").otherwise("hint")
    c = r.join(seen.select("n", choice.alias("choice")), "n").where(((F.col("choice") == "en") & F.col("en")) | ((F.col("choice") == "ca") & F.col("ca")) | ((F.col("choice") == "hint") & F.col("hint")))
    by_number = (F.length("id"), F.col("id"))  # e1000 is behind e999
    first = c.withColumn("_d", F.row_number().over(Window.partitionBy("n", "language", "text").orderBy(*by_number))).where("_d = 1")
    top = first.withColumn("_k", F.row_number().over(Window.partitionBy("n").orderBy(*by_number))).where(F.col("_k") <= most)
    jobs = evidence_jobs(top.join(entries.select("n"), "n", "left_semi"))
    return jobs.unionByName(headword_jobs(entries.join(top.select("n"), "n", "left_anti"), layers).select(jobs.columns))


def kinds(jobs: DataFrame) -> DataFrame:
    """kind, language, lemmas: lemmas by the kind of their first job."""
    one = jobs.groupBy("normalizedLemma").agg(F.min_by(F.struct("kind", F.col("sourceLanguage").alias("language")), "jobId").alias("k"))
    return one.groupBy("k.kind", "k.language").agg(F.count("*").alias("lemmas"))


def bound(published: DataFrame, jobs: DataFrame) -> DataFrame:
    """published rows whose jobId and all fields of JOB are those of a job; any other row is an error."""
    j = jobs.select(F.col("jobId").alias("_id"), *(F.col(c).alias(f"_{c}") for c in (*JOB, "sourceHash")))
    same = F.lit(True)
    for c in (*JOB, "sourceHash"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = published.join(j, F.col("jobId") == F.col("_id"), "left")
    fault = F.when(F.col("_id").isNull() | ~same, F.raise_error(F.concat(F.lit("evidence differs from its sources: "), F.col("normalizedLemma"))).cast("boolean"))
    return met.withColumn("_fault", fault).where("_fault is null").select(published.columns)


def unbound(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Evidence items (n, kind, language, text, layer, sources, p) that no row of evidence() is: a gate wants none."""
    by = ["n", "kind", "language", "text", "layer"]
    key = lambda d: d.withColumns({"_s": F.array_sort("sources"), "_p": F.array_sort("p")})
    return key(items).join(key(rows).select(*by, "_s", "_p").distinct(), [*by, "_s", "_p"], "left_anti").drop("_s", "_p")


def field_values(layers: DataFrame) -> DataFrame:
    """n, layer, field, text: every list value of a layer row under its dotted path, and the spelling (l)."""
    part = lambda f, c: F.transform(or_empty(c), lambda v: F.struct(F.lit(f).alias("field"), v.alias("text")))
    fields = [part(f, F.col(f)) for f in ("p", "pl", "zh", "es", "f", "s")] + [part(f"d.{k}", F.col(f"d.{k}")) for k in ("ca", "en", "es", "zh")] + [part("l", F.array("l"))]
    return layers.select("n", "layer", F.inline(F.concat(*fields))).distinct()


def reviewed_overlays(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """n, zh, aliases, s of reviewed senses (n, batch, ordinal, translation, aliases, sources) of entries without Chinese. A lemma
    reviewed in two batches is an error."""
    bare = entries.where(~has_chinese(F.col("zh"), F.col("d.zh"))).select("n")
    r = batches.join(bare, "n", "left_semi")
    twice = F.when(F.countDistinct("batch") > 1, F.raise_error(F.concat(F.lit("reviewed twice: "), F.col("n"))).cast("boolean"))
    listed = r.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("ordinal", "translation", "aliases", "sources"))).alias("x"), F.min("batch").alias("batch"), twice.alias("_f")).where("_f is null")
    return listed.select("n", F.array_distinct(F.transform("x", lambda v: v["translation"])).alias("zh"), F.array_distinct(F.flatten(F.transform("x", lambda v: v["aliases"]))).alias("aliases"), F.concat(F.array_distinct(F.flatten(F.transform("x", lambda v: v["sources"]))), F.array("batch")).alias("s"))


def machine_overlays(rows: DataFrame, entries: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, zh, s, terms of machine rows (n, id, ordinal, text, translation, sources) for entries without any Chinese; counters).
    A translation without Han, with a placeholder, over 2000 characters or equal to its source is an error, and so is a repeated id."""
    bad = ~F.coalesce(F.col("translation").rlike(HAN_RANGES), F.lit(False)) | F.col("translation").rlike(PLACEHOLDER) | (F.length("translation") > 2000) | (F.trim("translation") == F.trim("text"))
    fault = F.when(bad, F.raise_error(F.concat(F.lit("invalid machine translation: "), F.col("n"))).cast("boolean"))
    repeated = rows.groupBy("n", "id").count().where("count > 1").select("n", F.raise_error(F.concat(F.lit("repeated evidence: "), F.col("n"))).cast("boolean").alias("_r"))
    checked = rows.withColumn("_f", fault).where("_f is null").join(repeated, "n", "left").where("_r is null")
    done = entries.where(has_chinese(F.col("zh"), F.col("d.zh"))).select("n").unionByName(reviewed.select("n")).distinct()
    marked = checked.join(done.withColumn("done", F.lit(True)), "n", "left")
    new = marked.where("done is null").select("n", "ordinal", F.trim("translation").alias("t"), "sources", short_terms(F.col("translation")).alias("terms"))
    listed = new.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("ordinal", "t", "sources", "terms"))).alias("x"))
    out = listed.select("n", F.array_distinct(F.transform("x", lambda v: v["t"])).alias("zh"), F.array_distinct(F.concat(F.flatten(F.transform("x", lambda v: v["sources"])), F.array(F.lit("project-machine-translation")))).alias("s"), F.flatten(F.transform("x", lambda v: v["terms"])).alias("terms"))
    counters = marked.agg(F.count("*").alias("inputSenses"), F.count("done").alias("preservedExistingChineseSenses"), F.count(F.when(F.col("done").isNull(), 1)).alias("importedSenses"), F.countDistinct(F.when(F.col("done").isNull(), F.col("n"))).alias("importedLemmas"))
    return out, counters


def align_wordnet(entries: DataFrame, layers: DataFrame, wordnet: DataFrame, senses: DataFrame, terms: DataFrame) -> DataFrame:
    """n, synset, chinese, corroboration: synsets (rows synset, lang, term of `wordnet`) of entries without Chinese that have the
    entry's spelling, one of its word classes, Chinese terms, and a Spanish term that a trusted layer of the entry has too.
    Excluded senses (n, synset) and terms (synset, term) take no part."""
    bare = entries.where(~has_chinese(F.col("zh"), F.col("d.zh"))).select("n", F.transform(or_empty(F.col("p")), lambda p: F.create_map(*(F.lit(x) for pair in POS_SYNSET.items() for x in pair))[p]).alias("classes"))
    of = lambda lang: wordnet.where(F.col("lang") == lang).select("synset", "term").distinct()
    key = lambda c: normalize(F.col(c))
    ca = of("cat").select("synset", key("term").alias("n")).distinct()
    cand = ca.join(bare, "n").where(F.array_contains("classes", F.right("synset", F.lit(1)))).select("n", "synset").join(senses.select("n", "synset"), ["n", "synset"], "left_anti")
    trusted = layers.where(F.col("layer").isin(*TRUSTED)).select("n", F.explode(or_empty(F.col("es"))).alias("text")).select("n", F.explode(F.split("text", r"(?U)\s*[/；;]\s*")).alias("t")).where("t <> ''").select("n", key("t").alias("es")).distinct()
    spa = of("spa").select("synset", key("term").alias("es")).distinct()
    backed = cand.join(spa, "synset").join(trusted, ["n", "es"]).groupBy("n", "synset").agg(F.array_sort(F.collect_set("es")).alias("corroboration"))
    zh = of("cmn").join(terms.select("synset", "term"), ["synset", "term"], "left_anti").withColumn("zh", clean_chinese(F.col("term"))).where("zh is not null")
    zh = zh.groupBy("synset").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.length("zh").alias("a"), F.col("zh").alias("b")))), lambda x: x["b"]).alias("chinese"))
    return backed.join(zh, "synset").select("n", "synset", "chinese", "corroboration")


def wordnet_overlays(aligned: DataFrame) -> DataFrame:
    """n, zh (three terms a synset, distinct), aliases (all terms) of align_wordnet()."""
    x = aligned.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("synset", "chinese"))).alias("x"))
    return x.select("n", F.array_distinct(F.transform("x", lambda v: F.array_join(F.slice(v["chinese"], 1, 3), "、"))).alias("zh"), F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda v: v["chinese"])))).alias("aliases"))


def corroborated(layers: DataFrame) -> DataFrame:
    """n, text, corroborated: Spanish of the wiki layer, and whether a trusted layer of the same lemma has it (accents apart)."""
    text = lambda d: d.select("n", F.explode(or_empty(F.col("es"))).alias("text")).withColumn("key", spanish_fold(F.lower("text")))
    sure = text(layers.where(F.col("layer").isin(*TRUSTED))).select("n", "key").distinct().withColumn("ok", F.lit(True))
    return text(layers.where("layer = 'wiktionary'")).join(sure, ["n", "key"], "left").select("n", "text", F.coalesce("ok", F.lit(False)).alias("corroborated"))


def synonyms(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """jobId, target: Catalan definitions of one word that name another entry with a word class in common."""
    j = jobs.where((F.col("kind") == "definition") & (F.col("sourceLanguage") == "ca")).withColumn("_n", F.regexp_replace(normalize(F.col("sourceText")), r"\.+$", ""))
    j = j.where(F.col("_n").rlike(r"(?U)^[\w·’'-]+$") & (F.col("_n") != F.col("normalizedLemma")))
    return j.join(entries.select(F.col("n").alias("target"), "p"), F.col("_n") == F.col("target")).where(F.arrays_overlap("p", "sourcePartOfSpeech")).select("jobId", "target")


#: A gloss that is or ends with a scientific name in brackets, and what makes a gloss no plain name.
TAXON = r"^(?:([^()]{1,80})\s*)?\(([A-Z][a-z]{2,} [a-z]{3,}(?: [a-z]{3,})?)\)$"
NOT_PLAIN = r"\b(?:especially|or|and|from|used|for|of|with|in|which|that)\b|[;.]"


def taxa(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """jobId, name, label: jobs whose text is a scientific name, or a short plain gloss with one in brackets; names (name, language,
    label) with several different Chinese labels are left out, names without one have a null label."""
    gloss, name = F.regexp_extract("sourceText", TAXON, 1), F.regexp_extract("sourceText", TAXON, 2)
    plain = (gloss == "") | ((F.col("sourceLanguage") == "en") & ~gloss.rlike(NOT_PLAIN))
    j = jobs.where(plain).select("jobId", F.when(name != "", name).otherwise(F.col("sourceText")).alias("name"))
    label = F.when(F.col("language").startswith("zh") & F.col("label").rlike(HAN_RANGES), F.col("label"))
    known = names.groupBy("name").agg(F.min(label).alias("label"), F.max(label).alias("_last")).where("_last is null or label = _last").drop("_last")
    return j.join(known, "name").select("jobId", "name", "label")


def decide(jobs: DataFrame, results: DataFrame, corrections: DataFrame, remark: Column) -> DataFrame:
    """jobs with `translation` and `origin`: a correction (jobId, sourceHash, translation) before a literal `remark` before a result
    (jobId, translation). A correction with another hash, or for no job, is an error. Jobs without Han text have null."""
    c = corrections.select("jobId", F.col("translation").alias("_c"), F.col("sourceHash").alias("_h"))
    lost = corrections.join(jobs.select("jobId"), "jobId", "left_anti").agg(F.count("*").alias("_lost"))
    r = results.select("jobId", F.col("translation").alias("_r"))
    met = jobs.join(c, "jobId", "left").join(r, "jobId", "left").withColumn("_g", remark).join(F.broadcast(lost))
    stale = F.when(F.col("_lost") > 0, F.raise_error(F.lit("a correction is for no job"))).when(F.col("_h") != F.col("sourceHash"), F.raise_error(F.concat(F.lit("stale correction: "), F.col("normalizedLemma"))))
    text = F.coalesce("_c", "_g", "_r")
    ok = text.rlike(HAN)
    origin = F.when(F.col("_c").isNotNull(), "correction").when(F.col("_g").isNotNull(), "grammar").otherwise("machine")
    return met.withColumn("_s", stale).where("_s is null").withColumns({"translation": F.when(ok, text), "origin": F.when(ok, origin)}).select(*jobs.columns, "translation", "origin")


def retry(jobs: DataFrame, accepted: DataFrame, corrected: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """jobs that are neither accepted nor corrected, with the text of a pivot (jobId, language, text) where there is one."""
    left = jobs.join(accepted.select("jobId"), "jobId", "left_anti").join(corrected.select("jobId"), "jobId", "left_anti")
    return left if pivots is None else left.join(pivots.select("jobId", F.struct("language", "text").alias("pivot")), "jobId", "left")


def pending(rows: DataFrame, done: DataFrame, keys: list[str], order: str, per_lemma: int = 3, most: int | None = None) -> DataFrame:
    """The first `per_lemma` rows of each n (0: all) that are not done, at most `most`."""
    top = rows if not per_lemma else rows.withColumn("_k", F.row_number().over(Window.partitionBy("n").orderBy(order))).where(F.col("_k") <= per_lemma).drop("_k")
    left = top.join(done.select(*keys).distinct(), keys, "left_anti")
    return left if most is None else left.orderBy(order).limit(most)


def queue(entries: DataFrame, rows: DataFrame, core: DataFrame) -> DataFrame:
    """n, core, r, route of entries without Chinese: definitions, spanish-hints or needs-source, by what evidence they have; sorted when
    read by ~core, r, n."""
    missing = entries.where(~has_chinese(F.col("zh"), F.col("d.zh"))).select("n", F.coalesce("r", F.lit(MISSING_RANK)).alias("r"))
    has = rows.groupBy("n").agg(F.max((F.col("kind") == "definition") & F.col("language").isin("ca", "en")).alias("def"), F.max(F.coalesce("verified", F.lit(False))).alias("hint"))
    c = core.select("n", F.lit(True).alias("core"))
    route = F.when(F.coalesce("def", F.lit(False)), "definitions").when(F.coalesce("hint", F.lit(False)), "spanish-hints").otherwise("needs-source")
    return missing.join(has, "n", "left").join(c, "n", "left").select("n", F.coalesce("core", F.lit(False)).alias("core"), "r", route.alias("route"))


#: Characters that a job adds to a packet beside its text.
FRAME = 40
PACKET_REPORT = "_range long, head string, outcomes string, n long"


def packets(jobs: DataFrame, most_rows: int = 40, most_chars: int = 2600) -> DataFrame:
    """jobs with `packet`: runs of jobs of one language in order of jobId, cut before a job that would be one too many or take the
    packet beyond most_chars (UTF-16 units and FRAME a job); a longer job is a packet of its own. As one fold over all jobs.

    A range of the sorted jobs is streamed, a packet's counts at a time. Where a packet from before can first be cut is
    among the first most_rows jobs of a range, so a range reports what comes of a packet that begins at each of them.
    """
    size = utf16_length(F.col("sourceText")).cast("long") + FRAME
    r = ranged(jobs.withColumn("_size", size).withColumn("_language", F.coalesce("sourceLanguage", F.lit(""))), F.col("sourceLanguage"), F.col("jobId"))

    def grow(open_, language, size):
        """(whether the job begins a packet, the open packet after it: language, rows, characters)."""
        if open_ is None or open_[0] != language or open_[1] >= most_rows or open_[2] + size > most_chars:
            return True, (language, 1, size)
        return False, (language, open_[1] + 1, open_[2] + size)

    def report(batches):
        ranges: dict[int, list] = {}
        for b in batches:
            for p, at, lang, size in zip(*(b.column(c).to_pylist() for c in ("_range", "_at", "_language", "_size")), strict=True):
                held = ranges.setdefault(p, [[], {}, {}, 0])
                head, runs, same = held[:3]
                if at <= most_rows:
                    head.append((lang, size))
                    runs[at] = (None, 0)  # the open packet and packets begun of a fold that begins with this job
                met: dict[tuple, int] = {}
                for start, (open_, begun) in list(runs.items()):
                    new, open_ = grow(open_, lang, size)
                    runs[start] = open_, begun + new
                    if open_ in met:  # from here on it goes as an earlier one
                        same[start] = met[open_], begun + new - runs[met[open_]][1]
                        del runs[start]
                    else:
                        met[open_] = start
                held[3] = at + 1
        rows = []
        for p, (head, runs, same, n) in ranges.items():
            for start in sorted(same, reverse=True):  # a fold joins an earlier one only
                chain, more = start, 0
                while chain in same:
                    more += same[chain][1]
                    chain = same[chain][0]
                runs[start] = runs[chain][0], runs[chain][1] + more
            rows.append({"_range": p, "head": repr(head), "outcomes": repr(runs), "n": n})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("_range", pa.int64()), ("head", pa.string()), ("outcomes", pa.string()), ("n", pa.int64())]))

    def carry(batches):
        import ast

        open_, packet = None, -1
        for b in batches:
            out = []
            for x in b.to_pylist():
                out.append({"_in": x["_range"], "_open": repr(open_), "_packet": packet})
                head, outcomes = ast.literal_eval(x["head"]), ast.literal_eval(x["outcomes"])
                for i, (language, size) in enumerate(head):
                    new, after = grow(open_, language, size)
                    if new:
                        open_, begun = outcomes[i]
                        packet += begun
                        break
                    open_ = after
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_in", pa.int64()), ("_open", pa.string()), ("_packet", pa.int64())]))

    narrow = r.select("_range", "_at", "_language", "_size").repartition("_range").sortWithinPartitions("_range", "_at")
    told = stored(narrow.mapInArrow(report, PACKET_REPORT))
    entries = told.repartition(1).sortWithinPartitions("_range").mapInArrow(carry, "_in long, _open string, _packet long")  # a row a partition
    met = r.join(F.broadcast(stored(entries)), F.col("_range") == F.col("_in")).repartition("_range").sortWithinPartitions("_range", "_at")
    names = jobs.columns

    def number(batches):
        import ast

        last, open_, packet = None, None, 0
        for b in batches:
            out = []
            for p, start, first, lang, size in zip(*(b.column(c).to_pylist() for c in ("_range", "_open", "_packet", "_language", "_size")), strict=True):
                if p != last:
                    last, open_, packet = p, ast.literal_eval(start), first
                new, open_ = grow(open_, lang, size)
                packet += new
                out.append(packet)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int64())], [*names, "packet"])

    return met.mapInArrow(number, StructType([*jobs.schema.fields, StructField("packet", LongType())]))
