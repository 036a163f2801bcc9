"""Gates: coverage, integrity, order and structure of a built dictionary. Each gives rows of what is wrong, or figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, nonempty, normalize
from .sample import sample

#: Least shares of high-frequency entries, and of sources; least number of lemmas of a build.
SHARES = {"source": 1.0, "pos": 0.90, "spanish": 0.65, "meaning": 0.75}
ATTRIBUTED, LEMMAS = 0.99, 80_000


def has(entries_prefix: str = "") -> dict[str, Column]:
    """Whether an entry has each kind of content."""
    c = lambda k: nonempty(F.col(f"{entries_prefix}{k}"))
    out = {"pos": c("p"), "source": c("s"), "spanish": c("es"), "chinese": c("zh"), "catalanDefinitions": c("d.ca"), "englishGlosses": c("d.en")}
    return out | {"meaning": out["catalanDefinitions"] | out["spanish"] | out["chinese"]}


def summary(entries: DataFrame, morphology: DataFrame) -> DataFrame:
    """name, value: numbers of lemmas, forms, analyses, ambiguous forms, and of entries with each kind of content."""
    stack = lambda d: d.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, d.columns)), F.array(*(F.col(c).cast("long") for c in d.columns)))).alias("name", "value"))
    e = entries.agg(F.count("*").alias("lemmas"), *(F.count(F.when(c, 1)).alias(k) for k, c in has().items()))
    m = morphology.groupBy("surface").agg(F.count("*").alias("n")).agg(F.count("*").alias("forms"), F.coalesce(F.sum("n"), F.lit(0)).alias("analyses"), F.count(F.when(F.col("n") > 1, 1)).alias("ambiguous"))
    return stack(e).unionByName(stack(m))


def histogram(entries: DataFrame, field: str) -> DataFrame:
    """value, n: entries by each value of a list."""
    return entries.select(F.explode(F.array_distinct(field)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def flag_histogram(rows: DataFrame, field: str = "flags") -> DataFrame:
    """flag, n; and the row (needs review, n) of rows with any flag but a short source."""
    each = rows.select(F.explode(field).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    review = rows.where(F.exists(field, lambda f: f != "short-ambiguous-source")).agg(F.lit("needs-review").alias("flag"), F.count("*").alias("n"))
    return each.unionByName(review)


def coverage(entries: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """name, share of entries (or of the wanted keys among them) with each kind of content, and the share of wanted keys found."""
    if wanted is None:
        e = entries.withColumn("_found", F.lit(True))
    else:
        e = wanted.select(normalize(F.col("n")).alias("_w")).distinct().join(entries.withColumn("_found", F.lit(True)), F.col("_w") == F.col("n"), "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    share = lambda c: F.avg(F.when(c & F.col("_found"), 1.0).otherwise(0.0))
    one = e.agg(share(F.lit(True)).alias("found"), *(share(c).alias(k) for k, c in has().items()))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("name", "share"))


def below(shares: DataFrame, least: dict[str, float]) -> DataFrame:
    """name, share, least of shares under their gate."""
    table = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    return shares.withColumn("least", table[F.col("name")]).where("share < least")


def at_least(rows: DataFrame, n: int = LEMMAS) -> DataFrame:
    """One row (n), an error if there are fewer rows than `n`."""
    return rows.agg(F.count("*").alias("n")).select(F.when(F.col("n") >= n, F.col("n")).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {n} lemmas: "), F.col("n").cast("string"))).cast("long")).alias("n"))


def dangling(entries: DataFrame, morphology: DataFrame, prefixes: DataFrame, core: DataFrame) -> DataFrame:
    """gate, key, target: analyses and prefix rows (key, lemma) of lemmas that are not there, prefix keys that are not the folded
    lemma, core lemmas that are not there, analyses of core surfaces that lead out of the core."""
    heads = entries.select(F.col("n").alias("_n"))
    out = lambda d, gate, key, target: d.join(heads, F.col(target) == F.col("_n"), "left_anti").select(F.lit(gate).alias("gate"), F.col(key).alias("key"), F.col(target).alias("target"))
    rows = out(morphology, "morphology", "surface", "lemma").unionByName(out(prefixes, "prefix", "key", "lemma")).unionByName(out(core.withColumn("k", F.col("n")), "core", "k", "n"))
    wrong = prefixes.where(fold(F.col("lemma")) != F.col("key")).select(F.lit("prefix-key").alias("gate"), "key", F.col("lemma").alias("target"))
    return rows.unionByName(wrong)


def unknown_sources(entries: DataFrame, known: DataFrame) -> DataFrame:
    """n, source of sources that are not known."""
    return entries.select("n", F.explode("s").alias("source")).join(known.select("source"), "source", "left_anti").select("n", "source")


def attributed(entries: DataFrame) -> DataFrame:
    """share, ok: entries with a source; the gate wants 99 %."""
    return entries.agg(F.avg(F.when(nonempty(F.col("s")), 1.0).otherwise(0.0)).alias("share")).withColumn("ok", F.col("share") >= ATTRIBUTED)


def unsorted(rows: DataFrame, shard: str, ordinal: str, key: str) -> DataFrame:
    """Rows of a shard whose key is not behind the one before; a shard is of bounded size."""
    w = Window.partitionBy(shard).orderBy(ordinal)
    return rows.withColumn("before", F.lag(key).over(w)).where(F.col("before") >= F.col(key))


def out_of_bounds(rows: DataFrame, descriptors: DataFrame, shard: str, key: str) -> DataFrame:
    """Descriptors (shard, first, last, entries) that differ from their rows."""
    is_ = rows.groupBy(F.col(shard).alias("_s")).agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.count("*").alias("_n"))
    met = descriptors.join(is_, F.col(shard) == F.col("_s"), "full_outer")
    same = F.col("first").eqNullSafe(F.col("_first")) & F.col("last").eqNullSafe(F.col("_last")) & F.col("entries").eqNullSafe(F.col("_n"))
    return met.where(~same).select(F.coalesce(shard, "_s").alias(shard))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def round_trip(entries: DataFrame, lookup: DataFrame, n: int = 100, seed: str = "seed", *order: Column) -> DataFrame:
    """tested, found: of n sampled lemmas (in `order`, else by lemma), how many an exact lookup (rows n) finds again."""
    s = sample(entries, n, f"{seed}:lemmas", *(order or (F.col("n"),)))
    met = s.select("n").join(lookup.select(F.col("n").alias("_n")).distinct(), F.col("n") == F.col("_n"), "left")
    return met.agg(F.count("*").alias("tested"), F.count("_n").alias("found"))


def form_round_trip(morphology: DataFrame, lookup: DataFrame, n: int = 100, seed: str = "seed") -> DataFrame:
    """tested, found: of n sampled forms (surface, in its order), how many have all their lemmas among the analyses of a lookup."""
    forms = morphology.groupBy("surface").agg(F.collect_set("lemma").alias("lemmas"))
    s = sample(forms, n, f"{seed}:morphology", F.col("surface"))
    got = lookup.join(F.broadcast(s.select("surface")), "surface").groupBy("surface").agg(F.collect_set("lemma").alias("got"))
    met = s.join(got, "surface", "left")
    whole = F.size(F.array_except("lemmas", F.coalesce("got", F.array().cast("array<string>")))) == 0
    return met.agg(F.count("*").alias("tested"), F.count(F.when(whole, 1)).alias("found"))


def checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, problem of files (path, content) against expected (path, bytes, sha256): missing, size, checksum."""
    f = files.select(F.col("path").alias("_p"), F.length("content").cast("long").alias("_b"), F.sha2("content", 256).alias("_h"))
    met = expected.join(f, F.col("path") == F.col("_p"), "left")
    problem = F.when(F.col("_p").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_h"), "checksum")
    return met.withColumn("problem", problem).where("problem is not null").select("path", "problem")


def invalid_jobs(rows: DataFrame) -> DataFrame:
    """number, problem of machine jobs: a blank field, an unknown language, no sources, a hash that is not that of the text."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fields = ("normalizedLemma", "evidenceId", "sourceText", "sourceLanguage", "sourceHash")
    checks = [(blank(c), f"missing or empty {c}") for c in fields]
    checks += [
        (~F.col("sourceLanguage").isin("en", "ca", "es"), "unsupported source language"),
        (~nonempty(F.col("sourceIds")) | F.exists("sourceIds", lambda s: s.isNull() | (s == "")), "sourceIds must contain source identifiers"),
        (F.col("sourceHash") != F.sha2("sourceText", 256), "sourceHash does not match exact sourceText"),
    ]
    first = F.when(F.lit(False), F.lit(""))
    for c, what in checks:
        first = first.when(F.coalesce(c, F.lit(False)), what)
    return rows.withColumn("problem", first).where("problem is not null").select("number", "problem")


#: Fields of batches and what they may hold.
RECORD_IN = ("id", "lemma", "normalizedLemma", "partOfSpeech", "existingChinese", "priorityRank", "evidence", "inputHash")
RECORD_OUT = ("id", "lemma", "normalizedLemma", "inputHash", "status", "senses", "issues")
SENSE, ISSUE = ("sourceRefs", "partOfSpeech", "translationZh", "aliasesZh"), ("code", "sourceRefs", "noteZh")
CODES = ("source_language_mismatch", "source_conflict", "damaged_source", "form_only", "ambiguous_sense", "insufficient_evidence", "existing_chinese")
STATUSES = ("translated", "needs_review", "skipped")
NO_TEXT = r"(?i)^(?:待补充|待翻译|未翻译|省略|暂无(?:释义|中文|翻译)|请(?:在此)?(?:填写|补充)|TODO|TBD|placeholder|\.{3}|…{1,2})$"
RECORD = (
    "id string, lemma string, normalizedLemma string, inputHash string, partOfSpeech array<string>, existingChinese array<string>, priorityRank long, evidence array<struct<id:string>>, status string,"
    " senses array<struct<sourceRefs:array<string>,partOfSpeech:string,translationZh:string,aliasesZh:array<string>>>, issues array<struct<code:string,sourceRefs:array<string>,noteZh:string>>"
)


def strict_json(text: Column) -> Column:
    """The text as a variant, null if it is no JSON, repeats a key of an object, or holds NaN or Infinity."""
    return F.try_parse_json(text)


def keys_of(value: Column) -> Column:
    return F.json_object_keys(value)


def strings(value: Column, path: str, nonempty_: bool = False, unique: bool = False) -> Column:
    """array<string> of what is wrong with a list of strings."""
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    checks = [(value.isNull(), f"{path}: must be an array"), (F.exists(value, blank), f"{path}: must be nonempty strings")]
    checks += [(F.size(value) == 0, f"{path}: must not be empty")] * nonempty_ + [(F.size(F.array_distinct(value)) < F.size(value), f"{path}: duplicate value")] * unique
    return F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks))


def refs(value: Column, allowed: Column, path: str, nonempty_: bool) -> Column:
    """strings() and references that are not allowed."""
    other = F.size(F.array_except(value, allowed)) > 0
    return F.concat(strings(value, path, nonempty_, True), F.array(F.when(F.coalesce(other, F.lit(False)), f"{path}: is not evidence in this input record")))


def validate_records(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """position, error of reviewed records (position, json) against what was asked (position, json), record by record.

    Field sets are exact; ids are unique; spelling, key and hash are those of the input at the same position; the input's
    hash is that of its canonical JSON; senses and issues fit the status; references are evidence of the record;
    translations hold Han and are no placeholders; at most three aliases, trimmed, no lists.
    """

    def parsed(d: DataFrame, side: str) -> DataFrame:
        v = d.select("position", F.col("json").alias(f"{side}_json"), strict_json(F.col("json")).isNotNull().alias(f"{side}_ok"), F.from_json("json", RECORD).alias(side))
        return v.withColumn(f"{side}_keys", F.array_sort(keys_of(F.col(f"{side}_json"))))

    met = parsed(inputs, "i").join(parsed(outputs, "o"), "position", "full_outer")
    i, o = F.col("i"), F.col("o")
    allowed = F.transform(i["evidence"], lambda e: e["id"])
    exact = lambda keys, wanted: keys == F.array(*map(F.lit, sorted(wanted)))
    text = lambda c: c.isNotNull() & (F.trim(c) != "")
    status = o["status"]
    # canonical JSON without the hash: keys in order, no blanks; the input holds it as text, its hash field cut out
    bare = F.regexp_replace("i_json", r'"inputHash":"[0-9a-f]*",', "")
    checks = [
        (~F.coalesce(F.col("i_ok"), F.lit(False)), "input: not an object"),
        (~F.coalesce(F.col("o_ok"), F.lit(False)), "output: not an object"),
        (F.col("i_json").isNull(), "output: added record"),
        (F.col("o_json").isNull(), "output: missing record"),
        (~exact(F.col("i_keys"), RECORD_IN), "input: fields"),
        (~exact(F.col("o_keys"), RECORD_OUT), "output: fields"),
        (F.sha2(bare, 256) != i["inputHash"], "input.inputHash: does not match canonical input SHA-256"),
        *((~o[k].eqNullSafe(i[k]), f"output.{k}: does not match input record at the same position") for k in ("id", "lemma", "normalizedLemma", "inputHash")),
        *((~text(o[k]), f"output.{k}: must be a nonempty string") for k in ("id", "lemma", "normalizedLemma", "inputHash")),
        (~F.coalesce(status.isin(*STATUSES), F.lit(False)), "output.status: must be translated, needs_review, or skipped"),
        ((status == "skipped") & (F.size(o["senses"]) > 0), "output.senses: skipped records must have no senses"),
        (status.isin("translated", "needs_review") & (F.size(o["senses"]) < 1), "output.senses: translated and needs_review records require senses"),
        ((status == "translated") & (F.size(o["issues"]) > 0), "output.issues: translated records must have no issues"),
        (status.isin("needs_review", "skipped") & (F.size(o["issues"]) < 1), "output.issues: needs_review and skipped records require an issue"),
        ((F.size(i["existingChinese"]) > 0) & (status != "skipped"), "output.status: records with existing Chinese must be skipped"),
    ]
    own = F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks))

    def sense(s):
        zh, aliases = s["translationZh"], s["aliasesZh"]
        more = [
            (s["partOfSpeech"].isNotNull() & ~F.array_contains(F.coalesce(i["partOfSpeech"], F.array().cast("array<string>")), s["partOfSpeech"]), "senses.partOfSpeech: must be null or a part of speech in this input record"),
            (~text(zh), "senses.translationZh: must be a nonempty string"),
            (text(zh) & ~zh.rlike(r"\p{IsHan}"), "senses.translationZh: must contain Chinese characters"),
            (F.trim(zh).rlike(NO_TEXT), "senses.translationZh: placeholder text is not allowed"),
            (F.size(aliases) > 3, "senses.aliasesZh: must have at most 3 aliases"),
            (F.exists(aliases, lambda a: a.rlike("[;；]")), "senses.aliasesZh: semicolon-separated aliases are not allowed"),
            (F.exists(aliases, lambda a: a.rlike(r"(?U)^\s|\s$")), "senses.aliasesZh: surrounding whitespace is not allowed"),
        ]
        return F.concat(refs(s["sourceRefs"], allowed, "senses.sourceRefs", True), strings(aliases, "senses.aliasesZh", unique=True), F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in more)))

    def issue(s):
        more = [(~F.coalesce(s["code"].isin(*CODES), F.lit(False)), "issues.code: unsupported issue code"), (~text(s["noteZh"]), "issues.noteZh: must be a nonempty string")]
        return F.concat(refs(s["sourceRefs"], allowed, "issues.sourceRefs", False), F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in more)))

    none = F.array().cast("array<string>")
    every = F.concat(own, F.coalesce(F.flatten(F.transform(o["senses"], sense)), none), F.coalesce(F.flatten(F.transform(o["issues"], issue)), none))
    found = met.select("position", F.explode(F.array_distinct(F.filter(every, lambda e: e.isNotNull()))).alias("error"))
    ids = met.select("position", o["id"].alias("id")).where("id is not null")
    twice = ids.join(duplicates(ids, "id"), "id").select("position", F.lit("output.id: duplicate output id").alias("error"))
    return found.unionByName(twice)


def validate_batch(batch: dict, other: dict, records: int) -> list[str]:
    """What is wrong with the heads (all fields but records) of an input and an output batch of `records` records each way."""
    errors = []
    for name, b, wanted in (("input", batch, {"schemaVersion", "batchId", "recordCount", "dictionaryVersion", "sourceCommit", "selection"}), ("output", other, {"schemaVersion", "batchId", "recordCount"})):
        if set(b) - {"records"} != wanted:
            errors.append(f"{name}: fields")
        if type(b.get("schemaVersion")) is not int or b["schemaVersion"] != 1:
            errors.append(f"{name}.schemaVersion: must be 1")
        if b.get("recordCount") != records:
            errors.append(f"{name}.recordCount: does not match records length")
        errors += [f"{name}.{k}: must be a nonempty string" for k in sorted(wanted - {"schemaVersion", "recordCount"}) if not isinstance(b.get(k), str) or not b[k].strip()]
    if batch.get("batchId") != other.get("batchId"):
        errors.append("output.batchId: does not match input")
    return errors
