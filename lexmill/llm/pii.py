"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns (e-mail, IP address, card, phone) give the seeds. Base spans and all other tokens with a digit or '@' are
the instances; the word before one, its digit runs as 9, is a lexical pattern it occurs under, and so is that word with
the instance's shape (digit and letter runs, in lower case). Patterns and instances make a graph: a pattern's confidence
is the mean score of its distinct instances, an instance scores 1 if it is a seed, else the mean confidence of its
patterns. Patterns with SUPPORT distinct seeds and a confidence of at least CONFIDENT discover the instances that no base
pattern covers, of kind `context`; these are seeds of the next round, so that they make their other patterns known.
Rounds go on until one discovers nothing, ROUNDS of them at least. Base spans always stay. Tokens end at white space, brackets,
quotes and the marks : = , ; |, and at a full stop, ! or ? that nothing follows.

Null and empty texts have no spans. Repeated rows give repeated rows and count once as instances. doc_ids may be null or
repeated. Other columns are not read. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

KINDS = ("email", "ip", "card", "phone", "context")
#: The base patterns. Quantifiers are possessive where that can't change a match: no deep recursion. A match
#: begins where its run does, or where the last one ended: from inside a run it would fail at the same place, once for
#: each character of the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: A word and a gap, and ahead of them a token with a digit or '@' (group 1), itself the next one's word.
BETWEEN = r"""\s:=,;"'()<>\[\]{}|"""
CONTEXT = rf"(?<![^{BETWEEN}])[^{BETWEEN}]++[{BETWEEN}]++(?=([^{BETWEEN}0-9@]*+[0-9@](?:[^{BETWEEN}]*[^{BETWEEN}.!?])?))"
ROUNDS, SUPPORT, CONFIDENT = 3, 5, 0.8
#: Characters of a stretch of text whose spans are looked at together.
BLOCK = 4096


#: Matches whose places are added up together: an array grows by one copy of itself for each of its items.
TOGETHER = 256
SPAN = "struct<start:int,end:int,m:string>"


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, also where `use` has lambdas, which compute what they name each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums(sizes: Column) -> Column:
    """array<int>: for each item the sum of those before it."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches: by the pieces between them.

    Places are sums of the sizes before: of TOGETHER items at a time, then of these groups.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("size"), m.alias("m")))
    grouped = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / TOGETHER).cast("int")), lambda k: F.slice(b, k * TOGETHER + 1, F.lit(TOGETHER)))
    wide = lambda groups: F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x["before"] + x["size"]))

    def placed(g, at):
        return F.zip_with(g, _sums(F.transform(g, lambda x: x["before"] + x["size"])), lambda x, before: F.struct((at + before + x["before"]).alias("start"), (at + before + x["before"] + x["size"]).alias("end"), x["m"].alias("m")))

    every = lambda b: once(grouped(b), lambda groups: F.flatten(F.zip_with(groups, _sums(wide(groups)), placed)))
    return once(both, lambda b: F.when(F.size(b) > 0, every(b)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the check sum: every other one from the right but one is doubled, its digits added."""
    back = F.split(F.reverse(digits(m)), "")
    add = F.transform(back, lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int"))
    return F.aggregate(add, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    """The spans of each base kind; a kind's pattern runs only over texts that hold its mark."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")
    some = lambda mark, kind: F.when(text.rlike(mark), found(text, PATTERNS[kind])).otherwise(none)
    size = lambda m: F.length(digits(m))
    return {
        "email": some("@", "email"),
        "ip": F.filter(some(r"[0-9]\.[0-9]", "ip"), lambda x: x["m"].rlike(IP_PARTS)),
        "card": F.filter(some(r"[0-9][\x20-]?[0-9]", "card"), lambda x: size(x["m"]).between(12, 19) & luhn(x["m"])),
        "phone": F.filter(some(r"\+[0-9]", "phone"), lambda x: size(x["m"]).between(9, 15)),
    }


def near(text: Column, spans: Column) -> Column:
    """array<struct<word, start, end, instance, seed>>: the base spans that begin in a token, or the token if none touches it."""
    none = F.expr("cast(array() as array<struct<word:string,start:int,end:int,instance:string,seed:boolean>>)")
    item = lambda word, s, e, m, seed: F.struct(word.alias("word"), s.alias("start"), e.alias("end"), m.alias("instance"), F.lit(seed).alias("seed"))
    tokens = F.regexp_extract_all(text, F.lit(CONTEXT), F.lit(1))
    both = F.zip_with(found(text, CONTEXT), tokens, lambda x, m: F.struct(F.regexp_extract(x["m"], rf"^[^{BETWEEN}]+", 0).alias("word"), x["end"].alias("s"), (x["end"] + F.length(m)).alias("e"), m.alias("m")))

    # spans by stretches of BLOCK characters that they touch, so that a token looks at those near it
    last = F.floor(F.length(text) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.filter(spans, lambda b: (b["start"] < (k + 1) * BLOCK) & (b["end"] > k * BLOCK)))

    def instances(x, held):
        first = F.floor(x["s"] / BLOCK).cast("int")
        parts = F.slice(held, first + 1, F.floor(x["e"] / BLOCK).cast("int") - first + 1)
        touch = F.flatten(F.transform(parts, lambda part, i: F.filter(part, lambda b: (b["start"] < x["e"]) & (b["end"] > x["s"]) & ((i == 0) | (b["start"] >= (first + i) * BLOCK)))))
        own = F.transform(F.filter(touch, lambda b: b["start"] >= x["s"]), lambda b: item(x["word"], b["start"], b["end"], b["m"], True))
        return F.when(F.size(touch) > 0, own).otherwise(F.array(item(x["word"], x["s"], x["e"], x["m"], False)))

    return F.when(text.rlike("[0-9@]"), once(blocks, lambda held: F.flatten(F.transform(both, lambda x: instances(x, held))))).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end>> by start, then kind."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = base(F.col("text"))
    named = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    plain = F.concat(*(F.transform(kinds[KINDS[k]], named(k)) for k in range(4)))
    bare = F.array_sort(F.concat(*(kinds[KINDS[k]] for k in range(4))))
    rows = t.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.array_sort(plain).alias("spans"), bare.alias("bare"))
    rows = materialize(rows.select("doc_id", "row", "spans", near(F.col("text"), F.col("bare")).alias("near")))
    one = rows.select("row", F.inline("near"))
    shape = F.regexp_replace(F.regexp_replace(F.lower("instance"), "[0-9]+", "9"), "[a-z]+", "a")
    word = F.regexp_replace(F.lower("word"), "[0-9]+", "9")
    occurs = materialize(one.select("row", "start", "end", F.array(word, F.concat_ws(" ", word, shape)).alias("patterns"), "instance", "seed"))
    seen = occurs.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")).withColumn("score", F.col("seed").cast("double")))
    known = None
    for k in itertools.count():
        patterns = edges.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum("seed").alias("support"))
        sure = (F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)
        scores = edges.join(patterns, "pattern").groupBy("instance").agg(F.max(F.greatest("seed", sure.cast("int"))).alias("known"), F.avg("confidence").alias("mean"))
        after = edges.join(scores, "instance").select("pattern", "instance", F.col("known").alias("seed"), F.greatest(F.col("known").cast("double"), "mean").alias("score"))
        after = materialize(after)
        forget(edges)
        edges, before, known = after, known, after.agg(F.sum("seed")).first()[0]
        if k + 1 >= ROUNDS and known == before:
            break
    patterns = edges.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum("seed").alias("support"))
    sure = patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern")
    left = occurs.where(~F.col("seed")).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = left.join(sure, "pattern").groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
    spans = F.when(F.col("new").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "new")))
    return rows.select("doc_id", "row", "spans").join(new, "row", "left").select("doc_id", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op10_pii."""
    s = scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return s.select("doc_id", *(count(k) for k in range(4)), F.sha2(span_text(F.filter("spans", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), count(4), F.size("spans").cast("long").alias("n_found"))
