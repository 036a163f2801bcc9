"""Chinese suggestions of many queries: results against all pairs, and the number of pairs that are looked at."""

import random

from pyspark.sql import functions as F

from lexmill.functions.han import readings
from lexmill.operators import search as R

DIGITS = "天地人日月山水火木金"
SOUND = {c: str(i // 2) for i, c in enumerate(DIGITS)}


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def best(q, rows, sounds):
    """(key, kind) of the eight best, by the rules over all pairs."""
    most = 1 if len(q) < 6 else 2
    met = []
    for key, rank in rows:
        far = 1.5 if len(key) > max(12, len(q) + 8) or (len(key) > 8 and "，" in key) else 0
        changed = sum(x != y for x, y in zip(q, key, strict=False))
        if q in key or (len(q) > 2 and q == key + "的"):
            score = 0 if q == key else 0.5 if q not in key else (1 if key.startswith(q) else 2) + far
            met.append((score, len(key), rank, key, {0: "exact", 0.5: "related", 1: "prefix", 2.5: "prefix"}.get(score, "contains")))
        elif len(q) > 1 and sounds and len(q) == len(key) and 0 < changed <= (2 if len(q) > 4 else 1) and changed < len(q) and [SOUND.get(c, c) for c in q] == [SOUND.get(c, c) for c in key]:
            met.append((1.75 + changed * 0.1, len(key), rank, key, "fuzzy"))
        elif len(q) > 1 and abs(len(q) - len(key)) <= most and (n := osa(q, key)) <= most:
            met.append((4 + n * 0.25 + abs(len(key) - len(q)) * 0.15, len(key), rank, key, "fuzzy"))
    sure = [m for m in met if m[4] != "fuzzy"]
    if min((m[0] for m in sure), default=9) > 1:
        alike = [m for m in met if m[4] == "fuzzy" and m[0] < 4]
        plain = min((m[0] for m in sure), default=9) <= 2
        sure += alike or ([] if plain else [m for m in met if m[4] == "fuzzy"])
    return [(m[3], m[4]) for m in sorted(sure)[:8]]


def test_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice(DIGITS) for _ in range(rng.randint(a, b)))
    keys = sorted({word(1, 9) for _ in range(150)} | {word(4, 5) + "，" + word(5, 30) for _ in range(10)})
    rows = spark.createDataFrame([(x, x, x, i) for i, x in enumerate(keys)], "key string, term string, lemma string, rank long")
    asked = {word(1, 9) for _ in range(60)} | {x[:-2] + x[:-3:-1] for x in keys if len(x) > 3} | {x[1:] + "人" for x in keys} | {x + "的" for x in keys[:20]} | {x[:5] for x in keys} | {keys[3] + word(20, 20)} | {x[:18] for x in keys if len(x) > 20}
    q = spark.createDataFrame([(x,) for x in asked], "q string")
    for read in (None, readings(SOUND)):
        got = {}
        for x in R.suggest_chinese(q, rows, read=read).orderBy("q", "pos").collect():
            got.setdefault(x.q, []).append((x.term, x.kind))
        assert got == {x: b for x in asked if (b := best(x, [(k, i) for i, k in enumerate(keys)], read))}
        assert {k for g in got.values() for _, k in g} == {"exact", "related", "prefix", "contains", "fuzzy"}


def test_pairs_follow_the_input(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "osa_distance", lambda *a: seen.append(a) or F.lit(9))
    n = 1200
    k = F.translate(F.col("id").cast("string"), "0123456789", DIGITS)
    rows = spark.range(1000, 1000 + n).select(k.alias("key"), k.alias("term"), k.alias("lemma"), F.col("id").alias("rank"))
    q = rows.select(F.concat(F.lit("查一下"), "key").alias("q"))
    keyed = q.select("q", F.col("q").alias("k"), F.length("q").alias("n"), F.lit(2).alias("most"))
    held = rows.withColumn("len", F.length("key"))
    assert R.contained(keyed.withColumn("k", F.substring("q", 4, 4)).withColumn("n", F.lit(4)), held).count() == n
    assert R.misspelled(keyed, held, F.lit(True)).count() == 0
    near = R.misspelled(keyed.withColumn("k", F.concat(F.substring("q", 4, 4), F.lit("一一"))).withColumn("n", F.lit(6)), held, F.lit(True))
    assert near.count() <= 20 * n
    assert R.suggest_chinese(q, rows).count() == 0 and seen
