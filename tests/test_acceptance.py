"""The seeded sample, packets, the acceptance run and concepts against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import acceptance as A
from lexmill.operators import evidence as V
from lexmill.operators import gates as G
from lexmill.operators import sample as M
from lexmill.operators import search as R


def shuffled(n, count, seed):
    """The first places of a shuffle from the last place down, done in full."""
    h = 2166136261
    for c in seed:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    state, places = float(h), list(range(n))
    for i in range(n - 1, 0, -1):
        state += 0x6D2B79F5
        v = int(state) & 0xFFFFFFFF
        v = ((v ^ (v >> 15)) * (v | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        j = int(((v ^ (v >> 14)) & 0xFFFFFFFF) / 4294967296 * (i + 1))
        places[i], places[j] = places[j], places[i]
    return places[:count]


def test_sample_equals_the_whole_shuffle(monkeypatch):
    for n, count, seed in ((1, 1, ""), (2, 2, "a"), (7, 3, "s:lemmas"), (100, 100, "é"), (5000, 100, "seed:lemmas"), (4999, 7, "😀")):
        assert M.sampled_places(n, count, seed) == shuffled(n, count, seed)
    monkeypatch.setattr(M, "CHUNK", 37)
    for n in (36, 37, 38, 39, 75, 1000):
        assert M.sampled_places(n, min(n, 20), "x") == shuffled(n, min(n, 20), "x")
    with pytest.raises(ValueError, match="cannot sample"):
        M.sampled_places(3, 4, "x")


def test_sample_where_doubles_lose_bits():
    """Beyond 2 ** 53 the generator's state is rounded as doubles are; the first drawn numbers are those of the last places."""
    n = 6_000_000
    assert M.sampled_places(n, 3, "seed") == shuffled(n, 3, "seed")


def test_sampled_rows(spark):
    d = spark.createDataFrame([(f"k{i:04d}",) for i in range(900)], "n string").repartition(5)
    got = [r.n for r in M.sample(d, 100, "seed:lemmas", F.col("n")).orderBy("_pick").collect()]
    assert got == [f"k{i:04d}" for i in shuffled(900, 100, "seed:lemmas")]
    assert G.round_trip(d, d.where("n < 'k0450'")).first().asDict() == {"tested": 100, "found": sum(x < "k0450" for x in got)}


def packets_by_hand(jobs, most_rows, most_chars):
    out, open_ = {}, None
    packet = -1
    for language, i, text in jobs:
        size = len(text.encode("utf-16-le")) // 2 + 40
        if open_ is None or open_[0] != language or open_[1] >= most_rows or open_[2] + size > most_chars:
            packet, open_ = packet + 1, (language, 0, 0)
        open_ = (language, open_[1] + 1, open_[2] + size)
        out[i] = packet
    return out


@pytest.mark.parametrize("most", [(40, 2600), (3, 200), (5, 10_000)])
def test_packets_are_those_of_one_fold(spark, most, monkeypatch):
    rng = random.Random(most[0])
    jobs = sorted((rng.choice(("ca", "en", "en", "en")), f"j{i:05d}", "é" * rng.choice((1, 20, 90, 700))) for i in range(2500))
    d = spark.createDataFrame(jobs, "sourceLanguage string, jobId string, sourceText string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.jobId: r.packet for r in V.packets(d, *most).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == packets_by_hand(jobs, *most)


def test_a_million_jobs_of_one_language_in_packets(spark):
    jobs = spark.range(1_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("jobId"), F.lit("en").alias("sourceLanguage"), F.repeat(F.lit("x"), (F.col("id") % 200).cast("int")).alias("sourceText"))
    got = V.packets(jobs).groupBy("packet").agg(F.count("*").alias("n"), F.sum(F.length("sourceText") + 40).alias("c"))
    r = got.agg(F.max("n").alias("n"), F.max("c").alias("c"), F.sum("n").alias("all"), F.count("*").alias("packets"), F.max("packet").alias("last")).first()
    assert r.n <= 40 and r.c <= 2600 and r["all"] == 1_000_000 and r.packets == r.last + 1


def test_acceptance_reads_each_table_once_and_equals_the_gates(spark):
    entries = [(f"k{i}", ["noun"] if i % 4 else None, ["s1"] if i % 10 else ["s9"], ["x"] if i % 2 else None, None, (None, ["g"] if i % 3 == 0 else None)) for i in range(200)] + [("k1", ["verb"], None, None, None, None), (" ", None, None, None, None, None)]
    e = spark.createDataFrame(entries, "n string, p array<string>, s array<string>, es array<string>, zh array<string>, d struct<ca:array<string>,en:array<string>>")
    m = spark.createDataFrame([("k1s", "k1"), ("k2s", "gone"), ("", "k3"), ("k5", "k150")], "surface string, lemma string")
    p = spark.createDataFrame([("k1", "k1"), ("x", "k2"), ("gone", "gone")], "key string, lemma string")
    core = spark.createDataFrame([(f"k{i}",) for i in range(20)] + [("none",)], "n string")
    got = {r.gate: r for r in A.run(e, m, p, core, spark.createDataFrame([("s1",)], "source string"), core, lemmas=150, lookup=e.where("n <> 'k7'")).collect()}
    values = {k: r.value for k, r in got.items()}
    assert values["lemmas"] == 202 and got["lemmas"].ok and values["blank lemmas"] == 1 and values["repeated lemmas"] == 1
    assert values["dangling analyses"] == 1 and values["dangling prefixes"] == 1 and values["dangling core"] == 1 and values["wrong prefix keys"] == 1 and values["blank analyses"] == 1
    assert values["unknown sources"] == 20 and values["core analyses out of the core"] == 1
    shares = {r.name: r.share for r in G.coverage(e).collect()}
    assert all(abs(values[f"share {k}"] - shares[k]) < 1e-12 for k in ("pos", "source", "spanish", "meaning"))
    frequent = {r.name: r.share for r in G.coverage(e.dropDuplicates(["n"]), core).collect()}
    assert abs(values["frequent found"] - frequent["found"]) < 1e-12 and not got["frequent found"].ok
    assert abs(values["attributed"] - G.attributed(e).first().share) < 1e-12
    sampled = [([*sorted(x[0] for x in entries)][i]) for i in shuffled(202, 100, "seed:lemmas")]
    assert values["lemmas found again"] == sum(x != "k7" for x in sampled)
    assert values["forms found again"] == 4 and {r.gate for r in A.failed(spark.createDataFrame(list(got.values()), A.GATE)).collect()} >= {"repeated lemmas", "unknown sources"}


CONCEPT = "id string, lemma string, label string, part string, evidence array<struct<layer:string,field:string,text:string>>, expressions array<string>"


def test_concepts_and_their_problems(spark):
    entries = spark.createDataFrame([("gat", ["noun"], 3), ("gos", ["noun"], 2), ("cantar", ["verb"], 1)], "n string, p array<string>, r long")
    layers = spark.createDataFrame([("gat", "lex", ["noun"], "zh", "猫"), ("gat", "wiktionary", ["noun"], "d.en", "cat"), ("gos", "lex", ["noun"], "zh", "狗"), ("cantar", "lex", None, "zh", "唱")], "n string, layer string, p array<string>, field string, value string")
    terms = spark.createDataFrame([("gat", "猫", "translation", None, 3), ("gos", "狗", "translation", None, 2), ("gat", "狗", "translation", None, 3), ("cantar", "唱歌", "translation", None, 1)], "lemma string, term string, kind string, priority int, rank long")
    index = R.build_index(terms, "zh")
    good = [("cat-1", "gat", "猫", "noun", [("lex", "zh", "猫")], ["会叫的动物", "抓老鼠的"])]
    bad = {
        "X": ("gat", "猫", None, [("lex", "zh", "猫")], ["一"], "invalid or repeated id"),
        "long-1": ("gat", "猫" * 25, None, [("lex", "zh", "猫")], ["一"], "invalid lemma or label"),
        "verb-1": ("gat", "猫", "verb", [("lex", "zh", "猫")], ["一"], "class is not the entry's"),
        "none-1": ("gat", "猫", None, [], ["一"], "no evidence"),
        "same-1": ("gat", "猫", None, [("lex", "zh", "猫")], ["一", "一"], "no or repeated expressions"),
        "expr-1": ("gat", "猫", None, [("lex", "zh", "猫")], ["a"], "invalid expression"),
        "fld-1": ("gat", "猫", None, [("lex", "ipa", "猫")], ["一"], "unknown evidence field"),
        "es-1": ("gat", "猫", None, [("wiktionary", "es", "gato")], ["一"], "unverified Spanish evidence"),
        "dog-1": ("gat", "狗", None, [("lex", "zh", "猫")], ["一"], "label does not select its lemma"),
        "ev-1": ("gos", "狗", None, [("lex", "zh", "狼")], ["一"], "evidence is not in its layer"),
        "cls-1": ("cantar", "唱歌", "verb", [("lex", "zh", "唱")], ["一"], "evidence does not support its class"),
    }
    rows = good + [(i, *v[:5]) for i, v in bad.items()]
    problems = {(r.id, r.problem) for r in R.concept_problems(spark.createDataFrame(rows, CONCEPT), entries, layers, index).collect()}
    assert not any(i == "cat-1" for i, _ in problems) and all((i, v[5]) in problems for i, v in bad.items())
    mixed = [("a-1", "gat", "猫", "noun", [("lex", "zh", "猫")], ["一"]), ("b-1", "gat", "猫", "verb", [("lex", "zh", "猫")], ["一"])]
    found = Counter(r.problem for r in R.concept_problems(spark.createDataFrame(mixed, CONCEPT), entries, layers, index).collect())
    assert found["conflicting classes of an expression"] == 2
    read = R.expression_rows(spark.createDataFrame(good, CONCEPT), entries)
    hits = R.expressions(spark.createDataFrame([("抓老鼠的",), ("？",)], "q string"), read).collect()
    assert [(r.q, r.lemma, r.label, r.concept, r.sense_pos) for r in hits] == [("抓老鼠的", "gat", "猫", "cat-1", "noun")]
