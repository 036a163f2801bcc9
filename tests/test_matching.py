"""Longest matches against a walk character by character."""

import random
import time

from pyspark.sql import functions as F

from lexmill.functions import han as H
from lexmill.functions.matching import Longest


def by_hand(table, text):
    out, i = [], 0
    most = max(map(len, table), default=0)
    while i < len(text):
        w = next((w for w in range(min(most, len(text) - i), 0, -1) if text[i : i + w] in table), 0)
        out.append((text[i : i + (w or 1)], w > 0))
        i += w or 1
    return out


def tables(rng):
    letters = "學校发发長城a😀\ud800"
    keys = {"".join(rng.choice(letters) for _ in range(rng.choice((1, 1, 2, 3, 5)))) for _ in range(rng.choice((0, 1, 5, 60)))}
    return {k: "".join(rng.choice("学x") for _ in range(rng.randint(0, 3))) for k in keys}, ["".join(rng.choice(letters + "zß") for _ in range(rng.randint(0, 30))) for _ in range(rng.choice((1, 5, 200)))]


def test_pieces_equal_a_walk():
    for seed in range(60):
        table, texts = tables(random.Random(seed))
        keys = list(table)
        points, at, places, key = Longest(keys).cut(texts)
        flat = "".join(texts)
        got = [(flat[p : p + (len(keys[k]) if k >= 0 else 1)], k >= 0) for p, k in zip(places.tolist(), key.tolist(), strict=True)]
        assert got == [x for t in texts for x in by_hand(table, t)]


def test_conversion_and_readings_of_columns(spark):
    for seed in (1, 2, 3):
        table, texts = tables(random.Random(seed))
        texts = [t.replace("\ud800", "b") for t in texts]
        table = {k.replace("\ud800", "c"): v for k, v in table.items()}
        d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, q string")
        got = {r.i: (r.c, r.r) for r in d.select("i", H.converter(table)(F.col("q")).alias("c"), H.readings({}, {k: list(v) for k, v in table.items()})(F.col("q")).alias("r")).collect()}
        assert got.pop(len(texts)) == (None, None) and got.pop(len(texts) + 1) == ("", [])
        assert got == {i: ("".join(table[k] if known else k for k, known in by_hand(table, t)), [r for k, known in by_hand(table, t) for r in (list(table[k]) if known else [k])]) for i, t in enumerate(texts)}


def test_a_large_table_and_long_texts_take_seconds():
    rng = random.Random(9)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    keys = list({"".join(rng.choice(han) for _ in range(rng.randint(1, 6))) for _ in range(50_000)})
    began = time.time()
    match = Longest(keys)
    built = time.time() - began
    texts = ["".join(rng.choice(han) for _ in range(1_000_000)), *("".join(rng.choice(keys) for _ in range(20)) for _ in range(5000))]
    began = time.time()
    match.cut(texts)
    assert built < 20 and time.time() - began < 10


def test_retained_phrases():
    sounds = {"长": "chang", "城": "cheng", "校": "xiao"}
    phrases = {"校长": ["xiao", "zhang"], "长城": ["chang", "cheng"], "新校长": ["xin", "xiao", "zhang"], "长": ["chang"], "校城": ["xiao"]}
    assert set(H.retained_phrases(sounds, phrases)) == {"校长", "新校长"}
    blocked = {"长校长": ["chang", "xiao", "zhang"], "城长城": ["cheng", "chang", "cheng"], "校长": ["xiao", "zhang"]}
    assert set(H.retained_phrases(sounds | {"长": "chang"}, blocked)) == {"长校长", "校长"}
