"""Numbering, folds with a carry, prefix ranges, automata and distances against plain versions."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import fuzzy as Z
from lexmill.operators import index as I
from lexmill.operators import lexicon as L
from lexmill.operators import lookup as U
from lexmill.operators.ranges import Cut, cut_pieces, numbered, prefix_top
from lexmill.sources import shards as P


def word(rng, n, letters="abé"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))


def test_numbers_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 3), word(rng, 6)) for i in range(3000)] + [(9000, None, None)]
    d = spark.createDataFrame(rows, "i long, n int, w string").repartition(7)
    got = {r.i: r.place for r in numbered(d, "place", F.col("n").desc(), F.col("w"), F.col("i")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] or "", r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    assert numbered(d.limit(0), "place", F.col("i")).count() == 0
    ones = spark.createDataFrame([(w, 1) for w in {word(rng, 9) for _ in range(900)}], "token string, n int")
    assert [r["rank"] for r in L.global_rank(ones, {"n": F.col("n")}, "token").orderBy(F.length("token"), "token").collect()] == list(range(1, ones.count() + 1))


def fold_by_hand(sizes, prefixes, target, hard, bare):
    """The shard of each record: one pass from the first to the last."""
    out, held, size, before, piece = [], 0, 2, "", 0
    for n, p in zip(sizes, prefixes, strict=True):
        own = n + (1 if held or not bare else 0)
        if held and (size + own > hard or (target is not None and size >= target and p != before)):
            piece, held, size = piece + 1, 0, 2
        held, size, before = held + 1, size + own, p
        out.append(piece)
    return out, size


def test_reports_of_ranges_tell_what_the_fold_does():
    for seed in range(1500):
        rng = random.Random(seed)
        n = rng.randint(1, 40)
        sizes, prefixes = [rng.choice((1, 3, 5, 9, 30)) for _ in range(n)], [rng.choice("ab" if seed % 3 else "a") for _ in range(n)]
        target, hard = rng.choice(((20, 30), (10, 40), (None, 25), (5, 9)))
        bare = int(target is not None)
        cut, (want, end) = Cut(target, hard), fold_by_hand(sizes, prefixes, target, hard, bare)
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 5)))) if n > 1 else []
        size = None
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            report = cut.report(np.array(sizes[a:b]), np.array([False] + [prefixes[i] != prefixes[i - 1] for i in range(a + 1, b)]), bare)
            place, size, begun = (0, *report["alone"]) if size is None else cut.enter(report, size, prefixes[a] != prefixes[a - 1])
            heads = [i - a for i in range(a, b) if i == 0 or want[i] != want[i - 1]]
            assert begun == len(heads) and place == (heads[0] if heads else None)
        assert size == end


@pytest.mark.parametrize("by_prefix", [True, False])
@pytest.mark.parametrize("letters", ["abcé", "a"])
def test_shards_are_those_of_one_fold(spark, monkeypatch, by_prefix, letters):
    """With one letter only every record is in one group of the first letter; ranges still share the work."""
    monkeypatch.setattr(P, "TARGET", 900)
    monkeypatch.setattr(P, "HARD", 1300)
    rng = random.Random(3)
    rows = list({word(rng, 40 if letters == "a" else 8, letters) + str(i): json.dumps({"n": i, "x": "é" * rng.choice((1, 9, 60, 500))}, ensure_ascii=False) for i in range(700)}.items())
    rows.sort(key=lambda r: r[0].encode("utf-16-be"))
    want, _ = fold_by_hand([len(j.encode()) for _, j in rows], [k.replace("é", "e")[:2] for k, _ in rows] if by_prefix else [""] * len(rows), 900 if by_prefix else None, 1300 if by_prefix else 900, int(by_prefix))
    d = spark.createDataFrame(rows, "key string, json string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = P.sharded(d, by_prefix).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.key: r.piece for r in out} == {k: p for (k, _), p in zip(rows, want, strict=True)}
    assert len({r._range for r in out}) > 1
    assert P.sharded(d.limit(0), by_prefix).count() == 0


def test_pieces_longer_than_ranges(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(50)], "i int, p string").repartition(5)
    out = cut_pieces(rows, Cut(None, 10_000), F.lit(10), None, F.col("i"), bare=0).collect()
    assert {r.piece for r in out} == {0} and len({r._owner for r in out}) == 1


def test_shard_files_hold_all_records_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "TARGET", 2000)
    monkeypatch.setattr(P, "HARD", 3000)
    rows = [(f"{'aé'[i % 2]}{i:04d}", json.dumps({"i": i})) for i in range(900)]
    d = spark.createDataFrame(rows, "key string, json string").repartition(4)
    made = P.write_shards(d, f"file://{tmp_path}/out", "lex")
    files = sorted(made.collect(), key=lambda r: r.id)
    assert [r.id for r in files] == [f"lex-{i:04d}" for i in range(len(files))] and sum(r.entries for r in files) == 900
    back = [r.json for r in P.read_packs(spark, f"file://{tmp_path}/out", made).orderBy("path", "ordinal").collect()]
    assert [json.loads(x)["i"] for x in back] == [json.loads(j)["i"] for _, j in sorted(rows, key=lambda r: r[0].encode("utf-16-be"))]
    (tmp_path / "out" / "lex" / "lex-0000.json.gz").write_bytes(b"other")
    with pytest.raises(Exception, match="immutable"):
        P.write_shards(d, f"file://{tmp_path}/out", "lex")
    left = [p.name for p in (tmp_path / "out" / "lex").iterdir() if p.name.startswith("_")]
    assert not left and made.count() == len(files)
    with pytest.raises(ValueError, match="more than"):
        monkeypatch.setattr(P, "PACK_ROWS", 3)
        P.write_pack(d, f"file://{tmp_path}/out", "core", "x")


def test_a_retired_shard_is_read_again(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/new")
    tries = iter([f"{tmp_path}/old", f"{tmp_path}/new"])
    assert P.with_manifest(lambda: next(tries), lambda path: spark.read.parquet(path).count()) == 3
    with pytest.raises(ZeroDivisionError):
        P.with_manifest(lambda: 0, lambda x: 1 / x)


def test_many_prefixes_equal_few(spark, monkeypatch):
    rng = random.Random(4)
    lemmas = list({word(rng, 7, "aabcé") for _ in range(4000)})
    d = spark.createDataFrame([(w, rng.randint(0, 300)) for w in lemmas], "l string, r int").repartition(6)
    q = spark.createDataFrame([(w[: rng.randint(0, 5)] + rng.choice(("", "", "z")),) for w in lemmas] + [("É",)], "q string").distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = Counter(map(tuple, I.prefix_lookup(q, d, "l", "r", 5).collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(I, "FEW_QUERIES", 10**9)
    assert many == Counter(map(tuple, I.prefix_lookup(q, d, "l", "r", 5).collect())) and q.count() > 500


def test_many_prefix_suggestions_equal_few(spark, monkeypatch):
    rng = random.Random(5)
    lemmas = list({word(rng, 5, "aabcéà") + "x" for _ in range(900)})
    lex = spark.createDataFrame([(w, w, rng.choice((None, 1, 2, 3))) for w in lemmas], "n string, l string, r long")
    q = spark.createDataFrame([(w[: rng.randint(1, 4)],) for w in lemmas], "q string")
    few = Counter(map(tuple, U.prefix_suggestions(q, lex).collect()))
    monkeypatch.setattr(I, "FEW_QUERIES", 0)
    assert few == Counter(map(tuple, U.prefix_suggestions(q, lex).collect()))


def test_a_hundred_thousand_prefixes(spark):
    rng = random.Random(6)
    rows = [(word(rng, 12, "abcdefgh"), i) for i in range(50_000)]
    asked = [(f"q{i}", word(rng, 7, "abcdefgh")) for i in range(100_000)]
    got = prefix_top(spark.createDataFrame(asked, "q string, key string"), spark.createDataFrame(rows, "key string, place long"), 3)
    best = {}
    for key, place in rows:
        for n in range(len(key) + 1):
            top = best.setdefault(key[:n], [])
            if len(top) < 3:
                top.append(place)
    assert got.count() == sum(len(best.get(k, ())) for _, k in asked)
    some = {(r.q, r.pos): r.place for r in got.where("q like 'q1%'").collect()}
    assert some == {(q, i): p for q, k in asked if q.startswith("q1") for i, p in enumerate(best.get(k, ()), 1)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_automata_equal_all_pairs(most):
    rng = random.Random(most)
    core = list({word(rng, 9, "abcé😀") for _ in range(700)} | {"x" * 80, "", "x" * 79 + "y"})
    asked = [word(rng, 9, "abcé😀") for _ in range(150)] + ["x" * 78, ""]
    want = [(i, j, e) for i, q in enumerate(asked) for j, c in enumerate(core) if (e := levenshtein(Z.units(q), Z.units(c))) <= most]
    assert sorted(Z.near(asked, Z.front_coded(core), most)) == want
    assert sorted(Z.near(asked[:-2], Z.front_coded(core), most)) == [w for w in want if w[0] < 150]


def test_fuzzy_core_orders_and_checks_its_size(spark, monkeypatch):
    core = spark.createDataFrame([("casa", "casa", 2), ("cosa", "cosa", 1), ("cases", "cases", None), ("llargament", "llargament", 5)], "n string, l string, r long")
    q = spark.createDataFrame([("cassa",), ("càsa",), ("llargumant",), ("zzz",)], "q string")
    got = {(r.q, r.pos): r.l for r in U.fuzzy_core(q, core).collect()}
    assert got == {("cassa", 1): "casa", ("cassa", 2): "cosa", ("cassa", 3): "cases", ("càsa", 1): "casa", ("càsa", 2): "cosa", ("llargumant", 1): "llargament"}
    monkeypatch.setattr(Z, "CORE_MOST", 3)
    with pytest.raises(ValueError, match="more than 3"):
        U.fuzzy_core(q, core)


def osa(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = i + j if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances_of_a_column_equal_the_table():
    rng = random.Random(7)
    pairs = [(word(rng, 6), word(rng, 6)) for _ in range(6000)] + [(word(rng, 20, "ab"), word(rng, 20, "ab")) for _ in range(300)] + [(word(rng, 80), word(rng, 90)) for _ in range(20)]
    pairs += [("a" * 63, "a" * 64), ("b" * 64, "b" * 63 + "a"), ("😀a", "a😀"), ("", "abc"), ("", "")]
    assert T.osa_all([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [osa(a, b) for a, b in pairs]
    by_bits, by_rows = [p for p in pairs if 0 < len(p[0]) < 64], 100_000
    many = [(word(rng, 9, "abcd") or "a", word(rng, 9, "abcd")) for _ in range(by_rows)]
    assert (T.osa_bits(*map(list, zip(*many, strict=True))) == T.osa_rows(*map(list, zip(*many, strict=True)))).all() and by_bits
