"""Literal vectors: text functions, order independence, overlays, state, sources, the streaming twin."""

import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I
from lexmill.operators import lexicon as L
from lexmill.operators import state as S
from lexmill.sources import readers as R
from lexmill.streaming import kv
from lexmill.streaming.kv import state, upsert_stream


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("x,y", [("ABC  d", "abc d"), ("L’Hora", "l'hora"), ("coŀlegi", "col·legi"), ("", "")])
def test_normalize(spark, x, y):
    assert one(spark, T.normalize, x) == y


def test_spanish_key_keeps_enye(spark):
    assert [one(spark, T.spanish_key, x) for x in ("CAMIÓN", "niño", "nino", "Pingüino")] == ["camion", "niño", "nino", "pinguino"]


@pytest.mark.parametrize("a,b,d", [("escuela", "esceula", 1), ("ca", "abc", 3), ("", "ab", 2), ("a", "a", 0)])
def test_osa(a, b, d):
    assert min(int(T.osa_all([a], [b])[0]), 5 + 1) == d


def test_osa_bound():
    assert T.osa_all(["aaaa"], ["bbbb"]).tolist() == [4]


def test_overlay_never_overwrites(spark):
    base = spark.createDataFrame([(1, "own"), (2, None), (3, None)], "k int, v string")
    over = spark.createDataFrame([(1, "new"), (2, "new")], "k int, n string")
    assert sorted(L.overlay(base, over, "k", "v", "n").collect(), key=str) == sorted([(1, "own"), (2, "new"), (3, None)], key=str)


def test_merge_layers_does_not_depend_on_row_order(spark):
    data = [("a", "x", 1, 1), ("a", "y", 0, 5), ("a", "x", 0, 7), ("b", "z", 2, 1)]
    out = [sorted(L.merge_layers(spark.createDataFrame(d, "k string, v string, p int, o int").repartition(3), "k", "v", "p", "o").collect()) for d in (data, data[::-1])]
    assert out[0] == out[1] == [("a", ["y", "x"], 2), ("b", ["z"], 1)]


def test_ranked_equals_top_k(spark):
    counts = spark.createDataFrame([("a", 3), ("bb", 3), ("c", 5), ("d", 1), ("e", 1)], "token string, n long")
    full = sorted((r["rank"], r["token"]) for r in L.ranked(counts).collect())
    assert full == sorted((r["rank"], r["token"]) for r in L.ranked(counts, k=9).collect()) == [(1, "c"), (2, "a"), (3, "bb"), (4, "d"), (5, "e")]


def test_fuzzy_equals_all_pairs(spark):
    words = ["escuela", "esceula", "escuelas", "scuela", "xscuela", "esuc", "e", "", "ab", "ba"]
    df = spark.createDataFrame([(w,) for w in words], "q string")
    got = {(r.q, r.term) for r in I.fuzzy(df, df.select(F.col("q").alias("term"))).collect()}
    assert got == {(a, b) for a in words for b in words if min(int(T.osa_all([a], [b])[0]), 1 + 1) <= 1}


def test_compare_and_swap_needs_all_versions(spark):
    stored = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 7, "c")], "k int, v int, x string")
    changes = spark.createDataFrame([(1, 5, "A"), (2, None, "B"), (3, 8, "C")], "k int, v int, x string")
    out = S.compare_and_swap(stored, changes, "k", ["v"], "x").orderBy("k").collect()
    assert [(r.x, r.swapped) for r in out] == [("A", True), ("B", True), ("c", False)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"word":"x","senses":[{"form_of":["y"],"tags":[]}]}\n{"word":"z","senses":[{"form_of":[],"tags":["noun"]}]}\n{"word":"n","senses":[]}\n')
    df = R.json_lines(spark, str(tmp_path / "a.jsonl"), "word string, senses array<struct<form_of:array<string>,tags:array<string>>>")
    forms, others = R.route_forms(df)
    assert [r.word for r in forms.collect()] == ["x"] and sorted(r.word for r in others.collect()) == ["n", "z"]
    (tmp_path / "b.jsonl").write_text('{"word": oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        R.json_lines(spark, str(tmp_path / "b.jsonl"), "word string").collect()
    (tmp_path / "c.tsv").write_text("# note\na\tb\tc\n")
    assert R.tab_separated(spark, str(tmp_path / "c.tsv"), "a string, b string, c string").collect() == [("a", "b", "c")]
    (tmp_path / "d.xml").write_text("<d><entry><orth>un</orth></entry><entry><orth>dos</orth></entry></d>")
    assert sorted(r.orth for r in R.xml_rows(spark, str(tmp_path / "d.xml"), "entry", "orth string").collect()) == ["dos", "un"]
    R.write_version(spark.range(5), str(tmp_path / "out"), "v1", "id")
    with pytest.raises(Exception, match="(?i)exist"):
        R.write_version(spark.range(5), str(tmp_path / "out"), "v1", "id")


def test_markup(spark):
    assert one(spark, R.strip_markup, "a {{x|{{y}}}} [[t|b]] ''c''<ref>n</ref>") == "a b c"
    assert one(spark, lambda x: R.section(x, "==", "Noun"), "== Verb ==\nv\n== Noun ==\nn1\nn2\n== Z ==\nz") == "n1\nn2"


def test_markup_reaches_the_fix_point(spark):
    for x in ("a " + "{{x|" * 9 + "y" + "}}" * 9 + " b", "{" + "{{x}}" + "{y}} c", "}}{{a}} {{{b}}} {{", "{{a}} {{b {{c}} {{d {{e}}}}}}", "}" * 9 + "{{a{{b}}}}", "plain"):
        want = x
        while (once := re.sub(r"\{\{[^{}]*\}\}", "", want)) != want:
            want = once
        assert one(spark, R.strip_markup, x) == " ".join(want.split())


def streamed(spark, tmp_path, batches, schema):
    """Batches put into a folder one after the other, each a run of the query."""
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "ck")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_stream(spark, src, "k", ["t"], target, checkpoint).awaitTermination()
        yield i, target


def test_stream_equals_batch(spark, tmp_path):
    """Late rows in later batches lose; a key that no batch touches stays."""
    schema = "k int, t int, v string"
    batches = [[(i % 3, i, f"v{i}") for i in range(12)], [(7, 1, "once")], [(0, 2, "late"), (1, 99, "new")], [(2, 0, "late"), (8, 1, "x")]]
    every = []
    for i, target in streamed(spark, tmp_path, batches, schema):
        every += batches[i]
        df = spark.createDataFrame(every, schema)
        assert sorted(state(spark, target, df.schema, "k", ["t"]).collect()) == sorted(S.latest(df, "k", "t").collect())
    assert state(spark, str(tmp_path / "none"), df.schema, "k", ["t"]).count() == 0


def test_stream_replays_and_broken_merges(spark, tmp_path):
    schema = "k int, t int, v string"
    for _, target in streamed(spark, tmp_path, [[(i, j, "x") for i in range(5)] for j in range(5)], schema):
        pass
    d = spark.createDataFrame([(0, 0, "x")], schema)
    want = sorted(state(spark, target, d.schema, "k", ["t"]).collect())
    covering = kv.runs(spark, target)
    assert covering[0].first == 0 and covering[-1].last == 4
    # a merge that broke off has no mark; a replayed batch that is merged already is covered
    d.write.parquet(f"{target}/run-0-9")
    (tmp_path / "t" / "run-0-9" / "_SUCCESS").unlink()
    d.withColumn("t", F.lit(1)).write.parquet(f"{target}/run-1-1")
    assert kv.runs(spark, target) == [r for r in covering if r.first != 1 or r.last != 1]
    assert sorted(state(spark, target, d.schema, "k", ["t"]).collect()) == want


def test_a_small_batch_does_not_rewrite_a_large_table(spark, tmp_path):
    schema = "k long, t int, v string"
    batches = [[(i, 0, "x" * 50) for i in range(20_000)]] + [[(j * 100 + i, 1, "y") for i in range(100)] for j in range(6)]
    paths = []
    for _, target in streamed(spark, tmp_path, batches, schema):
        paths.append([r.path for r in kv.runs(spark, target)])
    assert all(p[0] == paths[0][0] for p in paths) and max(map(len, paths)) <= 4
    out = state(spark, target, spark.createDataFrame(batches[0][:1], schema).schema, "k", ["t"])
    assert out.where("t = 1").count() == 600 and out.count() == 20_000
