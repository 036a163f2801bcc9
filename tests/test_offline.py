"""Core tables, candidates, fallbacks, readers of authored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import offline as O
from lexmill.sources import lexical as X


def test_candidates_and_alternatives(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "z"), ("b", 2, "x")], "q string, pos int, n string")
    c = spark.createDataFrame([("a", "y"), ("b", "other"), ("c", "x")], "q string, n string")
    got = O.selected_candidate(r, c)
    assert {(x.q, x.n, x.pos) for x in got.where("selected").collect()} == {("a", "y", 2), ("b", "z", 1)}
    assert sorted((x.q, x.pos, x.n) for x in O.alternatives(got).collect()) == [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")]
    assert O.selected_candidate(r, c.limit(0)).where("selected and pos = 1").count() == 2


def test_candidates_of_equal_places_go_by_entry(spark):
    r = spark.createDataFrame([("a", 1, n) for n in range(40, 0, -1)] + [("b", 2, 9), ("b", 1, 8), ("b", 1, 7)], "q string, pos long, n long")
    got = O.selected_candidate(r, spark.createDataFrame([("b", 9)], "q string, n long"))
    assert sorted((x.q, x.n) for x in got.where("selected").collect()) == [("a", 1), ("b", 9)]
    assert sorted((x.q, x.pos, x.n) for x in O.alternatives(got).collect()) == [("a", i, i + 1) for i in range(1, 40)] + [("b", 1, 7), ("b", 2, 8)]


def test_core_tables(spark):
    core = spark.createDataFrame([("gat", ["猫"]), ("gos", None)], "n string, zh array<string>")
    rows = spark.createDataFrame([("gats", "gat"), ("x", "lloc"), (None, None)], "surface string, lemma string")
    assert [x.surface for x in O.core_only(rows, core).collect()] == ["gats"]
    assert {(x.q, x.n) for x in O.probe(rows.select(F.col("lemma").alias("q")), core).collect()} == {("gat", "gat"), ("lloc", None), (None, None)}
    e = spark.createDataFrame([("gat", None), ("gos", ["狗"]), ("lloc", [])], "n string, zh array<string>")
    assert {x.n: x.zh for x in O.enriched(e, core, "zh").collect()} == {"gat": ["猫"], "gos": ["狗"], "lloc": []}


@pytest.mark.parametrize(("ca", "machine", "zh", "es", "shown"), [(["d"], True, None, None, False), (None, True, ["猫"], None, True), (None, None, ["猫"], None, False), (None, False, [], [], True), ([], None, None, ["gato"], False)])
def test_gloss_fallback(spark, ca, machine, zh, es, shown):
    d = spark.createDataFrame([(ca, ["cat"], machine, zh, es)], "ca array<string>, en array<string>, m boolean, zh array<string>, es array<string>")
    got = d.select(O.shown_gloss(*(F.col(c) for c in ("ca", "en", "m", "zh", "es"))).alias("g")).first().g
    assert got == (["cat"] if shown else None)


def test_missing_pieces_and_keys(spark):
    wanted = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    assert O.short_of(wanted, wanted).first().asDict() == {"limited": False, "missing": 0}
    assert O.short_of(wanted, wanted.where("path = 'a'")).first().asDict() == {"limited": True, "missing": 1}
    rows = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, None), (4, [])], "i int, v array<int>")
    keys = {r.i: r.k for r in rows.select("i", O.value_key(F.col("v")).alias("k")).collect()}
    assert keys[1] == keys[2] and len({keys[1], keys[3], keys[4]}) == 3
    t = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678999),)], "t timestamp").select(O.millis(F.col("t")).alias("ms"))
    assert t.select("ms", O.millis(O.from_millis(F.col("ms"))).alias("again")).first().asDict() == {"ms": 1704164645678, "again": 1704164645678}


def test_authored_tables(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"key":"gat","lemma":"gat","partOfSpeech":"noun","zh":"猫；猫咪 ；","es":"gato / michino","examples":[{"ca":"Un gat."}]}\n{"key":"gat","lemma":"Gat","partOfSpeech":"noun","zh":"x","es":""}\n')
    got = X.seeds(spark, str(tmp_path / "s.jsonl")).collect()
    assert [(r.n, r.l, r.p, r.zh, r.es, r.ex[0].ca) for r in got] == [("gat", "gat", ["noun"], ["猫", "猫咪"], ["gato", "michino"], "Un gat.")]
    (tmp_path / "f.tsv").write_text("# forms\ncases\tcasa\tnoun\tfeminine plural\t0.99\ncases\tcasar\tverb\tpresent indicative\t0.72\n")
    got = X.reviewed_forms(spark, str(tmp_path / "f.tsv")).collect()
    assert sorted((r.surface, r.ord, r.lemma, r.pos, r.confidence) for r in got) == [("cases", 1, "casa", "noun", 0.99), ("cases", 2, "casar", "verb", 0.72)]
    (tmp_path / "g.tsv").write_text("a\tb\tnoun\tx\t7\n")
    with pytest.raises(Exception, match="invalid form"):
        X.reviewed_forms(spark, str(tmp_path / "g.tsv")).collect()
