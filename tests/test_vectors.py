"""Scalar functions on stated values."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import han as H
from lexmill.functions import labels as B
from lexmill.functions import text as T
from lexmill.operators import entries as E
from lexmill.operators import gates as G
from lexmill.operators import lookup as U
from lexmill.operators import search as R
from lexmill.sources import lexical as X

SURFACES = [('dona-me',), ("l'escola",), ('vaig cantar',), ('casa',), ("porta'm",), ("d'aigua",), ('va dir',), ('menjar-lo',), ("dona-me'n",), ('digue-li',), ("mira'ls",), ("compra-m'ho",), ('vàrem anar',), ('anem-hi',), ('fes-ho',)]
WANTED = [('dona', None, None), (None, 'escola', None), (None, None, 'cantar'), (None, None, None), ('porta', None, None), (None, 'aigua', None), (None, None, 'dir'), ('menjar', None, None), ('dona', None, None), ('digue', None, None), ('mira', None, None), ('compra', None, None), (None, None, 'anar'), ('anem', None, None), ('fes', None, None)]
NORMAL = {' PUJANT ': 'pujant', 'L’ESCOLA': "l'escola", 'coŀlegi': 'col·legi', 'ma': 'ma', 'mà': 'mà', 'A   B': 'a b', 'l.l': 'l.l', 'pa–ta': 'pa-ta', 'l•l': 'l·l', 'd＇or': "d'or", 'café': 'café', 'a\u3000b': 'a b'}
VECTORS = {}


def literal(name, columns, rows, results, want, make):
    VECTORS[name] = columns, rows, results.split(", "), [w if isinstance(w, tuple) else (w,) for w in want], make


SCRIPT, SOUNDS, PHRASE_SOUNDS = {"學": "学", "校": "校", "頭髮": "头发", "發": "发", "髮": "发"}, {"长": "chang", "学": "xue", "校": "xiao", "城": "cheng"}, {"校长": ["xiao", "zhang"]}
literal("gender_of_set", "q int, g array<string>", [(1, ["masculine"]), (2, ["masculine", "feminine"]), (3, ["common"]), (4, []), (5, ["feminine"])], "gender", ["masculine", "common", "common", None, "feminine"], lambda d: d.withColumn("gender", E.gender(F.col("g"))))
literal("label_order", "q string", [("present indicative · first person",), ("present indicative",), ("present subjunctive",), ("imperative",), ("plural",), ("",)], "priority", [0, 1, 2, 3, 4, 5], lambda d: d.withColumn("priority", T.label_priority(F.col("q"))))
literal("tag_labels", "q int, tags array<string>", [(1, ["vblex", "pri", "p1", "sg"]), (2, ["n", "f", "pl", "pl"]), (3, ["x"])], "label, pos", [("present indicative · first person · singular", "verb"), ("feminine · plural", "noun"), ("", None)], lambda d: d.withColumn("label", B.tag_label(F.col("tags"))).withColumn("pos", B.tag_pos(F.col("tags"))))
literal("kaikki_labels", "q int, tags array<string>", [(1, ["form-of", "third-person", "singular", "singular"]), (2, [])], "label", ["third person · singular", ""], lambda d: d.withColumn("label", B.kaikki_label(F.col("tags"))))
literal("conjugation_labels", "q int, parts array<string>", [(1, ["1", "pres", "ind", "g=m"]), (2, ["", "n=s"]), (3, ["part", "xyz"])], "label", ["first person · present · indicative", "conjugated verb form", "past participle · xyz"], lambda d: d.withColumn("label", B.conjugation_label(F.col("parts"))))
literal("heading_classes", "q string", [("Verb",), ("{{ca-nom}} Nom propi",), ("Locució adverbial",), ("Preposició",), ("Miscel·lània",)], "pos", ["verb", "proper-name", "expression", "preposition", None], lambda d: d.withColumn("pos", B.heading_pos(F.col("q"))))
literal("clean_texts", "q string", [("  a &amp; b ;",), ("x" * 490 + " yyyyyyyyyyyyyyy",), ("",)], "text", ["a & b", "x" * 490 + "…", ""], lambda d: d.withColumn("text", T.clean_text(F.col("q"))))
literal("search_keys", "q string", [("Niño",), ("niño",), ("PINGÜINO",), ("ＡＢ",), ("学　校",)], "es, zh", [("niño", "niño"), ("niño", "niño"), ("pinguino", "pingüino"), ("ａｂ", "ab"), ("学 校", "学 校")], lambda d: d.withColumn("es", T.search_key(F.col("q"), "es")).withColumn("zh", T.search_key(F.col("q"), "zh")))
literal("cache_keys", "q string", [(" Casa ",), ("Mà",)], "key", ["auto:casa", "auto:mà"], lambda d: d.withColumn("key", T.cache_key(F.col("q"))))
literal("edit_limits", "q string", [("abcd",), ("abcdefgh",), ("abcdefghi",), ("𠀀𠀀𠀀",)], "lookup, suggestion", [(1, 1), (2, 2), (3, 2), (2, 1)], lambda d: d.withColumn("lookup", T.edit_threshold(F.col("q"))).withColumn("suggestion", T.osa_threshold(F.col("q"))))
literal("osa_distances", "a string, b string", [("teh", "the"), ("ca", "abc"), ("abcdef", "badcfe"), ("casa", "cosa")], "d", [1, 3, 3, 1], lambda d: d.withColumn("d", T.osa_distance("a", "b", F.lit(3))))
literal("machine_text_flags", "source string, text string, route string, n int", [("to run fast in a race", "跑", "en-zh", 3), ("plural of cat", "cat 猫", "ca-en-zh", 300), ("a thing", "你好，你好，你好", "en-zh", 9), ("word", "众生", "en-zh", 2)], "flags", ["", "pivot-translation,latin-residue,grammatical-definition,decoding-limit", "repetition,unsupported-personal-reference", "short-ambiguous-source,suspected-hallucination"], lambda d: d.withColumn("flags", F.array_join(T.machine_flags(F.col("source"), F.col("text"), F.col("route"), F.col("n"), F.lit(256)), ",")))
literal("online_text_flags", "source string, text string", [("a", "字"), ("a", ""), ("字", "字"), ("a", "TODO 字")], "flags", ["", "empty-or-non-chinese", "unchanged-source", "placeholder-or-marker"], lambda d: d.withColumn("flags", F.array_join(T.online_flags(F.col("source"), F.col("text")), ",")))
literal("short_terms", "q string", [("学校；学院",), ("一种乐器、工具",), ("红、蓝",), ("逐渐、快速且令人警觉的增加",), ("（旧）车站",), ("abc",), ("符合法律，原则",)], "terms", ["学校|学院", "一种乐器、工具", "红|蓝", "逐渐、快速且令人警觉的增加", "车站", "", "符合法律，原则"], lambda d: d.withColumn("terms", F.array_join(H.short_terms(F.col("q")), "|")))
literal("masked_brackets", "q string", [("a（b）c",), ("x(y[z])w",)], "text", ["a   c", "x      w"], lambda d: d.withColumn("text", H.top_level(F.col("q"))))
literal("spanish_terms", "q string", [("casa / hogar；piso",), ("a {b}",), ("uno...",)], "terms", ["casa|hogar|piso", "", ""], lambda d: d.withColumn("terms", F.array_join(H.spanish_terms(F.col("q")), "|")))
literal("script_canonicalise", "q string", [("學校",), ("頭髮",), ("發",), ("abc",)], "simple", ["学校", "头发", "发", "abc"], lambda d: d.withColumn("simple", H.converter(SCRIPT)(F.col("q"))))
literal("matching_keys", "q string", [("「學 校」",), (" ＡＢＣ ",), ("学校？",)], "key", ["学校", "abc", "学校"], lambda d: d.withColumn("key", H.matching_key(F.col("q"), H.converter(SCRIPT))))
literal("phrase_readings", "q string", [("校长",), ("长城",), ("x",)], "sounds", ["xiao zhang", "chang cheng", "x"], lambda d: d.withColumn("sounds", F.array_join(H.readings(SOUNDS, PHRASE_SOUNDS)(F.col("q")), " ")))
literal("same_readings", "a string, b string", [("学", "学"), ("长", "城"), ("学", "长")], "same", [False, False, False], lambda d: d.withColumn("same", H.same_reading(F.col("a"), F.col("b"), SOUNDS)))
literal("toneless_readings", "q string", [("lǜ",), ("xué",)], "plain", ["lv", "xue"], lambda d: d.withColumn("plain", H.toneless("q")))
literal("display_meanings", "q int, zh array<string>", [(1, ["學；校", "学"]), (2, ["（a；b）；c"]), (3, [])], "text", ["学；校", "（a；b）；c", ""], lambda d: d.withColumn("text", H.display(F.col("zh"), H.converter(SCRIPT))))
literal("question_intents", "q string", [("学校用加泰语怎么说？",), ("请问形容高兴的形容词",), ("查一下苹果",), ("搜索引擎",), ("苹果的名词",), ("查一下怎么",), ("hello",)], "term, pos", [("学校", None), ("高兴", "adjective"), ("苹果", None), (None, None), ("苹果", "noun"), (None, None), (None, None)], lambda d: d.withColumn("i", H.intent(F.col("q"))).select("q", "i.term", "i.pos"))
literal("grammar_templates", "kind string, language string, pos array<string>, q string", [("definition", "en", ["noun"], "plural of gat."), ("headword", "ca", ["pronoun"], "me'n"), ("headword", "ca", ["noun"], "b"), ("definition", "en", ["noun"], "a cat")], "text", ["「gat」的复数形式", "加泰语弱读代词组合「me'n」", "拉丁字母 B（b）", None], lambda d: d.withColumn("text", H.grammatical(F.col("kind"), F.col("language"), F.col("pos"), F.col("q"))))
literal("wordnet_terms", "q string", [("心脏收缩+的",), ("学校",), ("待翻译",), ("a",)], "term", ["心脏收缩的", "学校", None, None], lambda d: d.withColumn("term", H.clean_chinese(F.col("q"))))
literal("wiki_sections", "q string", [("==Anglès==\nx\n== {{-ca-}} ==\ny\nz\n==Francès==\nw",), ("== Català ==\na",), ("x",)], "section", ["\ny\nz", "\na", ""], lambda d: d.withColumn("section", X.section(F.col("q"))))
literal("wiki_texts", "q string", [("Un [[gat|felí]] ''gran''.",), ("{{m|ca|casa}} i {{glossa|{{l|ca|nom}}}}",), ("a<ref>b</ref> {{x}} [http://u v]",)], "text", ["Un felí gran.", "casa i nom", "a v"], lambda d: d.withColumn("text", X.clean_wikitext(F.col("q"))))
literal("word_class_prefer", "q string, pos int, sense_pos string, p array<string>, preference string", [("a", 1, None, ["verb", "noun"], "noun"), ("a", 2, None, ["noun"], "noun"), ("a", 3, "noun", ["verb"], "noun"), ("a", 4, "verb", ["noun"], "noun")], "place", [3, 2, 1, 4], lambda d: R.prefer_class(d.withColumn("old", F.col("pos"))).select("q", F.col("old").alias("pos"), "sense_pos", "p", "preference", F.col("pos").alias("place")))
literal("rank_minimum", "q int, r array<long>", [(1, [1, 2]), (2, [None, 5]), (3, [None, None])], "least", [1, 5, 2**53 - 1], lambda d: d.withColumn("least", E.least_rank(F.get("r", 0), F.get("r", 1))))
literal("strict_json", "q string", [('{"a":1}',), ('{"a":1,"a":2}',), ('{"a":NaN}',), ("[",)], "ok", [True, False, False, False], lambda d: d.withColumn("ok", G.strict_json(F.col("q")).isNotNull()))
literal("string_lists", "q int, v array<string>", [(1, ["a", "b"]), (2, ["a", "a"]), (3, []), (4, ["a", " "])], "errors", ["", "v: duplicate value", "v: must not be empty", "v: must be nonempty strings"], lambda d: d.withColumn("errors", F.array_join(G.strings(F.col("v"), "v", True, True), ";")))
literal("clitics", "q string", SURFACES, "enclitic, proclitic, past", WANTED, lambda d: d.withColumn("enclitic", T.strip_enclitic(F.col("q"))).withColumn("proclitic", T.strip_proclitic(F.col("q"))).withColumn("past", T.periphrastic_past(F.col("q"))))
literal("normal", "q string", [(k,) for k in NORMAL], "key", list(NORMAL.values()), lambda d: d.withColumn("key", T.normalize(F.col("q"))))
literal("split", "q string", [("a;b",), ("a(b;c);d",), ("x, y",), ("（一；二）；三",)], "parts", ["a|b", "a(b;c)|d", "x, y", "（一；二）|三"], lambda d: d.withColumn("parts", F.array_join(T.split_outside_brackets(F.col("q"), ";；"), "|")))

literal("trimmed", "q string", [("1 a ; 0 b;2c ",), (" x;  (y ; z) ",)], "parts, terms", [("1 a|0 b|2c", "1 a|0 b|2c"), ("x|(y ; z)", "x|(y|z)")], lambda d: d.withColumn("parts", F.array_join(T.split_outside_brackets(F.col("q"), ";；"), "|")).withColumn("terms", F.array_join(H.spanish_terms(F.col("q")), "|")))


@pytest.mark.parametrize("name", sorted(VECTORS))
def test_vector(spark, name):
    columns, rows, results, want, make = VECTORS[name]
    first = columns.split(" ")[0]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {columns}")
    keyed = make(d.withColumn(first, F.col(first))).collect()
    inputs = {tuple(map(str, r)): w for r, w in zip(rows, want, strict=True)}
    names = [c.split()[0] for c in columns.split(", ")]
    assert len(keyed) == len(rows)
    for r in keyed:
        assert tuple(r[c] for c in results) == inputs[tuple(str(r[c]) for c in names)]


ZH_ROWS = [("学校", "学校", "escola", 1), ("学校的", "学校的", "escolar", 2), ("学", "学", "estudi", 3), ("大学校", "大学校", "gran", 4), ("学效", "学效", "error", 5), ("不学", "不学", "no", 6)]
ZH_WANT = {"学校": [("escola", "exact"), ("escolar", "prefix"), ("gran", "contains")], "学校的": [("escolar", "exact"), ("escola", "related")], "学笑": [("escola", "fuzzy"), ("error", "fuzzy"), ("estudi", "fuzzy")]}


def test_chinese_suggestions(spark):
    rows = spark.createDataFrame(ZH_ROWS, "key string, term string, lemma string, rank long")
    got = R.suggest_chinese(spark.createDataFrame([(q,) for q in ZH_WANT], "q string"), rows).collect()
    assert {(r.q, r.pos, r.lemma, r.kind) for r in got} == {(q, i, *x) for q, v in ZH_WANT.items() for i, x in enumerate(v, 1)}


def test_the_accent_equivalent_is_first(spark):
    rows = spark.createDataFrame([(w, w, r) for w, r in (("musics", 1), ("mùsica", 2), ("musical", 3))], "n string, l string, r long")
    got = U.prefix_suggestions(spark.createDataFrame([("musica",)], "q string"), rows).collect()
    assert {(r.pos, r.l) for r in got} == {(1, "mùsica"), (2, "musical")}
