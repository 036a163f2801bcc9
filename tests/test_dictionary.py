"""Sources, shards, entries, lookup, evidence and gates on small fixtures with known results."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import entries as E
from lexmill.operators import evidence as V
from lexmill.operators import gates as G
from lexmill.operators import index as I
from lexmill.operators import lexicon as L
from lexmill.operators import lookup as U
from lexmill.operators import search as R
from lexmill.sources import lexical as X
from lexmill.sources import shards as P


def facts_of(df):
    return {(r.lemma, r.field, r.value) for r in df.collect()}


def morph_of(df):
    return {(r.surface, r.lemma, r.label, r.pos) for r in df.collect()}


def test_kaikki_splits_forms_from_words(spark, tmp_path):
    rows = [
        {"lang_code": "ca", "word": "gat", "pos": "noun", "senses": [{"glosses": ["cat &amp; kitten"], "tags": ["masculine"], "examples": [{"text": "Un gat."}]}], "sounds": [{"ipa": "/gat/"}], "forms": [{"form": "gats", "tags": ["plural"]}, {"form": "x", "tags": ["canonical"]}]},
        {"lang_code": "ca", "word": "canto", "pos": "verb", "senses": [{"tags": ["form-of", "first-person"], "form_of": [{"word": "cantar"}]}]},
        {"lang_code": "es", "word": "gato", "pos": "noun", "senses": [{"glosses": ["cat"]}]},
    ]
    (tmp_path / "k.jsonl").write_text("\n".join(map(json.dumps, rows)))
    facts, morphology = X.kaikki(spark, str(tmp_path / "k.jsonl"))
    got = facts_of(facts)
    assert {("gat", "d_en", "cat &amp; kitten"), ("gat", "p", "noun"), ("gat", "g", "masculine"), ("gat", "f", "gats"), ("gat", "pl", "gats"), ("gat", "ipa", "/gat/")} <= got
    assert {x[0] for x in got} == {"gat"}
    assert morph_of(morphology) == {("canto", "cantar", "first person", "verb"), ("gats", "gat", "plural", "noun")}
    (tmp_path / "bad.jsonl").write_text('{"lang_code": "ca"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        X.kaikki(spark, str(tmp_path / "bad.jsonl"))[0].collect()


def test_tei_fans_out_over_spellings(spark, tmp_path):
    entry = '<entry><form><orth>gat</orth><orth>gató</orth><pron>gat</pron></form><gramGrp><pos>n</pos><gen>m</gen></gramGrp><sense><def>animal</def><cit type="trans"><quote>gato</quote></cit></sense></entry>'
    other = "<entry><form><orth>x</orth></form><gramGrp><pos>zzz</pos></gramGrp></entry>"
    (tmp_path / "t.xml").write_text(f"<TEI>{entry}{other}</TEI>")
    got = facts_of(X.tei(spark, str(tmp_path / "t.xml")))
    assert {("gat", "es", "gato"), ("gató", "es", "gato"), ("gat", "g", "masculine"), ("gató", "d_ca", "animal"), ("gat", "ipa", "gat")} <= got
    assert {x[0] for x in got} == {"gat", "gató"}


def test_curated_drops_unknown_classes(spark, tmp_path):
    rows = [{"lemma": "bon dia", "partOfSpeech": ["expression", "zzz"], "chinese": ["早上好"], "spanish": ["buenos días"], "definitions": {"ca": ["salutació"]}, "examples": [{"ca": "Bon dia!", "zh": "早上好！"}]}, {"lemma": "x", "partOfSpeech": ["zzz"]}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = facts_of(X.curated(spark, str(tmp_path / "c.json")))
    assert {("bon dia", "zh", "早上好"), ("bon dia", "d_ca", "salutació")} <= got and {x[0] for x in got} == {"bon dia"}
    assert {x[2] for x in got if x[1] == "p"} == {"expression"}


METADIX = """<dictionary><pardefs>
<pardef n="gat__n"><e><p><l></l><r><s n="n"/><s n="m"/><s n="sg"/></r></p></e><e><p><l>s</l><r><s n="n"/><s n="m"/><s n="pl"/></r></p></e><e r="RL"><p><l>z</l><r><s n="n"/></r></p></e><e><re>[0-9]</re></e></pardef>
</pardefs><section id="main" type="standard">
<e lm="gat"><i>gat</i><par n="gat__n"/></e><e lm="cap de setmana"><i>cap<b/>de<b/>setmana</i><par n="gat__n"/></e>
<e><p><l>pel</l><r>per<b/>el<s n="pr"/></r></p></e><e lm="zz"><i>zz</i></e></section></dictionary>"""


def test_metadix_expands_paradigms(spark, tmp_path):
    (tmp_path / "m.dix").write_text(METADIX)
    facts, morphology = X.metadix(spark, str(tmp_path / "m.dix"))
    assert morph_of(morphology) == {("gats", "gat", "masculine · plural", "noun"), ("cap de setmanas", "cap de setmana", "masculine · plural", "noun"), ("pel", "per el", "", "preposition")}
    got = facts_of(facts)
    assert {("gat", "p", "noun"), ("gat", "pl", "gats"), ("per el", "p", "preposition")} <= got and not any(x[0] == "zz" for x in got)


def test_bilingual_enriches_known_words(spark, tmp_path):
    (tmp_path / "b.dix").write_text('<dictionary><section id="main"><e><p><l>gato<s n="n"/></l><r>gat<s n="n"/></r></p></e><e r="LR"><p><l>minino</l><r>gat</r></p></e><e><p><l>Ana<s n="np"/></l><r>Anna<s n="np"/></r></p></e><e><i>sol<s n="n"/></i></e></section></dictionary>')
    lex = spark.createDataFrame([("gat",), ("anna",), ("sol",)], "n string")
    assert {tuple(r) for r in X.bilingual(spark, str(tmp_path / "b.dix"), lex).collect()} == {("gat", "gato"), ("sol", "sol")}


WIKI = """==Anglès==
===Nom===
# cat
== {{-ca-}} ==
=== Nom ===
# Animal [[felí]] {{m|ca|petit}}.
#: exemple
{{trad|es|gato}} {{trad+|zh|猫}}
=== Verb ===
# {{ca-forma-conj|gatar|1|pres|ind}}
# {{forma-p|ca|gat}}
==Francès==
"""


def test_wiki_pages_give_definitions_and_forms(spark):
    pages = spark.createDataFrame([("gata", WIKI), ("buit", "res")], "title string, text string")
    facts, morphology = X.wiki(pages)
    assert {("gata", "d_ca", "Animal felí petit."), ("gata", "es", "gato"), ("gata", "zh", "猫"), ("gata", "p", "noun")} <= facts_of(facts)
    assert morph_of(morphology) == {("gata", "gatar", "first person · present · indicative", "verb"), ("gata", "gat", "inflected nominal/adjectival form", "verb")}


def test_wiki_dump_leaves_out_other_namespaces(spark, tmp_path):
    page = lambda t: f"<page><title>{t}</title><revision><text>x</text></revision></page>"
    (tmp_path / "d.xml").write_text(f"<mediawiki>{page('gat')}{page('Ajuda:gat')}</mediawiki>")
    assert [r.title for r in X.pages(spark, str(tmp_path / "d.xml")).collect()] == ["gat"]


def test_wordnet_rejects_other_rows(spark, tmp_path):
    (tmp_path / "w.tab").write_text("# c\n00000001-n\tcat:lemma\tgat\n00000001-n\tcat:def\t0\n")
    assert [tuple(r) for r in X.wordnet(spark, str(tmp_path / "w.tab"), "cat").collect()] == [("00000001-n", "cat", "gat")]
    (tmp_path / "x.tab").write_text("1-n\tcat:lemma\tgat\n")
    with pytest.raises(Exception, match="invalid synset"):
        X.wordnet(spark, str(tmp_path / "x.tab"), "cat").collect()


def test_conversion_table_takes_the_first_alternative(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n發\t发 髪\n\n學\t学\n")
    assert dict(X.conversion_table(spark, str(tmp_path / "t.txt")).collect()) == {"發": "发", "學": "学"}


def test_shards_round_trip_and_are_checked(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/out"
    rows = [(f"k{i:03d}", json.dumps({"n": f"k{i:03d}", "x": "é" * 50}, ensure_ascii=False)) for i in range(60)]
    monkeypatch.setattr(P, "TARGET", 1500)
    d = P.write_shards(spark.createDataFrame(rows, "key string, json string"), root, "lex")
    made = d.collect()
    assert sum(r.entries for r in made) == 60
    for r in made:
        data = (tmp_path / "out" / "lex" / f"{r.id}.json.gz").read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(gzip.decompress(data)) == r.rawBytes
    back = P.read_packs(spark, root, d).collect()
    assert sorted(json.loads(r.json)["n"] for r in back) == [k for k, _ in rows]
    again = P.write_shards(spark.createDataFrame(rows, "key string, json string"), root, "lex")
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in made)
    with pytest.raises(Exception, match="checksum mismatch"):
        P.read_packs(spark, root, d.withColumn("sha256", F.lit("0"))).collect()
    with pytest.raises(ValueError, match="unsafe path"):
        P.read_packs(spark, root, d.withColumn("path", F.lit("/etc/passwd")))
    with pytest.raises(ValueError, match="immutable"):
        P._HadoopFiles(root).put(made[0].path, b"other")
    pack = P.write_pack(spark.createDataFrame(rows[:3], "key string, json string"), root, "core", "lex")
    assert (pack["first"], pack["last"], pack["entries"]) == ("k000", "k002", 3)
    m = P.manifest(P.version_id({"a": 1}), [{"id": "s", "path": "hidden", "license": "x"}], d, {"lemmaCount": 60})
    assert m["sources"] == [{"id": "s", "license": "x"}] and len(m["lex"]) == len(made) and len(m["dataVersion"]) == 16
    (tmp_path / "stage").mkdir()
    (tmp_path / "stage" / "f").write_text("new")
    P.publish(f"{tmp_path}/stage", root)
    assert (tmp_path / "out" / "f").read_text() == "new" and not (tmp_path / "out.old").exists()


def test_merge_of_layers_by_priority(spark):
    rows = [("a", 2, "B", ["x", "y"], 5, None), ("a", 1, "A", ["y", "z"], None, True), ("b", 1, None, None, None, None)]
    d = spark.createDataFrame(rows, "n string, priority int, l string, zh array<string>, r long, zhMachine boolean")
    none = lambda t: F.lit(None).cast(t)
    for c in E.ENTRY.replace(",fields", "§fields").replace(",sourceEntryId", "§sourceEntryId").split(", "):
        name, kind = c.strip().split(" ", 1)
        if name not in d.columns:
            d = d.withColumn(name, none(kind.replace("§", ",")))
    got = {r.n: r for r in E.merge(d).collect()}
    assert (got["a"].l, got["a"].zh, got["a"].r, got["a"].zhMachine) == ("A", ["y", "z", "x"], 5, True)
    assert got["b"].zh is None and got["b"].r is None and got["b"].l is None


LEX = [("cantar", "cantar", ["verb"], 10), ("casa", "casa", ["noun"], 5), ("escola", "escola", ["noun"], 20), ("dona", "dona", ["noun"], 8), ("donar", "donar", ["verb"], 7), ("agradar", "agradar", ["verb"], 30), ("fer", "fer", ["verb"], 1), ("faig", "faig", ["noun"], 900), ("anar", "anar", ["verb"], 2), ("mà", "mà", ["noun"], 40)]
MORPH = [("canto", "cantar", "present indicative · first person", "verb", 1), ("cases", "casa", "plural", "noun", 1), ("agrada", "agradar", "present indicative · third person", "verb", 1), ("dona", "donar", "imperative", "verb", 1), ("cant", "cantar", "", "", 1)]


@pytest.fixture(scope="module")
def words(spark):
    lex = spark.createDataFrame(LEX, "n string, l string, p array<string>, r long")
    return lex, spark.createDataFrame(MORPH, "surface string, lemma string, label string, pos string, ord int")


def test_catalan_cascade(spark, words):
    lex, morph = words
    asked = ["casa", " Casa", "canto", "l'escola", "m'agrada", "dona-me'n", "vaig cantar", "vàrem anar", "cas", "ma", "escoal", "zzzzzz", "?", "faig"]
    reviewed = spark.createDataFrame([("faig", "fer", "present indicative · first person", "verb", 1)], "surface string, lemma string, label string, pos string, ord int")
    out = U.catalan(spark.createDataFrame([(q,) for q in asked], "q string"), lex, morph, lex, reviewed).collect()
    first = {r.q: (r.status, r.source, r.n or r.l, r.label) for r in sorted(out, key=lambda r: -(r.pos or 0))}
    assert first["casa"] == ("found", "exact", "casa", None)
    assert first[" Casa"][1] == "normalized-exact"
    assert first["canto"] == ("found", "morphology", "cantar", "present indicative · first person")
    assert first["l'escola"] == ("found", "clitic", "escola", "elided l' + lemma")
    assert first["m'agrada"] == ("found", "clitic", "agradar", "proclitic m' + present indicative · third person")
    assert first["dona-me'n"] == ("found", "clitic", "donar", "imperative + clitic me'n")
    assert first["vaig cantar"] == ("found", "morphology", "cantar", "passat perifràstic · first person singular")
    assert first["vàrem anar"][2] == "anar"
    assert first["cas"][:3] == ("not-found", "prefix", "casa")
    assert first["ma"][:3] == ("not-found", "fuzzy", "mà")
    assert first["escoal"][:3] == ("not-found", "fuzzy", "escola")
    assert first["zzzzzz"][1] == first["?"][1] == "none"
    faig = sorted((r.pos, r.n, r.label, r.confidence) for r in out if r.q == "faig")
    assert faig == [(1, "fer", "present indicative · first person", 0.98), (2, "faig", "exact lexical homograph", 0.86)]


def test_hydrated_reverse_hits(spark, words):
    lex, _ = words
    terms = spark.createDataFrame([("casa", "casa", "translation", None, 5), ("escola", "casa", "alias", 1, 20), ("dona", "Casa", "translation", None, 8)], "lemma string, term string, kind string, priority int, rank long")
    hits = R.reverse(spark.createDataFrame([("casa",)], "q string"), R.build_index(terms, "es"), "es")
    assert [r.lemma for r in sorted(hits.collect(), key=lambda r: r.pos)] == ["escola", "casa", "dona"]
    got = R.hydrate(hits, None, lex).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.pos)] == ["escola", "casa", "dona"]
    with pytest.raises(Exception, match="not in the lexicon"):
        R.hydrate(hits, None, lex.where("n = 'anar'")).collect()
    both = U.lookup(spark.createDataFrame([("casa",)], "q string"), lex, words[1], lex, R.build_index(terms, "es")).collect()
    assert [(r.n, r.language) for r in sorted(both, key=lambda r: r.pos)] == [("casa", "ca"), ("escola", "es"), ("dona", "es")]


def test_chinese_index_has_both_scripts(spark):
    from lexmill.functions.han import converter

    terms = spark.createDataFrame([("escola", "學校", "translation", None, 1)], "lemma string, term string, kind string, priority int, rank long")
    index = R.build_index(terms, "zh", converter({"學": "学"}), converter({"学": "學"}))
    assert {r.key for r in index.collect()} == {"學校", "学校"}
    hits = R.reverse(spark.createDataFrame([("「学校」",)], "q string"), index, "zh", simplify=converter({"學": "学"}))
    assert [(r.lemma, r.exact) for r in hits.collect()] == [("escola", True)]


def test_expressions_and_intents(spark):
    rows = spark.createDataFrame([("高兴", "高兴", "content", "高兴的", 2, "c1", "adjective"), ("高兴", "高兴", "content", "乐", 2, "c2", None), ("高兴", "高兴", "alegre", "欢", 1, "c3", None)], "key string, expression string, lemma string, label string, rank long, concept string, pos_class string")
    got = R.expressions(spark.createDataFrame([("高兴？",)], "q string"), rows).collect()
    assert [(r.lemma, r.label) for r in sorted(got, key=lambda r: r.pos)] == [("alegre", "欢"), ("content", "高兴的")]
    found = spark.createDataFrame([("苹果", "poma")], "q string, n string")
    intents = spark.createDataFrame([("苹果怎么说", "苹果")], "q string, term string")
    out = U.intent_lookup(spark.createDataFrame([("苹果怎么说",), ("苹果",), ("梨",)], "q string"), found, intents)
    assert {(r.q, r.asked, r.n) for r in out.collect()} == {("苹果怎么说", "苹果", "poma"), ("苹果", "苹果", "poma")}


def test_many_queries_give_what_few_give(spark, words, monkeypatch):
    lex, _ = words
    rows = lex.select(F.col("n").alias("key"), F.col("n").alias("term"), F.col("n").alias("lemma"), F.col("r").alias("rank"))
    q = spark.createDataFrame([(x,) for x in ("cas", "csaa", "ar", "escoal", "donra", "mà")], "q string")
    calls = (lambda: R.suggest_spanish(q, rows), lambda: U.prefix_suggestions(q, lex), lambda: I.fuzzy(q, lex.select(F.col("n").alias("term")), 2), lambda: I.prefix_lookup(q, lex.select("n", "r"), "n", "r", 3), lambda: I.complete(q, rows, 4))
    few = [sorted(map(tuple, f().collect())) for f in calls]
    monkeypatch.setattr(I, "FEW_QUERIES", 0)
    assert [sorted(map(tuple, f().collect())) for f in calls] == few and all(few)


def test_wordnet_alignment(spark):
    none = "array<string>"
    entries = spark.createDataFrame([("gat", ["noun"], None), ("gos", ["noun"], ["狗"])], f"n string, p array<string>, zh {none}").withColumn("d", F.lit(None).cast("struct<zh:array<string>>"))
    layers = spark.createDataFrame([("gat", "lex", ["gato / felino"]), ("gos", "lex", ["perro"])], "n string, layer string, es array<string>")
    net = [("1-n", "cat", "gat"), ("1-n", "spa", "gato"), ("1-n", "cmn", "猫"), ("1-n", "cmn", "猫+的"), ("2-v", "cat", "gat"), ("2-v", "cmn", "抓"), ("3-n", "cat", "gat"), ("3-n", "spa", "taxi"), ("3-n", "cmn", "车"), ("4-n", "cat", "gos"), ("4-n", "spa", "perro"), ("4-n", "cmn", "犬")]
    net = spark.createDataFrame(net, "synset string, lang string, term string")
    no = lambda s: spark.createDataFrame([], s)
    got = V.align_wordnet(entries, layers, net, no("n string, synset string"), no("synset string, term string"))
    assert [tuple(r) for r in got.collect()] == [("gat", "1-n", ["猫", "猫的"], ["gato"])]
    assert [tuple(r) for r in V.wordnet_overlays(got).collect()] == [("gat", ["猫、猫的"], ["猫", "猫的"])]
    held = spark.createDataFrame([("gat", "1-n")], "n string, synset string")
    assert V.align_wordnet(entries, layers, net, held, no("synset string, term string")).count() == 0


def test_overlays_never_replace_chinese(spark):
    entries = spark.createDataFrame([("a", ["字"]), ("b", None), ("c", None)], "n string, zh array<string>").withColumn("d", F.lit(None).cast("struct<zh:array<string>>"))
    reviewed = spark.createDataFrame([("a", "b1", 1, "新", ["新"], ["s"]), ("b", "b1", 1, "新", ["新词"], ["s"])], "n string, batch string, ordinal int, translation string, aliases array<string>, sources array<string>")
    assert [tuple(r) for r in V.reviewed_overlays(reviewed, entries).collect()] == [("b", ["新"], ["新词"], ["s", "b1"])]
    twice = reviewed.unionByName(reviewed.withColumn("batch", F.lit("b2")))
    with pytest.raises(Exception, match="reviewed twice"):
        V.reviewed_overlays(twice, entries).collect()
    rows = spark.createDataFrame([("a", "e001", 1, "x", "译", ["s"]), ("c", "e001", 1, "x", "猫；狗", ["s"]), ("c", "e002", 2, "y", "猫", ["t"])], "n string, id string, ordinal int, text string, translation string, sources array<string>")
    out, counts = V.machine_overlays(rows, entries, spark.createDataFrame([("b",)], "n string"))
    assert [tuple(r) for r in out.collect()] == [("c", ["猫；狗", "猫"], ["s", "t", "project-machine-translation"], ["猫", "狗", "猫"])]
    assert counts.first().asDict() == {"inputSenses": 3, "preservedExistingChineseSenses": 1, "importedSenses": 2, "importedLemmas": 1}
    with pytest.raises(Exception, match="invalid machine translation"):
        V.machine_overlays(rows.withColumn("translation", F.lit("abc")), entries, entries.limit(0))[0].collect()


def test_synonyms_and_taxa(spark):
    jobs = spark.createDataFrame([("j1", "a", "definition", "ca", "Casa.", ["noun"]), ("j2", "a", "definition", "ca", "casa gran", ["noun"]), ("j3", "a", "definition", "en", "wild cat (Felis silvestris)", ["noun"]), ("j4", "a", "definition", "en", "cat of (Felis silvestris)", ["noun"])], "jobId string, normalizedLemma string, kind string, sourceLanguage string, sourceText string, sourcePartOfSpeech array<string>")
    entries = spark.createDataFrame([("casa", ["noun"]), ("a", ["noun"])], "n string, p array<string>")
    assert [tuple(r) for r in V.synonyms(jobs, entries).collect()] == [("j1", "casa")]
    names = spark.createDataFrame([("Felis silvestris", "zh", "野猫"), ("Felis silvestris", "en", "wildcat")], "name string, language string, label string")
    assert [tuple(r) for r in V.taxa(jobs, names).collect()] == [("j3", "Felis silvestris", "野猫")]
    assert V.taxa(jobs, names.unionByName(spark.createDataFrame([("Felis silvestris", "zh", "猫")], names.schema))).count() == 0


def test_bound_rows_and_stale_corrections(spark):
    base = spark.createDataFrame([("a", "definition", "en", "text", ["s"], ["noun"], "lex")], "normalizedLemma string, kind string, sourceLanguage string, sourceText string, sourceIds array<string>, sourcePartOfSpeech array<string>, layer string")
    jobs = V.identified(base)
    assert V.bound(jobs, jobs).count() == 1
    with pytest.raises(Exception, match="evidence differs"):
        V.bound(jobs.withColumn("sourceText", F.lit("other")), jobs).collect()
    c = jobs.select("jobId", F.lit("0").alias("sourceHash"), F.lit("字").alias("translation"))
    with pytest.raises(Exception, match="stale correction"):
        V.decide(jobs, c.limit(0).select("jobId", "translation"), c, F.lit(None).cast("string")).collect()


def test_packets_are_bounded(spark):
    jobs = spark.createDataFrame([(f"j{i}", "en" if i % 2 else "ca", "x" * 300) for i in range(60)], "jobId string, sourceLanguage string, sourceText string")
    got = V.packets(jobs).groupBy("packet").agg(F.count("*").alias("n"), F.sum(F.length("sourceText")).alias("c"), F.countDistinct("sourceLanguage").alias("l")).collect()
    assert sum(r.n for r in got) == 60 and all(r.n <= 40 and r.c <= 2600 and r.l == 1 for r in got)


def record(**more):
    base = {"id": "1", "lemma": "gat", "normalizedLemma": "gat", "partOfSpeech": ["noun"], "existingChinese": [], "priorityRank": 1, "evidence": [{"id": "e001"}]} | more
    return base | {"inputHash": hashlib.sha256(P.canonical(base)).hexdigest()}


def test_validation_of_batches(spark):
    i = record()
    o = {k: i[k] for k in ("id", "lemma", "normalizedLemma", "inputHash")} | {"status": "translated", "senses": [{"sourceRefs": ["e001"], "partOfSpeech": "noun", "translationZh": "猫", "aliasesZh": ["猫咪"]}], "issues": []}

    def errors(a, b):
        frame = lambda x: spark.createDataFrame([(0, P.canonical(x).decode())], "position int, json string")
        return {r.error for r in G.validate_records(frame(a), frame(b)).collect()}

    assert errors(i, o) == set()
    assert errors(i, o | {"status": "skipped"}) == {"output.senses: skipped records must have no senses", "output.issues: needs_review and skipped records require an issue"}
    bad = o["senses"][0] | {"sourceRefs": ["e009"], "translationZh": "待翻译", "aliasesZh": ["a;b", "a;b"], "partOfSpeech": "verb"}
    assert errors(i, o | {"senses": [bad]}) == {"senses.sourceRefs: is not evidence in this input record", "senses.translationZh: placeholder text is not allowed", "senses.aliasesZh: duplicate value", "senses.aliasesZh: semicolon-separated aliases are not allowed", "senses.partOfSpeech: must be null or a part of speech in this input record"}
    assert errors(i, {**o, "extra": 1}) == {"output: fields"}
    assert "input.inputHash: does not match canonical input SHA-256" in errors(i | {"lemma": "gos"}, o)
    head = {"schemaVersion": 1, "batchId": "b", "recordCount": 1}
    assert G.validate_batch(head | {"dictionaryVersion": "v", "sourceCommit": "c", "selection": "s"}, head, 1) == []
    assert G.validate_batch(head, head, 2)


def test_gates_raise_or_list(spark):
    with pytest.raises(Exception, match="fewer than 80000"):
        G.at_least(spark.range(3)).collect()
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    want = spark.createDataFrame([("a", 1, hashlib.sha256(b"x").hexdigest()), ("b", 1, "0"), ("c", 1, "0")], "path string, bytes long, sha256 string")
    assert {tuple(r) for r in G.checksums(files, want).collect()} == {("b", "checksum"), ("c", "missing")}
    text = "t"
    rows = [(1, "a", "e", text, "en", hashlib.sha256(text.encode()).hexdigest(), ["s"]), (2, "a", " ", text, "en", "0", ["s"]), (3, "a", "e", text, "fr", "0", []), (4, "a", "e", text, "en", "0", ["s"])]
    rows = spark.createDataFrame(rows, "number int, normalizedLemma string, evidenceId string, sourceText string, sourceLanguage string, sourceHash string, sourceIds array<string>")
    assert dict(G.invalid_jobs(rows).collect()) == {2: "missing or empty evidenceId", 3: "unsupported source language", 4: "sourceHash does not match exact sourceText"}
    flags = spark.createDataFrame([(["short-ambiguous-source"],), (["repetition", "latin-residue"],)], "flags array<string>")
    assert dict(G.flag_histogram(flags).collect()) == {"short-ambiguous-source": 1, "repetition": 1, "latin-residue": 1, "needs-review": 1}


def test_global_rank_is_a_total_order(spark):
    rows = [(f"{c}{i}", i % 3) for i in range(40) for c in "abé𠀀"]
    got = L.ranked(spark.createDataFrame(rows, "token string, n long")).collect()
    want = sorted(rows, key=lambda r: (-r[1], len(r[0]), r[0].encode()))
    assert [r.token for r in sorted(got, key=lambda r: r["rank"])] == [t for t, _ in want] and sorted(r["rank"] for r in got) == list(range(1, 161))


def test_fold_covers_more_than_latin_one(spark):
    d = spark.createDataFrame([("àŏṽǘ ñ й",), ("é",)], "x string")
    assert [r[0] for r in d.select(T.fold(F.col("x"))).collect()] == ["aovu n и", "e"]
    assert [r[0] for r in d.select(T.spanish_fold(F.col("x"))).collect()] == ["aovu ñ и", "e"]
