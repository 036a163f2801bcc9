"""Elements of files that many tasks read, and places in files."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexmill.sources import lexical as X
from lexmill.sources.elements import elements


@pytest.fixture()
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "3000"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def dictionary(rng, words):
    defs = "".join(f'<pardef n="p{i}__n">' + "".join(f'<e{" r=" + chr(34) + "RL" + chr(34) if rng.random() < 0.2 else ""}><p><l>{rng.choice("abc") * k}</l><r><s n="n"/></r></p></e>\n' for k in range(rng.randint(0, 4))) + "</pardef>\n" for i in range(40))
    out = [f"<dictionary>\n<pardefs>{defs}</pardefs>\n<section id=\"other\"><e lm=\"no\"><i>no</i></e></section>\n<section id='main' type=\"standard\">"]
    for i in range(words):
        out.append(rng.choice(("", "", "<!-- a comment -->", f'<!-- <e lm="gone{i}"><i>x</i></e> <e lm="gone"/> -->', "\n", '<e lm="empty"/>')))
        out.append(f'<e lm="w{i}é"><i>w{i}<b/>é</i><par n="p{rng.randrange(40)}__n"/></e>')
    return "".join(out) + "</section>\n</dictionary>"


def by_tree(text):
    root, out = ET.fromstring(text), []
    for d in root.iter("pardef"):
        out += [("pardef:" + d.get("n"), e) for e in d.iter("e")]
    for s in root.iter("section"):
        out += [("section:" + s.get("id"), e) for e in s.iter("e")]
    return [(c, ET.tostring(e, encoding="unicode").strip()) for c, e in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_elements_of_many_splits_equal_the_tree(small_splits, tmp_path, seed):
    text = dictionary(random.Random(seed), 900)
    (tmp_path / "d.xml").write_text(text)
    d = elements(small_splits, str(tmp_path / "d.xml"), "e", X.CONTEXTS)
    assert d.rdd.getNumPartitions() > 10
    rows = d.orderBy("ordinal").collect()
    assert [(r.context, ET.tostring(ET.fromstring(r.xml), encoding="unicode").strip()) for r in rows] == by_tree(text)
    assert len({r.ordinal for r in rows}) == len(rows)


def test_elements_of_an_empty_file(spark, tmp_path):
    (tmp_path / "d.xml").write_text("")
    assert elements(spark, str(tmp_path / "d.xml"), "e", X.CONTEXTS).count() == 0


def test_a_dictionary_gives_the_same_facts_however_it_is_split(spark, small_splits, tmp_path):
    (tmp_path / "d.xml").write_text(dictionary(random.Random(3), 300))
    small = [sorted(map(tuple, x.drop("ordinal").collect()), key=str) for x in X.metadix(spark, str(tmp_path / "d.xml"))]
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
    whole = [sorted(map(tuple, x.drop("ordinal").collect()), key=str) for x in X.metadix(spark, str(tmp_path / "d.xml"))]
    assert small == whole and len(whole[0]) > 300 and len(whole[1]) > 300


def test_places_are_those_in_the_files(small_splits, tmp_path):
    """The spelling that stands first in the files wins, whatever the splits."""
    (tmp_path / "in").mkdir()
    for f in range(3):
        rows = [{"lang_code": "ca", "word": f"w{i:04d}", "pos": "noun", "senses": [{"glosses": [f"gloss {f} {i} " + "x" * 60]}]} for i in range(200)]
        (tmp_path / "in" / f"{f}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    facts, _ = X.kaikki(small_splits, str(tmp_path / "in"))
    places = [(r.lemma, r.value[:7]) for r in facts.where("field = 'd_en'").orderBy("ordinal").select("lemma", "value", "ordinal").collect()]
    assert places == [(f"w{i:04d}", f"gloss {f}") for f in range(3) for i in range(200)]
    assert facts.where(F.col("ordinal") < 0).count() == 0
