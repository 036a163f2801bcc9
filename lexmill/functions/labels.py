"""Labels of morphology and word classes: tags, headings, paradigm names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

#: Tags of analysers and what they are called.
MORPH_TAGS = {
    "cni": "conditional", "fti": "future indicative", "fts": "future subjunctive", "ger": "gerund", "ifi": "simple past indicative", "imp": "imperative", "inf": "infinitive",
    "p1": "first person", "p2": "second person", "p3": "third person", "pii": "imperfect indicative", "pis": "imperfect subjunctive", "pl": "plural", "pp": "past participle",
    "pri": "present indicative", "prs": "present subjunctive", "sg": "singular", "f": "feminine", "m": "masculine", "mf": "common gender", "pos": "positive", "sup": "superlative",
}
CONJUGATION = {
    "1": "first person", "2": "second person", "3": "third person", "pres": "present", "imperf": "imperfect", "fut": "future", "cond": "conditional", "ind": "indicative",
    "subj": "subjunctive", "imp": "imperative", "ger": "gerund", "part": "past participle",
}
#: Word classes of the sources.
APERTIUM_POS = {
    "adj": "adjective", "adv": "adverb", "preadv": "adverb", "cnjadv": "conjunction", "cnjcoo": "conjunction", "cnjsub": "conjunction", "det": "determiner", "detnt": "determiner",
    "predet": "determiner", "ij": "interjection", "n": "noun", "num": "numeral", "ord": "numeral", "pr": "preposition", "prn": "pronoun", "vaux": "verb", "vbhaver": "verb", "vblex": "verb",
    "vbmod": "verb", "vbser": "verb",
}
KAIKKI_POS = {
    "adj": "adjective", "adv": "adverb", "article": "article", "conj": "conjunction", "contraction": "contraction", "det": "determiner", "intj": "interjection", "noun": "noun", "num": "numeral",
    "particle": "particle", "phrase": "expression", "prep": "preposition", "prep_phrase": "expression", "pron": "pronoun", "proverb": "expression", "verb": "verb",
}
FREEDICT_POS = {
    "adj": "adjective", "adjective": "adjective", "adv": "adverb", "adverb": "adverb", "article": "article", "conj": "conjunction", "conjunction": "conjunction", "det": "determiner",
    "idiom": "expression", "interj": "interjection", "interjection": "interjection", "n": "noun", "noun": "noun", "num": "numeral", "numeral": "numeral", "number": "numeral", "prep": "preposition",
    "preposition": "preposition", "pron": "pronoun", "pronoun": "pronoun", "proverb": "expression", "v": "verb", "verb": "verb",
}
#: Hints of headings, the first that occurs decides.
HEADING_POS = (
    ("locucio", "expression"), ("expressio", "expression"), ("frase", "expression"), ("adjectiu", "adjective"), ("adverbi", "adverb"), ("article", "article"), ("conjuncio", "conjunction"),
    ("contraccio", "contraction"), ("determinant", "determiner"), ("interjeccio", "interjection"), ("nom propi", "proper-name"), ("substantiu", "noun"), ("nom", "noun"), ("numeral", "numeral"),
    ("preposicio", "preposition"), ("pronom", "pronoun"), ("verb", "verb"),
)
#: Tags that are no part of a label; forms that are none.
UNLABELLED = ("form-of", "combined-form", "table-tags", "canonical")
NO_FORMS = ("canonical", "table-tags", "class", "romanization", "unknown")
#: Names of paradigms that inflect.
PARADIGM = r"__(?:adj|adv|cnjadv|cnjcoo|cnjsub|det|detnt|ij|n|num|ord|pr|prn|vaux|vbhaver|vblex|vbmod|vbser)$"


def lookup(table: dict[str, str], key: Column) -> Column:
    """table[key], null for other keys."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _joined(values: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull())), " · ")


def tag_label(tags: Column) -> Column:
    """Known tags in words, each once."""
    return _joined(F.transform(tags, lambda t: lookup(MORPH_TAGS, t)))


def tag_pos(tags: Column, paradigm: Column | None = None) -> Column:
    """Class of the first tag that has one, else of the paradigm's name."""
    known = F.filter(F.transform(tags, lambda t: lookup(APERTIUM_POS, t)), lambda v: v.isNotNull())
    out = F.get(known, 0)
    return out if paradigm is None else F.coalesce(out, lookup(APERTIUM_POS, F.regexp_extract(paradigm, "__([^/]+)$", 1)))


def kaikki_label(tags: Column) -> Column:
    return _joined(F.transform(F.filter(tags, lambda t: ~t.isin(*UNLABELLED)), lambda t: F.replace(t, F.lit("-"), F.lit(" "))))


def conjugation_label(parts: Column) -> Column:
    """Parts of a conjugation template in words; without any, the plain name."""
    kept = F.filter(parts, lambda p: (p != "") & ~p.startswith("g=") & ~p.startswith("n="))
    label = F.array_join(F.transform(kept, lambda p: F.coalesce(lookup(CONJUGATION, p), p)), " · ")
    return F.when(label == "", "conjugated verb form").otherwise(label)


def heading_pos(heading: Column) -> Column:
    key = fold(F.lower(F.regexp_replace(heading, r"\{\{.*?\}\}", "")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for hint, pos in HEADING_POS:
        out = out.when(key.contains(hint), pos)
    return out
