"""Text functions as column expressions; Arrow UDFs only where Spark has no built-in (Unicode forms, OSA distance)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: A word: letters, with inner apostrophe, middle dot or hyphen.
WORD = r"\p{L}+(?:['’·-]\p{L}+)*"
LETTERS = r"\p{L}+"
HAN = r"\p{IsHan}"
MARKS = r"[\u0300-\u036f]"
#: White space and line ends of ECMAScript, as a class.
BLANKS = r"[\u0009-\u000d\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
#: What is one apostrophe, one hyphen, one middle dot.
APOSTROPHES, HYPHENS, DOTS = "’‘ʼ＇`´", "‐‑‒–—−", "•∙⋅‧"
#: Attached pronouns behind a verb, in the order they are tried, and elided ones before it.
ENCLITICS = (
    "-me'n", "-te'n", "-se'n", "-m'ho", "-t'ho", "-n'hi", "-nos", "-vos", "-los", "-les", "-me", "-te", "-se", "-lo", "-la", "-li", "-ho", "-hi", "-ne",
    "'m", "'t", "'s", "'l", "'ls", "'n", "'ho", "'hi",
)
PROCLITICS = ("l'", "d'", "m'", "t'", "s'", "n'")
#: Auxiliaries of the periphrastic past and their persons.
AUXILIARIES = {
    "vaig": "first person singular", "vas": "second person singular", "va": "third person singular", "vam": "first person plural", "vàrem": "first person plural",
    "vau": "second person plural", "vàreu": "second person plural", "van": "third person plural",
}
MISSING_RANK = 2**53 - 1


def _form(name: str):
    @F.pandas_udf(StringType())
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v.isascii() else unicodedata.normalize(name, v)).where(lambda y: y.notna(), x)

    return convert


nfc, nfkc = _form("NFC"), _form("NFKC")


@lru_cache(maxsize=2)
def folding(keep: str = "") -> tuple[str, str]:
    """Every composed letter of the BMP that holds marks of U+0300 to U+036F, and what is left without them; by rule."""
    source, target = [], []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if c not in keep and any("\u0300" <= x <= "\u036f" for x in d):
            plain = unicodedata.normalize("NFC", "".join(x for x in d if not "\u0300" <= x <= "\u036f"))
            if len(plain) == 1:
                source.append(c)
                target.append(plain)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Without the marks U+0300 to U+036F, of text in composed form; in the JVM."""
    return F.translate(F.regexp_replace(text, MARKS, ""), *folding())


def spanish_fold(text: Column) -> Column:
    """fold() that keeps ñ, a letter of its own, composed or not."""
    return F.translate(F.regexp_replace(F.replace(text, F.lit("n\u0303"), F.lit("\u00f1")), MARKS, ""), *folding("\u00f1\u00d1"))


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    import html

    return x.map(lambda v: None if v is None else html.unescape(v) if "&" in v else v)


def one_kind(text: Column) -> Column:
    """One kind of apostrophe and of hyphen."""
    return F.translate(text, APOSTROPHES + HYPHENS, "'" * len(APOSTROPHES) + "-" * len(HYPHENS))


def squeezed(text: Column, trim: bool = True) -> Column:
    t = F.regexp_replace(text, BLANKS, " ")
    return F.trim(t) if trim else t


def normalize(text: Column, profile: str = "query", composed: bool = False) -> Column:
    """The key of a Catalan word: composed (NFC, unless the text is known to be), lower case, one kind of apostrophe and
    hyphen, single spaces, ŀl and l•l as l·l. Profile `build` drops U+FEFF and U+200B and makes every bullet a middle dot.
    """
    t = text if composed else nfc(text)
    if profile == "build":
        t = F.translate(F.regexp_replace(t, r"[\ufeff\u200b]", ""), DOTS, "·" * len(DOTS))
    t = one_kind(F.lower(t))
    t = F.regexp_replace(t, "ŀl", "l·l")
    if profile == "query":
        t = F.regexp_replace(t, f"l[{DOTS}]l", "l·l")
    return squeezed(t)


def search_input(text: Column, language: str = "auto") -> Column:
    """normalize() of a query; compatibility forms (NFKC) for Chinese and for any text with Han."""
    form = nfkc(text) if language == "zh" else F.when(text.rlike(HAN), nfkc(text)).otherwise(nfc(text))
    return normalize(form, composed=True)


def search_key(text: Column, language: str) -> Column:
    """The key under which a query is looked up: for Spanish without accents, ñ kept."""
    t = search_input(text, language)
    return t if language == "zh" else spanish_fold(t)


def spanish_key(text: Column) -> Column:
    """spanish_fold() of composed text in lower case."""
    return spanish_fold(F.lower(text))


def chinese_key(text: Column) -> Column:
    return normalize(nfkc(text), composed=True)


def search_language(text: Column) -> Column:
    return F.when(text.rlike(HAN), "zh").otherwise("es")


def searchable(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def clean_text(text: Column, most: int = 500, composed: bool = False) -> Column:
    """Entities unescaped, single spaces, no blanks, ; or , at the ends; beyond `most` characters cut at a word, with …"""
    t = F.coalesce(text, F.lit("")) if composed else unescape(nfc(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ ;,]+|[ ;,]+$", "")
    head = F.substring(t, 1, most)
    cut = F.regexp_replace(F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head), r"[ ,;:]+$", "")
    return F.when(F.length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def valid_term(text: Column, allow_spaces: bool = True) -> Column:
    ok = (F.length(text) <= 120) & text.rlike(r"\p{L}") & ~text.rlike(r"\{\{|\}\}|\[\[|\]\]|_prefix_|<|>|\n|\r")
    return ok if allow_spaces else ok & ~text.contains(" ")


def utf16_key(text: Column) -> Column:
    """What sorts by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def cache_key(text: Column, language: str = "auto") -> Column:
    return F.concat(F.lit(f"{language}:"), search_input(text, language))


def ordered_distinct(items: Column, limit: int | None = None) -> Column:
    """First occurrences, in order, at most `limit`."""
    out = F.array_distinct(items)
    return out if limit is None else F.slice(out, 1, limit)


def union_distinct(*lists: Column) -> Column:
    """First occurrences over all lists, in order; null if there are none."""
    out = F.array_distinct(F.concat(*lists))
    return F.when(F.size(out) > 0, out)


def or_empty(items: Column) -> Column:
    return F.coalesce(items, F.expr("cast(array() as array<string>)"))


def nonempty(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def split_outside_brackets(text: Column, separators: str) -> Column:
    """Pieces at separators that no bracket encloses; blanks trimmed, empty pieces dropped."""
    chars = F.split(text, "")
    start = F.struct(F.lit("").alias("closing"), F.lit("").alias("piece"), F.expr("cast(array() as array<string>)").alias("out"))
    # Brackets and what closes them.
    opening, closing = "（([【{〔「『《“‘", "）)]】}〕」』》”’"

    def step(acc, c):
        last = F.right(acc["closing"], F.lit(1))
        pushed = F.concat(acc["closing"], F.translate(c, opening, closing))
        popped = F.substring(acc["closing"], F.lit(1), F.length(acc["closing"]) - 1)
        known = F.when((c != "") & (F.instr(F.lit(opening), c) > 0), pushed).when((c != "") & (c == last), popped).otherwise(acc["closing"])
        cut = (known == "") & (F.instr(F.lit(separators), c) > 0) & (c != "")
        return F.struct(
            known.alias("closing"),
            F.when(cut, F.lit("")).otherwise(F.concat(acc["piece"], c)).alias("piece"),
            F.when(cut, F.concat(acc["out"], F.array(acc["piece"]))).otherwise(acc["out"]).alias("out"),
        )

    pieces = F.aggregate(chars, start, step, lambda acc: F.concat(acc["out"], F.array(acc["piece"])))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda p: p != "")


def enclitic(text: Column) -> Column:
    """The first attached pronoun, in the order of ENCLITICS, that the text ends with; null if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for e in ENCLITICS:
        out = out.when(text.endswith(e), e)
    return out


def strip_enclitic(text: Column) -> Column:
    """The host before enclitic(); null if there is none."""
    return F.substring(text, F.lit(1), F.length(text) - F.length(enclitic(text)))


def proclitic(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for p in PROCLITICS:
        out = out.when(text.startswith(p), p)
    return out


def strip_proclitic(text: Column) -> Column:
    return F.substring(text, F.length(proclitic(text)) + 1, F.length(text))


def periphrastic(text: Column) -> tuple[Column, Column]:
    """Person and second word of 'auxiliary word', null for any other text; whether the word is a verb is the lexicon's to say."""
    w = F.split(text, " ")
    person = F.create_map(*(F.lit(x) for pair in AUXILIARIES.items() for x in pair))[F.element_at(w, 1)]
    two = F.size(w) == 2
    return F.when(two, person), F.when(two & person.isNotNull(), F.element_at(w, -1))


def periphrastic_past(text: Column) -> Column:
    """The infinitive of 'auxiliary infinitive' by its ending, else null."""
    _, word = periphrastic(text)
    return F.when(word.rlike("(ar|er|re|ir)$"), word)


def label_priority(label: Column) -> Column:
    """Order of morphology labels, least first: first person of the present indicative, that tense, present subjunctive,
    imperative, any other, none."""
    t = F.lower(F.coalesce(label, F.lit("")))
    present = t.contains("present")
    indicative = present & t.contains("indicative")
    return F.when(indicative & t.contains("first person"), 0).when(indicative, 1).when(present & t.contains("subjunctive"), 2).when(t.contains("imperative"), 3).when(t != "", 4).otherwise(5)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def edit_threshold(text: Column) -> Column:
    """Edits allowed in a lookup, by the length of folded text."""
    n = utf16_length(text)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def osa_threshold(text: Column) -> Column:
    """Edits and swaps allowed in a suggestion."""
    return F.when(F.length(text) < 6, 1).otherwise(2)


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row each, with 0 behind their ends, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(sizes.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def osa_bits(left: list[str], right: list[str]) -> np.ndarray:
    """Edits with adjacent swaps, each part edited once, of pairs of texts; left ones of 63 characters at most, not empty.

    Bit-parallel: a pair's differences down a column are bits, and a column is a few operations for all pairs together.
    """
    one, (a, n), (b, m) = np.uint64(1), _padded(left), _padded(right)
    place = one << np.arange(a.shape[1], dtype=np.uint64)
    inside = np.arange(a.shape[1]) < n[:, None]
    place = np.where(inside, place, np.uint64(0))
    top = one << (n - 1).astype(np.uint64)
    up, down = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), np.uint64)
    zero, same, score = np.zeros(len(left), np.uint64), np.zeros(len(left), np.uint64), n.copy()
    for j in range(b.shape[1]):
        live = j < m
        now = np.where(a == b[:, j, None], place, np.uint64(0)).sum(1, dtype=np.uint64)
        swap = (((~zero) & now) << one) & same
        zero = (((now & up) + up) ^ up) | now | down | swap
        plus, minus = down | ~(zero | up), zero & up
        score += np.where(live & ((plus & top) != 0), 1, 0) - np.where(live & ((minus & top) != 0), 1, 0)
        plus, minus = (plus << one) | one, minus << one
        up, down, same = minus | ~(zero | plus), plus & zero, now
    return score


def osa_rows(left: list[str], right: list[str]) -> np.ndarray:
    """The same for texts of any length: a row of the table at a time, for all pairs together."""
    (a, n), (b, m) = _padded(left), _padded(right)
    across = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(across, (len(left), len(across))).copy()
    before, out = row, np.where(n == 0, m, 0)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i, None] != b))
        if i:
            swap = (a[:, i, None] == b[:, :-1]) & (a[:, i - 1, None] == b[:, 1:])
            new[:, 2:] = np.where(swap, np.minimum(new[:, 2:], before[:, :-2] + 1), new[:, 2:])
        new = np.minimum.accumulate(new - across, 1) + across  # insertions
        before, row = row, new
        out = np.where(n == i + 1, row[np.arange(len(m)), m], out)
    return out


def osa_all(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of pairs of texts, by bits where the shorter text of a pair fits in them."""
    out = np.zeros(len(left), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right, strict=True)]
    size = np.array([len(a) for a, _ in pairs], np.int64)
    for these, way in ((np.flatnonzero((size > 0) & (size < 64)), osa_bits), (np.flatnonzero((size == 0) | (size >= 64)), osa_rows)):
        for lo in range(0, len(these), 4096):
            part = these[lo : lo + 4096]
            out[part] = way([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    return out


@F.pandas_udf(IntegerType())
def osa_distance(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
    """Edits with adjacent swaps, each part edited once; most + 1 if there are more."""
    return pd.Series(np.minimum(osa_all(left.tolist(), right.tolist()), most.to_numpy(np.int64) + 1), dtype="int32")


def flags(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold, in order; an unknown check does not."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in checks)), lambda x: x.isNotNull())


REPEATED = r"(.{2,8})\1{3,}"


def quality_flags(text: Column) -> Column:
    """Flags of suspect text, in a fixed order."""
    return flags((F.length(text) < 50, "short"), (text.rlike(REPEATED), "repeated"), (text.rlike("https?://"), "url"), (text.rlike(r"[{}<>\[\]]"), "markup"), (~text.rlike(r"\p{L}"), "no_letters"))


def phrases(text: Column) -> Column:
    """Phrases between commas, semicolons and blanks."""
    return F.filter(F.split(text, r"(?U)[，,、;；\s]+"), lambda p: p != "")


def most_repeated(items: Column) -> Column:
    """How often the most frequent item of an array occurs; 0 if it is empty."""
    ordered = F.array_sort(items)
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc, x):
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(ordered, zero, step, lambda acc: acc["most"])


#: What the flags of machine text look for.
GRAMMAR = r"(?i)\b(?:contraction|preposition|article|participle|conjugation|inflection|plural of|singular of|alternative form|form of|past tense|present tense|feminine of|masculine of|imperative|pronoun)\b"
SCRIPTURE, SCRIPTURE_SOURCE = "汝等|众生|阿弥陀|菩萨", r"(?i)Buddha|Buddhis|bodhisattva|sentient|thou|thee"
PERSONAL, PERSONAL_SOURCE = "[你我您汝]", r"(?i)\b(?:I|me|my|mine|we|us|our|ours|you|your|yours|oneself)\b"
PLACEHOLDER = r"(?i)待翻译|待补充|\b(?:TODO|TBD)\b|ZXQSEG|QXZ"


def machine_flags(source: Column, text: Column, route: Column, tokens: Column, most: Column) -> Column:
    """Flags of a machine translation `text` of `source` by `route`, with its number of tokens and the limit."""
    return flags(
        (route != "en-zh", "pivot-translation"),
        (~text.rlike(r"[㐀-鿿]"), "no-chinese"),
        (text.rlike("[A-Za-z]"), "latin-residue"),
        (source.rlike(GRAMMAR), "grammatical-definition"),
        (F.size(F.filter(F.split(source, r"(?U)\s+"), lambda w: w != "")) <= 1, "short-ambiguous-source"),
        (tokens >= most, "decoding-limit"),
        (text.rlike(SCRIPTURE) & ~source.rlike(SCRIPTURE_SOURCE), "suspected-hallucination"),
        (text.rlike(REPEATED) | (most_repeated(phrases(text)) >= 3), "repetition"),
        (text.rlike(PERSONAL) & ~source.rlike(PERSONAL_SOURCE), "unsupported-personal-reference"),
        (F.length(text) > F.greatest(F.lit(100), F.length(source) * 3), "length-anomaly"),
    )


def online_flags(source: Column, text: Column, chinese: bool = True) -> Column:
    """Flags of a translation that came from a service; `chinese`: into Chinese."""
    to_zh = F.lit(chinese)
    return flags(
        ((text == "") | text.isNull() | (to_zh & ~text.rlike(HAN)), "empty-or-non-chinese"),
        (text.rlike(REPEATED), "repetition"),
        (text.rlike(PLACEHOLDER), "placeholder-or-marker"),
        (utf16_length(text) > F.greatest(F.lit(200), utf16_length(source) * 5), "length-anomaly"),
        (to_zh & (text == source), "unchanged-source"),
    )


def canonical_json(*fields: str) -> Column:
    """JSON of columns in alphabetical order of their names, without blanks; nulls are left out."""
    return F.to_json(F.struct(*sorted(fields)))


def identity(*fields: str) -> Column:
    """Content hash of fields, in alphabetical order, as canonical JSON."""
    return F.sha2(canonical_json(*fields), 256)
