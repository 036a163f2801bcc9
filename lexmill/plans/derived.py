"""Registered queries of the scalar functions, over texts that are made from the rows of `part` (every row, a pattern each by its key).

{n} is a part's name, {h} and {g} are Chinese words (the digits of its key and of its size as characters), {w} and {v}
Latin words made in the same way. In the SQL the answer is made from the same columns as the text, by what the
function means.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import han as H
from ..functions import labels as B
from ..functions import text as T
from ..operators import entries as E
from ..operators import gates as G
from ..operators import lookup as U
from ..operators import search as R
from ..sources import lexical as X
from ..operators.store import stored
from .queries import query, table

HAN, LATIN_DIGITS = "天地人日月山水火木金", "abdefgijko"
WORDS = {"n": ("p_name", None), "h": ("p_partkey", HAN), "g": ("p_size", HAN), "w": ("p_partkey", LATIN_DIGITS), "v": ("p_size", LATIN_DIGITS)}
SLOT = re.compile(r"\{([nhgwv])\}")


def text_sql(value: str) -> str:
    parts = SLOT.split(value)
    out = []
    for i, x in enumerate(parts):
        column, digits = WORDS[x] if i % 2 else (None, None)
        if i % 2:
            out.append(f"translate(CAST({column} AS VARCHAR), '0123456789', '{digits}')" if digits else column)
        elif x:
            out.append("'" + x.replace("'", "''") + "'")
    return " || ".join(out) or "''"


def text_column(value: str) -> Column:
    parts = SLOT.split(value)
    out = []
    for i, x in enumerate(parts):
        column, digits = WORDS[x] if i % 2 else (None, None)
        if i % 2:
            out.append(F.translate(F.col(column).cast("string"), "0123456789", digits) if digits else F.col(column))
        elif x:
            out.append(F.lit(x))
    return F.concat(*out) if out else F.lit("")


def sql_value(v) -> str:
    if v is None or isinstance(v, bool):
        return {None: "NULL", True: "true", False: "false"}[v]
    return text_sql(v) if isinstance(v, str) else f"CAST({v} AS {'BIGINT' if abs(v) > 1 << 31 else 'INTEGER'})"


def column_value(v) -> Column:
    if isinstance(v, list):
        return F.array(*map(column_value, v)) if v else F.expr("cast(array() as array<string>)")
    return text_column(v) if isinstance(v, str) else F.lit(v)


def derived(name: str, inputs: str, rows: list[tuple], results: str, want: list, make) -> None:
    """A query over all parts: pattern p_partkey mod len(rows) makes the inputs, make(DataFrame) adds `results`."""
    names, outs = inputs.split(", "), results.split(", ")
    want = [w if isinstance(w, tuple) else (w,) for w in want]
    pick = f"p_partkey % {len(rows)}"
    case = lambda values: "CASE " + pick + " " + " ".join(f"WHEN {i} THEN {sql_value(v)}" for i, v in enumerate(values)) + " END"
    shown = [k for k in range(len(names)) if not isinstance(rows[0][k], list) and not any(r[k] is None for r in rows)]
    sql = "SELECT p_partkey, " + ", ".join([f"{case([r[k] for r in rows])} AS {names[k]}" for k in shown] + [f"{case([w[k] for w in want])} AS {outs[k]}" for k in range(len(outs))]) + " FROM part"

    @query(name, sql)
    def _(spark, sf):
        p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % len(rows)).alias("_pick"))
        for k, n in enumerate(names):
            kind = "array<string>" if isinstance(rows[0][k], list) else None
            c = F.lit(None)
            for i, r in reversed(list(enumerate(rows))):
                v = column_value(r[k])
                c = F.when(F.col("_pick") == i, v.cast(kind) if kind else v).otherwise(c)
            p = p.withColumn(n, c)
        return make(p).select("p_partkey", *(names[k] for k in shown), *outs)


add = lambda name, f: lambda d: d.withColumn(name, f())
joined = lambda c: F.array_join(c, "|")

derived("label_order", "q", [("{n} present indicative · first person",), ("Present Indicative {w}",), ("present {w} subjunctive",), ("{w} imperative",), ("{n}",), ("",)], "priority", [0, 1, 2, 3, 4, 5], add("priority", lambda: T.label_priority(F.col("q"))))
derived("tag_labels", "tags", [(["vblex", "{w}", "pri", "p1", "sg"],), (["n", "f", "pl", "pl", "{v}{w}"],), (["{w}z"],)], "label, pos", [("present indicative · first person · singular", "verb"), ("feminine · plural", "noun"), ("", None)], lambda d: d.withColumn("label", B.tag_label(F.col("tags"))).withColumn("pos", B.tag_pos(F.col("tags"))))
derived("kaikki_labels", "tags", [(["form-of", "{w}-person", "{v}x", "{v}x"],), (["canonical", "{w}"],)], "label", ["{w} person · {v}x", "{w}"], add("label", lambda: B.kaikki_label(F.col("tags"))))
derived("conjugation_labels", "parts", [(["1", "pres", "ind", "g={w}"],), (["", "n={w}"],), (["part", "{w}x"],)], "label", ["first person · present · indicative", "conjugated verb form", "past participle · {w}x"], add("label", lambda: B.conjugation_label(F.col("parts"))))
derived("heading_classes", "q", [("Verb {w}",), ("-{w}- Nom propi",), ("Locució {w}",), ("Preposició",), ("q{w}",)], "pos", ["verb", "proper-name", "expression", "preposition", None], add("pos", lambda: B.heading_pos(F.col("q"))))
derived("clean_texts", "q", [("  {w} &amp; {n} ;",), ("{w}\t\n{v}  ",), (", {n};;",), ("x" * 490 + " yyyyyyyyyyyyyy{w}",)], "text", ["{w} & {n}", "{w} {v}", "{n}", "x" * 490 + "…"], add("text", lambda: T.clean_text(F.col("q"))))
derived("search_keys", "q", [("Niño{w}",), ("niño {w}",), ("PINGÜINO{w}",), ("ＡＢ{w}",), ("{h}　{g}",)], "es, zh", [("niño{w}", "niño{w}"), ("niño {w}", "niño {w}"), ("pinguino{w}", "pingüino{w}"), ("ａｂ{w}", "ab{w}"), ("{h} {g}", "{h} {g}")], lambda d: d.withColumn("es", T.search_key(F.col("q"), "es")).withColumn("zh", T.search_key(F.col("q"), "zh")))
derived("cache_keys", "q", [(" Casa{w} ",), ("Mà  {n}",), ("L’{w}",)], "key", ["auto:casa{w}", "auto:mà {n}", "auto:l'{w}"], add("key", lambda: T.cache_key(F.col("q"))))
derived("machine_text_flags", "source, text, route, n", [("to run fast to {w} in a race", "跑{h}", "en-zh", 3), ("plural of {w}", "{w} {h}", "ca-en-zh", 300), ("a thing q{w}", "你{h}，你{h}，你{h}", "en-zh", 9), ("{w}", "众生", "en-zh", 2)], "flags", ["", "pivot-translation,latin-residue,grammatical-definition,decoding-limit", "repetition,unsupported-personal-reference", "short-ambiguous-source,suspected-hallucination"], add("flags", lambda: F.array_join(T.machine_flags(F.col("source"), F.col("text"), F.col("route"), F.col("n"), F.lit(256)), ",")))
derived("online_text_flags", "source, text", [("{w}", "字{h}"), ("{w}", ""), ("{h}", "{h}"), ("{w}", "TODO {h}"), ("{w}", "{v}")], "flags", ["", "empty-or-non-chinese", "unchanged-source", "placeholder-or-marker", "empty-or-non-chinese"], add("flags", lambda: F.array_join(T.online_flags(F.col("source"), F.col("text")), ",")))
derived("short_terms", "q", [("{h}；{g}学",), ("一种{h}、{g}",), ("红{h}、蓝{g}",), ("{h}、快速且{g}的增加",), ("（旧）{h}",), ("{w}",), ("{h}，{g}",), ("{h}。{g}",)], "terms", ["{h}|{g}学", "一种{h}、{g}", "红{h}|蓝{g}", "{h}、快速且{g}的增加", "{h}", "", "{h}，{g}", ""], add("terms", lambda: joined(H.short_terms(F.col("q")))))
derived("masked_brackets", "q", [("{w}（天）c",), ("x(y[z])w{v}",), ("{n}",)], "text", ["{w}   c", "x      w{v}", "{n}"], add("text", lambda: H.top_level(F.col("q"))))
derived("spanish_terms", "q", [("{w} / {n}；piso",), ("{w} [x] <{v}>",), ("{w}...",), ("{h}; {v}",)], "terms", ["{w}|{n}|piso", "", "", "{v}"], add("terms", lambda: joined(H.spanish_terms(F.col("q")))))
SCRIPT = {"天": "添", "地": "第", "天地": "乾坤", "金": "今", "山水": "风景"}


def script_sql(column: str) -> str:
    """The conversion as replacements, phrases before characters: no phrase of SCRIPT ends where another begins."""
    for k in sorted(SCRIPT, key=len, reverse=True):
        column = f"replace({column}, '{k}', '{SCRIPT[k]}')"
    return column


HAN_KEY = "translate(CAST(p_partkey AS VARCHAR), '0123456789', '" + HAN + "')"


def han_key() -> Column:
    return F.translate(F.col("p_partkey").cast("string"), "0123456789", HAN)



@query("script_canonicalise", f"SELECT p_partkey, {script_sql(HAN_KEY)} AS simple FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", H.converter(SCRIPT)(han_key()).alias("simple"))


@query("matching_keys", f"SELECT p_partkey, {script_sql(HAN_KEY)} || 'ab' AS key FROM part")
def _(spark, sf):
    whole = H.matching_key(F.concat(F.lit("「"), han_key(), F.lit("ＡＢ？」")), H.converter(SCRIPT))
    return table(spark, sf, "part").select("p_partkey", whole.alias("key"))


SOUNDS = dict(zip(HAN, ("tian", "di", "ren", "ri", "yue", "shan", "shui", "huo", "mu", "jin"), strict=True))
PHRASE_SOUNDS = {"人日": ["ren", "zi"], "日月": ["ming", "yue"]}
SOUND_SQL = "array_to_string(list_transform(string_split({}, ''), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOUNDS.items()) + " ELSE c END), ' ')"


@query("phrase_readings", "SELECT p_partkey, replace(replace(" + SOUND_SQL.format(f"replace(replace({HAN_KEY}, '人日', '人一'), '日月', '二月')") + ", '一', 'zi'), '二', 'ming') AS sounds FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(H.readings(SOUNDS, PHRASE_SOUNDS)(han_key()), " ").alias("sounds"))


HOMOPHONES = {"天": "tian", "添": "tian", "地": "di", "第": "di", "人": "ren"}


@query("same_readings", f"SELECT p_partkey, a, b, (a = '天' AND b = '添') OR (a = '地' AND b = '第') AS same FROM (SELECT p_partkey, substr({HAN_KEY}, 1, 1) AS a, {script_sql(f'substr({HAN_KEY}, 1, 1)')} AS b FROM part)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.substring(han_key(), 1, 1).alias("a"))
    p = p.withColumn("b", H.converter(SCRIPT)(F.col("a")))
    return p.withColumn("same", H.same_reading(F.col("a"), F.col("b"), HOMOPHONES))


derived("toneless_readings", "q", [("lǜ{w}",), ("xué {v}",), ("{n} ñü",)], "plain", ["lv{w}", "xue {v}", "{n} nv"], add("plain", lambda: H.toneless("q")))
derived("display_meanings", "zh", [(["學{h}；{g}校", "{g}校"],), (["（{h}；b）；c"],), ([],)], "text", ["學{h}；{g}校", "（{h}；b）；c", ""], add("text", lambda: H.display(F.col("zh"))))
derived("question_intents", "q", [("{h}用加泰语怎么说？",), ("请问形容{h}的形容词",), ("查一下{h}",), ("{w}",), ("{h}的名词",), ("查一下怎么{h}",), ("加泰语中{h}怎么说",), ("{h}的加泰语是什么",), ("把{h}，翻译成加泰语",)], "term, pos", [("{h}", None), ("{h}", "adjective"), ("{h}", None), (None, None), ("{h}", "noun"), (None, None), ("{h}", None), ("{h}", None), (None, None)], lambda d: d.withColumn("i", H.intent(F.col("q"))).select("*", "i.term", "i.pos"))
derived("grammar_templates", "kind, language, pos, q", [("definition", "en", ["noun"], "plural of {w}."), ("headword", "ca", ["pronoun"], "me'n"), ("definition", "en", ["noun"], "a {w}"), ("definition", "en", ["noun"], "synonym of {w}")], "text", ["「{w}」的复数形式", "加泰语弱读代词组合「me'n」", None, "「{w}」的同义词"], add("text", lambda: H.grammatical(F.col("kind"), F.col("language"), F.col("pos"), F.col("q"))))
derived("wordnet_terms", "q", [("{h}+的",), ("{g}",), ("待翻译{h}",), ("{w}",)], "term", ["{h}的", "{g}", None, None], add("term", lambda: H.clean_chinese(F.col("q"))))
derived("wiki_sections", "q", [("==Anglès==\nx\n== -ca- ==\n{w}\n{n}\n==Francès==\nw",), ("== Català ==\n{w}",), ("{n}\n=== ca ===\n{w}",)], "section", ["\n{w}\n{n}", "\n{w}", ""], add("section", lambda: X.section(F.col("q"))))
derived("wiki_texts", "q", [("Un [[{w}|{n}]] ''gran''.",), ("a<ref>{w}</ref> [http://u {n}]",), ("[[{n}]] '''{w}'''",)], "text", ["Un {n} gran.", "a {n}", "{n} {w}"], add("text", lambda: X.clean_wikitext(F.col("q"))))
derived("rank_minimum", "a, b", [(5, 7), (None, 4), (None, None)], "least", [5, 4, 2**53 - 1], lambda d: d.withColumn("least", E.least_rank(F.col("a").cast("long"), F.col("b").cast("long"))))
derived("gender_of_set", "g", [(["masculine", "{w}"],), (["masculine", "{w}", "feminine"],), (["common"],), (["{w}"],), (["feminine"],)], "gender", ["masculine", "common", "common", None, "feminine"], add("gender", lambda: E.gender(F.col("g"))))
derived("strict_json", "q", [('{"a":"{w}"}',), ('{"{w}":1,"{w}":2}',), ('{"a":NaN,"b":"{w}"}',), ('["{w}"',)], "ok", [True, False, False, False], add("ok", lambda: G.strict_json(F.col("q")).isNotNull()))
derived("string_lists", "v", [(["{w}", "x{v}"],), (["{w}", "{w}"],), ([],), (["{w}", " "],)], "errors", ["", "v: duplicate value", "v: must not be empty", "v: must be nonempty strings"], add("errors", lambda: F.array_join(G.strings(F.col("v"), "v", True, True), ";")))
derived("norm_catalan_profile", "q", [(" {w}  PUJANT ",), ("L’{w}",), ("co ŀl{w}".replace(" ", ""),), ("{n}–x",), ("l•l{w}",), ("café {w}",), ("a　{w}",)], "key", ["{w} pujant", "l'{w}", "col·l{w}", "{n}-x", "l·l{w}", "café {w}", "a {w}"], add("key", lambda: T.normalize(F.col("q"))))
derived("clitic_strip", "q", [("{w}-me",), ("l'{w}",), ("vaig {w}ar",), ("{w}'ls",), ("{w}",), ("vàrem {w}ir",), ("d'{w}-hi",)], "enclitic, proclitic, periphrastic", [("{w}", None, None), (None, "{w}", None), (None, None, "{w}ar"), ("{w}", None, None), (None, None, None), (None, None, "{w}ir"), ("d'{w}", "{w}-hi", None)], lambda d: d.withColumns({"enclitic": T.strip_enclitic(F.col("q")), "proclitic": T.strip_proclitic(F.col("q")), "periphrastic": T.periphrastic_past(F.col("q"))}))
derived("han_split", "q", [("{w} ; {n} ",), ("{w}(b;{v});d",), ("{w}, y",), ("（{h}；{g}）；三{h}",)], "parts", ["{w}|{n}", "{w}(b;{v})|d", "{w}, y", "（{h}；{g}）|三{h}"], add("parts", lambda: joined(T.split_outside_brackets(F.col("q"), ";；"))))


@query("edit_limits", "SELECT p_partkey, q, CASE WHEN length(q) <= 4 THEN 1 WHEN length(q) <= 8 THEN 2 ELSE 3 END AS lookup, CASE WHEN length(q) < 6 THEN 1 ELSE 2 END AS suggestion FROM (SELECT p_partkey, substr(p_name, 1, 1 + p_partkey % 11) AS q FROM part)")
def _(spark, sf):
    q = F.substring(F.col("p_name"), F.lit(1), (1 + F.col("p_partkey") % 11).cast("int"))
    return table(spark, sf, "part").select("p_partkey", q.alias("q")).withColumn("lookup", T.edit_threshold(F.col("q"))).withColumn("suggestion", T.osa_threshold(F.col("q")))


@query("osa_distances", "SELECT p_partkey, CAST(CASE WHEN substr(p_name, 1, 1) = substr(p_name, 2, 1) THEN 0 ELSE 1 END AS INTEGER) AS swapped, CAST(1 AS INTEGER) AS longer, CAST(3 AS INTEGER) AS longest FROM part")
def _(spark, sf):
    n = F.col("p_name")
    p = table(spark, sf, "part").withColumn("s", F.concat(F.substring(n, 2, 1), F.substring(n, 1, 1), F.expr("substring(p_name, 3)")))
    return p.select("p_partkey", T.osa_distance(n, "s", F.lit(3)).alias("swapped"), T.osa_distance(n, F.concat(n, F.lit("é")), F.lit(3)).alias("longer"), T.osa_distance(n, F.concat(n, F.lit("日本語日")), F.lit(2)).alias("longest"))


@query("word_class_prefer", """
WITH c AS (SELECT p_brand AS q, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, CASE p_size % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' END AS sense, p_size % 2 = 0 AS one FROM part)
SELECT q, p_partkey, CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN sense = 'noun' THEN 2 WHEN sense IS NULL AND one THEN 1 ELSE 0 END DESC, pos) AS INTEGER) AS place FROM c""")
def _(spark, sf):
    size, w = F.col("p_size"), "q"
    p = table(spark, sf, "part").select(F.col("p_brand").alias("q"), "p_partkey", F.when(size % 3 == 0, "noun").when(size % 3 == 1, "verb").alias("sense_pos"), F.when(size % 2 == 0, F.array(F.lit("noun"))).otherwise(F.array(F.lit("noun"), F.lit("verb"))).alias("p"), F.lit("noun").alias("preference"), F.col("p_partkey").alias("pos"))
    return R.prefer_class(p).select(w, "p_partkey", F.col("pos").alias("place"))


#: Chinese suggestion rows of the parts: the characters of their keys.
@query("suggest_chinese", f"""
WITH r AS MATERIALIZED (SELECT {HAN_KEY} AS key, CAST(p_partkey AS VARCHAR) AS lemma, p_partkey AS rank FROM part), q AS (SELECT DISTINCT substr(key, 1, 2) AS q FROM r WHERE length(key) >= 2),
m AS (SELECT q, key, lemma, rank, length(key) AS len, CASE WHEN key = q THEN 0 WHEN starts_with(key, q) THEN 1 WHEN contains(key, q) THEN 2 END AS score FROM q JOIN r ON contains(key, q))
SELECT q, CAST(pos AS INTEGER) AS pos, key AS term, lemma, CASE score WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'contains' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, len, rank) AS pos FROM m) WHERE pos <= 8""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(han_key().alias("key"), han_key().alias("term"), F.col("p_partkey").cast("string").alias("lemma"), F.col("p_partkey").cast("long").alias("rank"))
    q = rows.where(F.length("key") >= 2).select(F.substring("key", 1, 2).alias("q")).distinct()
    return R.suggest_chinese(q, rows)


@query("accent_equivalent_first", """
WITH l AS MATERIALIZED (SELECT translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abdefgijko') AS q, p_partkey AS k FROM part),
n AS (SELECT q, 'é' || q AS n, 3 * k + 3 AS r FROM l UNION ALL SELECT q, 'e' || q || 'x', 3 * k + 1 FROM l UNION ALL SELECT q, 'e' || q || 'y', 3 * k + 2 FROM l),
a AS MATERIALIZED (SELECT 'e' || q AS q FROM l),
m AS (SELECT a.q, n.n, n.r, strip_accents(n.n) = a.q AS accent FROM a JOIN n ON starts_with(strip_accents(n.n), a.q)),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r) AS pos FROM m QUALIFY pos <= 8)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN accent AND pos = first THEN 0 ELSE pos END) AS INTEGER) AS pos, n AS l FROM (SELECT *, min(CASE WHEN accent THEN pos END) OVER (PARTITION BY q) AS first FROM p)""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.translate(F.col("p_partkey").cast("string"), "0123456789", LATIN_DIGITS).alias("w"), F.col("p_partkey").alias("k"))
    word = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    three = F.explode(F.array(*(F.struct(word(*n).alias("n"), (3 * F.col("k") + i).alias("r")) for n, i in ((("é", F.col("w")), 3), (("e", F.col("w"), "x"), 1), (("e", F.col("w"), "y"), 2)))))
    lex = p.select(three.alias("x")).select("x.n", F.col("x.n").alias("l"), F.col("x.r").cast("long").alias("r"))
    return U.prefix_suggestions(p.select(word("e", F.col("w")).alias("q")), lex).select("q", "pos", "l")



# --- lookup and suggestions end to end: a part is an entry, its Latin word the lemma, its Chinese word and its name lead to it

W = "translate(CAST(p_partkey AS VARCHAR), '0123456789', '" + LATIN_DIGITS + "')"
ASKS = ("{h}", "查一下{h}", "{h}的名词", "{w}", "{n}", "{h}用加泰语怎么说？")


def entry_tables(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.translate(F.col("p_partkey").cast("string"), "0123456789", LATIN_DIGITS).alias("n"), han_key().alias("h"))
    classes = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("noun"))).otherwise(F.array(F.lit("noun"), F.lit("verb")))
    lex = p.select("n", F.col("n").alias("l"), classes.alias("p"), F.col("p_partkey").cast("long").alias("r"))
    terms = lambda term: p.select(F.col("n").alias("lemma"), F.col(term).alias("term"), F.lit("translation").alias("kind"), F.lit(None).cast("int").alias("priority"), F.col("p_partkey").cast("long").alias("rank"))
    return stored(p), stored(lex), stored(R.build_index(terms("p_name"), "es")), stored(R.build_index(terms("h"), "zh"))


def asked_of(parts, asks=ASKS):
    pick = F.col("p_partkey") % len(asks)
    q = F.lit(None).cast("string")
    for i, a in enumerate(asks):
        q = F.when(pick == i, text_column(a)).otherwise(q)
    return parts.select(q.alias("q")).distinct()


PICKED = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {text_sql(a)}" for i, a in enumerate(ASKS)) + " END"


@query("lookup_languages", f"""
WITH x AS MATERIALIZED (SELECT p_partkey, p_partkey % 6 AS k, p_name, {W} AS n, {HAN_KEY} AS h, {PICKED} AS q FROM part),
es AS (SELECT a.q, x.n, x.p_partkey, row_number() OVER (PARTITION BY a.q ORDER BY x.p_partkey) AS pos FROM (SELECT DISTINCT q FROM x WHERE k = 4) a JOIN x ON x.p_name = a.q QUALIFY pos <= 32)
SELECT q, CAST(1 AS INTEGER) AS pos, n, 'zh' AS language, h AS match, 'translation' AS kind, CAST(1 AS DOUBLE) AS confidence, h AS asked FROM x WHERE k IN (0, 1, 2, 5)
UNION ALL SELECT q, 1, n, 'ca', q, 'exact', 1, q FROM x WHERE k = 3
UNION ALL SELECT q, CAST(pos AS INTEGER), n, 'es', q, 'translation', 1, q FROM es""")
def _(spark, sf):
    parts, lex, spanish, chinese = entry_tables(spark, sf)
    none = spark.createDataFrame([], "surface string, lemma string, label string, pos string, ord int")
    look = lambda q: U.lookup(q, lex, none, lex.where("r < 5000"), spanish, chinese)
    return U.with_intents(asked_of(parts), look).select("q", "pos", "n", "language", "match", "kind", "confidence", "asked")


QUESTIONS = ("查一下{h}", "{h}的名词", "{h}用加泰语怎么说？")
QUESTION = "CASE p_partkey % 3 " + " ".join(f"WHEN {i} THEN {text_sql(a)}" for i, a in enumerate(QUESTIONS)) + " END"


@query("suggest_questions", f"""
WITH x AS MATERIALIZED (SELECT p_partkey, p_partkey % 3 AS k, p_size, {W} AS n, {HAN_KEY} AS h, {QUESTION} AS q FROM part), y AS MATERIALIZED (SELECT {W} AS n, {HAN_KEY} AS h, p_partkey AS r FROM part),
m AS (SELECT q, y.h AS term, y.n AS lemma, y.r, CASE WHEN y.h = x.h THEN 0 WHEN starts_with(y.h, x.h) THEN 1 ELSE 2 END AS score FROM x JOIN y ON contains(y.h, x.h) WHERE k <> 1),
e AS (SELECT q, h, n FROM x WHERE k <> 1),
r AS (SELECT q, term, lemma, score, row_number() OVER (PARTITION BY q ORDER BY score, length(term), r) AS pos FROM m QUALIFY pos <= 8),
o AS (SELECT q, term, lemma, CASE score WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'contains' END AS kind, CASE score WHEN 0 THEN 0 ELSE 2 END AS tier, pos FROM r
  UNION ALL SELECT q, '义' || h, n, 'semantic', 1, 0 FROM e)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY tier, pos) AS INTEGER) AS pos, term, lemma, 'zh' AS language, kind FROM (SELECT *, row_number() OVER (PARTITION BY q, lemma ORDER BY tier, pos) AS n FROM o) WHERE n = 1 QUALIFY pos <= 8
UNION ALL SELECT q, 1, q, n, 'zh', 'related' FROM x WHERE k = 1 AND p_size % 2 = 0""")
def _(spark, sf):
    parts, lex, spanish, chinese = entry_tables(spark, sf)
    none = spark.createDataFrame([], "surface string, lemma string, label string, pos string, ord int")
    rows = stored(R.catalogue(chinese, lex, "zh"))
    meanings = parts.select(F.col("h").alias("key"), F.col("h").alias("expression"), F.col("n").alias("lemma"), F.concat(F.lit("义"), "h").alias("label"), F.col("p_partkey").cast("long").alias("rank"), F.concat(F.lit("c-"), "n").alias("concept"), F.lit(None).cast("string").alias("pos_class"))
    look = lambda q: U.lookup(q, lex, none, lex.where("r < 5000"), spanish, chinese)
    return U.suggest(asked_of(parts, QUESTIONS), rows.limit(0), rows, lex, lex.where("r < 5000"), look=look, meanings=meanings)
