"""Training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows."""

import base64
import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, common, decontam, graph, language, licenses, neardup, pii, quality, secrets, suffix, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, n long"


def docs(spark, rows):
    """Rows (doc_id, text[, lang]) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 1.0, 7, 7) for r in rows], DOC)


ODD = [(None, None), (1, None), (2, ""), (3, " \n "), (4, "a"), (5, "é" * 300), (6, "x " * 3000), (6, "x " * 3000), (7, "%" * 900)]
OPS = [suffix.digest, bpe.digest, licenses.digest, language.digest, secrets.digest, neardup.digest, pii.digest]


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__module__.rpartition(".")[2])
def test_odd_rows_and_empty_table(spark, op):
    out = op(docs(spark, ODD)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ODD)
    assert op(docs(spark, [])).count() == 0


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.digest(docs(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.digest(docs(spark, []), labels).count() == 0


def test_quality_separates(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality.digest(docs(spark, rows), labels).where("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in out]) > 0.95
    assert quality.keep(docs(spark, rows), labels).columns == docs(spark, rows).columns


def test_suffix_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    passage, other = prose(rng, 90), prose(rng, 120)
    rows = {i: prose(rng, 60) for i in range(8)}
    rows |= {10: prose(rng, 20) + passage + prose(rng, 9), 11: passage[:401], 12: other, 13: other, 14: "ab" * 500, 15: passage[5:404], 16: "é" + other[3:] + "ü"}
    rows |= {30 + i: prose(rng, 9) + passage + prose(rng, 9) for i in range(12)}
    rows |= {50 + i: prose(rng, 9) + passage[:300] + prose(rng, 40) for i in range(9)}
    rows |= {60 + i: other[: 40 * i] + "#" + other[40 * i + 1 :] for i in range(9)}
    want, short = suffix.brute_force(rows), suffix.brute_force(rows, suffix.PASSAGE)
    for hot in (256, 2):  # 2: the way of hot k-grams, to the last width
        monkeypatch.setattr(suffix, "HOT", hot)
        got = {r.doc_id: r for r in suffix.digest(docs(spark, rows.items())).collect()}
        assert {i: tuple(r)[1:5] for i, r in got.items()} == want
        assert {i: r.n_passage for i, r in got.items()} == {i: x[1] for i, x in short.items()}


def test_suffix_counts_repeated_rows_as_repeats(spark):
    text = prose(random.Random(7), 120)
    got = suffix.digest(docs(spark, [(1, text), (1, text), (2, text[:399]), (None, None)])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted([(0, 0, 0), (399, 0, 0), (len(text), len(text), 1), (len(text), len(text), 1)])


def test_suffix_of_a_text_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1 << 12)
    monkeypatch.setattr("lexmill.llm.common.SLICE_BYTES", 1 << 11)
    rng = random.Random(8)
    passage, rows = prose(rng, 100), {}
    rows[1] = prose(rng, 500) + passage + prose(rng, 700) + passage + prose(rng, 300)
    rows[2] = prose(rng, 640) + passage[:450] + prose(rng, 100)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.digest(docs(spark, rows.items())).collect()}
    assert got == suffix.brute_force(rows)


def test_suffix_bounds_the_memory_of_a_worker():
    rng = np.random.default_rng(9)

    def peak(run):
        common._POWERS.clear()
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return most

    block = [(i // 2, 336, 168, rng.integers(97, 123, 567).astype(np.uint8).tobytes()) for i in range(suffix.BLOCK_BYTES // 567 + suffix.HOT)]
    raw = rng.integers(97, 123, suffix.CHUNK + suffix.LENGTH - 1).astype(np.uint8)
    assert peak(lambda: suffix.repeated_in_block(block)) < 120
    assert peak(lambda: suffix.stretches(raw, np.array([0, len(raw)]))) < 120


def test_cover_reaches_every_pair_of_residues():
    p, d = suffix.PERIOD, set(suffix.COVER)
    assert all(any((a + s) % p in d and (b + s) % p in d for s in range(p)) for a in range(p) for b in range(p))


def test_bpe_equals_the_library_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "it's 12²½ \x1c\x85 x", "a" * 5000, "日本 👍🏽 <|endoftext|>"] + ["".join(rng.choice("ab \n't1%éß　") for _ in range(300)) for _ in range(40)]
    rows = docs(spark, enumerate(texts))
    for r in bpe.digest(rows).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.detokenize(bpe.tokenize(rows)).collect()
    assert all(texts[r.doc_id] == r.text for r in back)


def test_pipeline_decodes_its_tokens(spark):
    from corpus_pipeline import STAGES

    texts = ["", "it's 12²½", "日本 👍🏽", "a" * 900, None]
    out = {r.doc_id: r for r in STAGES[-1][1](spark, docs(spark, enumerate(texts)), "").collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "TILE", 1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(120)]
    odd = [(200, None), (201, []), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (None, [1.0] * 8), (205, [1.0] * 3)]
    whole = [*rows, rows[5], rows[10]]  # repeated rows are rows of their own
    v = topk.quantize(spark.createDataFrame([(i, x, 0, 0) for i, x in [*whole, *odd]], "vec_id long, embedding array<double>, row int, score int"))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 10 == 0, 5, groups=3).collect())
    data = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in whole]
    want = Counter()
    for n, (q, x) in enumerate(data):
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for m, (i, y) in enumerate(data) if m != n)[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.digest(empty).count() == 0


def test_topk_of_large_components(spark):
    rows = [(0, [2.0**40, 1.0]), (50, [2.0**40, -1.0]), (3, [2.0**-8, 2.0**-8]), (4, [-(2.0**40), 0.0])]
    v = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.vec_id, r.score) for r in topk.top_k(v.where("vec_id in (0, 3)"), F.col("vec_id") == 0).collect()}
    assert got == {(3, 2**48 + 256)}
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(v, F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="62 bits"):
        topk.digest(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def components_of(sets):
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_neardup_against_brute_force(spark):
    rng = random.Random(5)
    base = prose(rng, 150).split()
    rows = {i: prose(rng, 60) for i in range(20)}
    for i in range(40, 90):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows[i] = " ".join(w)
    rows |= {100: "one", 101: "ONE", 102: "one two", 103: "", 104: rows[3].upper(), 105: "a b c d e f", 106: "a b c d e f g"}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    want = components_of(sets)
    for r in neardup.digest(docs(spark, rows.items())).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice((3, 6, 20, 40)))) for i in range(12)] + [(None, "x"), (50, None), (51, ""), (3, None)]
    texts = {i: prose(rng, 80) for i in range(10)}
    texts[3] = prose(rng, 9) + " " + items[0][1].upper() + ", " + prose(rng, 5)
    long_item = next(t for _, t in items if len(t.split()) == 40).split()
    near = [*long_item[:38], "zz", "yy"]
    texts[4] = prose(rng, 11) + " " + " ".join(near)
    texts[5] = items[1][1]

    def words(t):
        return re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower())

    want = {}
    for d, t in texts.items():
        w = words(t)
        for i, x in items:
            y = words(x or "")
            n, k = len(y), min(5, len(y))
            for s in range(len(w) - n + 1) if n and i is not None else ():
                a, b = (Counter(tuple(z[j : j + k]) for j in range(n - k + 1)) for z in (w[s : s + n], y))
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and sim > want.get((d, i), (0,))[0]:
                    want[d, i] = sim, s
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8192, 4):  # several passes
        got = {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start_word) for r in decontam.contaminated(docs(spark, texts.items()), bench, items=size).collect()}
        assert got == want and {3, 4, 5} <= {d for d, _ in got}
    kept = {r.doc_id for r in decontam.keep(docs(spark, texts.items()), bench).collect()}
    assert kept == set(texts) - {d for d, _ in want}
    assert decontam.contaminated(docs(spark, ODD), bench.limit(0)).count() == 0


def test_secrets(spark):
    fresh = secrets.labelled(20, seed=99)
    g = secrets.default_grammar()
    for family, tokens in fresh.items():
        share = np.mean([g.score(t)[1] >= secrets.LOG_ODDS for t in tokens])
        assert share <= 0.01 if family == "ordinary" else share >= 0.9
    text = "é token: token=abcdefgh1 PassWord = 'short' AKIA" + "A" * 12 + " " + "0af" * 12 + " " + fresh["forge"][0]
    r = secrets.digest(docs(spark, [(1, text)])).first()
    assert (r.n_assign, r.n_access, r.n_hex, r.n_format) == (1, 1, 1, 1)
    for part in r.spans.split(","):
        kind, a, b = part.split(":")
        assert {"assign": "token: token=abcdefgh1", "access": "AKIA" + "A" * 12, "hex": "0af" * 12, "format": fresh["forge"][0]}[kind] == text[int(a) : int(b)]
    clean = secrets.scan(docs(spark, [(1, text), (2, None)]), redact="#").orderBy("doc_id").collect()
    assert clean[0].text == "é # PassWord = 'short' # # #" and clean[0].n_chars == len(clean[0].text) and clean[1].text is None


def test_secrets_inside_runs():
    g, fresh = secrets.default_grammar(), secrets.labelled(40, seed=98)
    for family in ("forge", "pay", "maps", "web", "chat"):
        for before, after in (("", ""), ("GH_PAT=", ""), ("https://a.example/x?key=", "&y"), ("path/", "/tail"), ("a.b/v2/", "."), ("3D", ""), ("x_", "=")):
            hit = 0
            for t in fresh[family]:
                text = f"is {before}{t}{after} it"
                s = 3 + len(before)
                hit += any(a <= s and b >= s + len(t) for a, _, b in secrets.find(text, g))
            assert hit >= 0.9 * len(fresh[family]), (family, before)
    rng = random.Random(12)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(36)) for _ in range(20)]
    assert all(secrets.find("ghp_" + x, g) == [(0, 3, 40)] for x in letters)
    assert secrets.find("GH_PAT=ghp_" + letters[0] + "/tail.", g) == [(7, 3, 47)]
    for t in fresh["ordinary"]:
        assert not secrets.find("dir/" + t, g)


def test_pii_base_and_context(spark):
    rows = [(i, f"badge: 41{i:02d}-77 ok, mail: u{i}@mail.example.com") for i in range(12)] + [(50, "ip: 300.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 tel +1 (415) 555-2671 a@b.c%d@e.f"), (60, "1 " * 9000 + "a." * 9000)]
    rows += [(100 + i, f"reach: +1 415 555 26{i:02d} or code: +141555526{i:02d}") for i in range(9)]
    out = {r.doc_id: r for r in pii.digest(docs(spark, rows)).collect()}
    r = out[50]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 1, 1, 1)
    assert out[60].spans == "" and all(out[i].n_email == 1 and out[i].n_context == 0 for i in range(12))


def test_pii_discovers_by_context(spark):
    rows = [(i, f"host: 10.0.0.{i} up") for i in range(20)] + [(99, "host: 10.0.0.999 up")]
    out = {r.doc_id: r for r in pii.digest(docs(spark, rows)).collect()}
    assert out[99].spans == "context:6:16" and out[99].n_ip == 0


def test_pii_every_base_span_is_a_seed(spark):
    texts = ["phone: +14155552671", "phone +1 415 555 2671", "tel +1 (415) 555-2671.", "card 4111 1111 1111 1111", "to jane.roe@mail9.example.com", "of.55@x of.55@mail9.example.com", "fon2 <a@b.example>", "x(+14155552671", "ip 1.2.3.4 5.6.7.8"]
    got = spark.createDataFrame([(x,) for x in texts], "text string")
    spans = F.array_sort(F.concat(*(pii.base(F.col("text"))[k] for k in pii.KINDS[:4])))
    got = got.select("text", spans.alias("bare")).select("text", "bare", pii.near(F.col("text"), F.col("bare")).alias("near"))
    for r in got.collect():
        assert r.bare and {(b.start, b.end, b.m) for b in r.bare} == {(x.start, x.end, x.instance) for x in r.near if x.seed}, r.text
        assert all(r.text[x.start : x.end] == x.instance for x in r.near)
    one = spark.createDataFrame([("id=12345678, a 7",)], "text string").select(pii.near(F.col("text"), F.array_sort(pii.base(F.col("text"))["card"])).alias("near")).first().near
    assert [(x.word, x.instance, x.seed) for x in one] == [("id", "12345678", False), ("a", "7", False)]


def test_pii_discovers_by_the_word_alone(spark):
    rows = [(i, f"phone: +141555526{i:02d} mail: u{i}@a.example card 4111 1111 1111 1111") for i in range(20)]
    rows += [(98, "phone: 4155559999 and mail: jane@local, page 17"), (99, "4155559999")]
    out = {r.doc_id: r.spans for r in pii.digest(docs(spark, rows)).collect()}
    assert out[98] == "context:7:17,context:28:38" and out[99] == ""


def test_language(spark):
    rng = random.Random(8)
    make = {"aa": "etaoin", "bb": "zxqwkv"}
    rows = [(i, " ".join("".join(rng.choice(make[k]) for _ in range(5)) for _ in range(30)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "123 !!", None), (502, "語", None)]
    out = {r.doc_id: r for r in language.digest(docs(spark, rows)).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:120]) and all(0 <= r.score <= 1 for r in out.values())
    assert out[500].lang_pred == out[501].lang_pred == "und" != out[502].lang_pred


def test_licenses(spark):
    rng = random.Random(9)
    rows = [(1, prose(rng, 30) + "\nReleased under the MIT License.\n" + prose(rng, 9)), (2, prose(rng, 200)), (3, "This is licensed under the Frob Terms license."), (4, "Licensed under CC BY-NC 4.0.")]
    out = {r.doc_id: r.families for r in licenses.digest(docs(spark, rows)).collect()}
    assert out == {1: "mit", 2: "", 3: "unknown", 4: "cc-by-nc"}
    assert licenses.scan(docs(spark, rows)).where("doc_id = 1").select(F.explode("found").alias("x")).first().x.confirmed


def test_licenses_of_notices_and_wrapped_ones(spark):
    import textwrap

    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in it'
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    nc = "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"
    rng, texts, want = random.Random(10), [], []
    for notice, family in ((mit, "mit"), (bsd, "bsd"), (nc, "cc-by-nc"), ("Released under the GNU GPL v3", "gpl-3.0"), ("Released under the GNU GPL v2", "gpl-2.0")):
        for text in (notice, *(textwrap.fill(notice, w) for w in (75, 40, 25)), prose(rng, 25) + "\n" + textwrap.fill(notice, 72) + "\n" + prose(rng, 25)):
            texts.append(text)
            want.append(family)
    texts += ["Permission is hereby granted, free of charge, to any person\n\nobtaining a copy of this software and associated documentation files", "\n".join(prose(rng, 8) for _ in range(50))]
    want += ["", ""]
    out = {r.doc_id: r.families for r in licenses.digest(docs(spark, enumerate(texts))).collect()}
    assert [out[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("wide", [0, 64, 4096])
def test_brief_sets_lose_no_link(monkeypatch, wide):

    monkeypatch.setattr(neardup, "WIDE", wide)
    rng, rows = np.random.default_rng(5), []
    for k in range(300):
        n, cut = int(rng.integers(1, 130)), float(rng.uniform(0, 0.4))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64((1 << 63) - (1 << 55)) if k % 3 == 0 else rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x = np.unique(x)
        y = np.unique(np.concatenate([x[rng.random(len(x)) > cut], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), dtype=np.uint64)]))
        rows.append((k, x, y))
    linked = {k for k, x, y in rows if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}

    class Pairs:
        def mapInArrow(self, run, schema):
            pack = lambda side: pa.array([neardup._brief(r[side]) for r in rows], pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[0] for r in rows]), pack(1), pack(2)], ["a", "b", "ha", "hb"])
            return [a for out in run([batch]) for a in out.column("a").to_pylist()]

    kept = set(neardup._possible(Pairs(), 80))
    assert linked and linked <= kept < {r[0] for r in rows}


def test_neardup_of_ids_with_several_texts_and_repeated_rows(spark):
    rows = [(6, "alpha beta gamma delta epsilon"), (6, "one two three four five six"), (7, "one two three four five six"), (8, "alpha beta gamma delta epsilon"), (9, "lone text here now"), (9, "lone text here now"), (None, "lone text here now")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.digest(docs(spark, rows)).collect())
    assert got == Counter([(6, 6, True), (6, 6, True), (7, 6, False), (8, 6, False), (9, 9, True), (9, 9, True), (None, None, False)])
    from corpus_pipeline import neardup_stage

    left = Counter((r.doc_id, r.text) for r in neardup_stage(spark, docs(spark, rows), "").collect())
    assert left == Counter([rows[0], rows[1], rows[4], rows[6]])


def test_neardup_recall_on_the_driver_tables(spark):
    """Every link of all pairs is found, whole texts, two words."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
    got = {r.doc_id: r.component_id for r in neardup.digest(spark.createDataFrame(table)).collect()}
    assert got == components_of(sets)


def test_pii_discovers_a_second_generation(spark):
    """Numbers under a word of e-mails are found, and so are numbers under a word that only those share."""
    rows = [(i, f"write contact u{i}@mail.example.org today") for i in range(20)]
    rows += [(100 + i, f"contact 77{i:04d}x then member 77{i:04d}x") for i in range(8)]
    rows += [(200, "member 550000y"), (201, "room 12")]
    got = {r.doc_id: r.n_context for r in pii.digest(docs(spark, rows)).collect()}
    assert all(got[100 + i] == 2 for i in range(8)) and got[200] == 1 and got[201] == 0


def test_secret_spans_are_rated(spark):
    key = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6"
    r = secrets.digest(docs(spark, [(1, f"token = {key}"), (2, "password: hunter2hunter2")])).orderBy("doc_id").collect()
    assert r[0].n_assign == 1 and r[0].scores.startswith("forge:") and r[1].scores == ":0.0"


def test_licenses_without_a_family_are_unknown(spark):
    rows = [(1, "some text\nreleased under the zorgon license\nmore text"), (2, "we walked to the house and the dog was with us for a time"), (3, "released under the mit license"), (4, "the use of this is for the people who have it and are with you")]
    got = {r.doc_id: r.families for r in licenses.digest(docs(spark, rows)).collect()}
    assert got == {1: "unknown", 2: "", 3: "mit", 4: ""}


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline

    rng = random.Random(9)
    item = prose(rng, 20)
    good = {i: prose(rng, 80) for i in range(0, 120)}
    texts = dict(good)
    texts[40] = texts[30]  # exact copy
    w = texts[31].split()
    w[40] = "edited"
    texts[41] = " ".join(w)  # near copy
    texts[42] = prose(rng, 40) + " " + item + " " + prose(rng, 40)
    texts[43] = texts[43] + " password: hunter2hunter2 " + prose(rng, 10)
    junk = {1000 + i: " ".join("#" + x.upper() + "!!$" for x in prose(rng, 60).split()) for i in range(60)}
    rows = [(i, t, "en", "s", len(t)) for i, t in (texts | junk).items()] + [(77, texts[77], "en", "s", 1)]  # a repeated row
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in good if i not in (43, 44)] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i: t for i, t in texts.items() if i not in (40, 41, 42)}
    want[43] = re.sub(r"password: \S+", corpus_pipeline.MARK, want[43])
    assert Counter(r.doc_id for r in out) == Counter(list(want))
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() and r.n_tokens == len(enc.encode_ordinary(want[r.doc_id]))


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], schema)
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns and stage(spark, odd, str(tmp_path)).count() <= len(ODD)
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
