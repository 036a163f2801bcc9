"""Quality rules, prefix trie and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lexmill.llm import repair, rules, trie
from lexmill.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, host string, row long, lines string, doc string, gone int"
CONVS = "conv_id long, turn long, role string, text string, pos long, label long, n long, depth long, edits string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, h, "x", 7, "x", "x", 1) for i, t, h in rows], DOCS)


def talks(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7, "x") for r in rows], CONVS)


def rules_by_hand(rows):
    split = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", "".join(c.lower() if c.isascii() else c for c in x))).strip(" ")
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t or "")
        for x in split(t or ""):
            held[h, norm(x)].add(t)
    over = {k for k, v in held.items() if len(v) > 10 and 100 * len(v) > len(hosts[k[0]])}
    out = []
    for i, t, h in rows:
        t = t or ""
        w, lines = WORD.findall(t), split(t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if often[x] > 1 for k in range(3)}
        lost = sum(len(WORD.findall(x)) for x in lines if (h, norm(x)) in over)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and 100 * (len(w) - lost) >= 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, kept, lost))
    return out


def test_rules_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé1#") for _ in range(rng.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    menu = ["Home  | About 12", "HOME | about 7", "Terms\tof use #1", "x" * 900]
    rows = [(None, None, None), (1, None, "h"), (2, "", "h"), (3, "\n\n \n", "h"), (4, "a", "h"), (4, "a", "h"), (5, "\r\nq\r\nq\n\nq ", None), (6, "é x " * 90, "h")]
    for i in range(300):
        own = [line(rng.randint(0, 12)) for _ in range(rng.randint(0, 12))]
        own += rng.sample(menu, 2) * rng.choice((0, 1, 1, 8)) if i % 3 else rng.sample(own, len(own) // 2)
        rng.shuffle(own)
        rows.append((100 + i, "\n".join(own), rng.choice(("h", "k", None))))
    shared = line(60)
    rows += [(1000 + i, shared + "\n" + line(3), "h") for i in range(30)] + [(2000 + i, shared + " copy", "k") for i in range(30)] + [rows[20]] * 2
    got = Counter(tuple(r) for r in rules.digest(documents(spark, rows)).collect())
    assert got == Counter(rules_by_hand(rows))
    verdicts = {r[0]: r[7] for r in got}
    assert not any(verdicts[1000 + i] for i in range(30)) and all(verdicts[2000 + i] for i in range(30))  # a line of many texts, and one text many times
    assert rules.digest(documents(spark, [])).count() == 0


def test_rules_clean_removes_lines_and_passes_columns_on(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(60))
    rows = [(i, prose() + f"\nCookie notice {i}\n" + prose(), "h") for i in range(20)]
    docs = documents(spark, rows)
    out = rules.clean(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {i: "\n".join(t.split("\n")[::2]) for i, t, _ in rows}
    joined = rules.removed(rules.measured(docs), rules.over_limit(rules.measured(docs))).count()
    assert joined == 20


def test_rules_joins_by_sorting_beyond_the_bound(spark, monkeypatch):
    rows = [(i, f"{i} a\nmenu one\n" + "w " * 9, "h") for i in range(30)]
    want = Counter(rules_by_hand(rows))
    monkeypatch.setattr(rules, "BROADCAST", 0)
    assert Counter(tuple(r) for r in rules.digest(documents(spark, rows)).collect()) == want


def test_rules_of_long_texts_take_seconds():
    for text in ("--- " * 250_000, "---\n" * 250_000, "a" * 1_000_000, "\n" * 1_000_000, "é" * 500_000):
        raw, began = np.frombuffer(text.encode(), np.uint8), time.time()
        out = rules.measure(raw, np.array([0, len(raw)]), ["h"])
        assert out[0][0] == len(WORD.findall(text)) and time.time() - began < 10


def trie_by_hand(rows):
    own, whole = defaultdict(list), {}
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    said = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = said.get(base, [])[:h] + said[c][h:]
    node = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            node[tuple(v[:d])].append(c)
    out = []
    kids = defaultdict(list)
    for k in node:
        if k:
            kids[k[:-1]].append(k)

    def fold(k):
        below = [fold(x) for x in kids[k]]
        own = (len(node[k]) - 1) * (len(k[-1][1]) if k else 0)
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = ",".join(map(str, sorted(c for c in node[k] if len(whole[c]) == len(k))))
        out.append((min(node[k]), len(k), min(node[k[:-1]]) if k else None, len(node[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if node:
        fold(())
    return out


def random_talks(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            text = rng.choice(("hi", "é!", "", None, "so.", "well", "no?\n")) if rng.random() < 0.8 else str(rng.random())
            rows.append((c if c % 9 else -c, rng.choice((t, t, t, None, 3)), rng.choice(("user", "assistant", "user", "system", None, "umpire", "")), text))
    return [*rows, *rows[:4], (None, 1, "user", "x"), (None, None, None, None), (500, 0, "user", "."), (777_777_777_777, 2, "user", "hi")]


@pytest.mark.parametrize("stride", [1024, 16])
def test_trie_against_brute_force(spark, stride, monkeypatch):
    rng = random.Random(stride)
    rows = random_talks(rng, 250)
    deep = [(t, "user", f"d{t}") for t in range(60)]
    rows += [(c, *x) for c in (600, 603, 607, 1600) for x in (deep if c != 607 else [*deep[:40], (40, "user", "other")])]
    rows += [(c, 0, "user", "hi") for c in range(2000, 2060)]
    if stride != 1024:
        monkeypatch.setattr(trie, "PACK", 7)
        monkeypatch.setattr(trie, "BROADCAST", 0)
    got = Counter(tuple(r) for r in trie.digest(talks(spark, rows)).collect())
    assert got == Counter(trie_by_hand(rows))


def test_trie_of_long_prefixes(spark):
    """More turns than a round takes, so that rounds of STRIDE turns follow one another."""
    rows = [(c, t, "user", str(t) if t < 2300 + c else "x") for c in (0, 100, 200) for t in range(2700)]
    got = {(r.conv_id, r.depth): r for r in trie.digest(talks(spark, rows)).collect()}
    assert got[0, 2300].n_convs == 3 and got[0, 2301].n_convs == 1 and got[100, 2400].n_convs == 2 and got[100, 2401].n_convs == 1
    assert got[0, 0].n_leaves == 3 and len(got) == 2700 + 1 + 2700 - 2300 + 2700 - 2400
    assert got[0, 0].saved_tokens == 2 * sum(len(str(t)) for t in range(2300)) + sum(len(str(t)) for t in range(2300, 2400))


def test_trie_of_empty_tables_and_one_conversation(spark):
    assert trie.digest(talks(spark, [])).count() == 0
    assert trie.digest(talks(spark, [(None, 1, "user", "x")])).count() == 0
    one = [(7, 0, "user", "x"), (7, 1, "assistant", "y")]
    assert Counter(tuple(r) for r in trie.digest(talks(spark, one)).collect()) == Counter(trie_by_hand(one))


GRAMMAR = re.compile(r"(?:s?(?:ua)+)?")


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, fault) by trying every sequence of edits with up to two inserted turns in a row."""
    best = None
    choices = [(("D", 3, None),) + (() if f in ("blank", "duplicate") else (("K", 0, r), ("R", 2, "user"), ("R", 2, "assistant"))) for r, _, f in rows]
    for puts in itertools.product(*[[p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)):
        for edits in itertools.product(*choices):
            cost, audit, turns = 2 * sum(map(len, puts)), "", []
            for put, (e, c, role), (_, text, fault) in zip(puts, edits, rows, strict=False):
                audit += "I" * len(put) + e
                turns += [(p, "") for p in put] + ([(role, text)] if e != "D" else [])
                cost += c + (e != "D" and fault == "truncated")
            audit += "I" * len(puts[-1])
            turns += [(p, "") for p in puts[-1]]
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
                best = cost, audit, turns
    return best


def by_strings(rows):
    """The same by a search over whole audit strings, for rows of any number."""
    put = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, turns) in best.items():
            for n in range(4):
                for e, c, r in (("D", 3, None), ("K", 0, role), ("R", 2, put[s])):
                    if e == "D" or fault not in ("blank", "duplicate"):
                        to = s if e == "D" else after.get((s, r[:1]))
                        if to is not None:
                            x = (cost + c + (e != "D" and fault == "truncated"), audit + e, (*turns, (r, text)) if e != "D" else turns)
                            new[to] = min(new.get(to, x), x, key=lambda v: v[:2])
                s, cost, audit, turns = after[s, put[s][0]], cost + 2, audit + "I", (*turns, (put[s], ""))
        best = new
    ends = []
    for s, (cost, audit, turns) in best.items():
        for _ in range(3):
            if s in (0, 3):
                ends.append((cost, audit, turns))
            s, cost, audit, turns = after[s, put[s][0]], cost + 2, audit + "I", (*turns, (put[s], ""))
    return min(ends, key=lambda v: v[:2])


def repair_by_hand(rows, search=by_strings):
    out, talk, ids = [], defaultdict(list), set()
    for c, t, r, x in rows:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        order = (t is not None, t or 0), r, hashlib.sha256(x.encode()).hexdigest()
        if fate:
            x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
            talk[c] += [(order, t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    for c in ids:
        turns = sorted(talk[c], key=lambda v: v[0])
        faulty, seen = [], set()
        for _, _, r, x in turns:
            bare = x.rstrip(" \t\n\x0b\x0c\r")
            faulty.append((r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((r, x))
        n = Counter(f for _, _, f in faulty)
        numbers = [t for _, t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, said = search(faulty)
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()))
    return out


def test_search_tries_everything():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(("user", "assistant", "system", "bot")), rng.choice("xy."), rng.choice(("", "", "blank", "duplicate", "truncated"))) for _ in range(rng.randint(0, 3))]
        cost, audit, turns = cheapest(rows)
        codes = bytes({"s": 1, "u": 2, "a": 3}.get(r[0], 0) for r, _, _ in rows)
        got, parts, tail = repair.Search().run(codes, bytes(repair.FAULTS.index(f) for _, _, f in rows))
        assert (got, "".join(parts) + "I" * tail) == (cost, audit)
        assert by_strings(rows)[:2] == (cost, audit) and list(by_strings(rows)[2]) == turns


def test_repair_against_brute_force(spark):
    rows = random_talks(random.Random(6), 300)
    assert Counter(tuple(r) for r in repair.digest(talks(spark, rows)).collect()) == Counter(repair_by_hand(rows))
    assert repair.digest(talks(spark, [])).count() == 0


def test_repair_of_long_conversations(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(("user", "assistant", "system")), rng.choice(("a.", "b", str(rng.random()) + "!"))) for t in range(3000)]
    assert [tuple(r) for r in repair.digest(talks(spark, rows)).collect()] == repair_by_hand(rows)
    began = time.time()
    n = 400_000
    cost, codes, _ = repair.Search().run(bytes(rng.choices((0, 1, 2, 3), k=n)), bytes(rng.choices((0, 0, 1, 2, 3), k=n)))
    assert len(codes) == n and cost > 0 and time.time() - began < 10


def test_repaired_turns_follow_the_grammar(spark):
    found, turns = repair.repair(talks(spark, random_talks(random.Random(8), 80)))
    said = defaultdict(list)
    for r in turns.collect():
        said[r.conv_id].append((r.pos is None, r.pos or 0, r.k, r.role[:1]))
    assert all(GRAMMAR.fullmatch("".join(x[3] for x in sorted(v))) for v in said.values())
    assert found.where("cost = 0").count() < found.count()


@pytest.mark.parametrize("name", ["op11_rules", "op12_trie", "op13_repair"])
def test_sql_agrees(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out, con = queries()[name](spark, sf), con.execute(oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(out.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in out.collect()) == Counter(con.fetchall())
