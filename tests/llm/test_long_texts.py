"""Texts of a megabyte, and words that one hash does not tell apart."""

import time
import tracemalloc

import numpy as np
import pytest

from lexmill.llm import common, decontam, licenses, neardup, pii, secrets
from lexmill.llm.common import word_hash


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("text", ["a@b.cc " + "x" * 1_000_000, "1.2.3 " + "7" * 1_000_000, "a@b.cc " * 30_000, "1.2.3.4 " * 30_000, "id: 4x " * 30_000])
def test_personal_data_in_long_texts(spark, text):
    pii.digest(docs(spark, [(1, "a@b.cc")])).collect()
    began = time.time()
    r = pii.digest(docs(spark, [(1, text)])).collect()[0]
    assert time.time() - began < 60
    assert (r.n_email, r.n_ip) == (text.count("a@b.cc"), text.count("1.2.3.4"))


def test_places_of_many_matches(spark):
    text = "é a@b.cc,1.2.3.4 +1 415 555 2671 x@y.z.w%q@r.st " * 700
    r = pii.digest(docs(spark, [(1, text)])).first()
    for part in r.spans.split(","):
        kind, a, b = part.split(":")
        assert text[int(a) : int(b)] in {"email": ("a@b.cc", "x@y.z.w", "%q@r.st"), "ip": ("1.2.3.4",), "phone": ("+1 415 555 2671",)}[kind]
    assert (r.n_email, r.n_ip, r.n_phone) == (2100, 700, 700)


@pytest.mark.parametrize("line", ["---\n", "- - -\n", "a\n", "license\n"])
def test_licences_need_memory_in_proportion(line):
    model = licenses.default_model()
    peaks = []
    for size in (1 << 15, 1 << 18):
        raw = np.frombuffer((line * (size // len(line))).encode(), np.uint8)
        common._POWERS.clear()
        tracemalloc.start()
        licenses.find(raw, np.array([0, len(raw)]), model)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 16 * peaks[0] and peaks[1] < 1 << 30


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_two_words_that_one_polynomial_confuses(spark):
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    both = np.frombuffer((x + y).encode(), np.uint8)
    h = word_hash(both, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    again = np.frombuffer(("zz" + y + "q" + x).encode(), np.uint8)
    assert set(word_hash(again, np.array([2, 1027]), np.array([1026, 2051])).tolist()) == set(h.tolist())
    got = {r.doc_id: r.component_id for r in neardup.digest(docs(spark, [(1, f"w {x}"), (2, f"w {y}"), (3, f"W {x}")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    bench = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs(spark, [(1, x), (2, y)]), bench).collect()} == {1}


def test_word_hashes_of_long_texts():
    raw = np.frombuffer(b"abcdefgh" * (1 << 21) + b"q", np.uint8)  # beyond the length whose sums are reduced
    ends = np.array([8, len(raw) - 1, len(raw)])
    h = word_hash(raw, ends - np.array([8, 8, 1]), ends)
    assert h[0] == h[1] != h[2]


@pytest.mark.parametrize("part", ["ghp_", "eyJh", "password=abcdefgh1 ", "AKIA" + "B" * 16 + " ", "0af1" * 8 + " "])
def test_secrets_in_long_texts(part):
    text, began = part * (1_000_000 // len(part)), time.time()
    found = secrets.find(text, secrets.default_grammar())
    assert time.time() - began < 30
    kinds = {"p": 0, "A": 1, "0": 2}
    assert part[0] not in kinds or sum(k == kinds[part[0]] for _, k, _ in found) == 1_000_000 // len(part)


def test_discovery_goes_on_until_nothing_is_new(spark):
    """Each word is known by the identifiers of the one before: five generations, the last one behind the least number of rounds."""
    words = ["contact", "member", "badge", "locker", "permit", "ticket"]
    sizes = [5120, 1280, 320, 80, 20, 5]
    rows = [f"write contact u{i}@mail.example.org today" for i in range(sizes[0])]
    for g in range(1, 6):
        rows += [f"{words[g - 1]} {g}77{i:05d}x then {words[g]} {g}77{i:05d}x" for i in range(sizes[g])]
    rows += [f"ticket 999{i:04d}y" for i in range(1)] + ["room 12"]
    got = {r.doc_id: r.n_context for r in pii.digest(docs(spark, list(enumerate(rows)))).collect()}
    assert all(got[i] == 2 for i in range(5120, 5120 + sum(sizes[1:]))) and got[len(rows) - 2] == 1 and got[len(rows) - 1] == 0
