"""License scans: a paragraph classifier on sparse word n-grams, its unknown class calibrated, templates to confirm.

A paragraph is a line, or consecutive lines that are not blank: all runs of up to WINDOW words, or of two lines, are
scored (n_paragraphs counts lines). Word 1-grams and 2-grams, hashed, feed a multinomial logistic regression over licence
families, `unknown` and `none`, trained here on notices of each family (see NOTICES) under edits, on notices of licences
that are none of these (see OTHERS), and on paragraphs that are no notices. A family is confirmed by the closest of its
notices: the share of the notice's words that the paragraph has, and one of the family's marks where the notice has one.
Of confirmed paragraphs that overlap, the closest to a notice stays, then the one of fewest lines. A line outside of them
is `unknown` if its probability of `none` is so low as only FALSE_UNKNOWN of other paragraphs that did not teach have it.

Null and empty texts have no paragraphs. Repeated rows give repeated rows. Other columns are not read. Offsets are in
code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, mix, prefix_hash, slices, small_batches, span_hash, word_spans
from .decontam import GAP

BUCKETS, EPOCHS, RATE, DECAY = 1 << 12, 120, 4.0, 1e-5
#: Share of a notice's distinct words that a paragraph must have; calibration: share of teaching notices accepted.
CONFIRM, CALIBRATE = 0.6, 0.02
#: Words of a run of lines: three times the longest notice.
WINDOW = 60

#: Short public notices and names of the families.
NOTICES = {
    "mit": ["released under the mit license", "licensed under the mit license", "this project is available under the terms of the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["licensed under the apache license version 2.0", "distributed under the apache license 2.0", "you may not use this file except in compliance with the apache license version 2.0"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "released under the gnu gpl v3", "this program is free software you can redistribute it under the terms of the gnu general public license version 3"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "released under the gnu gpl v2"],
    "lgpl": ["licensed under the gnu lesser general public license", "released under the gnu lgpl"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "released under the gnu agpl v3"],
    "bsd": ["licensed under the bsd license", "released under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license 2.0"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "licensed under the cc0 1.0 universal public domain dedication"],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission"],
}
#: Notices of licences without a family; {} is any name.
OTHERS = (
    "released under the {} license", "licensed under the {} public license version 2", "this work is licensed under the {} licence", "distributed under the terms of the {} license", "see the license file for the terms of use",
    "use of this material is governed by the {} license agreement", "permission to use copy modify and distribute this software for any purpose is hereby granted", "copyright {} some rights reserved under the {} licence",
)
#: Common words of running text, which notices hold as well.
COMMON = "a an and any are as at be by for from has have in is it its may no not of on or that the this to under use was were which with you".split()
#: Share of paragraphs without a licence that may count as unknown; how many of them calibrate it.
FALSE_UNKNOWN, CALIBRATION = 0.0005, 4000
#: The marks by which close families differ.
MARKS = {"gpl-3.0": "3 v3", "gpl-2.0": "2 v2", "apache-2.0": "apache", "mit": "mit", "bsd": "bsd", "lgpl": "lesser lgpl", "agpl-3.0": "affero agpl", "mpl-2.0": "mozilla", "cc-by-sa": "sa sharealike", "cc-by-nc": "nc noncommercial", "cc0": "cc0"}
NONE, UNKNOWN = "none", "unknown"
FAMILIES = (*NOTICES, UNKNOWN, NONE)


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = word_spans(GAP[raw], np.array([0, len(raw)]))
    return span_hash(prefix_hash(LOWER[raw]), s, e)


def buckets(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-grams and 2-grams with their rows."""
    two = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pair = mix(h[two] * np.uint64(3) + h[two + 1]) if len(two) else np.zeros(0, np.uint64)
    return (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[two]])


class Model:
    def __init__(self, weights: np.ndarray, accept: np.ndarray, doubt: float):
        self.weights, self.accept, self.doubt = weights, accept, doubt
        self.notices = {f: [np.unique(word_hashes(n)) for n in notices] for f, notices in NOTICES.items()}
        self.marks = {f: np.unique(word_hashes(m)) for f, m in MARKS.items()}
        often = np.unique(word_hashes("a an and any are be by for from in is it may no not of or the this to under use with you"))
        rare = [np.setdiff1d(n, often) if np.isin(n, often).mean() < CONFIRM else n for ns in self.notices.values() for n in ns]
        self.rare = np.unique(np.concatenate(rare))  # no notice is confirmed without one of these

    def shares(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of FAMILIES for each of n paragraphs."""
        b, r = buckets(h, row)
        z = np.zeros((n, len(FAMILIES)))
        count = np.maximum(np.bincount(r, minlength=n), 1)[:, None]
        for k in range(len(FAMILIES)):
            z[:, k] = np.bincount(r, self.weights[b, k], n)
        z = z / np.sqrt(count) + self.weights[BUCKETS]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def confirmed(self, family: str, h: np.ndarray) -> float:
        """The share of the closest notice's words, 0 if it is not confirmed."""
        marks = self.marks.get(family, np.zeros(0, np.uint64))
        marked = np.isin(marks, h).any()
        shares = [np.isin(n, h).mean() for n in self.notices[family] if marked or not np.isin(marks, n).any()]
        return max((x for x in shares if x >= CONFIRM), default=0.0)


def _shares(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@lru_cache(maxsize=2)
def default_model(seed: int = 5) -> Model:
    """Trained on edited notices and on other paragraphs, among them notices' words out of order."""
    rng = random.Random(seed)
    words = sorted({w for ns in NOTICES.values() for n in ns for w in n.split()} - {"license", "licensed", "copyright", "gpl", "lgpl", "agpl", "cc0", "redistribution", "redistribute", "rights"})
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def plain() -> list[str]:
        t = [noise() if rng.random() < 0.7 else rng.choice(COMMON) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.3:
            t += rng.sample(words, rng.randint(1, 3))
        rng.shuffle(t)
        return t

    def around(t: list[str]) -> list[str]:
        return [noise() for _ in range(rng.choice((0, 0, 0, 1, 3)))] + t + [noise() for _ in range(rng.choice((0, 0, 0, 1, 4)))]

    def notice(family: str) -> list[str]:
        if family == UNKNOWN:
            return " ".join(noise() if w == "{}" else w for w in rng.choice(OTHERS).split()).split()
        t = rng.choice(NOTICES[family]).split()
        if len(t) > 6 and rng.random() < 0.3:
            t.pop(rng.randrange(len(t)))
        return t

    def rows(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), BUCKETS + 1), np.float32)
        for i, t in enumerate(texts):
            h = word_hashes(" ".join(t))
            b, _ = buckets(h, np.zeros(len(h), np.int64))
            np.add.at(x[i], b, 1 / np.sqrt(max(len(b), 1)))
        x[:, BUCKETS] = 1
        return x

    texts, y = [], []
    for k, family in enumerate(FAMILIES):
        for _ in range(160 if family in NOTICES else 400 if family == UNKNOWN else 1500):
            texts.append(plain() if family == NONE else around(notice(family)))
            y.append(k)
    y = np.array(y)
    x = rows(texts)
    w = np.zeros((BUCKETS + 1, len(FAMILIES)), np.float32)
    hot = np.eye(len(FAMILIES), dtype=np.float32)[y]
    for _ in range(EPOCHS):
        w -= RATE * (x.T @ (_shares(x, w) - hot) / len(y) + DECAY * w)
    p = _shares(x, w)
    accept = np.array([np.quantile(p[y == k, k], CALIBRATE) for k in range(len(FAMILIES))])
    other = _shares(rows([plain() for _ in range(CALIBRATION)]), w)[:, -1]
    return Model(w.astype(float), np.minimum(accept, 0.9), float(min(np.quantile(other, FALSE_UNKNOWN), 0.5)))


LINE = re.compile(r"[^\n]+")
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def find(raw: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, list[tuple[int, int, int, str, float, bool]]]:
    """Paragraphs of each text; (row, first byte, last byte + 1, family, probability, confirmed), bytes counted in the text."""
    n = len(at) - 1
    ls, le, lrow = word_spans(NEWLINE[raw], at)
    out = []
    if len(ls):
        s, e, row = word_spans(GAP[raw], at)
        h = span_hash(prefix_hash(LOWER[raw]), s, e)
        line = np.searchsorted(ls, s, "right") - 1
        p = model.shares(h, line, len(ls))
        best = p.argmax(1)
        worded = np.bincount(line, minlength=len(ls)) > 0
        doubtful = worded & (p[:, -1] <= model.doubt)
        first = np.searchsorted(line, np.arange(len(ls) + 1))  # of the words of each line
        sure = []  # (-closeness, lines, first line, last line + 1, family, probability)
        for i in np.flatnonzero(best < len(NOTICES)):
            _confirm(sure, model, p[i], i, i + 1, h[first[i] : first[i + 1]])
        a, b = _windows(raw, ls, le, lrow, first, np.isin(h, model.rare), line)
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            size = first[y] - first[x]
            of = np.repeat(np.arange(len(x)), size)
            q = model.shares(h[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[x][of]], of, len(x))
            for i in np.flatnonzero(q.argmax(1) < len(NOTICES)):
                _confirm(sure, model, q[i], x[i], y[i], h[first[x[i]] : first[y[i]]])
        taken = np.zeros(len(ls), bool)
        kept = []
        for _, _, i, j, family, share in sorted(sure):
            if not taken[i:j].any():
                taken[i:j] = True
                kept.append((i, j, family, share, True))
        kept += [(i, i + 1, UNKNOWN, float(1 - p[i, -1]), False) for i in np.flatnonzero(doubtful & ~taken).tolist()]
        for i, j, family, share, ok in sorted(kept):
            r = int(lrow[i])
            out.append((r, int(ls[i] - at[r]), int(le[j - 1] - at[r]), family, share, ok))
    return np.bincount(lrow, minlength=n), out


def _confirm(sure: list, model: Model, p: np.ndarray, i: int, j: int, words: np.ndarray) -> None:
    k = int(p.argmax())
    close = model.confirmed(FAMILIES[k], words) if p[k] >= model.accept[k] else 0.0
    if close:
        sure.append((-close, int(j - i), int(i), int(j), FAMILIES[k], float(p[k])))


def _windows(raw, ls, le, lrow, first, rare, line) -> tuple[np.ndarray, np.ndarray]:
    """First lines and last lines + 1 of the runs of lines with no blank one among them that begin and end with a word: two lines
    with words, or more of at most WINDOW words. Runs without a rare word of a notice are left out. Lines without words, of
    which there may be any number, begin and end no run, so a line begins WINDOW runs at most."""
    inked = np.concatenate([[0], np.cumsum(~IS_SPACE[raw])])
    blank = inked[le] == inked[ls]
    joins = (lrow[1:] == lrow[:-1]) & (ls[1:] == le[:-1] + 1) & ~blank[1:] & ~blank[:-1]
    block = np.concatenate([[0], np.cumsum(~joins)])
    marked = np.concatenate([[0], np.cumsum(np.bincount(line[rare], minlength=len(ls)))])
    worded = np.flatnonzero(np.diff(first) > 0)
    i = np.arange(len(worded))
    a, b, more = [], [], 2
    while len(i):
        i = i[i + more <= len(worded)]
        x, y = worded[i], worded[i + more - 1]
        fit = (block[y] == block[x]) & ((more == 2) | (first[y + 1] - first[x] <= WINDOW))
        i = i[fit]
        some = marked[y[fit] + 1] > marked[x[fit]]
        a.append(x[fit][some])
        b.append(y[fit][some] + 1)
        more += 1
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, found array<struct<start, end, family, share, confirmed>> of each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("share", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        for part, raw, at in slices(batches, "text"):
            count, found = find(raw, at, shared.value)
            lists = [[] for _ in range(part.num_rows)]
            for r, s, e, family, p, ok in found:
                t = raw[at[r] : at[r + 1]]
                chars = lambda j, t=t: int(((t[:j] & 0xC0) != 0x80).sum())
                lists[r].append({"start": chars(s), "end": chars(e), "family": family, "share": p, "confirmed": ok})
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(lists, kind)], ["doc_id", "n_paragraphs", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<start:int,end:int,family:string,share:double,confirmed:boolean>>")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op4_licenses."""
    f = scan(docs)
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    return f.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_found"), families.alias("families"), spans.alias("spans"))
