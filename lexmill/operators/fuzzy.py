"""Words of a core near a query: a Levenshtein automaton walked over the sorted, front-coded core for a batch of queries at once.

The automaton of a query is bit-parallel: after some characters, bit i of state e says that the query's first i
characters can be had with e edits. All queries of an Arrow batch keep their states in arrays; a step along a character
of the core is the same few operations for all of them. Sorted core words share prefixes, so a step is made once for each
distinct prefix, and not at all where no query has a state left. Characters are UTF-16 units.

The core is a table of at most CORE_MOST words, which is checked; it goes to the tasks as one list, and queries never
meet it as a join. Queries may be any number and length (over 62 units by numbers of any size instead of arrays).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a core at most.
CORE_MOST = 50_000
#: Units of a query that fit into the bits of an array.
WIDE = 62
#: Queries that walk together.
TOGETHER = 2048


def units(text: str) -> tuple[int, ...]:
    """UTF-16 units."""
    return tuple(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist())


def front_coded(words: list[str]) -> list[tuple[int, tuple[int, ...], int]]:
    """(units shared with the word before, the units after them, place in the list) of the words in order of their units."""
    out, before = [], ()
    for u, place in sorted((units(w), i) for i, w in enumerate(words)):
        shared = 0
        while shared < min(len(u), len(before)) and u[shared] == before[shared]:
            shared += 1
        out.append((shared, u[shared:], place))
        before = u
    return out


class States:
    """The states of queries with the same number of edits: a row of bits for each number of edits up to `most`."""

    def __init__(self, queries: list[tuple[int, ...]], most: int):
        wide = max(map(len, queries), default=0) > WIDE
        kind = object if wide else np.uint64
        self.most, self.one = most, 1 if wide else np.uint64(1)
        self.masks: dict[int, np.ndarray] = {}
        for row, q in enumerate(queries):
            for i, c in enumerate(q):
                mask = self.masks.setdefault(c, np.array([self.one * 0] * len(queries), kind))
                mask[row] |= self.one << (i if wide else np.uint64(i))
        self.none = np.array([self.one * 0] * len(queries), kind)
        number = (lambda x: x) if wide else np.uint64
        self.whole = np.array([number((1 << len(q) + 1) - 1) for q in queries], kind)
        self.final = np.array([number(1 << len(q)) for q in queries], kind)
        self.start = [np.array([number((1 << min(e, len(q)) + 1) - 1) for q in queries], kind) for e in range(most + 1)]

    def step(self, rows: np.ndarray, states: list[np.ndarray], c: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The queries (rows) that have a state left after unit c, and their states."""
        mask, whole = self.masks.get(c, self.none)[rows], self.whole[rows]
        new = [((states[0] & mask) << self.one) & whole]
        for e in range(1, self.most + 1):
            moved = ((states[e] & mask) << self.one) | states[e - 1] | (states[e - 1] << self.one) | (new[e - 1] << self.one)
            new.append(moved & whole)
        left = new[-1] != 0
        return rows[left], [x[left] for x in new]

    def edits(self, rows: np.ndarray, states: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(query, edits) of the queries that end here."""
        final, taken = self.final[rows], np.zeros(len(rows), bool)
        for e, x in enumerate(states):
            hit = ((x & final) != 0) & ~taken
            taken |= hit
            for row in rows[hit]:
                yield int(row), e


def near(queries: list[str], core: list[tuple[int, tuple[int, ...], int]], most: int) -> list[tuple[int, int, int]]:
    """(query, place of the word, edits) within `most` edits; core: front_coded()."""
    if not queries:
        return []
    states = States([units(q) for q in queries], most)
    path = [(np.arange(len(queries)), states.start)]
    out = []
    for shared, rest, place in core:
        if shared >= len(path):  # no query got as far as what this word shares with the one before
            continue
        del path[shared + 1 :]
        rows, at = path[-1]
        for c in rest:
            rows, at = states.step(rows, at, c)
            if not len(rows):
                break
            path.append((rows, at))
        if len(rows):
            out += [(q, place, e) for q, e in states.edits(rows, at)]
    return out


def threshold(query: str) -> int:
    """Edits allowed, by the length of folded text in UTF-16 units."""
    n = len(units(query))
    return 1 if n <= 4 else 2 if n <= 8 else 3


def core_near(queries: DataFrame, core: DataFrame, word: Column, k: int, *order: Column) -> DataFrame:
    """q, pos, l: of each query (q, _f) the k words l of the core with the fewest edits, then in `order`.

    `word` is compared with _f. An error if the core has more than CORE_MOST rows.
    """
    rows = core.withColumn("_w", word).orderBy(*order).limit(CORE_MOST + 1).collect()
    if len(rows) > CORE_MOST:
        raise ValueError(f"a core of more than {CORE_MOST} words")
    words = front_coded([r["_w"] for r in rows if r["_w"] is not None])
    labels = [r["l"] for r in rows if r["_w"] is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), TOGETHER):
                b = batch.slice(lo, TOGETHER)
                names, keys = b.column("q").to_pylist(), b.column("_f").to_pylist()
                found: dict[int, list] = {}
                for most in (1, 2, 3):
                    some = [i for i, f in enumerate(keys) if f is not None and threshold(f) == most]
                    for at, place, edits in near([keys[i] for i in some], words, most):
                        found.setdefault(some[at], []).append((edits, place))
                out = [(names[i], pos, labels[place]) for i, hits in found.items() for pos, (_, place) in enumerate(sorted(hits)[:k], 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["q", "pos", "l"])

    return queries.select("q", "_f").mapInArrow(run, "q string, pos int, l string")
