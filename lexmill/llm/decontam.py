"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Words are runs without white space and ASCII punctuation, ASCII letters in lower case. An item of n words is compared
with windows of n words, each as the multiset of its shingles of WORDS words (a shorter item: of all its words). A
window can only be similar enough if NEED of its shingles are shingles of some item; other windows are not
fingerprinted. A window's fingerprint (BITS bits) is looked up by blocks of 8 bits: two fingerprints at most RADIUS
apart have some block at most RADIUS // BLOCKS apart, and the items of a size are listed under all such neighbours of
their blocks, so the lookup gives every item of the window's size within RADIUS. Candidates are confirmed by the weighted Jaccard similarity of the
multisets. At similarity 0.8 fingerprints differ in about 19 of 128 bits; one in a million is beyond RADIUS.

Items are broadcast ITEMS at a time (a bound in items and, by ITEM_BYTES, in bytes); more items take more passes. Null
and empty texts and items match nothing; rows with a null item_id take no part. Repeated rows give repeated rows, but
repeated items count once. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, mix, slices, small_batches, word_hash, word_spans

WORDS, SIMILAR = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 16, 40
ITEMS, ITEM_BYTES = 8192, 16 << 20
#: What separates words: white space and ASCII punctuation.
GAP = IS_SPACE.copy()
GAP[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    s, e, row = word_spans(GAP[raw], at)
    return word_hash(LOWER[raw], s, e), row


def shingle(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` neighbouring words from each place that has them."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * np.uint64(31) + h[j : j + n] + np.uint64(j))
    return out


def simhash(windows: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of BITS // 8 bytes, of rows of shingle hashes (a repeated hash weighs more)."""
    out = np.zeros((len(windows), BITS), np.int32)
    for j in range(windows.shape[1]):
        both = np.stack([windows[:, j], mix(windows[:, j] ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
        out += np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32)
    return np.packbits(2 * out > windows.shape[1], axis=1)


ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Index:
    """Items of one pass."""

    def __init__(self, items: list[tuple[int, str]], words_: int = WORDS, similar: float = SIMILAR):
        self.similar, self.ids, self.bags, prints, sizes = similar, [], [], [], []
        self.by_size: dict[int, np.ndarray] = {}
        grams: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _ = words(raw, np.array([0, len(raw)]))
            if not len(h):
                continue
            width = min(words_, len(h))
            g = shingle(h, width)
            self.ids.append(item_id)
            self.bags.append(Counter(g.tolist()))
            prints.append(simhash(g[None, :])[0])
            sizes.append(len(h))
            grams.setdefault(width, []).append(g)
        self.sizes = np.array(sizes, np.int64)
        self.prints = np.array(prints, np.uint8).reshape(len(prints), BITS // 8)
        self.words = words_
        self.grams = {w: np.unique(np.concatenate(g)) for w, g in grams.items()}
        # of each size, block and byte: the items, as bits, that have a byte at most RADIUS // BLOCKS bits away there
        near = ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == n)
            self.tables[n] = own, np.stack([np.packbits(near[:, self.prints[own, b]], axis=1) for b in range(BLOCKS)])

    def need(self, n: int) -> int:
        """Least number of a window's shingles that are an item's, at the least similarity, for n-word windows."""
        m = n - min(self.words, n) + 1
        return max(1, int(np.ceil(2 * m * self.similar / (1 + self.similar) - 1e-9)))

    def matches(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(row, item, first word, similarity) of windows of all texts of a batch; first word counted in the text."""
        out = []
        first = np.searchsorted(row, np.arange(int(row.max(initial=-1)) + 2))
        for width, known in self.grams.items():
            g = shingle(h, width)
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = (known[at] == g) & (row[: len(g)] == row[width - 1 : width - 1 + len(g)])
            if not hit.any():
                continue
            total = np.concatenate([[0], np.cumsum(hit)])
            for n in np.unique(self.sizes[np.minimum(self.sizes, self.words) == width]).tolist():
                m = n - width + 1
                if m > len(g):
                    continue
                s = np.flatnonzero(total[m:] - total[: len(total) - m] >= self.need(n))
                s = s[row[s] == row[s + n - 1]]
                for i in range(0, len(s), 4096):
                    out += self._look(g, s[i : i + 4096], n, m, row, first)
        return out

    def _look(self, g, s, n, m, row, first):
        windows = g[s[:, None] + np.arange(m)]
        f = simhash(windows)
        own, table = self.tables[n]
        bits = np.zeros((len(s), table.shape[2]), np.uint8)
        for b in range(BLOCKS):
            bits |= table[b][f[:, b]]
        w, k = np.nonzero(np.unpackbits(bits, axis=1, count=len(own)))
        item = own[k]
        ok = ONES[f[w] ^ self.prints[item]].sum(1) <= RADIUS
        out = []
        for i, k in zip(w[ok].tolist(), item[ok].tolist(), strict=True):
            bag = Counter(windows[i].tolist())
            both = sum((bag & self.bags[k]).values())
            similarity = both / (2 * m - both)
            if similarity >= self.similar - 1e-9:
                r = int(row[s[i]])
                out.append((r, self.ids[k], int(s[i] - first[r]), similarity))
        return out


def passes(benchmark: DataFrame, items: int, most_bytes: int):
    """Lists of (item_id, text) of bounded size that together hold all items."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    held, size = [], 0
    for r in rows.sort("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if len(held) == items or size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, words_: int = WORDS, similar: float = SIMILAR, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, start_word: the best window (then the first) of each row of docs and item."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, similarity double, start_word long"
    out = None
    for part in passes(benchmark, items, ITEM_BYTES):
        shared = spark.sparkContext.broadcast(Index(part, words_, similar))

        def run(batches, shared=shared):
            for part, raw, at in slices(batches, "text"):
                h, row = words(raw, at)
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for r, item, start, sim in shared.value.matches(h, row):
                    if (r, item) not in best or (-sim, start) < best[r, item]:
                        best[r, item] = -sim, start
                ids = part.column("doc_id")
                cols = [[ids[r].as_py() for r, _ in best], [k for _, k in best], [-v for v, _ in best.values()], [v for _, v in best.values()]]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "similarity", "start_word"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def keep(docs: DataFrame, benchmark: DataFrame, words_: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs without a contaminated window, all columns; texts are not moved."""
    spark = docs.sparkSession
    small_batches(spark)
    for part in passes(benchmark, ITEMS, ITEM_BYTES):
        shared = spark.sparkContext.broadcast(Index(part, words_, similar))

        def run(batches, shared=shared):
            for part, raw, at in slices(batches, "text"):
                h, row = words(raw, at)
                good = np.ones(part.num_rows, bool)
                good[[r for r, *_ in shared.value.matches(h, row)]] = False
                yield part.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


