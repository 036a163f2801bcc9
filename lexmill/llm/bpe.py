"""Byte-level BPE: encode and decode whole texts by a file of ranks.

A word (one match of the split pattern) is merged on a segment tree over its byte positions. A leaf
holds the rank of the pair that starts at its position, with the position, so the root is the
leftmost pair of least rank. A merge updates at most three leaves (the merged position, the one that
vanishes, the live neighbour before) and their ancestors: a logarithmic number of steps. Short words
go through the trees in lockstep, many words at a time; long ones one by one.

Null and empty texts have no tokens. Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Words kept with their ids by a Python worker; beyond that the memory is emptied.
CACHE_WORDS = 400_000
#: Longest word in bytes that goes through the lockstep trees.
LOCKSTEP_BYTES = 64
POS_BITS = 20
#: The split pattern that a text without unusual characters may be split by with the faster engine: there its
#: classes hold the same characters. UNUSUAL: numerals that aren't digits, separators, and all from U+0250.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u024f]")
NONE = np.int64(1) << 60
#: Fixed value: the only pattern that PLAIN stands in for.
PLAIN_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Ranks of one file. Immutable but for the memory of words."""

    def __init__(self, raw: bytes, pattern: str):
        lines = [line.split() for line in raw.splitlines() if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in lines}
        self.plain = pattern == PLAIN_FOR
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        pairs = {}
        for token, c in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = c
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        top = max(self.ids.values()) + 1
        self.sizes, parts = np.zeros(top + 1, np.int64), [b""] * top
        for token, c in self.ids.items():
            self.sizes[c + 1], parts[c] = len(token), token
        self.starts, self.flat = np.cumsum(self.sizes), np.frombuffer(b"".join(parts), np.uint8)
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids that pairs merge to, NONE where they don't."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """Ids of a word of any length, by a single tree."""
        n = len(word)
        if n < 2:
            return [int(self.byte[b]) for b in word]
        size = 1 << (n - 1).bit_length()
        none, pairs = int(NONE), self.pairs
        ids = [int(self.byte[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(p: int) -> int:
            q = after[p]
            c = pairs.get(ids[p] << 32 | ids[q]) if q < n else None
            return none if c is None else c << POS_BITS | p if n < 1 << POS_BITS else c * n + p

        base = (1 << POS_BITS) if n < 1 << POS_BITS else n
        for p in range(n - 1):
            tree[size + p] = leaf(p)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (top := tree[1]) < none:
            c, p = divmod(top, base)
            q = after[p]
            r = after[q]
            ids[p], after[p] = c, r
            if r < n:
                before[r] = p
            todo = [(q, none), (p, leaf(p))]
            if before[p] >= 0:
                todo.append((before[p], leaf(before[p])))
            for at, value in todo:
                i = size + at
                tree[i] = value
                while i > 1:
                    i >>= 1
                    low = min(tree[2 * i], tree[2 * i + 1])
                    if tree[i] == low:
                        break
                    tree[i] = low
        out, p = [], 0
        while p < n:
            out.append(ids[p])
            p = after[p]
        return out

    def many(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids, as bytes, of words of 2 to `size` bytes, on trees of `size` leaves in lockstep."""
        w = len(words)
        length = np.fromiter(map(len, words), np.int64, w)
        col = np.arange(size)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = col < length[:, None]
        ids = np.zeros((w, size + 1), np.int64)
        ids[:, :size][inside] = self.byte[flat]
        after = np.broadcast_to(np.arange(1, size + 2), (w, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (w, size + 1)).copy()
        alive = inside.copy()
        tree = np.full((w, 2 * size), NONE)
        has = col[:-1] < (length - 1)[:, None]
        rows, cols = np.nonzero(has)
        got = self.rank(ids[rows, cols], ids[rows, cols + 1])
        tree[rows, size + cols] = np.where(got < NONE, got << POS_BITS | cols, NONE)
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        tree_, ids_, after_, before_, alive_ = (x.reshape(-1) for x in (tree, ids, after, before, alive))
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            top = tree_[live * (2 * size) + 1]
            p, c = top & ((1 << POS_BITS) - 1), top >> POS_BITS
            row, end = live * (size + 1), length[live]
            q = after_[row + p]
            r = after_[row + q]
            ids_[row + p], after_[row + p] = c, r
            ok = r < end
            before_[(row + r)[ok]] = p[ok]
            alive_[live * size + q] = False
            right = np.where(ok, self.rank(c, ids_[row + np.minimum(r, size)]), NONE)
            b = before_[row + p]
            has = b >= 0
            left = np.where(has, self.rank(ids_[row + np.maximum(b, 0)], c), NONE)
            base = live * (2 * size)
            leaf = base + size
            tree_[leaf + q] = NONE
            tree_[leaf + p] = np.where(right < NONE, right << POS_BITS | p, NONE)
            tree_[(leaf + b)[has]] = np.where(left < NONE, left << POS_BITS | b, NONE)[has]
            for pos in (q, p, np.where(has, b, p)):
                i = (size + pos) >> 1
                while i[0]:
                    at = base + 2 * i
                    tree_[base + i] = np.minimum(tree_[at], tree_[at + 1])
                    i >>= 1
            live = live[tree_[base + 1] < NONE]
        packed = ids[:, :size][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the memory."""
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            raw = word.encode()
            whole = self.ids.get(raw)
            if whole is not None:
                self.cache[word] = whole.to_bytes(4, "little")
            elif len(raw) > LOCKSTEP_BYTES:
                self.cache[word] = np.array(self.one(raw), "<u4").tobytes()
            else:
                size = 1 << (len(raw) - 1).bit_length()
                if size not in groups:
                    groups[size] = [], []
                groups[size][0].append(word)
                groups[size][1].append(raw)
        for size, (texts, raws) in groups.items():
            for i in range(0, len(texts), 8192):
                self.cache.update(zip(texts[i : i + 8192], self.many(raws[i : i + 8192], size), strict=True))

    def words(self, text: str) -> list[str]:
        """The matches of the split pattern."""
        return (self.split if not self.plain or UNUSUAL.search(text) else PLAIN).findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.words(x) for x in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = set().union(*found) - self.cache.keys() if found else set()
        gc.disable()  # the memory holds no cycles; scanning it again and again costs more than the merges
        self.learn(new)
        gc.enable()
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in found]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        size = self.sizes[ids + 1]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.starts[ids] - first, size) + np.arange(int(size.sum()))].tobytes()


_CODECS: dict[int, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of a rank file, built once in each process."""
    key = hash((raw, pattern))
    if key not in _CODECS:
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def tokenize(docs: DataFrame, path: str | None = None, pattern: str | None = None, decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_le (ids as little-endian unsigned 32-bit integers) and decoded (bytes, if asked) of each row.

    path: the rank file, read on the driver and broadcast (it is a vocabulary: its size does not grow with the data).
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        c = codec(shared.value, pattern)
        for part, _, _ in slices(batches, "text"):
            ids = c.encode_all([x or "" for x in part.column("text").to_pylist()])
            cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                cols.append(pa.array([c.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_le", "decoded"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_le binary" + ", decoded binary" * decode)


def detokenize(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows that tokenize() made."""
    import public_tokenizers

    spark = tokens.sparkSession
    small_batches(spark)
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(shared.value, "")
        for part in batches:
            out = [c.decode(x or b"").decode("utf-8", "replace") for x in part.column("ids_le").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids_le").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op3_bpe."""
    t = tokenize(docs)
    return t.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
