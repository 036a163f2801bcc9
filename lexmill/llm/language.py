"""Language ID: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams for n = 1, 2, 3 (ASCII letters in lower case; n = 2, 3 hashed to buckets, apart
for each n). The kernel of two texts is the number of n-grams both have, normalised by the texts' own kernels. Kernel
values with the landmarks, mapped by the inverse square root of the landmarks' kernel matrix, feed one ridge
regression for each language; a batch of texts is scored by matrix products.

Null texts, and texts without a letter, are `und` with score 0. Texts whose lang is null don't teach. Without any
teaching row all are `und`. Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, fold_mod, mix, slices, small_batches

TWO, THREE = 2048, 4096
WIDTH = 256 + TWO + THREE
#: Bounds of the teaching sample: rows a language, and of these landmarks a language. All rows are scored.
TEACH_ROWS, LANDMARKS, RIDGE, SHARP = 300, 32, 1e-2, 4.0
#: A language's rows are thinned by a hash to about SHARE times the sample before they are ranked.
SHARE = 4
#: Up to so many languages (they are counted) the table of their sizes is broadcast, so that rows are thinned where they are read.
FEW_LANGS = 10_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 0/1 row of n-gram presence for each text."""
    n = len(at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    flat = out.reshape(-1)
    low = LOWER[raw].astype(np.int64)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    flat[row * WIDTH + low] = 1
    base = row * WIDTH
    if len(low) > 1:
        two = low[:-1] << 8 | low[1:]
        ok = row[:-1] == row[1:]
        flat[(base[:-1] + 256 + ((two * 0x9E3779B1 >> 13) % TWO))[ok]] = 1
    if len(low) > 2:
        three = two[:-1] << 8 | low[2:]
        ok = row[:-2] == row[2:]
        flat[(base[:-2] + 256 + TWO + ((three * 0x9E3779B1 >> 15) % THREE))[ok]] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    landmarks: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share, of rows of presence()."""
        f = (_unit(x) @ self.landmarks.T) @ self.weights
        p = np.exp(SHARP * (f - f.max(1, keepdims=True)))
        best = f.argmax(1)
        return best, (p / p.sum(1, keepdims=True))[np.arange(len(f)), best].astype(float)


def fit(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    names = tuple(sorted(set(langs)))
    if not names:
        return Model(names)
    which = np.array([names.index(v) for v in langs])
    unit = _unit(x).astype(np.float64)
    chosen = np.concatenate([np.flatnonzero(which == k)[:landmarks] for k in range(len(names))])
    z = unit[chosen]
    values, vectors = np.linalg.eigh(z @ z.T)
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
    phi = (unit @ z.T) @ root
    y = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    rows = 1 / np.bincount(which, minlength=len(names))[which][:, None]  # each language weighs the same
    w = np.linalg.solve(phi.T @ (phi * rows) + ridge * np.eye(phi.shape[1]), phi.T @ (y * rows))
    return Model(names, z.astype(np.float32), (root @ w).astype(np.float32))


def learn(docs: DataFrame, rows: int = TEACH_ROWS) -> Model:
    """A model by at most `rows` rows of each non-null lang, the first by a hash of doc_id among those that a hash lets in."""
    small_batches(docs.sparkSession)
    some = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), (F.xxhash64("doc_id", "text").bitwiseAND((1 << 53) - 1) / 2.0**53).alias("u"))
    # of a language with many rows only a share is ranked, some times as large as needed: a task never ranks more than that
    often = some.groupBy("lang").agg(F.count("*").alias("n"))
    few = often.limit(FEW_LANGS + 1).count() <= FEW_LANGS
    some = some.join(F.broadcast(often) if few else often, "lang").where(F.col("u") * F.col("n") <= SHARE * rows)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))
    picked = docs.join(F.broadcast(some), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l"))).select("doc_id", "lang", "text")

    def run(batches):
        for part, raw, at in slices(batches, "text"):
            bits = np.packbits(presence(raw, at) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], ["doc_id", "lang", "bits"])

    got = sorted(picked.mapInArrow(run, "doc_id long, lang string, bits binary").collect(), key=lambda r: (r.lang, r.doc_id is not None, r.doc_id or 0, bytes(r.bits)))
    count: dict[str, int] = {}
    kept = []
    for r in got:  # repeated rows could pass the bound
        count[r.lang] = count.get(r.lang, 0) + 1
        if count[r.lang] <= rows:
            kept.append(r)
    x = np.array([np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8))[:WIDTH] for r in kept], np.float32).reshape(len(kept), WIDTH)
    return fit(x, [r.lang for r in kept])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row, by its text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.names, "und"], dtype=object)
        for part, raw, at in slices(batches, "text"):
            n = len(at) - 1
            letters = np.diff(np.concatenate([[0], np.cumsum(LETTER[raw])])[at])
            none = letters == 0
            for i in np.flatnonzero(none & (np.diff(at) > 0)):
                none[i] = not any(c.isalpha() for c in part.column("text")[int(i)].as_py())
            best, share = np.full(n, len(m.names)), np.zeros(n)
            if m.names:
                for i in range(0, n, 256):
                    j = min(n, i + 256)
                    best[i:j], share[i:j] = m.score(presence(raw[at[i] : at[j]], at[i : j + 1] - at[i]))
            best[none], share[none] = len(m.names), 0.0
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    return fold_mod("doc_id", 3) == 1


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op5_language."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
