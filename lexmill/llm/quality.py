"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Class means and covariances come from sums of products over every labelled row (partial sums on the executors, two
rows to the driver). Each class covariance is shrunk to the pooled one and that to a multiple of the identity; a score
is the logistic of the difference of Mahalanobis log-densities and log-priors, by Cholesky factors kept in the model.

Null texts count as empty; an empty text has the statistics of no words and gets a score like any other. Labels other
than 0 and 1, null labels and null doc_ids in labels don't teach. If a class has no rows, all scores are the share of
label 1 (0.5 without labels). Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, fold_mod, materialize, mix, prefix_hash, slices, small_batches, span_hash, word_spans

NAMES = ("length", "upper", "digit", "marks", "punct", "space", "wide", "word_len", "echo", "variety", "line_echo", "long_word", "short_word", "entropy", "bars", "glued", "bigram_variety")
#: Shrinkage of class covariances to the pooled one, and of the result to the identity; the accepted score.
TO_POOLED, TO_IDENTITY, ACCEPT = 0.5, 0.01, 0.7

UPPER, DIGIT, MARK, PUNCT, BAR, HIGH = (np.zeros(256, bool) for _ in range(6))
UPPER[65:91] = True
DIGIT[48:58] = True
MARK[[ord(c) for c in "#$%&*@^~<>{}[]\\=_+!"]] = True
PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True
BAR[ord("|")] = True
HIGH[0xC0:] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(h):
        return np.zeros(n)
    salted = h ^ mix(rows.astype(np.uint64))
    order = np.argsort(salted)
    salted = salted[order]
    first = np.concatenate([[True], salted[1:] != salted[:-1]])
    return np.bincount(rows[order[first]], minlength=n)


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n = len(at) - 1
    size = np.diff(at)
    hist = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    per = lambda table: hist[:, table].sum(1)
    chars = np.maximum(size - hist[:, 0x80:0xC0].sum(1), 1)
    prefix = prefix_hash(LOWER[raw])
    s, e, row = word_spans(IS_SPACE[raw], at)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1)
    h = span_hash(prefix, s, e)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    two = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pair = mix(h[two] * np.uint64(3) + h[two + 1]) if len(two) else np.zeros(0, np.uint64)
    ls, le, lrow = word_spans(NEWLINE[raw], at)
    lines = np.bincount(lrow, minlength=n)
    length = e - s
    last = raw[e - 1] if len(e) else raw[:0]
    glued = MARK[last] | BAR[last]
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    out = np.empty((n, len(NAMES)))
    rate = lambda x, y: np.log((x + 0.5) / (y + 1.0))
    out[:, 0] = np.log1p(chars)
    for k, table in ((1, UPPER), (2, DIGIT), (3, MARK), (4, PUNCT), (5, IS_SPACE), (6, HIGH)):
        out[:, k] = rate(per(table), chars)
    out[:, 7] = np.log1p(np.bincount(row, length, n) / some)
    out[:, 8] = rate(np.bincount(row, same, n), some)
    out[:, 9] = _distinct(row, h, n) / some / np.maximum(1 - 0.07 * np.log(some), 0.2)
    out[:, 10] = 1 - _distinct(lrow, span_hash(prefix, ls, le), n) / np.maximum(lines, 1)
    out[:, 11] = rate(np.bincount(row, length > 18, n), some)
    out[:, 12] = rate(np.bincount(row, length < 4, n), some)
    out[:, 13] = entropy
    out[:, 14] = rate(per(BAR), chars)
    out[:, 15] = rate(np.bincount(row, glued, n), some)
    out[:, 16] = _distinct(row[two], pair, n) / np.maximum(np.bincount(row[two], minlength=n), 1)
    return out


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log-density constants of the two classes; prior: share of label 1."""

    prior: float
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    constant: np.ndarray | None = None
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        log = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) * self.scale, -500, 500)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """A model by (rows, sums, sums of products) of the classes."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    total = n[0] + n[1]
    if min(n.values()) < 2:
        return Model(n[1] / total if total else 0.5)
    mean = {k: sums[k][1] / n[k] for k in (0, 1)}
    own = {k: sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
    pooled = (n[0] * own[0] + n[1] * own[1]) / total
    d = len(pooled)
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * np.diag(spread**2) + 1e-6 * np.eye(d)
        chol = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(chol))
        constants.append(-np.log(np.diag(chol)).sum() + np.log(n[k] / total))
    return Model(n[1] / total, np.array([mean[0], mean[1]]), np.array(factors), np.array(constants))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and one double column f0, f1, ... for each of NAMES."""
    small_batches(docs.sparkSession)
    names = [f"f{i}" for i in range(len(NAMES))]

    def run(batches):
        for part, raw, at in slices(batches, "text"):
            x = statistics(raw, at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x[:, i]) for i in range(len(names)))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in names))


def learn(feats: DataFrame, labels: DataFrame) -> Model:
    """The model of all rows of feats whose doc_id has a label (doc_id, quality) 0 or 1."""
    d = len(NAMES)
    labels = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("label_id"), "quality").distinct()
    x = [F.col(f"f{i}") for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]
    rows = feats.join(labels, F.col("doc_id") == F.col("label_id")).groupBy("quality").agg(F.count("*"), *sums).collect()
    out = {}
    for r in rows:
        second, at = np.zeros((d, d)), 2 + d
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = r[at]
                at += 1
        out[int(r[0])] = float(r[1]), np.array(r[2 : 2 + d], float), second
    return fit(out)


def score(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of rows of features()."""
    shared = feats.sparkSession.sparkContext.broadcast(model)
    d = len(NAMES)

    def run(batches):
        for part in batches:
            x = np.column_stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs with a score of at least `accept`, all columns. The texts are read twice and not moved."""
    model = learn(features(docs), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, raw, at in slices(batches, "text"):
            yield part.filter(pa.array(shared.value.score(statistics(raw, at)) >= accept))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return fold_mod("doc_id", 4) == 2


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of query op6_quality: labels of rows that are not held out teach."""
    feats = materialize(features(docs))
    model = learn(feats.where(~held_out()), labels)
    out = score(feats, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
