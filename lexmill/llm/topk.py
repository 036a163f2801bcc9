"""Exact top-k search by inner product, on vector-approximation files.

Vectors are packed into blocks. A block of candidates keeps, beside the exact integers, the approximation: the cell
of each component on a grid of 2**BITS cells, of which only the cells' bounds are scanned first. Two matrix products
give an upper and a lower bound of every score; the kth largest lower bound starts the search, and exact vectors are
read in order of upper bounds, until the kth exact score is above the next upper bound. Ties go to smaller ids.

Every query block meets every candidate block once: candidate blocks lie in groups and query blocks in tiles of at most
about TILE blocks; both are repeated, for each tile and for each group, and meet by an equi-join on group and tile. So
no task holds more than a tile of the queries, however many there are. A group's best k of each query are merged by a
ranking that keeps k rows before it shuffles.

Null or empty vectors, vectors that hold null or non-finite components, and null ids take no part. Repeated rows are
rows of their own: each is a query, and a candidate of all rows but itself (ties of score and id: the earlier row of the
table of vectors). Only vectors of one width meet. Other columns are not read. An empty table gives an empty result. A
component whose integer has more than 62 bits is an error, and so is a score that does not fit 64 bits; scores that
could pass 64 bits are worked out in integers of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

BITS = 4
QUERY_BLOCK, BLOCK, TILE = 256, 2048, 32
#: Exact vectors read at a time.
READ = 64
MOST = 2.0**62


def quantize(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of vectors that take part; row: a number of its own, once it is written."""
    v = F.col(vector)
    fine = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def whole(x):
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < MOST, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component has more than 62 bits")).cast("long"))

    return df.where(fine).where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"), F.monotonically_increasing_id().alias("row"))


def pack(vectors: DataFrame, rows: int, role: str) -> DataFrame:
    """Blocks of at most `rows` vectors of one width: width, rows and ids, data (little-endian 64-bit integers)."""

    def run(batches):
        held: dict[int, list] = {}

        def out(w):
            row, ids, data = zip(*held.pop(w), strict=True)
            packed = [np.array(x, "<i8").tobytes() for x in (row, ids, data)]
            return pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["width", f"{role}_rows", f"{role}_ids", f"{role}_data"])

        for b in batches:
            for r, i, v in zip(*(b.column(c).to_pylist() for c in ("row", "vec_id", "v")), strict=True):
                held.setdefault(len(v), []).append((r, i, v))
                if len(held[len(v)]) == rows:
                    yield out(len(v))
        for w in list(held):
            yield out(w)

    return vectors.mapInArrow(run, f"width int, {role}_rows binary, {role}_ids binary, {role}_data binary")


class Approximation:
    """Cells of a block's components and the bounds of cells."""

    def __init__(self, exact: np.ndarray, bits: int = BITS):
        low, high = exact.min(0), exact.max(0)
        step = np.maximum((high - low + (1 << bits)) // (1 << bits), 1)
        self.cells = ((exact - low) // step).astype(np.uint8)
        self.low = (low + self.cells * step).astype(np.float64)
        self.high = self.low + (step - 1)


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, names: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(query, candidate's name, score, candidate) of the k best candidates of each query in a block; ties go to smaller
    names (the candidates themselves without `names`), then to smaller candidates."""
    names = cid if names is None else names
    va = Approximation(c)
    plus, minus = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    upper = plus @ va.high.T + minus @ va.low.T
    lower = plus @ va.low.T + minus @ va.high.T
    own = qid[:, None] == cid[None, :]
    upper[own] = lower[own] = -np.inf
    # beyond 2**53 sums of doubles are rounded; the bounds then give way
    slack = 0.0 if np.abs(upper[np.isfinite(upper)]).max(initial=0) < 2.0**52 else np.inf
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] >= 2.0**63
    out = []
    for i in range(len(q)):
        n = int((~own[i]).sum())
        if not n:
            continue
        m = min(k, n)
        certain = -np.partition(-lower[i], m - 1)[m - 1] - slack
        near = np.flatnonzero((upper[i] >= certain) & ~own[i])
        near = near[np.argsort(-upper[i][near], kind="stable")]
        best: list[tuple[int, int, int]] = []
        for a in range(0, len(near), READ):
            if len(best) == m and -best[-1][0] > upper[i][near[a]] + slack:
                break
            part = near[a : a + READ]
            scores = c[part].astype(object) @ q[i].astype(object) if wide else c[part] @ q[i]
            best = sorted([*best, *zip((-scores).tolist(), names[part].tolist(), cid[part].tolist(), strict=True)])[:m]
        if any(abs(s) >= 1 << 63 for s, *_ in best):
            raise OverflowError("a score does not fit 64 bits")
        out += [(int(qid[i]), x, -s, r) for s, x, r in best]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of `vectors` (of quantize()) for each of its rows with `is_query`."""
    spark = vectors.sparkSession
    small_batches(spark, BLOCK)
    groups = groups or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    stored = materialize(vectors)  # the numbers of rows must not change
    queries = stored.where(is_query)
    tiles = 1 + queries.count() // (QUERY_BLOCK * TILE)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = pack(stored.repartition(groups, "row"), BLOCK, "c").withColumn("part", F.spark_partition_id()).withColumn("tile", every(tiles))
    asked = pack(queries.repartition(max(1, min(groups, tiles)), "row"), QUERY_BLOCK, "q").withColumn("tile", F.spark_partition_id() % tiles).withColumn("part", every(groups))
    met = asked.hint("shuffle_hash").join(cand, ["part", "tile", "width"])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                w, n = row["width"], lambda name, row=row: np.frombuffer(row[name], "<i8")
                found = search(n("q_rows"), n("q_data").reshape(-1, w), n("c_rows"), n("c_data").reshape(-1, w), k, n("c_ids"))
                own = dict(zip(n("q_rows").tolist(), n("q_ids").tolist(), strict=True))
                cols = zip(*((own[q], q, x, s, r) for q, x, s, r in found), strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], ["query_id", "query_row", "vec_id", "score", "row"])

    best = met.select("width", *(f"{r}_{c}" for r in "qc" for c in ("rows", "ids", "data"))).mapInArrow(run, "query_id long, query_row long, vec_id long, score long, row long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, is_query: Column | None = None) -> DataFrame:
    """The rows of query op2_topk: queries are the rows whose vec_id is divisible by 50."""
    return top_k(quantize(embeddings), F.col("vec_id") % 50 == 0 if is_query is None else is_query)
