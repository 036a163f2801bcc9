"""Helpers shared by the training-data operators: shared storage, Arrow text buffers, vectorized hashing."""

from __future__ import annotations

import gc
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch: bounds what a Python worker holds at once.
ARROW_ROWS = 512
#: Bytes of text that one vectorized step looks at, but for a single longer text.
SLICE_BYTES = 1 << 20

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
#: An odd base of the polynomial prefix hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Arrow batches of few rows, unless the session already has still smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of this machine only in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file:///tmp/checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_mod(key: str, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its rows."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, text: str, most: int = SLICE_BYTES):
    """Row ranges of the batches whose text is at most `most` bytes, or one row: (batch slice, bytes, offsets)."""
    for batch in batches:
        raw, at = utf8(batch.column(batch.schema.names.index(text)))
        n, i = len(at) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", BASE_INV)):
                p = np.full(size, U64(base & (2**64 - 1)))
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all bits (in a new array)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h *= U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of values[i:j], still to be shifted by span_hash()."""
    up, _ = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, U64), np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], dtype=U64)])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of values[start:end]; equal for equal contents wherever they stand."""
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * down[start]
        return mix(h + (end - start).astype(U64) * MULT)


#: A prime and a base of a second hash. Modulo 2**64 alone some long words of two letters (Thue-Morse words) have one hash for any base.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_664_525_013
_PRIME_POWERS: dict[str, np.ndarray] = {}


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_PRIME_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", PRIME_BASE), ("down", pow(PRIME_BASE, -1, PRIME))):
            p = np.ones(size, U64)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * U64(pow(base, have, PRIME)) % U64(PRIME)
                have *= 2
            _PRIME_POWERS[name] = p
    return _PRIME_POWERS["up"][:n], _PRIME_POWERS["down"][:n]


def word_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] by two polynomials, modulo 2**64 and modulo PRIME: what proves words equal."""
    n = len(values)
    up, down = _prime_powers(n + 1)
    terms = (values.astype(U64) + U64(1)) * up[:n]
    if n > 1 << 24:  # else sums stay below 2**63
        terms %= U64(PRIME)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
    second = (prefix[end] - prefix[start]) % U64(PRIME) * down[start] % U64(PRIME)
    with np.errstate(over="ignore"):
        return mix(span_hash(prefix_hash(values), start, end) ^ mix(second * MULT + U64(1)))


def word_spans(space: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs where `space` is false, cut at the offsets of rows."""
    n = len(space)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~space
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cuts = at[(at > 0) & (at < n)]
    start[cuts] = word[cuts]
    end[cuts - 1] = word[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(at, s, "right") - 1


#: The white space that separates words.
SPACE_BYTES = (0x20, *range(0x09, 0x0E))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
