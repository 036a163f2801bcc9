"""Quality rules: counts of each text, and lines that too many documents of a host share.

A line is normalised (A-Z in lower case, each run of digits as 0, each run of white space as one space, none at the ends)
and hashed together with its host, 64 bits. Distinct documents are counted for each host and line; texts that are equal
byte for byte are one document. A line is over the limit if more than MOST of its host's documents hold it, and more than
LEAST. Over-limit lines are removed, and a document is depleted if less than LEFT of its words remain.

One pass reads the texts and writes counts and line hashes, a row a document, without texts. Counting lines adds up in
the tasks before anything is shuffled, so a common line or a large host is no hot key; copies of a text are merged by a
128-bit digest in the same way. Over-limit lines are broadcast up to BROADCAST of them, else joined by sorting.

Null and empty texts have no words and no lines (all counts 0, base_failed). A null host is one host of its own. Repeated
rows give repeated rows, and count once as documents. doc_ids may be null or repeated; nothing is joined by them. Columns
not named here are not read by `digest`, and are passed on by `clean`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, forget, materialize, slices, small_batches, word_spans

#: Words that a document has at least, and the share (percent) of its words that repeated windows cover at most.
WORDS, REPEATED, WINDOW = 50, 50, 3
#: A line is over the limit in more documents than this, and in more than this share (percent) of its host's documents.
LEAST, MOST = 10, 1
#: Percent of a document's words that must remain.
LEFT = 50
#: Over-limit lines (16 bytes each) that are broadcast at most.
BROADCAST = 500_000
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ", ".join(f"{c} long" for c in COUNTS) + ", host long, copy binary, lines array<struct<line:long,words:int>>"
SPACES, DIGITS = re.compile(rb"[\x20\x09-\x0D]+"), re.compile(rb"[0-9]+")


def normalised(line: bytes) -> bytes:
    return SPACES.sub(b" ", DIGITS.sub(b"0", line.lower())).strip(b" ")


def line_hash(host: int, line: bytes) -> int:
    """64 bits, signed, of a normalised line on its host."""
    return xxhash.xxh3_64_intdigest(line, seed=host & (2**64 - 1)) - (1 << 63)


def host_hash(host: str | None) -> int:
    return -1 if host is None else xxhash.xxh3_64_intdigest(host.encode()) >> 1


def _names(kept: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Equal numbers for equal strings: the strings stand one after the other in `kept`. Compares whole strings."""
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    found = pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.bincount(found)[found] > 1 if len(found) else np.zeros(0, bool)


def repeat_words(names: np.ndarray, rows: np.ndarray, n_rows: int, width: int = WINDOW) -> np.ndarray:
    """Words of each row in windows of `width` words that occur twice or more in it. Names of windows are exact."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    inside = rows[:n] == rows[width - 1 :]
    key = rows[:n].astype(np.int64)
    for k in range(width):
        key = pa.array(key * (int(names.max()) + 1) + names[k : n + k]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    twice = np.zeros(n, bool)
    twice[inside] = _again(key[inside])
    covered = np.zeros(len(names), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return np.bincount(rows[covered], minlength=n_rows)


def measure(raw: np.ndarray, at: np.ndarray, hosts: list) -> list[tuple]:
    """A tuple of MEASURES for each text; at: the offsets of the texts in raw."""
    n = len(at) - 1
    space = IS_SPACE[raw]
    s, e, rows = word_spans(space, at)
    sizes = e - s
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(~space & ((raw & 0xC0) != 0x80))])
    symbols = np.concatenate([np.zeros(1, np.int64), np.cumsum(IS_SYMBOL[raw])])
    n_words = np.bincount(rows, minlength=n)
    repeats = repeat_words(_names(raw[~space], sizes), rows, n)
    # Lines: cut at every newline and at the ends of texts.
    ends = np.union1d(np.flatnonzero(raw == 10), at[1:])
    cuts = np.concatenate([np.zeros(1, np.int64), ends])
    first_word = np.searchsorted(s, cuts)  # words that begin before each cut
    words = np.diff(first_word)
    some = np.flatnonzero(words)
    left, right = cuts[:-1][some], cuts[1:][some]
    if len(left):
        left = left + (raw[left] == 10)  # the newline that ends the line before
    line_row = rows[first_word[:-1][some]]
    text, copies = raw.tobytes(), np.zeros(n, np.int64)
    out = []
    per_row = np.searchsorted(line_row, np.arange(n + 1))
    for i in range(n):
        host, seen, lines = host_hash(hosts[i]), set(), {}
        for k in range(per_row[i], per_row[i + 1]):
            line = text[left[k] : right[k]]
            copies[i] += line in seen
            seen.add(line)
            h = line_hash(host, normalised(line))
            lines[h] = lines.get(h, 0) + int(words[some[k]])
        own = text[at[i] : at[i + 1]]
        out.append((int(n_words[i]), int(points[at[i + 1]] - points[at[i]]), int(symbols[at[i + 1]] - symbols[at[i]]), int(copies[i]), int(repeats[i]), host, hashlib.blake2b(own, digest_size=16).digest(), [{"line": h, "words": w} for h, w in lines.items()]))
    return out


def measured(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A written table: struct `doc` of the columns in `keep`, `row` (a number of this table's own), MEASURES."""
    small_batches(docs.sparkSession)
    inner = docs.select(F.struct(*(F.col(c) for c in keep)).alias("doc"), F.col(text).cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    kind = inner.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch, raw, at in slices(batches, "text"):
            rows = measure(raw, at, batch.column(2).to_pylist())
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
            columns.append(pa.array([r[6] for r in rows], pa.binary()))
            columns.append(pa.array([r[7] for r in rows], pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", *COUNTS, "host", "copy", "lines"])

    return materialize(inner.mapInArrow(run, f"doc {kind}, {MEASURES}").withColumn("row", F.monotonically_increasing_id()))


def over_limit(rows: DataFrame, least: int = LEAST, most: float = MOST) -> DataFrame:
    """host, line, n_docs, host_docs of the lines over the limit, from rows of `measured`."""
    texts = rows.groupBy("host", "copy").agg(F.first(F.col("lines.line")).alias("line"))
    texts = materialize(texts.select("host", "line"))
    sizes = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    often = texts.select("host", F.explode("line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least)
    out = materialize(often.join(sizes, "host").where(F.col("n_docs") * 100 > F.col("host_docs") * most))
    forget(texts)
    return out


def removed(rows: DataFrame, over: DataFrame) -> DataFrame:
    """row, n_removed_words, gone (line hashes) of the documents that hold lines over the limit."""
    few = over.limit(BROADCAST + 1).count() <= BROADCAST
    lines = rows.select("row", F.inline("lines"))
    over = over.select("line")
    hit = lines.join(F.broadcast(over) if few else over, "line")
    return hit.groupBy("row").agg(F.sum("words").cast("long").alias("n_removed_words"), F.collect_list("line").alias("gone"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc, COUNTS, n_removed_words, base_failed, kept, gone (hashes of the lines removed) of every row."""
    rows = measured(docs, host, text, keep)
    over = over_limit(rows)
    out = rows.drop("lines", "host", "copy").join(removed(rows, over), "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < LEFT * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def clean(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, in the columns of docs, without their lines over the limit."""
    kept = judged(docs, host, text, tuple(docs.columns)).where("kept").select("doc", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            rows = []
            for doc, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if gone:
                    out, key = set(gone), host_hash(doc[host])
                    doc[text] = "\n".join(x for x in doc[text].split("\n") if line_hash(key, normalised(x.encode())) not in out)
                rows.append(doc)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], pa.schema([batch.schema.field(0).type.field(c) for c in names]))

    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op11_rules."""
    return judged(docs).select(F.col("doc.doc_id").cast("long").alias("doc_id"), *COUNTS, "base_failed", "kept", "n_removed_words")
