"""Suffix-array dedup of long repeated strings, by blocks of suffixes.

A repeated string of LENGTH bytes starts at i if the LENGTH bytes at i also start anywhere else. Suffixes are dealt to
buckets by content: a suffix's bucket is the least k-gram (by hash, leftmost) within its first LENGTH bytes and the
distance to it, so equal prefixes share a bucket. Neighbouring suffixes with one such k-gram travel together as a
stretch of text. Stretches with the same bytes are counted by a plain aggregation; only one of each, and only where
another stretch has the same k-gram, goes on to be sorted.

A k-gram that more than HOT different stretches have is lengthened until its buckets fit: stretches are cut where the
distance to the k-gram passes a multiple of WIDTHS[0], and the key of a piece is all the text that the prefixes of its
suffixes have in common, which is WIDTHS[0] - 1 bytes less than LENGTH. Equal pieces are counted as stretches are;
keys that are still hot go on with the next width. At width 1 a key is a whole prefix, so the last step leaves nothing.
Every group ends in the same sort, none is larger than HOT stretches.

One block of buckets is sorted at a time. Ranks of the suffixes at positions of a difference cover are computed first,
by doubling; a suffix is then placed by the few bytes before its next cover position and that position's rank, so ties
of any length take no longer. Stretches are laid out so that suffixes of one bucket have the same residue, and hence
the same next cover position. Equal prefixes are neighbours in suffix order; neighbours are compared byte by byte.
Whole stretches count as equal if two 64-bit hashes agree (that of the k-gram and that of all bytes).

passages() adds what repeats in shorter strings: it runs the above with PASSAGE bytes over all texts, and with LENGTH
bytes over the regions that this leaves, where all longer repeats lie.

Null texts count as empty. Texts under LENGTH bytes lose nothing. Repeated rows are texts that repeat each other. A
doc_id may be null or repeated; each row is judged by its own text. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, _powers, forget, materialize, mix, prefix_hash, slices, small_batches, span_hash

LENGTH, GRAM = 400, 64
#: Length of the shorter strings that passages() counts as well: about 40 words.
PASSAGE = 240
#: Bytes of one text that are looked at together; bytes of stretches sorted together; stretches of a k-gram in a group.
#: A Python worker needs about 100 bytes for each byte looked at and 75 for each byte sorted.
CHUNK, BLOCK_BYTES, HOT = 1 << 20, 1 << 20, 256
#: Distances to the k-gram that a piece of a hot stretch spans, step by step.
WIDTHS = (64, 16, 4, 1)
#: A difference cover: any two residues modulo PERIOD reach COVER by one common shift.
PERIOD, COVER = 7, (0, 1, 3)
SHIFT = np.array([next(s for s in range(PERIOD) if (r + s) % PERIOD in COVER) for r in range(PERIOD)])
MASKS = np.array([(1 << 64) - (1 << (64 - 8 * s)) if s else 0 for s in range(8)], np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    tiles = padded.reshape(-1, width)
    left = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    right = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def stretches(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, start in row, suffixes, place of the least k-gram behind start, its hash, hash of the bytes)."""
    n, gram = len(raw), min(gram, max(1, length // 2))
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    prefix = prefix_hash(raw)
    # the order of k-grams at all places, by whole arrays; only chosen ones get their mixed hash
    order = prefix[gram:] - prefix[: n - gram + 1]
    with np.errstate(over="ignore"):
        order *= _powers(n + 1)[1][: n - gram + 1]
        order *= MULT
    order &= ~np.uint64((1 << 24) - 1)
    order |= np.arange(n - gram + 1, dtype=np.uint64)
    least = sliding_min(order, length - gram + 1)
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(place))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    ok = start + length <= at[row + 1]
    start, row, place = start[ok], row[ok], place[ok]
    if not len(start):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s = start[first]
    p = place[first]
    return row[first], s - at[row[first]], count, p - s, span_hash(prefix, p, p + gram), span_hash(prefix, s, s + count - 1 + length)


def cover_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions of `text` by their first `depth` bytes or more; 0 elsewhere."""
    n = len(text)
    pos = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    words = leading(text)[pos] & MASKS[PERIOD]
    rank = np.zeros(n + 2 * depth + PERIOD, np.int64)

    def place(key):
        rank[pos] = r = ranked(key)
        return r.max(initial=0) == len(key)

    done, have = place(words), PERIOD
    while not done and have < depth:
        done = place(rank[pos] * (len(pos) + 2) + rank[pos + have])
        have *= 2
    return rank


def ranked(key: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal keys have equal ranks."""
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))[: len(key)]
    return out


def leading(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as big-endian integers (zeros behind the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(text)]
    return out


def repeated_in_block(block: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For stretches (k-gram, its place, suffixes, bytes): flags of suffixes whose first `length` bytes others have too."""
    parts, at, n = [], [], 0
    for _, place, _, data in block:
        pad = (-(n + place)) % PERIOD
        parts += [b"\0" * pad, data]
        at.append(n + pad)
        n += pad + len(data)
    text = np.frombuffer(b"".join(parts), np.uint8)
    rank, lead = cover_ranks(text, length), leading(text)
    count = np.array([c for _, _, c, _ in block])
    base = np.repeat(np.cumsum(count) - count, count)
    inner = np.arange(int(count.sum())) - base
    pos = np.repeat(np.array(at), count) + inner
    away = np.repeat(np.array([p for _, p, _, _ in block]), count) - inner
    names = {g: i for i, g in enumerate(dict.fromkeys(g for g, *_ in block))}
    bucket = np.repeat(np.array([names[g] for g, *_ in block]), count) * (1 << 12) + away
    shift = SHIFT[pos % PERIOD]
    # the bucket, then the bytes before the cover position, then its rank
    near = ranked(lead[pos] & MASKS[shift])
    order = np.argsort(ranked(bucket * (len(pos) + 1) + near) * (len(text) + 1) + rank[pos + shift])
    prefix = prefix_hash(text)
    h = span_hash(prefix, pos, pos + length)
    h, b = h[order], bucket[order]
    same = (h[1:] == h[:-1]) & (b[1:] == b[:-1])
    near = np.flatnonzero(same)
    same[near] = equal_bytes(lead, pos[order[near]], pos[order[near + 1]], length)
    flags = np.zeros(len(pos), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return np.split(flags, np.cumsum(count)[:-1])


def equal_bytes(lead: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes from places a and from places b are the same, by leading()."""
    out = np.ones(len(a), bool)
    for k in [*range(0, length - 8, 8), max(length - 8, 0)]:
        out &= lead[a + k] == lead[b + k]
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, size) of maximal runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


WHERE = "did long, tkey long, start int, n int"
STRETCH = WHERE + ", place int, gram long, body long"
PIECE = WHERE + ", place int, gram long, body long, c long, g long, bytes binary"


def find_stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batches):
        for part, raw, at in slices(batches, "text"):
            for c in range(0, max(1, len(raw) - length + 1), CHUNK):
                if len(at) == 2:
                    sub, cut = raw[c : c + CHUNK + length - 1], None
                    row, start, n, place, gram, body = stretches(sub, np.array([0, len(sub)]), length)
                else:
                    row, start, n, place, gram, body = stretches(raw, at, length)
                    cut = True
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("did").take(take), part.column("tkey").take(take), pa.array((start + (0 if cut else c)).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(body.view(np.int64))],
                    ["did", "tkey", "start", "n", "place", "gram", "body"],
                )
                if cut:
                    break

    return docs.mapInArrow(run, STRETCH)


def _rows(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) for n, t in fields], [n for n, _ in fields])


def with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """PIECE rows of the stretches `wanted` (did, tkey, start, n, place, gram, body, c, g: stretches of the k-gram), with their bytes."""
    lists = wanted.groupBy("did", "tkey").agg(F.collect_list(F.struct("start", "n", "place", "gram", "body", "c", "g")).alias("parts"))
    joined = lists.join(docs.dropDuplicates(["did", "tkey"]), ["did", "tkey"])

    def run(batches):
        for b in batches:
            for did, tkey, parts, text in zip(*(b.column(x) for x in ("did", "tkey", "parts", "text")), strict=True):
                did, tkey, parts, data = did.as_py(), tkey.as_py(), parts.as_py(), memoryview(text.as_buffer())
                columns = {k: [p[k] for p in parts] for k in ("start", "n", "place", "gram", "body", "c", "g")}
                columns |= {"did": [did] * len(parts), "tkey": [tkey] * len(parts)}
                columns["bytes"] = [data[p["start"] : p["start"] + p["n"] - 1 + length].tobytes() for p in parts]
                yield _rows(columns, PIECE)

    return joined.select("did", "tkey", "parts", F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECE)


def finer(hot: DataFrame, width: int, length: int) -> DataFrame:
    """PIECE rows: stretches cut at multiples of `width` of the distance to their k-gram; gram is the hash of that
    k-gram, the multiple and all the text that the pieces of this multiple must share."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("did", "tkey", "start", "n", "place", "gram", "body", "c", "g", "bytes")}
            for r in b.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                far = r["place"]  # the distance of the first suffix; each next one is nearer by 1
                j = np.arange((far - r["n"] + 1) // width, far // width + 1)
                first = np.maximum(far - ((j + 1) * width - 1), 0)
                last = np.minimum(far - j * width, r["n"] - 1)
                prefix = prefix_hash(data)
                common = span_hash(prefix, far - j * width, far - (j + 1) * width + 1 + length)
                with np.errstate(over="ignore"):
                    key = mix(common + np.uint64(r["gram"] & (2**64 - 1)) * np.uint64(31) + j.astype(np.uint64))
                    body = mix(span_hash(prefix, first, last + length) * np.uint64(31) + (far - first).astype(np.uint64))
                for k, s, e, g, h in zip(j.tolist(), first.tolist(), last.tolist(), key.view(np.int64).tolist(), body.view(np.int64).tolist(), strict=True):
                    for name, v in (("did", r["did"]), ("tkey", r["tkey"]), ("start", r["start"] + s), ("n", e - s + 1), ("place", far - s), ("gram", g), ("body", h), ("c", r["c"]), ("g", 0), ("bytes", r["bytes"][s : e + length])):
                        out[name].append(v)
            yield _rows(out, PIECE)

    return hot.mapInArrow(run, PIECE)


def sort_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """did, tkey, start, n of repeated prefixes in groups of PIECE rows by gram, of rows that stand for one place (c = 1)."""

    def run(batches):
        held, size, last = [], 0, None

        def judged():
            flags = repeated_in_block([(r["gram"], r["place"], r["n"], r["bytes"]) for r in held], length)
            found = [(r["did"], r["tkey"], r["start"] + a, n) for r, f in zip(held, flags, strict=True) if r["c"] == 1 for a, n in runs(f)]
            cols = zip(*found, strict=True) if found else ((), (), (), ())
            return _rows(dict(zip(("did", "tkey", "start", "n"), map(list, cols), strict=True)), WHERE)

        for b in batches:
            for r in b.to_pylist():
                if size > BLOCK_BYTES and r["gram"] != last:
                    yield judged()
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
                last = r["gram"]
        if held:
            yield judged()

    dealt = pieces.select("did", "tkey", "start", "n", "place", "gram", "c", "bytes").repartition(F.col("gram"))
    return dealt.sortWithinPartitions("gram").mapInArrow(run, WHERE)


def repeats(docs: DataFrame, length: int = LENGTH, hot: int | None = None) -> DataFrame:
    """did, tkey, start, n: runs of byte positions where a repeated string of `length` bytes starts (runs may touch)."""
    hot = HOT if hot is None else hot
    table = materialize(find_stretches(docs, length))
    # any row stands for its kind; first() of plain columns, all of one row, is added up by hash, a least struct only by sorting
    some = [F.first(c).alias(c) for c in ("did", "tkey", "start", "n", "place")]
    kinds = materialize(table.groupBy("gram", "body").agg(F.count("*").alias("c"), *some))
    many = kinds.where("c > 1").select("gram", "body")
    found = [materialize(table.join(many, ["gram", "body"]).select("did", "tkey", "start", "n"))]
    groups = kinds.groupBy("gram").agg(F.count("*").alias("g")).where("g > 1")
    wanted = kinds.join(groups, "gram").select("did", "tkey", "start", "n", "place", "gram", "body", "c", "g")
    pieces = materialize(with_bytes(docs, wanted, length))
    found.append(materialize(sort_blocks(pieces.where(F.col("g") <= hot), length)))
    rest = pieces.where(F.col("g") > hot)
    forget(table, kinds)
    for width in WIDTHS:
        if rest.isEmpty():
            break
        halved = materialize(finer(rest, width, length))
        forget(pieces)
        pieces = halved
        # a piece that several stretches have, or that stands for one with copies, is repeated as a whole
        kinds = materialize(pieces.groupBy("gram", "body").agg(F.count("*").alias("k"), F.sum("c").alias("copies"), *(F.first(c).alias(c) for c in ("did", "tkey", "start"))))
        several = kinds.join(kinds.groupBy("gram").agg(F.count("*").alias("g")).where("g > 1"), "gram")
        met = pieces.join(kinds.where("k > 1").select("gram", "body"), ["gram", "body"])
        found.append(materialize(met.where("c = 1").select("did", "tkey", "start", "n")))
        ones = several.select("gram", "body", "did", "tkey", "start", F.col("copies").alias("all"), "g")
        reps = materialize(pieces.drop("g").join(ones, ["gram", "body", "did", "tkey", "start"]).select("did", "tkey", "start", "n", "place", "gram", "body", F.col("all").alias("c"), "g", "bytes"))
        found.append(materialize(sort_blocks(reps.where(F.col("g") <= hot), length)))
        rest = reps.where(F.col("g") > hot)
        forget(pieces, kinds)
        pieces = reps
    forget(pieces)
    return reduce(DataFrame.unionByName, found)


def keyed(docs: DataFrame) -> DataFrame:
    """did, tkey (what a row's text is found by), text and the original doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(2**63))).alias("did"), F.xxhash64(doc_id, text).alias("tkey"), text.alias("text"), doc_id.alias("doc_id"))


def covered(size: int, starts: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Flags of the bytes that strings of `length` bytes starting in the runs (starts, n) cover."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _by_row(found: DataFrame, names: tuple[str, str]) -> DataFrame:
    return found.distinct().groupBy("did", "tkey").agg(F.collect_list("start").alias(names[0]), F.collect_list("n").alias(names[1]))


def regions(rows: DataFrame, length: int) -> DataFrame:
    """did, tkey, start, text (bytes) of runs of at least `length` covered bytes; rows: did, tkey, text, starts, sizes of PASSAGE strings."""

    def run(batches):
        for b in batches:
            out = {"did": [], "tkey": [], "start": [], "text": []}
            for did, tkey, text, starts, sizes in zip(b.column("did").to_pylist(), b.column("tkey").to_pylist(), b.column("text"), b.column("starts"), b.column("sizes"), strict=True):
                data = memoryview(text.as_buffer())
                for s, n in runs(covered(len(data), starts.values.to_numpy(), sizes.values.to_numpy(), PASSAGE)):
                    if n >= length:
                        for k, v in (("did", did), ("tkey", tkey), ("start", s), ("text", data[s : s + n].tobytes())):
                            out[k].append(v)
            yield _rows(out, "did long, tkey long, start int, text binary")

    return rows.select("did", "tkey", F.col("text").cast("binary").alias("text"), "starts", "sizes").mapInArrow(run, "did long, tkey long, start int, text binary")


def passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """repeats() of PASSAGE and of LENGTH bytes of docs (did, tkey, text)."""
    short = materialize(repeats(docs, PASSAGE))
    met = docs.join(_by_row(short, ("starts", "sizes")), ["did", "tkey"])  # repeated rows stay: they repeat each other
    parts = materialize(regions(met, LENGTH).select("did", "start", "text", F.col("tkey").alias("row")).withColumn("tkey", F.xxhash64("row", "start")))
    long = repeats(parts.select("did", "tkey", "text"))
    at = parts.select("did", "tkey", "row", F.col("start").alias("from")).distinct()
    moved = long.join(at, ["did", "tkey"]).select("did", F.col("row").alias("tkey"), (F.col("start") + F.col("from")).cast("int").alias("start"), "n")
    return short, moved


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), n_passage (bytes in repeated strings of PASSAGE) of
    each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    short, long = passages(rows.select("did", "tkey", "text"))
    lists = _by_row(short, ("short", "short_n")).join(_by_row(long, ("starts", "sizes")), ["did", "tkey"], "left")
    met = rows.join(lists, ["did", "tkey"], "left").select("doc_id", "text", "starts", "sizes", "short", "short_n")

    def run(batches):
        for b in batches:
            raw = b.column("text").cast(pa.binary())
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "n_passage")}
            for text, starts, sizes, short, short_n in zip(raw, *(b.column(c) for c in ("starts", "sizes", "short", "short_n")), strict=True):
                data = text.as_py()
                removed, spans, kept, passage = 0, 0, data, 0
                if short.is_valid:
                    passage = int(covered(len(data), short.values.to_numpy(), short_n.values.to_numpy(), PASSAGE).sum())
                if starts.is_valid:
                    gone = covered(len(data), starts.values.to_numpy(), sizes.values.to_numpy(), LENGTH)
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for k, v in zip(out, (len(data), removed, spans, kept, passage), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items())], ["doc_id", *out])

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage long")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op1_suffix."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """What remove_repeats() must give, by counting all substrings: for tests."""
    data = {k: (t or "").encode() for k, t in texts.items()}
    count: dict[bytes, int] = {}
    for d in data.values():
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = {}
    for k, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out[k] = len(d), int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).hexdigest()
    return out


