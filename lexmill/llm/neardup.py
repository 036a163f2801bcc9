"""MinHash near-duplicates: a signature-coordinate inverted join, links confirmed on full shingle sets.

Texts with equal shingle sets become one node, whatever their doc_ids. A node's signature has COORDS coordinates; it is
posted under each coordinate-value pair. A pair of nodes with similarity 0.8 agrees in 51 of 64 coordinates on average;
pairs that agree in fewer than MATCHES are not looked at (at 0.8 that misses about four pairs in a million). So a node
needs MATCHES pairs that some other node has too, and two such nodes meet in the list of at least one of their size -
MATCHES + 1 rarest pairs: only that prefix is posted, and lists that everybody is in fall away. Collisions are counted
on the whole signatures where two nodes meet, inside the join; of pairs at or above the threshold, those whose sizes or
whose upper bits of all hashes show that they cannot be links are left out (exact bounds), and the rest are confirmed
on the full sets.

Large lists do not make all pairs. Each list has a leader, its most central node (the one whose pairs are the most
frequent: in a group of edited copies that is close to the original). A node's hub is the most central leader of its
lists that it agrees with in HUB_MATCHES coordinates, or that hub's own hub if it agrees with that as well. A node is
compared with its hub, and what it does not share with the hub (its difference) is kept. Two nodes of
one hub differ by exactly the symmetric difference of their differences. Either both are linked with the hub, and then
they are in one component, or a link between them needs common elements of the differences, at least the number that
_entries() derives from the sizes: so such pairs are found by a prefix join of the differences, rarest elements first,
which is exact. Nodes of different hubs meet in the lists of pairs.

In both kinds of lists components are contracted as links are found (linked()): LEADS times every entry meets its list's
leader only, then lists whose nodes all are in one component fall away; at last entries of different components meet.
So no link between components is lost, and links within a component are not listed.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. A null doc_id takes no
part: component_id is null and kept is false. Rows that repeat a doc_id with the same text give repeated rows. A doc_id
with several texts is in several groups; each row has the smallest doc_id of its own text's group. The table may be
empty. Other columns are not read. Texts of one doc_id are told apart by a 64-bit hash, sets by 128 bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, forget, materialize, mix, release, slices, small_batches, word_hash, word_spans
from .graph import components, merged

COORDS, MATCHES = 64, 36
#: A node keeps its hub if their sketches agree in so many places and their sets differ in at most FAR of both sizes; the
#: rest are their own hubs. Any choice gives the same links.
HUB_MATCHES, FAR = 24, 0.6
#: Rounds in which entries of a list meet its leader only, 2 at most. Any number gives the same components.
LEADS = 2
#: About so many pairs at most (16 bytes each; dealt evenly by hash) are broadcast to the sets. Steps are of so many pairs, or
#: of as many as there are sets: that bounds the disk of a step, and reading the sets once a step costs no more than its pairs.
STEP_PAIRS = 100_000
#: A token is a coordinate above 32 bits of a value. Above it, a post has the length of its list, up to MOST.
TOKEN_BITS, MOST = 38, (1 << 25) - 1
#: The brief form of a set has the upper 16 bits of each hash, or 32 from so many hashes on.
WIDE = 4096
#: The sketch of a signature: the low byte of each coordinate's value, eight coordinates to a column.
SKETCH = [f"s{k}" for k in range(COORDS // 8)]
ONES = 0x0101010101010101

_rng = np.random.default_rng(20240607)
#: Parameters of the coordinates' hash functions, from a fixed seed.
XORS = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
ODDS = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by row then hash: (rows, hashes)."""
    n = len(at) - 1
    s, e, row = word_spans(IS_SPACE[raw], at)
    h = word_hash(LOWER[raw], s, e)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    size = np.minimum(count, words)[row] if len(row) else row
    begin = np.flatnonzero((np.arange(len(h)) - first[row] + size) <= count[row]) if len(row) else row
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            take = j < size[begin]
            i = begin[take] + j
            out[take] = mix(out[take] * np.uint64(31) + h[i] + np.uint64(j))
    rows = row[begin]
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    if len(out):
        new = np.concatenate([[True], (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])])
        rows, out = rows[new], out[new]
    return rows, out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tkey (of the text), n_shingles, set_a, set_b (128 bits of the set), tokens array<long> (coordinate and value; null
    if the set is empty), the sketch."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part, raw, at in slices(batches, "text"):
            n = len(at) - 1
            rows, h = shingles(raw, at, words)
            count = np.bincount(rows, minlength=n)
            some = np.flatnonzero(count)
            starts = (np.cumsum(count) - count)[some]
            keys = np.zeros((2, n), np.int64)
            tokens = np.zeros((len(some), COORDS), np.int64)
            if len(some):
                with np.errstate(over="ignore"):
                    keys[0, some] = np.add.reduceat(mix(h), starts).view(np.int64)
                    keys[1, some] = np.add.reduceat(mix(h ^ XORS[0]), starts).view(np.int64)
                    for k in range(COORDS):
                        low = np.minimum.reduceat((h ^ XORS[k]) * ODDS[k] >> np.uint64(32), starts)
                        tokens[:, k] = (low | np.uint64(k << 32)).astype(np.int64)
            sketch = np.zeros((n, len(SKETCH)), np.int64)
            sketch[some] = np.ascontiguousarray((tokens & 255).astype(np.uint8)).view(np.int64)
            ends = np.zeros(n + 1, np.int32)
            ends[1:] = np.cumsum(count > 0) * COORDS
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.reshape(-1)), mask=pa.array(count == 0))
            columns = [part.column("doc_id"), part.column("tkey"), pa.array(count.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists, *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "n_shingles", "set_a", "set_b", "tokens", *SKETCH])

    schema = "doc_id long, tkey long, n_shingles long, set_a long, set_b long, tokens array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, schema)


def sets(docs: DataFrame, words: int) -> DataFrame:
    """node, hashes (sorted distinct shingle hashes, packed), brief (their number, then the distinct upper bits, packed)."""

    def run(batches):
        for part, raw, at in slices(batches, "text"):
            rows, h = shingles(raw, at, words)
            cut = np.searchsorted(rows, np.arange(len(at)))
            each = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in each], pa.binary()), pa.array([_brief(x) for x in each], pa.binary())], ["node", "hashes", "brief"])

    return docs.select("node", "text").mapInArrow(run, "node long, hashes binary, brief binary")


def _distinct(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _brief(hashes: np.ndarray) -> bytes:
    upper = (hashes >> np.uint64(48)).astype(np.uint16) if len(hashes) < WIDE else (hashes >> np.uint64(32)).astype(np.uint32)
    return len(hashes).to_bytes(8, "little") + _distinct(upper).tobytes()


def _unbrief(packed: memoryview) -> tuple[int, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    return n, np.frombuffer(packed[8:], np.uint16 if n < WIDE else np.uint32)


def _agreeing(left: str, right: str) -> Column:
    """The number of coordinates in which two sketches (columns with these prefixes) agree."""

    def unlike(c):
        x = F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))
        for k in (4, 2, 1):  # the lowest bit of each byte becomes the OR of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(ONES)))

    return F.lit(COORDS) - reduce(lambda x, y: x + y, map(unlike, SKETCH))


def _with_sets(pairs: DataFrame, full: DataFrame, few: bool, form: str) -> DataFrame:
    """a, b, ha, hb (column `form` of sets()) of distinct pairs (a, b). If they are few, the sets are not shuffled, only those of the pairs."""
    fa, fb = full.select(F.col("node").alias("a"), F.col(form).alias("ha")), full.select(F.col("node").alias("b"), F.col(form).alias("hb"))
    if few:
        return fa.join(F.broadcast(pairs), "a").join(fb.join(F.broadcast(pairs), "b"), ["a", "b"]).select("a", "b", "ha", "hb")
    return pairs.join(fb, "b").join(fa, "a").select("a", "b", "ha", "hb")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of _with_sets() in brief form that can be links; no link is lost.

    Common hashes have common upper bits, and a set of n hashes has n - d repeated ones, d distinct; so the intersection
    has at most as many elements as that of the upper bits and the fewer repeated ones of the two sets together.
    """

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha"), b.column("hb"), strict=True):
                (nx, x), (ny, y) = _unbrief(memoryview(x.as_buffer())), _unbrief(memoryview(y.as_buffer()))
                if x.dtype != y.dtype:
                    x, y = (_distinct((v >> 16).astype(np.uint16)) if v.dtype == np.uint32 else v for v in (x, y))
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum()) + min(nx - len(x), ny - len(y))
                keep.append(100 * both >= percent * (nx + ny - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of _with_sets() whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha"), b.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _differences(pairs: DataFrame, percent: int) -> DataFrame:
    """node, hub, size (of the node's set), linked (with the hub), diff array<long> of pairs of _with_sets() (a: node, b: hub)."""

    def run(batches):
        for batch in batches:
            keep, sizes, linked, ends, diffs = [], [], [], [0], [np.zeros(0, np.uint64)]
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                twice = z[1:] == z[:-1]
                one = np.ones(len(z), bool)
                one[1:] &= ~twice
                one[:-1] &= ~twice
                diff, total = z[one], len(z)
                keep.append(len(diff) <= FAR * total)
                if keep[-1]:
                    sizes.append(len(x))
                    linked.append((100 + percent) * len(diff) <= (100 - percent) * total)
                    ends.append(ends[-1] + len(diff))
                    diffs.append(diff)
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            flat = pa.array(np.concatenate(diffs).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), lists], ["node", "hub", "size", "linked", "diff"])

    return pairs.mapInArrow(run, "node long, hub long, size long, linked boolean, diff array<long>")


def linked(posts: DataFrame, keys: list[str], able: Column, rank: Column, confirm, comps: DataFrame, payload: DataFrame | None = None, alike: Column | None = None) -> DataFrame:
    """comps (node, comp) after all links between nodes that meet in a list (rows of posts with the same keys).

    Columns of the one row are those of posts, of the other `b_` and the column. `able` tells which rows of a list may be
    linked, `alike` by columns of `payload` (a row a node), which only rows of lists with several components get. The
    leader of a list has the least `rank` at first, then it is any; confirm() gives the links among pairs (a, b).
    """
    light = [c for c in posts.columns if c not in keys]
    split = F.col("comp") != F.col("b_comp")

    def other(d: DataFrame, kept: list[str]) -> DataFrame:
        return d.select(*(F.col(c).alias(c if c in kept else f"b_{c}") for c in d.columns))

    def lists(*more: Column) -> tuple[DataFrame, DataFrame]:
        p = posts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = [c for c in ("comp", "hub") if c not in keys]  # lists of one component, or of one hub, have nothing to link
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in several for f in (F.min, F.max)]
        many = p.groupBy(*keys).agg(*ends, *more).where(" and ".join(f"min_{c} <> max_{c}" for c in several))
        return p, many.drop(*(f"{f}_{c}" for c in several for f in ("min", "max")))

    def add(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b"))
        links = confirm(materialize(both.distinct()))
        out = merged(comps, links)
        discard(links)
        return out

    kept = list(posts.columns)
    own = None
    for order in (rank, F.xxhash64("node"))[:LEADS]:
        p, lead = lists(F.min_by(F.struct(*light, "comp"), F.struct(order, "node")).alias("lead"))
        # rows of the lists that are left, each with its list's leader: the next round looks at no others
        live = materialize(p.join(lead.select(*keys, *(F.col(f"lead.{c}").alias(f"b_{c}") for c in [*light, "comp"])), keys))
        met = live.where(split & able)
        if payload is not None:
            met = met.select("node", "b_node").distinct().join(payload, "node").join(other(payload, []), "b_node").where(alike)
        comps = add(met)
        if own is not None:
            forget(own)
        own, posts = live, live.select(kept)
    p, many = lists()
    p = p.join(many, keys)
    p = materialize(p if payload is None else p.join(payload, "node"))
    comps = add(p.join(other(p, keys), keys).where((F.col("node") < F.col("b_node")) & split & able & (F.lit(True) if alike is None else alike)))
    forget(p, own)
    return comps


def discard(df: DataFrame) -> None:
    """forget() of a table, or of all that a union of tables is made of."""
    forget(*getattr(df, "_tables", [df]))


def _entries(grouped: DataFrame, percent: int) -> DataFrame:
    """hub, e, node, linked, v, cap: the elements e of differences under which nodes of one hub that are not both linked
    with it must meet to be linked.

    With D the difference of a node and n its size, x and y are linked if |Dx ^ Dy| <= r (nx + ny), where r is (100 -
    percent) / (100 + percent). So they share at least (v(x) + v(y)) / 2 elements, v = |D| - r n; that is more than 0
    unless both are linked with the hub. Let e be the first element that both have in an order common to all nodes
    (rarest in the hub's differences first), and u the number of elements from e on that other nodes have as well: then
    v(x) + v(y) <= 2 u(x) and <= 2 u(y). Entries of e that no other entry of e can meet so are taken out first, from
    the least v and the largest cap = 2 u - v of each list. v and u are multiplied by 100 + percent here: whole numbers.
    """
    scale, rest = 100 + percent, 100 - percent
    needy = grouped.where(~F.col("linked")).select("hub").distinct()
    group = grouped.join(needy, "hub", "left_semi")
    v = F.size("diff") * scale - F.col("size") * rest
    rows = group.select("hub", "node", "linked", v.alias("v"), F.explode("diff").alias("e"))
    often = group.select("hub", F.explode("diff").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("n")).where("n > 1")
    ordered = rows.join(often, ["hub", "e"]).groupBy("hub", "node", "linked", "v").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("live"))
    spread = ordered.select("hub", "node", "linked", "v", F.size("live").alias("m"), F.posexplode("live").alias("at", "x"))
    entries = materialize(spread.select("hub", "node", "linked", "v", F.col("x.e").alias("e"), ((F.col("m") - F.col("at")) * (2 * scale) - F.col("v")).alias("cap")))
    for _ in range(2):
        free = ~F.col("linked")
        bounds = entries.groupBy("hub", "e").agg(F.min("v").alias("low"), F.max("cap").alias("high"), F.min(F.when(free, F.col("v"))).alias("low_free"), F.max(F.when(free, F.col("cap"))).alias("high_free"))
        low, high = F.when(free, F.col("low")).otherwise(F.col("low_free")), F.when(free, F.col("high")).otherwise(F.col("high_free"))
        fewer = materialize(entries.join(bounds, ["hub", "e"]).where((low <= F.col("cap")) & (F.col("v") <= high)).select(entries.columns))
        forget(entries)
        entries = fewer
    return entries


def _near_hub(pairs: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b) of nodes of one hub, by their differences from it."""
    scale, rest = 100 + percent, 100 - percent
    da = grouped.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("diff").alias("da"))
    db = grouped.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("diff").alias("db"))
    unlike = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    out = materialize(pairs.join(da, "a").join(db, "b").where(unlike * scale <= (F.col("na") + F.col("nb")) * rest).select("a", "b"))
    forget(pairs)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """doc_id, tkey (xxhash64 of the text), n_shingles, component_id, kept (doc_id is component_id), first (the row holds
    its group's first text, by doc_id and tkey) of each row of docs (doc_id, text)."""
    signed = materialize(signatures(docs, words))
    rows = materialize(signed.select("doc_id", "tkey", "n_shingles", "set_a", "set_b"))
    nodes = materialize(
        signed.where(F.col("tokens").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("tokens").alias("tokens"), *(F.first(c).alias(c) for c in SKETCH))
        .withColumn("node", F.monotonically_increasing_id())
    )
    posted = nodes.select("node", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.least(F.count("*"), F.lit(MOST)).alias("n")).where("n > 1")
    dealt = posted.join(shared, "token").select("node", F.shiftleft("n", TOKEN_BITS).bitwiseOR(F.col("token")).alias("post")).repartition("node")
    live = dealt.groupBy("node").agg(F.sort_array(F.collect_list("post")).alias("live"), F.sum(F.shiftright("post", TOKEN_BITS)).alias("weight")).where(F.size("live") >= matches)
    prefix = F.transform(F.slice("live", F.lit(1), F.size("live") - matches + 1), lambda x: x.bitwiseAND((1 << TOKEN_BITS) - 1))
    prefixes = materialize(live.select("node", "weight", prefix.alias("prefix")))
    posts = prefixes.select("node", "weight", F.explode("prefix").alias("token"))
    slim = materialize(nodes.drop("tokens"))
    forget(signed, nodes)
    nodes = slim
    active = nodes.join(prefixes.select("node"), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64("text").alias("rep_key"), "text")
    full = materialize(sets(texts.join(active, ["rep_id", "rep_key"]).select("node", "text").dropDuplicates(["node"]), words))
    sketches = materialize(nodes.join(prefixes.select("node"), "node", "left_semi").select("node", "n_shingles", *SKETCH))
    release(rows.sparkSession)
    first = posts.groupBy("token").agg(F.min(F.struct((-F.col("weight")).alias("o"), F.col("node").alias("leader"))).alias("lead"))
    sa, sb = (sketches.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in SKETCH)) for x in "ab")
    close = lambda pairs: pairs.join(sa, "a").join(sb, "b").where(_agreeing("a_", "b_") >= HUB_MATCHES)
    led = posts.join(first, "token").select(F.col("node").alias("a"), F.col("lead.leader").alias("b"), F.col("lead.o").alias("o")).where("a <> b").distinct()
    lead = materialize(close(led).groupBy("a").agg(F.min_by("b", F.struct("o", "b")).alias("b")))
    # on to the hub's own hub, where that is close to the node as well
    on = lead.select(F.col("a").alias("b"), F.col("b").alias("next"))
    further = close(lead.join(on, "b").where("a <> next").select("a", F.col("next").alias("b"))).select("a", F.col("b").alias("far"))
    near = materialize(lead.join(further, "a", "left").select("a", F.coalesce("far", "b").alias("b")))
    forget(lead)
    release(rows.sparkSession)
    n_sets = full.count()

    def in_steps(pairs: DataFrame, make, form: str = "hashes") -> DataFrame:
        """make() of distinct pairs with their sets, in steps."""
        n = pairs.count()
        steps, tables = 1 + n // max(STEP_PAIRS, n_sets), []
        for k in range(steps):
            part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(steps)) == k) if steps > 1 else pairs
            tables.append(materialize(make(_with_sets(part, full, n // steps <= STEP_PAIRS, form), percent)))
            release(rows.sparkSession)
        discard(pairs)
        out = reduce(DataFrame.unionByName, tables)
        out._tables = tables
        return out

    grouped = in_steps(near, _differences)
    comps = materialize(components(grouped.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))).where("node <> comp"))
    entries = _entries(grouped, percent)
    able = ~(F.col("linked") & F.col("b_linked")) & (F.col("b_v") <= F.col("cap")) & (F.col("v") <= F.col("b_cap"))
    comps = linked(entries, ["hub", "e"], able, F.struct(~F.col("linked"), -F.col("cap")), lambda pairs: _near_hub(pairs, grouped, percent), comps)
    forget(entries)
    release(rows.sparkSession)
    homes = prefixes.join(grouped.select("node", "hub"), "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    posts = materialize(homes.select("node", "hub", "weight", F.explode("prefix").alias("token")))
    forget(prefixes)
    alike = (F.least("n_shingles", "b_n_shingles") * 100 >= F.greatest("n_shingles", "b_n_shingles") * percent) & (_agreeing("", "b_") >= matches)
    apart = F.col("hub") != F.col("b_hub")
    comps = linked(posts, ["token"], apart, -F.col("weight"), lambda pairs: in_steps(in_steps(pairs, _possible, "brief"), _confirmed), comps, sketches, alike)
    # the least text of each group, for groups of several nodes
    members = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct()).join(nodes.select("node", "rep"), "node")
    least = members.groupBy("comp").agg(F.min("rep").alias("least"))
    named = nodes.select("node", "rep", "set_a", "set_b", "n_shingles").join(members.select("node", "comp").join(least, "comp").select("node", "least"), "node", "left")
    named = materialize(named.select("set_a", "set_b", "n_shingles", F.coalesce("least", "rep").alias("least")))
    own = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(named, ["set_a", "set_b", "n_shingles"], "left")
    head = ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("tkey") == F.col("least.tkey"))).alias("first")
    alone = rows.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "tkey", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    out = own.select("doc_id", "tkey", "n_shingles", F.col("least.doc_id").alias("component_id"), head).unionByName(alone)
    discard(grouped)
    forget(posts, full, sketches, comps, nodes)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op9_neardup: distinct 2-word shingles, at least 80 %."""
    return near_duplicates(docs, words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
