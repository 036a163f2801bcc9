"""Work on globally ordered rows without a task that sees all of them: numbering, folds with a carry, prefix ranges.

Rows are dealt out by ranges of the order and sorted inside a range; each range is looked at on its own, and what one needs of the ranges
before it is a small report of each range (a count, the outcome of a fold for each state it may start in). Reports are
as many as there are partitions; they are put in order by one task. The ranges are a written table, so that a lost
executor can't deal the rows out otherwise a second time.

Rows that are equal in all columns of the order stay together and are numbered in any order; an empty table gives an
empty one; columns of the caller may have any name but those that begin with `_range`.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored

#: monotonically_increasing_id() holds the partition above this bit, the row within it below.
PART = 33


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """rows as a written table with `_range` (its partition, in order) and `_at` (from 0, in order within it)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range_id", F.monotonically_increasing_id())
    place = F.col("_range_id")
    return stored(dealt.withColumn("_range", F.shiftright(place, PART)).withColumn("_at", place.bitwiseAND((1 << PART) - 1)).drop("_range_id"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their number from 1 in a total order: the count of the ranges before, plus the place within the range."""
    r = ranged(rows, *order)
    sizes = r.groupBy("_range").agg(F.count("*").alias("_range_n"))
    before = F.coalesce(F.sum("_range_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("_range", before.alias("_range_before"))  # a row a partition
    return r.join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_range_before") + F.col("_at") + 1).cast("long")).select(*rows.columns, name)


# --- a fold that cuts rows into pieces of bounded size


class Cut:
    """Cuts records into pieces: before a record that would take the piece beyond `hard`, or, from `target` on, before one whose
    prefix is another than that of the record before. A piece starts with `base`; each record adds its size and `comma`.
    """

    def __init__(self, target: int | None, hard: int, base: int = 2, comma: int = 1):
        self.target, self.hard, self.base, self.comma = target, hard, base, comma

    def full(self, size: int, own: int, changed: bool) -> bool:
        return size + own > self.hard or (self.target is not None and size >= self.target and changed)

    def report(self, sizes: np.ndarray, changed: np.ndarray, bare: int) -> dict:
        """What a range does to any piece that is open when it begins.

        steps: (least open size, place of the first cut, open size at the end, pieces begun), the largest sizes last to
        apply: the first step whose least size is reached holds. changed[0] is not known yet: `first` is the step of a
        cut before record 0. `alone` is the outcome if nothing is before the range (its first record has no comma: bare
        = 1, or 0). `total`: what all records add where nothing is cut.
        """
        own = sizes + self.comma
        ahead = np.concatenate([[0], np.cumsum(own)])
        n, places = len(own), np.flatnonzero(changed)
        places = places[places > 0]

        def run(i: int, less: int, seen: dict) -> tuple[int, int]:
            """Open size at the end and pieces begun, from a piece that begins with record i."""
            path = []
            while i not in seen:
                path.append((i, less))
                grown = self.base - less - ahead[i]
                j = int(np.searchsorted(ahead, self.hard - grown, "right")) - 1  # the first record that passes `hard`
                j = max(j, i + 1)
                if self.target is not None:
                    k = np.searchsorted(places, np.searchsorted(ahead, self.target - grown, "left"), "left")
                    k = max(k, np.searchsorted(places, i + 1, "left"))
                    j = min(j, int(places[k])) if k < len(places) else j
                if j >= n:
                    end = (int(grown + ahead[n]), 1)
                    break
                i, less = j, 0
            else:
                end = seen[i]
                end = (end[0], end[1] + 1) if path else end
            for back in reversed(path):
                if not back[1]:
                    seen[back[0]] = end
                last = end
                end = (end[0], end[1] + 1)
            return last if path else end

        seen: dict = {}
        # The least open size that makes a cut before record i: only new minima can be the first cut of some size.
        need = self.hard - ahead[1:] + 1
        if self.target is not None:
            need = np.where(changed, np.minimum(need, self.target - ahead[:-1]), need)
        need = need[1:]
        low = np.minimum.accumulate(need) if n > 1 else need
        fresh = np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]])) if n > 1 else np.zeros(0, int)
        steps = []
        for i in fresh:
            steps.append((int(low[i]), int(i) + 1, *run(int(i) + 1, 0, seen)))
            if low[i] <= self.base:
                break
        return {"own": int(own[0]), "first": run(0, 0, seen), "alone": run(0, bare, dict(seen) if not bare else {}), "steps": steps, "total": int(ahead[n])}

    def enter(self, report: dict, size: int, changed: bool) -> tuple[int | None, int, int]:
        """Place of the first cut in a range (None: none), the open size at its end and the pieces begun, from an open size."""
        if self.full(size, report["own"], changed):
            return (0, *report["first"])
        for least, place, left, begun in report["steps"]:
            if size >= least:
                return place, left, begun
        return None, size + report["total"], 0


ENTRY = "_range long, _owner long, _cut long, _piece long"


def cut_pieces(rows: DataFrame, cut: Cut, size: Column, prefix: Column | None, *order: Column, bare: int = 1) -> DataFrame:
    """rows with `piece` (from 0, in order) and `_owner`, `_range`, `_at`: cut as one sequential fold over all rows would cut them.

    size: what a record adds (without the comma). bare: what the very first record of all adds less. Two passes: each
    range reports what it does to an open piece of any size; one task carries the open size through the reports; then
    each range, together with the records at the heads of the next ranges that still belong to its last piece, is folded
    over from its first cut, where a piece begins.
    """
    r = ranged(rows.withColumn("_range_size", size.cast("long")).withColumn("_range_prefix", F.lit("") if prefix is None else prefix), *order)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for p in np.unique(b.column(0).to_numpy()):
                keep = b.filter(pc.equal(b.column(0), int(p)))
                held.setdefault(int(p), []).append(keep)
        for p, parts in held.items():
            t = pa.Table.from_batches(parts).sort_by("_at")
            text = t.column("_range_prefix").to_pylist()
            changed = np.array([False] + [a != b for a, b in zip(text, text[1:], strict=False)])
            out = cut.report(t.column("_range_size").to_numpy(), changed, bare)
            yield pa.RecordBatch.from_pylist([{"_range": p, "_first": text[0], "_last": text[-1], "_report": repr(out)}], pa.schema([("_range", pa.int64()), ("_first", pa.string()), ("_last", pa.string()), ("_report", pa.string())]))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        size, last, owner, pieces = None, None, -1, 0
        for b in batches:
            out = []
            for x in b.to_pylist():
                report = ast.literal_eval(x["_report"])
                if size is None:
                    place, (size, begun) = 0, report["alone"]
                else:
                    place, size, begun = cut.enter(report, size, x["_first"] != last)
                last = x["_last"]
                out.append({"_range": x["_range"], "_owner": owner, "_cut": place, "_piece": pieces})
                if place is not None:
                    owner, pieces = x["_range"], pieces + begun
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_range", pa.int64()), ("_owner", pa.int64()), ("_cut", pa.int64()), ("_piece", pa.int64())]))

    narrow = r.select("_range", "_at", "_range_size", "_range_prefix").repartition("_range")
    told = stored(narrow.mapInArrow(reports, "_range long, _first string, _last string, _report string"))
    entries = stored(told.repartition(1).sortWithinPartitions("_range").mapInArrow(carry, ENTRY))  # a row a partition
    met = r.join(F.broadcast(entries.withColumnRenamed("_owner", "_before")), "_range")
    mine = F.coalesce(F.col("_at") >= F.col("_cut"), F.lit(False))
    owned = met.withColumn("_owner", F.when(mine, F.col("_range")).otherwise(F.col("_before"))).drop("_before", "_cut", "_piece")
    starts = entries.where("_cut is not null").select(F.col("_range").alias("_owner"), F.col("_piece").alias("_start"))
    dealt = owned.join(F.broadcast(starts), "_owner").repartition("_owner").sortWithinPartitions("_owner", "_range", "_at")
    names = [*rows.columns, "_owner", "_range", "_at"]
    columns = [*names, "_range_size", "_range_prefix", "_start"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = last = None
        piece = open_ = 0
        for b in batches:
            out = np.empty(len(b), np.int64)
            facts = zip(b.column("_owner").to_pylist(), b.column("_range_size").to_pylist(), b.column("_range_prefix").to_pylist(), b.column("_start").to_pylist(), strict=True)
            for i, (o, n, text, start) in enumerate(facts):
                own = n + cut.comma
                if o != owner:
                    owner, piece, open_ = o, start, cut.base + own - (bare if start == 0 else 0)
                elif cut.full(open_, own, text != last):
                    piece, open_ = piece + 1, cut.base + own
                else:
                    open_ += own
                last, out[i] = text, piece
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out)], [*names, "piece"])

    schema = dealt.select(*names).schema.add("piece", "long")
    return dealt.select(*columns).mapInArrow(pieces, schema)


# --- the best k rows of many prefixes


def prefix_top(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """q, pos, place: of each query (q, key) the k rows (key, place) with the least places whose key begins with the query's.

    Keys and queries are dealt out together by ranges of the key; a query sorts just before the keys that begin with
    it. A pass over a range holds the prefixes that are open, which are prefixes of the key at hand and so nest, with
    the best k of each. A range can't know which prefixes were open where it begins, but all of them are prefixes of its
    first key: it keeps the best k of each of these as well, and the queries pick theirs up. No key and no first
    letter gathers in one task; what is shuffled a second time is at most k rows a query and range.
    """
    marks = queries.select("key").distinct().select("key", F.lit(-1).cast("long").alias("place"))
    both = rows.select("key", F.col("place").cast("long").alias("place")).where("key is not null and place is not null").unionByName(marks.where("key is not null"))
    dealt = both.repartitionByRange("key", "place").sortWithinPartitions("key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[str, list[int]]] = []
        keys, places, begun = [], [], False

        def close(until: int) -> None:
            while len(open_) > until:
                p, best = open_.pop()
                keys.extend([p] * len(best))
                places.extend(best)

        for b in batches:
            for key, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun:
                    begun = True
                    open_.extend((key[:n], []) for n in range(len(key) + 1))
                n = len(open_)
                while n and not key.startswith(open_[n - 1][0]):
                    n -= 1
                close(n)
                if place < 0:
                    if not open_ or open_[-1][0] != key:
                        open_.append((key, []))
                    continue
                for _, best in open_:
                    if len(best) < k:
                        bisect.insort(best, place)
                    elif place < best[-1]:
                        best.pop()
                        bisect.insort(best, place)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int64())], ["key", "place"])
            keys, places = [], []
        close(0)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int64())], ["key", "place"])

    best = dealt.mapInArrow(run, "key string, place long").distinct()
    pos = F.row_number().over(Window.partitionBy("q").orderBy("place"))
    return queries.select("q", "key").join(best, "key").withColumn("pos", pos).where(F.col("pos") <= k).select("q", "pos", "place")


