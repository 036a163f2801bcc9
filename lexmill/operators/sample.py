"""The seeded sample: the same rows that a shuffle of all rows by a seeded generator puts first, without shuffling them.

The generator counts, so its value at any step is known without the steps before; a row's place before the shuffle is traced back
through the few swaps that touch it. Swaps are drawn a million at a time; nothing but places is held. The rows are then
picked by their number in the order of the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered

#: Of the 32-bit FNV-1a hash, and the step of the generator.
OFFSET, PRIME, STEP = 2166136261, 16777619, 0x6D2B79F5
CHUNK = 1 << 20
MASK = 0xFFFFFFFF


def seed_hash(seed: str) -> int:
    """FNV-1a over code points, 32 bits."""
    h = OFFSET
    for c in seed:
        h = ((h ^ ord(c)) * PRIME) & MASK
    return h


def fractions(states: np.ndarray) -> np.ndarray:
    """Numbers from 0 up to 1 of generator states (doubles, of which the low 32 bits count)."""
    v = np.fmod(states, 2.0**32).astype(np.uint64)
    m = np.uint64(MASK)
    v = ((v ^ (v >> np.uint64(15))) * (v | np.uint64(1))) & m
    v = v ^ ((v + (((v ^ (v >> np.uint64(7))) * (v | np.uint64(61))) & m)) & m)
    return (v ^ (v >> np.uint64(14))).astype(np.float64) / 2.0**32


def swaps(n: int, seed: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, what each place from it on is swapped with) of a shuffle from the last place down, in chunks, the last swaps first."""
    steps = n - 1  # step t swaps place n - t
    starts, at = [], float(seed_hash(seed))
    for lo in range(0, steps, CHUNK):
        starts.append((lo, at))
        if lo + CHUNK < steps:
            at = float(np.add.accumulate(np.concatenate([[at], np.full(CHUNK, float(STEP))]))[-1])  # adds as doubles do, one by one
    for lo, at in reversed(starts):
        size = min(CHUNK, steps - lo)
        states = np.add.accumulate(np.concatenate([[at], np.full(size, float(STEP))]))[1:]
        places = n - 1 - np.arange(lo, lo + size)
        yield int(places[-1]), np.floor(fractions(states) * (places + 1)).astype(np.int64)[::-1]


def sampled_places(n: int, count: int, seed: str) -> list[int]:
    """Places (from 0) of the first `count` of n rows after the shuffle, in that order."""
    if count > n:
        raise ValueError(f"cannot sample {count} rows of {n}")
    slot = {p: p for p in range(count)}  # place: whose it will be
    for base, with_ in swaps(n, seed):
        order = np.argsort(with_, kind="stable")
        by = with_[order]

        def coming(place: int, after: int) -> int | None:
            """The next place after `after` whose swap touches `place`."""
            own = base + order[np.searchsorted(by, place) : np.searchsorted(by, place, "right")]  # noqa: B023
            later = own[np.searchsorted(own, after, "right") :]
            first = int(later[0]) if len(later) else None
            if after < place and base <= place < base + len(with_):  # noqa: B023
                first = place if first is None else min(first, place)
            return first

        heap = [(e, p) for p in slot if (e := coming(p, base - 1)) is not None]
        heapq.heapify(heap)
        last = -1
        while heap:
            at, place = heapq.heappop(heap)
            if place not in slot or at == last:  # moved since, or the same swap seen from its other place
                continue
            last = at
            other = int(with_[at - base])
            mine, his = slot.pop(at, None), slot.pop(other, None) if other != at else None
            for p, who in ((other, mine), (at, his)) if other != at else ((at, mine),):
                if who is not None:
                    slot[p] = who
                    if (e := coming(p, at)) is not None:
                        heapq.heappush(heap, (e, p))
    return [p for p, _ in sorted(slot.items(), key=lambda x: x[1])]


def sample(rows: DataFrame, count: int, seed: str, *order: Column) -> DataFrame:
    """`count` rows as the seeded shuffle of the rows in `order` puts them first, with `_pick`, their place in the sample (from 0).

    An error if there are fewer. The order has to be total; a sample is a bounded list.
    """
    placed = numbered(rows, "_place", *order)
    picked = sampled_places(placed.count(), count, seed)
    picks = rows.sparkSession.createDataFrame([(p + 1, i) for i, p in enumerate(picked)], "_at long, _pick int")
    return placed.join(F.broadcast(picks), F.col("_place") == F.col("_at")).drop("_place", "_at")
