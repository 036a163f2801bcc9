"""Longest matches of a table's keys in all texts of a batch at once: a double-array trie walked from every place in step.

The trie is two arrays of numbers: from state s a character with code c leads to base[s] + c if check there is s. A step
moves every place whose walk is still on by one character, so a batch takes as many steps as the longest key has characters, whatever
the number of texts. Which matches stand (from left to right, each from where the last one ended) follows by jumps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Texts from which on the jumps of all texts are made together.
MANY = 64


class Longest:
    """Keys of a table, numbered in their order; empty keys never match."""

    def __init__(self, keys: Sequence[str]):
        letters = sorted({ord(c) for k in keys for c in k})
        self.letters = np.array(letters, np.int64)
        code = {c: i + 1 for i, c in enumerate(letters)}
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            at = 0
            for c in key:
                at = nodes[at].setdefault(code[ord(c)], len(nodes))
                if at == len(nodes):
                    nodes.append({})
            if key:
                ends[at] = number
        self._place(nodes, ends)

    def _place(self, nodes: list[dict[int, int]], ends: dict[int, int]) -> None:
        """Each node's children where their codes, moved by its base, hit free places only."""
        base, check, final = [0], [-1], [-1]
        after = [1]  # a free place at or behind each place, found by following it

        def free(i: int) -> int:
            while len(after) <= i:
                after.append(len(after))
            at = i
            while after[at] != at:
                at = after[at]
                while len(after) <= at:
                    after.append(len(after))
            while after[i] != at:
                after[i], i = at, after[i]
            return at

        todo = [(0, 0)]
        for node, state in todo:
            final[state] = ends.get(node, -1)
            codes = sorted(nodes[node])
            if not codes:
                continue
            at = free(codes[0] + 1) - codes[0]
            while any(free(at + c) != at + c for c in codes[1:]):
                at = free(at + codes[0] + 1) - codes[0]
            base[state] = at
            grow = at + codes[-1] + 1 - len(check)
            if grow > 0:
                base += [0] * grow
                check += [-1] * grow
                final += [-1] * grow
            for c in codes:
                after[at + c], check[at + c] = at + c + 1, state
                todo.append((nodes[node][c], at + c))
        room = [0] * (len(self.letters) + 1)  # a step from any state stays inside
        self.base, self.check, self.final = np.array(base + room), np.array(check + [-1] * len(room)), np.array(final + [-1] * len(room))

    def longest(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length (0: none) and number of the longest key that begins at each place; ends: where the text of each place ends."""
        n = len(points)
        found, number = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if not len(self.letters):
            return found, number
        slot = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        code = np.where(self.letters[slot] == points, slot + 1, 0)
        live = np.flatnonzero(code)
        state, depth = np.zeros(len(live), np.int64), 0
        while len(live):
            to = self.base[state] + code[live + depth]
            ok = (self.check[to] == state) & (code[live + depth] > 0)
            live, state, depth = live[ok], to[ok], depth + 1
            hit = self.final[state] >= 0
            found[live[hit]], number[live[hit]] = depth, self.final[state[hit]]
            inside = live + depth < ends[live]
            live, state = live[inside], state[inside]
        return found, number

    def cut(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, where each text begins (and the last ends), and of each piece its place and key (-1: one character)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        found, number = self.longest(points, np.repeat(at[1:], sizes))
        step, head = np.maximum(found, 1), np.zeros(len(points), bool)
        live, stop = at[:-1][sizes > 0], at[1:][sizes > 0]
        while len(live) >= MANY:
            head[live] = True
            live = live + step[live]
            on = live < stop
            live, stop = live[on], stop[on]
        jumps = step.tolist() if len(live) else []
        for i, end in zip(live.tolist(), stop.tolist(), strict=True):
            while i < end:
                head[i] = True
                i += jumps[i]
        places = np.flatnonzero(head)
        return points, at, places, number[places]


def gathered(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[first[i] : first[i] + sizes[i]] one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return pool[np.arange(total) - np.repeat(before - first, sizes)]
