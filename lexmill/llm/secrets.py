"""Secret scans: fixed base patterns, and format likelihoods under automata inferred from labelled credentials.

Grammar inference: the labelled credentials of a family make a prefix-tree acceptor with counts; states whose
futures are statistically compatible (Hoeffding bound, recursively) are merged, red-blue order, into a
probabilistic automaton. A candidate token's score is its log-likelihood under the best family less that under an
automaton inferred from ordinary tokens. A candidate may start wherever a family's mark stands in a run of credential
characters, and end before any character of the run that is no letter or digit. Base spans always stay, the automata
only add spans; but base spans are candidates too: each span has the family that its credential is likeliest of, and its
log-odds.

Null and empty texts have no spans. Repeated rows give repeated rows. Other columns are not read. Offsets are in
code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import deque
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: The base patterns and the lengths they need.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_32 = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "format")

#: Runs of credential characters whose parts are scored; a part is at least as long as the shortest run.
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{20,}")
#: Where a part may end, and where it may start if no mark is needed.
STOP, START = re.compile(r"[^A-Za-z0-9]"), re.compile(r"(?<=[=/])|^")
PREFIX = 4
#: Significance of the Hoeffding test; least log-odds against ordinary tokens; slack, in nats a symbol, under the
#: lowest score of a labelled credential.
ALPHA, LOG_ODDS, SLACK = 0.05, math.log(1e4), 0.15
END = "$"
#: Probability of a symbol that a state has never seen.
UNSEEN = 1e-4
LOST = math.log(UNSEEN)
CLASSES = str.maketrans({c: k for k, cs in {"a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "9": "0123456789"}.items() for c in cs})


def symbols(token: str) -> str:
    """The first characters as they are, then character classes: marks of a format tend to stand in front."""
    return token[:PREFIX] + token[PREFIX:].translate(CLASSES)


class Automaton:
    """A probabilistic deterministic automaton by state merging."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in samples:
            q = 0
            for c in symbols(s):
                self.count[q][c] = self.count[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                q = self.next[q][c]
            self.count[q][END] = self.count[q].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.total = [sum(c.values()) for c in self.count]

    def _differ(self, a: int, b: int) -> bool:
        """Whether some future of the two states has frequencies too far apart."""
        todo = deque([(a, b)])
        while todo:
            a, b = todo.popleft()
            ca, cb = self.count[a], self.count[b]
            na, nb = sum(ca.values()), sum(cb.values())
            if not na or not nb:
                continue
            most = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for c in ca.keys() | cb.keys():
                if abs(ca.get(c, 0) / na - cb.get(c, 0) / nb) > most:
                    return True
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return False

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, q in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], q))
                else:
                    self.next[a][c] = q

    def _merge(self) -> None:
        red, depth = [0], {0: 0}
        blue = deque(sorted((c, 0) for c in self.next[0]))
        while blue:
            c, parent = blue.popleft()
            q = self.next[parent].get(c)
            if q is None or q in depth:
                continue
            # the marks in front stay apart: only states behind them are merged
            d = depth[parent] + 1
            for r in red if d > PREFIX else ():
                if depth[r] > PREFIX and not self._differ(r, q):
                    self.next[parent][c] = r
                    self._fold(r, q)
                    blue.extend((k, r) for k in sorted(self.next[r]) if self.next[r][k] not in depth)
                    break
            else:
                depth[q] = d
                red.append(q)
                blue.extend((k, q) for k in sorted(self.next[q]))

    def walk(self, s: str, classes: str | None = None, start: int = 0) -> tuple[list[float], list[float]]:
        """log P of each prefix of the symbols from `start` on that is met in full, not ended and ended; behind it all symbols are
        unseen. s: symbols(), or a run as it is with its classes, from which nothing is copied."""
        q, at, ended, out = 0, 0.0, [], []
        for i in range(start, len(s)):
            c = s[i] if classes is None or i < start + PREFIX else classes[i]
            out.append(at)
            ended.append(at + self._log(q, END))
            if c not in self.next[q]:
                break
            at += self._log(q, c)
            q = self.next[q][c]
        else:
            out.append(at)
            ended.append(at + self._log(q, END))
        return out, ended

    def _log(self, q: int, c: str) -> float:
        n = self.count[q].get(c, 0)
        return math.log(n / self.total[q]) if n else LOST

    def score(self, s: str) -> float:
        """log P(s)."""
        return ended_at(self.walk(symbols(s)), len(s))

    def marks(self) -> set[str]:
        """What may stand in front."""
        at = {("", 0)}
        for _ in range(PREFIX):
            at = {(m + c, q) for m, p in at for c, q in self.next[p].items()}
        return {m for m, _ in at}


def ended_at(walked: tuple[list[float], list[float]], n: int) -> float:
    """log P of the first n symbols of a walk."""
    out, ended = walked
    return ended[n] if n < len(ended) else out[-1] + (n - len(out) + 2) * LOST


def labelled(per_family: int = 240, seed: int = 7) -> dict[str, list[str]]:
    """Synthetic labelled credentials, by the public shapes of their families, and ordinary long tokens."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: some(low, rng.randint(2, 9))
    make = {
        "forge": lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + some(low + up + dig, 36),
        "chat": lambda: rng.choice(["xoxb", "xoxp"]) + "-" + some(dig, 12) + "-" + some(dig, 12) + "-" + some(low + up + dig, 24),
        "maps": lambda: "AIza" + some(low + up + dig + "_-", 35),
        "pay": lambda: rng.choice(["sk_live_", "rk_live_"]) + some(low + up + dig, 24),
        "web": lambda: "eyJh" + some(low + up + dig, 32) + "." + "eyJ" + some(low + up + dig, 45) + "." + some(low + up + dig + "_-", 43),
        "cloud": lambda: "AKIA" + some(up + dig, 16),
        "ordinary": lambda: rng.choice(
            [
                lambda: "-".join(word() for _ in range(5)),
                lambda: "_".join(word() for _ in range(5)),
                lambda: "/".join(word() for _ in range(5)),
                lambda: ".".join(word() for _ in range(5)),
                lambda: some(low, rng.randint(20, 40)),
                lambda: some(low, 1).upper() + some(low, rng.randint(20, 30)),
                lambda: word() + "." + some(dig, 2) + "." + ".".join(word() for _ in range(4)),
                lambda: some(dig, 4) + "-" + some(dig, 2) + "-" + some(dig, 2) + "/" + "-".join(word() for _ in range(4)),
                lambda: some(dig, rng.randint(20, 30)),
                lambda: some("-=_.", 1) * rng.randint(20, 60),
            ]
        )(),
    }
    return {family: [f() for _ in range(per_family * (4 if family == "ordinary" else 1))] for family, f in make.items()}


class Grammar:
    """An automaton and a floor for each family, and one for ordinary tokens."""

    def __init__(self, samples: dict[str, list[str]]):
        self.ordinary = Automaton(samples["ordinary"])
        self.families = {}
        for family, tokens in samples.items():
            if family != "ordinary" and tokens:
                a = Automaton(tokens[::2])  # the other half sets the floor
                self.families[family] = a, min(a.score(x) / (len(x) + 1) for x in tokens[1::2] or tokens) - SLACK
        marks = sorted(set().union(*(a.marks() for a, _ in self.families.values())))
        self.mark = re.compile("(?=" + "|".join(map(re.escape, marks)) + ")") if marks else re.compile("(?!)")
        # a token without a mark has at most PREFIX - 1 seen symbols: no floor is as low as that, else other starts count too
        self.marked = all(floor > LOST * (LEAST + 2 - PREFIX) / (LEAST + 1) for _, floor in self.families.values())

    def score(self, token: str) -> tuple[str, float]:
        """The likeliest family and its log-odds against ordinary tokens; '' if no family's floor is reached."""
        best, at = "", -math.inf
        for family, (a, floor) in self.families.items():
            s = a.score(token)
            if s > at and s / (len(token) + 1) >= floor:
                best, at = family, s
        return best, (at - self.ordinary.score(token) if best else -math.inf)

    def starts(self, run: str) -> list[int]:
        found = {m.start() for m in self.mark.finditer(run)}
        return sorted(found if self.marked else found | {m.start() for m in START.finditer(run)})

    def end(self, run: str, classes: str, s: int, stops: list[int]) -> int | None:
        """The end of the likeliest credential at s, by log-odds, the longest of equals; stops are the ends to try."""
        ordinary, best = None, (LOG_ODDS, -1)
        for a, floor in self.families.values():
            walked = a.walk(run, classes, s)
            out = walked[0]
            for k in range(bisect_left(stops, s + LEAST), len(stops)):
                e = stops[k]
                n = e - s
                at = ended_at(walked, n)
                if at / (n + 1) >= floor:
                    ordinary = ordinary or self.ordinary.walk(run, classes, s)
                    best = max(best, (round(at - ended_at(ordinary, n), 6), e))
                elif n >= len(out) and floor > LOST:
                    break  # behind the last symbol met, the mean only falls
        return best[1] if best[1] >= 0 else None


@lru_cache(maxsize=2)
def default_grammar() -> Grammar:
    return Grammar(labelled())


def rated(text: str, spans: list[tuple[int, int, int]], grammar: Grammar) -> list[tuple[str, float]]:
    """Family and log-odds of each span of find(); of an assignment, its value counts. '' and 0 if no family reaches its floor."""
    out = []
    for start, kind, end in spans:
        token = ASSIGN.fullmatch(text, start, end)[2] if kind == 0 else text[start:end]
        family, odds = grammar.score(token)
        out.append((family, round(odds, 6) if family else 0.0))
    return out


def find(text: str, grammar: Grammar) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX_32.finditer(text)]
    # the furthest end of the base spans that begin at or before each start
    firsts = sorted((a, b) for a, _, b in out)
    begins, reach = [a for a, _ in firsts], list(accumulate((b for _, b in firsts), max))
    for m in CANDIDATE.finditer(text):
        run, done, stops = m[0], 0, None
        for s in grammar.starts(run):
            if s < done or len(run) - s < LEAST:
                continue
            if stops is None:
                stops, classes = [x.start() for x in STOP.finditer(run)] + [len(run)], run.translate(CLASSES)
            e = grammar.end(run, classes, s, stops)
            if e is not None:
                done = e
                held = bisect_right(begins, m.start() + s)
                if not held or reach[held - 1] < m.start() + e:
                    out.append((m.start() + s, 3, m.start() + e))
    return sorted(out)


def scan(docs: DataFrame, grammar: Grammar | None = None, redact: str | None = None) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end, family, odds>> of each row; with redact, the text with each span replaced by it
    (overlapping spans as one) instead of the other columns' being dropped: all columns of docs, their n_chars anew.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar or default_grammar())
    if redact is None:
        schema = "doc_id long, spans array<struct<start:int,kind:int,end:int,family:string,odds:double>>"
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("odds", pa.float64())]))

        def spans(text: str) -> list[dict]:
            found = find(text, shared.value)
            return [{"start": s, "kind": k, "end": e, "family": f, "odds": o} for (s, k, e), (f, o) in zip(found, rated(text, found, shared.value), strict=True)]

        def run(batches):
            for part, _, _ in slices(batches, "text"):
                found = [spans(x) if x else [] for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

    def clean(batches):
        for part, _, _ in slices(batches, "text"):
            texts = [x and without(x, find(x, shared.value), redact) for x in part.column("text").to_pylist()]
            cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            cols["text"] = pa.array(texts, part.schema.field("text").type)
            if "n_chars" in cols:
                lengths = [None if x is None else len(x) for x in texts]
                cols["n_chars"] = pa.array(lengths, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(clean, docs.schema)


def without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with the union of spans replaced by mark, once for each run."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def span_text(spans, kinds: tuple[str, ...]):
    """'kind:start:end,...' of an array column of spans."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op8_secrets."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = span_text(F.filter("spans", lambda x: x["kind"] < 3), KINDS)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans"), KINDS).alias("spans"), count(3).alias("n_format"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["family"], F.round(x["odds"], 3).cast("string"))), ",").alias("scores"), F.size("spans").cast("long").alias("n_found"),
    )
