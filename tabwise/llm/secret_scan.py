"""Secret scans: all rules in one automaton, one pass over the bytes.

The rules' regular expressions are compiled together: a nondeterministic automaton, subset
construction, minimisation, and a transition array over byte classes. A batch of documents is cut
where the automaton is in its first state whatever came before, and the pieces step through the
array side by side. An accepted end is followed backwards through the rule's reversed automaton,
which gives the places where a match may start.

Defined results: a null or empty text has no spans; repeated rows have equal results; a text of any
length is scanned whole; an empty table gives an empty table; other columns stay as they are, but
those with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that the group, or the whole match for 0, must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The order is that of spans that start together. Base rules come first. Lengths are tested on the
#: match, since counted repeats would multiply the states of the common automaton; the eight of "hex"
#: only keep short words of those letters from being looked at.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{8,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_spans", T.LongType()),
]


# --- regular expressions of bytes -> trees: ("set", bytes) ("cat", …) ("alt", …) ("rep", x, lo, hi)


class _Reader:
    """Literals, classes, groups, (?i:…), alternatives and ? * + {n} {n,} {n,m}: what rules need."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self, fold: bool = False) -> tuple:
        found = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence(fold))
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self, fold: bool) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom(fold)))
        return ("cat", parts)

    def repeated(self, node: tuple) -> tuple:
        if self.peek() in ("?", "*", "+") and self.peek():
            lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.take()]
            return ("rep", node, lo, hi)
        if m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.p, self.i):
            self.i = m.end()
            lo = int(m[1])
            return ("rep", node, lo, int(m[3]) if m[3] else None if m[2] else lo)
        return node

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self, fold: bool) -> tuple:
        if self.peek() == "(":
            self.take()
            if self.p.startswith("?i:", self.i):
                fold, self.i = True, self.i + 3
            elif self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives(fold)
            self.take()
            return node
        if self.peek() == "[":
            self.take()
            found: set[int] = set()
            while self.peek() != "]":
                lo = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    found.update(range(lo, self.char() + 1))
                else:
                    found.add(lo)
            self.take()
        else:
            found = {self.char()}
        if fold:
            found |= {ord(x) for c in found for x in (chr(c).lower(), chr(c).upper()) if ord(x) < 128}
        return ("set", frozenset(found))


def _reversed(node: tuple) -> tuple:
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.byte: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.byte.append(None)
        return len(self.free) - 1

    def add(self, node: tuple, at: int) -> int:
        """Append the tree's automaton to a state; its end."""
        if node[0] == "set":
            self.byte[at] = (node[1], end := self.state())
            return end
        if node[0] == "cat":
            for x in node[1]:
                at = self.fresh(at, x)
            return at
        if node[0] == "alt":
            end = self.state()
            for x in node[1]:
                begin = self.state()
                self.free[at].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        _, x, lo, hi = node
        for _ in range(lo):
            at = self.fresh(at, x)
        if hi is None:
            loop, end = self.state(), self.state()
            begin = self.state()
            self.free[at].append(loop)
            self.free[loop] += [begin, end]
            self.free[self.add(x, begin)].append(loop)
            return end
        end = self.state()
        for _ in range(hi - lo):
            self.free[at].append(end)
            at = self.fresh(at, x)
        self.free[at].append(end)
        return end

    def fresh(self, at: int, x: tuple) -> int:
        begin = self.state()
        self.free[at].append(begin)
        return self.add(x, begin)

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Automaton:
    """classes: of the 256 bytes; moves: (states, classes); accepts: bits of the rules of a state."""

    classes: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray


def compile_rules(trees: list[tuple], search: bool) -> Automaton:
    """Subset construction and minimisation. search: a match may begin at any byte. State 0 is first."""
    nfa = _Nfa()
    first, ends = nfa.state(), []
    for tree in trees:
        begin = nfa.state()
        nfa.free[first].append(begin)
        ends.append(nfa.add(tree, begin))
    marks = np.zeros((256, len(nfa.byte)), np.uint8)
    for s, b in enumerate(nfa.byte):
        if b:
            marks[list(b[0]), s] = 1
    _, sample, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)
    start = nfa.closure([first])
    steps = [(s, *b) for s, b in enumerate(nfa.byte) if b]
    goes = {s: (letters, to) for s, letters, to in steps}
    closed = {to: nfa.closure([to]) for _, _, to in steps}
    known, order, rows = {start: 0}, [start], []
    for at in order:
        row = []
        active = [goes[s] for s in at if s in goes]
        for c in sample:
            nxt = frozenset().union(*(closed[to] for letters, to in active if c in letters), start if search else ())
            if nxt not in known:
                known[nxt] = len(order)
                order.append(nxt)
            row.append(known[nxt])
        rows.append(row)
    moves = np.array(rows, np.int32)
    accepts = np.array([sum(1 << k for k, e in enumerate(ends) if e in at) for at in order], np.int64)
    group = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:  # states stay together while all their moves lead to the same groups
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    _, one = np.unique(group, return_index=True)
    # first state first, accepting states last, so that one comparison tells whether any accepts
    rank = sorted(range(len(one)), key=lambda g: (g != group[0], accepts[one[g]] != 0, g))
    place = np.empty(len(one), np.int32)
    place[rank] = np.arange(len(one))
    one = one[rank]
    return Automaton(classes.astype(np.uint8), place[group[moves[one]]], accepts[one])


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[re.Pattern]]:
    trees = [_Reader(r.pattern).alternatives() for r in rules]
    back = [compile_rules([_reversed(t)], search=False) for t in trees]
    return compile_rules(trees, search=True), back, [re.compile(r.pattern.encode()) for r in rules]


def ends(auto: Automaton, data: np.ndarray, limits: np.ndarray, piece: int = 1024) -> list[tuple[int, int]]:
    """(end, rule) wherever a rule has accepted and the next byte, or the text's end, ends that."""
    if not len(data):
        return []
    k = auto.moves.shape[1]
    codes = auto.classes[data]
    # after such a byte the state is the first one, whatever it was: pieces may begin there
    cut = np.flatnonzero((auto.moves == 0).all(axis=0)[codes]) + 1
    if len(cut):
        cut = cut[np.unique(cut // piece, return_index=True)[1]]
    starts = np.union1d(limits[:-1], cut)
    starts = starts[starts < len(data)]
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    moves = (auto.moves * k).astype(np.int32).ravel()
    accepts = auto.accepts
    first = int(np.argmax(accepts != 0)) * k if accepts.any() else k * len(accepts)
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) + 1), side="right")
    state = np.zeros(len(starts), np.int32)
    found: list[tuple[int, int]] = []

    def note(at: np.ndarray, bits: np.ndarray) -> None:
        for p, b in zip(at.tolist(), bits.tolist(), strict=True):
            found.extend((p, r) for r in range(int(b).bit_length()) if b >> r & 1)

    m = len(starts)
    for j in range(int(lengths[0])):
        if active[j] < m:
            done = np.flatnonzero(state[active[j] : m] >= first) + active[j]
            note(starts[done] + lengths[done], accepts[state[done] // k])
            m = int(active[j])
        old = state[:m]
        new = moves[old + codes[starts[:m] + j]]
        if old.max() >= first:
            hit = np.flatnonzero(old >= first)
            lost = accepts[old[hit] // k] & ~accepts[new[hit] // k]
            gone = np.flatnonzero(lost)
            note(starts[hit[gone]] + j, lost[gone])
        state[:m] = new
    done = np.flatnonzero(state[:m] >= first)
    note(starts[done] + lengths[done], accepts[state[done] // k])
    return found


def _starts(back: Automaton, data: np.ndarray, lo: int, end: int) -> list[int]:
    """Where the reversed automaton accepts, from the end towards lo."""
    moves, accepts, classes = back.moves, back.accepts, back.classes
    dead = [bool((moves[s] == s).all() and not accepts[s]) for s in range(len(accepts))]
    state, found = 0, []
    for p in range(end - 1, lo - 1, -1):
        state = int(moves[state, classes[data[p]]])
        if dead[state]:
            break
        if accepts[state]:
            found.append(p)
    return found[::-1]


def scan(data: np.ndarray, limits: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, rule, end) in bytes from the row's start, sorted; leftmost, not overlapping within a rule."""
    auto, back, exact = compiled(rules)
    out: dict[int, list[tuple[int, int, int]]] = {}
    free: dict[tuple[int, int], int] = {}
    for end, r in sorted(ends(auto, data, limits)):
        row = int(np.searchsorted(limits, end - 1, side="right")) - 1
        lo = int(limits[row])
        after = free.get((row, r), lo)
        start = next((s for s in _starts(back[r], data, lo, end) if s >= after), None)
        if start is None:
            continue
        free[row, r] = end
        rule = rules[r]
        m = exact[r].fullmatch(data[start:end].tobytes())
        if m and len(m[rule.group]) >= rule.least:
            out.setdefault(row, []).append((start - lo, r, end - lo))
    return {row: sorted(v) for row, v in out.items()}


def _digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


_NONE = _digest([])


def _columns(text: pa.Array, rules: tuple[Rule, ...]) -> list[pa.Array]:
    data, limits = utf8(text)
    n = len(text)
    counts = {kind: np.zeros(n, np.int64) for kind in BASE}
    digests, spans, total = [_NONE] * n, [""] * n, np.zeros(n, np.int64)
    for row, found in scan(data, limits, rules).items():
        body = data[limits[row] : limits[row + 1]]
        points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        named = [(rules[r].kind, f"{rules[r].kind}:{points[s]}:{points[e]}") for s, r, e in found]
        digests[row] = _digest([x for kind, x in named if kind in BASE])
        spans[row] = ",".join(x for _, x in named)
        total[row] = len(named)
        for kind, _ in named:
            if kind in counts:
                counts[kind][row] += 1
    return [*(pa.array(counts[kind]) for kind in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(total)]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and n_spans of each whole text."""
    return append(docs, ["text"], FIELDS, lambda text: _columns(text, rules))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that any rule found replaced by a mark; overlapping spans become one mark."""

    def masked(text: pa.Array) -> list[pa.Array]:
        data, limits = utf8(text)
        out = text.to_pylist()
        for row, found in scan(data, limits, rules).items():
            body, parts, at = data[limits[row] : limits[row + 1]].tobytes(), [], 0
            for s, _, e in found:
                if s >= at:
                    parts += [body[at:s], mark.encode()]
                at = max(at, e)
            out[row] = b"".join([*parts, body[at:]]).decode()
        return [pa.array(out, pa.string())]

    names = docs.columns
    return append(docs, ["text"], [T.StructField("text", T.StringType())], masked).select(*names)
