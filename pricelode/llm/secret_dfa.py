"""Secret scan with one combined deterministic automaton.

All rule patterns are compiled together: patterns -> one non-deterministic automaton -> subset construction ->
minimisation -> a transition array over byte classes.  A text is read once, byte by byte, for all rules: numpy advances
many lanes of a slice of texts together, one transition per lane and step.  Lanes start on the guess that nothing is
pending; a lane whose true entry state differs is run again until it meets its earlier states, so the result is that of a
single sequential pass.

The pass gives, per rule, the bytes where a match ends.  For each end the rule's reversed automaton gives the leftmost
start behind the previous match of the rule: matches are leftmost-longest and do not overlap within a rule.  A minimum
length of a group is checked on the matched text afterwards.

Null and empty texts have no spans.  Offsets are code points, end exclusive.  Other columns, also of clashing names, stay
unread; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import rowwise

#: Separates texts in the scanned buffer; it never occurs in UTF-8.
SEPARATOR = 0xFF
LANES = 8192
MAX_STATES = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` over ASCII; a match counts if ``group`` of it has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: The base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further well-known token shapes.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("service_token", r"(?:gh[opsur]_|xox[abprs]-|[sr]k_live_|AIza)[A-Za-z0-9_-]+", 0, 24),
    Rule("signed_token", r"eyJ[A-Za-z0-9_.-]+", 0, 30),
)
RULES = BASE_RULES + MORE_RULES


class Nfa:
    """Thompson construction; edges carry sets of bytes."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, fold: bool) -> int:
        for op, arg in items:
            at = self._one(op, arg, at, fold)
        return at

    def _one(self, op, arg, at: int, fold: bool) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
            end = self.state()
            self.edges[at].append((_bytes(op, arg, fold), end))
            return end
        if op is C.SUBPATTERN:
            _, on, off, items = arg
            return self.add(items, at, (fold or bool(on & re.I)) and not off & re.I)
        if op is C.BRANCH:
            end = self.state()
            for items in arg[1]:
                self.empty[self.add(items, at, fold)].append(end)
            return end
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, items = arg
            for _ in range(low):
                at = self.add(items, at, fold)
            if high is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(items, loop, fold)].append(loop)
                return loop
            end = self.state()
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.add(items, at, fold)
                self.empty[at].append(end)
            return end
        raise ValueError(f"unsupported in a rule: {op}")

    def reversed(self, start: int, end: int) -> tuple[Nfa, int, int]:
        other = Nfa()
        for _ in self.edges:
            other.state()
        for a, row in enumerate(self.edges):
            for chars, b in row:
                other.edges[b].append((chars, a))
        for a, row in enumerate(self.empty):
            for b in row:
                other.empty[b].append(a)
        return other, end, start

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(op, arg, fold: bool) -> frozenset:
    whole = set(range(256)) - {SEPARATOR}
    if op is C.ANY:
        return frozenset(whole - {10})
    if op is not C.IN:
        found, negate = {arg}, op is C.NOT_LITERAL
    else:
        found, negate = set(), False
        for kind, x in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found |= set(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"unsupported in a rule: {kind}")
    if any(x > 127 for x in found):
        raise ValueError("rules are over ASCII")
    if fold:
        found |= {ord(chr(x).swapcase()) for x in found if chr(x).isalpha()}
    return frozenset(whole - found if negate else found)


@dataclass
class Automaton:
    """``table[state * n_classes + class_of[byte]]`` is the next state, times ``n_classes``; ``accepts`` has rule bits by the same index."""

    class_of: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    n_classes: int


def determinise(nfa: Nfa, starts: list[int], ends: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction, then minimisation.  ``ends`` gives rule bits; ``anywhere`` lets a match begin at every byte."""
    sets = list(dict.fromkeys(chars for row in nfa.edges for chars, _ in row))
    signature = [tuple([b == SEPARATOR, *(b in s for s in sets)]) for b in range(256)]
    names = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    class_of = np.array([names[s] for s in signature], np.uint8)
    member = {i: next(b for b in range(256) if class_of[b] == i) for i in names.values()}
    moves = [{i: [t for chars, t in row if member[i] in chars] for i in member} for row in nfa.edges]
    first = nfa.closure(starts)
    number, todo, rows = {first: 0}, [first], []
    dead = int(class_of[SEPARATOR])
    for here in todo:
        row = []
        for i in range(len(names)):
            if i == dead:
                there = first if anywhere else frozenset()
            else:
                there = nfa.closure([*(starts if anywhere else ()), *(t for s in here for t in moves[s][i])])
            if there not in number:
                if len(number) >= MAX_STATES:
                    raise ValueError(f"the rules need over {MAX_STATES} states")
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        rows.append(row)
    step = np.array(rows, np.int64)
    accepts = np.array([sum({ends[s] for s in here if s in ends}) for here in todo], np.int64)
    label = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while their accepts and successors are alike
        finer = np.unique(np.column_stack([label, label[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == label.max():
            break
        label = finer
    order = np.zeros(label.max() + 1, np.int64)
    order[label[::-1]] = np.arange(len(label))[::-1]  # a member of each class
    rank = np.argsort(np.argsort(np.where(np.arange(len(order)) == label[0], -1, np.arange(len(order)))))  # the start is 0
    n, k = len(order), len(names)
    small, found = np.zeros((n, k), np.int32), np.zeros((n, k), np.uint16)
    small[rank] = rank[label[step[order]]] * k
    found[rank] = accepts[order][:, None]
    return Automaton(class_of, small.ravel(), found.ravel(), k)


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    """The combined automaton and, for each rule, the reversed one that finds starts from an end."""
    if len(rules) > 16:
        raise ValueError("at most 16 rules a scan")
    nfa, starts, ends, back = Nfa(), [], {}, []
    for i, rule in enumerate(rules):
        items = _parser.parse(rule.pattern)
        start = nfa.state()
        ends[nfa.add(items, start, False)] = 1 << i
        starts.append(start)
        single = Nfa()
        s = single.state()
        other, a, b = single.reversed(s, single.add(items, s, False))
        back.append(determinise(other, [a], {b: 1}, anywhere=False))
    return determinise(nfa, starts, ends, anywhere=True), back


def run_lanes(dfa: Automaton, data: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Rule bits that accept at each byte of ``data``."""
    width = max(64, -(-len(data) // lanes))
    n_lanes = -(-len(data) // width)
    padded = np.full(n_lanes * width, SEPARATOR, np.uint8)
    padded[: len(data)] = data
    classes = np.ascontiguousarray(dfa.class_of[padded].reshape(n_lanes, width).T)
    states = np.empty((width, n_lanes), np.int32)
    state, at = np.zeros(n_lanes, np.int32), np.empty(n_lanes, np.int32)
    entry = state.copy()
    for t in range(width):
        np.add(state, classes[t], out=at)
        np.take(dfa.table, at, out=states[t])
        state = states[t]
    while True:
        true = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
        wrong = np.flatnonzero(true != entry)
        if not len(wrong):
            break
        entry = true
        state = true[wrong]
        for t in range(width):
            state = dfa.table[state + classes[t, wrong]]
            apart = state != states[t, wrong]
            if not apart.any():
                break
            states[t, wrong] = state
    return dfa.accepts[states].T.ravel()[: len(data)]


def find_spans(data: list[bytes], rules: tuple[Rule, ...], dfa: Automaton, back: list[Automaton]) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of each text, in code points, by start."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in data]
    joined = bytes([SEPARATOR]).join(data) + bytes([SEPARATOR])
    buffer = np.frombuffer(joined, np.uint8)
    bits = run_lanes(dfa, buffer)
    hits = np.flatnonzero(bits)
    if not len(hits):
        return out
    starts = np.cumsum([0, *(len(x) + 1 for x in data)])[:-1]
    owner = np.searchsorted(starts, hits, side="right") - 1
    last = bits[hits] & ~bits[np.minimum(hits + 1, len(bits) - 1)]  # the rule accepts here but not one byte on
    behind: dict[tuple[int, int], int] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for hit, doc, ends in zip(hits.tolist(), owner.tolist(), last.tolist()):
        for i, rule in enumerate(rules):
            if not ends >> i & 1:
                continue
            floor = behind.get((doc, i), int(starts[doc]))
            start = _leftmost(back[i], joined, hit + 1, floor)
            if start is None:
                continue
            behind[doc, i] = hit + 1
            text = joined[start : hit + 1].decode("ascii", "replace")
            found = re.fullmatch(rule.pattern, text)
            if found and len(found[rule.group]) >= rule.at_least:
                spans.setdefault(doc, []).append((start - int(starts[doc]), i, hit + 1 - int(starts[doc])))
    for doc, found in spans.items():
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data[doc], np.uint8) & 0xC0) != 0x80)])
        out[doc] = sorted((int(chars[a]), i, int(chars[b])) for a, i, b in found)
    return out


def _leftmost(back: Automaton, joined: bytes, end: int, floor: int) -> int | None:
    state, best = 0, None
    dead = back.table[back.class_of[SEPARATOR]]
    for at in range(end - 1, floor - 1, -1):
        state = back.table[state + back.class_of[joined[at]]]
        if state == dead:
            break
        if back.accepts[state]:
            best = at
    return best


def scan_secrets(df: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns plus ``secrets``: array of (kind, start, end), by start, then in the order of the rules."""
    dfa, back = compile_rules(rules)
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField("secrets", T.ArrayType(item))])

    def work(data):
        found = find_spans(data, rules, dfa, back)
        return {"secrets": [[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in row] for row in found]}

    return rowwise(df, text, out, work, keep)


def secret_digest(df: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every document."""
    found = scan_secrets(df, ["doc_id"])
    base = [r.kind for r in BASE_RULES]
    listed = lambda col: F.array_join(
        F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        F.size("secrets").cast("long").alias("n_spans"),
    )
