"""Secret scanning with one deterministic automaton over all rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` is ASCII and must end in a repeated class or in fixed text; the last group,
    or the whole match where there is none, must have ``at_least`` characters, else the match is dropped (but
    still uses up its text).."""

    kind: str
    pattern: str
    at_least: int = 1


def _any_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


# The three base kinds, in their order.
BASE = (
    Rule(
        "assign",
        "(?:" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{8,}", 32),
)
EXTRA = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", 30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)


class _Nfa:
    """States with empty moves and moves on sets of bytes, from the standard library's parse of a pattern."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, items, at: int, backward: bool) -> int:
        """Lay out ``items`` from state ``at``; returns where they end."""
        for code, arg in reversed(items) if backward else items:
            if code in (op.LITERAL, op.IN):
                to = self.state()
                self.moves[at].append((_bytes(code, arg), to))
                at = to
            elif code is op.SUBPATTERN:
                at = self.add(list(arg[3]), at, backward)
            elif code is op.BRANCH:
                out = self.state()
                for branch in arg[1]:
                    first = self.state()
                    self.empty[at].append(first)
                    self.empty[self.add(list(branch), first, backward)].append(out)
                at = out
            elif code is op.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(list(inner), at, backward)
                if high is op.MAXREPEAT:
                    loop, out = self.state(), self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(list(inner), loop, backward)].append(loop)
                    self.empty[loop].append(out)
                    at = out
                else:
                    out = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(out)
                        at = self.add(list(inner), at, backward)
                    self.empty[at].append(out)
                    at = out
            else:
                raise ValueError(f"{code} is not supported in a rule")
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(code, arg) -> frozenset:
    out: set[int] = set()
    for c, a in [(code, arg)] if code is op.LITERAL else arg:
        if c is op.LITERAL:
            out.add(a)
        elif c is op.RANGE:
            out.update(range(a[0], a[1] + 1))
        else:
            raise ValueError(f"{c} is not supported in a class")
    if max(out) > 127:
        raise ValueError("rules are ASCII")
    return frozenset(out)


def compile_dfa(patterns: list[str], search: bool = True, backward: bool = False) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Minimal automaton of all patterns: (states x 256) next states, and the patterns that each state accepts.

    State 0 is the start. With ``search`` a match can begin at any byte. Subset construction over classes of
    bytes that no pattern tells apart, then Moore's refinement.
    """
    nfa = _Nfa()
    start, final = nfa.state(), {}
    for k, p in enumerate(patterns):
        first = nfa.state()
        nfa.empty[start].append(first)
        final[nfa.add(list(_parser.parse(p)), first, backward)] = k
    sets = {s for moves in nfa.moves for s, _ in moves}
    kind_of = {}
    kind = np.array([kind_of.setdefault(tuple(b in s for s in sets), len(kind_of)) for b in range(256)])
    example = [int(np.argmax(kind == k)) for k in range(len(kind_of))]
    origin = nfa.closure([start])
    number, order, table = {origin: 0}, [origin], []
    for states in order:  # grows meanwhile
        row = []
        for b in example:
            to = {t for s in states for chars, t in nfa.moves[s] if b in chars}
            to = nfa.closure(to) | origin if search else nfa.closure(to)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    accepts = [tuple(sorted({final[s] for s in states if s in final})) for states in order]
    table = np.array(table)
    of_accept = {}
    part = np.array([of_accept.setdefault(a, len(of_accept)) for a in accepts])
    while True:
        _, first, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if len(first) == part.max() + 1:
            break
        part = finer
    swap = {int(finer[0]): 0}
    for p in finer:
        swap.setdefault(int(p), len(swap))
    rank = np.array([swap[p] for p in range(len(first))])
    small = np.empty((len(first), len(example)), dtype=np.int64)
    small[rank] = rank[finer[table[first]]]
    named = [()] * len(first)
    for p, f in enumerate(first):
        named[rank[p]] = accepts[f]
    return small[:, kind].astype(np.int32), named


def _linked(table: np.ndarray, accepts: list) -> list:
    """States as lists of their 256 next states, and at 256 what they accept: a byte costs one look-up."""
    rows = [[None] * 256 + [a] for a in accepts]
    for row, to in zip(rows, table.tolist(), strict=True):
        row[:256] = [rows[t] for t in to]
    return rows


class Scanner:
    """Finds every rule's leftmost, longest, non-overlapping matches with one forward pass over the bytes.

    The forward automaton yields, by rule, the ends of runs of accepting positions; the rule's backward
    automaton then walks from such an end to the leftmost start after the rule's last match.
    """

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.forward = compile_dfa([r.pattern for r in rules])
        self.back = [compile_dfa([r.pattern], search=False, backward=True) for r in rules]

    def prepare(self) -> Scanner:
        """Build the look-up structures, once in each worker's task."""
        self._rows = _linked(*self.forward)
        self._back = [_linked(*x)[0] for x in self.back]
        self._exact = [re.compile(r.pattern.encode()) for r in self.rules]
        return self

    def ends(self, data: bytes) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        s = self._rows[0]
        for i, b in enumerate(data, 1):
            s = s[b]
            if s[256]:
                for k in s[256]:
                    runs = found.setdefault(k, [])
                    if runs and runs[-1] == i - 1:
                        runs[-1] = i
                    else:
                        runs.append(i)
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted."""
        out = []
        for k, runs in self.ends(data).items():
            last = 0
            for end in runs:
                s, start, i = self._back[k], -1, end
                while i > last and s is not None:
                    i -= 1
                    s = s[data[i]]
                    if s[256]:
                        start = i
                    elif all(t is s for t in s[:256]):
                        s = None  # nothing can follow
                if start < 0:
                    continue
                m = self._exact[k].fullmatch(data, start, end)
                last = end
                if len(m[m.lastindex or 0]) >= self.rules[k].at_least:
                    out.append((start, k, end))
        return sorted(out)


def _offsets(data: bytes, spans: list) -> list[tuple[int, int]]:
    """Byte spans as code point spans."""
    if data.isascii() or not spans:
        return [(a, b) for a, _, b in spans]
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(points[i - 1]) if i else 0
    return [(at(a), at(b)) for a, _, b in spans]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``, an array of (kind, start, stop, secret) by start, then by
    the order of the rules. Offsets are code points, the end exclusive. Null and empty texts have no spans;
    repeated rows and null ids are scanned like any other; an empty table gives an empty one. Texts are scanned whole.
    """
    scanner = Scanner(rules)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner.prepare()
        for batch in batches:
            found = []
            for text in batch["t"]:
                data = text.encode() if text else b""
                spans = scanner.spans(data)
                points = _offsets(data, spans)
                found.append(
                    [
                        {"kind": rules[k].kind, "start": p, "stop": q, "secret": data[a:b].decode()}
                        for (a, k, b), (p, q) in zip(spans, points, strict=True)
                    ]
                )
            yield pd.DataFrame({"id": batch["id"], "spans": found})

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("t"))  # as a float, an id would lose digits
    found = chosen.mapInPandas(scan, "id string, spans array<struct<kind:string,start:bigint,stop:bigint,secret:string>>")
    return found.select(found["id"].cast(kind).alias(id_col), "spans")
