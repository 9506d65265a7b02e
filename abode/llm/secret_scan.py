r"""Secret scans (operator 10): one minimised automaton for all rules, one pass over the bytes.

Every rule is a regex over ASCII. ``compile_rules`` turns regexes into one NFA, determinises
it by subset construction and merges equal states by partition refinement; the result is an
array ``next_state[state, byte]`` and the accepting states. Two automata come from it:

* the combined, unanchored one over all rules scans each text once and marks the stretches in
  which some rule accepts;
* in those few stretches the anchored automaton of each rule gives leftmost, longest,
  non-overlapping matches, which are kept if the closing run is long enough.

Bytes that lead every state back to the start (newline, comma and most others that no rule
mentions) cut a text into stretches that do not depend on each other. The scan therefore runs
over all stretches of a batch at once, one byte of each per step, with numpy lookups; the few
stretches longer than the rest are finished one by one.

A rule's ``least`` is the least number of characters in its closing run (the characters at
which the regex already accepts): group 2 for ``assign``, the run after ``AKIA``, all of
``hex``. A shorter match is dropped after it has used up its text, as the contract says.

Defined results: a null or empty text has no spans; long texts are scanned whole; repeated
rows are scanned each; other columns pass through and ``secrets`` replaces a column of that
name. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.arrowtext import by_bytes, released, utf8
from abode.llm.columns import ROW, carried, kept, restored


class Rule(NamedTuple):
    kind: str
    regex: str
    least: int = 1
    trigger: str | None = None  # a regex that accepts inside every kept match; default: the regex


# The base rules and public formats of further secrets.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 16, r"AKIA[A-Z0-9]{4}"),
    Rule("hex", r"[0-9a-f]+", 24, r"[0-9a-f]{24}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BATCH_BYTES = 1 << 20
SHORT_WALK = 32  # bytes after which a walk without acceptance remembers its way, so that later ones do not repeat it


class Automaton(NamedTuple):
    next_state: np.ndarray  # int32 [states, 256]; state 0 is the start
    accepting: np.ndarray   # bool [states]


class _Nfa:
    """States with byte-set edges and empty edges, built from Python's own regex syntax trees."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, at: int, nocase: bool = False) -> int:
        """Append the tree behind state ``at``; returns the last state."""
        for op, arg in tree:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                to = self.state()
                self.edges[at].append((_bytes(op, arg, nocase), to))
                at = to
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, bool(nocase or arg[1] & re.IGNORECASE))
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, at, nocase)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, nocase)
                if most is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, nocase)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(end)
                        at = self.add(body, at, nocase)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules cannot use {op}")
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(op, arg, nocase: bool) -> frozenset:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    out: set[int] = set()
    negate = op is C.NOT_LITERAL
    for kind, value in [(C.LITERAL, arg)] if op in (C.LITERAL, C.NOT_LITERAL) else arg:
        if kind is C.NEGATE:
            negate = True
        elif kind is C.LITERAL:
            out.add(value)
        elif kind is C.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"rules cannot use {kind}")
    if max(out, default=0) > 127:
        raise ValueError("rules are ASCII")
    if nocase:
        out |= {ord(f(chr(b))) for b in out for f in (str.lower, str.upper)}
    return frozenset(range(256)) - out if negate else frozenset(out)


def compile_rules(regexes: list[str], anchored: bool) -> Automaton:
    """Subset construction, then minimisation. Unanchored: the start is live at every byte."""
    nfa = _Nfa()
    start, ends = nfa.state(), set()
    for regex in regexes:
        first = nfa.state()
        nfa.empty[start].append(first)
        ends.add(nfa.add(_parser.parse(regex), first))
    # bytes that no edge tells apart form one class and share a column
    sets = list({chars for edges in nfa.edges for chars, _ in edges})
    kinds: dict[tuple, int] = {}
    column = np.array([kinds.setdefault(tuple(b in c for c in sets), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(column == k)[0]) for k in range(len(kinds))]
    moves = [[tuple(to for chars, to in edges if b in chars) for b in sample] for edges in nfa.edges]
    initial = nfa.closure([start])
    found, todo, table, known = {initial: 0}, [initial], [], {}
    for now in todo:
        row = []
        for k in range(len(sample)):
            key = frozenset(to for s in now for to in moves[s][k])
            if key not in known:
                known[key] = nfa.closure(key if anchored else key | initial)
            nxt = known[key]
            if nxt not in found:
                found[nxt] = len(found)
                todo.append(nxt)
            row.append(found[nxt])
        table.append(row)
    table = np.array(table, np.int32)[:, column]
    return _minimise(table, np.array([bool(s & ends) for s in found]))


def _minimise(table: np.ndarray, accepting: np.ndarray) -> Automaton:
    """Refine {accepting, other} until all states of a class lead to the same classes; the start stays 0."""
    cls = accepting.astype(np.int32)
    _, columns = np.unique(table, axis=1, return_index=True)
    narrow = table[:, columns]
    while True:
        ids: dict[bytes, int] = {}  # numbered by first state, so the start's class is 0
        new = np.array([ids.setdefault(row.tobytes(), len(ids)) for row in np.column_stack([cls, cls[narrow]])], np.int32)
        if len(ids) == cls.max() + 1:
            break
        cls = new
    _, reps = np.unique(new, return_index=True)
    return Automaton(new[table[reps]], accepting[reps])


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.combined = compile_rules([r.trigger or r.regex for r in rules], anchored=False)
        self.single = []
        for rule in rules:
            a = compile_rules([rule.regex], anchored=True)
            dead = np.flatnonzero(~a.accepting & (a.next_state == np.arange(len(a.next_state))[:, None]).all(axis=1))
            self.single.append((a.next_state.tolist(), a.accepting.tolist(), int(dead[0])))
        self.resets = (self.combined.next_state == 0).all(axis=0)
        self.flat = (self.combined.next_state * 256).reshape(-1).astype(np.int32)  # states as row offsets
        self.hits = np.repeat(self.combined.accepting, 256)

    def marked(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Stretches [a, b) between reset bytes and text ends in which the combined automaton accepts."""
        cut = self.resets[data]
        ends = np.union1d(np.flatnonzero(cut), off[1:])
        starts = np.concatenate([[0], ends[:-1] + cut[ends[:-1]]]) if len(ends) else ends
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, ends = starts[order], ends[order]
        length = ends - starts
        state = np.zeros(len(starts), np.int32)
        hit = np.zeros(len(starts), bool)
        active, step = len(starts), 0
        while active > 32:
            s = self.flat[state[:active] + data[starts[:active] + step]]
            state[:active] = s
            hit[:active] |= self.hits[s]
            step += 1
            active = int(np.searchsorted(-length, -step, side="left"))
        for i in range(active):
            s = state[i] // 256
            table, accepting = self.rows
            for b in data[starts[i] + step:ends[i]].tobytes():
                s = table[s][b]
                if accepting[s]:
                    hit[i] = True
                    break
        found = np.sort(np.flatnonzero(hit))
        return np.column_stack([starts[found], ends[found]])

    @property
    def rows(self):
        if not hasattr(self, "_rows"):
            self._rows = self.combined.next_state.tolist(), self.combined.accepting.tolist()
        return self._rows

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of the kept matches in one stretch."""
        out = []
        for r, (table, accepting, dead) in enumerate(self.single):
            i, n, least = 0, len(text), self.rules[r].least
            first = table[0]
            lost: set[int] = set()  # (place, state) from which nothing is accepted any more, on long walks
            while i < n:
                if first[text[i]] == dead:
                    i += 1
                    continue
                s, j, end, run, trail = 0, i, -1, 0, []
                while j < n:
                    s = table[s][text[j]]
                    j += 1
                    if accepting[s]:
                        end, run = j, run + 1
                        trail.clear()
                    elif s == dead:
                        break
                    else:
                        run = 0
                        if j - max(i, end) > SHORT_WALK:
                            at = j * len(table) + s
                            if at in lost:
                                break
                            trail.append(at)
                lost.update(trail)
                if end < 0:
                    i += 1
                    continue
                if run >= least or (end < j and self._run(table, accepting, text, i, end) >= least):
                    out.append((r, i, end))
                i = end
        return out

    @staticmethod
    def _run(table, accepting, text, i, end) -> int:
        """Characters up to ``end`` at which the automaton, begun at i, has accepted without a break."""
        s = run = 0
        for b in text[i:end]:
            s = table[s][b]
            run = run + 1 if accepting[s] else 0
        return run

    def scan(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (start, end, rule) in code points, sorted by start, then rule."""
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in self.marked(data, off):
            row = int(np.searchsorted(off, a, side="right")) - 1
            for r, i, j in self.matches(data[a:b].tobytes()):
                spans.setdefault(row, []).append((int(a) + i - int(off[row]), int(a) + j - int(off[row]), r))
        for row, found in spans.items():
            text = data[off[row]:off[row + 1]]
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            spans[row] = sorted((int(points[i]), int(points[j]), r) for i, j, r in found)
        return spans


@lru_cache(maxsize=4)
def scanner(rules=RULES) -> Scanner:
    return Scanner(rules)


SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                    T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redacted(text: str, spans, rules=RULES) -> str:
    """The text with every span, overlapping ones together, replaced by ``[KIND]`` of the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, rule = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"[{rules[rule].kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text: str = "text", rules=RULES, redact: bool = False) -> DataFrame:
    """Add ``secrets``, sorted by start and rule; with ``redact`` also mask them in ``text``."""
    columns = kept(df, ("secrets", text))
    order = [c for c in df.columns if c.lower() != "secrets"]
    rows = carried(df, columns, text=F.col(f"`{text}`"))
    automaton = scanner(rules)  # compiled once, on the driver; its arrays go to the tasks with the function

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in by_bytes(off, BATCH_BYTES):
                part = off[a:b + 1]
                spans = automaton.scan(data[part[0]:part[-1]], part - part[0])
                texts = batch.column(1).slice(a, b - a)
                if redact and spans:
                    said = texts.to_pylist()
                    for row, found in spans.items():
                        said[row] = redacted(said[row], found, rules)
                    texts = pa.array(said, texts.type)
                values = [[{"kind": rules[r].kind, "start": i, "end": j} for i, j, r in spans.get(k, ())] for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts, pa.array(values, _ARROW)], names=[ROW, "text", "secrets"])

    out = rows.mapInArrow(released(run), T.StructType([rows.schema[ROW], rows.schema["text"], T.StructField("secrets", SECRETS)]))
    found = restored(out, columns, F.col("text").alias(text), F.col("secrets"))
    return found.select(*[F.col(f"`{c}`") for c in order], "secrets")
