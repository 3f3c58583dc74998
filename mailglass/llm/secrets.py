"""Secret scans: one combined deterministic automaton.

The rules' regular expressions become one nondeterministic automaton (each rule in front of "anything before"), subset
construction makes it deterministic, partition refinement minimises it, and its transitions lie in one array by state and
byte class. The texts' UTF-8 bytes pass through it once for all rules together, in numpy lanes of equal length side by side,
whatever the texts hold. Bytes that send every state to the start separate stretches, so no match crosses one. Where the
automaton accepts for a rule, that rule's own expression reads the stretch for exact leftmost spans.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mailglass.llm.common import append_columns, bounded, slices, tidy


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: over ASCII; matches are leftmost and non-overlapping. group, least: matches whose
    group has fewer characters are dropped afterwards. scan: what the automaton looks for, any match of `pattern` that is
    kept must contain one (default:
    pattern). Long counted runs multiply the automaton's states, so a rule with a telling prefix scans for that."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str = ""


_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""

BASE_RULES = (
    Rule("assign", _ASSIGN + r"([A-Za-z0-9+/_.=-]+)", 1, 6, _ASSIGN + r"[A-Za-z0-9+/_.=-]{6}"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Well-known public token formats beyond the base.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, r"-----BEGIN "),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abprs]-"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", 0, 1, r"AIza"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, r"eyJ"),
)
RULES = BASE_RULES + MORE_RULES
#: Bytes in a lane, and bytes before it that tell the state it starts in.
LANE, WARM = 4096, 64


class Nfa:
    """Thompson's automaton over bytes: `edges[s]` has (set of bytes, next), `free[s]` the moves that read nothing."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, items, s: int) -> int:
        """Appends a parsed expression behind state s; the state after it."""
        for op, arg in items:
            if op is rc.LITERAL:
                s = self.read(s, frozenset([arg]))
            elif op is rc.IN:
                s = self.read(s, self.members(arg))
            elif op is rc.SUBPATTERN:
                s = self.add(arg[3], s)
            elif op is rc.BRANCH:
                end = self.state()
                for option in arg[1]:
                    self.free[self.add(option, s)].append(end)
                s = end
            elif op is rc.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    s = self.add(inner, s)
                if most is rc.MAXREPEAT:
                    loop = self.state()
                    self.free[s].append(loop)
                    self.free[self.add(inner, loop)].append(loop)
                    s = loop
                else:
                    ends = [s]
                    for _ in range(most - least):
                        ends.append(s := self.add(inner, s))
                    s = self.state()
                    for e in ends:
                        self.free[e].append(s)
            else:
                raise ValueError(f"rules may not use {op}")
        return s

    def read(self, s: int, chars: frozenset[int]) -> int:
        if max(chars) > 127:
            raise ValueError("rules are over ASCII")
        self.edges[s].append((chars, end := self.state()))
        return end

    @staticmethod
    def members(arg) -> frozenset[int]:
        out: set[int] = set()
        for op, x in arg:
            if op is rc.LITERAL:
                out.add(x)
            elif op is rc.RANGE:
                out.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"rules may not use {op} in a set")
        return frozenset(out)

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """next_row[state * n_classes + class_of[byte]] is the next state's row (state * n_classes); accepts[state]: bit r for
    rule r; resets[byte]: every state goes to the start."""

    class_of: np.ndarray
    next_row: np.ndarray
    accepts: np.ndarray
    resets: np.ndarray
    n_classes: int


@cache
def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for r, rule in enumerate(rules):
        nfa.free[start].append(first := nfa.state())
        ends[nfa.add(rp.parse(rule.scan or rule.pattern), first)] = r
    # Bytes that no edge tells apart are one class.
    sets = sorted({c for es in nfa.edges for c, _ in es}, key=sorted)
    keys = [tuple(b in c for c in sets) for b in range(256)]
    classes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    class_of = np.array([classes[k] for k in keys], np.uint8)
    a_byte = [keys.index(k) for k in classes]
    # Subset construction; the start's states stay in every subset, so a match may begin anywhere.
    root = nfa.closure([start])
    number, todo, table = {root: 0}, [root], []
    while todo:
        now, todo = todo, []
        for subset in now:
            row = []
            for b in a_byte:
                to = nfa.closure({t for s in subset for c, t in nfa.edges[s] if b in c} | {start})
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
    delta = np.array(table)
    accepts = np.array([sum(1 << r for s, r in ends.items() if s in subset) for subset in number], np.int64)
    # Minimisation: refine by acceptance until the parts of the successors tell no more states apart.
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[delta]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, one_of = np.unique(part, return_index=True)
    order = np.argsort(one_of != one_of[part[0]], kind="stable")  # the start comes first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    delta, accepts = rank[part[delta[one_of[order]]]], accepts[one_of[order]]
    resets = (delta == 0).all(axis=0)[class_of]
    return Automaton(class_of, (delta * delta.shape[1]).astype(np.int32).ravel(), accepts, resets, delta.shape[1])


def run_lanes(data: np.ndarray, auto: Automaton, begin: np.ndarray, row: np.ndarray, steps: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Reads `steps` bytes from each place of begin on, side by side, from the rows given: the rows at the end, and for every
    step the lanes that accept with the rules' bits."""
    hits, last = [], len(data) - begin
    for t in range(steps):
        n = int(np.searchsorted(-last, -t, side="left"))  # places rise, so only the last lane ends early
        row[:n] = auto.next_row[row[:n] + auto.class_of[data[begin[:n] + t]]]
        bits = auto.accepts[row[:n] // auto.n_classes]
        if bits.any():
            i = np.flatnonzero(bits)
            hits.append((i, bits[i], t))
    return row, hits


def accepting(data: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The places behind which a rule accepts, and the rules' bits: one pass over the bytes, in lanes of LANE bytes.

    A lane starts in the state that the WARM bytes before it lead to from the start. Where the lane before really ends in
    another one, the lane is read again from there, until all agree.
    """
    begin = np.arange(0, len(data), LANE)
    row = np.zeros(len(begin), np.int32)
    row[1:], _ = run_lanes(data, auto, begin[1:] - WARM, row[1:], WARM)
    assumed = row.copy()
    end, hits = run_lanes(data, auto, begin, row, LANE)
    found = [(i, begin[i] + t, b, 0) for i, b, t in hits]
    turn, last = 0, np.zeros(len(begin), np.int64)
    wrong = np.flatnonzero(end[:-1] != assumed[1:]) + 1
    while len(wrong):
        turn += 1
        assumed[wrong], last[wrong] = end[wrong - 1], turn
        end[wrong], hits = run_lanes(data, auto, begin[wrong], assumed[wrong], LANE)
        found += [(wrong[i], begin[wrong[i]] + t, b, turn) for i, b, t in hits]
        wrong = np.flatnonzero(end[:-1] != assumed[1:]) + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = [(at[ok], b[ok]) for i, at, b, n in found if (ok := last[i] == n).any()]
    where, bits = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return where, bits


def hot_stretches(data: np.ndarray, auto: Automaton) -> dict[tuple[int, int], int]:
    """Stretches between two resetting bytes of data in which a rule accepts: (start, end) to the rules' bits."""
    if not len(data):
        return {}
    where, bits = accepting(data, auto)
    if not len(where):
        return {}
    order = np.argsort(where)
    where, bits = where[order], bits[order]
    cuts = np.flatnonzero(auto.resets[data])
    k = np.searchsorted(cuts, where)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    mask, k = np.bitwise_or.reduceat(bits, first), k[first]
    edges = np.concatenate([[-1], cuts, [len(data)]])
    return dict(zip(zip((edges[k] + 1).tolist(), edges[k + 1].tolist(), strict=True), mask.tolist(), strict=True))


def find_spans(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end) in code points, by start, then rule."""
    auto = compile_rules(rules)
    exact = [re.compile(r.pattern.encode()) for r in rules]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw])
    joined = b"\n".join(raw) + b"\n"
    if not auto.resets[10]:
        raise ValueError("no rule may read a line break")
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, b), mask in sorted(hot_stretches(np.frombuffer(joined, np.uint8), auto).items()):
        doc = int(np.searchsorted(ends, a, side="right"))
        base = int(ends[doc]) - len(raw[doc]) - 1
        for r, rule in enumerate(rules):
            if mask >> r & 1:
                found[doc] += [(a - base + m.start(), r, a - base + m.end()) for m in exact[r].finditer(joined[a:b]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    for spans, b, t in zip(found, raw, texts, strict=True):
        if spans and len(b) != len(t):  # bytes to code points: a match is ASCII, so only what lies before it counts
            marks = np.frombuffer(b, np.uint8)
            points = np.cumsum((marks & 0xC0) != 0x80)
            spans[:] = [(int(points[s]) - 1, r, int(points[s]) - 1 + e - s) for s, r, e in spans]
        spans.sort()
    return found


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def secret_spans(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """docs with an array of (kind, start, end) for every secret of the whole text; one pass, no shuffle.

    start and end count code points, the end is exclusive; order: start, then the rules' order. Null and empty texts have
    none. Repeated rows get equal results; a column called `name` gives way.
    """

    def work(texts: list[str]) -> list[pa.Array]:
        spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in f] for f in find_spans(texts, rules)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(spans, kind)]

    return append_columns(docs, text_col, work, [T.StructField(name, T.ArrayType(SPAN))])


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in the text replaced by [kind]; overlapping spans become one, named after the first. A null
    text stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, at):
                texts = b.column(at).to_pylist()
                out = []
                for t, spans in zip(texts, find_spans([t or "" for t in texts], rules), strict=True):
                    parts, done = [], 0
                    for s, r, e in spans:
                        if s >= done:
                            parts += [t[done:s], f"[{rules[r].kind}]"]
                        done = max(done, e)
                    out.append("".join([*parts, t[done:]]) if spans else t)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], names=b.schema.names)

    return bounded(docs).mapInArrow(tidy(run), docs.schema)


def span_digest(spans: list[dict], kinds: tuple[str, ...]) -> tuple[str, str]:
    """kind:start:end, comma-joined, of all spans; SHA-256 of the same for the base kinds alone."""
    joined = lambda xs: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in xs)
    base = joined([x for x in spans if x["kind"] in kinds])
    return joined(spans), hashlib.sha256(base.encode()).hexdigest()
