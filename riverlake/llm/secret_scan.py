"""Secret scans by one automaton that all rules share.

Each rule is a regular expression over bytes. The rules are read backwards and joined into one
nondeterministic automaton that may begin anywhere; the subset construction makes it
deterministic, and states that no input can tell apart are merged. What is left are transition
arrays over classes of bytes. One pass over the bytes of a text, from its end to its start, then
tells for each place which rules have a match that begins there. From the leftmost such place
that no earlier match of the rule covers, a forward automaton of the rule gives the longest
match. So the scan is linear: each byte is stepped once, and bytes of matches once more. A match
that fails its rule's check of length is dropped after it was made, so it still covers its text.

Rules must be such that the longest match is the one that is meant, may not match the empty
string, and are matched to bytes: a class of ASCII letters and signs says what it says in any
text, as no such byte is part of a longer character.

Defined results: a null text is empty and has no spans. Places count code points, the end is
exclusive. Matches of different rules may overlap and all stay. Repeated rows give equal rows; a
null id is kept; an empty table gives no rows. A text of any length is scanned whole. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as kind
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riverlake.llm.rows import over_texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and what length its ``group`` must have to count."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    def holds(self, said: str) -> bool:
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        return len(re.fullmatch(self.pattern, said, flags)[self.group]) >= self.least


# The kinds that are always looked for, in the order in which they are listed.
BASE_RULES = [
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=12,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # Runs of 16 and more: the automaton counts, so that shorter runs need no look.
    Rule("hex", r"[0-9a-f]{16,}", least=16),
]

# Public formats of credentials.
MORE_RULES = [
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+)", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("key_block", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:([A-Za-z0-9._~%!$*+-]+)@[A-Za-z0-9-]", least=6, group=1),
]
RULES = BASE_RULES + MORE_RULES


# -- from patterns to automata --------------------------------------------------------------

Edges = list[tuple[int, frozenset[int], int]]


class Builder:
    """A nondeterministic automaton: edges over sets of bytes, and empty edges."""

    def __init__(self) -> None:
        self.size = 0
        self.edges: Edges = []
        self.empty: list[tuple[int, int]] = []

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def _set(self, op, value, any_case: bool) -> frozenset[int]:
        if op is kind.LITERAL:
            found = {value}
        elif op is kind.RANGE:
            found = set(range(value[0], value[1] + 1))
        elif op is kind.IN and value[0][0] is not kind.NEGATE:
            found = {b for o, v in value for b in self._set(o, v, any_case)}
        else:
            raise ValueError(f"rules have no {op}")
        if max(found) > 127:
            raise ValueError("rules are over ASCII")
        if any_case:
            found |= {ord(c) for b in found for c in (chr(b).lower(), chr(b).upper())}
        return frozenset(found)

    def add(self, tree, start: int, any_case: bool, backwards: bool) -> int:
        """The state in which what the parsed pattern matches ends."""
        for op, value in reversed(list(tree)) if backwards else tree:
            if op is kind.SUBPATTERN:
                start = self.add(value[3], start, any_case, backwards)
            elif op is kind.BRANCH:
                ends = [self.add(way, start, any_case, backwards) for way in value[1]]
                start = self.state()
                self.empty += [(end, start) for end in ends]
            elif op is kind.MAX_REPEAT:
                least, most, inner = value
                for _ in range(least):
                    start = self.add(inner, start, any_case, backwards)
                if most is kind.MAXREPEAT:
                    loop = self.state()
                    self.empty.append((start, loop))
                    self.empty.append((self.add(inner, loop, any_case, backwards), loop))
                    start = loop
                else:
                    skips = [start]
                    for _ in range(most - least):
                        skips.append(self.add(inner, skips[-1], any_case, backwards))
                    start = self.state()
                    self.empty += [(skip, start) for skip in skips]
            else:
                end = self.state()
                self.edges.append((start, self._set(op, value, any_case), end))
                start = end
        return start


class Automaton:
    """A deterministic, minimal automaton as arrays.

    ``classes`` maps bytes to classes of bytes, ``step[state * n_classes + class]`` is the next
    state times ``n_classes``, and ``accepts[state]`` has bit ``i`` if rule ``i`` accepts. States
    are in order of whether they accept, so that ``first`` tells them apart. State 0 is the start,
    and ``dead`` is the state that nothing leaves, if there is one.
    """

    def __init__(self, rules: list[Rule], backwards: bool, anywhere: bool):
        nfa = Builder()
        begin = nfa.state()
        finals = {}
        for i, rule in enumerate(rules):
            own = nfa.state()
            nfa.empty.append((begin, own))
            tree = _parser.parse(rule.pattern)
            finals[nfa.add(tree, own, rule.any_case, backwards)] = i
        if anywhere:
            nfa.edges.append((begin, frozenset(range(256)), begin))
        self._classes(nfa.edges)
        self._subsets(nfa, begin, finals)
        self._merge()

    def _classes(self, edges: Edges) -> None:
        told = np.array([[b in over for b in range(256)] for _, over, _ in edges])
        _, first, self.byte_class = np.unique(told, axis=1, return_index=True, return_inverse=True)
        self.byte_class = self.byte_class.ravel()
        self.samples, self.n_classes = first.tolist(), len(first)

    def _subsets(self, nfa: Builder, begin: int, finals: dict[int, int]) -> None:
        jumps: dict[int, list[int]] = {}
        for a, b in nfa.empty:
            jumps.setdefault(a, []).append(b)
        moves: dict[tuple[int, int], list[int]] = {}
        for a, over, b in nfa.edges:
            for c, sample in enumerate(self.samples):
                if sample in over:
                    moves.setdefault((a, c), []).append(b)

        def closed(states: set[int]) -> frozenset[int]:
            todo = list(states)
            while todo:
                for b in jumps.get(todo.pop(), ()):
                    if b not in states:
                        states.add(b)
                        todo.append(b)
            return frozenset(states)

        known = {closed({begin}): 0}
        order, rows = list(known), []
        while len(rows) < len(order):
            subset, row = order[len(rows)], []
            for c in range(self.n_classes):
                after = closed({b for a in subset for b in moves.get((a, c), ())})
                if after not in known:
                    known[after] = len(order)
                    order.append(after)
                row.append(known[after])
            rows.append(row)
        self.table = np.array(rows)
        self.masks = np.array([sum(1 << finals[s] for s in subset if s in finals) for subset in order])

    def _merge(self) -> None:
        """Split states by what they accept, then by where they go, until nothing changes."""
        group = np.unique(self.masks, return_inverse=True)[1]
        while True:
            told = np.concatenate([group[:, None], group[self.table]], axis=1)
            finer = np.unique(told, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        # The start first, then states that accept nothing, then the others.
        first = np.unique(group, return_index=True)[1]
        rank = sorted(range(len(first)), key=lambda g: (g != group[0], self.masks[first[g]] != 0, g))
        renamed = np.empty(len(first), np.int64)
        renamed[rank] = np.arange(len(first))
        kept = first[rank]
        self.table = renamed[group[self.table[kept]]]
        self.masks = self.masks[kept]
        self.first = int((self.masks == 0).sum())
        loops = [s for s in range(self.first) if (self.table[s] == s).all()]
        self.dead = loops[0] if loops else -1
        self.classes = bytes(self.byte_class.astype(np.uint8).tolist())
        self.step = (self.table * self.n_classes).ravel().tolist()
        self.accepts = self.masks.tolist()


class Scanner:
    """Spans of all rules in texts."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.starts = Automaton(rules, backwards=True, anywhere=True)
        self.ends = [Automaton([rule], backwards=False, anywhere=False) for rule in rules]

    def _end(self, rule: int, data: bytes, start: int) -> int:
        """Where the longest match from ``start`` ends."""
        own = self.ends[rule]
        step, n, state, end = own.step, own.n_classes, 0, start
        least, dead = own.first * n, own.dead * n
        for place in range(start, len(data)):
            state = step[state + own.classes[data[place]]]
            if state >= least:
                end = place + 1
            elif state == dead:
                break
        return end

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, sorted."""
        data = text.encode("utf-8")
        step, n = self.starts.step, self.starts.n_classes
        least, state, found, place = self.starts.first * n, 0, [], len(data)
        for c in data[::-1].translate(self.starts.classes):
            place -= 1
            state = step[state + c]
            if state >= least:
                found.append((place, state))
        if not found:
            return []
        covered = [0] * len(self.rules)
        out = []
        for place, state in reversed(found):
            mask = self.starts.accepts[state // n]
            for rule in range(len(self.rules)):
                if mask >> rule & 1 and place >= covered[rule]:
                    covered[rule] = end = self._end(rule, data, place)
                    if self.rules[rule].holds(data[place:end].decode("ascii")):
                        out.append((place, rule, end))
        if not text.isascii():
            out = _in_code_points(data, out)
        return out


def _in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Places in bytes as places in code points; matches are ASCII, so their length stays."""
    out, at, points = [], 0, 0
    for start, rule, end in spans:
        points += len(data[at:start].decode("utf-8"))
        at = start
        out.append((points, rule, points + end - start))
    return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in the driver; its arrays are sent to the tasks."""
    return Scanner(list(rules))


# -- over tables ----------------------------------------------------------------------------


def find_secrets(
    docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end) by start, then order of rules."""
    return _scan(
        docs, tuple(rules or RULES), id_col, text_col,
        "spans array<struct<kind: string, start: long, end: long>>",
        lambda names, spans: ([{"kind": names[r], "start": s, "end": e} for s, r, e in spans],),
    )


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts and digest of the base kinds, and all spans as text."""

    def digest(names: list[str], spans: list[tuple[int, int, int]]) -> tuple:
        said = [(r, f"{names[r]}:{s}:{e}") for s, r, e in spans]
        base = ",".join(text for r, text in said if r < len(BASE_RULES))
        counts = [sum(r == i for r, _ in said) for i in range(len(BASE_RULES))]
        return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in said))

    columns = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _scan(docs, tuple(RULES), id_col, text_col, columns, digest)


def _scan(
    docs: DataFrame,
    rules: tuple[Rule, ...],
    id_col: str,
    text_col: str,
    columns: str,
    row: Callable[[list[str], list[tuple[int, int, int]]], tuple],
) -> DataFrame:
    names = [rule.name for rule in rules]
    schema = f"id long, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    kinds, fields = arrow.types[1:], arrow.names
    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = compiled.value.spans
        for batch in batches:
            rows = [row(names, find(text)) for text in batch.column(1).to_pylist()]
            if rows:
                made = [pa.array(list(c)) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[c.cast(k) for c, k in zip(made, kinds)]], fields
                )

    return over_texts(docs, id_col, text_col, schema, step).withColumnRenamed("id", id_col)
