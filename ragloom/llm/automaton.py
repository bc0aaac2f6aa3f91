"""One deterministic automaton for many regular expressions.

Rules are parsed to NFAs, each is determinised by subset construction, the
products of all rules are enumerated into one transition table, and that table
is minimised.  A scan then reads every byte once, whatever the number of rules.

A rule carries the marker ``(?C)`` where a match is *committed*: from there on
it takes its longest extension, later starts inside it are dropped, and the
rule starts afresh at the byte that ends it.  What ends in an accepting state
is reported; a committed match that dies before is consumed and not reported.
That is leftmost, greedy, non-overlapping search with a test of the match
afterwards, for rules whose keywords do not nest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    ignore_case: bool = False
    least: int = 0  # shorter matches are consumed and not reported


# -- parsing ---------------------------------------------------------------
# AST: ("set", frozenset of bytes) | ("seq", [..]) | ("alt", [..]) |
#      ("rep", node, least, most or None) | ("commit",)


class _Parser:
    """Bytes literals, classes, groups, ``| ? * + {n} {n,}``, ``\\xHH`` and ``(?C)``."""

    def __init__(self, rule: Rule):
        self.s, self.i, self.fold = rule.pattern, 0, rule.ignore_case

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def one(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def both(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes = codes | {c ^ 32 for c in codes if chr(c).isalpha() and c < 128}
        return frozenset(codes)

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() and self.peek() not in "|)":
            found.append(self.repeated(self.atom()))
        return ("seq", found)

    def atom(self):
        if self.s.startswith("(?C)", self.i):
            self.i += 4
            return ("commit",)
        if self.peek() == "(":
            self.i += 1
            inner = self.alternatives()
            self.i += 1
            return inner
        if self.peek() == "[":
            self.i += 1
            codes: set[int] = set()
            while self.peek() != "]":
                low = self.one()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    codes |= set(range(low, self.one() + 1))
                else:
                    codes.add(low)
            self.i += 1
            return ("set", self.both(codes))
        return ("set", self.both({self.one()}))

    def repeated(self, node):
        c = self.peek()
        if c in ("?", "*", "+") and c:
            self.i += 1
            return ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        if c == "{":
            end = self.s.index("}", self.i)
            low, comma, high = self.s[self.i + 1 : end].partition(",")
            self.i = end + 1
            return ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
        return node


def parse(rule: Rule):
    return _Parser(rule).alternatives()


def reverse(node):
    kind = node[0]
    if kind in ("seq", "alt"):
        parts = [reverse(x) for x in node[1]]
        return (kind, parts[::-1] if kind == "seq" else parts)
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


@dataclass
class _Nfa:
    """States are numbers; ``moves[s]`` holds (bytes, target), ``free[s]`` the empty moves."""

    moves: list = field(default_factory=list)
    free: list = field(default_factory=list)
    commits: set = field(default_factory=set)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, at: int) -> int:
        """Append ``node`` behind state ``at``; returns the state behind it."""
        kind = node[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((node[1], to))
            return to
        if kind == "commit":
            to = self.state()
            self.free[at].append(to)
            self.commits.add(to)
            return to
        if kind == "seq":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            to = self.state()
            for x in node[1]:
                first = self.state()
                self.free[at].append(first)
                self.free[self.add(x, first)].append(to)
            return to
        _, inner, least, most = node
        for _ in range(least):
            at = self.add(inner, at)
        if most is None:
            loop, to = self.state(), self.state()
            self.free[at].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(to)
            return to
        to = self.state()
        self.free[at].append(to)
        for _ in range(most - least):
            at = self.add(inner, at)
            self.free[at].append(to)
        return to

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states, byte: int) -> frozenset[int]:
        return self.closed({t for s in states for codes, t in self.moves[s] if byte in codes})


def _nfa(node) -> tuple[_Nfa, int, int]:
    nfa = _Nfa()
    start = nfa.state()
    return nfa, start, nfa.add(node, start)


class Backwards:
    """Finds where a match begins, from its end, by the reversed rule."""

    def __init__(self, rule: Rule):
        self.nfa, start, self.accept = _nfa(reverse(parse(rule)))
        self.first = self.nfa.closed({start})
        self.known: dict = {}

    def start(self, data: bytes, low: int, end: int) -> int:
        """The leftmost begin, not before ``low``, of a match that ends at ``end``."""
        states, found, i = self.first, end, end
        while i > low and states:
            i -= 1
            key = (states, data[i])
            if key not in self.known:
                self.known[key] = self.nfa.step(states, data[i])
            states = self.known[key]
            if self.accept in states:
                found = i
        return found


def _classes(rules_sets: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Byte classes that no set tells apart, and one byte of each."""
    names: dict[tuple, int] = {}
    of = np.zeros(256, np.uint8)
    sample: list[int] = []
    for b in range(256):
        key = tuple(b in s for s in rules_sets)
        if key not in names:
            names[key] = len(names)
            sample.append(b)
        of[b] = names[key]
    return of, sample


def _determinise(rule: Rule, sample: list[int]):
    """Subset construction with commit and restart: (transitions, report, committed)."""
    nfa, start, accept = _nfa(parse(rule))
    behind = {s: nfa.closed({s}) for s in nfa.commits}
    inside: set[int] = set()  # states that lie behind a commit
    todo = [s for c in behind.values() for s in c]
    while todo:
        s = todo.pop()
        if s not in inside:
            inside.add(s)
            todo += [t for _, t in nfa.moves[s]] + nfa.free[s]
    fresh = nfa.closed({start})

    def kept(states: frozenset[int]) -> tuple[frozenset[int], bool]:
        held = states & inside
        return (frozenset(held), True) if held else (states, False)

    first = (frozenset(), False)
    ids, order, rows = {first: 0}, [first], []
    for states, committed in order:  # grows while it is walked
        row = []
        for b in sample:
            if committed:
                to = nfa.step(states, b)
                to = kept(to) if to else kept(nfa.step(fresh, b))
            else:
                to = kept(nfa.step(states | fresh, b))
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    return rows, [accept in s for s, _ in order], [c for _, c in order]


@dataclass
class Automaton:
    rules: tuple[Rule, ...]
    classes: np.ndarray  # byte -> class
    table: np.ndarray  # flat; an entry is the next state times the number of classes
    marks: np.ndarray  # by entry: bit k: rule k may end here; bit 16 + k: rule k is committed
    resets: np.ndarray  # byte -> it leads every state to the same one
    backwards: list[Backwards]
    sizes: dict
    reset_classes: np.ndarray = None  # class -> as resets
    reports: np.ndarray = None  # entry -> some rule may end here

    def __post_init__(self):
        self.reset_classes = np.zeros(int(self.classes.max()) + 1, bool)
        self.reset_classes[self.classes] = self.resets
        self.reports = (self.marks & 0xFFFF) > 0


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    assert len(rules) <= 16
    sets = sorted({codes for r in rules for row in _nfa(parse(r))[0].moves for codes, _ in row}, key=sorted)
    classes, sample = _classes(sets)
    each = [_determinise(r, sample) for r in rules]
    first = (0,) * len(rules)
    ids, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for k in range(len(sample)):
            to = tuple(one[0][s][k] for one, s in zip(each, state, strict=True))
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    step = np.array(rows, np.int32)
    mark = np.array([sum((one[1][s] << k) | (one[2][s] << (16 + k)) for k, (one, s) in enumerate(zip(each, state, strict=True))) for state in order], np.int64)
    # Moore's partition refinement: states stay together while marks and the blocks of all successors agree
    block = np.unique(mark, return_inverse=True)[1].ravel()
    while True:
        signature = np.concatenate([block[:, None], block[step]], axis=1)
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    count, width = int(block.max()) + 1, len(sample)
    least = np.zeros((count, width), np.int32)
    least[block] = block[step]
    marks = np.zeros(count * width, np.int64)
    marks[block * width] = mark
    begin = int(block[0])  # the first state becomes 0
    swap = np.arange(count)
    swap[[0, begin]] = swap[[begin, 0]]
    least = swap[least[swap]]
    marks = marks.reshape(count, width)[swap].ravel()
    alike = (least == least[0]).all(axis=0)
    sizes = {"rules": [len(x[0]) for x in each], "product": len(order), "minimal": count, "classes": width}
    return Automaton(rules, classes, (least * width).astype(np.int32).ravel(), marks, alike[classes], [Backwards(r) for r in rules], sizes)


def scan(a: Automaton, data: bytes, lanes: int = 1024) -> list[tuple[int, int, int]]:
    """All matches in ``data`` as (rule, start, end), in bytes.

    The buffer is cut at bytes that lead every state to one state (any cut
    there is exact) into lanes that advance side by side, one table lookup a
    byte.  A stretch without such a byte stays whole in one lane, which is then
    walked by itself.
    """
    classes = a.classes[np.frombuffer(data, np.uint8)]
    n = len(classes)
    if not n:
        return []
    assert a.resets.any(), "these rules use every byte"
    safe = np.flatnonzero(a.reset_classes.take(classes))
    size = max(64, -(-n // lanes))
    at = np.searchsorted(safe, np.arange(size, n, size))
    cuts = np.unique(np.concatenate([[0], safe[at[at < len(safe)]], [n]]))
    starts, lengths = cuts[:-1], np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    long = int((lengths > 16 * size).sum())
    found: list[tuple[int, int, int]] = []
    for s, m in zip(starts[:long], lengths[:long], strict=True):
        found += _lane_matches(a, data, int(s), _walk(a, classes[s : s + m]))
    starts, lengths = starts[long:], lengths[long:]
    if len(starts):
        most = int(lengths[0])
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(most), side="right")
        rows = np.concatenate([[0], np.cumsum(active)])  # a step's states lie together, one for each lane that has not ended: as many in all as bytes
        states = np.empty(rows[-1], np.int32)
        hit = np.zeros(len(starts), bool)
        now, at = np.zeros(len(starts), np.int32), starts.copy()
        for i, k in enumerate(active.tolist()):
            now, at = now[:k], at[:k]
            own = states[rows[i] : rows[i] + k]
            a.table.take(now + classes.take(at), out=own, mode="clip")
            now = own
            hit[:k] |= a.reports.take(now)
            at += 1
        for lane in np.flatnonzero(hit):
            found += _lane_matches(a, data, int(starts[lane]), states[rows[: lengths[lane]] + lane])
    return sorted(found)


def _walk(a: Automaton, classes: np.ndarray) -> np.ndarray:
    table, state, out = a.table.tolist(), 0, np.empty(len(classes), np.int32)
    for i, c in enumerate(classes.tolist()):
        state = table[state + c]
        out[i] = state
    return out


def _lane_matches(a: Automaton, data: bytes, base: int, states: np.ndarray) -> list[tuple[int, int, int]]:
    """The matches of one lane, from the states that it went through."""
    marks = a.marks.take(states)
    after = np.append(marks[1:], 0)
    found = []
    for i in np.flatnonzero(marks & ~after & 0xFFFF).tolist():
        for k, rule in enumerate(a.rules):
            if (marks[i] & ~after[i]) >> k & 1:
                held = marks[: i + 1] >> (16 + k) & 1
                free = np.flatnonzero(held == 0)
                begin = int(free[-1]) + 1 if len(free) else 0  # first committed byte of this match
                before = np.flatnonzero(held[:begin])
                low = int(before[-1]) + 1 if len(before) else 0
                start, end = a.backwards[k].start(data, base + low, base + i + 1), base + i + 1
                if end - start >= rule.least:
                    found.append((k, start, end))
    return found
