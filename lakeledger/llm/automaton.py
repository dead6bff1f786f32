"""Regular expressions as transition arrays: parsed, made deterministic and minimal.

Understood are literals, classes, groups with ``|``, ``(?i:...)``, ``?``, ``*``, ``+``, ``{n}``,
``{n,}``, ``{n,m}`` and ``\\xNN`` or escaped signs, over ASCII bytes.  Several expressions become
one automaton whose states name all expressions that end there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Nfa:
    """Byte edges and empty edges of each state, and the rule that ends in a state."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    jumps: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def new(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for to in self.jumps[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)


class Parser:
    """One expression as a tree: a byte set, or (kind, parts): "all", "any", or a repeat with its bounds."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at, self.either_case = pattern, 0, False

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or (expected and c != expected):
            raise ValueError(f"{expected or 'a character'} expected at {self.at} of {self.pattern!r}")
        self.at += 1
        return c

    def tree(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("all", parts)

    def atom(self):
        c = self.take()
        if c == "(":
            was = self.either_case
            if self.peek() == "?":
                self.take()
                if self.peek() == "i":
                    self.take()
                    self.either_case = True
                self.take(":")
            inside = self.tree()
            self.take(")")
            self.either_case = was
            return inside
        if c == "[":
            chars: set[int] = set()
            while self.peek() != "]":
                low = high = self.char(self.take())
                if self.peek() == "-" and self.pattern[self.at + 1] != "]":
                    self.take()
                    high = self.char(self.take())
                chars |= set(range(low, high + 1))
            self.take()
            return self.cased(chars)
        return self.cased({self.char(c)})

    def char(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        return int(self.take() + self.take(), 16) if c == "x" else ord(c)

    def cased(self, chars: set[int]) -> frozenset[int]:
        return frozenset(ord(x) for b in chars for x in (chr(b).lower(), chr(b).upper())) if self.either_case else frozenset(chars)

    def repeated(self, inside):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                bounds = ""
                while self.peek() != "}":
                    bounds += self.take()
                self.take()
                low, comma, high = bounds.partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            inside = ("repeat", (inside, least, most))
        return inside


def _build(nfa: Nfa, tree, at: int, backwards: bool) -> int:
    """Adds ``tree`` after state ``at``; the state where it ends."""
    if isinstance(tree, frozenset):
        to = nfa.new()
        nfa.moves[at].append((tree, to))
        return to
    kind, parts = tree
    if kind == "all":
        for part in reversed(parts) if backwards else parts:
            at = _build(nfa, part, at, backwards)
        return at
    if kind == "any":
        to = nfa.new()
        for part in parts:
            first = nfa.new()
            nfa.jumps[at].append(first)
            nfa.jumps[_build(nfa, part, first, backwards)].append(to)
        return to
    inside, least, most = parts
    for _ in range(least):
        at = _build(nfa, inside, at, backwards)
    end = nfa.new()
    if most is None:
        loop = nfa.new()
        nfa.jumps[at].append(loop)
        nfa.jumps[loop].append(end)
        nfa.jumps[_build(nfa, inside, loop, backwards)].append(loop)
        return end
    nfa.jumps[at].append(end)
    for _ in range(most - least):
        at = _build(nfa, inside, at, backwards)
        nfa.jumps[at].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """``table[state * n_classes + class_of[byte]]`` is the next state, 0 the start; bit r of ``ends[state]`` says rule r ends there."""

    table: np.ndarray
    class_of: np.ndarray
    ends: np.ndarray
    dead: int  # the state that nothing leads out of, -1 if there is none

    @property
    def n_classes(self) -> int:
        return int(self.class_of.max()) + 1

    @property
    def n_states(self) -> int:
        return len(self.ends)


def compile_rules(patterns: list[str], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """One automaton for all ``patterns``; ``anywhere`` finds them at any place, ``backwards`` reads from their end to their start."""
    nfa = Nfa()
    nfa.new()
    for rule, pattern in enumerate(patterns):
        parser = Parser(pattern)
        tree = parser.tree()
        if parser.peek():
            raise ValueError(f"unbalanced ) at {parser.at} of {pattern!r}")
        first = nfa.new()
        nfa.jumps[0].append(first)
        nfa.ends[_build(nfa, tree, first, backwards)] = rule

    # bytes that no rule tells apart share a class
    sets = list({chars: None for edges in nfa.moves for chars, _ in edges})
    signature: dict[tuple[bool, ...], int] = {}
    class_of = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)])
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(signature))]

    # subset construction
    start = nfa.closure({0})
    number: dict[frozenset[int], int] = {start: 0}
    todo = [start]
    rows = []
    for state in todo:
        row = []
        for byte in sample:
            reached = {t for s in state for chars, t in nfa.moves[s] if byte in chars}
            to = nfa.closure(reached | {0} if anywhere else reached)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    ends = np.array([sum(1 << r for s, r in nfa.ends.items() if s in state) for state in todo])

    # partition refinement: states stay together while they end the same rules and lead to the same blocks
    block = np.unique(ends, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}
    names = np.array([order[b] for b in block.tolist()])
    small, small_ends = np.zeros((len(order), len(sample)), np.int64), np.zeros(len(order), np.int64)
    small[names], small_ends[names] = names[table], ends
    stuck = np.flatnonzero((small == np.arange(len(order))[:, None]).all(axis=1) & (small_ends == 0))
    return Automaton(np.ascontiguousarray(small.reshape(-1).astype(np.int32)), class_of.astype(np.uint8), small_ends, int(stuck[0]) if len(stuck) else -1)
