"""Regular expressions over bytes as one deterministic automaton: positions of all rules, subset construction, minimisation.

Understood are ASCII letters, classes with ranges, \\xHH and escaped signs, groups, |, ?, *, +, {m}, {m,} and {m,n}; matches are never empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TOO_MANY = 200_000


@dataclass
class Positions:
    """Places of the expressions, each a set of bytes, as bits of one integer: where a match of a rule begins and ends, and what follows what."""

    admits: list[int] = field(default_factory=lambda: [0] * 256)  # per byte the places that admit it
    follow: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # per rule
    last: list[int] = field(default_factory=list)

    def add(self, pattern: str, fold: bool = False) -> None:
        """One more rule; fold: its letters count in either case."""
        nullable, first, last = Reader(self, pattern, fold).read()
        if nullable:
            raise ValueError(f"{pattern!r} has an empty match")
        self.first.append(first)
        self.last.append(last)

    def turned(self) -> Positions:
        """The rules read from right to left."""
        back = [0] * len(self.follow)
        for p, after in enumerate(self.follow):
            for q in places(after):
                back[q] |= 1 << p
        return Positions(self.admits, back, self.last, self.first)


def places(bits: int) -> list[int]:
    found = []
    while bits:
        low = bits & -bits
        found.append(low.bit_length() - 1)
        bits ^= low
    return found


class Reader:
    """Reads an expression by recursive descent; each part is (can be empty, places it begins with, places it ends with)."""

    def __init__(self, into: Positions, pattern: str, fold: bool):
        self.into, self.pattern, self.fold, self.at = into, pattern, fold, 0

    def read(self) -> tuple[bool, int, int]:
        part = self.choice()
        if self.at < len(self.pattern):
            raise ValueError(f"unexpected {self.pattern[self.at]!r} at {self.at} of {self.pattern!r}")
        return part

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def choice(self) -> tuple[bool, int, int]:
        part = self.sequence()
        while self.peek() == "|":
            self.take()
            more = self.sequence()
            part = part[0] or more[0], part[1] | more[1], part[2] | more[2]
        return part

    def joined(self, a: tuple[bool, int, int], b: tuple[bool, int, int]) -> tuple[bool, int, int]:
        for p in places(a[2]):
            self.into.follow[p] |= b[1]
        return a[0] and b[0], a[1] | (b[1] if a[0] else 0), b[2] | (a[2] if b[0] else 0)

    def sequence(self) -> tuple[bool, int, int]:
        part = True, 0, 0
        while self.peek() and self.peek() not in "|)":
            part = self.joined(part, self.repeated())
        return part

    def repeated(self) -> tuple[bool, int, int]:
        begin = self.at
        part = self.atom()
        end = self.at
        if not self.peek() or self.peek() not in "?*+{":
            return part
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(self.peek(), (0, 0))
        if self.take() == "{":
            bounds = self.pattern[self.at : self.pattern.index("}", self.at)]
            self.at += len(bounds) + 1
            a, comma, b = bounds.partition(",")
            low, high = int(a), (int(b) if b else None) if comma else int(a)
        after = self.at

        def again() -> tuple[bool, int, int]:
            self.at = begin
            copy = self.atom()
            if self.at != end:
                raise ValueError(f"unreadable repetition in {self.pattern!r}")
            return copy

        copies = [part] + [again() for _ in range((max(low, 1) if high is None else high) - 1)]
        if high is None:
            self.joined(copies[-1], copies[-1])
        whole = True, 0, 0
        for k, copy in enumerate(copies):
            whole = self.joined(whole, copy if k < low else (True, *copy[1:]))
        self.at = after
        return whole

    def atom(self) -> tuple[bool, int, int]:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                if self.pattern[self.at : self.at + 2] != "?:":
                    raise ValueError(f"groups in {self.pattern!r} can't have flags")
                self.at += 2
            part = self.choice()
            if not self.peek() or self.take() != ")":
                raise ValueError(f"open group in {self.pattern!r}")
            return part
        if c == "[":
            return self.place(self.members())
        if c in ".^$*+?{}])":
            raise ValueError(f"{c!r} isn't understood in {self.pattern!r}")
        return self.place({self.escaped() if c == "\\" else self.byte(c)})

    def byte(self, c: str) -> int:
        if not c.isascii():
            raise ValueError(f"{c!r} in {self.pattern!r} isn't ASCII")
        return ord(c)

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"\\{c} isn't understood in {self.pattern!r}")
        return self.byte(c)

    def members(self) -> set[int]:
        found: set[int] = set()
        if self.peek() == "^":
            raise ValueError(f"negated class in {self.pattern!r}")
        while (c := self.take()) != "]":
            low = high = self.escaped() if c == "\\" else self.byte(c)
            if self.peek() == "-" and self.pattern[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else self.byte(c)
            found |= set(range(low, high + 1))
        return found

    def place(self, members: set[int]) -> tuple[bool, int, int]:
        if self.fold:
            members = members | {x ^ 0x20 for x in members if chr(x).isalpha() and x < 128}
        bit = 1 << len(self.into.follow)
        self.into.follow.append(0)
        for x in members:
            self.into.admits[x] |= bit
        return False, bit, bit


@dataclass
class Automaton:
    """kinds: per byte its class; step: per state and class the next state; accepts: per state the rules (bits) that have a match there.
    States are numbered from the start state, 0."""

    kinds: bytes
    step: np.ndarray
    accepts: list[int]

    def linked(self) -> tuple[list, int]:
        """The start row and the place of its rules: a row holds, per class, the next row, and at last its rules; a step is one look-up."""
        width = self.step.shape[1]
        rows: list[list] = [[None] * width + [a] for a in self.accepts]
        for row, to in zip(rows, self.step.tolist(), strict=True):
            row[:width] = [rows[t] for t in to]
        return rows[0], width


def automaton(rules: Positions, anywhere: bool) -> Automaton:
    """The minimal automaton of all rules together. anywhere: a match may begin at any byte; else only at the first, and a state
    that nothing can follow steps to itself."""
    signs = sorted(set(rules.admits))
    kinds = bytes(signs.index(a) for a in rules.admits)
    begin = 0
    for f in rules.first:
        begin |= f
    states, step, at = {-1: 0}, [], 0
    order = [-1]
    while at < len(order):
        bits = order[at]
        at += 1
        can = begin if bits == -1 or anywhere else 0
        for p in places(bits) if bits != -1 else ():
            can |= rules.follow[p]
        row = []
        for sign in signs:
            to = can & sign
            if to not in states:
                states[to] = len(order)
                order.append(to)
                if len(order) > TOO_MANY:
                    raise ValueError("the rules need too many states together")
            row.append(states[to])
        step.append(row)
    accepts = [sum(1 << r for r, last in enumerate(rules.last) if bits != -1 and bits & last) for bits in order]
    return minimal(kinds, np.array(step, dtype=np.int32), accepts)


def minimal(kinds: bytes, step: np.ndarray, accepts: list[int]) -> Automaton:
    """States that no text tells apart become one: classes begin with the rules accepted and are split by where their steps lead."""
    _, block = np.unique(np.array(accepts, dtype=np.int64), return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(first) == block.max() + 1:
            break
        block = finer
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(len(first))  # numbered as met, the start state first
    block, one = rank[finer], np.sort(first)
    return Automaton(kinds, block[step[one]].astype(np.int32), [accepts[i] for i in one.tolist()])
