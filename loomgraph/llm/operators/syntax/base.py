"""What the recursive-descent parsers share: tokens, errors, panic-mode recovery, precedence climbing.

A token is a kind: the text itself for signs and keywords, ``id``, ``num``,
``str`` and the like for the rest. ``nl`` tells whether a line ends before it.
Statements are parsed one by one; an error ends the statement, is stored with
its line, and parsing goes on behind the next statement end or block (panic
mode), so that all errors of a text come out. The first is the cause.
"""

from __future__ import annotations

import bisect
import re

OPEN = {"(": ")", "[": "]", "{": "}"}
SHUT = frozenset(OPEN.values())


class Broken(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.message, self.at = message, at


class End(Broken):
    """The text ends within something; no recovery."""


class Parser:
    #: kinds at which a statement may begin, to stop skipping before them at a line's start
    STARTS: frozenset[str] = frozenset()

    def __init__(self, code: str, shift: int = 0):
        self.code, self.k, self.p, self.nl = code, [], [], []
        self.errors: list[tuple[int, str]] = []
        self.ends: list[int] | None = None
        self.i = 0
        self.shift = shift
        self.lex()
        self.k += ["eof"] * 4
        self.p += [len(code)] * 4
        self.nl += [True] * 4

    # -- tokens
    def lex(self) -> None:
        raise NotImplementedError

    def fail(self, message: str | None = None):
        k = self.k[self.i]
        if k == "eof":
            raise End(message or "the text ends too early", self.i)
        raise Broken(message or f"unexpected {self.k[self.i]}", self.i)

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind} instead of {self.k[self.i]}")
        self.i += 1

    def eat(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def touching(self) -> bool:
        """The next token stands right behind the present one (both one character)."""
        return self.p[self.i + 1] == self.p[self.i] + 1

    # -- errors
    def line(self, at: int) -> int:
        if self.ends is None:  # counted once, as a text may have very many errors
            self.ends = [m.start() for m in re.finditer("\n", self.code)]
        pos = self.p[min(at, len(self.p) - 1)]
        return bisect.bisect_left(self.ends, pos) + 1 + self.shift

    def note(self, e: Broken) -> None:
        self.errors.append((self.line(e.at), e.message))

    def items(self, parse, end: str) -> None:
        """Statements or members up to ``end``, which is taken; errors are noted and skipped."""
        k = self.k
        while True:
            kind = k[self.i]
            if kind == end:
                self.i += 1
                return
            if kind == "eof":
                self.fail(f"expected {end} before the end")
            at = self.i
            try:
                parse()
                if self.i == at:
                    self.fail()
            except End:
                raise
            except Broken as e:
                self.note(e)
                self.skip(at)

    def skip(self, at: int) -> None:
        """Panic mode: go on behind the next ; or matched block, or before a closing brace or a statement's first word."""
        self.i = max(self.i, at + 1)
        depth = 0
        k = self.k
        while k[self.i] != "eof":
            kind = k[self.i]
            if kind == "{":
                depth += 1
            elif kind == "}":
                if not depth:
                    return
                depth -= 1
                if not depth:
                    self.i += 1
                    return
            elif not depth and (kind == ";" or self.nl[self.i] and kind in self.STARTS):
                self.i += kind == ";"
                return
            self.i += 1

    def attempt(self, parse) -> bool:
        """Parse or leave everything as it was."""
        at = self.i
        try:
            parse()
            return True
        except Broken:
            self.i = at
            return False

    def run(self) -> list[tuple[int, str]]:
        """All errors of the text as (line, message) in order of detection; none for a text that parses."""
        try:
            self.text()
        except Broken as e:
            self.errors.append((self.line(e.at), e.message))
        except RecursionError:
            self.errors.append((self.line(self.i), "nested too deeply"))
        return self.errors

    def text(self) -> None:
        raise NotImplementedError

    def listed(self, parse, end: str, sep: str = ",") -> None:
        """``parse`` separated by commas up to ``end``, which is taken; a comma before the end is allowed."""
        while not self.eat(end):
            parse()
            if not self.eat(sep):
                self.need(end)
                return

    # -- operators
    LEVELS: dict[str, int] = {}
    RIGHT: frozenset[str] = frozenset()

    def operator(self) -> tuple[str, int]:
        """The binary operator here and its number of tokens."""
        return self.k[self.i], 1

    def unary(self) -> str:
        raise NotImplementedError

    def operand(self, op: str, level: int) -> None:
        self.binary(level if op in self.RIGHT else level + 1)

    def binary(self, least: int = 0) -> str:
        """Precedence climbing over ``LEVELS``."""
        left = self.unary()
        levels = self.LEVELS
        while True:
            op, n = self.operator()
            level = levels.get(op)
            if level is None or level < least:
                return left
            self.i += n
            self.operand(op, level)
            left = "binary"


def scan(parser: Parser, pattern: re.Pattern, gap: re.Pattern, words: frozenset[str], special=None, fold: bool = False) -> None:
    """Fills the tokens by one pattern; ``special(kind, match)`` may take over and return where to go on."""
    code, k, p, nl = parser.code, parser.k, parser.p, parser.nl
    at, n = 0, len(code)
    match, blank = pattern.match, gap.match
    fresh = False
    while True:
        e = blank(code, at).end()
        if e > at:
            fresh = fresh or "\n" in code[at:e] or "\r" in code[at:e]
            at = e
        if at >= n:
            return
        m = match(code, at)
        if m is None:
            k.append("bad")
            p.append(at)
            nl.append(fresh)
            at += 1
            fresh = False
            continue
        kind = m.lastgroup
        text = m.group()
        start = at
        at = m.end()
        if kind == "op":
            kind = text
        elif kind == "id":
            w = text.lower() if fold else text
            if w in words:
                kind = w
        if special is not None and kind in parser.SPECIAL:
            kind, at = special(kind, m)
            if kind is None:  # a comment
                fresh = fresh or "\n" in code[start:at]
                continue
        k.append(kind)
        p.append(start)
        nl.append(fresh)
        fresh = False


def word_at(parser: Parser, i: int) -> str:
    """The text of an identifier token."""
    m = _WORD.match(parser.code, parser.p[i]) if i < len(parser.p) else None
    return m.group() if m else ""


_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")


class Lines:
    """Line numbers of many positions of one text."""

    def __init__(self, code: str):
        self.ends = [m.start() for m in re.finditer("\n", code)]

    def of(self, pos: int) -> int:
        return bisect.bisect_left(self.ends, pos) + 1
