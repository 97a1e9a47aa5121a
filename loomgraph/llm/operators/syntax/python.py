"""Python 3.13."""

from __future__ import annotations

import re
import unicodedata

from .base import Broken, Parser, word_at

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n|\\\r)|(?P<cmt>\#[^\n\r]*)|(?P<nl>\r\n|\n|\r)"""
    r"""|(?P<num>0[xX](?:_?[\da-fA-F])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|0[bB](?:_?[01])+(?!\w)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"""
    r"""|(?P<str>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''|\"\"\"|'|\"))|(?P<fstr>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))|(?P<id>[^\W\d]\w*)"""
    r"""|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=|[-+*/%=<>.,;:(){}\[\]&|^~@])"""
)
_DOUBLE, _SINGLE = re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'), re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
_LONG_DOUBLE, _LONG_SINGLE = re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'), re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''")
_ENDS = {'"': _DOUBLE, "'": _SINGLE, '"""': _LONG_DOUBLE, "'''": _LONG_SINGLE}
_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_PLACE = frozenset(["name", "member", "index"])
_SHUT = {")": "(", "]": "[", "}": "{"}
_ATOM_STARTS = frozenset("id num str fstr ( [ { None True False ... lambda not - + ~ await *".split())


class Python(Parser):
    STARTS = frozenset("if for while try return raise with def class import from pass".split())
    LEVELS = {"|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}

    def __init__(self, code: str, shift: int = 0, part: bool = False):
        self.part = part
        super().__init__(code, shift)

    # -- tokens
    def lex(self):
        """Tokens with ``newline``, ``indent`` and ``dedent``; what is wrong with a text, bracket or indentation becomes ``bad``."""
        code, k, p, nl = self.code, self.k, self.p, self.nl
        self.why: dict[int, str] = {}
        at, n = 0, len(code)
        brackets: list[str] = []
        levels = [(0, 0)]
        fresh = not self.part  # at the beginning of a logical line
        match = _TOKEN.match

        def add(kind: str, pos: int, why: str = "") -> None:
            if why:
                self.why[len(k)] = why
            k.append(kind)
            p.append(pos)
            nl.append(False)

        while at < n:
            if fresh:
                start = at
                wide = tabs = 0
                while at < n and code[at] in " \t\f":
                    c = code[at]
                    if c == " ":
                        wide, tabs = wide + 1, tabs + 1
                    elif c == "\t":
                        wide, tabs = (wide // 8 + 1) * 8, tabs + 1
                    else:
                        wide = tabs = 0
                    at += 1
                if at >= n:
                    break
                if code[at] in "#\n\r":
                    m = match(code, at)
                    at = m.end()
                    continue
                if code[at] == "\\" and match(code, at):
                    at = match(code, at).end()
                    continue
                fresh = False
                if wide > levels[-1][0]:
                    if tabs <= levels[-1][1]:
                        add("bad", at, "tabs and spaces mixed")
                    levels.append((wide, tabs))
                    add("indent", at)
                else:
                    while wide < levels[-1][0]:
                        levels.pop()
                        add("dedent", start)
                    if wide != levels[-1][0]:
                        add("bad", at, "an indentation that no block has")
                        levels.append((wide, tabs))
                        add("indent", at)
                    elif tabs != levels[-1][1]:
                        add("bad", at, "tabs and spaces mixed")
            m = match(code, at)
            if m is None:
                add("bad", at, f"invalid character {code[at]!r}")
                at += 1
                continue
            kind, start, at = m.lastgroup, at, m.end()
            if kind in ("ws", "cmt"):
                continue
            if kind == "nl":
                if not brackets and not self.part:
                    if k and k[-1] not in ("newline", "indent", "dedent") or not k:
                        add("newline", start)
                    fresh = True
                continue
            text = m.group()
            if kind == "op":
                if text in "([{":
                    brackets.append(text)
                elif text in ")]}":
                    if not brackets or brackets[-1] != _SHUT[text]:
                        add("bad", start, f"{text} closes nothing")
                        continue
                    brackets.pop()
                add(text, start)
            elif kind == "id":
                if text in _WORDS:
                    add(text, start)
                elif not text.isascii() and not unicodedata.normalize("NFKC", text).isidentifier():
                    add("bad", start, "invalid identifier")
                else:
                    add("id", start)
            elif kind == "num":
                rest = re.compile(r"\w+").match(code, at)
                word = rest.group() if rest else ""
                if word and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", word) or re.fullmatch(r"0[\d_]*[1-9][\d_]*", text) or re.match(r"0[xXoObB]$", text + word[:1]):
                    add("bad", start, "invalid number")
                    at += len(word)
                else:
                    add("num", start)
            elif kind == "str":
                q = text.lstrip("rRbBuU")
                e = _ENDS[q].match(code, at)
                if not e:
                    add("bad", start, "a string that does not end")
                    stop = code.find("\n", at)
                    at = n if len(q) == 3 or stop < 0 else stop
                else:
                    at = e.end()
                    if "b" in text.lower() and not code[start:at].isascii():
                        add("bad", start, "bytes can hold ASCII only")
                    elif "\\" in code[start:at] and "r" not in text.lower() and self.escapes(code[start:at], "b" in text.lower()):
                        add("bad", start, "invalid escape")
                    else:
                        add("str", start)
            else:
                end, why = self.formatted(at, text)
                if why:
                    add("bad", start, why)
                    stop = code.find("\n", at)
                    at = end if end > 0 else n if stop < 0 else stop
                else:
                    add("fstr", start)
                    at = end
        if brackets:
            add("bad", n, f"{brackets[-1]} is never closed")
        if not self.part:
            if k and k[-1] not in ("newline", "dedent"):
                add("newline", n)
            for _ in levels[1:]:
                add("dedent", n)

    def escapes(self, s: str, is_bytes: bool) -> bool:
        s = s.replace("\\\\", "")
        if re.search(r"\\x(?![\da-fA-F]{2})", s):
            return True
        return not is_bytes and bool(re.search(r"\\u(?![\da-fA-F]{4})|\\U(?!00(?:0[\da-fA-F]|10)[\da-fA-F]{4})|\\N(?!\{[^}\n]+\})", s))

    def formatted(self, at: int, head: str) -> tuple[int, str]:
        """End of an f-string whose text begins at ``at``, and what is wrong with it."""
        quote = head.lstrip("rRfF")
        raw = "r" in head.lower()
        return self.fields(at, quote, raw, False)

    def fields(self, at: int, quote: str, raw: bool, spec: bool) -> tuple[int, str]:
        code, n = self.code, len(self.code)
        long = len(quote) == 3
        while at < n:
            c = code[at]
            if code.startswith(quote, at):
                return (at, "") if spec else (at + len(quote), "")
            if c in "\n\r" and not long:
                return -1, "a string that does not end"
            if c == "\\" and not raw and code[at + 1 : at + 2] not in ("{", "}"):
                at += 2
            elif c == "\\":
                at += 1 if code[at + 1 : at + 2] in ("{", "}") else 2
            elif c == "{":
                if code.startswith("{{", at) and not spec:
                    at += 2
                    continue
                at, why = self.field(at + 1, quote, raw)
                if why:
                    return at, why
            elif c == "}":
                if spec:
                    return at, ""
                if not code.startswith("}}", at):
                    return -1, "a single } in an f-string"
                at += 2
            else:
                at += 1
        return -1, "a string that does not end"

    def field(self, at: int, quote: str, raw: bool) -> tuple[int, str]:
        """Behind the opening brace: the expression, an = or conversion, a format; up to behind the closing brace."""
        code, n = self.code, len(self.code)
        start, depth = at, []
        while at < n:
            c = code[at]
            if depth and c == depth[-1]:
                depth.pop()
            elif c in "([{":
                depth.append({"(": ")", "[": "]", "{": "}"}[c])
            elif c in ")]":
                return -1, f"{c} closes nothing in an f-string"
            elif c in "'\"" or c in "rRbBfFuU" and re.compile(r"(?:[rR][bBfF]?|[bB][rR]?|[fF][rR]?|[uU])['\"]").match(code, at) and not (code[at - 1].isalnum() or code[at - 1] == "_"):
                m = re.compile(r"([rRbBfFuU]*)('''|\"\"\"|'|\")").match(code, at)
                if "f" in m.group(1).lower():
                    at, why = self.fields(m.end(), m.group(2), "r" in m.group(1).lower(), False)
                    if why:
                        return at, why
                    continue
                e = _ENDS[m.group(2)].match(code, m.end())
                if not e:
                    return -1, "a string that does not end"
                at = e.end()
                continue
            elif c == "#":
                return -1, "a comment in an f-string"
            elif not depth and (c == "}" or c == ":" or c == "!" and code[at + 1 : at + 2] != "=" or c == "=" and code[at + 1 : at + 2] != "=" and code[at - 1] not in "=!<>:"):
                break
            at += 1
        if at >= n:
            return -1, "an f-string field that does not end"
        text = code[start:at]
        sub = Python(text, part=True)
        try:
            sub.star_expressions(True)
            if sub.k[sub.i] != "eof":
                sub.fail()
        except Broken as e:
            return -1, "in an f-string: " + e.message
        if code[at] == "=":
            at += 1
            while at < n and code[at] in " \t":
                at += 1
        if code[at : at + 1] == "!":
            m = re.compile(r"!\s*[rsa]\s*").match(code, at)
            if not m:
                return -1, "an invalid conversion in an f-string"
            at = m.end()
        if code[at : at + 1] == ":":
            at, why = self.fields(at + 1, quote, raw, True)
            if why:
                return at, why
        if code[at : at + 1] != "}":
            return -1, "expected } in an f-string"
        return at + 1, ""

    def fail(self, message=None):
        if self.k[self.i] == "bad" and self.i in self.why:
            raise Broken(self.why[self.i], self.i)
        super().fail(message)

    def soft(self, w: str) -> bool:
        return self.k[self.i] == "id" and word_at(self, self.i) == w

    # -- statements
    def text(self):
        self.items(self.statement, "eof")

    def skip(self, at: int) -> None:
        """Panic mode: to the end of the logical line and behind the block that belongs to it."""
        self.i = max(self.i, at + 1)
        k = self.k
        while k[self.i] not in ("newline", "eof", "dedent", "indent"):
            self.i += 1
        if k[self.i] == "newline":
            self.i += 1
        depth = 0
        while k[self.i] in ("indent",) or depth:
            if k[self.i] == "eof":
                return
            depth += (k[self.i] == "indent") - (k[self.i] == "dedent")
            self.i += 1

    def statement(self):
        k = self.k[self.i]
        if k == "indent":
            self.fail("an indentation for no reason")
        compound = self.COMPOUND.get(k)
        if compound:
            compound(self)
            return
        if k == "id":
            w = word_at(self, self.i)
            if w == "match" and self.match_statement():
                return
            if w == "type" and self.k[self.i + 1] == "id":
                at = self.i
                self.i += 2
                if self.k[self.i] in ("=", "["):
                    self.type_parameters()
                    self.need("=")
                    self.expression()
                    self.line_end()
                    return
                self.i = at
        self.simple_line()

    def simple_line(self):
        while True:
            self.simple()
            if not self.eat(";"):
                break
            if self.k[self.i] == "newline":
                break
        self.need("newline")

    def line_end(self):
        if self.eat(";"):
            if self.k[self.i] != "newline":
                self.simple_line()
                return
        self.need("newline")

    def block(self):
        self.need(":")
        if self.k[self.i] != "newline":
            self.simple_line()
            return
        self.i += 1
        if self.k[self.i] != "indent":
            if self.k[self.i] == "bad":
                self.fail()
            raise Broken("expected an indented block", self.i)
        self.i += 1
        self.items(self.statement, "dedent")

    def simple(self):
        k = self.k[self.i]
        f = self.SIMPLE.get(k)
        if f:
            f(self)
            return
        left = self.star_expressions()
        k = self.k[self.i]
        if k == "=":
            while True:
                self.assignable(left)
                self.i += 1
                left = self.yielded()
                if self.k[self.i] != "=":
                    return
        elif k in _AUGMENTED:
            if left not in _PLACE:
                self.fail("this can't be assigned to")
            self.i += 1
            self.yielded()
        elif k == ":":
            if left not in _PLACE and left != "paren-name":
                self.fail("this can't be annotated")
            self.i += 1
            self.expression()
            if self.eat("="):
                self.yielded()

    def assignable(self, left: str):
        if left not in _PLACE and left not in ("targets", "paren-name", "starred-targets"):
            self.fail("this can't be assigned to")

    def yielded(self) -> str:
        if self.k[self.i] == "yield":
            return self.yield_()
        return self.star_expressions()

    def yield_(self) -> str:
        self.i += 1
        if self.eat("from"):
            self.expression()
        elif self.k[self.i] in _ATOM_STARTS:
            self.star_expressions()
        return "yield"

    def s_word(self):
        self.i += 1

    def s_return(self):
        self.i += 1
        if self.k[self.i] not in ("newline", ";"):
            self.star_expressions()

    def s_raise(self):
        self.i += 1
        if self.k[self.i] not in ("newline", ";"):
            self.expression()
            if self.eat("from"):
                self.expression()

    def s_global(self):
        self.i += 1
        self.need("id")
        while self.eat(","):
            self.need("id")

    def s_del(self):
        self.i += 1
        left = self.star_expressions()
        if left not in _PLACE and left not in ("targets", "paren-name"):
            self.fail("this can't be deleted")

    def s_assert(self):
        self.i += 1
        self.expression()
        if self.eat(","):
            self.expression()

    def s_import(self):
        self.i += 1
        while True:
            self.dotted()
            if self.eat("as"):
                self.need("id")
            if not self.eat(","):
                return

    def s_from(self):
        self.i += 1
        dots = 0
        while self.k[self.i] in (".", "..."):
            dots += 1
            self.i += 1
        if not dots or self.k[self.i] != "import":
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return
        paren = self.eat("(")
        while True:
            self.need("id")
            if self.eat("as"):
                self.need("id")
            if not self.eat(",") or paren and self.k[self.i] == ")":
                break
        if paren:
            self.need(")")

    def s_yield(self):
        self.yield_()
        if self.k[self.i] == "=":
            self.fail("this can't be assigned to")

    def dotted(self):
        self.need("id")
        while self.eat("."):
            self.need("id")

    SIMPLE = {"pass": s_word, "break": s_word, "continue": s_word, "return": s_return, "raise": s_raise, "global": s_global, "nonlocal": s_global, "del": s_del, "assert": s_assert, "import": s_import, "from": s_from, "yield": s_yield}

    def c_if(self):
        self.i += 1
        self.named()
        self.block()
        while self.eat("elif"):
            self.named()
            self.block()
        if self.eat("else"):
            self.block()

    def c_while(self):
        self.i += 1
        self.named()
        self.block()
        if self.eat("else"):
            self.block()

    def c_for(self):
        self.i += 1
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        if self.eat("else"):
            self.block()

    def targets(self):
        """Targets of a loop or comprehension: no comparison, so that ``in`` ends them."""
        left = self.target()
        if left not in _PLACE and left not in ("targets", "paren-name"):
            self.fail("this can't be assigned to")
        while self.eat(","):
            if self.k[self.i] == "in":
                return
            left = self.target()
            if left not in _PLACE and left not in ("targets", "paren-name"):
                self.fail("this can't be assigned to")

    def target(self) -> str:
        self.eat("*")
        return self.binary(5)

    def c_try(self):
        self.i += 1
        self.block()
        has = False
        bare = False
        star = None
        while self.k[self.i] == "except":
            if bare:
                self.fail("a bare except must be the last")
            has = True
            self.i += 1
            now = self.eat("*")
            if star is not None and star != now:
                self.fail("except and except* mixed")
            star = now
            if self.k[self.i] != ":":
                self.expression()
                if self.eat("as"):
                    self.need("id")
            else:
                if now:
                    self.fail()
                bare = True
            self.block()
        if has and self.eat("else"):
            self.block()
        if self.eat("finally"):
            has = True
            self.block()
        if not has:
            raise Broken("expected except or finally", self.i)

    def c_with(self):
        self.i += 1
        at = self.i
        if self.k[self.i] == "(":

            def grouped():
                self.i += 1
                while True:
                    self.expression()
                    if self.eat("as"):
                        self.with_target()
                    if not self.eat(",") or self.k[self.i] == ")":
                        break
                self.need(")")
                if self.k[self.i] != ":":
                    self.fail()

            if self.attempt(grouped):
                self.block()
                return
            self.i = at
        while True:
            self.expression()
            if self.eat("as"):
                self.with_target()
            if not self.eat(","):
                break
        self.block()

    def with_target(self):
        left = self.target()
        if left not in _PLACE and left not in ("targets", "paren-name"):
            self.fail("this can't be assigned to")

    def c_def(self):
        self.i += 1
        self.need("id")
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        self.block()

    def parameters(self, end: str, typed: bool):
        default = star = slash = double = False
        names = 0
        while self.k[self.i] != end:
            if double:
                self.fail("a parameter behind **")
            if self.eat("/"):
                if slash or star or not names:
                    self.fail("/ at a wrong place")
                slash = True
            elif self.eat("**"):
                self.need("id")
                double = True
                if typed and self.eat(":"):
                    self.expression()
            elif self.eat("*"):
                if star:
                    self.fail("a second *")
                star = True
                if self.k[self.i] == "id":
                    self.i += 1
                    if typed and self.eat(":"):
                        self.eat("*")
                        self.expression()
                elif self.k[self.i] != "," or self.k[self.i + 1] in (end, "**"):
                    self.fail("names must follow *")
            else:
                self.need("id")
                names += 1
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a parameter without default behind one with")
            if not self.eat(","):
                break
        if self.k[self.i] != end:
            self.fail(f"expected {end} instead of {self.k[self.i]}")

    def type_parameters(self):
        if self.eat("["):
            while True:
                if self.k[self.i] in ("*", "**"):
                    self.i += 1
                self.need("id")
                if self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.eat("*")
                    self.expression()
                if not self.eat(",") or self.k[self.i] == "]":
                    break
            self.need("]")

    def c_class(self):
        self.i += 1
        self.need("id")
        self.type_parameters()
        if self.k[self.i] == "(":
            self.arguments()
        self.block()

    def c_decorated(self):
        while self.eat("@"):
            self.named()
            self.need("newline")
        if self.k[self.i] == "async" and self.k[self.i + 1] == "def":
            self.i += 1
        if self.k[self.i] not in ("def", "class"):
            self.fail("expected a definition")
        self.COMPOUND[self.k[self.i]](self)

    def c_async(self):
        self.i += 1
        if self.k[self.i] not in ("def", "for", "with"):
            self.fail()
        self.COMPOUND[self.k[self.i]](self)

    COMPOUND = {"if": c_if, "while": c_while, "for": c_for, "try": c_try, "with": c_with, "def": c_def, "class": c_class, "@": c_decorated, "async": c_async}

    def match_statement(self) -> bool:
        """``match`` is a statement where a colon, a line end and an indented ``case`` follow the subject."""
        at = self.i
        self.i += 1

        def head():
            self.star_named()
            self.need(":")
            self.need("newline")
            self.need("indent")
            if not self.soft("case"):
                self.fail()

        if self.k[self.i] in _ATOM_STARTS and self.attempt(head):

            def case():
                if not self.soft("case"):
                    self.fail("expected case")
                self.i += 1
                self.patterns()
                if self.eat("if"):
                    self.named()
                self.block()

            self.items(case, "dedent")
            return True
        self.i = at
        return False

    def patterns(self):
        self.star_pattern()
        while self.eat(","):
            if self.k[self.i] in (":", "if"):
                return
            self.star_pattern()

    def star_pattern(self):
        if self.eat("*"):
            self.need("id")
        else:
            self.pattern()

    def pattern(self):
        self.closed_pattern()
        while self.eat("|"):
            self.closed_pattern()
        if self.eat("as"):
            self.need("id")

    def closed_pattern(self):
        k = self.k[self.i]
        if k in ("-", "num"):
            self.eat("-")
            self.need("num")
            if self.k[self.i] in ("+", "-"):
                self.i += 1
                self.need("num")
        elif k in ("str", "fstr"):
            while self.k[self.i] == "str":
                self.i += 1
            if k == "fstr":
                self.fail()
        elif k in ("None", "True", "False"):
            self.i += 1
        elif k == "id":
            self.dotted()
            if self.eat("("):
                while not self.eat(")"):
                    if self.k[self.i] == "id" and self.k[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.eat(","):
                        self.need(")")
                        break
        elif k in ("(", "["):
            self.i += 1
            self.listed(self.star_pattern, ")" if k == "(" else "]")
        elif k == "{":
            self.i += 1

            def pair():
                if self.eat("**"):
                    self.need("id")
                    return
                self.closed_pattern()
                self.need(":")
                self.pattern()

            self.listed(pair, "}")
        else:
            self.fail("expected a pattern")

    # -- expressions
    def star_expressions(self, walrus: bool = False) -> str:
        """Expressions separated by commas, each perhaps with a star; ``targets`` if all could be assigned to."""
        at = self.i
        if self.k[at] == "yield" and walrus:
            return self.yield_()
        first = self.star_expression(walrus)
        if self.k[self.i] != ",":
            if first == "starred":
                self.fail("a star alone")
            return first
        ok = self.assignable_kind(first)
        while self.eat(","):
            if self.k[self.i] not in _ATOM_STARTS:
                break
            ok = self.assignable_kind(self.star_expression(walrus)) and ok
        return "targets" if ok else "tuple"

    def assignable_kind(self, kind: str) -> bool:
        return kind in _PLACE or kind in ("targets", "paren-name", "starred-place")

    def star_expression(self, walrus: bool = False) -> str:
        if self.eat("*"):
            return "starred-place" if self.binary(5) in _PLACE else "starred"
        return self.named() if walrus else self.expression()

    def star_named(self):
        while True:
            self.star_expression(True)
            if not self.eat(",") or self.k[self.i] == ":":
                return

    def named(self) -> str:
        if self.k[self.i] == "id" and self.k[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            return "walrus"
        return self.expression()

    def expression(self) -> str:
        if self.k[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "lambda"
        left = self.disjunction()
        if self.k[self.i] == "if":
            self.i += 1
            self.disjunction()
            self.need("else")
            self.expression()
            return "conditional"
        return left

    def disjunction(self) -> str:
        left = self.conjunction()
        while self.eat("or"):
            self.conjunction()
            left = "or"
        return left

    def conjunction(self) -> str:
        left = self.inversion()
        while self.eat("and"):
            self.inversion()
            left = "and"
        return left

    def inversion(self) -> str:
        if self.eat("not"):
            self.inversion()
            return "not"
        left = self.binary(5)
        while True:
            k = self.k[self.i]
            if k in ("==", "!=", "<", ">", "<=", ">=", "in"):
                self.i += 1
            elif k == "is":
                self.i += 1
                self.eat("not")
            elif k == "not" and self.k[self.i + 1] == "in":
                self.i += 2
            else:
                return left
            self.binary(5)
            left = "comparison"

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("-", "+", "~"):
            self.i += 1
            self.unary()
            return "unary"
        awaited = self.eat("await")
        left = self.trailers(self.atom())
        if awaited:
            left = "await"
        if self.eat("**"):
            self.unary()
            return "power"
        return left

    def atom(self) -> str:
        k = self.k[self.i]
        if k == "id":
            self.i += 1
            return "name"
        if k in ("num", "None", "True", "False", "..."):
            self.i += 1
            return "literal"
        if k in ("str", "fstr"):
            kinds = set()
            while self.k[self.i] in ("str", "fstr"):
                if self.k[self.i] == "str":
                    kinds.add(bool(re.compile(r"[rR]?[bB]").match(self.code, self.p[self.i])))
                else:
                    kinds.add(False)
                self.i += 1
            if len(kinds) > 1:
                self.fail("bytes and text side by side")
            return "literal"
        if k == "(":
            return self.paren()
        if k == "[":
            self.i += 1
            return self.bracket("]")
        if k == "{":
            return self.brace()
        self.fail()

    def paren(self) -> str:
        self.i += 1
        if self.eat(")"):
            return "targets"
        if self.k[self.i] == "yield":
            self.yield_()
            self.need(")")
            return "paren"
        first = self.star_expression(True)
        if self.k[self.i] in ("for", "async"):
            if first.startswith("starred"):
                self.fail()
            self.comprehension()
            self.need(")")
            return "generator"
        if self.k[self.i] == ",":
            ok = self.assignable_kind(first)
            while self.eat(","):
                if self.k[self.i] == ")":
                    break
                ok = self.assignable_kind(self.star_expression(True)) and ok
            self.need(")")
            return "targets" if ok else "tuple"
        if first.startswith("starred"):
            self.fail("a star alone")
        self.need(")")
        return "paren-name" if first == "name" else first if first in _PLACE or first in ("targets", "paren-name") else "paren"

    def bracket(self, end: str) -> str:
        if self.eat(end):
            return "targets"
        first = self.star_expression(True)
        if self.k[self.i] in ("for", "async"):
            self.comprehension()
            self.need(end)
            return "comprehension"
        ok = self.assignable_kind(first)
        while self.eat(","):
            if self.k[self.i] == end:
                break
            ok = self.assignable_kind(self.star_expression(True)) and ok
        self.need(end)
        return "targets" if ok else "list"

    def brace(self) -> str:
        self.i += 1
        if self.eat("}"):
            return "dict"
        if self.k[self.i] == "**":
            self.pairs()
            return "dict"
        self.star_expression(True)
        if self.eat(":"):
            self.expression()
            if self.k[self.i] in ("for", "async"):
                self.comprehension()
                self.need("}")
                return "comprehension"
            if self.eat(","):
                self.pairs()
            else:
                self.need("}")
            return "dict"
        if self.k[self.i] in ("for", "async"):
            self.comprehension()
            self.need("}")
            return "comprehension"
        while self.eat(","):
            if self.k[self.i] == "}":
                break
            self.star_expression(True)
        self.need("}")
        return "set"

    def pairs(self):
        def pair():
            if self.eat("**"):
                self.binary(5)
                return
            self.expression()
            self.need(":")
            self.expression()

        self.listed(pair, "}")

    def comprehension(self):
        while self.k[self.i] in ("for", "async"):
            if self.eat("async") and self.k[self.i] != "for":
                self.fail()
            self.i += 1
            self.targets()
            self.need("in")
            self.disjunction()
            while self.eat("if"):
                if self.k[self.i] == "id" and self.k[self.i + 1] == ":=":
                    self.named()
                else:
                    self.disjunction()

    def trailers(self, left: str) -> str:
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.need("id")
                left = "member"
            elif k == "(":
                self.arguments()
                left = "call"
            elif k == "[":
                self.i += 1
                if self.k[self.i] == "]":
                    self.fail()
                while True:
                    self.slice()
                    if not self.eat(",") or self.k[self.i] == "]":
                        break
                self.need("]")
                left = "index"
            else:
                return left

    def slice(self):
        if self.eat("*"):
            self.binary(5)
            return
        if self.k[self.i] != ":":
            self.named()
        if self.eat(":"):
            if self.k[self.i] not in (":", ",", "]"):
                self.expression()
            if self.eat(":") and self.k[self.i] not in (",", "]"):
                self.expression()

    def arguments(self):
        self.need("(")
        keyword = double = False
        count = 0
        while not self.eat(")"):
            count += 1
            if self.eat("**"):
                self.expression()
                double = keyword = True
            elif self.eat("*"):
                if double:
                    self.fail("unpacking behind **")
                self.expression()
            elif self.k[self.i] == "id" and self.k[self.i + 1] == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                at = self.i
                self.named()
                if self.k[self.i] in ("for", "async"):
                    if count > 1:
                        raise Broken("a generator needs brackets", at)
                    self.comprehension()
                    if self.k[self.i] != ")":
                        self.fail()
                elif self.k[self.i] == "=":
                    self.fail("a keyword must be a name")
                elif keyword:
                    raise Broken("an argument behind a keyword", at)
            if not self.eat(","):
                self.need(")")
                return
