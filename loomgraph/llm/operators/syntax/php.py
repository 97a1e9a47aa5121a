"""PHP 8. What stands outside the tags is output and always valid."""

from __future__ import annotations

import re

from .base import Broken, Parser, word_at

_GAP = re.compile(r"(?:\s+|//(?:(?!\?>)[^\n\r])*|#(?!\[)(?:(?!\?>)[^\n\r])*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TOKEN = re.compile(
    r"""(?P<dv>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<id>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)"""
    r"""|(?P<num>0[xX][\da-fA-F](?:_?[\da-fA-F])*(?!\w)|0[bB][01](?:_?[01])*(?!\w)|0[oO][0-7](?:_?[0-7])*(?!\w)|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?(?![A-Za-z_])|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?(?![A-Za-z_]))"""
    r"""|(?P<str>'(?:[^'\\]|\\[\s\S])*')|(?P<dq>[bB]?")|(?P<bt>`)|(?P<here><<<[ \t]*(?P<hq>["']?)(?P<hn>[A-Za-z_]\w*)(?P=hq)\r?\n)|(?P<shut>\?>(?:\r?\n)?)"""
    r"""|(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)[ \t]*\))"""
    r"""|(?P<op>\?->|\?\?=|\?\?|<=>|\*\*=|\*\*|\.\.\.|===|!==|<<=|>>=|==|!=|<>|<=|>=|=>|->|::|\+\+|--|&&|\|\||<<|>>|[+\-*/.%&|^]=|\#\[|[-+*/%=<>!.,;:?(){}\[\]&|^~@$\\])""",
    re.I,
)
_OPEN = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I)
_WORDS = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit die extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield eval".split()
)
_NAMEABLE = frozenset(["id"]) | _WORDS
_ASSIGN = frozenset("= += -= *= /= .= %= **= ??= &= |= ^= <<= >>=".split())
_PLACE = frozenset(["dv", "prop", "index", "static"])
_MODIFIER = frozenset("public private protected static abstract final readonly var".split())
_INNER = re.compile(r"\{\$|\$\{|\\[\s\S]|[\s\S]")


class Php(Parser):
    PATH = True
    STARTS = frozenset("if for foreach while do try return throw switch break continue class function public private protected echo namespace use".split())
    LEVELS = {"or": 1, "xor": 2, "and": 3, "??": 6, "||": 7, "&&": 8, "|": 9, "^": 10, "&": 11, "==": 12, "!=": 12, "===": 12, "!==": 12, "<>": 12, "<=>": 12, "<": 13, "<=": 13, ">": 13, ">=": 13, ".": 14, "<<": 15, ">>": 15, "+": 16, "-": 16, "*": 17, "/": 17, "%": 17, "instanceof": 19, "**": 20}
    RIGHT = frozenset(["??", "**"])

    def __init__(self, code: str, path: str = "", shift: int = 0, part: bool = False):
        self.part = part
        super().__init__(code, shift)

    # -- tokens
    def lex(self):
        code, k, p, nl = self.code, self.k, self.p, self.nl
        at, n = 0, len(code)
        inside = self.part
        while at < n:
            if not inside:
                m = _OPEN.search(code, at)
                if not m:
                    if at < n:
                        k.append("html")
                        p.append(at)
                        nl.append(True)
                    return
                if m.start() > at:
                    k.append("html")
                    p.append(at)
                    nl.append(True)
                if m.group().endswith("="):
                    k.append("echo")
                    p.append(m.start())
                    nl.append(True)
                at = m.end()
                inside = True
                continue
            at = _GAP.match(code, at).end()
            if at >= n:
                return
            m = _TOKEN.match(code, at)
            if m is None:
                k.append("bad")
                p.append(at)
                nl.append(False)
                at += 1
                continue
            kind, text, start = m.lastgroup, m.group(), at
            at = m.end()
            if kind == "op":
                kind = text
            elif kind == "id":
                w = text.lower()
                if w in _WORDS:
                    kind = w
            elif kind == "cast":
                kind = "cast"
            elif kind in ("dq", "bt"):
                kind, at = self.quoted(at, '"' if kind == "dq" else "`")
            elif kind in ("here", "hn", "hq"):
                kind, at = self.heredoc(m)
            elif kind == "shut":
                inside = False
                kind = ";"
                if k and k[-1] in (";", "{", "}", ":", "html"):
                    continue
            k.append(kind)
            p.append(start)
            nl.append("\n" in code[p[-2] if len(p) > 1 else 0 : start])

    def quoted(self, at: int, stop: str) -> tuple[str, int]:
        code = self.code
        while at < len(code):
            m = _INNER.match(code, at)
            t = m.group()
            if t == stop:
                return "str", m.end()
            if t == "{$" or t == "${":
                end = self.braces(at + (1 if t == "{$" else 2))
                if end < 0:
                    return "bad", len(code)
                inner = code[at + 1 : end] if t == "{$" else "$" + code[at + 2 : end]
                if Php(inner, part=True).expression_only():
                    return "bad", end + 1
                at = end + 1
                continue
            at = m.end()
        return "bad", len(code)

    def braces(self, at: int) -> int:
        depth, code = 1, self.code
        while at < len(code):
            c = code[at]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return at
            elif c in "'\"":
                e = re.compile(rf"{c}(?:[^{c}\\]|\\[\s\S])*{c}").match(code, at)
                if e:
                    at = e.end()
                    continue
            at += 1
        return -1

    def heredoc(self, m: re.Match) -> tuple[str, int]:
        e = re.compile(rf"^[ \t]*{re.escape(m.group('hn'))}\b", re.M).search(self.code, m.end())
        return ("str", e.end()) if e else ("bad", len(self.code))

    def expression_only(self) -> bool:
        """True if the text is not one expression."""
        try:
            self.expression()
            return self.k[self.i] != "eof"
        except Broken:
            return True

    def soft(self, w: str) -> bool:
        return self.k[self.i] == "id" and word_at(self, self.i).lower() == w

    # -- statements
    def text(self):
        self.items(self.statement, "eof")

    def end(self):
        if self.k[self.i] != "html":
            self.need(";")

    def name(self):
        if self.k[self.i] not in ("id",) and not (self.k[self.i] in _WORDS and self.k[self.i] in ("enum", "namespace")):
            self.fail(f"expected a name instead of {self.k[self.i]}")
        self.i += 1

    def member_name(self):
        if self.k[self.i] not in _NAMEABLE:
            self.fail(f"expected a name instead of {self.k[self.i]}")
        self.i += 1

    def block(self):
        self.need("{")
        self.items(self.statement, "}")

    def body(self, *ends: str):
        """A statement, or with a colon all statements up to one of ``ends``."""
        if self.k[self.i] == ":":
            self.i += 1
            while self.k[self.i] not in ends:
                if self.k[self.i] in ("eof", "}"):
                    self.fail(f"expected {ends[0]}")
                self.statement()
            return True
        self.statement()
        return False

    def condition(self):
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self):
        k = self.k[self.i]
        f = self.SIMPLE.get(k)
        if f:
            f(self)
            return
        n = self.k[self.i + 1]
        if k == "id" and n == ":" and self.k[self.i + 2] != ":":
            self.i += 2
            return
        if k == "#[":
            self.attributes()
            self.statement()
            return
        if k == "function" and (n == "id" or n == "&" and self.k[self.i + 2] == "id" or n in _WORDS and n not in ("use",)):
            self.function()
            return
        if k in ("abstract", "final", "class") or k == "readonly" and n in ("class", "final", "abstract"):
            while self.k[self.i] in ("abstract", "final", "readonly"):
                self.i += 1
            self.class_()
            return
        if k in ("interface", "trait"):
            self.i += 1
            self.name()
            if self.eat("extends"):
                self.names()
            self.members()
            return
        if k == "id" and n == "id" and word_at(self, self.i).lower() == "enum":
            self.i += 2
            if self.eat(":"):
                self.type()
            if self.eat("implements"):
                self.names()
            self.members()
            return
        if k == "static" and n == "dv":
            self.i += 1
            while True:
                self.need("dv")
                if self.eat("="):
                    self.expression()
                if not self.eat(","):
                    break
            self.end()
            return
        self.expression()
        self.end()

    def s_html(self):
        self.i += 1

    def s_if(self):
        self.i += 1
        self.condition()
        if self.body("elseif", "else", "endif"):
            while self.eat("elseif"):
                self.condition()
                if not self.body("elseif", "else", "endif"):
                    self.fail()
            if self.eat("else"):
                if self.k[self.i] == "if":
                    self.s_if()
                    return
                if not self.body("endif"):
                    self.fail()
            self.need("endif")
            self.end()
            return
        while True:
            if self.eat("elseif"):
                self.condition()
                self.statement()
            elif self.k[self.i] == "else":
                self.i += 1
                self.statement()
                return
            else:
                return

    def s_while(self):
        self.i += 1
        self.condition()
        if self.body("endwhile"):
            self.i += 1
            self.end()

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.end()

    def s_for(self):
        self.i += 1
        self.need("(")
        for stop in (";", ";", ")"):
            if self.k[self.i] != stop:
                self.expression()
                while self.eat(","):
                    self.expression()
            self.need(stop)
        if self.body("endfor"):
            self.i += 1
            self.end()

    def s_foreach(self):
        self.i += 1
        self.need("(")
        self.expression()
        self.need("as")
        for _ in range(2):
            self.eat("&")
            left = self.expression()
            if left not in _PLACE and left not in ("array", "list", "call"):
                self.fail("this can't be assigned to")
            if not self.eat("=>"):
                break
        self.need(")")
        if self.body("endforeach"):
            self.i += 1
            self.end()

    def s_switch(self):
        self.i += 1
        self.condition()
        stop = "}" if self.k[self.i] == "{" else "endswitch"
        if not self.eat("{"):
            self.need(":")
        while not self.eat(stop):
            if self.eat("case"):
                self.expression()
            elif not self.eat("default"):
                self.fail("expected case")
            if not self.eat(":"):
                self.need(";")
            while self.k[self.i] not in ("case", "default", stop):
                if self.k[self.i] == "eof":
                    self.fail()
                self.statement()
        if stop == "endswitch":
            self.end()

    def s_try(self):
        self.i += 1
        self.block()
        has = False
        while self.eat("catch"):
            has = True
            self.need("(")
            self.class_name()
            while self.eat("|"):
                self.class_name()
            self.eat("dv")
            self.need(")")
            self.block()
        if self.eat("finally"):
            has = True
            self.block()
        if not has:
            self.fail("try without catch or finally")

    def s_value(self):
        self.i += 1
        if self.k[self.i] not in (";", "html"):
            self.expression()
        self.end()

    def s_jump(self):
        self.i += 1
        self.eat("num")
        self.end()

    def s_echo(self):
        self.i += 1
        self.expression()
        while self.eat(","):
            self.expression()
        self.end()

    def s_global(self):
        self.i += 1
        self.expression()
        while self.eat(","):
            self.expression()
        self.end()

    def s_namespace(self):
        if self.k[self.i + 1] == "id" and word_at(self, self.i + 1).startswith("\\"):
            self.expression()
            self.end()
            return
        self.i += 1
        self.eat("id")
        if self.k[self.i] == "{":
            self.block()
        else:
            self.end()

    def s_use(self):
        self.i += 1
        if self.k[self.i] in ("function", "const"):
            self.i += 1
        while True:
            self.need("id")
            if self.k[self.i] == "\\" and self.k[self.i + 1] == "{":
                self.i += 2

                def one():
                    if self.k[self.i] in ("function", "const"):
                        self.i += 1
                    self.need("id")
                    if self.eat("as"):
                        self.need("id")

                self.listed(one, "}")
            elif self.eat("as"):
                self.need("id")
            if not self.eat(","):
                break
        self.end()

    def s_const(self):
        self.i += 1
        while True:
            self.member_name()
            self.need("=")
            self.expression()
            if not self.eat(","):
                break
        self.end()

    def s_unset(self):
        self.i += 1
        self.need("(")
        self.listed(self.expression, ")")
        self.end()

    def s_declare(self):
        self.i += 1
        self.need("(")
        while True:
            self.need("id")
            self.need("=")
            self.expression()
            if not self.eat(","):
                break
        self.need(")")
        if self.eat(";"):
            return
        if self.body("enddeclare"):
            self.i += 1
            self.end()

    def s_goto(self):
        self.i += 1
        self.need("id")
        self.end()

    def s_empty(self):
        self.i += 1

    SIMPLE = {"{": block, ";": s_empty, "html": s_html, "if": s_if, "while": s_while, "do": s_do, "for": s_for, "foreach": s_foreach, "switch": s_switch, "try": s_try, "return": s_value, "break": s_jump, "continue": s_jump, "echo": s_echo, "global": s_global, "namespace": s_namespace, "use": s_use, "const": s_const, "unset": s_unset, "declare": s_declare, "goto": s_goto}

    # -- declarations
    def attributes(self):
        while self.eat("#["):
            while True:
                self.class_name()
                if self.k[self.i] == "(":
                    self.arguments()
                if not self.eat(",") or self.k[self.i] == "]":
                    break
            self.need("]")

    def class_name(self):
        if self.k[self.i] in ("id", "static", "namespace", "enum"):
            self.i += 1
        else:
            self.fail("expected a class name")

    def names(self):
        self.class_name()
        while self.eat(","):
            self.class_name()

    def class_(self):
        self.need("class")
        self.name()
        if self.eat("extends"):
            self.class_name()
        if self.eat("implements"):
            self.names()
        self.members()

    def members(self):
        self.need("{")
        self.items(self.member, "}")

    def type(self):
        self.eat("?")
        while True:
            if self.eat("("):
                self.type()
                self.need(")")
            elif self.k[self.i] in ("id", "array", "callable", "static"):
                self.i += 1
            else:
                self.fail("expected a type")
            if self.k[self.i] == "|" or self.k[self.i] == "&" and self.k[self.i + 1] not in ("dv", "...", "&"):
                self.i += 1
                continue
            return

    def member(self):
        self.attributes()
        if self.k[self.i] == "use":
            self.i += 1
            self.names()
            if self.eat("{"):
                while not self.eat("}"):
                    if self.k[self.i] == "eof":
                        self.fail()
                    self.i += 1
            else:
                self.need(";")
            return
        if self.k[self.i] == "case":
            self.i += 1
            self.member_name()
            if self.eat("="):
                self.expression()
            self.need(";")
            return
        any_ = False
        while self.k[self.i] in _MODIFIER:
            any_ = True
            self.i += 1
        if self.k[self.i] == "const":
            self.i += 1
            if self.k[self.i] in _NAMEABLE and self.k[self.i + 1] != "=" or self.k[self.i] == "?":
                self.type()
            while True:
                self.member_name()
                self.need("=")
                self.expression()
                if not self.eat(","):
                    break
            self.need(";")
        elif self.k[self.i] == "function":
            self.i += 1
            self.eat("&")
            self.member_name()
            self.signature()
            if self.k[self.i] == "{":
                self.block()
            else:
                self.need(";")
        elif any_:
            if self.k[self.i] != "dv":
                self.type()
            while True:
                self.need("dv")
                if self.eat("="):
                    self.expression()
                if not self.eat(","):
                    break
            self.need(";")
        else:
            self.fail(f"expected a member instead of {self.k[self.i]}")

    def function(self):
        self.i += 1
        self.eat("&")
        self.member_name()
        self.signature()
        self.block()

    def signature(self):
        self.need("(")
        self.listed(self.parameter, ")")
        if self.eat(":"):
            self.type()

    def parameter(self):
        self.attributes()
        while self.k[self.i] in ("public", "private", "protected", "readonly"):
            self.i += 1
        if self.k[self.i] not in ("dv", "&", "..."):
            self.type()
        self.eat("&")
        self.eat("...")
        self.need("dv")
        if self.eat("="):
            self.expression()

    # -- expressions
    def operand(self, op, level):
        if op == "instanceof":
            if self.k[self.i] in ("id", "static"):
                self.i += 1
            else:
                self.unary()
            return
        self.binary(level if op in self.RIGHT else level + 1)

    def operator(self):
        return self.k[self.i], 1

    def expression(self) -> str:
        left = self.ternary()
        while self.k[self.i] in ("or", "xor", "and"):
            self.i += 1
            self.ternary()
            left = "binary"
        return left

    def ternary(self) -> str:
        left = self.binary(4)
        while self.k[self.i] == "?":
            self.i += 1
            if not self.eat(":"):
                self.ternary()
                self.need(":")
            self.binary(4)
            left = "ternary"
        return left

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("!", "-", "+", "~", "@", "cast", "clone", "print", "include", "include_once", "require", "require_once", "eval"):
            self.i += 1
            if k in ("print", "include", "include_once", "require", "require_once"):
                self.ternary()
            else:
                self.unary()
            return "unary"
        if k == "throw":
            self.i += 1
            self.expression()
            return "throw"
        if k in ("++", "--"):
            self.i += 1
            if self.unary() not in _PLACE:
                self.fail("nothing to step")
            return "step"
        if k == "&":
            self.i += 1
            return self.unary()
        if k == "yield":
            self.i += 1
            if self.soft("from"):
                self.i += 1
                self.ternary()
            elif self.k[self.i] not in (";", ")", "]", ","):
                self.ternary()
                if self.eat("=>"):
                    self.ternary()
            return "yield"
        left = self.postfix(self.primary())
        op = self.k[self.i]
        if op in _ASSIGN:
            if left not in _PLACE and not (op == "=" and left in ("array", "list")):
                self.fail("this can't be assigned to")
            self.i += 1
            self.eat("&")
            self.ternary()
            return "assign"
        if op in ("++", "--"):
            if left not in _PLACE:
                self.fail("nothing to step")
            self.i += 1
            return "step"
        return left

    def primary(self) -> str:
        k = self.k[self.i]
        if k == "dv":
            self.i += 1
            return "dv"
        if k in ("num", "str"):
            self.i += 1
            return "literal"
        if k == "id":
            self.i += 1
            return "name"
        if k == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return "paren"
        if k == "[":
            self.i += 1
            self.array("]")
            return "array"
        if k in ("array", "list") and self.k[self.i + 1] == "(":
            self.i += 2
            self.array(")")
            return k
        if k == "$":
            self.i += 1
            if self.eat("{"):
                self.expression()
                self.need("}")
            else:
                self.primary()
            return "dv"
        if k == "new":
            self.i += 1
            self.attributes()
            n = self.k[self.i]
            if n == "class" or n == "readonly" and self.k[self.i + 1] == "class":
                self.i += 1 + (n == "readonly")
                if self.k[self.i] == "(":
                    self.arguments()
                if self.eat("extends"):
                    self.class_name()
                if self.eat("implements"):
                    self.names()
                self.members()
                return "new"
            if n == "(":
                self.i += 1
                self.expression()
                self.need(")")
            elif n in ("id", "static"):
                self.i += 1
            elif n in ("dv", "$"):
                self.primary()
                while self.k[self.i] in ("->", "?->", "::", "["):
                    if self.eat("["):
                        self.expression()
                        self.need("]")
                        continue
                    self.i += 1
                    if not self.eat("dv"):
                        self.member_name()
            else:
                self.fail("expected a class")
            if self.k[self.i] == "(":
                self.arguments()
            return "new"
        if k == "static" and self.k[self.i + 1] in ("function", "fn"):
            self.i += 1
            k = self.k[self.i]
        if k == "#[":
            self.attributes()
            return self.primary()
        if k == "function":
            self.i += 1
            self.eat("&")
            self.need("(")
            self.listed(self.parameter, ")")
            if self.eat("use"):
                self.need("(")

                def used():
                    self.eat("&")
                    self.need("dv")

                self.listed(used, ")")
            if self.eat(":"):
                self.type()
            self.block()
            return "closure"
        if k == "fn":
            self.i += 1
            self.eat("&")
            self.signature()
            self.need("=>")
            self.ternary()
            return "closure"
        if k == "static":
            self.i += 1
            if self.k[self.i] != "::":
                self.fail()
            return "name"
        if k == "isset":
            self.i += 1
            self.need("(")
            self.listed(self.expression, ")")
            return "call"
        if k == "empty":
            self.i += 1
            self.condition()
            return "call"
        if k in ("exit", "die"):
            self.i += 1
            if self.eat("("):
                if not self.eat(")"):
                    self.expression()
                    self.need(")")
            return "call"
        if k == "match":
            self.i += 1
            self.condition()
            self.need("{")

            def arm():
                if not self.eat("default"):
                    self.expression()
                    while self.eat(","):
                        if self.k[self.i] == "=>":
                            break
                        self.expression()
                self.need("=>")
                self.expression()

            self.listed(arm, "}")
            return "match"
        if k == "namespace":
            self.i += 1
            return "name"
        if k == "enum" or k == "readonly" and self.k[self.i + 1] == "(":
            self.i += 1
            return "name"
        self.fail()

    def array(self, stop: str):
        while not self.eat(stop):
            if self.eat(","):
                continue
            if self.eat("..."):
                self.expression()
            else:
                self.eat("&")
                self.expression()
                if self.eat("=>"):
                    self.eat("&")
                    self.expression()
            if self.k[self.i] != stop:
                self.need(",")

    def arguments(self):
        self.need("(")
        if self.k[self.i] == "..." and self.k[self.i + 1] == ")":
            self.i += 2
            return
        self.listed(self.argument, ")")

    def argument(self):
        if self.k[self.i] in _NAMEABLE and self.k[self.i + 1] == ":":
            self.i += 2
        self.eat("...")
        self.expression()

    def postfix(self, left: str) -> str:
        while True:
            k = self.k[self.i]
            if k in ("->", "?->"):
                self.i += 1
                if self.eat("{"):
                    self.expression()
                    self.need("}")
                elif self.k[self.i] == "$":
                    self.primary()
                elif not self.eat("dv"):
                    self.member_name()
                left = "prop" if k == "->" else "nullsafe"
            elif k == "::":
                self.i += 1
                if self.eat("{"):
                    self.expression()
                    self.need("}")
                    left = "const"
                elif self.k[self.i] in ("dv", "$"):
                    self.primary()
                    left = "static"
                else:
                    self.member_name()
                    left = "const"
            elif k == "(":
                if left in ("literal",) and self.k[self.i - 1] != "str":
                    self.fail()
                self.arguments()
                left = "call"
            elif k == "[":
                self.i += 1
                if not self.eat("]"):
                    self.expression()
                    self.need("]")
                left = "index"
            else:
                return left
