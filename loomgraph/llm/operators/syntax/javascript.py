"""JavaScript modules (JSX allowed) and TypeScript (JSX in .tsx)."""

from __future__ import annotations

import re

from .base import Broken, Parser, scan, word_at

_GAP = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TOKEN = re.compile(
    r"""(?P<id>(?:[^\W\d]|[$]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$‌‍]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)|(?P<priv>\#[^\W\d][\w$]*|\#[$][\w$]*)"""
    r"""|(?P<num>0[xX][\da-fA-F](?:_?[\da-fA-F])*n?(?![\w$])|0[oO][0-7](?:_?[0-7])*n?(?![\w$])|0[bB][01](?:_?[01])*n?(?![\w$])|(?:0|[1-9](?:_?\d)*)n(?![\w$])|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?(?![\w$]))"""
    r"""|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|0(?!\d)|[^xu0-9]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|u\{[\da-fA-F]+\}))*"|'(?:[^'\\\n\r]|\\(?:\r\n|0(?!\d)|[^xu0-9]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|u\{[\da-fA-F]+\}))*')"""
    r"""|(?P<tpl>`)|(?P<slash>/=?)|(?P<less><(?![<=]))"""
    r"""|(?P<op>\.\.\.|=>|===|!==|\*\*=|\?\?=|&&=|\|\|=|==|!=|<<=|<=|<<|\*\*|\?\?|\?\.(?!\d)|\+\+|--|&&|\|\||[+\-*%&|^]=|[-+*%=>!~?:;,.(){}\[\]@&|^])"""
)
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([\w$]*)")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:(?::|\.)[A-Za-z_$][\w$-]*)*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_SPACE = re.compile(r"(?:\s+|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*)*")
_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
#: kinds behind which an operand has ended, so that a slash divides and < compares
_ENDED = frozenset("id num str tpl regex jsx priv ) ] } this super null true false ++ --".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PLACE = frozenset(["name", "member"])
_PATTERN = frozenset(["array", "object"])
_TS_START = frozenset("interface type namespace module declare abstract enum global".split())


class JavaScript(Parser):
    SPECIAL = frozenset(["tpl", "slash", "less", "str"])
    PATH = True
    STARTS = frozenset("if for while do try return throw switch break continue class function const var import export".split())
    LEVELS = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
    RIGHT = frozenset(["**"])

    def __init__(self, code: str, path: str = "", shift: int = 0, ts: bool | None = None, jsx: bool | None = None, state: tuple[bool, bool, bool] = (False, True, False)):
        self.ts = path.endswith((".ts", ".tsx", ".mts", ".cts")) if ts is None else ts
        self.jsx = not path.endswith((".ts", ".mts", ".cts")) if jsx is None else jsx
        self.functions, self.await_, self.yield_ = state
        self.no_in = False
        self.ambient = path.endswith(".d.ts")
        self.nested: list[tuple[int, list[str]]] = []
        self.braces: list[str] = []
        super().__init__(code, shift)

    # -- tokens
    def lex(self):
        if self.code.startswith("#!"):
            end = self.code.find("\n")
            self.code = " " * (end if end >= 0 else len(self.code)) + (self.code[end:] if end >= 0 else "")
        scan(self, _TOKEN, _GAP, _WORDS, self.special)

    def ended(self) -> bool:
        return bool(self.k) and self.k[-1] in _ENDED

    def special(self, kind: str, m: re.Match) -> tuple[str, int]:
        code, at = self.code, m.start()
        if kind == "str":
            return "str", m.end()
        if kind == "tpl":
            return self.template(at)
        if kind == "slash":
            if self.ended() and not (self.k[-1] == "}" and m.group() == "/" and self.line_starts(at)) and not self.heads_paren():
                return m.group(), m.end()
            r = _REGEX.match(code, at)
            if not r:
                return "bad", at + 1
            return ("regex" if not set(r.group(1)) - set("dgimsuvy") and len(set(r.group(1))) == len(r.group(1)) else "bad"), r.end()
        if self.jsx and not (self.ended() and self.k[-1] != "}" or self.k and self.k[-1] == "}" and not self.line_starts(at)) and re.compile(r"<(?:[A-Za-z_$]|\s*>)").match(code, at):
            if not (self.ts and re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b|=)[^<>]*>?\s*").match(code, at) and not re.compile(r"<\s*\w+\s+[\w-]+=").match(code, at) and re.compile(r"<[^<>()]*>\s*\(").match(code, at)):
                end = self.element(at)
                return ("jsx", end) if end > 0 else ("bad", max(at + 1, -end))
        return "<", m.end()

    def line_starts(self, at: int) -> bool:
        return not self.code[self.code.rfind("\n", 0, at) + 1 : at].strip()

    def heads_paren(self) -> bool:
        """The closing bracket before belongs to if, while or for: no operand."""
        if self.k[-1] != ")":
            return False
        depth = 0
        for i in range(len(self.k) - 1, -1, -1):
            if self.k[i] == ")":
                depth += 1
            elif self.k[i] == "(":
                depth -= 1
                if not depth:
                    return i > 0 and self.k[i - 1] in ("if", "while", "for", "with")
        return False

    def close_brace(self, at: int) -> int:
        """End of an expression in braces that opened before ``at``: lexed by a scanner of its own; -1 if it doesn't close."""
        depth, code, n = 1, self.code, len(self.code)
        while at < n:
            c = code[at]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return at
            elif c in "\"'":
                m = _TOKEN.match(code, at)
                if m and m.lastgroup == "str":
                    at = m.end()
                    continue
            elif c == "`":
                kind, at = self.template(at, False)
                if kind == "bad":
                    return -1
                continue
            elif c == "/" and code[at + 1 : at + 2] in ("/", "*"):
                e = _GAP.match(code, at).end()
                if e > at:
                    at = e
                    continue
            elif c == "/" and code[max(0, at - 80) : at].rstrip()[-1:] in "(,=:[!&|?{;+-*%~^" and code[at + 1 : at + 2] != ">":
                r = _REGEX.match(code, at)
                if r:
                    at = r.end()
                    continue
            at += 1
        return -1

    def template(self, at: int, check: bool = True) -> tuple[str, int]:
        code = self.code
        at += 1
        while True:
            at = _TPL.match(code, at).end()
            if code.startswith("`", at):
                return "tpl", at + 1
            if not code.startswith("${", at):
                return "bad", len(code)
            end = self.close_brace(at + 2)
            if end < 0:
                return "bad", len(code)
            if check:
                self.inner(at + 2, end)
            at = end + 1

    def inner(self, lo: int, hi: int, empty: bool = False, spread: bool = False) -> None:
        """Errors of an expression within the text between braces."""
        text = self.code[lo:hi]
        bare = _GAP.fullmatch(text)
        if bare and empty:
            return
        sub = type(self)(text, ts=self.ts, jsx=self.jsx, shift=self.shift + self.code.count("\n", 0, lo), state=(self.functions, True, True))
        try:
            if spread:
                sub.eat("...")
            sub.sequence()
            if sub.k[sub.i] != "eof":
                sub.fail()
        except Broken as e:
            sub.errors.append((sub.line(e.at), e.message))
        self.nested.extend([(lo, x) for x in sub.nested_errors()])

    def nested_errors(self) -> list[tuple[int, str]]:
        return self.errors + [e for _, e in self.nested]

    def run(self):
        super().run()
        self.errors.extend(e for _, e in self.nested)
        return self.errors

    def element(self, at: int) -> int:
        """End of a JSX element or fragment that begins at ``at``; minus the place of an error."""
        code = self.code
        at += 1
        at = _SPACE.match(code, at).end()
        name = ""
        if not code.startswith(">", at):
            m = _JSX_NAME.match(code, at)
            if not m:
                return -at
            name, at = m.group(), m.end()
            if self.ts and code.startswith("<", at):
                d = code.find(">", at)
                if d < 0:
                    return -at
                at = d + 1
            while True:
                at = _SPACE.match(code, at).end()
                if code.startswith("/>", at):
                    return at + 2
                if code.startswith(">", at):
                    break
                if code.startswith("{", at):
                    end = self.close_brace(at + 1)
                    if end < 0:
                        return -len(code)
                    self.inner(at + 1, end, False, True)
                    at = end + 1
                    continue
                m = _JSX_NAME.match(code, at)
                if not m:
                    return -at
                at = _SPACE.match(code, m.end()).end()
                if code.startswith("=", at):
                    at = _SPACE.match(code, at + 1).end()
                    if code.startswith("{", at):
                        end = self.close_brace(at + 1)
                        if end < 0:
                            return -len(code)
                        self.inner(at + 1, end)
                        at = end + 1
                    elif code.startswith("<", at):
                        at = self.element(at)
                        if at < 0:
                            return at
                    else:
                        m = _JSX_STRING.match(code, at)
                        if not m:
                            return -at
                        at = m.end()
        at += 1
        while True:
            at = _JSX_TEXT.match(code, at).end()
            if at >= len(code):
                return -at
            c = code[at]
            if c == "{":
                end = self.close_brace(at + 1)
                if end < 0:
                    return -len(code)
                self.inner(at + 1, end, True, True)
                at = end + 1
            elif c == "<":
                shut = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(code, at)
                if shut:
                    return shut.end() if shut.group(1) == name else -at
                at = self.element(at)
                if at < 0:
                    return at
            else:
                return -at

    def word(self, *words: str) -> bool:
        return self.k[self.i] == "id" and word_at(self, self.i) in words

    def name(self) -> None:
        """An identifier that may be bound."""
        if self.k[self.i] != "id":
            self.fail(f"expected a name instead of {self.k[self.i]}")
        if not self.ts and word_at(self, self.i) in ("let", "static", "implements", "interface", "package", "private", "protected", "public", "yield", "await", "eval", "arguments"):
            self.fail("a reserved word as a name")
        self.i += 1

    def any_name(self) -> bool:
        k = self.k[self.i]
        if k == "id" or k in _WORDS:
            self.i += 1
            return True
        return False

    def semicolon(self):
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif not (k == "}" or k == "eof" or self.nl[self.i]):
            self.fail(f"expected ; before {k}")

    # -- statements
    def text(self):
        self.items(self.module_item, "eof")

    def module_item(self):
        k = self.k[self.i]
        if k == "import" and self.k[self.i + 1] not in ("(", "."):
            self.imports()
        elif k == "export":
            self.exports()
        else:
            self.statement(True)

    def imports(self):
        self.i += 1
        if self.k[self.i] == "str":
            self.i += 1
            self.attributes()
            self.semicolon()
            return
        if self.ts and self.word("type") and (self.k[self.i + 1] in ("{", "*") or self.k[self.i + 1] == "id" and not (word_at(self, self.i + 1) == "from" and self.k[self.i + 2] == "str")):
            self.i += 1
        if self.k[self.i] == "id":
            self.name()
            if self.ts and self.eat("="):
                if self.word("require") and self.k[self.i + 1] == "(":
                    self.i += 2
                    self.need("str")
                    self.need(")")
                else:
                    self.dotted()
                self.semicolon()
                return
            if not self.eat(","):
                self.source()
                return
            if self.k[self.i] not in ("{", "*"):
                self.fail()
        if self.eat("*"):
            self.keyword("as")
            self.name()
        else:
            self.need("{")
            self.listed(self.import_name, "}")
        self.source()

    def import_name(self):
        if self.ts and self.word("type") and (self.k[self.i + 1] == "id" and word_at(self, self.i + 1) != "as" or self.k[self.i + 1] in _WORDS):
            self.i += 1
        if self.eat("str") or self.k[self.i] in _WORDS:
            self.i += self.k[self.i] in _WORDS
            self.keyword("as")
            self.name()
            return
        self.need("id")
        if self.word("as"):
            self.i += 1
            self.name()

    def keyword(self, w: str):
        if not self.word(w):
            self.fail(f"expected {w}")
        self.i += 1

    def source(self):
        self.keyword("from")
        self.need("str")
        self.attributes()
        self.semicolon()

    def attributes(self):
        if (self.k[self.i] == "with" or self.word("assert") and not self.nl[self.i]) and self.k[self.i + 1] == "{":
            self.i += 1
            self.literal_object()

    def dotted(self):
        self.need("id")
        while self.eat("."):
            if not self.any_name():
                self.fail()

    def exports(self):
        self.i += 1
        k = self.k[self.i]
        if k == "default":
            self.i += 1
            k = self.k[self.i]
            if k == "function" or self.word("async") and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += k != "function"
                self.function(False, k != "function")
            elif k in ("class", "@") or self.ts and self.word("abstract") and self.k[self.i + 1] == "class":
                self.decorators()
                self.i += self.k[self.i] == "id"
                self.class_(False)
            elif self.ts and self.word("interface") and self.k[self.i + 1] == "id":
                self.ts_statement()
            else:
                self.assignment()
                self.semicolon()
        elif k == "*":
            self.i += 1
            if self.word("as"):
                self.i += 1
                if not (self.any_name() or self.eat("str")):
                    self.fail()
            self.source()
        elif k == "{" or self.ts and self.word("type") and self.k[self.i + 1] in ("{", "*"):
            self.i += k != "{"
            if self.eat("*"):
                if self.word("as"):
                    self.i += 1
                    self.need("id")
                self.source()
                return
            self.need("{")
            self.listed(self.export_name, "}")
            if self.word("from"):
                self.source()
            else:
                self.semicolon()
        elif self.ts and k == "=":
            self.i += 1
            self.sequence()
            self.semicolon()
        elif self.ts and self.word("as"):
            self.i += 1
            self.keyword("namespace")
            self.name()
            self.semicolon()
        elif self.ts and k == "import":
            self.imports()
        elif k in ("var", "const", "function", "class", "@") or self.word("let") or self.word("async") and self.k[self.i + 1] == "function" or self.ts and (self.word(*_TS_START) or k == "enum"):
            self.statement(True)
        else:
            self.fail()

    def export_name(self):
        if self.ts and self.word("type") and self.k[self.i + 1] == "id" and word_at(self, self.i + 1) != "as":
            self.i += 1
        if not (self.any_name() or self.eat("str")):
            self.fail()
        if self.word("as"):
            self.i += 1
            if not (self.any_name() or self.eat("str")):
                self.fail()

    def block(self):
        self.need("{")
        self.items(lambda: self.statement(True), "}")

    def statement(self, declare: bool = False):
        k = self.k[self.i]
        simple = self.SIMPLE.get(k)
        if simple:
            simple(self)
            return
        if k == "id":
            n = self.k[self.i + 1]
            if n == ":":
                self.i += 2
                self.statement()
                return
            w = word_at(self, self.i)
            if w == "let" and (n in ("id", "[", "{") or n in _WORDS and n not in ("in", "instanceof")):
                self.variables()
                self.semicolon()
                return
            if w == "async" and n == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True, True)
                return
            if self.ts and w in _TS_START and self.ts_statement():
                return
        elif k == "enum" and self.ts:
            self.ts_enum()
            return
        elif k == "import" and self.k[self.i + 1] not in ("(", ".") or k == "export":
            if self.ts and self.nesting:
                self.imports() if k == "import" else self.exports()
                return
            self.fail(f"{k} within a block")
        elif k == "@":
            self.decorators()
            if self.ts and self.word("abstract"):
                self.i += 1
            if self.k[self.i] == "export":
                self.exports()
                return
            self.class_(True)
            return
        self.sequence()
        self.semicolon()

    nesting = 0

    def s_block(self):
        self.block()

    def s_empty(self):
        self.i += 1

    def s_var(self):
        if self.ts and self.k[self.i] == "const" and self.k[self.i + 1] == "enum":
            self.i += 1
            self.ts_enum()
            return
        self.variables()
        self.semicolon()

    def variables(self, loop: bool = False):
        const = self.k[self.i] == "const"
        self.i += 1
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.target()
            if self.ts:
                self.eat("!")
                self.annotation()
            if self.eat("="):
                self.assignment()
            elif (const or pattern) and not (loop and (self.k[self.i] == "in" or self.word("of"))) and not self.ambient:
                self.fail("expected a value")
            if not self.eat(","):
                return

    def target(self):
        """What is bound: a name or a pattern."""
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.element_target()
                if self.k[self.i] != "]":
                    self.need(",")
        elif k == "{":
            self.i += 1
            self.listed(self.property_target, "}")
        else:
            self.name()

    def element_target(self):
        self.target()
        if self.eat("="):
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held

    def property_target(self):
        if self.eat("..."):
            self.name()
            return
        k = self.k[self.i]
        if k == "id" and self.k[self.i + 1] != ":":
            self.element_target()
            return
        self.key()
        self.need(":")
        self.element_target()

    def key(self):
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held
            self.need("]")
        elif k in ("str", "num", "priv"):
            self.i += 1
        elif not self.any_name():
            self.fail("expected a property name")

    def condition(self):
        self.need("(")
        self.sequence()
        self.need(")")

    def s_if(self):
        self.i += 1
        self.condition()
        self.statement()
        if self.eat("else"):
            self.statement()

    def s_while(self):
        self.i += 1
        self.condition()
        self.statement()

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.eat(";")

    def s_for(self):
        self.i += 1
        if self.word("await"):
            self.i += 1
        self.need("(")
        k = self.k[self.i]
        if not self.eat(";"):
            self.no_in = True
            left = "name"
            if k in ("var", "const") or self.word("let") and self.k[self.i + 1] in ("id", "[", "{"):
                self.variables(True)
                left = "name"
            else:
                left = self.sequence()
            self.no_in = False
            if self.k[self.i] == "in" or self.word("of"):
                if left not in _PLACE and left not in _PATTERN:
                    self.fail()
                self.i += 1
                self.sequence()
                self.need(")")
                self.statement()
                return
            self.need(";")
        if not self.eat(";"):
            self.sequence()
            self.need(";")
        if self.k[self.i] != ")":
            self.sequence()
        self.need(")")
        self.statement()

    def s_try(self):
        self.i += 1
        self.block()
        has = False
        if self.eat("catch"):
            has = True
            if self.eat("("):
                self.target()
                if self.ts:
                    self.annotation()
                self.need(")")
            self.block()
        if self.eat("finally"):
            has = True
            self.block()
        if not has:
            self.fail("try without catch or finally")

    def s_switch(self):
        self.i += 1
        self.condition()
        self.need("{")

        def case():
            if self.eat("case"):
                self.sequence()
                self.need(":")
            elif self.eat("default"):
                self.need(":")
            else:
                self.statement(True)

        if self.k[self.i] not in ("case", "default", "}"):
            self.fail()
        self.items(case, "}")

    def s_return(self):
        if not self.functions:
            self.fail("return outside a function")
        self.i += 1
        if self.k[self.i] not in (";", "}", "eof") and not self.nl[self.i]:
            self.sequence()
        self.semicolon()

    def s_throw(self):
        self.i += 1
        if self.nl[self.i]:
            self.fail("a line end behind throw")
        self.sequence()
        self.semicolon()

    def s_jump(self):
        self.i += 1
        if self.k[self.i] == "id" and not self.nl[self.i]:
            self.i += 1
        self.semicolon()

    def s_debugger(self):
        self.i += 1
        self.semicolon()

    def s_function(self):
        self.function(True, False)

    def s_class(self):
        self.class_(True)

    def s_with(self):
        self.fail("with in a module")

    SIMPLE = {"{": s_block, ";": s_empty, "var": s_var, "const": s_var, "if": s_if, "while": s_while, "do": s_do, "for": s_for, "try": s_try, "switch": s_switch, "return": s_return, "throw": s_throw, "break": s_jump, "continue": s_jump, "debugger": s_debugger, "function": s_function, "class": s_class, "with": s_with}

    # -- functions and classes
    def function(self, named: bool, is_async: bool):
        self.need("function")
        star = self.eat("*")
        if self.k[self.i] == "id":
            self.i += 1
        elif named:
            self.fail("expected a name")
        if self.ts:
            self.type_parameters()
        self.parameters()
        self.function_body(is_async, star, True)

    def function_body(self, is_async: bool, star: bool, bare: bool = False):
        if self.ts:
            self.return_type()
            if self.k[self.i] != "{" and bare:
                self.semicolon()
                return
        held = self.functions, self.await_, self.yield_, self.no_in
        self.functions, self.await_, self.yield_, self.no_in = True, is_async, star, False
        self.block()
        self.functions, self.await_, self.yield_, self.no_in = held

    def parameters(self):
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self):
        self.decorators()
        if self.ts:
            while self.word("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] in ("id", "{", "["):
                self.i += 1
            if self.eat("this"):
                self.annotation()
                return
        rest = self.eat("...")
        self.target()
        if self.ts:
            self.eat("?")
            self.annotation()
        if not rest and self.eat("="):
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held

    def decorators(self):
        while self.eat("@"):
            if self.eat("("):
                self.sequence()
                self.need(")")
            else:
                self.need("id")
                while self.eat("."):
                    if not self.any_name() and not self.eat("priv"):
                        self.fail()
                if self.k[self.i] == "(":
                    self.arguments()

    def class_(self, named: bool):
        self.need("class")
        if self.k[self.i] == "id" and not (self.ts and self.word("implements") and self.k[self.i + 1] == "id"):
            self.i += 1
        elif named:
            self.fail("expected a name")
        if self.ts:
            self.type_parameters()
        if self.eat("extends"):
            self.postfix(self.primary())
            if self.ts:
                self.type_arguments()
        if self.ts and self.word("implements"):
            self.i += 1
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.items(self.member, "}")

    def member(self):
        if self.eat(";"):
            return
        self.decorators()
        k = self.k
        if self.word("static") and k[self.i + 1] == "{":
            self.i += 1
            held = self.functions
            self.functions = False
            self.block()
            self.functions = held
            return
        after = ("(", "=", ";", "}", "eof", ":", "?", "!", "<") if self.ts else ("(", "=", ";", "}", "eof")
        is_async = star = accessor = abstract = False
        while k[self.i] == "id" and k[self.i + 1] not in after:
            w = word_at(self, self.i)
            if w == "static" or w == "accessor" and not self.nl[self.i + 1]:
                self.i += 1
            elif self.ts and w in ("public", "private", "protected", "readonly", "override", "abstract", "declare") and not self.nl[self.i + 1]:
                abstract = abstract or w in ("abstract", "declare")
                self.i += 1
            elif w == "async" and not self.nl[self.i + 1]:
                is_async = True
                self.i += 1
            elif w in ("get", "set") and not (k[self.i + 1] == "*"):
                accessor = True
                self.i += 1
                break
            else:
                break
        if self.eat("*"):
            star = True
        if self.ts and k[self.i] == "[" and k[self.i + 1] == "id" and k[self.i + 2] == ":":
            self.index_signature()
            self.semicolon()
            return
        self.key()
        if self.ts:
            self.eat("?") or self.eat("!")
            self.type_parameters()
        if k[self.i] == "(":
            self.parameters()
            self.function_body(is_async, star, self.ts)
            return
        if accessor or is_async or star:
            self.fail()
        if self.ts:
            self.annotation()
        if self.eat("="):
            held = self.functions, self.await_, self.yield_
            self.functions, self.await_, self.yield_ = False, False, False
            self.assignment()
            self.functions, self.await_, self.yield_ = held
        self.semicolon()

    # -- expressions
    def operator(self):
        k = self.k[self.i]
        if k == ">":
            n = 1
            while n < 3 and self.k[self.i + n] == ">" and self.p[self.i + n] == self.p[self.i] + n:
                n += 1
            if self.k[self.i + n] in ("=", "==", "===") and self.p[self.i + n] == self.p[self.i] + n:
                if self.k[self.i + n] == "=":
                    return ">" * n + "=", n + 1
                return "bad", 1
            return ">" * n, n
        if k == "in" and self.no_in:
            return "", 0
        if k == "id":
            if self.ts and not self.nl[self.i]:
                w = word_at(self, self.i)
                if w in ("as", "satisfies"):
                    return w, 1
            return "", 0
        return k, 1

    def operand(self, op, level):
        if op in ("as", "satisfies"):
            if self.k[self.i] == "const":
                self.i += 1
            else:
                self.type()
            self.cast_end = self.i
        else:
            self.binary(level if op == "**" else level + 1)

    def sequence(self) -> str:
        left = self.assignment()
        while self.eat(","):
            self.assignment()
            left = "sequence"
        return left

    def assignment(self) -> str:
        k = self.k[self.i]
        if k == "id":
            n = self.k[self.i + 1]
            if n == "=>" and not self.nl[self.i + 1]:
                self.i += 2
                return self.arrow(False)
            w = word_at(self, self.i)
            if w == "async" and not self.nl[self.i + 1]:
                if n == "id" and self.k[self.i + 2] == "=>":
                    self.i += 3
                    return self.arrow(True)
                if n in ("(", "<"):
                    self.i += 1
                    if self.arrow_head():
                        return self.arrow(True)
                    self.i -= 1
            elif w == "yield" and self.yield_:
                self.i += 1
                if not self.nl[self.i] and self.k[self.i] not in (")", "]", "}", ",", ";", ":", "eof", "in"):
                    self.eat("*")
                    self.assignment()
                return "yield"
        elif (k == "(" or k == "<" and self.ts) and self.arrow_head():
            return self.arrow(False)
        at = self.i
        left = self.conditional()
        op, n = self.operator()
        if op in _ASSIGN:
            if left not in _PLACE and not (op == "=" and left in _PATTERN):
                self.fail("this can't be assigned to")
            self.i += n
            self.assignment()
            return "assign"
        if left == "cover":  # {a = 1} without being a pattern
            self.i = max(self.i, at)
            self.fail()
        return left

    def arrow_head(self) -> bool:
        """Takes parameters and the arrow, if an arrow function begins here."""
        at, k = self.i, self.k
        if k[at] == "(":
            n = k[at + 1]
            if n not in (")", "id", "{", "[", "...", "this", "@"):
                return False
            if n == "id" and k[at + 2] not in (",", ")", "=", ":", "?", "id"):
                return False
        errors = len(self.errors), len(self.nested)
        try:
            if self.ts:
                self.type_parameters()
            self.parameters()
            if self.ts and k[self.i] == ":":
                self.return_type()
            if k[self.i] == "=>" and not self.nl[self.i]:
                self.i += 1
                return True
        except Broken:
            pass
        del self.errors[errors[0] :], self.nested[errors[1] :]
        self.i = at
        return False

    def arrow(self, is_async: bool) -> str:
        held = self.functions, self.await_, self.yield_, self.no_in
        self.functions, self.await_, self.yield_ = True, is_async or self.await_, False
        if self.k[self.i] == "{":
            self.no_in = False
            self.block()
        else:
            self.functions = held[0]
            self.assignment()
        self.functions, self.await_, self.yield_, self.no_in = held
        return "arrow"

    def conditional(self) -> str:
        left = self.binary(0)
        if self.k[self.i] == "?":
            self.i += 1
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held
            self.need(":")
            self.assignment()
            return "conditional"
        return left

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("!", "-", "+", "~", "typeof", "void", "delete"):
            self.i += 1
            self.unary()
            if self.k[self.i] == "**":
                self.fail()
            return "unary"
        if k in ("++", "--"):
            self.i += 1
            if self.unary() not in _PLACE:
                self.fail("nothing to step")
            return "step"
        if k == "id" and self.await_ and word_at(self, self.i) == "await":
            self.i += 1
            self.unary()
            return "await"
        if k == "<" and self.ts and not self.jsx:
            self.i += 1
            if not self.eat("const"):
                self.type()
            self.need(">")
            self.unary()
            return "cast"
        left = self.postfix(self.primary())
        if self.k[self.i] in ("++", "--") and not self.nl[self.i]:
            if left not in _PLACE:
                self.fail("nothing to step")
            self.i += 1
            return "step"
        return left

    def primary(self) -> str:
        k = self.k[self.i]
        if k == "id":
            if word_at(self, self.i) == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(False, True)
                return "function"
            self.i += 1
            return "name"
        if k in ("num", "str", "regex", "null", "true", "false", "jsx"):
            self.i += 1
            if k == "jsx" and self.k[self.i] == "jsx":
                self.fail("elements without a common parent")
            return "literal"
        if k == "tpl":
            self.i += 1
            return "template"
        if k == "this":
            self.i += 1
            return "this"
        if k == "(":
            self.i += 1
            held, self.no_in = self.no_in, False
            inner = self.sequence()
            self.no_in = held
            cast = self.ts and inner == "binary" and self.cast_end == self.i
            self.need(")")
            return inner if inner in _PLACE else "name" if cast else "paren"
        if k == "[":
            self.i += 1
            held, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
            self.no_in = held
            return "array"
        if k == "{":
            return self.literal_object()
        if k == "function":
            self.function(False, False)
            return "function"
        if k in ("class", "@"):
            self.decorators()
            self.class_(False)
            return "class"
        if k == "new":
            self.i += 1
            if self.eat("."):
                self.keyword("target")
                return "literal"
            left = self.primary()
            while True:
                k = self.k[self.i]
                if k == ".":
                    self.i += 1
                    if not (self.any_name() or self.eat("priv")):
                        self.fail()
                elif k == "[":
                    self.i += 1
                    self.sequence()
                    self.need("]")
                elif k == "tpl":
                    self.i += 1
                elif k == "!" and self.ts and not self.nl[self.i]:
                    self.i += 1
                else:
                    break
            if self.ts:
                self.attempt(self.call_types)
            if self.k[self.i] == "(":
                self.arguments()
            return "call" if left else "call"
        if k == "super":
            self.i += 1
            if self.k[self.i] not in ("(", ".", "["):
                self.fail()
            return "this"
        if k == "import":
            self.i += 1
            if self.eat("."):
                self.keyword("meta")
                return "literal"
            if self.k[self.i] != "(":
                self.fail()
            return "this"
        if k == "priv" and self.k[self.i + 1] == "in":
            self.i += 1
            return "literal"
        self.fail()

    def literal_object(self) -> str:
        self.need("{")
        held, self.no_in = self.no_in, False
        kinds: list[str] = []
        self.listed(lambda: kinds.append(self.property()), "}")
        self.no_in = held
        if "cover" in kinds and not (self.k[self.i] == "=" or self.k[self.i] in (",", "}", "]", ")", "=>") or self.word("of")):
            self.fail()
        return "object"

    def property(self) -> str:
        if self.eat("..."):
            self.assignment()
            return "spread"
        k = self.k
        is_async = star = accessor = False
        after = ("(", ",", "}", ":", "=", "<") if self.ts else ("(", ",", "}", ":", "=")
        if k[self.i] == "id" and k[self.i + 1] not in after:
            w = word_at(self, self.i)
            if w == "async" and not self.nl[self.i + 1]:
                is_async = True
                self.i += 1
            elif w in ("get", "set"):
                accessor = True
                self.i += 1
        if self.eat("*"):
            star = True
        name = k[self.i]
        self.key()
        if self.ts:
            self.type_parameters()
        if k[self.i] == "(":
            self.parameters()
            self.function_body(is_async, star)
            return "method"
        if accessor or is_async or star or name == "priv":
            self.fail()
        if self.eat(":"):
            self.assignment()
            return "pair"
        if name != "id":
            self.fail("expected : behind the property name")
        if self.eat("="):
            self.assignment()
            return "cover"
        return "short"

    def arguments(self):
        self.need("(")
        held, self.no_in = self.no_in, False
        self.listed(self.argument, ")")
        self.no_in = held

    def argument(self):
        self.eat("...")
        self.assignment()

    def call_types(self):
        """Type arguments of a call; what follows must not begin an operand."""
        self.type_arguments(True)
        if self.k[self.i] not in ("(", "tpl", ")", "]", "}", ",", ";", ":", ".", "?.", "eof", "==", "===", "!=", "!==", "&&", "||", "??", "?", "=", "as", "=>") and not self.nl[self.i]:
            self.fail()

    def postfix(self, left: str) -> str:
        optional = False
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if not (self.any_name() or self.eat("priv")):
                    self.fail("expected a name")
                left = "chain" if optional else "member"
            elif k == "(":
                self.arguments()
                left = "call"
            elif k == "[":
                self.i += 1
                held, self.no_in = self.no_in, False
                self.sequence()
                self.no_in = held
                self.need("]")
                left = "chain" if optional else "member"
            elif k == "?.":
                self.i += 1
                optional = True
                if self.k[self.i] == "(":
                    self.arguments()
                elif self.eat("["):
                    self.sequence()
                    self.need("]")
                elif self.k[self.i] != "tpl":
                    if not (self.any_name() or self.eat("priv")):
                        self.fail("expected a name")
                left = "chain"
            elif k == "tpl":
                self.i += 1
                left = "call"
            elif self.ts and k == "!" and not self.nl[self.i]:
                self.i += 1
            elif self.ts and k == "<" and left in ("name", "member", "chain", "call", "this", "paren") and self.attempt(self.call_types):
                if self.k[self.i] not in ("(", "tpl"):
                    left = "call"
            else:
                return left

    # -- types
    def annotation(self):
        if self.eat(":"):
            self.type()

    def return_type(self):
        if self.eat(":"):
            if self.word("asserts") and (self.k[self.i + 1] in ("id", "this")) and not self.nl[self.i + 1]:
                self.i += 2
                if self.word("is"):
                    self.i += 1
                    self.type()
            elif self.k[self.i] in ("id", "this") and self.k[self.i + 1] == "id" and word_at(self, self.i + 1) == "is" and not self.nl[self.i + 1]:
                self.i += 2
                self.type()
            else:
                self.type()

    def type_parameters(self):
        if self.eat("<"):
            while True:
                while self.k[self.i] in ("in", "const") or self.word("out") and self.k[self.i + 1] == "id":
                    self.i += 1
                self.need("id")
                if self.eat("extends"):
                    self.type()
                if self.eat("="):
                    self.type()
                if not self.eat(",") or self.k[self.i] == ">":
                    break
            self.need(">")

    def type_arguments(self, must: bool = False):
        if self.k[self.i] == "<":
            self.i += 1
            while True:
                self.type()
                if not self.eat(",") or self.k[self.i] == ">":
                    break
            self.need(">")
        elif must:
            self.fail()

    def type(self):
        k = self.k[self.i]
        if k == "<" or k == "(" and self.function_type_ahead():
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type_result()
            return
        if k == "new" or self.word("abstract") and self.k[self.i + 1] == "new":
            self.i += 1 + (k != "new")
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type()
            return
        self.union()
        if self.k[self.i] == "extends" and not self.nl[self.i] and not self.no_condition:
            self.i += 1
            self.no_condition = True
            self.union()
            self.no_condition = False
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    no_condition = False
    cast_end = -1

    def type_result(self):
        """Behind the arrow of a function type: a type or a predicate."""
        if self.word("asserts") and self.k[self.i + 1] in ("id", "this") and not self.nl[self.i + 1]:
            self.i += 2
            if not self.word("is"):
                return
            self.i += 1
        elif self.k[self.i] in ("id", "this") and self.k[self.i + 1] == "id" and word_at(self, self.i + 1) == "is":
            self.i += 2
        self.type()

    def function_type_ahead(self) -> bool:
        k, i = self.k, self.i
        n = k[i + 1]
        if n == ")":
            return k[i + 2] == "=>"
        if n == "...":
            return True
        if n in ("id", "this") and k[i + 2] in (":", ",", "?", "="):
            return True
        if n == "id" and k[i + 2] == ")":
            return k[i + 3] == "=>"
        if n in ("{", "["):
            at = self.i

            def head():
                self.parameters()
                self.need("=>")

            ok = self.attempt(head)
            self.i = at
            return ok
        return False

    def union(self):
        self.eat("|") or self.eat("&")
        while True:
            self.type_unary()
            if self.k[self.i] in ("|", "&"):
                self.i += 1
            else:
                return

    def type_unary(self):
        if self.word("keyof", "unique", "readonly", "infer") and (self.k[self.i + 1] in ("id", "(", "[", "{", "typeof", "str") and not self.nl[self.i + 1]):
            infer = self.word("infer")
            self.i += 1
            self.type_unary()
            if infer and self.k[self.i] == "extends":
                at = self.i
                self.i += 1
                if not (self.attempt(self.type_unary) and (self.no_condition or self.k[self.i] != "?")):
                    self.i = at
            return
        self.type_primary()
        while not self.nl[self.i]:
            if self.k[self.i] != "[":
                break
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def type_primary(self):
        k = self.k[self.i]
        if k == "id":
            self.i += 1
            while self.k[self.i] == ".":
                self.i += 1
                if not self.any_name():
                    self.fail()
            if not self.nl[self.i]:
                self.type_arguments()
        elif k in ("str", "num", "true", "false", "null", "void", "this", "tpl"):
            self.i += 1
        elif k == "-":
            self.i += 1
            self.need("num")
        elif k == "(":
            self.i += 1
            held, self.no_condition = self.no_condition, False
            self.type()
            self.no_condition = held
            self.need(")")
        elif k == "[":
            self.i += 1
            self.listed(self.tuple_item, "]")
        elif k == "{":
            self.type_object()
        elif k == "typeof":
            self.i += 1
            if self.eat("import"):
                self.need("(")
                self.need("str")
                self.need(")")
            elif not self.eat("this"):
                self.need("id")
            while self.eat("."):
                if not (self.any_name() or self.eat("priv")):
                    self.fail()
            if not self.nl[self.i]:
                self.type_arguments()
        elif k == "import":
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.eat("."):
                self.need("id")
            self.type_arguments()
        else:
            self.fail(f"expected a type instead of {k}")

    def tuple_item(self):
        self.eat("...")
        if self.k[self.i] == "id" and (self.k[self.i + 1] == ":" or self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":"):
            self.i += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def index_signature(self):
        self.need("[")
        self.need("id")
        self.need(":")
        self.type()
        self.need("]")
        self.annotation()

    def type_object(self):
        self.need("{")
        held, self.no_condition = self.no_condition, False
        while not self.eat("}"):
            self.type_member()
            if self.k[self.i] in (";", ","):
                self.i += 1
            elif self.k[self.i] != "}" and not self.nl[self.i]:
                self.fail()
        self.no_condition = held

    def type_member(self):
        k = self.k
        if k[self.i] in ("(", "<") or k[self.i] == "new" and k[self.i + 1] in ("(", "<"):
            self.i += k[self.i] == "new"
            self.type_parameters()
            self.parameters()
            self.return_type()
            return
        if k[self.i] in ("+", "-"):
            self.i += 1
        while self.word("readonly", "get", "set", "static") and k[self.i + 1] not in (":", "?", "(", ",", ";", "}", "<"):
            self.i += 1
        if k[self.i] == "[" and k[self.i + 1] == "id" and k[self.i + 2] == ":":
            self.index_signature()
            return
        if k[self.i] == "[" and k[self.i + 1] == "id" and k[self.i + 2] == "in":
            self.i += 3
            self.type()
            if self.word("as"):
                self.i += 1
                self.type()
            self.need("]")
            if k[self.i] in ("+", "-"):
                self.i += 1
            self.eat("?")
            self.annotation()
            return
        self.key()
        self.eat("?")
        if k[self.i] in ("(", "<"):
            self.type_parameters()
            self.parameters()
            self.return_type()
        else:
            self.annotation()

    # -- statements of TypeScript
    def ts_statement(self) -> bool:
        w, n = word_at(self, self.i), self.k[self.i + 1]
        if self.nl[self.i + 1] and w != "declare":
            return False
        if w == "interface" and n == "id":
            self.i += 2
            self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.type_object()
        elif w == "type" and n == "id":
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif w in ("namespace", "module") and n in ("id", "str"):
            self.i += 1
            if not self.eat("str"):
                self.dotted()
            if self.k[self.i] == "{":
                self.nesting += 1
                self.block()
                self.nesting -= 1
            else:
                self.semicolon()
        elif w == "global" and n == "{":
            self.i += 1
            self.block()
        elif w == "abstract" and n == "class":
            self.i += 1
            self.class_(True)
        elif w == "declare" and (n in ("var", "const", "function", "class", "enum") or n == "id"):
            self.i += 1
            held, self.ambient = self.ambient, True
            self.statement(True)
            self.ambient = held
        else:
            return False
        return True

    def ts_enum(self):
        self.need("enum")
        self.need("id")
        self.need("{")

        def entry():
            self.key()
            if self.eat("="):
                self.assignment()

        self.listed(entry, "}")
