"""Kotlin. Line ends matter outside round and square brackets; a script (.kts) may hold statements at the top."""

from __future__ import annotations

import re

from .base import Broken, Parser, scan, word_at

_GAP = re.compile(r"(?:\s+|//[^\n\r]*|#![^\n]*)*")
_NEST = re.compile(r"/\*|\*/")
_TOKEN = re.compile(
    r"""(?P<id>[^\W\d]\w*|`[^`\n\r]+`)|(?P<num>0[xX][\da-fA-F][\da-fA-F_]*[uU]?L?(?!\w)|0[bB][01][01_]*[uU]?L?(?!\w)|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fF]?(?!\w)|\d[\d_]*(?:[eE][+-]?\d+)?(?:[uU]?L?|[fF])(?!\w))"""
    r"""|(?P<cmt>/\*)|(?P<raw>\"\"\")|(?P<str>\")|(?P<chr>'(?:\\[tbrn'"\\$]|\\u[\da-fA-F]{4}|[^'\\\n\r])')"""
    r"""|(?P<op>\.\.<|\.\.|===|!==|->|=>|::|\?\.|\?:|\+\+|--|&&|\|\||!!|!in\b|!is\b|as\?|[=!<+\-*/%]=|[-+*/%=<>!?:;,.(){}\[\]@&|])"""
)
_HARD = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split())
_MODIFIER = frozenset("public private protected internal open abstract final override sealed data enum annotation inner companion lateinit const tailrec operator infix inline external suspend crossinline noinline vararg expect actual value reified out".split())
_ASSIGN = frozenset("= += -= *= /= %=".split())
_CHUNK = re.compile(r'(?:[^"\\$\n\r]|\\(?:[tbrn\'"\\$]|u[\da-fA-F]{4})|\$(?![{\w`]))*')
_RAW = re.compile(r'(?:[^"$]|"(?!"")|\$(?![{\w`]))*')
_SIMPLE_NAME = re.compile(r"\$(?:this\b|[^\W\d]\w*|`[^`\n]+`)")
_PLACE = frozenset(["name", "member", "index"])


class Kotlin(Parser):
    SPECIAL = frozenset(["str", "raw", "cmt"])
    PATH = True
    STARTS = frozenset("if for while do try return throw val var fun class interface object package import".split())
    LEVELS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "===": 3, "!==": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "in": 5, "!in": 5, "is": 5, "!is": 5, "?:": 6, "infix": 7, "..": 8, "..<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "as": 11, "as?": 11}

    def __init__(self, code: str, path: str = "", shift: int = 0, part: bool = False):
        self.script, self.part = path.endswith(".kts"), part
        self.inside = part  # within round or square brackets, where line ends don't count
        super().__init__(code, shift)

    def lex(self):
        scan(self, _TOKEN, _GAP, _HARD, self.special)

    def special(self, kind: str, m: re.Match) -> tuple[str, int]:
        """A string with its templates; those in braces are parsed at once."""
        code, raw = self.code, kind == "raw"
        if kind == "cmt":  # comments nest
            depth = 0
            for n in _NEST.finditer(code, m.start()):
                depth += 1 if n.group() == "/*" else -1
                if not depth:
                    return None, n.end()
            return "bad", len(code)
        body, stop, at = (_RAW, '"""', m.end()) if raw else (_CHUNK, '"', m.end())
        while True:
            at = body.match(code, at).end()
            if code.startswith(stop, at):
                at += len(stop)
                while raw and code.startswith('"', at):
                    at += 1
                return "str", at
            if code.startswith("${", at):
                depth, j = 1, at + 2
                while j < len(code) and depth:
                    c = code[j]
                    if c == "{":
                        depth += 1
                    elif c == "}":
                        depth -= 1
                    elif c == '"':
                        wide = code.startswith('"""', j)
                        j = self.special("raw" if wide else "str", re.compile('"""' if wide else '"').match(code, j))[1] - 1
                    j += 1
                if depth:
                    return "bad", len(code)
                if Kotlin(code[at + 2 : j - 1], part=True).run():
                    return "bad", j
                at = j
            elif code.startswith("$", at) and (s := _SIMPLE_NAME.match(code, at)):
                at = s.end()
            elif code.startswith("$", at):
                at += 1
            else:
                return "bad", at

    # -- line ends
    def same(self) -> bool:
        """The next token goes on with the expression as far as line ends tell."""
        return self.inside or not self.nl[self.i]

    def within(self, parse, end: str):
        """Comma list inside brackets, up to ``end``, which is taken."""
        held, self.inside = self.inside, True
        try:
            self.listed(parse, end)
        finally:
            self.inside = held

    def close(self):
        """The end of a statement."""
        if self.eat(";"):
            while self.eat(";"):
                pass
        elif not self.nl[self.i] and self.k[self.i] not in ("}", "eof"):
            self.fail(f"expected a new line before {self.k[self.i]}")

    def soft(self, word: str) -> bool:
        return self.k[self.i] == "id" and word_at(self, self.i) == word

    # -- files
    def text(self):
        if self.part:
            self.inside = False
            if self.k[self.i] == "eof":
                self.fail("an empty template")
            self.items(self.statement, "eof")
            return
        while self.k[self.i] == "@" and self.k[self.i + 1] == "id" and word_at(self, self.i + 1) == "file":
            self.i += 1
            self.annotation_body()
        at = self.i
        self.annotations()
        if self.k[self.i] == "package":
            self.i += 1
            self.dotted()
            self.close()
        else:
            self.i = at
        self.items(self.top, "eof")

    def dotted(self):
        self.word()
        while self.k[self.i] == "." and not self.nl[self.i]:
            self.i += 1
            self.word()

    def word(self):
        """A name in a package or import, where some hard words occur too."""
        if self.k[self.i] in ("id", "in", "is", "as", "object", "val", "var", "fun", "interface", "typeof"):
            self.i += 1
        else:
            self.fail("expected a name")

    def top(self):
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif self.soft("import") and self.k[self.i + 1] == "id":
            self.i += 1
            self.word()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.word()
            if self.eat("as"):
                self.need("id")
            self.close()
        elif self.script:
            self.statement()
        else:
            self.modifiers()
            if not self.declaration(True):
                self.fail("expected a declaration")

    def annotations(self):
        while self.k[self.i] == "@" and self.k[self.i + 1] in ("id", "["):
            self.i += 1
            self.annotation_body()

    def annotation_body(self):
        if self.k[self.i] == "id" and self.k[self.i + 1] == ":" and word_at(self, self.i) in ("file", "field", "get", "set", "property", "param", "receiver", "setparam", "delegate"):
            self.i += 2
        if self.eat("["):
            while not self.eat("]"):
                self.constructed()
            return
        self.constructed()

    def constructed(self):
        self.user_type()
        if self.k[self.i] == "(" and not self.nl[self.i]:
            self.arguments()

    def modifiers(self) -> bool:
        """Takes modifiers; a word counts as one only where a declaration goes on behind it."""
        any_ = False
        while True:
            k = self.k[self.i]
            if k == "@" and self.k[self.i + 1] in ("id", "["):
                self.annotations()
                any_ = True
            elif k == "id" and word_at(self, self.i) in _MODIFIER and (self.k[self.i + 1] in ("id", "class", "interface", "object", "fun", "val", "var", "typealias", "@", "in")) and not (self.k[self.i + 1] == "id" and self.nl[self.i + 1] and word_at(self, self.i + 1) not in _MODIFIER):
                if self.k[self.i + 1] in ("id", "in") and not self.leads(self.i + 1):
                    return any_
                self.i += 1
                any_ = True
            elif k == "fun" and self.k[self.i + 1] == "interface":
                self.i += 1
            else:
                return any_

    def leads(self, i: int) -> bool:
        while self.k[i] == "id" and word_at(self, i) in _MODIFIER:
            i += 1
        return self.k[i] in ("class", "interface", "object", "fun", "val", "var", "typealias", "@") or self.k[i] == "id" and (word_at(self, i) in ("constructor", "get", "set", "init") or self.k[i + 1] == ":") or self.params

    params = False

    def declaration(self, member: bool) -> bool:
        k = self.k[self.i]
        if k in ("class", "interface"):
            self.i += 1
            self.need("id")
            self.type_parameters()
            self.modifiers()
            if self.soft("constructor"):
                self.i += 1
                if self.k[self.i] != "(":
                    self.fail()
            if self.k[self.i] == "(" and k == "class":
                self.parameters(True)
            self.supers()
            self.where()
            self.class_body(False)
        elif k == "object" and (self.k[self.i + 1] == "id" or word_at(self, self.i - 1) == "companion"):
            self.i += 1
            self.eat("id")
            self.supers()
            self.class_body(False)
        elif k == "fun":
            self.function(True)
        elif k in ("val", "var"):
            self.property(member)
        elif k == "typealias":
            self.i += 1
            self.need("id")
            self.type_parameters()
            self.need("=")
            self.type()
        else:
            return False
        self.close()
        return True

    def supers(self):
        if self.eat(":"):
            while True:
                self.annotations()
                self.type()
                if self.k[self.i] == "(" and not self.nl[self.i]:
                    self.arguments()
                elif self.k[self.i] == "id" and word_at(self, self.i) == "by":
                    self.i += 1
                    self.headless = True  # a brace opens the body, not a lambda
                    self.expression()
                    self.headless = False
                if not self.eat(","):
                    return

    def where(self):
        if self.soft("where"):
            self.i += 1
            while True:
                self.annotations()
                self.need("id")
                self.need(":")
                self.type()
                if not self.eat(","):
                    return

    def class_body(self, must: bool):
        if self.k[self.i] != "{":
            if must:
                self.fail()
            return
        self.i += 1
        held, self.inside = self.inside, False
        entries = self.code[: self.p[self.i]].rfind("enum")
        if entries >= 0 and self.k[self.i] in ("id", "@", ";", "}") and self.is_enum():
            self.entries()
        self.items(self.member, "}")
        self.inside = held

    def is_enum(self) -> bool:
        """Looks back from an opened body for ``enum class``."""
        i, depth = self.i - 2, 0
        while i >= 0:
            k = self.k[i]
            if k in (")", ">", "]"):
                depth += 1
            elif k in ("(", "<", "["):
                depth -= 1
            elif not depth:
                if k == "class":
                    return i > 0 and self.k[i - 1] == "id" and word_at(self, i - 1) == "enum"
                if k in ("{", "}", ";", "interface", "object", "fun"):
                    return False
            i -= 1
        return False

    def entries(self):
        while self.k[self.i] in ("id", "@"):
            if self.k[self.i] == "id" and self.k[self.i + 1] in ("fun", "val", "var", "class", "object"):
                break
            self.annotations()
            self.need("id")
            if self.k[self.i] == "(":
                self.arguments()
            if self.k[self.i] == "{":
                self.class_body(True)
            if not self.eat(","):
                break
        if self.k[self.i] != "}":
            self.need(";")

    def member(self):
        if self.eat(";"):
            return
        if self.soft("init") and self.k[self.i + 1] == "{":
            self.i += 1
            self.block()
            self.close()
            return
        self.modifiers()
        if self.soft("constructor"):
            self.i += 1
            self.parameters(False)
            if self.eat(":"):
                if self.k[self.i] not in ("this", "super"):
                    self.fail()
                self.i += 1
                self.arguments()
            if self.k[self.i] == "{":
                self.block()
            self.close()
        elif not self.declaration(True):
            self.fail("expected a member")

    def type_parameters(self):
        if self.eat("<"):
            while True:
                self.annotations()
                while self.soft("reified") or self.soft("out") or self.k[self.i] == "in":
                    if self.k[self.i] == "id" and self.k[self.i + 1] not in ("id",):
                        break
                    self.i += 1
                self.need("id")
                if self.eat(":"):
                    self.type()
                if not self.eat(",") or self.k[self.i] == ">":
                    break
            self.need(">")

    def parameters(self, fields: bool):
        self.need("(")
        self.params = True
        try:
            self.within(self.parameter, ")")
        finally:
            self.params = False

    def parameter(self):
        self.modifiers()
        if self.k[self.i] in ("val", "var"):
            self.i += 1
        self.need("id")
        self.need(":")
        self.type()
        if self.eat("="):
            held, self.params = self.params, False
            self.expression()
            self.params = held

    def function(self, named: bool):
        self.need("fun")
        self.type_parameters()
        at = self.i
        if self.k[self.i] != "(" or named:
            if not self.attempt(self.receiver):
                self.i = at
                if named:
                    self.need("id")
        self.parameters(False)
        if self.eat(":"):
            self.type()
        self.where()
        if self.eat("="):
            self.expression()
        elif self.k[self.i] == "{":
            self.block()

    def receiver(self):
        """Optional receiver type, the name, and no more: an opening bracket follows."""
        if self.k[self.i] == "id" and self.k[self.i + 1] == "(":
            self.i += 1
            return
        self.annotations()
        if self.k[self.i] == "(":
            self.type()
        else:
            while True:  # the last part is the name
                self.need("id")
                self.type_arguments()
                self.eat("?")
                if self.k[self.i] not in (".", "?."):
                    self.fail()
                if self.k[self.i + 1] == "id" and self.k[self.i + 2] == "(":
                    self.i += 2
                    return
                self.i += 1
        self.need(".")
        self.need("id")
        if self.k[self.i] != "(":
            self.fail()

    def property(self, member: bool):
        self.i += 1
        self.type_parameters()
        if self.k[self.i] == "(":
            self.i += 1
            self.within(self.binding, ")")
        else:
            at = self.i
            if not (self.k[at] == "id" and self.k[at + 1] not in (".", "<", "?", "?.")):
                if not self.attempt(self.extension):
                    self.i = at
                    self.need("id")
            else:
                self.i += 1
            if self.eat(":"):
                self.type()
        self.where()
        if self.k[self.i] == "=":
            self.i += 1
            self.expression()
        elif self.soft("by"):
            self.i += 1
            self.expression()
        for _ in range(2):
            at = self.i
            self.eat(";")
            self.modifiers()
            if (self.soft("get") or self.soft("set")) and self.k[self.i + 1] in ("(",) and member:
                self.i += 2
                if self.k[self.i] != ")":
                    self.modifiers()
                    self.need("id")
                    if self.eat(":"):
                        self.type()
                    self.eat(",")
                self.need(")")
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expression()
                elif self.k[self.i] == "{":
                    self.block()
            elif (self.soft("get") or self.soft("set")) and member and (self.nl[self.i + 1] or self.k[self.i + 1] in ("}", ";")):
                self.i += 1
            else:
                self.i = at
                return

    def extension(self):
        while True:
            self.need("id")
            self.type_arguments()
            self.eat("?")
            if not (self.eat(".") or self.eat("?.")):
                self.fail()
            if self.k[self.i] == "id" and self.k[self.i + 1] in (":", "=", "id", "eof", "{", "}") or self.nl[self.i + 1]:
                self.need("id")
                return

    def binding(self):
        self.annotations()
        self.need("id")
        if self.eat(":"):
            self.type()

    # -- types
    def type(self):
        self.annotations()
        while self.soft("suspend") and self.k[self.i + 1] in ("(", "id"):
            self.i += 1
        if self.k[self.i] == "(":
            self.i += 1
            self.within(self.type_item, ")")
            if self.eat("->"):
                self.type()
                return
        else:
            self.user_type()
        while self.k[self.i] == "?" and not self.nl[self.i]:
            self.i += 1
        if self.k[self.i] == "&" and not self.nl[self.i]:
            self.i += 1
            self.type()
        if self.k[self.i] == "." and self.k[self.i + 1] == "(":
            self.i += 1
            self.type()

    def type_item(self):
        if self.k[self.i] == "id" and self.k[self.i + 1] == ":":
            self.i += 2
        self.type()

    def user_type(self):
        self.need("id")
        self.type_arguments()
        while self.k[self.i] == "." and self.k[self.i + 1] == "id":
            self.i += 2
            self.type_arguments()

    def type_arguments(self):
        if self.k[self.i] == "<" and not self.nl[self.i]:
            self.i += 1
            while True:
                if not self.eat("*"):
                    if self.k[self.i] == "in" or self.soft("out") and self.k[self.i + 1] == "id":
                        self.i += 1
                    self.type()
                if not self.eat(",") or self.k[self.i] == ">":
                    break
            self.need(">")

    # -- statements
    def block(self):
        self.need("{")
        held, self.inside = self.inside, False
        self.items(self.statement, "}")
        self.inside = held

    def statement(self):
        k = self.k[self.i]
        if k == ";":
            self.i += 1
            return
        if k == "@" or k in ("val", "var", "class", "interface", "typealias") or k == "fun" and self.k[self.i + 1] in ("id", "<", "interface") or k == "object" and self.k[self.i + 1] == "id" or k == "id" and word_at(self, self.i) in _MODIFIER:
            at = self.i
            if self.modifiers() or k != "id" and k != "@":
                if self.declaration(False):
                    return
            if k != "@":
                self.i = at
        if k == "id" and self.k[self.i + 1] == "@" and self.p[self.i + 1] == self.p[self.i] + len(word_at(self, self.i)) and self.k[self.i + 2] in ("for", "while", "do"):
            self.i += 2
            k = self.k[self.i]
        if k == "for":
            self.i += 1
            self.need("(")
            held, self.inside = self.inside, True
            self.annotations()
            if self.eat("("):
                self.listed(self.binding, ")")
            else:
                self.binding()
            self.need("in")
            self.expression()
            self.need(")")
            self.inside = held
            self.controlled()
        elif k == "while":
            self.i += 1
            self.condition()
            self.controlled()
        elif k == "do":
            self.i += 1
            if self.k[self.i] != "while":
                self.controlled(False)
            self.need("while")
            self.condition()
        else:
            self.assignment()
        self.close()

    def assignment(self):
        left = self.expression()
        if self.k[self.i] in _ASSIGN and not self.nl[self.i]:
            if left not in _PLACE:
                self.fail("this can't be assigned to")
            self.i += 1
            self.expression()

    def condition(self):
        self.need("(")
        held, self.inside = self.inside, True
        self.expression()
        self.need(")")
        self.inside = held

    def controlled(self, empty: bool = True):
        """The body of a loop or branch: a block, one statement or nothing before ;"""
        if self.k[self.i] == "{":
            self.block()
        elif empty and self.k[self.i] == ";":
            return
        elif self.k[self.i] in ("for", "while", "do"):
            at = self.i
            self.statement()
            if self.i > at and self.k[self.i - 1] == ";":
                self.i -= 1
        else:
            held, self.inside = self.inside, False
            self.assignment()
            self.inside = held

    # -- expressions
    def operator(self):
        k = self.k[self.i]
        if self.nl[self.i] and not self.inside and k not in ("?:", "&&", "||"):
            return "", 0
        if k == "id" and self.k[self.i + 1] not in ("eof", ")", "}", "]", ",", ";", "=") and not self.nl[self.i + 1]:
            w = word_at(self, self.i)
            if w in ("by", "where", "else") or self.k[self.i + 1] in ("->",):
                return "", 0
            return "infix", 1
        if k == ">" and self.k[self.i + 1] == "=" and self.touching():
            return ">=", 2
        if k == "as" and self.k[self.i + 1] == "?" and self.p[self.i + 1] == self.p[self.i] + 2:
            return "as?", 2
        if k == "?" and self.k[self.i + 1] == ":" and self.touching():
            return "?:", 2
        return k, 1

    def operand(self, op, level):
        if op in ("is", "!is", "as", "as?"):
            self.type()
        else:
            self.binary(level + 1)

    def expression(self) -> str:
        return self.binary(0)

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("-", "+", "!", "++", "--"):
            self.i += 1
            self.unary()
            return "unary"
        if k == "!!":
            self.i += 1
            self.unary()
            return "unary"
        if k == "@":
            self.annotations()
            if self.k[self.i] == "@":
                self.fail()
            return self.unary()
        if k == "id" and self.k[self.i + 1] == "@" and self.k[self.i + 2] == "{":
            self.i += 2
        return self.postfix(self.primary())

    def primary(self) -> str:
        k = self.k[self.i]
        if k == "id":
            self.i += 1
            return "name"
        if k in ("num", "str", "chr", "true", "false", "null"):
            self.i += 1
            return "literal"
        if k == "(":
            self.i += 1
            held, self.inside = self.inside, True
            inner = self.expression()
            self.need(")")
            self.inside = held
            return inner if inner in _PLACE else "paren"
        if k == "this" or k == "super":
            self.i += 1
            if k == "super" and self.k[self.i] == "<":
                self.type_arguments()
            if self.k[self.i] == "@" and self.k[self.i + 1] == "id":
                self.i += 2
            return "this"
        if k == "{":
            self.lambda_()
            return "lambda"
        if k == "if":
            self.i += 1
            self.condition()
            if self.k[self.i] == "else" or self.k[self.i] == ";" and self.k[self.i + 1] == "else":
                pass
            else:
                self.controlled()
            if self.k[self.i] == ";" and self.k[self.i + 1] == "else":
                self.i += 1
            if self.eat("else"):
                self.controlled()
            return "if"
        if k == "when":
            self.when()
            return "when"
        if k == "try":
            self.i += 1
            self.block()
            has = False
            while self.soft("catch"):
                self.i += 1
                has = True
                self.need("(")
                self.annotations()
                self.need("id")
                self.need(":")
                self.type()
                self.eat(",")
                self.need(")")
                self.block()
            if self.soft("finally"):
                self.i += 1
                has = True
                self.block()
            if not has:
                self.fail("try without catch or finally")
            return "try"
        if k in ("return", "throw", "break", "continue"):
            self.i += 1
            if k != "throw" and self.k[self.i] == "@" and self.k[self.i + 1] == "id":
                self.i += 2
            if k == "throw" or k == "return" and self.same() and self.k[self.i] not in ("}", ")", "]", ";", "eof", ",", "else", "?:"):
                self.expression()
            return "jump"
        if k == "object":
            self.i += 1
            self.supers()
            self.class_body(True)
            return "object"
        if k == "fun":
            self.function(False)
            return "function"
        if k == "[":
            self.i += 1
            self.within(self.expression, "]")
            return "array"
        if k == "::":
            self.i += 1
            if not self.eat("class"):
                self.need("id")
            return "reference"
        self.fail()

    def when(self):
        self.i += 1
        if self.eat("("):
            held, self.inside = self.inside, True
            self.annotations()
            if self.eat("val"):
                self.need("id")
                if self.eat(":"):
                    self.type()
                self.need("=")
            self.expression()
            self.need(")")
            self.inside = held
        self.need("{")
        held, self.inside = self.inside, False
        self.items(self.branch, "}")
        self.inside = held

    def branch(self):
        if not self.eat("else"):
            while True:
                k = self.k[self.i]
                if k in ("in", "!in"):
                    self.i += 1
                    self.expression()
                elif k in ("is", "!is"):
                    self.i += 1
                    self.type()
                else:
                    self.expression()
                if not self.eat(",") or self.k[self.i] == "->":
                    break
        self.need("->")
        self.controlled()
        while self.eat(";"):
            pass

    def lambda_(self):
        self.need("{")
        held, self.inside = self.inside, False
        at = self.i
        if not (self.eat("->") or self.k[self.i] in ("id", "(") and self.attempt(self.lambda_parameters)):
            self.i = at
        self.items(self.statement, "}")
        self.inside = held

    def lambda_parameters(self):
        while True:
            if self.eat("("):
                self.listed(self.binding, ")")
                if self.eat(":"):
                    self.type()
            else:
                self.binding()
            if not self.eat(",") or self.k[self.i] == "->":
                break
        self.need("->")

    def arguments(self):
        self.need("(")
        self.within(self.argument, ")")

    def argument(self):
        if self.k[self.i] == "id" and self.k[self.i + 1] == "=":
            self.i += 2
        self.eat("*")
        self.expression()

    def postfix(self, left: str) -> str:
        while True:
            k = self.k[self.i]
            fresh = self.nl[self.i] and not self.inside
            if k in (".", "?.") or k == "?" and self.k[self.i + 1] == "." and self.touching():
                self.i += 1 + (k == "?")
                if self.k[self.i] == "id" or self.k[self.i] == "class":
                    self.i += 1
                    left = "member"
                elif self.k[self.i] == "(":
                    self.i += 1
                    self.expression()
                    self.need(")")
                    left = "call"
                else:
                    self.fail("expected a name")
            elif k == "::" and not fresh:
                self.i += 1
                if not self.eat("class"):
                    self.need("id")
                left = "reference"
            elif fresh:
                return left
            elif k == "(":
                self.arguments()
                left = "call"
            elif k == "[":
                self.i += 1
                self.within(self.expression, "]")
                left = "index"
            elif k == "{" and left in ("name", "member", "call", "reference", "index") and not self.headless:
                self.lambda_()
                left = "call"
            elif k == "id" and self.k[self.i + 1] == "@" and self.k[self.i + 2] == "{" and left in ("name", "member", "call"):
                self.i += 2
                self.lambda_()
                left = "call"
            elif k in ("++", "--", "!!"):
                self.i += 1
                left = "name" if k == "!!" and left in _PLACE else "step" if k != "!!" else "call"
            elif k == "<" and left in ("name", "member") and self.generic():
                left = "call"
            elif k == "?" and self.k[self.i + 1] == "::":
                self.i += 1
            else:
                return left

    headless = False

    def generic(self) -> bool:
        at = self.i
        try:
            self.type_arguments()
            if self.k[self.i] in ("(", "{", "::", ".", "?.") and not self.nl[self.i]:
                return True
        except Broken:
            pass
        self.i = at
        return False
