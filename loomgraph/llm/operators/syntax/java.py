"""Java 17."""

from __future__ import annotations

import re

from .base import Parser, scan, word_at

_GAP = re.compile(r"(?:[\s\x1a]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TOKEN = re.compile(
    r'''(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?(?!\w)|0[bB][01_]+[lL]?(?!\w)|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?[fFdDlL]?(?![\w])|\d[\d_]*\.(?:[eE][+-]?\d+)?[fFdD]?(?!\w))'''
    r'''|(?P<str>"""[ \t\f]*\r?\n(?:\\.|[^\\"]|"(?!""))*"""|"(?!"")(?:\\(?:[btnfrs0-7"'\\]|u+[\da-fA-F]{4})|[^"\\\n\r])*"|""(?!"))|(?P<chr>'(?:\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4})|[^'\\\n\r])')'''
    r"""|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||[=!<+\-*/&|^%]=|<<=?|[-+*/%=<>!~?:;,.(){}\[\]@&|^])"""
)
_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_MODIFIER = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_LITERAL = frozenset(["num", "str", "chr", "true", "false", "null"])
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())
_STATEMENT = frozenset(["call", "assign", "step", "new"])
_PLACE = frozenset(["name", "member", "index"])


class Java(Parser):
    SPECIAL = frozenset()
    STARTS = frozenset("if for while do try return throw switch break continue class interface enum public private protected static final import package @".split())
    LEVELS = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}

    def lex(self):
        scan(self, _TOKEN, _GAP, _WORDS)

    def word(self, *words: str) -> bool:
        return self.k[self.i] == "id" and word_at(self, self.i) in words

    # -- declarations
    def text(self):
        at = self.i
        if not self.attempt(self.package):
            self.i = at
        self.items(self.top, "eof")

    def package(self):
        self.annotations()
        self.need("package")
        self.name()
        self.need(";")

    def top(self):
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k == "import":
            self.i += 1
            self.eat("static")
            self.need("id")
            while self.eat("."):
                if self.eat("*"):
                    break
                self.need("id")
            self.need(";")
        elif self.word("module", "open") and self.k[self.i + 1] == "id":
            self.i += 1 + (word_at(self, self.i) == "open")
            self.name()
            self.need("{")
            while not self.eat("}"):
                while not self.eat(";"):
                    if self.k[self.i] in ("eof", "{", "}"):
                        self.fail()
                    self.i += 1
        else:
            self.modifiers()
            if not self.type_declaration():
                self.fail()

    def name(self):
        self.need("id")
        while self.k[self.i] == "." and self.k[self.i + 1] == "id":
            self.i += 2

    def annotations(self):
        while self.k[self.i] == "@" and self.k[self.i + 1] != "interface":
            self.i += 1
            self.name()
            if self.eat("("):
                self.listed(self.annotation_value, ")")

    def annotation_value(self):
        if self.k[self.i] == "id" and self.k[self.i + 1] == "=":
            self.i += 2
        self.element()

    def element(self):
        if self.k[self.i] == "@":
            self.annotations()
        elif self.eat("{"):
            self.listed(self.element, "}")
        else:
            self.ternary()

    def modifiers(self):
        while True:
            k = self.k[self.i]
            if k == "@" and self.k[self.i + 1] != "interface":
                self.annotations()
            elif k in _MODIFIER and not (k == "default" and self.k[self.i + 1] in (":", "->")):
                self.i += 1
            elif k == "id" and word_at(self, self.i) == "sealed" and self.k[self.i + 1] in ("class", "interface", "abstract", "public", "static", "id"):
                if self.k[self.i + 1] == "id" and word_at(self, self.i + 1) not in ("record",):
                    return
                self.i += 1
            elif k == "id" and word_at(self, self.i) == "non" and self.k[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def type_declaration(self) -> bool:
        k = self.k[self.i]
        if k in ("class", "interface", "enum"):
            self.i += 1
        elif k == "@" and self.k[self.i + 1] == "interface":
            self.i += 2
            self.need("id")
            self.body(True)
            return True
        elif k == "id" and self.k[self.i + 1] == "id" and self.k[self.i + 2] in ("(", "<") and word_at(self, self.i) == "record":
            self.i += 2
            self.type_parameters()
            self.parameters()
            k = "record"
        else:
            return False
        if k != "record":
            self.need("id")
            self.type_parameters()
        if self.eat("extends"):
            self.types()
        if self.eat("implements"):
            self.types()
        if self.word("permits"):
            self.i += 1
            self.types()
        if k == "enum":
            self.need("{")
            while self.k[self.i] not in (";", "}"):
                self.annotations()
                self.need("id")
                if self.eat("("):
                    self.listed(self.expression, ")")
                if self.k[self.i] == "{":
                    self.body(False)
                if not self.eat(","):
                    break
            if not self.eat(";"):
                self.need("}")
                return True
            self.items(self.member, "}")
        else:
            self.body(k == "interface")
        return True

    def types(self):
        self.type()
        while self.eat(","):
            self.type()

    def type_parameters(self):
        if self.eat("<"):
            while True:
                self.annotations()
                self.need("id")
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def type(self):
        self.annotations()
        k = self.k[self.i]
        if k in _PRIMITIVE:
            self.i += 1
        else:
            self.need("id")
            self.type_arguments()
            while self.k[self.i] == "." and self.k[self.i + 1] in ("id", "@"):
                self.i += 1
                self.annotations()
                self.need("id")
                self.type_arguments()
        self.dims()

    def dims(self):
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]" or self.k[self.i] == "@" and self.k[self.i + 1] == "id" and self.k[self.i + 2] == "[":
            self.annotations()
            self.i += 2

    def type_arguments(self):
        if self.eat("<"):
            if self.eat(">"):
                return
            while True:
                self.annotations()
                if self.eat("?"):
                    if self.k[self.i] in ("extends", "super"):
                        self.i += 1
                        self.type()
                else:
                    self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def body(self, interface: bool):
        self.need("{")
        self.items(self.member, "}")

    def member(self):
        k = self.k[self.i]
        if k == ";":
            self.i += 1
            return
        if k == "{" or k == "static" and self.k[self.i + 1] == "{":
            self.i += k == "static"
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.k[self.i] == "id" and self.k[self.i + 1] in ("(", "{"):  # constructor, also of a record
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        if not self.eat("void"):
            self.type()
        self.need("id")
        if self.k[self.i] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.element()
            if self.k[self.i] == "{":
                self.block()
            else:
                self.need(";")
            return
        self.i -= 1
        self.variables()
        self.need(";")

    def throws(self):
        if self.eat("throws"):
            self.types()

    def parameters(self):
        self.need("(")
        if self.eat(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            self.eat("...")
            if not self.eat("this"):
                self.need("id")
                if self.k[self.i] == "." and self.k[self.i + 1] == "this":
                    self.i += 2
            self.dims()
            if not self.eat(","):
                break
        self.need(")")

    def variables(self):
        while True:
            self.need("id")
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return

    def initializer(self):
        if self.eat("{"):
            self.listed(self.initializer, "}")
        else:
            self.expression()

    # -- statements
    def block(self):
        self.need("{")
        self.items(self.statement, "}")

    def local(self) -> bool:
        """Whether a declaration of variables begins here; a type and a name are read ahead."""
        k = self.k
        if k[self.i] in _PRIMITIVE:
            return k[self.i + 1] not in (".", "::") and not (k[self.i + 1] == "[" and k[self.i + 2] == "]" and k[self.i + 3] in ("::", "."))
        if k[self.i] != "id":
            return False
        n = k[self.i + 1]
        if n == "id":
            return True
        if n not in ("<", ".", "["):
            return False
        at = self.i
        ok = self.attempt(self.type) and k[self.i] == "id" and k[self.i + 1] in ("=", ";", ",", ":", "[")
        self.i = at
        return ok

    def declaration(self):
        self.modifiers()
        if self.type_declaration():
            return
        self.type()
        self.variables()
        self.need(";")

    def statement(self):
        k = self.k[self.i]
        simple = self.SIMPLE.get(k)
        if simple:
            simple(self)
        elif k == "id" and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k in ("final", "abstract", "static", "class", "interface", "enum", "strictfp") or k == "@" or self.word("record", "sealed") and self.k[self.i + 1] in ("id", "class", "interface") and self.k[self.i + 2] in ("(", "<", "{", "id"):
            self.declaration()
        elif k == "id" and word_at(self, self.i) == "yield" and self.k[self.i + 1] not in ("=", ".", "[", "(", "++", "--", "+=", "-="):
            self.i += 1
            self.expression()
            self.need(";")
        elif self.local():
            self.declaration()
        else:
            if self.expression() not in _STATEMENT:
                self.fail("not a statement")
            self.need(";")

    def condition(self):
        self.need("(")
        self.expression()
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
        self.need(";")

    def s_for(self):
        self.i += 1
        self.need("(")
        if not self.eat(";"):
            at = self.i
            if self.k[at] in ("final", "@") or self.local():
                self.modifiers()
                self.type()
                if self.k[self.i] == "id" and self.k[self.i + 1] == ":":
                    self.i += 2
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
                self.variables()
            else:
                self.expressions()
            self.need(";")
        if not self.eat(";"):
            self.expression()
            self.need(";")
        if self.k[self.i] != ")":
            self.expressions()
        self.need(")")
        self.statement()

    def expressions(self):
        self.expression()
        while self.eat(","):
            self.expression()

    def s_try(self):
        self.i += 1
        has = False
        if self.eat("("):
            has = True
            while not self.eat(")"):
                if self.k[self.i] in ("final", "@") or self.local():
                    self.modifiers()
                    self.type()
                    self.need("id")
                    self.need("=")
                self.expression()
                if not self.eat(";"):
                    self.need(")")
                    break
        self.block()
        while self.eat("catch"):
            has = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.need("id")
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
        self.switch_body()
        if self.k[self.i] == ".":
            self.fail()

    def switch_body(self):
        self.need("{")
        self.items(self.case, "}")

    def case(self):
        k = self.k[self.i]
        if k == "default" and self.k[self.i + 1] in (":", "->"):
            self.i += 1
        elif k == "case":
            self.i += 1
            while True:
                if not self.eat("default"):
                    if self.local():
                        self.type()
                        self.need("id")
                    else:
                        self.ternary()
                if not self.eat(","):
                    break
        else:
            self.statement()
            return
        if self.eat("->"):
            if self.k[self.i] in ("{", "throw"):
                self.statement()
            else:
                self.expression()
                self.need(";")
        else:
            self.need(":")

    def s_return(self):
        self.i += 1
        if not self.eat(";"):
            self.expression()
            self.need(";")

    def s_throw(self):
        self.i += 1
        self.expression()
        self.need(";")

    def s_jump(self):
        self.i += 1
        self.eat("id")
        self.need(";")

    def s_assert(self):
        self.i += 1
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    def s_sync(self):
        self.i += 1
        self.condition()
        self.block()

    def s_empty(self):
        self.i += 1

    SIMPLE = {"{": block, ";": s_empty, "if": s_if, "while": s_while, "do": s_do, "for": s_for, "try": s_try, "switch": s_switch, "return": s_return, "throw": s_throw, "break": s_jump, "continue": s_jump, "assert": s_assert, "synchronized": s_sync}

    # -- expressions
    def operator(self):
        k = self.k[self.i]
        if k == ">":
            n = 1
            while n < 3 and self.k[self.i + n] == ">" and self.p[self.i + n] == self.p[self.i] + n:
                n += 1
            if self.k[self.i + n] == "=" and self.p[self.i + n] == self.p[self.i] + n:
                return ">" * n + "=", n + 1
            return ">" * n, n
        return k, 1

    def operand(self, op, level):
        if op == "instanceof":
            self.eat("final")
            self.annotations()
            self.type()
            self.eat("id")
        else:
            self.binary(level + 1)

    def expression(self) -> str:
        k, nxt = self.k[self.i], self.k[self.i + 1]
        if k == "id" and nxt == "->":
            self.i += 2
            return self.lambda_body()
        if k == "(" and self.is_lambda():
            return self.lambda_body()
        left = self.ternary()
        op, n = self.operator()
        if op in _ASSIGN:
            if left not in _PLACE:
                self.fail("this can't be assigned to")
            self.i += n
            self.expression()
            return "assign"
        return left

    def is_lambda(self) -> bool:
        """Takes the parameters and the arrow of a lambda, if there is one here."""
        k, at = self.k, self.i
        n = k[at + 1]
        if not (n == ")" and k[at + 2] == "->" or n in _PRIMITIVE or n in ("final", "@") or n == "id" and k[at + 2] in (",", ")", "id", "<", ".", "[", "...")):
            return False
        self.i += 1
        if n == "id" and k[at + 2] in (",", ")"):
            while self.k[self.i] == "id":
                self.i += 1
                if not self.eat(","):
                    break
            if self.eat(")") and self.eat("->"):
                return True
        self.i = at
        if self.attempt(self.parameters) and self.eat("->"):
            return True
        self.i = at
        return False

    def lambda_body(self) -> str:
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()
        return "lambda"

    def ternary(self) -> str:
        left = self.binary(0)
        if self.eat("?"):
            self.branch()
            self.need(":")
            self.branch()
            return "ternary"
        return left

    def branch(self):
        k = self.k[self.i]
        if k == "id" and self.k[self.i + 1] == "->" or k == "(":
            self.expression()
        else:
            self.ternary()

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("++", "--"):
            self.i += 1
            if self.unary() not in _PLACE:
                self.fail("nothing to step")
            return "step"
        if k in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "unary"
        if k == "(" and self.cast():
            return "cast"
        return self.postfix(self.primary())

    def cast(self) -> bool:
        at, k = self.i, self.k
        n = k[at + 1]
        if n not in _PRIMITIVE and n != "id" and n != "@":
            return False
        self.i += 1

        def types():
            self.type()
            while self.eat("&"):
                self.type()
            self.need(")")

        if self.attempt(types):
            f = k[self.i]
            if n in _PRIMITIVE and k[self.i - 2] in _PRIMITIVE or f in ("id", "(", "!", "~", "this", "super", "new", "switch") or f in _LITERAL or f in _PRIMITIVE:
                if n not in _PRIMITIVE and f == "id" and self.k[self.i + 1] == "->" or f == "(":
                    here = self.i
                    if f == "id" or self.is_lambda():
                        self.i = here
                        self.expression()
                        return True
                    self.i = here
                self.unary()
                return True
        self.i = at
        return False

    def primary(self) -> str:
        k = self.k[self.i]
        if k == "id":
            self.i += 1
            if self.k[self.i] == "(":
                self.arguments()
                return "call"
            if self.k[self.i] in ("<", "[") and self.generic_reference():
                return "lambda"
            return "name"
        if k in _LITERAL:
            self.i += 1
            return "literal"
        if k == "(":
            self.i += 1
            inner = self.expression()
            self.need(")")
            return inner if inner in _PLACE else "paren"
        if k == "new":
            return self.new()
        if k == "this":
            self.i += 1
            if self.k[self.i] == "(":
                self.arguments()
                return "call"
            return "this"
        if k == "super":
            self.i += 1
            if self.k[self.i] == "(":
                self.arguments()
                return "call"
            if self.k[self.i] not in (".", "::"):
                self.fail()
            return "this"
        if k == "switch":
            self.i += 1
            self.condition()
            self.switch_body()
            return "switch"
        if k in _PRIMITIVE or k == "void":
            self.i += 1
            self.dims()
            if self.eat("::"):
                self.need("new")
                return "lambda"
            self.need(".")
            self.need("class")
            return "literal"
        self.fail()

    def generic_reference(self) -> bool:
        """``List<String>::new``, ``int[]::new``, ``String[].class`` behind a name."""
        at = self.i
        if not self.attempt(lambda: (self.type_arguments(), self.dims())) or self.i == at:
            self.i = at
            return False
        if self.eat("::"):
            if self.k[self.i] in ("id", "new"):
                self.i += 1
                return True
        elif self.k[self.i] == "." and self.k[self.i + 1] == "class" and self.k[self.i - 1] == "]":
            self.i += 2
            return True
        self.i = at
        return False

    def arguments(self):
        self.need("(")
        if self.eat(")"):
            return
        while True:
            self.expression()
            if not self.eat(","):
                break
        self.need(")")

    def new(self) -> str:
        self.i += 1
        self.type_arguments()
        self.annotations()
        if self.k[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            self.need("id")
            self.type_arguments()
            while self.eat("."):
                self.need("id")
                self.type_arguments()
        if self.k[self.i] == "[":
            sized = False
            while self.k[self.i] == "[":
                self.i += 1
                if self.eat("]"):
                    continue
                self.expression()
                sized = True
                self.need("]")
            if self.k[self.i] == "{":
                self.initializer()
            elif not sized:
                self.fail("an array without size")
            return "array"
        self.arguments()
        if self.k[self.i] == "{":
            self.body(False)
        return "new"

    def postfix(self, left: str) -> str:
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                n = self.k[self.i]
                if n == "id":
                    self.i += 1
                    if self.k[self.i] == "(":
                        self.arguments()
                        left = "call"
                    elif self.k[self.i] in ("<", "[") and left in ("name", "member") and self.generic_reference():
                        left = "lambda"
                    else:
                        left = "member"
                elif n == "<":
                    self.type_arguments()
                    self.i += self.k[self.i] in ("super", "this")
                    self.eat("id")
                    self.arguments()
                    left = "call"
                elif n == "new":
                    left = self.new()
                elif n in ("this", "class"):
                    self.i += 1
                    left = "this"
                elif n == "super":
                    self.i += 1
                    if self.k[self.i] == "(":
                        self.arguments()
                        left = "call"
                else:
                    self.fail()
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                left = "index"
            elif k == "::":
                self.i += 1
                self.type_arguments()
                if not self.eat("new"):
                    self.need("id")
                left = "lambda"
            elif k in ("++", "--"):
                if left not in _PLACE:
                    self.fail("nothing to step")
                self.i += 1
                left = "step"
            else:
                return left
