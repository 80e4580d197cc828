"""JSONata text to the common syntax tree, by an operator-precedence parser.

What JSONata does otherwise than the common language (paths that map over arrays, sequences, missing
values, its functions) becomes calls of builtins whose names begin with "jsonata:"; see docql.functions.jsonata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from docql.plans import nodes as N
from docql.plans.parser import ESCAPES, ProgramError

SCAN = re.compile(
    r"""(?P<space>\s+|/\*.*?\*/)
      |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      |(?P<quoted>`[^`]*`)
      |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      |(?P<variable>\$\$|\$[A-Za-z_]\w*|\$)
      |(?P<name>[^\W\d]\w*)
      |(?P<sign>\*\*|\.\.|:=|!=|<=|>=|~>|\?\?|\?:|[][(){}.,:;?&+*/%<>=^@\#|-])""",
    re.X | re.S,
)
#: Binding powers of infix signs.
POWER = {"[": 80, "(": 80, ".": 75, "{": 70, "*": 60, "/": 60, "%": 60, "+": 50, "-": 50, "&": 50, "=": 40, "!=": 40, "<": 40, "<=": 40, ">": 40, ">=": 40, "~>": 40, "in": 40, "and": 30, "or": 25, "?": 20, "??": 20, "?:": 20, "..": 20, ":=": 10, "^": 75}
OPERATORS = {"+", "-", "*", "/", "%"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def text_of(raw: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "u":
            return chr(int(e[1:], 16))
        if e not in ESCAPES and e != "'":
            raise ProgramError(f"unsupported escape \\{e}")
        return ESCAPES.get(e, e)

    out = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", one, raw[1:-1], flags=re.S)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def call(name: str, *args: N.Node) -> N.Call:
    return N.Call(f"jsonata:{name}", args)


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.token = self.read(True)

    def read(self, start: bool) -> Token:
        """The next token; at the start of an operand a slash opens a regular expression."""
        while True:
            if self.at >= len(self.text):
                return Token("end", "", self.at)
            if start and self.text[self.at] == "/" and self.text[self.at : self.at + 2] != "/*":
                m = re.compile(r"/((?:[^/\\]|\\.)+)/([im]*)").match(self.text, self.at)
                if m is None:
                    raise ProgramError(f"unterminated regular expression at {self.at}")
                self.at = m.end()
                return Token("regex", (f"(?{m[2]})" if m[2] else "") + m[1], m.start())
            m = SCAN.match(self.text, self.at)
            if m is None:
                raise ProgramError(f"unexpected {self.text[self.at]!r} at {self.at}")
            self.at = m.end()
            if m.lastgroup != "space":
                return Token(m.lastgroup, m[0], m.start())

    def take(self, start: bool = False) -> Token:
        t = self.token
        self.token = self.read(start)
        return t

    def need(self, sign: str, start: bool = False) -> None:
        if self.token.text != sign or self.token.kind != "sign":
            raise ProgramError(f"expected {sign!r} but found {self.token.text or 'the end'!r} at {self.token.at}")
        self.take(start)

    def sees(self, sign: str) -> bool:
        return self.token.kind == "sign" and self.token.text == sign

    def program(self) -> N.Node:
        out = self.expression(0)
        if self.token.kind != "end":
            raise ProgramError(f"unexpected {self.token.text!r} at {self.token.at}")
        return N.Bind(N.Identity(), (N.VarPattern("$"),), out)

    def expression(self, power: int) -> N.Node:
        left = self.prefix()
        while True:
            t = self.token
            word = t.text if t.kind == "sign" or t.kind == "name" and t.text in ("and", "or", "in") else None
            if word is None or POWER.get(word, 0) <= power:
                return left
            left = self.infix(left, word)

    def prefix(self) -> N.Node:
        t = self.take()
        if t.kind == "number":
            v = float(t.text)
            return N.Literal(int(v) if v.is_integer() else v)
        if t.kind == "string":
            return N.Literal(text_of(t.text))
        if t.kind == "regex":
            return call("regex", N.Literal(t.text))
        if t.kind == "quoted":
            return call("field", N.Literal(t.text[1:-1]))
        if t.kind == "variable":
            return N.Identity() if t.text == "$" else call("variable", N.Literal(t.text[1:]))
        if t.kind == "name":
            if t.text in ("true", "false", "null"):
                return N.Literal({"true": True, "false": False, "null": None}[t.text])
            if t.text in ("function", "λ") and self.sees("("):
                return self.function()
            return call("field", N.Literal(t.text))
        if t.text == "-":
            return call("negate", self.expression(70))
        if t.text == "*":
            return call("wildcard")
        if t.text == "**":
            return call("descendants")
        if t.text == "(":
            return self.block()
        if t.text == "[":
            return self.array()
        if t.text == "{":
            return self.object(None)
        raise ProgramError(f"unexpected {t.text or 'end'!r} at {t.at}")

    def block(self) -> N.Node:
        parts: list[N.Node] = []
        while not self.sees(")"):
            parts.append(self.expression(0))
            if not self.sees(";"):
                break
            self.take(True)
        self.need(")")
        out: N.Node | None = None
        for p in reversed(parts):
            made = [p]  # of $a := $b := e the inner assignment comes first
            while isinstance(made[0], N.Bind) and isinstance(made[0].source.args[1], N.Bind):
                made.insert(0, made[0].source.args[1])
            for q in reversed(made):
                if isinstance(q, N.Bind):
                    source = q.source if q is made[0] else call("assign", q.source.args[0], q.source.args[1].body)
                    out = N.Bind(source, q.patterns, q.body if out is None else out)
                elif out is None:
                    out = q
        return call("block", out or N.Literal(None))

    def array(self) -> N.Node:
        items = []
        while not self.sees("]"):
            v = self.expression(20)
            if self.sees(".."):
                self.take(True)
                v = call("range", v, self.expression(20))
            items.append(v)
            if not self.sees(","):
                break
            self.take(True)
        self.need("]")
        return call("array", *items)

    def object(self, source: N.Node | None) -> N.Node:
        parts = []
        while not self.sees("}"):
            key = self.expression(0)
            self.need(":", True)
            parts += [key, self.expression(0)]
            if not self.sees(","):
                break
            self.take(True)
        self.need("}")
        return call("object", *parts) if source is None else call("group", source, *parts)

    def function(self) -> N.Node:
        self.need("(", True)
        names = []
        while not self.sees(")"):
            names.append(self.take().text[1:])
            if self.sees(","):
                self.take(True)
        self.need(")")
        if self.sees("<"):  # a signature says nothing that is needed
            while not self.sees("{"):
                self.take()
        self.need("{", True)
        body = self.expression(0)
        self.need("}")
        return call("lambda", N.Literal(tuple(names)), body)

    def arguments(self) -> list[N.Node]:
        args = []
        while not self.sees(")"):
            if self.sees("?"):
                raise ProgramError("partial application is not supported")
            args.append(self.expression(0))
            if not self.sees(","):
                break
            self.take(True)
        self.need(")")
        return args

    def infix(self, left: N.Node, sign: str) -> N.Node:
        self.take(True)
        if sign == ".":
            right = self.expression(75)
            return call("map", left, call("field", right) if isinstance(right, N.Literal) and isinstance(right.value, str) else right)
        if sign == "[":
            if self.sees("]"):
                self.take()
                return call("keep", left)
            inner = self.expression(0)
            self.need("]")
            return call("filter", left, inner)
        if sign == "(":
            args = self.arguments()
            return call("call", left, *args)
        if sign == "{":
            return self.object(left)
        if sign == "^":
            self.need("(", True)
            keys = []
            while True:
                down = self.sees(">")
                if down or self.sees("<"):
                    self.take(True)
                keys += [N.Literal(down), self.expression(0)]
                if not self.sees(","):
                    break
                self.take(True)
            self.need(")")
            return call("sort", left, *keys)
        if sign == "?":
            then = self.expression(0)
            other: N.Node = N.Literal(None)
            if self.sees(":"):
                self.take(True)
                other = self.expression(0)
            return N.If(call("boolean", left), then, other)
        if sign in ("??", "?:"):
            right = self.expression(20)
            return call("default" if sign == "?:" else "coalesce", left, right)
        if sign == "..":
            return call("range", left, self.expression(20))
        if sign == ":=":
            if not (isinstance(left, N.Call) and left.name == "jsonata:variable"):
                raise ProgramError("only a variable can be assigned")
            return N.Bind(call("assign", left.args[0], self.expression(9)), (N.VarPattern(left.args[0].value),), left)
        if sign == "~>":
            right = self.expression(40)
            if isinstance(right, N.Call) and right.name == "jsonata:call":
                return N.Call(right.name, (right.args[0], left, *right.args[1:]))
            return call("call", right, left)
        right = self.expression(POWER[sign])
        if sign in OPERATORS:
            return call("arithmetic", N.Literal(sign), left, right)
        if sign == "&":
            return call("concat", left, right)
        if sign in ("and", "or"):
            return N.Logic(sign, call("boolean", left), call("boolean", right))
        if sign == "in":
            return call("in", left, right)
        return call("compare", N.Literal("==" if sign == "=" else sign), left, right)


def translate(text: str) -> N.Node:
    return Parser(text).program()
