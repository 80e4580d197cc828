"""SQL/JSON path text to the common syntax tree, by recursive descent.

Steps become calls of builtins named "path:...", which know lax mode (arrays are unwrapped, scalars
wrapped, structural errors dropped) and strict mode; see docql.functions.sqljson.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from docql.plans import nodes as N
from docql.plans.parser import ESCAPES, ProgramError

SCAN = re.compile(
    r"""(?P<space>\s+|/\*.*?\*/)
      |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<string>"(?:[^"\\]|\\.)*")
      |(?P<variable>\$[A-Za-z_]\w*|\$"(?:[^"\\]|\\.)*")
      |(?P<name>[^\W\d]\w*)
      |(?P<sign>\*\*|&&|\|\||==|!=|<>|<=|>=|[][(){}.,?@$*/%+<>!-])""",
    re.X | re.S,
)
METHODS = frozenset("size type double ceiling floor abs keyvalue string boolean number integer bigint".split())
COMPARISONS = {"==": "==", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def scan(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = SCAN.match(text, at)
        if m is None:
            raise ProgramError(f"unexpected {text[at]!r} at {at} of the path")
        at = m.end()
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], m.start()))
    return [*out, Token("end", "", at)]


def unquoted(raw: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)


def call(name: str, *args: N.Node) -> N.Call:
    return N.Call(f"path:{name}", args)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = scan(text), 0
        self.lax = True
        if self.peek().text in ("lax", "strict") and self.peek(1).kind != "end":
            self.lax = self.next().text == "lax"

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def took(self, *texts: str) -> bool:
        if self.peek().kind in ("sign", "name") and self.peek().text in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.took(text):
            raise ProgramError(f"expected {text!r} at {self.peek().at} of the path")

    def program(self) -> N.Node:
        out = self.predicate()
        if self.peek().kind != "end":
            raise ProgramError(f"unexpected {self.peek().text!r} at {self.peek().at} of the path")
        return N.Bind(N.Identity(), (N.VarPattern("$"),), call("run", N.Literal(self.lax), out))

    # Predicates are calls of "path:test", whose value is true, false or null (unknown).

    def predicate(self) -> N.Node:
        left = self.conjunction()
        while self.took("||"):
            left = call("or", left, self.conjunction())
        return left

    def conjunction(self) -> N.Node:
        left = self.negation()
        while self.took("&&"):
            left = call("and", left, self.negation())
        return left

    def negation(self) -> N.Node:
        if self.took("!"):
            self.need("(")
            inner = self.predicate()
            self.need(")")
            return self.known(call("not", inner))
        if self.peek().text == "exists" and self.peek(1).text == "(":
            self.at += 2
            inner = self.predicate()
            self.need(")")
            return self.known(call("exists", inner))
        left = self.sum()
        t = self.peek()
        if t.kind == "sign" and t.text in COMPARISONS:
            self.next()
            return self.known(call("compare", N.Literal(COMPARISONS[t.text]), left, self.sum()))
        if self.took("starts"):
            self.need("with")
            return self.known(call("starts", left, self.sum()))
        if self.took("like_regex"):
            pattern = unquoted(self.next().text)
            flags = unquoted(self.next().text) if self.took("flag") else ""
            return self.known(call("like", left, N.Literal(pattern), N.Literal(flags)))
        return self.known(left)

    def known(self, n: N.Node) -> N.Node:
        if self.peek().text == "is" and self.peek(1).text == "unknown":
            self.at += 2
            return call("unknown", n)
        return n

    def sum(self) -> N.Node:
        left = self.product()
        while self.peek().kind == "sign" and self.peek().text in "+-":
            op = self.next().text
            left = call("arithmetic", N.Literal(op), left, self.product())
        return left

    def product(self) -> N.Node:
        left = self.unary()
        while self.peek().kind == "sign" and self.peek().text in ("*", "/", "%"):
            op = self.next().text
            left = call("arithmetic", N.Literal(op), left, self.unary())
        return left

    def unary(self) -> N.Node:
        if self.took("-", "+"):
            op = self.tokens[self.at - 1].text
            return call("sign", N.Literal(op), self.unary())
        return self.steps(self.primary())

    def primary(self) -> N.Node:
        t = self.next()
        if t.kind == "number":
            v = float(t.text)
            return N.Literal(int(v) if v.is_integer() else v)
        if t.kind == "string":
            return N.Literal(unquoted(t.text))
        if t.kind == "variable":
            return N.Variable(unquoted(t.text[1:]) if t.text[1] == '"' else t.text[1:])
        if t.text in ("true", "false", "null"):
            return N.Literal({"true": True, "false": False, "null": None}[t.text])
        if t.text == "$":
            return N.Variable("$")
        if t.text == "@":
            return N.Identity()
        if t.text == "last":
            return N.Variable("last")
        if t.text == "(":
            inner = self.predicate()
            self.need(")")
            return inner
        raise ProgramError(f"unexpected {t.text or 'end'!r} at {t.at} of the path")

    def steps(self, n: N.Node) -> N.Node:
        lax = N.Literal(self.lax)
        while True:
            if self.took("."):
                if self.took("**"):
                    low, high = 0, None
                    if self.took("{"):
                        low = self.level()
                        high = self.level() if self.took("to") else low
                        self.need("}")
                    n = call("descend", n, N.Literal(low), N.Literal(high))
                    continue
                if self.took("*"):
                    n = call("values", lax, n)
                    continue
                t = self.next()
                if t.kind == "string":
                    n = call("member", lax, n, N.Literal(unquoted(t.text)))
                elif t.kind in ("name",):
                    if self.peek().text == "(":
                        self.at += 1
                        self.need(")")
                        if t.text not in METHODS:
                            raise ProgramError(f"the method {t.text}() is not supported")
                        n = call("method", lax, n, N.Literal(t.text))
                    else:
                        n = call("member", lax, n, N.Literal(t.text))
                else:
                    raise ProgramError(f"unexpected {t.text!r} at {t.at} of the path")
            elif self.took("["):
                if self.took("*"):
                    self.need("]")
                    n = call("elements", lax, n)
                    continue
                places: list[N.Node] = []
                while True:
                    a = self.sum()
                    places += [a, self.sum() if self.took("to") else N.Literal(None)]
                    if not self.took(","):
                        break
                self.need("]")
                n = call("places", lax, n, *places)
            elif self.took("?"):
                self.need("(")
                inner = self.predicate()
                self.need(")")
                n = call("filter", lax, n, inner)
            else:
                return n

    def level(self) -> int | None:
        return None if self.took("last") else int(self.next().text)


def translate(text: str) -> N.Node:
    """All matches of the path; `lax` (also where nothing is said) or `strict` may stand before it."""
    return Parser(text.strip() or "$").program()


def first_of(n: N.Node) -> N.Node:
    return N.Call("first", (n,))


def array_of(n: N.Node) -> N.Node:
    return N.Collect(n)
