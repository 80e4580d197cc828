"""Text of a program to its syntax tree: a regular-expression scanner and recursive descent."""

from __future__ import annotations

import re
from dataclasses import dataclass

from docql.plans.nodes import (
    Alternative,
    Arithmetic,
    ArrayPattern,
    Assign,
    Bind,
    Break,
    Build,
    Call,
    Collect,
    Comma,
    Compare,
    Define,
    Field,
    Foreach,
    Format,
    Identity,
    If,
    Index,
    Interpolate,
    Iterate,
    Label,
    Literal,
    Logic,
    Negate,
    Node,
    ObjectPattern,
    Pipe,
    RecurseAll,
    Reduce,
    Slice,
    Try,
    Variable,
    VarPattern,
)


class ProgramError(ValueError):
    """The program can't be understood."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    value: object = None


KEYWORDS = frozenset("if then elif else end try catch reduce foreach as def label break and or import include".split())
SCAN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<field>\.[A-Za-z_]\w*)
      |(?P<variable>\$[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)
      |(?P<format>@[A-Za-z0-9]+)
      |(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)
      |(?P<quote>")
      |(?P<sign>\?//=?|\|=|//=|[-+*/%=!<>]=|//|\.\.|[][(){}|,.:;?=<>+*/%$-])""",
    re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"'}


def string_at(text: str, at: int) -> tuple[list, int]:
    """Parts (str, or tokens of an interpolation) of the string whose opening quote is before at; the place after it."""
    parts: list = [""]
    while True:
        if at >= len(text):
            raise ProgramError("unterminated string")
        c = text[at]
        if c == '"':
            return parts, at + 1
        if c != "\\":
            parts[-1] += c
            at += 1
            continue
        e = text[at + 1 : at + 2]
        if e == "(":
            tokens, at = scan(text, at + 2, nested=True)
            parts += [tokens, ""]
        elif e == "u":
            code = int(text[at + 2 : at + 6], 16)
            at += 6
            if 0xD800 <= code < 0xDC00 and text[at : at + 2] == "\\u":
                low = int(text[at + 2 : at + 6], 16)
                if 0xDC00 <= low < 0xE000:
                    code = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)
                    at += 6
            parts[-1] += chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd"
        elif e in ESCAPES:
            parts[-1] += ESCAPES[e]
            at += 2
        else:
            raise ProgramError(f"invalid escape in a string at {at}")


def scan(text: str, at: int = 0, nested: bool = False) -> tuple[list[Token], int]:
    """Tokens up to the end, or (nested) up to the parenthesis that closes an interpolation."""
    out: list[Token] = []
    depth = 0
    while at < len(text):
        m = SCAN.match(text, at)
        if m is None:
            raise ProgramError(f"unexpected character {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        start, at = at, m.end()
        if kind == "space":
            continue
        if kind == "quote":
            parts, at = string_at(text, at)
            out.append(Token("string", s, start, parts))
            continue
        if nested and s in "()":
            depth += 1 if s == "(" else -1
            if depth < 0:
                return [*out, Token("end", "", start)], at
        out.append(Token("keyword" if kind == "name" and s in KEYWORDS else kind, s, start))
    if nested:
        raise ProgramError("unterminated interpolation")
    return [*out, Token("end", "", at)], at


#: Left-associative levels of binary operators above assignment, loosest first.
LEVELS = (("//",), ("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
ASSIGNMENTS = frozenset({"=", "|=", "+=", "-=", "*=", "/=", "%=", "//="})


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def sees(self, *texts: str) -> bool:
        t = self.peek()
        return t.kind in ("sign", "keyword") and t.text in texts

    def took(self, *texts: str) -> bool:
        if self.sees(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> Token:
        t = self.next()
        if t.kind not in ("sign", "keyword") or t.text != text:
            raise ProgramError(f"expected {text!r} but found {t.text or 'the end'!r} at {t.at}")
        return t

    def name(self, kind: str) -> str:
        t = self.next()
        if t.kind != kind:
            raise ProgramError(f"expected a {kind} but found {t.text or 'the end'!r} at {t.at}")
        return t.text

    # Expressions, loosest first.

    def program(self) -> Node:
        out = self.pipe()
        if self.peek().kind != "end":
            raise ProgramError(f"unexpected {self.peek().text!r} at {self.peek().at}")
        return out

    def pipe(self) -> Node:
        if self.sees("def"):
            return self.define()
        if self.sees("label"):
            self.next()
            name = self.name("variable")
            self.need("|")
            return Label(name[1:], self.pipe())
        left = self.comma()
        return Pipe(left, self.pipe()) if self.took("|") else left

    def comma(self) -> Node:
        left = self.assignment()
        while self.took(","):
            left = Comma(left, self.assignment())
        return left

    def bound(self, source: Node) -> Node:
        """A binding holds from its source to the end of the pipe."""
        patterns = [self.pattern()]
        while self.took("?//"):
            patterns.append(self.pattern())
        self.need("|")
        return Bind(source, tuple(patterns), self.pipe())

    def assignment(self) -> Node:
        left = self.binary(0)
        if self.took("as"):
            return self.bound(left)
        while self.peek().kind == "sign" and self.peek().text in ASSIGNMENTS:
            op = self.next().text
            left = Assign(op, left, self.binary(0))
        return left

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.postfix()
        signs = LEVELS[level]
        left = self.binary(level + 1)
        while self.sees(*signs):
            op = self.next().text
            right = self.binary(level + 1)
            left = Alternative(left, right) if op == "//" else Logic(op, left, right) if level in (1, 2) else Compare(op, left, right) if level == 3 else Arithmetic(op, left, right)
        return left

    def postfix(self) -> Node:
        out = self.term()
        while True:
            t = self.peek()
            if t.kind == "field":
                self.next()
                out = Field(out, t.text[1:])
            elif t.kind == "sign" and t.text == "." and self.peek(1).kind == "string":
                self.at += 1
                out = self.keyed(out)
            elif t.kind == "sign" and t.text == "." and self.peek(1).text == "[":
                self.at += 1
            elif self.sees("["):
                out = self.brackets(out)
            elif self.took("?"):
                out = Try(out, None)
            else:
                return out

    def keyed(self, base: Node) -> Node:
        key = self.string(None)
        return Field(base, key.value) if isinstance(key, Literal) else Index(base, key)

    def brackets(self, base: Node) -> Node:
        self.need("[")
        if self.took("]"):
            return Iterate(base)
        start = None if self.sees(":") else self.pipe()
        if self.took(":"):
            end = None if self.sees("]") else self.pipe()
            self.need("]")
            return Slice(base, start, end)
        self.need("]")
        return Index(base, start)

    def term(self) -> Node:
        t = self.peek()
        if t.kind == "number":
            self.next()
            value = float(t.text)
            return Literal(int(t.text) if t.text.isdigit() else int(value) if value.is_integer() and abs(value) < 2**63 else value)
        if t.kind == "string":
            return self.string(None)
        if t.kind == "format":
            self.next()
            return self.string(t.text[1:]) if self.peek().kind == "string" else Format(t.text[1:])
        if t.kind == "field":
            self.next()
            return Field(Identity(), t.text[1:])
        if t.kind == "variable":
            self.next()
            return Variable(t.text[1:])
        if t.kind == "name":
            return self.call()
        if self.took(".."):
            return RecurseAll()
        if self.took("."):
            if self.peek().kind == "string":
                return self.keyed(Identity())
            return self.brackets(Identity()) if self.sees("[") else Identity()
        if self.took("("):
            out = self.pipe()
            self.need(")")
            return out
        if self.took("["):
            body = None if self.sees("]") else self.pipe()
            self.need("]")
            return Collect(body)
        if self.sees("{"):
            return self.build()
        if self.took("-"):
            return Negate(self.postfix())
        if self.took("if"):
            return self.conditional()
        if self.took("try"):
            body = self.postfix()
            return Try(body, self.postfix() if self.took("catch") else None)
        if self.sees("reduce", "foreach"):
            return self.fold()
        if self.sees("def"):
            return self.define()
        if self.took("label"):
            name = self.name("variable")
            self.need("|")
            return Label(name[1:], self.pipe())
        if self.took("break"):
            return Break(self.name("variable")[1:])
        raise ProgramError(f"unexpected {t.text or 'end'!r} at {t.at}")

    def string(self, fmt: str | None) -> Node:
        t = self.next()
        parts = [p if isinstance(p, str) else Parser(p).program() for p in t.value]
        if len(parts) == 1 and fmt is None:
            return Literal(parts[0])
        return Interpolate(fmt, tuple(p for p in parts if p != ""))

    def call(self) -> Node:
        name = self.next().text
        if name in ("null", "true", "false"):
            return Literal({"null": None, "true": True, "false": False}[name])
        args = []
        if self.took("("):
            args.append(self.pipe())
            while self.took(";"):
                args.append(self.pipe())
            self.need(")")
        return Call(name, tuple(args))

    def conditional(self) -> Node:
        test = self.pipe()
        self.need("then")
        then = self.pipe()
        if self.took("elif"):
            return If(test, then, self.conditional())
        other = self.pipe() if self.took("else") else Identity()
        self.need("end")
        return If(test, then, other)

    def fold(self) -> Node:
        kind = self.next().text
        source = self.postfix()
        self.need("as")
        pattern = self.pattern()
        self.need("(")
        parts = [self.pipe()]
        while self.took(";"):
            parts.append(self.pipe())
        self.need(")")
        if kind == "reduce" and len(parts) == 2:
            return Reduce(source, pattern, *parts)
        if kind == "foreach" and len(parts) in (2, 3):
            return Foreach(source, pattern, parts[0], parts[1], parts[2] if len(parts) == 3 else None)
        raise ProgramError(f"{kind} has {len(parts)} parts")

    def define(self) -> Node:
        self.need("def")
        name = self.next().text
        params: list[str] = []
        if self.took("("):
            while True:
                params.append(self.next().text)
                if not self.took(";"):
                    break
            self.need(")")
        self.need(":")
        body = self.pipe()
        self.need(";")
        # A value parameter is a filter parameter whose outputs are bound one after the other.
        for p in reversed([p for p in params if p.startswith("$")]):
            body = Bind(Call(p[1:], ()), (VarPattern(p[1:]),), body)
        rest = Identity() if self.peek().kind == "end" or self.sees(")", "]", "}", ";") else self.pipe()
        return Define(name, tuple(p.lstrip("$") for p in params), body, rest)

    def build(self) -> Node:
        self.need("{")
        entries = []
        while not self.took("}"):
            entries.append(self.entry())
            if not self.took(","):
                self.need("}")
                break
        return Build(tuple(entries))

    def entry(self) -> tuple[Node, Node]:
        t = self.peek()
        value: Node | None = None
        if t.kind == "variable":
            self.next()
            if t.text == "$__loc__":
                return Literal("__loc__"), Variable("__loc__")
            key: Node = Literal(t.text[1:])
            value = Variable(t.text[1:])
        elif t.kind in ("name", "keyword"):
            self.next()
            key = Literal(t.text)
            value = Field(Identity(), t.text)
        elif t.kind == "number":
            self.next()
            key = Literal(t.text)
        elif t.kind == "string":
            key = self.string(None)
            value = Index(Identity(), key)
        elif t.kind == "format":
            self.next()
            key = self.string(t.text[1:])
            value = Index(Identity(), key)
        else:
            self.need("(")
            key = self.pipe()
            self.need(")")
        if self.took(":"):
            return key, self.entry_value()
        if value is None:
            raise ProgramError(f"a value is missing at {self.peek().at}")
        return key, value

    def entry_value(self) -> Node:
        out = self.binary(0)
        while self.took("|"):
            out = Pipe(out, self.binary(0))
        return out

    def pattern(self):
        if self.peek().kind == "variable":
            return VarPattern(self.next().text[1:])
        if self.took("["):
            items = [self.pattern()]
            while self.took(","):
                items.append(self.pattern())
            self.need("]")
            return ArrayPattern(tuple(items))
        self.need("{")
        entries = []
        while True:
            t = self.peek()
            var = None
            if t.kind == "variable":
                self.next()
                key, var = Literal(t.text[1:]), t.text[1:]
            elif t.kind in ("name", "keyword"):
                self.next()
                key = Literal(t.text)
            elif t.kind == "string":
                key = self.string(None)
            else:
                self.need("(")
                key = self.pipe()
                self.need(")")
            inner = self.pattern() if self.took(":") else None
            if inner is None and var is None:
                raise ProgramError(f"a pattern is missing at {self.peek().at}")
            entries.append((key, var, inner))
            if not self.took(","):
                break
        self.need("}")
        return ObjectPattern(tuple(entries))


def parse(text: str) -> Node:
    return Parser(scan(text)[0]).program()
