"""One expression language for virtual columns, filters and post-aggregations: a precedence parser that makes Columns.

The three uses differ in what names resolve to and in division by zero, which gives null. Comparisons are two-valued: null equals null,
differs from any value, and is neither above nor below anything. `+` adds numbers and joins strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Invalid

TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<string>'(?:[^'\\]|\\.|'')*')|(?P<quoted>\"[^\"]*\")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>&&|\|\||==|!=|>=|<=|<>|[-+*/%()<>!,=]))")
LEVELS = [("||", "or"), ("&&", "and"), ("==", "=", "!=", "<>"), (">", ">=", "<", "<="), ("+", "-"), ("*", "/", "%")]
DEEP = 128


class Typed:
    """A column and what is known of it: 'number', 'string', 'boolean' or None."""

    def __init__(self, column: Column, kind: str | None):
        self.column, self.kind = column, kind

    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        return self.column.try_cast("double") if self.kind != "boolean" else self.column.cast("int").cast("double")

    def string(self) -> Column:
        return self.column if self.kind == "string" else self.column.cast("string")

    def truth(self) -> Column:
        if self.kind == "boolean":
            return F.coalesce(self.column, F.lit(False))
        return F.coalesce(self.number() != 0, F.lit(False))


def kind_of(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.NumericType):
        return "number"
    return "string" if isinstance(data_type, T.StringType) else "boolean" if isinstance(data_type, T.BooleanType) else None


class Parser:
    def __init__(self, text: str, resolve: Callable[[str], Typed]):
        self.tokens, self.at, self.deep, self.resolve, self.text = [], 0, 0, resolve, text
        place = 0
        while text[place:].strip():
            match = TOKEN.match(text, place)
            if not match:
                raise Invalid("expression", f"can't read {text[place:]!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            place = match.end()

    def parse(self) -> Typed:
        out = self._level(0)
        if self.at < len(self.tokens):
            raise Invalid("expression", f"{self.tokens[self.at][1]!r} is out of place in {self.text!r}")
        return out

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _next(self) -> tuple[str, str]:
        token = self._peek()
        self.at += 1
        return token

    def _want(self, op: str) -> None:
        if self._next()[1] != op:
            raise Invalid("expression", f"{op!r} is missing in {self.text!r}")

    def _level(self, n: int) -> Typed:
        if n == len(LEVELS):
            return self._unary()
        left = self._level(n + 1)
        while self._peek()[0] in ("op", "name") and self._peek()[1].lower() in LEVELS[n]:
            op = self._next()[1].lower()
            left = binary(op, left, self._level(n + 1))
        return left

    def _unary(self) -> Typed:
        self.deep += 1
        if self.deep > DEEP:
            raise Invalid("expression", "nested too deeply")
        try:
            kind, text = self._peek()
            if kind == "op" and text in "-!":
                self._next()
                value = self._unary()
                return Typed(-value.number(), "number") if text == "-" else Typed(~value.truth(), "boolean")
            return self._atom()
        finally:
            self.deep -= 1

    def _atom(self) -> Typed:
        kind, text = self._next()
        if kind == "number":
            return Typed(F.lit(float(text) if re.search(r"[.eE]", text) else int(text)), "number")
        if kind == "string":
            return Typed(F.lit(re.sub(r"\\(.)|''", lambda m: m[1] or "'", text[1:-1])), "string")
        if kind == "quoted":
            return self.resolve(text[1:-1])
        if kind == "op" and text == "(":
            out = self._level(0)
            self._want(")")
            return out
        if kind == "name":
            if self._peek() == ("op", "("):
                return self._call(text.lower())
            if text.lower() in ("true", "false"):
                return Typed(F.lit(text.lower() == "true"), "boolean")
            if text.lower() == "null":
                return Typed(F.lit(None), None)
            return self.resolve(text)
        raise Invalid("expression", f"{text or 'its end'!r} is out of place in {self.text!r}")

    def _call(self, name: str) -> Typed:
        self._want("(")
        args: list[Typed] = []
        while self._peek() != ("op", ")"):
            args.append(self._level(0))
            if self._peek() == ("op", ","):
                self._next()
        self._want(")")
        if name not in FUNCTIONS:
            raise Invalid("expression", f"unknown function {name}")
        low, high, build = FUNCTIONS[name]
        if not low <= len(args) <= high:
            raise Invalid("expression", f"{name} doesn't take {len(args)} arguments")
        return build(*args)


def binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("||", "or"):
        return Typed(a.truth() | b.truth(), "boolean")
    if op in ("&&", "and"):
        return Typed(a.truth() & b.truth(), "boolean")
    if op in ("==", "=", "!=", "<>"):
        same = a.string().eqNullSafe(b.string()) if "number" not in (a.kind, b.kind) else a.number().eqNullSafe(b.number())
        return Typed(same if op in ("==", "=") else ~same, "boolean")
    if op in ("<", "<=", ">", ">="):
        x, y = (a.number(), b.number()) if "number" in (a.kind, b.kind) else (a.string(), b.string())
        return Typed(F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False)), "boolean")
    if op == "+" and "string" in (a.kind, b.kind):
        joined = F.concat(a.string(), b.string())
        if a.kind == b.kind == "string":
            numeric = a.number() + b.number()
            return Typed(F.when(numeric.isNotNull(), numeric.cast("string")).otherwise(joined), "string")
        return Typed(joined, "string")
    x, y = a.number(), b.number()
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x.cast("double"), y), "%": lambda: F.try_mod(x, y)}[op]()
    return Typed(made, "number")


def _case(*args: Typed) -> Typed:
    out = args[-1].column if len(args) % 2 else F.lit(None)
    kind = args[1].kind
    for k in range(len(args) - len(args) % 2 - 2, -1, -2):
        out = F.when(args[k].truth(), args[k + 1].column).otherwise(out)
    return Typed(out, kind)


def _round(x: Typed, n: Typed | None = None) -> Typed:
    if n is None:
        return Typed(F.round(x.number()), "number")
    return Typed(F.round(x.number(), n.column), "number")


#: name: least and most arguments, and what it makes.
FUNCTIONS = {
    "strlen": (1, 1, lambda s: Typed(F.length(s.string()), "number")),
    "substring": (2, 3, lambda s, i, n=None: Typed(F.substring(s.string(), i.column + 1, n.column if n else F.length(s.string())), "string")),
    "concat": (1, 64, lambda *a: Typed(F.concat(*(F.coalesce(x.string(), F.lit("")) for x in a)), "string")),
    "lower": (1, 1, lambda s: Typed(F.lower(s.string()), "string")),
    "upper": (1, 1, lambda s: Typed(F.upper(s.string()), "string")),
    "abs": (1, 1, lambda x: Typed(F.abs(x.number()), "number")),
    "floor": (1, 1, lambda x: Typed(F.floor(x.number()).cast("double"), "number")),
    "ceil": (1, 1, lambda x: Typed(F.ceil(x.number()).cast("double"), "number")),
    "round": (1, 2, _round),
    "coalesce": (1, 64, lambda *a: Typed(F.coalesce(*(x.column for x in a)), a[0].kind)),
    "nvl": (2, 2, lambda a, b: Typed(F.coalesce(a.column, b.column), a.kind)),
    "isnull": (1, 1, lambda a: Typed(a.column.isNull(), "boolean")),
    "notnull": (1, 1, lambda a: Typed(a.column.isNotNull(), "boolean")),
    "case": (2, 65, _case),
}


def over_columns(text: str, schema: T.StructType) -> Typed:
    """An expression over a DataFrame's columns; an unknown name reads as null."""
    types = {f.name: f.dataType for f in schema}

    def resolve(name: str) -> Typed:
        if name not in types:
            return Typed(F.lit(None), None)
        if isinstance(types[name], T.ArrayType):
            raise Invalid("expression", f"{name} has several values a row")
        return Typed(F.col(f"`{name}`"), kind_of(types[name]))

    return Parser(text, resolve).parse()
