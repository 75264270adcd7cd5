"""Native filters as two-valued Columns: every leaf is true or false, never null, and arrays match if any element does."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Invalid, Unsupported
from tidemark.functions import bloom
from tidemark.functions.expressions import over_columns
from tidemark.functions.granularity import within


#: The least and greatest value of each integral type.
WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def number(value) -> Decimal | None:
    """What a literal says as a number; None if it is none."""
    try:
        out = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return out if out.is_finite() else None


def typed(kind: T.DataType, value) -> Column | None:
    """The literal as a value of a numeric column's own type; None if no value of this type equals it."""
    of = number(value)
    if of is None:
        return None
    if type(kind) in WHOLE:
        most = 1 << WHOLE[type(kind)]
        return F.lit(int(of)).cast(kind) if of == of.to_integral_value() and -most <= of < most else None
    return F.lit(float(of)).cast(kind) if isinstance(kind, T.FractionalType) else None


def between(c: Column, kind: T.DataType, low, high, low_open: bool, high_open: bool) -> Column:
    """A numeric column within bounds, in its own type; a bound that is no number matches nothing."""
    out = c.isNotNull()
    for bound, strict, lower in ((low, low_open, True), (high, high_open, False)):
        if bound is None:
            continue
        of = number(bound)
        if of is None:
            return F.lit(False)
        if type(kind) in WHOLE:
            # the nearest whole number inside the bound
            most = 1 << WHOLE[type(kind)]
            of = (math.floor(of) + 1 if strict else math.ceil(of)) if lower else (math.ceil(of) - 1 if strict else math.floor(of))
            if lower and of >= most or not lower and of < -most:
                return F.lit(False)
            if -most <= of < most:
                out = out & (c >= F.lit(of).cast(kind) if lower else c <= F.lit(of).cast(kind))
            continue
        edge = F.lit(float(of))
        out = out & ((c > edge if strict else c >= edge) if lower else (c < edge if strict else c <= edge))
    return out


def legal(pattern: str) -> bool:
    """Whether the engine that runs regular expressions takes the pattern."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, PySparkException):
        return False
    return True


class Filters:
    def __init__(self, schema: T.StructType):
        self.schema, self.types = schema, {f.name: f.dataType for f in schema}

    def __call__(self, spec: dict | None) -> Column:
        if spec is None:
            return F.lit(True)
        build = getattr(self, f"_{spec.get('type', '').lower()}", None)
        if build is None:
            raise Unsupported("filter", f"type {spec.get('type')!r}")
        return build(spec)

    def _any(self, name: str, test: Callable[[Column], Column]) -> Column:
        """`test` on the column, or on any element of it; an empty or null array tests as null."""
        if name not in self.types:
            return F.coalesce(test(F.lit(None).cast("string")), F.lit(False))
        column = F.col(f"`{name}`")
        if isinstance(self.types[name], T.ArrayType):
            values = F.when(F.coalesce(F.size(column), F.lit(0)) == 0, F.array(F.lit(None).cast(self.types[name].elementType))).otherwise(column)
            return F.exists(values, lambda x: F.coalesce(test(x), F.lit(False)))
        return F.coalesce(test(column), F.lit(False))

    def _single(self, name: str, what: str) -> None:
        if isinstance(self.types.get(name), T.ArrayType):
            raise Invalid(what, f"{name} has several values a row")

    def _equals(self, name: str, value) -> Callable[[Column], Column]:
        kind = self.types.get(name)
        if value is None:
            return lambda c: c.isNull()
        if isinstance(kind, T.NumericType):
            literal = typed(kind, value)
            return lambda c: F.lit(False) if literal is None else c == literal
        return lambda c: c.cast("string") == F.lit(str(value))

    def _selector(self, s: dict) -> Column:
        return self._any(s["dimension"], self._equals(s["dimension"], s.get("value")))

    def _in(self, s: dict) -> Column:
        name, values = s["dimension"], s["values"]
        some = [v for v in values if v is not None]
        kind = self.types.get(name)
        if isinstance(kind, T.NumericType):
            some = [x for x in (typed(kind, v) for v in some) if x is not None]

        def test(c: Column) -> Column:
            found = F.lit(False)
            if some:
                found = c.isin(some) if isinstance(kind, T.NumericType) else c.cast("string").isin([str(v) for v in some])
            return F.coalesce(found, F.lit(False)) | (c.isNull() if None in values else F.lit(False))

        return self._any(name, test)

    def _ordered(self, name: str, low, high, low_open: bool, high_open: bool, key) -> Column:
        def test(c: Column) -> Column:
            x, out = key(c), c.isNotNull()
            if low is not None:
                out = out & (x > key(F.lit(low)) if low_open else x >= key(F.lit(low)))
            if high is not None:
                out = out & (x < key(F.lit(high)) if high_open else x <= key(F.lit(high)))
            return out

        return self._any(name, test)

    def _bound(self, s: dict) -> Column:
        order = s.get("ordering", "lexicographic")
        if isinstance(order, dict):
            order = order.get("type")
        low, high = s.get("lower"), s.get("upper")
        strict = bool(s.get("lowerStrict")), bool(s.get("upperStrict"))
        kind = self.types.get(s["dimension"])
        if order == "numeric" and isinstance(kind, T.NumericType):
            return self._any(s["dimension"], lambda c: between(c, kind, low, high, *strict))
        if order == "numeric":
            return self._ordered(s["dimension"], None if low is None else str(low), None if high is None else str(high), *strict, lambda c: c.try_cast("double"))
        if order == "strlen":
            length = lambda c: F.length(c.cast("string"))
            return self._ordered(s["dimension"], low, high, *strict, length)
        return self._ordered(s["dimension"], None if low is None else str(low), None if high is None else str(high), *strict, lambda c: c.cast("string"))

    def _range(self, s: dict) -> Column:
        kind = {"LONG": "bigint", "DOUBLE": "double", "FLOAT": "float"}.get(str(s.get("matchValueType", "STRING")).upper(), "string")
        own = self.types.get(s["column"])
        if kind != "string" and isinstance(own, T.NumericType):
            return self._any(s["column"], lambda c: between(c, own, s.get("lower"), s.get("upper"), bool(s.get("lowerOpen")), bool(s.get("upperOpen"))))
        key = (lambda c: c.cast("string")) if kind == "string" else (lambda c: c.try_cast("double"))
        text = lambda v: None if v is None else str(v)
        return self._ordered(s["column"], text(s.get("lower")), text(s.get("upper")), bool(s.get("lowerOpen")), bool(s.get("upperOpen")), key)

    def _like(self, s: dict) -> Column:
        import re

        escape, out, k = s.get("escape"), "", 0
        pattern = s["pattern"]
        while k < len(pattern):
            c = pattern[k]
            if escape and c == escape and k + 1 < len(pattern):
                k += 1
                out += re.escape(pattern[k])
            else:
                out += {"%": ".*", "_": "."}.get(c) or re.escape(c)
            k += 1
        return self._any(s["dimension"], lambda c: c.cast("string").rlike(rf"\A(?:{out})\z"))

    def _regex(self, s: dict) -> Column:
        if not legal(s["pattern"]):
            return F.lit(False)
        return self._any(s["dimension"], lambda c: c.cast("string").rlike(s["pattern"]))

    def _search(self, s: dict) -> Column:
        return self._any(s["dimension"], lambda c: searched(c.cast("string"), s["query"]))

    def _and(self, s: dict) -> Column:
        out = F.lit(True)
        for f in s["fields"]:
            out = out & self(f)
        return out

    def _or(self, s: dict) -> Column:
        out = F.lit(False)
        for f in s["fields"]:
            out = out | self(f)
        return out

    def _not(self, s: dict) -> Column:
        return ~self(s["field"])

    def _interval(self, s: dict) -> Column:
        self._single(s["dimension"], "interval filter")
        column = F.col(f"`{s['dimension']}`")
        if isinstance(self.types.get(s["dimension"]), T.NumericType):
            column = F.timestamp_millis(column)
        return F.coalesce(within(column, s["intervals"]), F.lit(False))

    def _expression(self, s: dict) -> Column:
        return over_columns(s["expression"], self.schema).truth() if s["expression"].strip() else F.lit(True)

    def _columncomparison(self, s: dict) -> Column:
        names = [d if isinstance(d, str) else d["dimension"] for d in s["dimensions"]]
        for name in names:
            self._single(name, "columnComparison filter")
        value = lambda n: F.col(f"`{n}`").cast("string") if n in self.types else F.lit(None).cast("string")
        out = F.lit(True)
        for a, b in zip(names, names[1:], strict=False):
            out = out & value(a).eqNullSafe(value(b))
        return out

    def _bloomfilter(self, s: dict) -> Column:
        name = s["dimension"]
        self._single(name, "bloomFilter filter")
        text = bloom.checked(s.get("bloomKFilter") or s.get("bloomFilter") or "")
        return F.expr(bloom.test(f"`{name}`", f"'{text}'")) if name in self.types else F.lit(False)

    def _true(self, _: dict) -> Column:
        return F.lit(True)

    def _false(self, _: dict) -> Column:
        return F.lit(False)

    def _null(self, s: dict) -> Column:
        return self._any(s.get("column", s.get("dimension")), lambda c: c.isNull())

    def _mvfilteronly(self, s: dict) -> Column:
        return self._in({"dimension": s["dimension"], "values": [v for v in s["values"] if v is not None]})

    def _mvfilternone(self, s: dict) -> Column:
        return ~self._mvfilteronly(s)


    def necessary(self, s: dict) -> Column | None:
        """What all rows that pass the filter fulfil, as bare comparisons that a scan can be given; None if that is nothing.

        The filter itself still decides; NaN, which it takes for null, may pass here.
        """
        kind = s.get("type", "").lower()
        if kind in ("and", "or"):
            parts = [self.necessary(f) for f in s["fields"]]
            known = [p for p in parts if p is not None]
            if not known or kind == "or" and len(known) < len(parts):
                return None
            out = known[0]
            for p in known[1:]:
                out = out & p if kind == "and" else out | p
            return out
        name = s.get("dimension", s.get("column"))
        of = self.types.get(name) if isinstance(name, str) else None
        if not isinstance(of, T.NumericType | T.StringType | T.TimestampType):
            return None
        c, text = F.col(f"`{name}`"), isinstance(of, T.StringType)
        if kind == "selector" and s.get("value") is not None and not isinstance(of, T.TimestampType):
            literal = F.lit(str(s["value"])) if text else typed(of, s["value"])
            return F.lit(False) if literal is None else c == literal
        if kind == "in" and None not in s["values"] and not isinstance(of, T.TimestampType):
            literals = [str(v) for v in s["values"]] if text else [x for x in (typed(of, v) for v in s["values"]) if x is not None]
            return c.isin(literals) if literals else F.lit(False)
        if kind == "interval" and isinstance(of, T.TimestampType):
            return within(c, s["intervals"])
        if kind == "bound":
            order = s.get("ordering", "lexicographic")
            order = order.get("type") if isinstance(order, dict) else order
            low, high, strict = s.get("lower"), s.get("upper"), (bool(s.get("lowerStrict")), bool(s.get("upperStrict")))
            if order == "numeric" and isinstance(of, T.NumericType):
                return between(c, of, low, high, *strict)
            if order == "lexicographic" and text:
                return self._ordered_text(c, low, high)
        if kind == "like" and text and not s.get("escape"):
            start = s["pattern"].replace("_", "%").split("%")[0]
            return c.startswith(start) if start else None
        return None

    @staticmethod
    def _ordered_text(c: Column, low, high) -> Column:
        out = c.isNotNull()
        out = out if low is None else out & (c >= F.lit(str(low)))
        return out if high is None else out & (c <= F.lit(str(high)))


def searched(text: Column, query: dict) -> Column:
    kind = query.get("type")
    if kind == "contains" and query.get("caseSensitive", True):
        return text.contains(query["value"])
    if kind in ("contains", "insensitive_contains"):
        return F.lower(text).contains(query["value"].lower())
    if kind == "fragment":
        exact = query.get("caseSensitive", False)
        out = F.lit(True)
        for v in query["values"]:
            out = out & (text.contains(v) if exact else F.lower(text).contains(v.lower()))
        return out
    if kind == "regex":
        return text.rlike(query["pattern"])
    raise Unsupported("search query", f"type {kind!r}")
