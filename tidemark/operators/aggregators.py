"""Aggregators and post-aggregators as Columns. All are partial and final in Spark, so results merge exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import TIME
from tidemark.errors import Invalid, Unsupported
from tidemark.functions import bloom
from tidemark.functions.expressions import Parser, Typed
from tidemark.operators.filters import Filters

SKETCHES = {"HLLSketchBuild": "hll", "HLLSketchMerge": "hll", "hyperUnique": "hll", "thetaSketch": "theta", "quantilesDoublesSketch": "kll"}


class Aggregators:
    def __init__(self, schema: T.StructType, subtotalled: list[str] | None = None):
        """`subtotalled` names the dimensions of a query with grouping sets."""
        self.types = {f.name: f.dataType for f in schema}
        self.subtotalled = subtotalled or []
        self.filters = Filters(schema)

    def field(self, spec: dict, key: str = "fieldName") -> Column:
        name = spec[key]
        if isinstance(self.types.get(name), T.ArrayType):
            raise Invalid(spec["type"], f"{name} has several values a row")
        return F.col(f"`{name}`") if name in self.types else F.lit(None).cast("double")

    def __call__(self, spec: dict, only: Column | None = None) -> Column:
        return self._made(spec, only).alias(spec.get("name") or spec.get("aggregator", {}).get("name"))

    def _made(self, s: dict, only: Column | None) -> Column:
        kind = s["type"]
        keep = (lambda c: c) if only is None else (lambda c: F.when(only, c))
        if kind == "filtered":
            inner = self.filters(s["filter"])
            return self._made(s["aggregator"], inner if only is None else only & inner)
        if kind == "count":
            return F.count(keep(F.lit(1)))
        for number, cast in (("long", "bigint"), ("double", "double"), ("float", "float")):
            if kind == f"{number}Sum":
                return F.sum(keep(self._number(s, cast))).cast(cast)
            if kind == f"{number}Min":
                return F.min(keep(self._number(s, cast)))
            if kind == f"{number}Max":
                return F.max(keep(self._number(s, cast)))
            if kind in (f"{number}First", f"{number}Last"):
                return self._by_time(s, keep(self._number(s, cast)), kind.endswith("First"))
        if kind in ("stringFirst", "stringLast"):
            # so many bytes at most, cut between characters
            most = F.lit(int(s.get("maxStringBytes", 1024)))
            text = keep(self.field(s).cast("string"))
            text = F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), most), "UTF-8"), "\uFFFD+$", ""))
            return self._by_time(s, text, kind == "stringFirst")
        if kind == "cardinality":
            fields = [f if isinstance(f, str) else f["dimension"] for f in s.get("fields", s.get("fieldNames", []))]
            columns = [keep(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("\0"))) for f in fields]
            if s.get("byRow"):
                return F.count_distinct(keep(F.struct(*(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("\0")) for f in fields))))
            out = F.count_distinct(columns[0])
            for c in columns[1:]:
                out = out + F.count_distinct(c)
            return out
        if kind == "variance":
            x = keep(self.field(s).cast("double"))
            return F.var_samp(x) if s.get("estimator") in ("sample", "samp") else F.var_pop(x)
        if kind == "HLLSketchBuild":
            return F.hll_sketch_agg(keep(self.field(s)), F.lit(int(s.get("lgK", 14))))
        if kind in ("HLLSketchMerge", "hyperUnique"):
            return F.hll_union_agg(keep(self.field(s)))
        if kind == "thetaSketch":
            x = keep(self.field(s))
            return F.theta_union_agg(x) if isinstance(self.types.get(s["fieldName"]), T.BinaryType) else F.theta_sketch_agg(x)
        if kind == "quantilesDoublesSketch":
            return F.kll_sketch_agg_double(keep(self.field(s).cast("double")), F.lit(int(s.get("k", 200))))
        if kind == "arrayAgg":
            values = F.collect_set(keep(self.field(s))) if s.get("distinct") else F.collect_list(keep(self.field(s)))
            return F.slice(F.sort_array(values), 1, int(s.get("maxElements", 1024)))
        if kind == "stringAgg":
            values = F.sort_array(F.collect_list(keep(self.field(s).cast("string"))))
            return F.when(F.size(values) > 0, F.array_join(values, s.get("separator", ",")))
        if kind == "bloomFilter":
            name = s.get("fieldName") or (s["field"] if isinstance(s.get("field"), str) else (s.get("field") or {}).get("dimension"))
            if only is not None:
                raise Unsupported("bloomFilter", "under a filtered aggregator; filter the query")
            value = f"`{name}`" if name in self.types else "CAST(NULL AS STRING)"
            return F.expr(bloom.build(value, int(s.get("maxNumEntries", s.get("numEntries", 1500)))))
        if kind == "grouping":
            # the first name is the highest bit, 1 where it is aggregated away; without grouping sets nothing is
            bits = [F.grouping(f"`{n}`").cast("bigint") if n in self.subtotalled else F.lit(0).cast("bigint") for n in s.get("groupings") or s.get("fields") or []]
            out = F.lit(0).cast("bigint")
            for b in bits:
                out = out * 2 + b
            return out if self.subtotalled else F.max(out)
        raise Unsupported("aggregator", f"type {kind!r}")

    def _number(self, s: dict, cast: str) -> Column:
        if "expression" in s and "fieldName" not in s:
            raise Unsupported(s["type"], "an expression; use a virtual column")
        x = self.field(s)
        of = self.types.get(s["fieldName"])
        if isinstance(of, T.StringType):
            x = x.try_cast("double")
        return x.try_cast(cast)

    def _by_time(self, s: dict, value: Column, first: bool) -> Column:
        time = F.col(f"`{TIME}`")
        if s.get("timeColumn"):
            time = F.coalesce(F.col(f"`{s['timeColumn']}`").cast("timestamp"), time)
        at = F.when(value.isNotNull(), time)
        return F.min_by(value, at) if first else F.max_by(value, at)


def finalized(kind: str, c: Column) -> Column:
    """A sketch's number: its estimate, or how many values a quantiles sketch has."""
    sketch = SKETCHES.get(kind)
    if sketch == "hll":
        return F.hll_sketch_estimate(c)
    if sketch == "theta":
        return F.theta_sketch_estimate(c)
    return F.kll_sketch_get_n_double(c) if sketch == "kll" else c


class PostAggregators:
    """`kinds` has the type of each aggregator's output by name; other names are dimensions or earlier post-aggregations."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds

    def _read(self, name: str) -> Column:
        return finalized(self.kinds.get(name, ""), F.col(f"`{name}`"))

    def _sketch(self, s) -> Column:
        """A sketch as it is: an output's, or what set operations make of several."""
        if isinstance(s, str) or s["type"] != "thetaSketchSetOp":
            return F.col(f"`{s if isinstance(s, str) else s['fieldName']}`")
        combine = {"UNION": F.theta_union, "INTERSECT": F.theta_intersection, "NOT": F.theta_difference}.get(str(s.get("func")).upper())
        if combine is None or not s.get("fields"):
            raise Unsupported("thetaSketchSetOp", f"func {s.get('func')!r}")
        parts = [self._sketch(f) for f in s["fields"]]
        for f in s["fields"]:
            name = f if isinstance(f, str) else f.get("fieldName")
            if name in self.kinds and SKETCHES.get(self.kinds[name]) != "theta":
                raise Invalid("thetaSketchSetOp", f"{name} is no theta sketch")
        out = parts[0]
        for p in parts[1:]:
            out = combine(out, p)
        return out

    def __call__(self, s: dict) -> Column:
        kind = s["type"]
        if kind in ("fieldAccess", "finalizingFieldAccess"):
            return self._read(s["fieldName"])
        if kind == "constant":
            return F.lit(float(s["value"]))
        if kind == "arithmetic":
            parts = [self(f).cast("double") for f in s["fields"]]
            if not parts:
                return F.lit(0.0)
            out = parts[0]
            for p in parts[1:]:
                out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}.get(s["fn"], self._divided)(out, p)
            return out
        if kind == "expression":
            return Parser(s["expression"], lambda n: Typed(self._read(n).cast("double"), "number")).parse().column
        sketch = lambda: self._sketch(s.get("field") or s.get("fieldName"))
        if kind == "thetaSketchSetOp":
            return F.theta_sketch_estimate(self._sketch(s))
        if kind in ("hyperUniqueCardinality", "HLLSketchEstimate"):
            return F.hll_sketch_estimate(sketch())
        if kind == "thetaSketchEstimate":
            return F.theta_sketch_estimate(sketch())
        if kind == "quantilesDoublesSketchToQuantile":
            return F.kll_sketch_get_quantile_double(sketch(), F.lit(float(s["fraction"])))
        if kind == "variance":
            return sketch()
        if kind == "stddev":
            return F.sqrt(sketch())
        raise Unsupported("post-aggregator", f"type {kind!r}")

    @staticmethod
    def _divided(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))
