"""Dimension specs: what a row is grouped by, its transformation, and the rows it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import Catalog
from tidemark.errors import Invalid, Unsupported

OUTPUT = {"STRING": "string", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double"}


def extracted(c: Column, fn: dict, catalog: Catalog) -> Column:
    kind = fn.get("type")
    text = c.cast("string")
    if kind == "regex":
        found = F.regexp_extract(text, fn["expr"], int(fn.get("index", 1)))
        missing = F.lit(fn.get("replaceMissingValueWith")) if fn.get("replaceMissingValue") else F.lit("")
        return F.when(text.rlike(fn["expr"]), found).otherwise(missing)
    if kind == "partial":
        return F.when(text.rlike(fn["expr"]), F.regexp_extract(text, fn["expr"], 0)).otherwise("")
    if kind == "searchQuery":
        from tidemark.operators.filters import searched

        return F.when(searched(text, fn["query"]), text)
    if kind == "strlen":
        return F.length(text).cast("string")
    if kind in ("timeFormat", "time"):
        return F.date_format(c.cast("timestamp"), fn.get("format") or fn.get("resultFormat") or "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind == "substring":
        start = int(fn.get("index", 0)) + 1
        return F.substring(text, start, int(fn["length"])) if fn.get("length") is not None else F.substring(text, F.lit(start), F.length(text))
    if kind in ("upper", "lower"):
        return getattr(F, kind)(text)
    if kind == "bucket":
        size, offset = float(fn.get("size", 1)) or 1.0, float(fn.get("offset", 0))
        return F.floor((F.coalesce(text.try_cast("double"), F.lit(0.0)) - offset) / size) * size + offset
    if kind == "cascade":
        for part in fn["extractionFns"]:
            c = extracted(c, part, catalog)
        return c
    if kind == "stringFormat":
        null = {"emptyString": F.coalesce(text, F.lit("")), "returnNull": text}.get(fn.get("nullHandling"), F.coalesce(text, F.lit("")))
        return F.replace(F.lit(fn["format"]), F.lit("%s"), null)
    if kind in ("lookup", "registeredLookup"):
        table = catalog.lookup(fn["lookup"]) if kind == "registeredLookup" else fn["lookup"]["map"]
        return looked_up(text, table, fn.get("retainMissingValue", False), fn.get("replaceMissingValueWith"))
    raise Unsupported("extraction function", f"type {kind!r}")


def looked_up(key: Column, table: dict[str, str], retain: bool = False, missing: str | None = None) -> Column:
    """The value of `key` in a lookup; a lookup is a literal of the query and small by its nature."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, key) if retain else F.coalesce(found, F.lit(missing)) if missing is not None else found


def dimension(df: DataFrame, spec, catalog: Catalog) -> tuple[DataFrame, str]:
    """`df` with the dimension's column, and its name. Several values a row are exploded; none are the null group."""
    if isinstance(spec, str):
        spec = {"type": "default", "dimension": spec}
    kind = spec.get("type", "default")
    if kind in ("listFiltered", "regexFiltered", "prefixFiltered"):
        df, name = dimension(df, spec["delegate"], catalog)
        c = F.col(f"`{name}`").cast("string")
        if kind == "listFiltered":
            keep = c.isin([str(v) for v in spec["values"]])
            keep = keep if spec.get("isWhitelist", True) else ~F.coalesce(keep, F.lit(False))
        else:
            keep = c.rlike(spec["pattern"]) if kind == "regexFiltered" else c.startswith(spec["prefix"])
        return df.where(keep), name
    source = spec["dimension"]
    name = spec.get("outputName") or source
    types = {f.name: f.dataType for f in df.schema}
    if source not in types:
        value: Column = F.lit(None).cast("string")
    else:
        value = F.col(f"`{source}`")
    if isinstance(types.get(source), T.ArrayType):
        df = df.withColumn(name, F.explode_outer(value))
        value = F.col(f"`{name}`")
    if kind == "extraction":
        value = extracted(value, spec["extractionFn"], catalog)
    elif kind != "default":
        raise Unsupported("dimension", f"type {kind!r}")
    output = str(spec.get("outputType", "")).upper()
    if output:
        if output not in OUTPUT:
            raise Invalid("dimension", f"unknown outputType {output}")
        value = value.try_cast(OUTPUT[output])
    return df.withColumn(name, value), name
