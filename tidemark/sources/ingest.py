"""Batch ingestion: formats, timestamps, typed dimensions and roll-up, as one lazy DataFrame until it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import TIME
from tidemark.errors import Invalid, Unsupported
from tidemark.functions.granularity import bucket

TYPES = {"string": "string", "long": "bigint", "float": "float", "double": "double"}


def read(spark: SparkSession, spec: dict, path: str | None = None) -> DataFrame:
    """Rows of an inputFormat; all fields are strings in CSV and TSV."""
    kind = spec["type"]
    if kind == "json":
        return spark.read.json(path, schema=spec.get("schema"))
    if kind in ("csv", "tsv"):
        options = {"sep": spec.get("delimiter", "," if kind == "csv" else "\t"), "header": str(bool(spec.get("findColumnsFromHeader"))).lower(), "inferSchema": "false"}
        if kind == "tsv":
            options["quote"] = ""
        columns = spec.get("columns")
        schema, skipped = ", ".join(f"`{c}` string" for c in columns) if columns else None, int(spec.get("skipHeaderRows", 0))
        if skipped:
            # the first lines of each file, which is read whole by one task: lines have no number otherwise
            lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "\r?\n"), skipped + 1, 1 << 30)).alias("value")).where("value <> ''")
            if schema is None:
                raise Invalid("inputFormat", "skipHeaderRows needs columns")
            df = lines.select(F.from_csv("value", schema, {"sep": options["sep"]} | ({"quote": ""} if kind == "tsv" else {})).alias("r")).select("r.*")
        else:
            df = spark.read.options(**options).csv(path, schema=schema)
        separator = spec.get("listDelimiter", "\u0001")
        return df.withColumns({c: F.split(c, f"\\Q{separator}\\E") for c in spec.get("listColumns", [])})
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("orc", "avro"):
        return spark.read.format(kind).load(path)
    raise Unsupported("inputFormat", f"type {kind!r}")


def timestamp(df: DataFrame, spec: dict) -> Column:
    """`auto`: digits are milliseconds, else ISO; `iso`: digits are a year; `millis`: digits only. What can't be read is null."""
    name, kind = spec.get("column", "timestamp"), spec.get("format", "auto")
    of, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(of, T.TimestampType | T.TimestampNTZType | T.DateType):
        return c.cast("timestamp")
    text = F.trim(c.cast("string"))
    digits = F.timestamp_millis(text.try_cast("bigint"))
    if kind == "millis":
        return digits
    if kind == "auto":
        return F.when(text.rlike(r"^-?\d+$"), digits).otherwise(text.try_cast("timestamp"))
    if kind == "iso":
        return text.try_cast("timestamp")
    raise Unsupported("timestampSpec", f"format {kind!r}")


def ingest(df: DataFrame, spec: dict) -> DataFrame:
    """`df` as a datasource by `spec`: timestampSpec, dimensionsSpec, metricsSpec, granularitySpec. Rows without a time are left out."""
    if spec.get("transformSpec"):
        raise Unsupported("transformSpec", "transform the rows before")
    dims = spec["dimensionsSpec"]["dimensions"]
    dims = [{"name": d, "type": "string"} if isinstance(d, str) else d for d in dims]
    for d in dims:
        if d.get("type", "string") not in TYPES:
            raise Invalid("dimensionsSpec", f"unknown type {d['type']}")
    grain = spec.get("granularitySpec") or {}
    metrics = spec.get("metricsSpec") or []
    time = timestamp(df, spec.get("timestampSpec") or {})
    many = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    if grain.get("rollup") and many & {d["name"] for d in dims}:
        raise Invalid("rollup", "a dimension has several values a row")
    value = lambda d: F.col(f"`{d['name']}`") if d["name"] in many else F.col(f"`{d['name']}`").try_cast(TYPES[d.get("type", "string")])
    measure = lambda m: F.lit(1).cast("bigint") if m["type"] == "count" else F.col(f"`{m['fieldName']}`").try_cast("bigint" if m["type"].startswith("long") else "double")
    out = df.select(time.alias(TIME), *(value(d).alias(d["name"]) for d in dims), *(measure(m).alias(m["name"]) for m in metrics)).where(F.col(TIME).isNotNull())
    at = bucket(F.col(TIME), grain.get("queryGranularity") or "none")
    out = out.withColumn(TIME, F.timestamp_millis(F.lit(0)) if at is None else at)
    if not grain.get("rollup"):
        return out
    return out.groupBy(TIME, *(d["name"] for d in dims)).agg(*(F.sum(m["name"]).alias(m["name"]) for m in metrics))


def publish(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes a datasource by day, sorted by time within files, so that both prune."""
    df.withColumn("date", F.to_date(TIME)).sortWithinPartitions("date", TIME).write.mode(mode).partitionBy("date").parquet(path)
