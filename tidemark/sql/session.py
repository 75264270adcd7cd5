"""The SQL surface: Spark SQL with the dialect's functions as SQL-bodied functions, which Catalyst inlines."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.errors import Invalid, Unsupported
from tidemark.functions import bloom
from tidemark.functions.granularity import FIXED, PERIODS

CALENDAR = {"P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year"}
MONTHS = {"P1M": 1, "P3M": 3, "P1Y": 12}
SHIFTS = {"P1W": "make_interval(0, 0, n)", "P1M": "make_interval(0, n)", "P3M": "make_interval(0, 3 * n)", "P1Y": "make_interval(n)"}


def _floor() -> str:
    """Of a time t, a period p and an origin o, or null: fixed periods count from it, calendar periods from its day of the month."""
    fixed = " ".join(f"WHEN '{p}' THEN timestamp_millis(unix_millis(t) - pmod(unix_millis(t) - coalesce(unix_millis(o), 0L), {FIXED[g]}))" for p, g in PERIODS.items() if g in FIXED)
    from_origin = " ".join(f"WHEN o IS NOT NULL AND p = '{p}' THEN o + make_interval(0, {n} * CAST(floor(months_between(t, o, false) / {n}) AS INT))" for p, n in MONTHS.items())
    from_origin += f" WHEN o IS NOT NULL AND p = 'P1W' THEN timestamp_millis(unix_millis(t) - pmod(unix_millis(t) - unix_millis(o), {7 * FIXED['day']}))"
    calendar = " ".join(f"WHEN p = '{p}' THEN date_trunc('{g}', t)" for p, g in CALENDAR.items())
    return f"CASE {from_origin} {calendar} ELSE CASE p {fixed} ELSE raise_error(concat('TIME_FLOOR: unknown period ', p)) END END"


def _shift() -> str:
    fixed = " ".join(f"WHEN '{p}' THEN timestamp_millis(unix_millis(t) + {FIXED[g]}L * n)" for p, g in PERIODS.items() if g in FIXED)
    return f"CASE p {fixed} {' '.join(f"WHEN '{p}' THEN t + {x}" for p, x in SHIFTS.items())} ELSE raise_error(concat('TIME_SHIFT: unknown period ', p)) END"


def _in_zone(body: str) -> str:
    """A body over t and o, in a time zone z if there is one."""
    return f"CASE WHEN z IS NULL THEN {body.format(t='t', o='o')} ELSE to_utc_timestamp({body.format(t='from_utc_timestamp(t, z)', o='from_utc_timestamp(o, z)')}, z) END"


#: Functions that Spark lacks: name, parameters, result, body. Those with an underscore in front serve the others.
FUNCTIONS = [
    ("_time_floor", "t TIMESTAMP, p STRING, o TIMESTAMP", "TIMESTAMP", _floor()),
    ("_time_shift", "t TIMESTAMP, p STRING, n INT", "TIMESTAMP", _shift()),
    ("_time_ceil", "t TIMESTAMP, p STRING, o TIMESTAMP", "TIMESTAMP", "CASE WHEN _time_floor(t, p, o) = t THEN t ELSE _time_shift(_time_floor(t, p, o), p, 1) END"),
    ("_time_extract", "t TIMESTAMP, u STRING", "BIGINT", "CASE upper(u) WHEN 'EPOCH' THEN unix_seconds(t) WHEN 'SECOND' THEN second(t) WHEN 'MINUTE' THEN minute(t) WHEN 'HOUR' THEN hour(t) WHEN 'DAY' THEN day(t) WHEN 'DOW' THEN weekday(t) + 1 WHEN 'DOY' THEN dayofyear(t) WHEN 'WEEK' THEN weekofyear(t) WHEN 'MONTH' THEN month(t) WHEN 'QUARTER' THEN quarter(t) WHEN 'YEAR' THEN year(t) END"),
    ("_time_parse", "s STRING, f STRING", "TIMESTAMP", "CASE WHEN f IS NULL THEN try_to_timestamp(s) ELSE try_to_timestamp(s, f) END"),
    ("time_floor", "t TIMESTAMP, p STRING, o TIMESTAMP DEFAULT NULL, z STRING DEFAULT NULL", "TIMESTAMP", _in_zone("_time_floor({t}, p, {o})")),
    ("time_ceil", "t TIMESTAMP, p STRING, o TIMESTAMP DEFAULT NULL, z STRING DEFAULT NULL", "TIMESTAMP", _in_zone("_time_ceil({t}, p, {o})")),
    ("time_shift", "t TIMESTAMP, p STRING, n INT, z STRING DEFAULT NULL", "TIMESTAMP", _in_zone("_time_shift({t}, p, n)")),
    ("time_format", "t TIMESTAMP, f STRING DEFAULT 'yyyy-MM-dd''T''HH:mm:ss.SSS''Z''', z STRING DEFAULT NULL", "STRING", "date_format(CASE WHEN z IS NULL THEN t ELSE from_utc_timestamp(t, z) END, replace(replace(f, 'YYYY', 'yyyy'), 'DD', 'dd'))"),
    ("time_parse", "s STRING, f STRING DEFAULT NULL, z STRING DEFAULT NULL", "TIMESTAMP", "CASE WHEN z IS NULL THEN _time_parse(s, f) ELSE to_utc_timestamp(_time_parse(s, f), z) END"),
    ("time_extract", "t TIMESTAMP, u STRING, z STRING DEFAULT NULL", "BIGINT", "_time_extract(CASE WHEN z IS NULL THEN t ELSE from_utc_timestamp(t, z) END, u)"),
    ("truncate", "x DOUBLE, d INT DEFAULT 0", "DOUBLE", "sign(x) * floor(abs(x) * power(10, d)) / power(10, d)"),
    ("mv_filter_only", "a ARRAY<STRING>, v ARRAY<STRING>", "ARRAY<STRING>", "filter(a, x -> array_contains(v, x))"),
    ("mv_filter_none", "a ARRAY<STRING>, v ARRAY<STRING>", "ARRAY<STRING>", "filter(a, x -> NOT array_contains(v, x))"),
]
#: Aggregates that are spelt otherwise.
AGGREGATES = {"earliest": ("min_by({0}, CASE WHEN {0} IS NOT NULL THEN __time END)", 1), "latest": ("max_by({0}, CASE WHEN {0} IS NOT NULL THEN __time END)", 1), "earliest_by": ("min_by({0}, CASE WHEN {0} IS NOT NULL THEN {1} END)", 2), "latest_by": ("max_by({0}, CASE WHEN {0} IS NOT NULL THEN {1} END)", 2), "approx_quantile_ds": ("percentile_approx({0}, {1})", 2)}
TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|[A-Za-z_][A-Za-z0-9_]*|\s+|.", re.S)


class Sql:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        if not self.spark.catalog.functionExists(FUNCTIONS[-1][0]):  # once a session
            for name, args, result, body in FUNCTIONS:
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")

    def __call__(self, text: str) -> DataFrame:
        words = {t.strip('"').lower() for t in TOKEN.findall(text)}
        for name in self.catalog.names:
            if name.lower() in words:
                self.catalog.table(name).createOrReplaceTempView(name)
        if "information_schema" in words:
            for name, make in self.information_schema().items():
                if name.lower() in words:
                    make().createOrReplaceTempView(f"information_schema_{name}")
        return self.spark.sql(self.rewritten(text))

    def rewritten(self, text: str) -> str:
        """Aggregates, LOOKUP and quoted names in Spark's spelling. It works on tokens, so strings and comments stay."""
        tokens = TOKEN.findall(text.strip().rstrip(";"))
        words = [t.upper() for t in tokens if t.strip()][:3]
        if words == ["EXPLAIN", "PLAN", "FOR"]:
            k = [k for k, t in enumerate(tokens) if t.upper() == "FOR"][0]
            return "EXPLAIN " + self.rewritten("".join(tokens[k + 1 :]))
        return "".join(self._rewrite(tokens))

    def _rewrite(self, tokens: list[str]) -> list[str]:
        out, k = [], 0
        while k < len(tokens):
            token = tokens[k]
            after = k + 1
            while after < len(tokens) and tokens[after].isspace():
                after += 1
            call = after < len(tokens) and tokens[after] == "("
            name = token.lower()
            follows = tokens[after] if after < len(tokens) else ""
            if token.startswith('"'):
                out.append("`" + token[1:-1] + "`")
            elif name == "information_schema" and follows == ".":
                out.append("information_schema_")
                k = after + 1
                continue
            elif name == "array" and follows == "[":
                own, k = self._bracket(tokens, after)
                out.append(f"array({own})")
                continue
            elif call and (name in AGGREGATES or name in ("lookup", "bloom_filter", "bloom_filter_test")):
                args, k = self._arguments(tokens, after)
                if name == "lookup":
                    out.append(self._lookup(args))
                elif name.startswith("bloom"):
                    if len(args) != 2:
                        raise Invalid(token, "takes 2 arguments")
                    value, other = (a.strip() for a in args)
                    if name == "bloom_filter":
                        out.append(bloom.build(f"({value})", int(other)))
                    else:
                        if other.startswith("'"):
                            bloom.checked(other.strip("'"))
                        out.append(bloom.test(f"({value})", other))
                else:
                    if name in ("earliest", "latest") and len(args) > 1 and not args[1].strip().isdigit():
                        name += "_by"
                    shape, needed = AGGREGATES[name]
                    if len(args) < needed:
                        raise Invalid(token, f"takes {needed} arguments")
                    out.append(shape.format(*(a.strip() for a in args)))
                continue
            else:
                out.append(token)
            k += 1
        return out

    def _bracket(self, tokens: list[str], at: int) -> tuple[str, int]:
        """What stands in square brackets, and where they end."""
        deep = 0
        for k in range(at, len(tokens)):
            deep += (tokens[k] == "[") - (tokens[k] == "]")
            if deep == 0:
                return "".join(self._rewrite(tokens[at + 1 : k])), k + 1
        raise Invalid("SQL", "a bracket isn't closed")

    def _arguments(self, tokens: list[str], at: int) -> tuple[list[str], int]:
        deep, args, own = 0, [], []
        for k in range(at, len(tokens)):
            t = tokens[k]
            deep += (t == "(") - (t == ")")
            if deep == 0:
                args.append("".join(self._rewrite(own)))
                return args, k + 1
            if t == "," and deep == 1:
                args.append("".join(self._rewrite(own)))
                own = []
            elif not (t == "(" and deep == 1 and k == at):
                own.append(t)
        raise Invalid("SQL", "a parenthesis isn't closed")

    def _lookup(self, args: list[str]) -> str:
        name = args[1].strip().strip("'")
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in self.catalog.lookup(name).items())
        return f"element_at(map({pairs}), CAST({args[0]} AS STRING))"

    def information_schema(self) -> dict[str, Callable[[], DataFrame]]:
        make = self.spark.createDataFrame

        def columns() -> DataFrame:
            schemas = [(n, self.catalog.table(n).schema) for n in self.catalog.names]
            rows = [("tidemark", n, f.name, k + 1, f.dataType.simpleString().upper(), "NO" if f.name == "__time" else "YES") for n, schema in schemas for k, f in enumerate(schema)]
            return make(rows, "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, IS_NULLABLE string")

        return {
            "SCHEMATA": lambda: make([("tidemark",)], "SCHEMA_NAME string"),
            "TABLES": lambda: make([("tidemark", n, "TABLE") for n in self.catalog.names], "TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string"),
            "COLUMNS": columns,
        }


#: What PARTITIONED BY takes, and the form of its folders' names.
PARTITIONS = {"HOUR": "yyyy-MM-dd-HH", "DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy", "ALL": None, "ALL TIME": None}


def insert(sql: Sql, text: str, path: str) -> None:
    """INSERT INTO or REPLACE INTO: the query's rows are written to `path`, in a folder `date=...` for each bucket of PARTITIONED BY.

    REPLACE writes beside the table first and takes its place when all is written, so its query may read the table.
    """
    match = re.match(r"\s*(INSERT|REPLACE)\s+INTO\s+(\w+)\s+(.*)", text, re.S | re.I)
    if not match:
        raise Unsupported("INSERT", "only INSERT INTO and REPLACE INTO name SELECT")
    body = re.sub(r"\bOVERWRITE\s+ALL\b", "", match[3], flags=re.I)
    by = re.search(r"\s+PARTITIONED\s+BY\s+(\w+(?:\s+TIME)?)\s*;?\s*$", body, flags=re.I)
    body = body[: by.start()] if by else body
    grain = " ".join(by[1].upper().split()) if by else "ALL"
    if grain not in PARTITIONS:
        raise Unsupported("PARTITIONED BY", grain)
    rows = sql(body)
    parted = PARTITIONS[grain] is not None
    if parted and "__time" not in rows.columns:
        raise Invalid("PARTITIONED BY", "the query has no column __time")
    rows = rows.withColumn("date", F.date_format("__time", PARTITIONS[grain])) if parted else rows
    target = f"{path}/{match[2]}"

    def put(mode: str, to: str) -> None:
        writer = rows.write.mode(mode)
        (writer.partitionBy("date") if parted else writer).parquet(to)

    if match[1].upper() == "INSERT":
        put("append", target)
        return
    beside = f"{path}/.{match[2]}-{uuid.uuid4().hex}"
    put("error", beside)
    jvm, conf = sql.spark._jvm, sql.spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(target)
    files = old.getFileSystem(conf)
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{beside} is written, but can't be renamed {target}")


def session(catalog: Catalog) -> Sql:
    return Sql(catalog)
