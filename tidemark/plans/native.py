"""The JSON query algebra: a spec becomes one lazy DataFrame, and Catalyst plans the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import TIME, Catalog
from tidemark.errors import Invalid, Unsupported
from tidemark.functions.expressions import over_columns
from tidemark.functions.granularity import FIXED, bucket, millis, named, within
from tidemark.operators.aggregators import Aggregators, PostAggregators, finalized
from tidemark.operators.dims import dimension
from tidemark.operators.filters import Filters, searched

TIMESTAMP = "timestamp"


class Native:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def __call__(self, spec: dict) -> DataFrame:
        kind = spec.get("queryType")
        build = getattr(self, f"_{kind}", None) if kind in QUERY_TYPES else None
        if build is None:
            raise Unsupported("query", f"type {kind!r}")
        return build(spec)

    # sources

    def source(self, spec) -> DataFrame:
        if isinstance(spec, str):
            return self.catalog.table(spec)
        kind = spec["type"]
        if kind == "table":
            return self.catalog.table(spec["name"])
        if kind == "union":
            tables = [self.source(x) for x in spec["dataSources"]]
            out = tables[0]
            for t in tables[1:]:
                out = out.unionByName(t, allowMissingColumns=True)
            return out
        if kind == "query":
            return self(spec["query"]).withColumnRenamed(TIMESTAMP, TIME)
        if kind == "lookup":
            rows = list(self.catalog.lookup(spec["lookup"]).items())
            return self.catalog.spark.createDataFrame(rows, "k string, v string")
        if kind == "inline":
            types = spec.get("columnTypes") or ["STRING"] * len(spec["columnNames"])
            fields = ", ".join(f"`{n}` {dict(LONG='bigint', DOUBLE='double', FLOAT='float').get(t, 'string')}" for n, t in zip(spec["columnNames"], types, strict=True))
            return self.catalog.spark.createDataFrame([tuple(r) for r in spec["rows"]], fields)
        if kind == "join":
            return self._join(spec)
        raise Unsupported("dataSource", f"type {kind!r}")

    def _join(self, spec: dict) -> DataFrame:
        """An equi-join on one key or more; null keys never match. The right side is broadcast only where Spark knows that it is small."""
        how = str(spec.get("joinType", "INNER")).upper()
        if how not in ("INNER", "LEFT"):
            raise Unsupported("join", f"joinType {how}")
        left, right, prefix = self.source(spec["left"]), self.source(spec["right"]), spec.get("rightPrefix", "")
        right = right.select(*(F.col(f"`{c}`").alias(prefix + c) for c in right.columns))
        clash = set(left.columns) & set(right.columns)
        if clash:
            right = right.withColumnsRenamed({c: f"__right_{c}" for c in clash})
        on = None
        for a, b in spec["keys"]:
            b = prefix + b
            b = f"__right_{b}" if b in clash else b
            for df, c in ((left, a), (right, b)):
                if isinstance(df.schema[c].dataType, T.ArrayType):
                    raise Invalid("join", f"{c} has several values a row")
            x, y = left[f"`{a}`"], right[f"`{b}`"]
            if left.schema[a].dataType != right.schema[b].dataType:
                x, y = x.cast("string"), y.cast("string")
            on = (x == y) if on is None else on & (x == y)
        return left.join(right, on, how.lower()).drop(*(f"__right_{c}" for c in clash))

    def rows(self, spec: dict) -> DataFrame:
        """The source with virtual columns, in the intervals and through the filter; filters come before any explosion."""
        of, test = spec["dataSource"], spec.get("filter")
        name = of if isinstance(of, str) else of.get("name") if of.get("type") == "table" else None
        made = {v["name"] for v in spec.get("virtualColumns") or []}
        if name is not None and test:
            # comparisons with the columns as they are stored reach the scan; virtual columns have no part in it
            df = self.catalog.table(name, lambda x: Filters(T.StructType([f for f in x.schema if f.name not in made])).necessary(test))
        else:
            df = self.source(of)
        intervals = spec.get("intervals")
        if isinstance(intervals, dict):
            intervals = intervals.get("intervals")
        if intervals and TIME in df.columns:
            df = df.where(within(F.col(TIME), intervals))
        for v in spec.get("virtualColumns") or []:
            if v["name"] == TIME:
                raise Invalid("virtual column", f"{TIME} is reserved")
            made = over_columns(v["expression"], df.schema).column
            kind = dict(LONG="bigint", DOUBLE="double", FLOAT="float", STRING="string").get(str(v.get("outputType", "")).upper())
            df = df.withColumn(v["name"], made.try_cast(kind) if kind else made)
        return df.where(Filters(df.schema)(spec["filter"])) if spec.get("filter") else df

    # aggregation

    def _aggregated(self, df: DataFrame, keys: list, spec: dict, post: bool = True) -> DataFrame:
        aggs = spec.get("aggregations") or []
        make = Aggregators(df.schema)
        columns = [make(a) for a in aggs] or [F.count(F.lit(1)).alias("__rows")]
        out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
        return self._post(out if aggs else out.drop("__rows"), spec) if post else out

    def _post(self, df: DataFrame, spec: dict) -> DataFrame:
        aggs = spec.get("aggregations") or []
        flat = {}
        for a in aggs:
            inner = a
            while inner["type"] == "filtered":
                inner = inner["aggregator"]
            flat[a.get("name") or inner.get("name")] = inner
        make = PostAggregators({n: a["type"] for n, a in flat.items()})
        for p in spec.get("postAggregations") or []:
            df = df.withColumn(p["name"], make(p))
        if (spec.get("context") or {}).get("finalize", True):
            sketches = {n: finalized(a["type"], F.col(f"`{n}`")) for n, a in flat.items() if a.get("shouldFinalize", True) and finalized(a["type"], F.col("x")) is not None and a["type"].lower().endswith(("sketch", "sketchbuild", "sketchmerge", "unique"))}
            df = df.withColumns(sketches) if sketches else df
        return df

    def _timeseries(self, spec: dict) -> DataFrame:
        df, grain = self.rows(spec), spec.get("granularity", "all")
        at = bucket(F.col(TIME), grain)
        if at is None:
            return self._aggregated(df, [], spec)
        out = self._aggregated(df, [at.alias(TIMESTAMP)], spec, post=False)
        name = named(grain)
        skip = (spec.get("context") or {}).get("skipEmptyBuckets", False)
        if isinstance(name, str) and name in FIXED and not skip:
            out = self._filled(out, name, spec)
        out = self._post(out, spec)
        return out.orderBy(F.desc(TIMESTAMP)) if spec.get("descending") else out

    @staticmethod
    def _filled(out: DataFrame, name: str, spec: dict) -> DataFrame:
        """Empty buckets between the first and last of each next coarser bucket: hours for less than hours, days, weeks.

        Without any data there is one bucket for the start of each interval.
        """
        outer = "hour" if FIXED[name] < FIXED["hour"] else "day" if FIXED[name] < FIXED["day"] else "week"
        step = F.expr(f"make_dt_interval(0, 0, 0, {FIXED[name] / 1000})")
        ends = out.groupBy(F.date_trunc(outer, TIMESTAMP).alias("macro")).agg(F.min(TIMESTAMP).alias("low"), F.max(TIMESTAMP).alias("high"))
        every = ends.select(F.explode(F.sequence("low", "high", step)).alias(TIMESTAMP))
        intervals = spec.get("intervals")
        intervals = intervals.get("intervals") if isinstance(intervals, dict) else intervals
        if intervals:
            starts = sorted({millis(i.split("/")[0]) // FIXED[name] * FIXED[name] for i in ([intervals] if isinstance(intervals, str) else intervals)})
            none = out.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            every = every.union(none.select(F.explode(F.array(*(F.timestamp_millis(F.lit(x)) for x in starts)))))
        out = every.join(out, TIMESTAMP, "left")
        counts = [a["name"] for a in spec.get("aggregations") or [] if a["type"] == "count"]
        return out.na.fill(0, counts) if counts else out

    def _topN(self, spec: dict) -> DataFrame:
        df, name = dimension(self.rows(spec), spec["dimension"], self.catalog)
        at = bucket(F.col(TIME), spec.get("granularity", "all")) if TIME in df.columns else None
        keys = [F.col(f"`{name}`"), *([] if at is None else [at.alias(TIMESTAMP)])]
        out = self._aggregated(df, keys, spec)
        metric = spec["metric"]
        metric = {"type": "numeric", "metric": metric} if isinstance(metric, str) else metric
        out, order = self._metric(out, name, metric, False)
        limit = int(spec["threshold"])
        if at is None:
            return out.orderBy(*order).limit(limit)
        rank = F.row_number().over(W.partitionBy(TIMESTAMP).orderBy(*order))
        return out.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")

    def _metric(self, out: DataFrame, name: str, metric: dict, flip: bool) -> tuple[DataFrame, list[Column]]:
        kind, text = metric["type"], F.col(f"`{name}`").cast("string")
        if kind == "inverted":
            return self._metric(out, name, metric["metric"] if isinstance(metric["metric"], dict) else {"type": "numeric", "metric": metric["metric"]}, not flip)
        if kind == "numeric":
            if metric["metric"] not in out.columns:
                raise Invalid("topN", f"{metric['metric']} names no aggregation")
            value = F.coalesce(F.col(f"`{metric['metric']}`").cast("double"), F.lit(0.0))
            return out, [value.asc(), text.desc()] if flip else [value.desc(), text.asc()]
        if kind in ("dimension", "lexicographic"):
            numeric = metric.get("ordering") == "numeric"
            key = text.try_cast("double") if numeric else text
            if metric.get("previousStop") is not None:
                stop = F.lit(str(metric["previousStop"]))
                stop = stop.try_cast("double") if numeric else stop
                out = out.where(key < stop if flip else key > stop)
            return out, [key.desc(), text.desc()] if flip else [key.asc(), text.asc()]
        raise Unsupported("topN", f"metric {kind!r}")

    def _groupBy(self, spec: dict) -> DataFrame:
        df, names = self.rows(spec), []
        for d in spec.get("dimensions") or []:
            df, name = dimension(df, d, self.catalog)
            names.append(name)
        at = bucket(F.col(TIME), spec.get("granularity", "all")) if TIME in df.columns else None
        if at is not None:
            df = df.withColumn(TIMESTAMP, at)
        time = [] if at is None else [TIMESTAMP]
        subtotals = spec.get("subtotalsSpec")
        if subtotals:
            unknown = {d for s in subtotals for d in s} - set(names)
            if unknown:
                raise Invalid("subtotalsSpec", f"no such dimension: {sorted(unknown)}")
            make = Aggregators(df.schema, names)
            sets = [[F.col(f"`{c}`") for c in [*time, *s]] for s in subtotals]
            columns = [F.col(f"`{c}`") for c in [*time, *names]]
            out = self._post(df.groupingSets(sets, *columns).agg(*(make(a) for a in spec.get("aggregations") or [])), spec)
        else:
            out = self._aggregated(df, [F.col(f"`{c}`") for c in [*time, *names]], spec)
        if spec.get("having"):
            out = out.where(self._having(spec["having"]))
        limit = spec.get("limitSpec")
        if limit:
            order = [self._order(c) for c in limit.get("columns") or []]
            out = out.orderBy(*order) if order else out
            out = out.offset(int(limit["offset"])) if limit.get("offset") else out
            out = out.limit(int(limit["limit"])) if limit.get("limit") is not None else out
        return out

    @staticmethod
    def _order(spec) -> Column:
        spec = {"dimension": spec} if isinstance(spec, str) else spec
        c = F.col(f"`{spec['dimension']}`")
        if spec.get("dimensionOrder") in ("lexicographic", "alphanumeric"):
            c = c.cast("string")
        elif spec.get("dimensionOrder") == "numeric":
            c = c.try_cast("double")
        down = str(spec.get("direction", "ascending")).lower().startswith("desc")
        return c.desc_nulls_last() if down else c.asc_nulls_first()

    def _having(self, spec: dict) -> Column:
        kind = spec["type"]
        if kind in ("and", "or"):
            out = F.lit(kind == "and")
            for s in spec["havingSpecs"]:
                out = out & self._having(s) if kind == "and" else out | self._having(s)
            return out
        if kind == "not":
            return ~self._having(spec["havingSpec"])
        value = F.col(f"`{spec['aggregation']}`").cast("double")
        test = {"greaterThan": value > spec["value"], "lessThan": value < spec["value"], "equalTo": value == spec["value"]}.get(kind)
        if test is None:
            raise Unsupported("having", f"type {kind!r}")
        return F.coalesce(test, F.lit(False))

    # rows

    def _scan(self, spec: dict) -> DataFrame:
        df = self.rows(spec)
        order = spec.get("order", "none")
        if order in ("ascending", "descending"):
            df = df.orderBy(F.asc(TIME) if order == "ascending" else F.desc(TIME))
        if spec.get("columns"):
            have = set(df.columns)
            df = df.select(*(F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in spec["columns"]))
        df = df.offset(int(spec["offset"])) if spec.get("offset") else df
        return df.limit(int(spec["limit"])) if spec.get("limit") is not None else df

    def _search(self, spec: dict) -> DataFrame:
        df = self.rows(spec)
        names = spec.get("searchDimensions") or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        names = [n if isinstance(n, str) else n["dimension"] for n in names]
        types = {f.name: f.dataType for f in df.schema}
        value = lambda n: F.col(f"`{n}`").cast("array<string>") if isinstance(types[n], T.ArrayType) else F.array(F.col(f"`{n}`").cast("string"))
        named_values = lambda n: F.transform(value(n), lambda x: F.struct(F.lit(n).alias("dimension"), x.alias("value")))
        pairs = F.flatten(F.array(*map(named_values, names)))
        at = bucket(F.col(TIME), spec.get("granularity", "all")) if TIME in df.columns else None
        keys = [] if at is None else [at.alias(TIMESTAMP)]
        found = df.select(*keys, F.explode(pairs).alias("p")).select(*([] if at is None else [TIMESTAMP]), "p.*")
        found = found.where(F.col("value").isNotNull() & searched(F.col("value"), spec["query"]))
        time = [] if at is None else [TIMESTAMP]
        out = found.groupBy(*time, "dimension", "value").agg(F.count(F.lit(1)).alias("count"))
        sort = spec.get("sort") or {}
        sort = sort if isinstance(sort, str) else sort.get("type", "lexicographic")
        order = [F.length("value"), F.col("value"), F.col("dimension")] if sort == "strlen" else [F.col("value"), F.col("dimension")]
        if spec.get("limit") is None:
            return out
        if at is None:
            return out.orderBy(*order).limit(int(spec["limit"]))
        return out.withColumn("__rank", F.row_number().over(W.partitionBy(TIMESTAMP).orderBy(*order))).where(F.col("__rank") <= int(spec["limit"])).drop("__rank")

    # metadata

    def _timeBoundary(self, spec: dict) -> DataFrame:
        low, high = F.min(TIME).alias("minTime"), F.max(TIME).alias("maxTime")
        wanted = {"minTime": [low], "maxTime": [high]}.get(spec.get("bound"), [low, high])
        return self.rows(spec).agg(*wanted)

    def _dataSourceMetadata(self, spec: dict) -> DataFrame:
        return self.rows(spec).agg(F.max(TIME).alias("maxIngestedEventTime"))

    def _segmentMetadata(self, spec: dict) -> DataFrame:
        """One row per column: type, hasMultipleValues, cardinality (distinct strings, else rows) and size (8 bytes a row)."""
        df = self.rows(spec)
        parts = []
        for f in df.schema:
            many = isinstance(f.dataType, T.ArrayType)
            text = isinstance(f.dataType, T.StringType)
            distinct = F.count_distinct(F.col(f"`{f.name}`")) if text else F.count(F.lit(1))
            parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(many).alias("hasMultipleValues"), distinct.alias("cardinality"), (F.count(F.lit(1)) * 8).alias("size")))
        return df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")

    # windows

    def _window(self, spec: dict) -> DataFrame:
        """Window functions over rows; without a frame it is the whole partition, also with an order."""
        df = self.rows(spec)
        columns = [F.col(f"`{c}`") for c in spec.get("columns") or df.columns]
        made = [self._windowed(w).alias(w["outputName"]) for w in spec["windows"]]
        out = df.select(*columns, *made)
        if spec.get("orderBy"):
            out = out.orderBy(*(self._order(c) for c in spec["orderBy"]))
        return out.limit(int(spec["limit"])) if spec.get("limit") is not None else out

    def _windowed(self, s: dict) -> Column:
        kind = s["function"].upper()
        over = W.partitionBy(*(F.col(f"`{c}`") for c in s.get("partitionBy") or []))
        order = [self._order(c) for c in s.get("orderBy") or []]
        over = over.orderBy(*order) if order else over
        c = F.col(f"`{s['column']}`") if s.get("column") else None
        ranked = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "CUME_DIST": F.cume_dist, "PERCENT_RANK": F.percent_rank}
        if kind in ranked:
            return ranked[kind]().over(over if order else over.orderBy(F.lit(0)))
        if kind == "NTILE":
            return F.ntile(int(s["n"])).over(over)
        if kind in ("LAG", "LEAD"):
            return getattr(F, kind.lower())(c, int(s.get("offset", 1))).over(over)
        frame = s.get("frame") or {}
        ends = [self._end(frame.get("start", "UNBOUNDED PRECEDING")), self._end(frame.get("end", "UNBOUNDED FOLLOWING"))]
        if ends[0] > ends[1]:
            raise Invalid("window", "the frame ends before it starts")
        over = over.rowsBetween(*ends)
        whole = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "FIRST_VALUE": F.first_value, "LAST_VALUE": F.last_value}
        if kind in whole:
            return whole[kind](c).over(over)
        if kind == "COUNT":
            return F.count(F.lit(1) if c is None else c).over(over)
        if kind == "NTH_VALUE":
            return F.nth_value(c, int(s["n"])).over(over)
        raise Unsupported("window", f"function {kind}")

    @staticmethod
    def _end(text) -> int:
        if isinstance(text, int):
            return text
        n, side = text.upper().rsplit(" ", 1)
        if n == "CURRENT":
            return W.currentRow
        if n == "UNBOUNDED":
            return W.unboundedPreceding if side == "PRECEDING" else W.unboundedFollowing
        return -int(n) if side == "PRECEDING" else int(n)

    def _unionAll(self, spec: dict) -> DataFrame:
        parts = [self(q) for q in spec["queries"]]
        if len({len(p.columns) for p in parts}) != 1:
            raise Invalid("unionAll", "the queries differ in their number of columns")
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


QUERY_TYPES = ("timeseries", "topN", "groupBy", "scan", "search", "timeBoundary", "dataSourceMetadata", "segmentMetadata", "window", "unionAll")
