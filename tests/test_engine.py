import json

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.errors import Invalid
from tidemark.operators.filters import Filters
from tidemark.plans.native import Native
from tidemark.sources.ingest import ingest, read
from tidemark.sql.session import Sql, insert
from tidemark.streaming.ingest import deduplicated, files, joined, run, sessions, sliding, supervised, tumbling

BIG = 1 << 60


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(BIG, 1, 0.5, "a"), (BIG + 1, 2, float("nan"), "b"), (3, None, None, None)], "id long, n int, x double, s string")


def passed(rows, spec):
    return sorted(r.id for r in rows.where(Filters(rows.schema)(spec)).collect())


def test_filters_are_typed(rows):
    sel = lambda d, v: {"type": "selector", "dimension": d, "value": v}
    assert passed(rows, sel("id", str(BIG))) == [BIG]
    assert passed(rows, sel("id", "3.0")) == [3] and passed(rows, sel("id", "3.5")) == []
    assert passed(rows, sel("n", "x")) == [] and passed(rows, sel("n", str(1 << 40))) == []
    assert passed(rows, {"type": "in", "dimension": "id", "values": ["x", str(BIG + 1), None]}) == [BIG + 1]
    bound = {"type": "bound", "dimension": "id", "ordering": "numeric"}
    assert passed(rows, bound | {"lower": str(BIG), "lowerStrict": True}) == [BIG + 1]
    assert passed(rows, bound | {"upper": "3.7"}) == [3] and passed(rows, bound | {"lower": "2.5", "upper": "3"}) == [3]
    assert passed(rows, bound | {"lower": "x"}) == [] and passed(rows, bound | {"lower": "1e30"}) == [] and passed(rows, bound | {"upper": "1e30"}) == [3, BIG, BIG + 1]
    assert passed(rows, {"type": "range", "column": "id", "matchValueType": "LONG", "lower": BIG, "lowerOpen": True}) == [BIG + 1]
    assert passed(rows, {"type": "regex", "dimension": "s", "pattern": "("}) == []
    assert passed(rows, {"type": "not", "field": {"type": "regex", "dimension": "s", "pattern": "["}}) == [3, BIG, BIG + 1]


@pytest.mark.parametrize(
    "spec",
    [
        {"type": "selector", "dimension": "id", "value": str(BIG)},
        {"type": "in", "dimension": "s", "values": ["a", "b"]},
        {"type": "bound", "dimension": "x", "lower": "0.1", "upper": "2", "ordering": "numeric"},
        {"type": "bound", "dimension": "s", "lower": "b"},
        {"type": "like", "dimension": "s", "pattern": "b%"},
        {"type": "or", "fields": [{"type": "selector", "dimension": "s", "value": "a"}, {"type": "selector", "dimension": "n", "value": 2}]},
        {"type": "and", "fields": [{"type": "selector", "dimension": "s", "value": "a"}, {"type": "not", "field": {"type": "selector", "dimension": "n", "value": 2}}]},
    ],
)
def test_filters_reach_the_scan(spark, rows, tmp_path, spec):
    rows.withColumn("t", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/rows.parquet")
    catalog = Catalog.of_folder(spark, str(tmp_path), {"rows": "t"})
    out = Native(catalog)({"queryType": "scan", "dataSource": "rows", "columns": ["id"], "filter": spec})
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert pushed, plan
    assert sorted(r.id for r in out.collect()) == passed(rows.withColumn("x", F.when(~F.isnan("x"), F.col("x"))), spec)


def test_virtual_columns_are_not_pushed(spark, rows):
    catalog = Catalog(spark).add("rows", rows.withColumn("__time", F.lit("2024-01-01").cast("timestamp")))
    spec = {"queryType": "scan", "dataSource": "rows", "columns": ["id"], "virtualColumns": [{"name": "n", "expression": "n + 1"}], "filter": {"type": "selector", "dimension": "n", "value": 2}}
    assert [r.id for r in Native(catalog)(spec).collect()] == [BIG]


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nmore\n2024-01-01T00:00:00,x|y,5\n1704067200000,z,6\n")
    spec = {"type": "csv", "columns": ["t", "tags", "v"], "skipHeaderRows": 2, "listDelimiter": "|", "listColumns": ["tags"]}
    got = read(spark, spec, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in got.collect()] == [("2024-01-01T00:00:00", ["x", "y"], "5"), ("1704067200000", ["z"], "6")]
    made = {"timestampSpec": {"column": "t"}, "dimensionsSpec": {"dimensions": ["tags"]}, "metricsSpec": [{"type": "longSum", "name": "v", "fieldName": "v"}], "granularitySpec": {"queryGranularity": "day"}}
    assert sorted((r["__time"].isoformat(), r.v) for r in ingest(got, made).collect()) == [("2024-01-01T00:00:00", 5), ("2024-01-01T00:00:00", 6)]
    with pytest.raises(Invalid):
        ingest(got, made | {"granularitySpec": {"rollup": True}})
    (tmp_path / "a.tsv").write_text('h\tk\n"q\t1\n')
    assert [tuple(r) for r in read(spark, {"type": "tsv", "findColumnsFromHeader": True}, str(tmp_path / "a.tsv")).collect()] == [('"q', "1")]
    (tmp_path / "a.json").write_text('{"year": "2023", "s": "x"}\n{"s": "y"}\n')
    json_rows = read(spark, {"type": "json"}, str(tmp_path / "a.json"))
    iso = {"timestampSpec": {"column": "year", "format": "iso"}, "dimensionsSpec": {"dimensions": ["s"]}}
    assert [r["__time"].year for r in ingest(json_rows, iso).collect()] == [2023]
    auto = ingest(json_rows, iso | {"timestampSpec": {"column": "year"}}).collect()
    assert [(r["__time"].year, r["__time"].microsecond) for r in auto] == [(1970, 23000)]


def test_insert_and_replace(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 05:00:00", 1), ("2024-01-02 06:00:00", 2)], "t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    sql = Sql(Catalog(spark).add("inserted_from", events, "t"))
    insert(sql, "INSERT INTO target SELECT __time, v FROM inserted_from PARTITIONED BY DAY", str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "target").glob("date=*")) == ["date=2024-01-01", "date=2024-01-02"]
    sql.catalog.add("target", spark.read.parquet(f"{tmp_path}/target").drop("date"))
    insert(sql, "REPLACE INTO target OVERWRITE ALL SELECT __time, v + 10 AS v FROM target WHERE v = 2 PARTITIONED BY ALL", str(tmp_path))
    assert [r.v for r in spark.read.parquet(f"{tmp_path}/target").collect()] == [12]
    assert [p.name for p in tmp_path.iterdir()] == ["target"]


def test_stream_of_files(spark, tmp_path):
    source, out, dead, checkpoint = (str(tmp_path / n) for n in ("in", "out", "dead", "checkpoint"))
    (tmp_path / "in").mkdir()
    line = lambda t, k: json.dumps({"t": t, "k": k}) + "\n"
    (tmp_path / "in" / "a.json").write_text(line("2024-01-01T00:00:10", "x") + line("2024-01-01T00:00:50", "x") + "no json\n" + line(None, "y"))
    spec = {"type": "files", "ioConfig": {"folder": source}, "dataSchema": {"timestampSpec": {"column": "t"}}}
    supervised(spark, spec, "t string, k string", out, dead, checkpoint).awaitTermination()
    (tmp_path / "in" / "b.json").write_text(line("2024-01-01T00:03:00", "z"))
    run(files(spark, source), "t string, k string", {"column": "t"}, out, dead, checkpoint).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["x", "x", "z"]
    assert spark.read.parquet(dead).count() == 2


def test_stream_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("00:00:10", "x"), ("00:00:50", "x"), ("00:01:30", "y"), ("00:00:10", "x")]
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"t": f"2024-01-01T{t}", "k": k}) + "\n" for t, k in lines))

    def rows():
        parsed = files(spark, str(tmp_path / "in")).select(F.from_json("value", "t string, k string").alias("r")).select("r.*")
        return parsed.select(F.col("t").cast("timestamp").alias("__time"), "k")

    def result(df, name, mode="complete"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted((r.k, r["rows"]) for r in result(tumbling(rows(), "1 minute", "1 hour", "k"), "tumbling")) == [("x", 3), ("y", 1)]
    assert sum(r["rows"] for r in result(sliding(rows(), "1 minute", "30 seconds", "1 hour"), "sliding2")) == 8
    assert sorted((r.k, r["rows"]) for r in result(sessions(rows(), "45 seconds", "1 hour", "k"), "sessions")) == [("x", 3), ("y", 1)]
    assert sorted(r.k for r in result(deduplicated(rows(), "1 hour", "k"), "deduplicated", "append")) == ["x", "y"]
    pairs = result(joined(rows(), rows(), "k", "1 minute", "1 hour"), "joined", "append")
    assert len(pairs) == 2 * 2 + 2 + 1 + 1


def test_bloom_filter(spark):
    from tidemark.errors import Unsupported

    df = spark.range(0, 2000).select(F.lit("2024-01-01").cast("timestamp").alias("__time"), F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), "id")).alias("v"))
    native = Native(Catalog(spark).add("t", df))
    for entries in (1000, 60_000):
        made = native({"queryType": "timeseries", "dataSource": "t", "granularity": "all", "aggregations": [{"type": "bloomFilter", "name": "b", "fieldName": "v", "maxNumEntries": entries}]}).first().b
        found = native({"queryType": "scan", "dataSource": "t", "columns": ["k"], "filter": {"type": "bloomFilter", "dimension": "v", "bloomKFilter": made}}).collect()
        assert sorted(r.k for r in found) == list(range(0, 2000, 3))
        other = native({"queryType": "scan", "dataSource": "t", "columns": ["k"], "filter": {"type": "bloomFilter", "dimension": "k", "bloomKFilter": made}}).collect()
        assert len(other) < 60
    with pytest.raises(Invalid):
        native({"queryType": "scan", "dataSource": "t", "filter": {"type": "bloomFilter", "dimension": "v", "bloomKFilter": "abc="}})
    with pytest.raises(Unsupported):
        native({"queryType": "timeseries", "dataSource": "t", "granularity": "all", "aggregations": [{"type": "bloomFilter", "name": "b", "fieldName": "v", "maxNumEntries": 1 << 26}]})
