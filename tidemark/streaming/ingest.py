"""Streaming ingestion and windows on Structured Streaming: checkpoints give exactly-once files, a dead-letter folder takes what can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import TIME
from tidemark.errors import Unsupported
from tidemark.sources.ingest import timestamp


def decoded(payloads: DataFrame, schema: str, time: dict) -> tuple[DataFrame, DataFrame]:
    """`payloads` (value: JSON text) as rows with a time, and those that have none or can't be read."""
    parsed = payloads.select(F.col("value").cast("string").alias("value"), F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("row"))
    fields = parsed.select("row.*")
    if time["column"] not in fields.columns:
        raise KeyError(time["column"])
    rows = parsed.select("value", "row.*")
    rows = rows.withColumn(TIME, timestamp(rows, time))
    return rows.where(F.col(TIME).isNotNull()).drop("value"), rows.where(F.col(TIME).isNull()).select("value")


def run(payloads: DataFrame, schema: str, time: dict, out: str, dead: str, checkpoint: str):
    """Consumes what there is and stops; begun again it goes on after the last commit."""

    def batch(df: DataFrame, number: int) -> None:
        good, bad = decoded(df, schema, time)
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is repeated overwrites itself
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(rows: DataFrame, size: str, late: str, *keys: str) -> DataFrame:
    return rows.withWatermark(TIME, late).groupBy(F.window(TIME, size), *keys).agg(F.count(F.lit(1)).alias("rows"))


def sliding(rows: DataFrame, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    return rows.withWatermark(TIME, late).groupBy(F.window(TIME, size, slide), *keys).agg(F.count(F.lit(1)).alias("rows"))


def sessions(rows: DataFrame, gap: str, late: str, key: str, *keys: str) -> DataFrame:
    return rows.withWatermark(TIME, late).groupBy(F.session_window(TIME, gap), key, *keys).agg(F.count(F.lit(1)).alias("rows"))


def deduplicated(rows: DataFrame, late: str, *keys: str) -> DataFrame:
    """The first row of each key; state is kept for as long as rows may be late."""
    return rows.withWatermark(TIME, late).dropDuplicatesWithinWatermark(list(keys))


def joined(left: DataFrame, right: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Pairs of rows with the same key, of which the right one comes at most `within` after the left one."""
    x, y = left.withWatermark(TIME, late).alias("x"), right.withWatermark(TIME, late).alias("y")
    near = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col(f"y.{TIME}") >= F.col(f"x.{TIME}")) & (F.col(f"y.{TIME}") <= F.col(f"x.{TIME}") + F.expr(f"INTERVAL {within}"))
    return x.join(y, near)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def kafka(spark: SparkSession, spec: dict) -> DataFrame:
    """Payloads of a supervisor spec's topic; needs Spark's Kafka package. A task's share is bounded, so a long backlog comes in many batches."""
    io = spec["ioConfig"]
    options = {f"kafka.{k}": str(v) for k, v in io["consumerProperties"].items()}
    options |= {"subscribe": io["topic"], "startingOffsets": "earliest" if io.get("useEarliestOffset") else "latest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": str(io.get("maxRowsPerBatch", 10_000_000))}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def supervised(spark: SparkSession, spec: dict, schema: str, out: str, dead: str, checkpoint: str):
    """Runs a supervisor spec: of type kafka from its topic, of type files from a folder of lines of JSON."""
    kind = spec.get("type")
    if kind not in ("kafka", "files"):
        raise Unsupported("supervisor", f"type {kind!r}")
    payloads = kafka(spark, spec) if kind == "kafka" else files(spark, spec["ioConfig"]["folder"])
    return run(payloads, schema, spec["dataSchema"]["timestampSpec"], out, dead, checkpoint)
