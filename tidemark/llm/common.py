"""What the operators share: word rules, shared storage and Arrow helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; fixed by the data contracts.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, body) -> Column:
    """Binds a value to a lambda's variable, so that it is computed once a row and not once an element."""
    return F.transform(F.array(value), body)[0]


def free(name: str, df: DataFrame) -> str:
    """The name, with as many underscores after it as make it differ from all columns of `df`, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. A session on one machine without one (tests) gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = sc.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As `checkpointed`, for rows with texts: a compressed table in the same folder, of which later reads take the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a `written` table that no later step reads."""
    spark = table.sparkSession
    jvm, path = spark._jvm, os.path.dirname(table.inputFiles()[0]) if table.inputFiles() else None
    if path and os.path.basename(path).startswith("tidemark-"):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing refers to any more, now and not when the driver next collects its garbage.

    To be called when a step's result is stored and its plans are out of reach. Python tells the driver of plans that it has let go of
    about once a second.
    """
    gc.collect()
    time.sleep(1.5)
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows; texts go to Python in batches of `rows` at most."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
