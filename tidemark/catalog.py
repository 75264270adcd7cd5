"""Datasources: tables with a time column `__time`, and the lookups that queries name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Invalid

TIME = "__time"


def timed(df: DataFrame, time: str | None = None) -> DataFrame:
    """`df` with `time` as `__time` (timestamp) in front."""
    if time is not None:
        df = df.select(F.col(time).cast("timestamp").alias(TIME), *(c for c in df.columns if c != time))
    if TIME not in df.columns:
        raise Invalid("datasource", f"no column {TIME}")
    return df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN, which is no value here, becomes null."""
    nan = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in nan}) if nan else df


@dataclass
class Catalog:
    """Tables are read when a query first names them; `plain` has them as they are, `tables` without NaN."""

    spark: SparkSession
    plain: dict[str, DataFrame] = field(default_factory=dict)
    lookups: dict[str, dict[str, str]] = field(default_factory=dict)
    waiting: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, time: str | None = None) -> Catalog:
        self.plain[name] = timed(df, time)
        return self

    def add_file(self, name: str, path: str, time: str | None = None) -> Catalog:
        self.waiting[name] = lambda: timed(self.spark.read.parquet(path), time)
        return self

    @property
    def names(self) -> list[str]:
        return sorted({*self.plain, *self.waiting})

    def table(self, name: str, keep: Callable[[DataFrame], Column | None] = lambda _: None) -> DataFrame:
        """The table without NaN. `keep` says what its rows must fulfil at least, which the scan is given as it stands."""
        if name not in self.plain:
            if name not in self.waiting:
                raise Invalid("dataSource", f"unknown table {name}")
            self.plain[name] = self.waiting.pop(name)()
        df = self.plain[name]
        test = keep(df)
        return without_nan(df if test is None else df.where(test))

    def lookup(self, name: str) -> dict[str, str]:
        if name not in self.lookups:
            raise Invalid("lookup", f"unknown lookup {name}")
        return self.lookups[name]

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, times: dict[str, str]) -> Catalog:
        """The Parquet tables of a folder, by name and time column."""
        out = cls(spark)
        for name, time in times.items():
            out.add_file(name, f"{folder}/{name}.parquet", time)
        return out
