"""Reading tables: Parquet folders, CSV globs, tolerant schemas, fallbacks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import spread


def load(spark: SparkSession, base: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table ``name`` below ``base``; only ``columns`` reach the scan when given."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def load_spread(spark: SparkSession, base: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Like ``load`` for work on whole texts: rows of a table in one small file are spread over the cores."""
    return spread(load(spark, base, name, columns))


def scan_between(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows with ``start <= column < end``; the bounds are literals, so Parquet statistics prune."""
    kind = df.schema[column].dataType.simpleString()
    low, high = (F.lit(x).cast(kind) for x in (start, end))
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def read_csv(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Many CSV files as one table. The schema is explicit: inference would read everything twice."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').option("mode", "PERMISSIVE").csv(pattern)
    )


def usable_projection(df: DataFrame, columns: Sequence[str], condition: Column) -> DataFrame:
    """Filter early and keep ``columns``: both are pushed into the scan."""
    return df.where(condition).select(*columns)


def tolerant(df: DataFrame, wanted: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The wanted columns that exist, in the wanted order; ``defaults`` fill columns that are absent."""
    defaults = defaults or {}
    there = set(df.columns)
    out = [F.col(f"`{c}`") if c in there else F.lit(defaults[c]).alias(c) for c in wanted if c in there or c in defaults]
    return df.select(*out)


def first_available(spark: SparkSession, base: str, names: Iterable[str]) -> DataFrame:
    """The first of ``names`` that can be read, for example deduplicated articles, else labelled ones."""
    failure: Exception | None = None
    for name in names:
        try:
            return load(spark, base, name)
        except Exception as error:  # a path that is absent; the next name is tried
            failure = error
    raise FileNotFoundError(f"none of the tables is below {base}") from failure
