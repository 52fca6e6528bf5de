"""What a session knows of itself, as rows: tables, columns and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """(name, kind, temporary) of the tables and views that a pattern (* for any characters) fits."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(pattern=pattern)]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean").orderBy("name")


def columns(spark: SparkSession, table: str) -> DataFrame:
    """(column, type, nullable) of a table."""
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "column string, type string, nullable boolean")


def has_columns(spark: SparkSession, table: str, *names: str) -> bool:
    """Whether a table has all the columns that a newer version added."""
    return set(names) <= {c.name for c in spark.catalog.listColumns(table)}


def has_function(spark: SparkSession, name: str) -> bool:
    return spark.catalog.functionExists(name)
