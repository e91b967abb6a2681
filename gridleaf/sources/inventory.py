"""Folder listing as a table, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modificationTime`` of every file below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", "modificationTime")
    )


def render_outputs(rows: DataFrame, fmt: str, title: Column, body: Column) -> DataFrame:
    """One text value per row: plain text, Markdown with a heading, or the whole row as JSON."""
    if fmt == "txt":
        value = body
    elif fmt == "md":
        value = F.concat(F.lit("# "), title, F.lit("\n\n"), body)
    elif fmt == "json":
        value = F.to_json(F.struct(*rows.columns))
    else:
        raise ValueError(f"unknown format: {fmt}")
    return rows.select(value.alias("value"))


def write_outputs(rows: DataFrame, path: str, fmt: str, title: Column | None = None, body: Column | None = None) -> None:
    """Write results; the commit protocol publishes all files of a job or none."""
    if fmt == "parquet":
        rows.write.mode("errorifexists").parquet(path)
    else:
        render_outputs(rows, fmt, title, body).write.mode("errorifexists").text(path)
