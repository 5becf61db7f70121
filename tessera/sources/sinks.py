"""Sinks: upsert and append on Parquet, CSV and JSON rows, and a small HTML report."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tessera.sources.shared import shared_path


def upsert(current: DataFrame | None, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table after the changes: per key the last change by order, else the current row."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return last if current is None else current.join(last, list(keys), "left_anti").unionByName(last)


def flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, nulls as empty text."""
    columns = []
    for field in rows.schema.fields:
        column = F.col(f"`{field.name}`")
        text = F.to_json(column) if isinstance(field.dataType, (ArrayType, MapType, StructType)) else column.cast("string")
        columns.append(F.coalesce(text, F.lit("")).alias(field.name))
    return rows.select(*columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV row per row, nested values as JSON."""
    flat(rows).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Append to a Parquet log."""
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Overwrite a table that rows may be read from: written aside first; where overwriting fails, the error names the whole copy."""
    aside = shared_path(rows.sparkSession, "replace")
    rows.write.parquet(aside)
    try:
        rows.sparkSession.read.schema(rows.schema).parquet(aside).write.mode("overwrite").parquet(path)
    except Exception as error:
        raise RuntimeError(f"{path} was not replaced; its rows are whole in {aside}") from error


def html_report(summary: DataFrame, title: str, most: int = 10_000) -> str:
    """A page with a table of a summary (a few rows of aggregates); a summary of more than `most` rows is refused."""
    rows = flat(summary).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; write a table instead")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in summary.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in row) + "</tr>" for row in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"
