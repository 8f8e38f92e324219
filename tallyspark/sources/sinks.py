"""Sinks. Tables are written by the executors; summaries and reports are small by their definition."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; `single` for a card or a report, which has a handful of rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> dict:
    """The one row of an aggregate as JSON text."""
    row = json.loads(df.select(F.to_json(F.struct(*df.columns)).alias("j")).first().j)
    df.sparkSession.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return row


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """A report's first `rows` rows."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect())])


def write_resolved(df: DataFrame, resolved: str, path: str) -> None:
    """Rows with the resolved key to one folder, the others to a side output."""
    df.where(F.col(resolved).isNotNull()).write.mode("overwrite").parquet(f"{path}/resolved")
    df.where(F.col(resolved).isNull()).write.mode("overwrite").parquet(f"{path}/unresolved")


def save_model(writer, path: str) -> str:
    """A new version beside the old ones; nothing is overwritten."""
    version = f"{path}/{uuid.uuid4()}"
    writer.save(version)
    return version
