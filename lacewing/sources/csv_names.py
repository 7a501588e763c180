"""Names from CSV files, and results as CSV rows."""

from __future__ import annotations

import csv
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.plans.numbering import numbered_rows


def read_names(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(id, name) of a UTF-8 CSV with a header; ids are positions from 0, missing cells are empty."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    if column not in table.columns:
        raise ValueError(f"no column {column!r} in {path}: {', '.join(table.columns)}")
    rows = table.select(F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("name"))
    return numbered_rows(rows)


def write_rows(rows: DataFrame, header: list[str], out: TextIO) -> int:
    """Rows in the order of their first two columns, streamed through the driver; scores with four decimals."""
    w, n = csv.writer(out), 0
    w.writerow(header)
    for row in rows.orderBy(*rows.columns[:2]).toLocalIterator():
        w.writerow([f"{v:.4f}" if isinstance(v, float) else v for v in row])
        n += 1
    return n
