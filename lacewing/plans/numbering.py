"""Consecutive numbers for rows in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle

ROW_BITS = 33  # of a monotonically increasing id


def numbered_rows(rows: DataFrame, first: int = 0, column: str = "id") -> DataFrame:
    """rows with `column`: first, first + 1, ... in their order. Each partition numbers its own rows; the offsets, one for
    each partition, are joined. Columns of rows may have any names but that one."""
    own = settle(rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("m")))
    part, place = F.shiftright("m", ROW_BITS), F.col("m").bitwiseAND((1 << ROW_BITS) - 1)
    at, offsets = first, []
    for p, n in sorted(map(tuple, own.groupBy(part.alias("p")).agg(F.max(place) + 1).collect())):
        offsets.append((p, at))
        at += n
    table = rows.sparkSession.createDataFrame(offsets, "p long, at long")
    return own.join(table, part == table["p"]).select((F.col("at") + place).alias(column), "row.*")
