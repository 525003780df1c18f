"""Joins that split hot keys among tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is hot, and the parts into which its rows are split. There are at most
#: rows / HOT_ROWS hot keys, so their list stays small enough to broadcast at any size.
HOT_ROWS, SALTS = 1_000_000, 32


def salted_join(rows: DataFrame, sizes: DataFrame, keys: list[str], count: str, spread_by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``sizes`` (one row for each key, whose ``count`` is its number of rows).

    Rows of a hot key are spread over ``SALTS`` parts by a hash of ``spread_by``, and its row of
    ``sizes`` is repeated for each; other keys join as usual.
    """
    is_hot = F.col(count) > hot_rows
    hot = F.broadcast(sizes.filter(is_hot).select(*keys, F.lit(SALTS).alias("__salts")))  # at most rows / hot_rows
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    right = sizes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    return left.join(right, [*keys, "__salt"]).drop("__salt")
