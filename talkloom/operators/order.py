"""Positions and running sums within groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.session import cut_lineage


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], position: str | None = None, size: str | None = None) -> DataFrame:
    """Adds running sums (including the own row), positions from 1 and group sizes.

    The rows are range-partitioned by group and order, so that a large group is split among tasks;
    each part sums up for itself, and the totals of the parts before (one row for each group and
    part) are added. The sorted rows are checkpointed, so that parts and totals agree.
    """
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    sums = {**sums, **({position: F.lit(1)} if position else {})}
    values = {f"__v{i}": c.cast("bigint") for i, c in enumerate(sums.values())}
    cut = df.withColumns({**keys, **values}).repartitionByRange(*group, *keys)
    rows = cut_lineage(cut.withColumn("__part", F.spark_partition_id()))
    parts = rows.groupBy(*group, "__part").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = parts.select(*group, "__part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}b") for v in values], F.sum("__n").over(whole).alias("__size"))
    same = [rows[g].eqNullSafe(offsets[g]) for g in group] + [rows["__part"] == offsets["__part"]]
    joined = rows.join(offsets, same).drop(*[offsets[g] for g in group], offsets["__part"])
    within = Window.partitionBy(*group, "__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({name: F.sum(v).over(within) + F.col(f"{v}b") for name, v in zip(sums, values)})
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.drop(*keys, *values, "__part", "__size", *[f"{v}b" for v in values])
