"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from stallbook.session import ship_package
from stallbook.sources.scratch import discard, materialise, shared_folder

__all__ = ["discard", "materialise", "numbered", "read", "ship_package", "shared_folder", "whole_text"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, as it is."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; NULL is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def numbered(rows: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the row's place (from 0) in its group, and ``name_total``, the group's rows.

    A group is never sorted in one task. ``bucket`` cuts it into consecutive parts: rows of a
    smaller bucket come first, rows of one bucket are ordered by ``order``. Only the counts per
    group and bucket are summed up in order, so ``bucket`` should have a fixed number of values.
    Groups and bucket are never NULL, so that one shuffle of the rows serves the place and the join.
    """
    keys = [*groups, "_bucket"]
    rows = rows.withColumn("_bucket", bucket)
    whole = W.partitionBy(*groups)
    offsets = (
        rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(whole))
        .select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_before", "_total")
    )
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_o_{k}"))
    return (
        placed.join(offsets, same)
        .withColumn(name, F.col("_before") + F.col("_place") - 1)
        .withColumn(f"{name}_total", F.col("_total"))
        .drop("_before", "_total", "_place", "_bucket", *[f"_o_{k}" for k in keys])
    )
