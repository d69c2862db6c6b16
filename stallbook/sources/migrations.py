"""Schema migrations. Both can run again without changing a migrated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallbook import config
from stallbook.functions.casting import date_prefix
from stallbook.schemas import LISTING_TYPES


def add_missing_columns(
    df: DataFrame, columns: tuple[str, ...] = config.MANUAL_COLUMNS
) -> tuple[DataFrame, int]:
    """(table with the columns, number of columns added)."""
    new = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(LISTING_TYPES[c]) for c in new}), len(new)


def add_history(df: DataFrame) -> DataFrame:
    """The eight history columns with defaults for rows that have none yet."""
    full, _ = add_missing_columns(df, config.HISTORY_COLUMNS)
    scanned = date_prefix(F.col("scan_date").cast("string"))
    defaults = {
        "first_seen": scanned,
        "last_seen": scanned,
        "status": F.lit(config.ACTIVE),
        "scan_count": F.lit(1),
        "price_current": F.col("ask_unit"),
        "price_prev7": F.lit(None).cast("double"),
        "price_changes": F.lit(0),
        "price_changed_on": F.lit(None).cast("date"),
    }
    todo = F.col("listing_id").isNotNull() & F.col("first_seen").isNull()
    return full.select(
        *[
            F.when(todo, defaults[c]).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c)
            for c in full.columns
        ]
    )
