"""Name, date and city similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallbook import config


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 when either side has none."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / union).otherwise(F.lit(0.0))


def date_score(a: Column, b: Column, band: int = config.DATE_BAND_DAYS) -> Column:
    gap = F.abs(F.datediff(a, b))
    return F.when(gap == 0, 1.0).when(gap <= band, 0.5).otherwise(0.0)


def city_score(a: Column, b: Column) -> Column:
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return (
        F.when(known & (x == y), 1.0)
        .when(known & (x.contains(y) | y.contains(x)), 0.5)
        .otherwise(0.0)
    )


def weighted_total(name: Column, date: Column, city: Column) -> Column:
    total = name * config.NAME_WEIGHT + date * config.DATE_WEIGHT + city * config.CITY_WEIGHT
    return F.round(total, 4)
