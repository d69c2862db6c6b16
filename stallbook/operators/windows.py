"""Running run statistics that do not need a whole run in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

LAST_DURATIONS = 10
#: parts into which the rows are cut at most; the cuts are held by the driver
MOST_PARTS = 4096


def equal_parts(rows: DataFrame, seq: str, chunk: int) -> DataFrame:
    """Adds ``_chunk``, which grows with ``seq``: parts of about ``chunk`` rows, -1 without ``seq``."""
    kind = rows.schema[seq].dataType.simpleString()
    place = F.col(seq).cast("timestamp").cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(seq).cast("double")
    parts = min(MOST_PARTS, -(-rows.count() // chunk))
    placed = rows.withColumn("_place", place)
    cuts = sorted(set(placed.approxQuantile("_place", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if not cuts:
        return placed.drop("_place").withColumn("_chunk", F.when(F.col(seq).isNull(), -1).otherwise(0))
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_place", outputCol="_chunk", handleInvalid="keep")
    return split.transform(placed).drop("_place").withColumn(
        "_chunk", F.when(F.col(seq).isNull(), -1).otherwise(F.col("_chunk").cast("int")))


def run_progress(
    rows: DataFrame,
    run: str = "run_id",
    seq: str = "seq",
    duration: str = "duration_ms",
    failed: str = "failed",
    keep: int = LAST_DURATIONS,
    chunk: int = 100_000,
) -> DataFrame:
    """Per parsed advert: position, errors so far, mean of the last known durations.

    ``seq`` (numbers, dates or timestamps) is cut at its quantiles, over all runs, into
    as many parts as the rows make chunks of ``chunk`` rows, MOST_PARTS at most; so the
    rows of a long run spread evenly however unevenly they lie in time. Rows of one
    instant stay together. Offsets come from per-part counts; the last durations of a
    block are copied into the next one that needs them, so a run of any length spreads
    over tasks. Rows without ``seq`` come first.
    """
    parts = equal_parts(rows, seq, chunk)
    counts = parts.groupBy(run, "_chunk").agg(
        F.count("*").alias("_rows"), F.count(duration).alias("_known"),
        F.count_if(F.col(failed)).alias("_errors"),
    )
    before = W.partitionBy(run).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(run)
    offsets = counts.select(
        run, "_chunk",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_known").over(before), F.lit(0)).alias("_known0"),
        F.coalesce(F.sum("_errors").over(before), F.lit(0)).alias("_errors0"),
        F.sum("_rows").over(every).alias("total"),
    )
    inside = W.partitionBy(run, "_chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = parts.join(offsets, [run, "_chunk"]).withColumns(
        {
            "current": F.col("_rows0") + F.count("*").over(inside),
            "known": F.col("_known0") + F.count(duration).over(inside),
            "errors": F.col("_errors0") + F.count_if(F.col(failed)).over(inside),
        }
    )
    # The mean belongs to the rank among known durations. Ranks are cut into blocks;
    # the last ranks of a block also go to the next one. Rows without a duration, of
    # which a run may have any number, read the mean of their rank.
    tail = F.col("known") % chunk > chunk - keep
    ranked = placed.where(F.col(duration).isNotNull()).select(
        run, "known", duration,
        F.explode(F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).withColumn("_block", F.floor(F.col("known") / chunk) + F.col("_copy"))
    last = W.partitionBy(run, "_block").orderBy("known").rowsBetween(-(keep - 1), 0)
    means = (
        ranked.withColumn("avg_duration_ms", F.avg(duration).over(last))
        .where("_copy = 0")
        .select(run, "known", "avg_duration_ms")
    )
    percent = F.floor(F.col("current") / F.col("total") * 100).cast("string")
    progress = F.concat(
        F.col("current").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("),
        percent, F.lit("%)"),
    )
    return (
        placed.drop("_chunk", "_rows0", "_known0", "_errors0")
        .join(means, [run, "known"], "left")
        .withColumn("progress", progress)
    )
