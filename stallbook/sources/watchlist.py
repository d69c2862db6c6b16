"""Watchlist text files and provider search URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallbook import config
from stallbook.functions.casting import strict_double
from stallbook.functions.keys import strip


def parse_watchlist(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) → (line_no, event_name, ref_price, ref_link).

    ``name | OVP: 89,90 | Link: https://…``: the parts after the name come in
    any order, the last of a kind counts, a bad price is no price.
    """
    parts = F.transform(F.split(strip(F.col("value")), r"\|"), strip)
    rest = F.slice(F.col("parts"), F.lit(2), F.size("parts"))

    def tagged(tag: str) -> F.Column:
        values = F.filter(rest, lambda p: F.upper(p).startswith(tag))
        return F.transform(values, lambda p: strip(F.substr(p, F.lit(len(tag) + 1))))

    prices = F.transform(
        tagged("OVP:"), lambda p: strict_double(F.replace(p, F.lit(","), F.lit(".")))
    )
    good = F.filter(prices, lambda p: p.isNotNull())
    return (
        lines.withColumn("parts", parts)
        .withColumn("event_name", F.col("parts")[0])
        .where("event_name <> ''")
        .select(
            "line_no", "event_name",
            F.try_element_at(good, F.lit(-1)).alias("ref_price"),
            F.try_element_at(tagged("LINK:"), F.lit(-1)).alias("ref_link"),
        )
    )


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Watchlist files, one entry per line. Lines keep their order within a file."""
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), "value"
    )
    return parse_watchlist(lines)


def read_watchlist_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """The same table from settings documents with a ``watchlist`` list.

    Entries have event_name, ovp_preis and ovp_link; one without a name drops out,
    a price that is no number is no price, a blank link is no link.
    """
    schema = "watchlist ARRAY<STRUCT<event_name STRING, ovp_preis STRING, ovp_link STRING>>"
    docs = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    name, link = strip(F.col("e.event_name")), strip(F.col("e.ovp_link"))
    entries = docs.select(F.explode("watchlist").alias("e"))
    return entries.where(name != "").select(
        F.monotonically_increasing_id().alias("line_no"), name.alias("event_name"),
        strict_double(F.replace("e.ovp_preis", F.lit(","), F.lit("."))).alias("ref_price"),
        F.when(link != "", link).alias("ref_link"),
    )


def provider_urls(
    events: DataFrame, templates: Sequence[str] = config.PROVIDER_TEMPLATES
) -> DataFrame:
    """(event_name, provider_ord, url): the search URLs of every event, in provider order.

    The templates are literals in the projection: no join, no shuffle.
    """
    name = F.replace(F.col("event_name"), F.lit(" "), F.lit("+"))
    urls = F.array(*[F.replace(F.lit(t), F.lit("{event}"), name) for t in templates])
    return events.select("event_name", F.posexplode(urls).alias("provider_ord", "url"))
