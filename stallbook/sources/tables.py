"""Readers and writers of the tables, and keyed stores on top of Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallbook.functions.casting import strict_date, strict_double, strict_int
from stallbook.functions.pricing import fill_unit_ask
from stallbook.operators.dashboard import OPTIONAL
from stallbook.operators.pages import first_wins
from stallbook.schemas import DASHBOARD_HEADERS, HEADER_TO_COLUMN, RAW_AD


# --- raw adverts -----------------------------------------------------------------------


def read_raw_ads(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """JSON adverts with the fixed schema; only documents that are not JSON drop out.

    A date or time that cannot be read is NULL, the rest of its advert stays.
    ``one_per_file`` reads one advert per file. Large collections should hold
    one advert per line instead, which splits into even tasks.
    """
    reader = spark.read.schema(RAW_AD_TEXT).options(**RAW_AD_OPTIONS)
    reader = reader.option("multiLine", one_per_file).option("recursiveFileLookup", True)
    return typed_ads(reader.json(path))


# every field is text first: a field of another form must not spoil its advert
RAW_AD_TEXT = ", ".join(f"{c.split()[0]} STRING" for c in RAW_AD.split(", ")) + ", _bad STRING"
RAW_AD_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def typed_ads(texts: DataFrame) -> DataFrame:
    """Rows read with RAW_AD_TEXT → RAW_AD."""
    return texts.where("_bad IS NULL").drop("_bad").withColumns(
        {"posted_on": strict_date(F.col("posted_on")), "scraped_at": F.try_to_timestamp("scraped_at")}
    )


def write_raw_ads(ads: DataFrame, path: str) -> None:
    """One advert per line, whole collection replaced."""
    ads.write.mode("overwrite").json(path)


def replace_keyed(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Stored rows plus new ones; a new row replaces its key, the last new row counts."""
    latest = first_wins(new, list(keys), order.desc())
    return stored.join(latest.select(*keys), list(keys), "left_anti").unionByName(
        latest, allowMissingColumns=True
    )


def missing_from(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key ``target`` does not have: what an incremental copy appends."""
    return source.join(target.select(key), key, "left_anti")


def append_missing(source: DataFrame, target: DataFrame, key: str, path: str) -> None:
    missing_from(source, target, key).write.mode("append").parquet(path)


# --- keyed stores ----------------------------------------------------------------------


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored table, or an empty one of the same schema when its path was never created.

    Any other failure is raised: a table that cannot be read is not an empty one.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the completely written ``version=n`` tables of a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(path(f"{folder}/version=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)


def committed_parts(spark: SparkSession, folder: str, pattern: str = "*/answers=*") -> list[str]:
    """Completely written tables below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(path(f"{folder}/{pattern}/_SUCCESS")) or []
    return sorted(s.getPath().getParent().toString() for s in done)


def read_versions(spark: SparkSession, folder: str, upto: int) -> DataFrame:
    """All versions up to a number, at least one, as one table with their ``version``."""
    paths = [f"{folder}/version={v}" for v in stored_versions(spark, folder) if v <= upto]
    return spark.read.option("basePath", folder).parquet(*paths)


def store_hits(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return store.join(wanted.select(key).distinct(), key, "left_semi")


def store_misses(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return wanted.join(store.select(key), key, "left_anti")


# --- main table --------------------------------------------------------------------------


def rename_headers(df: DataFrame) -> DataFrame:
    """Display headers → column names; unknown headers stay."""
    return df.withColumnsRenamed(HEADER_TO_COLUMN)


def _typed(c: Column, kind: str) -> Column:
    if kind == "double":
        return strict_double(c.cast("string"))
    if kind == "int":
        return strict_int(F.regexp_replace(c.cast("string"), r"\.0$", ""))
    if kind == "date":
        return strict_date(F.left(c.cast("string"), F.lit(10)))
    if kind.startswith("array"):
        return F.split(c.cast("string"), r"\s*;\s*")
    return F.when(F.trim(c.cast("string")) != "", c.cast("string"))


def load_listings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Exported main table with display headers → dashboard input.

    Known columns get their types, absent ones become NULL, all others stay as
    they are stored; missing unit prices are filled. ``seq`` orders the rows: the
    stored column of that name, else the order in which the files are read. A
    table that is not there gives an empty frame.
    """
    types = OPTIONAL | {"posted_on": "date", "verif_score": "double"}
    try:
        raw = spark.read.format(fmt).option("header", True).load(path)
    except AnalysisException:
        empty = ", ".join(f"{c} {t}" for c, t in types.items())
        return spark.createDataFrame([], empty + ", seq BIGINT")
    named = rename_headers(raw)
    have = dict(named.dtypes)
    columns = [
        (F.lit(None).cast(t) if c not in have else F.col(c) if have[c] == t else _typed(F.col(c), t)).alias(c)
        for c, t in types.items()
    ]
    unit = fill_unit_ask(F.col("ask_unit"), F.col("ask_total"), F.col("quantity"))
    others = [c for c in named.columns if c not in types]
    typed = named.select(*others, *columns).withColumn("ask_unit", unit)
    return typed if "seq" in others else typed.withColumn("seq", F.monotonically_increasing_id())


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drops rows in which nothing is filled: only NULL, '', 0 or false."""

    def filled(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "string":
            return c != ""
        if kind == "boolean":
            return c
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return c != 0
        return c.isNotNull()

    anything = F.lit(False)
    for name, kind in df.dtypes:
        anything = anything | F.coalesce(filled(name, kind), F.lit(False))
    return df.where(anything)


# --- sinks -------------------------------------------------------------------------------


def export_rows(df: DataFrame) -> DataFrame:
    """Display form: true/false → ja/nein, lists joined by '; ', NULL → ''."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "boolean":
            c = F.when(c, "ja").when(~c, "nein")
        elif kind.startswith("array"):
            c = F.concat_ws("; ", c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path, compression=compression)


def dashboard_rows(dashboard: DataFrame, headers: bool = True) -> DataFrame:
    """Columns in display order; fractions rounded to two digits, NaN → NULL."""

    def shown(name: str) -> Column:
        c = F.col(name)
        if dict(dashboard.dtypes)[name] == "double":
            c = F.round(F.when(~F.isnan(c), c), 2)
        return c.alias(DASHBOARD_HEADERS[name] if headers else name)

    return dashboard.select(*[shown(c) for c in DASHBOARD_HEADERS])


def write_dashboard(dashboard: DataFrame, path: str, headers: bool = False) -> None:
    """Replaces the stored dashboard as a whole, with column names or display headers."""
    dashboard_rows(dashboard, headers).write.mode("overwrite").parquet(path)
