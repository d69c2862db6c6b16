"""Schemaless JSON through the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

VARIANTS = "array<variant>"


_END = "\u241e end \u241e"


def _closed(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def _only(listed: Column) -> Column:
    ends = F.try_variant_get(listed, "$[1]", "string") == _END
    alone = F.try_variant_get(listed, "$[2]", "variant").isNull()
    return F.when(ends & alone, F.try_variant_get(listed, "$[0]", "variant"))


def whole_json(text: Column) -> Column:
    """The text as one JSON value, NULL when anything else follows it.

    The parser stops after the first value and ignores the rest. So the text
    goes into a list in front of a marker: only a text that is exactly one value
    leaves the marker in second place.
    """
    return _only(_closed(text))


def with_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """``whole_json`` as a column. Two steps, so that each text is parsed once."""
    return df.withColumn(out, _closed(F.col(text))).withColumn(out, _only(F.col(out)))


def kind(v: Column) -> Column:
    """Upper-case type word: ARRAY, OBJECT, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", VARIANTS)


def field(v: Column, path: str, type_name: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, type_name)


def as_list(v: Column) -> Column:
    """An array stays, anything else becomes a list of one."""
    return F.when(kind(v) == "ARRAY", elements(v)).when(v.isNotNull(), F.array(v))


def json_ld(html: Column) -> Column:
    """All linked-data items of a page, in page order, arrays flattened."""
    scripts = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)
    )
    lists = F.transform(scripts, lambda s: F.coalesce(as_list(whole_json(s)), F.array().cast(VARIANTS)))
    return F.filter(F.flatten(lists), lambda v: kind(v) == "OBJECT")
