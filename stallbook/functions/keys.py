"""The four key normalisers. They differ on purpose; do not merge them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: all characters of Unicode's White_Space, which is what ``\\s`` means under ``(?U)``
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks. No regular expression: it would try every position of a long text."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def event_key(name: Column) -> Column:
    """Dashboard key: white space collapsed, lower case, missing → ''.

    The regular expression is left to names that have white space to collapse; it costs more than all else of a row.
    """
    plain = (F.translate(name, WHITE_SPACE.replace(" ", ""), "") == name) & ~name.contains("  ") & ~name.startswith(" ") & ~name.endswith(" ")
    collapsed = F.when(plain, name).otherwise(F.regexp_replace(strip(name), r"(?U)\s+", " "))
    return F.coalesce(F.lower(collapsed), F.lit(""))


def ref_price_key(name: Column, date: Column) -> Column:
    """Reference-price key: ``name|date``."""
    return F.concat(
        F.lower(strip(name)), F.lit("|"), F.coalesce(strip(date.cast("string")), F.lit(""))
    )


def verification_key(name: Column) -> Column:
    return strip(F.lower(name))


def match_name(name: Column) -> Column:
    """Matching form: punctuation becomes a blank, white space collapses."""
    no_punctuation = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return strip(F.regexp_replace(no_punctuation, r"(?U)\s+", " "))


def name_tokens(name: Column) -> Column:
    """Sorted distinct words of the matching form; empty for a blank name."""
    words = F.split(match_name(F.coalesce(name, F.lit(""))), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))
