"""I-Match fingerprints: hashes of the terms within a band of inverse document frequency."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from stallbook.llm.common import materialise, shared_folder, whole_text

#: a term is in the lexicon if between these shares of all rows hold it
LEAST_SHARE, MOST_SHARE = 0.001, 0.02
#: (parts into which the lexicon is dealt at random, how many of them are subsets)
LEVELS = ((4, 4), (4, 4), (16, 12), (64, 16), (256, 12))
SUBSETS = sum(n for _, n in LEVELS)
#: levels from here on hold few terms of a text
_FINE = sum(n for m, n in LEVELS if m < 16)
#: rows per part in which the next row is looked up, and ranges of ids at most, which are cut into parts
SPAN, MOST_RANGES = 256, 65_536
#: parts up to which their list (two numbers each) is broadcast; beyond it texts are shuffled for the join
BROADCAST_PARTS = 1_000_000

_ALL_FINE = sum(1 << b for b in range(_FINE, SUBSETS))


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def _membership(term: Column) -> Column:
    """Bits of the randomised subsets that hold a term."""
    bits, first = [], 0
    for i, (parts, n) in enumerate(LEVELS):
        part = F.pmod(F.xxhash64(term, F.lit(i)), F.lit(parts)).cast("int")
        bits.append(F.when(part < n, F.call_function("shiftleft", F.lit(1).cast("long"), part + first)).otherwise(F.lit(0).cast("long")))
        first += n
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, subsets): hashes of the terms within the band, over the whole texts of all rows.

    A term is kept if its share of the different texts lies in the band, so there are at most
    (mean distinct terms of a text) / ``least`` of them, however many rows there are. Each of k equal
    texts counts 1 / k; the sums are whole numbers again, and texts are not shuffled for it.
    """
    texts = materialise(
        docs.groupBy(F.xxhash64(whole_text()).alias("_hash")).agg(F.count("*").alias("_copies")), f"{shared_folder(docs.sparkSession)}/texts")
    n, repeated = texts.count(), texts.where("_copies > 1")
    small = repeated.count() <= BROADCAST_PARTS
    counts = (
        docs.select(whole_text().alias("text")).withColumn("_hash", F.xxhash64("text"))
        .join(F.broadcast(repeated) if small else repeated, "_hash", "left")
        .select(F.explode(terms(F.col("text"))).alias("term"), (1 / F.coalesce("_copies", F.lit(1))).alias("_share"))
        .groupBy(F.xxhash64("term").alias("term")).agg(F.round(F.sum("_share")).alias("n"))
    )
    return counts.where((F.col("n") >= least * n) & (F.col("n") <= most * n)).select("term", _membership(F.col("term")).alias("subsets"))


def hashes(rows: DataFrame, words: DataFrame, keys: list[str], texts: list[str], carried: list[str]) -> DataFrame:
    """For every row the hashes of its ``texts``: arrays of 1 + SUBSETS numbers, NULL for an empty subset.

    Rows of equal ``keys`` must be one row. The first number belongs to the whole lexicon. A text
    without any term of it has no first number, and a hash of all its terms in place of the others.
    """
    mark = F.lit(None).cast("string")
    sides = F.array(*[
        F.struct(F.lit(i).alias("side"), terms(F.col(t)).alias("terms")) for i, t in enumerate(texts)
    ])
    sides = F.transform(sides, lambda x: F.struct(
        x["side"].alias("side"), F.concat(F.array(mark), x["terms"]).alias("terms"),
        F.when(F.size(x["terms"]) > 0, F.xxhash64(F.sort_array(F.transform(x["terms"], lambda t: F.xxhash64(t))))).alias("all")))
    # the mark keeps rows without any term: NULL hashes to 42, which the lexicon gets as well
    known = words.unionByName(words.sparkSession.range(1).select(F.xxhash64(mark).alias("term"), F.lit(0).cast("long").alias("subsets")))
    hits = (
        rows.select(*keys, *carried, F.explode(sides).alias("_side"))
        .select(*keys, *carried, F.col("_side.side").alias("_side"), F.col("_side.all").alias("_all"), F.explode("_side.terms").alias("_term"))
        .withColumn("term", F.xxhash64("_term")).drop("_term")
        .join(F.broadcast(known), "term")
    )
    real = F.xxhash64(mark) != F.col("term")
    found = hits.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        *[F.collect_list(F.when(real & (F.col("_side") == i), F.struct("term", "subsets"))).alias(f"_{t}")
          for i, t in enumerate(texts)],
        *[F.max(F.when(F.col("_side") == i, F.col("_all"))).alias(f"_{t}_all") for i, t in enumerate(texts)],
    )
    for t in texts:
        ordered = f"_{t}"
        found = found.withColumn(ordered, F.sort_array(ordered)).withColumn(
            f"{ordered}_fine", F.filter(ordered, lambda x: x["subsets"].bitwiseAND(F.lit(_ALL_FINE).cast("long")) != 0))

        def subset(bits: range, source: str) -> Column:
            masks = F.array(*[F.lit(1 << b).cast("long") for b in bits])
            return F.transform(masks, lambda m: _hash(F.filter(source, lambda x: x["subsets"].bitwiseAND(m) != 0)))

        instead = F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), lambda i: _low(F.xxhash64(F.col(f"_{t}_all"), i)))
        found = found.withColumn(t, F.when(
            (F.size(ordered) == 0) & F.col(f"{ordered}_all").isNotNull(), F.concat(F.array(F.lit(None).cast("long")), instead),
        ).otherwise(F.concat(
            F.array(_hash(F.col(ordered))), subset(range(_FINE), ordered), subset(range(_FINE, SUBSETS), f"{ordered}_fine"))))
    return found.select(*keys, *carried, *texts)


def _low(number: Column) -> Column:
    return number.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _hash(chosen: Column) -> Column:
    return F.when(F.size(chosen) > 0, _low(F.xxhash64(chosen)))


def text_of(numbers: Column) -> Column:
    """A fingerprint as text: eight hex digits for each subset, dashes for an empty one."""
    return F.array_join(F.transform(numbers, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 8, "0")), F.lit("--------"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that at least one text has terms of; 1 if neither has any."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    any_ = F.size(F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    same = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(same / any_)


def _parted(docs: DataFrame) -> DataFrame:
    """Adds ``_part``: consecutive ranges of doc_id with about SPAN rows, numbered in order; NULL without doc_id.

    The ids are cut at their quantiles into MOST_RANGES ranges at most, and each range evenly into
    parts; so parts are filled alike for running numbers, sparse numbers and hashes.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").withColumn("_id", F.col("doc_id").cast("double"))
    ranges = min(MOST_RANGES, -(-ids.count() // (SPAN * SPAN)))
    cuts = sorted(set(ids.approxQuantile("_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    if cuts:
        cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_range", handleInvalid="keep").transform
    else:
        cut = lambda rows: rows.withColumn("_range", F.lit(0.0))
    sizes = cut(ids).groupBy("_range").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_n"))
    # one row a range
    sizes = materialise(sizes.select("_range", "_low", F.greatest(
        (F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / SPAN), F.lit(1.0)).alias("_width")), f"{shared_folder(docs.sparkSession)}/ranges")
    part = F.shiftleft(F.col("_range").cast("long"), 32) + F.floor((F.col("_id") - F.col("_low")) / F.col("_width"))
    placed = cut(docs.withColumn("_id", F.col("doc_id").cast("double"))).join(F.broadcast(sizes), "_range", "left")
    return placed.withColumn("_part", F.when(F.col("doc_id").isNotNull(), part)).drop("_id", "_range", "_low", "_width")


def _previous_parts(docs: DataFrame) -> DataFrame:
    """(part, id): for each part (``_parted``) the largest id of the part below, for the lowest the largest of all.

    Two steps: the last one sees one row a range.
    """
    parts = docs.where(F.col("doc_id").isNotNull()).groupBy("_part").agg(F.max("doc_id").alias("_top"))
    parts = parts.withColumn("_large", F.shiftright("_part", 32))
    inner = W.partitionBy("_large").orderBy("_part")
    parts = parts.withColumn("_below", F.lag("_top").over(inner))
    large = parts.groupBy("_large").agg(F.max("_top").alias("_large_top"))
    outer = W.partitionBy().orderBy("_large")
    large = large.select(
        "_large", F.lag("_large_top").over(outer).alias("_large_below"),
        F.max("_large_top").over(W.partitionBy()).alias("_largest"))
    return parts.join(large, "_large").select("_part", F.coalesce("_below", "_large_below", "_largest").alias("_ghost_id"))


def fingerprints_with_edits(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text has the last half of the code points replaced by the first as many of the next
    row, by descending doc_id; the next of the last is the first. Rows meet their next one within
    parts of about SPAN rows, into which the top row of the part below is copied, so texts are shuffled
    once (twice beyond BROADCAST_PARTS parts). Ties of doc_id follow by text. A NULL text is empty; a row without doc_id has no next one
    (an empty text instead). A text without lexicon terms has dashes in
    the first place and then hashes of all its terms; one without any terms has dashes only.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    plain = docs.select("doc_id", whole_text().alias("text"))
    words = lexicon(plain, least, most)
    no_id = F.col("doc_id").isNull()
    placed = _parted(plain)
    own = placed.select(
        "doc_id", "text", F.lit(False).alias("_ghost"), no_id.alias("_no_id"), F.coalesce("_part", F.xxhash64("text")).alias("_part"))
    parts = materialise(_previous_parts(placed), f"{shared_folder(docs.sparkSession)}/parts")
    small = parts.count() <= BROADCAST_PARTS
    ghosts = (
        plain.join(F.broadcast(parts) if small else parts, F.col("doc_id") == F.col("_ghost_id"))
        .select("doc_id", "text", F.lit(True).alias("_ghost"), F.lit(False).alias("_no_id"), "_part"))
    part = W.partitionBy("_part", "_no_id")
    order = part.orderBy("_ghost", F.col("doc_id").desc(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = (
        own.unionByName(ghosts)
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_next", F.when(F.col("_no_id"), F.lit("")).otherwise(F.lead("text").over(order)))
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.when(F.col("_ghost"), F.lit("")).otherwise(F.concat(
            F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    found = hashes(rows, words, ["_part", "_no_id", "_row"], ["text", "edited"], ["doc_id", "_ghost", "n_chars", "edited_sha256"])
    empty = F.array_repeat(F.lit(None).cast("long"), SUBSETS + 1)
    following = F.when(F.col("_no_id"), empty).otherwise(F.lead("text").over(part.orderBy("_row")))
    return (
        found.withColumn("_following", following).where(~F.col("_ghost"))
        .select(
            "doc_id", "n_chars", "edited_sha256", text_of(F.col("text")).alias("fingerprint"),
            text_of(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("text"), F.col("edited")).alias("near_edited"),
            likeness(F.col("text"), F.col("_following")).alias("near_next"),
        )
    )
