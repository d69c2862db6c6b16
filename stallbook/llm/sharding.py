"""Proportional stratified interleaving: every shard holds the corpus mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallbook.llm.common import numbered, whole_text

#: parts into which a source and the whole order are cut; a fixed number
PARTS_BITS = 12


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, strata: str = "source") -> DataFrame:
    """Puts every row of ``docs`` (doc_id, text and the column ``strata``) into one shard.

    Rows are shuffled by a seeded hash of doc_id within their stratum; the row of rank r among n
    has the fractional rank (2r - 1) / 2n. The order by fractional rank is cut into ``shards``
    runs whose numbers of rows differ by one at most, so every shard has each stratum in
    proportion. Both ranks come from counts over hash ranges, so a large stratum is spread.

    Ties: doc_id, size, checksum. NULL strata are one stratum, a NULL text is empty, a NULL doc_id
    is shuffled like an id; repeated rows keep a slot each. Returns doc_id, size (UTF-8 bytes of the
    text plus 8), text_crc32, law ('rows'), shard, slot, grown_shard (NULL).
    """
    text = whole_text()
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col(strata).cast("string")), F.lit("")).alias("_stratum"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_key"),
    )
    ties = ["_key", "doc_id", "size", "text_crc32"]
    ranked = numbered(rows, ["_stratum"], F.shiftrightunsigned("_key", 64 - PARTS_BITS), ties, "_rank")
    share = (F.col("_rank") * 2 + 1) / (F.col("_rank_total") * 2)
    ordered = numbered(
        ranked.withColumn("_share", share.cast("double")), [],
        F.floor(F.col("_share") * (1 << PARTS_BITS)), ["_share", "_stratum", "_rank"], "_pos",
    )
    shard = F.expr(f"(_pos * {shards}) div _pos_total")
    return ordered.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - F.expr(f"(_shard * _pos_total + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
