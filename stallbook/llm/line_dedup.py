"""Repeated runs of lines, found on the suffixes of the line sequence by prefix doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from stallbook.llm.common import materialise, shared_folder, whole_text

#: words in a run of lines from which on its later copies are deleted
MIN_WORDS = 30
_WORD = r"[^ \t\r\x0B\x0C]+"


def _sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, line_no, words, name, check): the lines that hold words, numbered in their document.

    ``name`` and ``check`` are two hashes of the line.
    """
    lines = F.transform(F.split(whole_text(), "\n"), lambda x, i: F.struct(
        i.alias("line_no"), F.regexp_count(x, F.lit(_WORD)).alias("words"), F.xxhash64(x).alias("name"),
        F.xxhash64(F.lit("check"), x).alias("check")))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64(whole_text()).alias("version"), F.posexplode(F.filter(lines, lambda s: s["words"] > 0)))
        .select("doc_id", "version", "pos", "col.*")
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose class (``name``) has more than one member."""
    twice = rows.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name")
    return rows.join(twice, "name", "left_semi")


def suffix_levels(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The repeated lines, and the classes of suffixes by their first 2^k lines.

    Level 0 names a suffix by its first line; level k + 1 by the pair of level-k names of itself and
    of the suffix 2^k lines on. Suffixes with one name at level k are an interval of the suffix
    array whose longest common prefix has 2^k lines at least. An interval of one suffix holds no
    repeat and is dropped, so each level has fewer rows. Names are 64-bit hashes of the pairs, which
    need no order between shards. Runs are looked up by at most ``min_words`` lines (a line has a
    word at least), so there are log2(min_words) levels. Each is a table in the shared folder.
    """
    folder = shared_folder(docs.sparkSession)
    keys = ["doc_id", "version", "pos"]
    lines = materialise(_repeated(_sequences(docs)).dropDuplicates(keys), f"{folder}/lines")
    level, levels = materialise(lines.select(*keys, "name"), f"{folder}/level0"), []
    for k in range(min_words.bit_length()):
        levels.append(level.withColumn("level", F.lit(k)))
        if 2 << k > min_words:
            break
        later = level.select("doc_id", "version", (F.col("pos") - (1 << k)).alias("pos"), F.col("name").alias("_later"))
        pairs = level.join(later, keys).select(*keys, F.xxhash64("name", "_later").alias("name"))
        level = materialise(_repeated(pairs), f"{folder}/level{k + 1}")
    return lines, reduce(DataFrame.unionByName, levels)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, first_line, last_line): the maximal runs of lines to delete.

    A run of whole lines with ``min_words`` words or more is deleted if the same run also starts
    earlier (smaller doc_id, or earlier in the document). Such runs are unions of the shortest ones
    of that size, those that begin and those that end at each line. A shortest run of m lines is
    named by the classes of its first and its last 2^k lines, 2^k being m at most and over half of m,
    and by the second hashes of all its lines: names of 64 bits alone would mix up runs of a large corpus.
    """
    lines, levels = suffix_levels(docs, min_words)
    own = W.partitionBy("doc_id", "version").orderBy("pos")
    item = F.struct("pos", "words", "line_no", "check")

    def shortest(around):
        """Lines up to the first with which the words suffice; NULL beyond a gap or the end."""
        size = F.aggregate(around, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("words")), lambda acc, x: F.when(
            acc["words"] >= min_words, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["words"] + x["words"]).alias("words"))))
        return F.when(size["words"] >= min_words, size["n"])

    ahead = F.collect_list(item).over(own.rowsBetween(0, min_words - 1))
    back = F.reverse(F.collect_list(item).over(own.rowsBetween(1 - min_words, 0)))
    both = lines.select("doc_id", "version", "pos", "line_no", ahead.alias("_ahead"), back.alias("_back"))

    def runs(around: str, forward: bool) -> DataFrame:
        m, end = F.col("_m"), F.element_at(around, F.col("_m"))
        found = both.withColumn("_m", shortest(F.col(around))).where(m.isNotNull())
        near, far = F.struct("pos", "line_no"), F.struct(end["pos"].alias("pos"), end["line_no"].alias("line_no"))
        first, last = (near, far) if forward else (far, near)
        content = F.transform(F.slice(around, F.lit(1), F.col("_m")), lambda x: x["check"])
        content = F.xxhash64(content if forward else F.reverse(content)).alias("_content")
        return found.select("doc_id", "version", first.alias("_first"), last.alias("_last"), "_m", content).where(
            F.col("_last.pos") - F.col("_first.pos") == m - 1)

    # m is at most min_words, so this is exact
    level = F.floor(F.log2(F.col("_m") + F.lit(0.5))).cast("int")
    candidates = runs("_ahead", True).unionByName(runs("_back", False)).distinct().select(
        "doc_id", "version", F.col("_first.pos").alias("pos"), F.col("_first.line_no").alias("first_line"),
        F.col("_last.line_no").alias("last_line"), "_m", "_content", level.alias("level"))
    half = F.col("pos") + F.col("_m") - F.call_function("shiftleft", F.lit(1), F.col("level"))
    heads = levels.withColumnRenamed("name", "_head")
    tails = levels.select("doc_id", "version", F.col("pos").alias("_half"), "level", F.col("name").alias("_tail"))
    named = (
        candidates.withColumn("_half", half)
        .join(heads, ["doc_id", "version", "pos", "level"])
        .join(tails, ["doc_id", "version", "_half", "level"])
        .select("doc_id", "version", "pos", "first_line", "last_line", "_content", F.xxhash64("_head", "_tail", "_m").alias("_run"))
    )
    named = materialise(named, f"{shared_folder(docs.sparkSession)}/runs")
    place = F.struct("doc_id", "version", "pos")
    first = named.groupBy("_run", "_content").agg(F.min(place).alias("_origin"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = named.join(first, ["_run", "_content"]).where(place != F.col("_origin")).select("doc_id", "version", "first_line", "last_line").distinct()
    upto = W.partitionBy("doc_id", "version").orderBy("first_line", "last_line")
    begins = F.coalesce(F.col("first_line") > F.max("last_line").over(upto.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    return (
        later.withColumn("_begins", begins.cast("int"))
        .withColumn("_group", F.sum("_begins").over(upto.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "version", "_group").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
        .drop("_group")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any other columns) with the later copies of runs deleted.

    Lines are compared as they stand. Lines without words belong to no run; those within a deleted
    run go with it. A NULL text stays NULL, a row without doc_id is neither compared nor changed,
    repeated rows (one doc_id and text) are one document and change alike.

    Adds n_lines, n_removed (lines) and n_runs, in place of columns of that name; ``text`` is what is
    left. Other columns may have any names.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), min_words).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("runs"))
    # the row as one value, so that no column of it clashes with those of the join
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("version"))
    found = rows.join(runs.withColumnRenamed("doc_id", "id"), ["id", "version"], "left")
    text = F.col("doc.text")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["first_line"]) & (i <= r["last_line"])))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["last_line"] - r["first_line"] + 1)
    new = {
        "text": F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long"),
        "n_removed": F.coalesce(removed, F.lit(0).cast("long")), "n_runs": F.coalesce(F.size("runs"), F.lit(0)).cast("long"),
    }
    done = found.select("doc", F.struct(*[c.alias(name) for name, c in new.items()]).alias("new"))
    return done.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in new], *[F.col("new")[c].alias(c) for c in new])


LINE_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split
),
numbered AS (
  SELECT doc_id, line, line_no, words, row_number() OVER d AS pos, sum(words) OVER d AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '[^ \\t\\r\\v\\f]+')) AS words FROM lines) WHERE words > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)
),
spans AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id
    AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS - 1} AND b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id
    AND a.pos BETWEEN b.pos - {MIN_WORDS - 1} AND b.pos AND b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY ALL
),
runs AS (
  SELECT s.doc_id, s, min(line_no) AS l1, max(line_no) AS l2, string_agg(line, chr(10) ORDER BY pos) AS content
  FROM spans s JOIN numbered n ON s.doc_id = n.doc_id AND n.pos BETWEEN s.s AND s.e GROUP BY s.doc_id, s.s, s.e
),
later AS (
  SELECT doc_id, l1, l2 FROM (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS nth FROM runs) WHERE nth > 1
),
gone AS (
  SELECT DISTINCT l.doc_id, l.line_no FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.line_no BETWEEN r.l1 AND r.l2
),
marked AS (
  SELECT l.doc_id, l.line, l.line_no, g.line_no IS NOT NULL AS removed,
    g.line_no IS NOT NULL AND (lag(g.line_no) OVER d) IS NULL AS begins
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no
  WINDOW d AS (PARTITION BY l.doc_id ORDER BY l.line_no)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(removed AS INT)) AS BIGINT) AS n_removed,
  CAST(sum(CAST(begins AS INT)) AS BIGINT) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
