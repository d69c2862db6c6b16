"""Exact Jaccard join of word-shingle sets: equal prefixes meet as groups, members are verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from stallbook.llm import wordhash
from stallbook.llm.common import discard, materialise, shared_folder, ship_package, whole_text
from stallbook.llm.components import components

#: members of a bucket that are paired; a larger bucket is split by what its members and a pivot do not share
LIMIT = 256
#: rounds of splitting, after which what is still together is paired
ROUNDS = 8
#: bits of the filter that spares texts without a candidate set the shuffle; a fixed number, as it is broadcast
FILTER_BITS = 1 << 23
#: bytes of text whose shingles are made at once; a longer text is handled alone
SLICE = 2 << 20
_HEADS = 1 << 18
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least(n, share):
    """Shingles that a set of ``n`` has in common with any similar set, at least."""
    return (share[0] * n + share[1] - 1) // share[1]


def more(n):
    """Of the smallest hashes so many are kept beyond those that a similar set can lack."""
    return max(n // 10, 1)


def shingles(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted, distinct hashes of the word shingles of each text; fewer words are one shingle."""
    found = list(wordhash.words(texts))
    h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
    owner = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    places = max(len(h) - words + 1, 0)
    rolled = np.full(places, words, np.uint64)
    for j in range(words):
        rolled += h[j: j + places] * _FACTORS[j]
    rolled = wordhash.mix(rolled).view(np.int64)
    for s, e in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if e - s >= words:
            yield np.unique(rolled[s: e - words + 1])
        elif e > s:
            whole = np.array([e - s], np.uint64) + (h[s:e] * _FACTORS[: e - s]).sum(dtype=np.uint64)
            yield wordhash.mix(whole).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _each(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    held: list[bytes] = []
    size = 0
    for x in texts:
        data = x.as_buffer().to_pybytes()
        if held and size + len(data) > SLICE:
            yield from shingles(held, words)
            held, size = [], 0
        held.append(data)
        size += len(data)
    yield from shingles(held, words)


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sets(batches: Iterable[pa.RecordBatch], words: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Each row's set by name and size, with its smallest hashes."""
    for batch in batches:
        nodes, sizes, heads = [], [], []
        for found in _each(batch.column(2), words):
            nodes.append(_node(found))
            sizes.append(len(found))
            heads.append(found[: len(found) - least(len(found), share) + more(len(found))])
        short = np.frombuffer(b"".join(nodes), "<i8")[::2]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(short), pa.array(sizes, pa.int64()),
             pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "row", "node", "short", "n", "head"])


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, short, k): a hash of one set of a batch has k 0; of a hash of several sets one row goes on with k -1, the
    others are counted here, so many (k) for each set."""
    for batch in batches:
        head = batch.column(1)
        owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(head.offsets.to_numpy()))
        h = head.flatten().to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
        h, owner = h[new], owner[new]
        first = np.append(True, h[1:] != h[:-1])
        run = np.cumsum(first) - 1
        done, times = np.unique(owner[~first], return_counts=True)
        columns = [
            np.concatenate([np.zeros(len(done), np.int64), h[first]]), np.concatenate([done, owner[first]]),
            np.concatenate([times, -(np.bincount(run) > 1).astype(np.int64)])]
        for i in range(0, len(columns[0]), _HEADS):
            yield pa.RecordBatch.from_arrays([pa.array(c[i: i + _HEADS]) for c in columns], ["h", "short", "k"])


def _meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(short, k): so many hashes of a set are in others too, or fewer; rows come sorted by hash and set."""
    last = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        h, short, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        own = k > 0
        out, times = [short[own]], [k[own]]
        h, short, k = (np.concatenate([a, b[~own]]) for a, b in zip(last, (h, short, k)))
        if len(h):
            pair = (h[1:] == h[:-1]) & (short[1:] != short[:-1])
            shared = k < 0
            shared[1:] |= pair
            shared[:-1] |= pair
            out.append(short[shared])
            times.append(np.ones(int(shared.sum()), np.int64))
            last = [c[-1:].copy() for c in (h, short, k)]
        found, at = np.unique(np.concatenate(out), return_inverse=True)
        counts = np.bincount(at, np.concatenate(times), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["short", "k"])


def _whole(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The whole set of each text that stands for the node it was chosen for."""
    for batch in batches:
        kept = [(node, found) for node, found in zip(batch.column(0).to_pylist(), _each(batch.column(1), words)) if _node(found) == node]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], pa.list_(pa.int64()))], ["node", "hs"])


def _candidates(texts: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, share: tuple[int, int], folder: str) -> DataFrame:
    """(id, node, hs): the whole sets that can be similar to another one; no such set is left out.

    Two similar sets have the same smallest hashes in common, whatever else they hold: of the first
    n - least + k hashes of a set of n at least k are in a similar one, and among its first ones.
    """
    heads = rows.select("short", "head").mapInArrow(_heads, "h long, short long, k long")
    dealt = heads.repartition(F.when(F.col("k") > 0, F.xxhash64("short")).otherwise(F.col("h"))).sortWithinPartitions("h", "short")
    met = dealt.mapInArrow(_meeting, "short long, k long").groupBy("short").agg(F.sum("k").alias("k"))
    need = F.greatest(F.floor(_least(F.col("n"), share) / 10), F.lit(1))
    key = F.xxhash64("doc_id", "row")
    chosen = nodes.join(met, "short").where(F.col("k") >= need).select("node", "first.*").select("node", "row", key.alias("key"))
    chosen = materialise(chosen, f"{folder}/chosen")
    # most texts are not chosen; a filter of fixed size keeps them from the shuffle, the join is exact
    place, bit = (F.pmod(F.col("key"), F.lit(FILTER_BITS)), F.expr("shiftleft(1L, cast(key & 63 AS int))"))
    word = F.shiftright(place, 6).alias("word")
    bits = chosen.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    likely = texts.withColumn("key", key).withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    found = likely.select("row", "key", "data").join(chosen, ["row", "key"]).dropDuplicates(["row", "key"]).select("node", "data")
    whole = found.mapInArrow(lambda it: _whole(it, words), "node binary, hs array<long>")
    return whole.select(F.monotonically_increasing_id().alias("id"), "*")


def _classes(sets: DataFrame, share: tuple[int, int], folder: str) -> tuple[DataFrame, DataFrame]:
    """Sets of one size that share all but the shingles that only they have are one class: the members
    have the same shingles in common with any other set. Returns (cid, n, m, hs, own, g) and (node, cid).

    ``hs`` are the shingles of two sets or more, rarest first. The first ``own`` of them are the shared
    part of the prefix; a set whose prefix has none has no partner and is left out. Classes of one
    size and prefix have one group ``g``.
    """
    entries = sets.select("id", F.explode("hs").alias("h"))
    counts = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = entries.join(counts, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    ordered = ordered.join(sets.select("id", "node", F.size("hs").cast("long").alias("n")), "id")
    # of a prefix of n - least + 1, the n - size(hs) shingles of this set alone come first
    ordered = ordered.withColumn("hs", F.col("hs.h")).withColumn("own", (F.size("hs") - _least(F.col("n"), share) + 1).cast("int")).where("own > 0")
    names = [F.xxhash64(F.lit(i), "n", "hs").alias(f"k{i}") for i in (1, 2)]
    ordered = materialise(ordered.select("node", "n", "hs", "own", *names), f"{folder}/ordered")
    classes = ordered.groupBy("k1", "k2").agg(
        F.min("node").alias("cid"), F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("n", "hs", "own")])
    classes = materialise(classes.withColumn("g", F.xxhash64("n", "own", F.expr("slice(hs, 1, own)"))), f"{folder}/classes")
    return classes, ordered.select("node", "k1", "k2").join(classes.select("k1", "k2", "cid"), ["k1", "k2"]).select("node", "cid")


def _least(n: Column, share: tuple[int, int]) -> Column:
    return F.floor((n * share[0] + share[1] - 1) / share[1])


def _enough(o: Column, n: Column, m: Column, share: tuple[int, int]) -> Column:
    return o * share[1] >= (n + m - o) * share[0]


def _can(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sizes allow two sets (n, and s shingles that others have) to be similar; by far the most pairs end here.

    Where both hold the shingle at the places i and j of the common order, they share no more than
    the places before the first of these and behind the last allow.
    """
    n, s, i, m, t, j = (F.col(f"{x}.{y}") for x in (a, b) for y in ("n", "s", "pos"))
    places = F.coalesce(F.least(i, j) + 1 + F.least(s - i, t - j) - 1, s)
    return _enough(F.least(s, t, places), n, m, share)


def _compared(pairs: DataFrame, classes: DataFrame, extra: list[str]) -> DataFrame:
    """The pairs (a, b) with what both have in common (``o``), their sizes and the columns asked for."""
    x, y = (classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("hs").alias(f"hs{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").withColumn("o", F.size(F.array_intersect("hsa", "hsb"))).select("a", "b", "na", "nb", "o", *extra)


def _telling(share: tuple[int, int]) -> Column:
    """Of the shingles that set a apart from its pivot b, so many that one of them is among those of any similar set.

    With k = share / (1 + share) and v = k n + |p - x|, two sets have at least v + w - |p| of these
    shingles in common. w is k |p| at least, and more than |p| - k n(p) if its set is not similar to
    the pivot; of two sets that are both similar to it nothing need be known.
    """
    k, one = share[0], share[0] + share[1]
    lacking = F.col("sb") - F.col("o")
    v = F.col("na") * k + lacking * one
    needed = F.when(F.col("link"), F.floor((v - F.col("nb") * k) / one) + 1).otherwise(F.ceil((v - F.col("sb") * share[1]) / one))
    return F.greatest(F.size("apart") - F.greatest(needed, F.lit(1)) + 1, F.lit(0)).cast("int")


def _starred(met: DataFrame, members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): the members of each bucket of more than two classes, with one of the bucket, if sizes allow similarity.

    That one has the fewest shingles of its own. The order is the same in all buckets, so a class
    meets few others this way, however many buckets it is in.
    """
    one = F.min(F.struct((F.col("n") - F.col("s")).alias("u"), F.xxhash64("g").alias("r"), "g", "n", "s", "pos", "top"))
    bucket = W.partitionBy("key")
    rows = met.select(F.struct("g", "n", "s", "pos").alias("a"), F.sum("m").over(bucket).alias("size"), one.over(bucket).alias("b"))
    pairs = rows.where((F.col("size") > 2) & _can("a", "b", share)).select("a.g", "b.top").distinct().join(members, "g")
    return pairs.select(F.least("cid", "top").alias("a"), F.greatest("cid", "top").alias("b")).where("a < b").distinct()


def _links(classes: DataFrame, share: tuple[int, int], folder: str) -> DataFrame:
    """(node, component) of the classes that are similar to another class.

    Classes of one size and prefix are one group. Groups meet in the buckets of their prefix
    shingles. At first the members of a bucket are compared with one of them, see ``_starred``, so
    that near copies of one text are one component without being paired. Then pairs of groups that
    are not of one component are filtered by size, and the members of the rest are verified. A
    bucket of more than LIMIT classes is not paired: all members are compared with one pivot p. Two
    members x, y that are both similar to p are in one component; if one of them is not, they can
    be similar only if both lack the same shingle of p or both hold the same other one, because
    |x n y| <= |p| - |p - x| - |p - y| + |(p - x) n (p - y)| + |(x - p) n (y - p)|. So the
    members go into a smaller bucket for each of the shingles that set them apart from p (a prefix of
    these, see ``_telling``), and so on.
    """
    members = classes.select("g", "cid")
    groups = classes.groupBy("g", "n", F.size("hs").alias("s"), F.expr("slice(hs, 1, own)").alias("prefix")).agg(
        F.count("*").alias("m"), F.min("cid").alias("top"))
    met = groups.select("g", "n", "s", "m", "top", F.posexplode("prefix").alias("pos", "key"))
    met = materialise(met, f"{folder}/met")
    sizes = classes.select("cid", "n", F.size("hs").alias("s"))
    stars = _compared(_starred(met, members, share), classes, []).where(_enough(F.col("o"), F.col("na"), F.col("nb"), share))
    found = components(stars.select("a", "b"))
    for step in range(ROUNDS + 1):
        if step:
            buckets = rest.join(sizes, "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
                "key", F.col("cid").alias("g"), "n", "s", F.lit(1).alias("m"), F.lit(None).cast("int").alias("pos"), F.coalesce("component", "cid").alias("c"))
            members = None
        else:
            # a group has no component while its members are of several
            own = F.coalesce("component", "cid")
            known = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").groupBy("g").agg(
                F.min(own).alias("c"), F.max(own).alias("_c")).select("g", F.when(F.col("c") == F.col("_c"), F.col("c")).alias("c"))
            buckets = met.drop("top").join(known, "g")
        # buckets whose members are not all of one component, each row once
        whole = W.partitionBy("key")
        apart = F.max(F.col("c").isNull()).over(whole) | (F.min("c").over(whole) < F.max("c").over(whole))
        opened = buckets.withColumns({"size": F.sum("m").over(whole), "apart": apart}).where("apart AND size > 1").drop("apart")
        opened = materialise(opened, f"{folder}/open{step}")
        rows = opened if step == ROUNDS else opened.where(F.col("size") <= LIMIT)
        other = F.col("a.c").isNull() | F.col("b.c").isNull() | (F.col("a.c") != F.col("b.c"))
        pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.g") <= F.col("b.g")) & other & _can("a", "b", share))
        pairs = pairs.select(F.col("a.g").alias("a"), F.col("b.g").alias("b")).distinct()
        if members is not None:
            pairs = pairs.join(members.select(F.col("g").alias("a"), F.col("cid").alias("_a")), "a").join(
                members.select(F.col("g").alias("b"), F.col("cid").alias("_b")), "b")
            pairs = pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        pairs = pairs.where("a < b").withColumn("star", F.lit(False))
        rows = opened.where(F.col("size") > LIMIT)
        if step < ROUNDS and not rows.isEmpty():
            if members is not None:
                rows = rows.select("key", "g", "n", "s").join(members, "g")
            else:
                rows = rows.withColumn("cid", F.col("g"))
            pivot = rows.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("u"), F.xxhash64("cid").alias("r"), "cid")).alias("p"))
            star = rows.join(pivot.select("key", F.col("p.cid").alias("p")), "key").where("cid != p").select(
                F.col("cid").alias("a"), F.col("p").alias("b"), F.lit(True).alias("star")).distinct()
            pairs = pairs.unionByName(star)
        apart = F.when(F.col("star"), F.array_sort(F.concat(F.array_except("hsa", "hsb"), F.array_except("hsb", "hsa"))))
        done = materialise(
            _compared(pairs, classes, ["star", F.size("hsb").alias("sb"), apart.alias("apart")])
            .withColumn("link", _enough(F.col("o"), F.col("na"), F.col("nb"), share)).where("link OR star")
            .withColumn("apart", F.slice("apart", F.lit(1), _telling(share))).select("a", "b", "link", "star", "apart"), f"{folder}/compared{step}")
        new = done.where("link").select("a", "b")
        if not new.isEmpty():
            found = components(new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        rest = done.where("star").select(F.col("a").alias("cid"), F.explode("apart").alias("e"), "b").select(
            F.xxhash64("b", "e").alias("key"), "cid").distinct()
        if rest.isEmpty():
            return found
    return found


def similar_rows(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(doc_id, row, n, component, least_id) of every row of ``docs`` (doc_id, text).

    ``row`` is the text's xxhash64, n the size of its set of shingles; rows are linked if the Jaccard
    similarity of their sets is ``share`` (a fraction) or more. Equal sets are one, empty ones too.
    ``least_id`` is the smallest doc_id of the component.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = shared_folder(spark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), whole_text().cast("binary").alias("data"))
    heads = materialise(texts.mapInArrow(
        lambda it: _sets(it, words, share), "doc_id long, row long, node binary, short long, n long, head array<long>"), f"{folder}/heads")
    rows = materialise(heads.drop("head"), f"{folder}/rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = materialise(rows.groupBy("node", "short", "n").agg(first), f"{folder}/nodes")
    sets = materialise(_candidates(texts, heads, nodes.where("n > 0"), words, share, folder), f"{folder}/sets")
    discard(spark, f"{folder}/heads")
    classes, members = _classes(sets, share, folder)
    discard(spark, f"{folder}/sets")
    found = _links(classes.select("cid", "n", "hs", "own", "g"), share, folder)
    # a class whose members are similar to each other, or to another class, is one component
    alike = _enough(F.size("hs"), F.col("n"), F.col("n"), share)
    linked = classes.join(found, classes.cid == found.node, "left").where(F.col("component").isNotNull() | alike).select(
        "cid", F.coalesce("component", "cid").alias("component"))
    known = nodes.join(members.join(linked, "cid"), "node", "left").select(
        "node", F.col("first.doc_id").alias("_id"), F.coalesce("component", "node").alias("component"))
    known = materialise(known, f"{folder}/known")
    least_ids = known.groupBy("component").agg(F.min("_id").alias("least_id"))
    known = known.join(least_ids, "component").select("node", "component", "least_id")
    return rows.select("doc_id", "row", "n", "node").join(known, "node").select("doc_id", "row", "n", "component", "least_id")


def jaccard_join(docs: DataFrame, words: int = 4, share: tuple[int, int] = (85, 100)) -> DataFrame:
    """Components of the rows of ``docs`` (doc_id, text) under Jaccard similarity of word shingles; exact.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the distinct shingles of
    ``words`` words, of a shorter text the whole sequence. Sets are 64-bit hashes of shingles and named
    by 128 bits. component_id is the smallest doc_id that links reach.

    A text without words, or NULL, has an empty set and is linked with nothing. Repeated rows are
    returned each; a row without doc_id has the component of the rows that it is linked with, NULL if
    there are none. Other columns are not read. Returns doc_id, n_shingles, component_id.
    """
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least_id"))
    return similar_rows(docs, words, share).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """One row of each component of ``similar_rows``: that with the smallest doc_id, then the smallest hash of its text.

    Rows without doc_id come last; of rows that agree in doc_id and text one stays, the first by the
    other columns. A row whose text is unlike all others is not touched, whatever its doc_id.
    """
    rows = similar_rows(docs, words, share).select("doc_id", "row", "component")
    rows = materialise(rows, f"{shared_folder(docs.sparkSession)}/components")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = rows.groupBy("component").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first != _last")
    others = rows.join(firsts, "component").where(key != F.col("_first")).select("doc_id", "row", F.lit(True).alias("_gone"))
    repeated = rows.groupBy("doc_id", "row").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", "row", F.lit(False).alias("_gone"))
    known = others.unionByName(repeated).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.max("_gone").alias("_gone"))
    left = docs.join(known, (F.xxhash64("text") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    place = F.row_number().over(W.partitionBy("doc_id", "_row").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    one = left.where("NOT _gone").withColumn("_place", place).where("_place = 1")
    return left.where("_gone IS NULL").select(*docs.columns).unionByName(one.select(*docs.columns))
