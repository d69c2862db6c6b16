"""SimHash fingerprints and their self-join by traversing a binary trie in pairs of nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stallbook.llm.common import materialise, shared_folder, ship_package, whole_text
from stallbook.llm.components import components

BITS = 64
#: fingerprints of one part of the trie, beyond which it is split by further bits
PART = 4096
#: node pairs with so few candidate pairs are compared at once
LEAF = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at: at + _CHUNK].tolist(), ends[at: at + _CHUNK].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(starts)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", whole_text().cast("binary").alias("_text")).mapInArrow(_fingerprinted, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, used: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sorted, distinct 64-bit ``values`` that differ in ``budget`` bits at most.

    The binary trie of the values is traversed in pairs of nodes, one bit a step from bit
    63 - ``used`` on (all values agree on those before). A node is a range of the sorted values; a
    pair of nodes carries the bits in which its two prefixes differ and is dropped beyond the budget.
    """
    n = len(values)
    lo_a, hi_a = np.array([0]), np.array([n])
    lo_b, hi_b, error = lo_a.copy(), hi_a.copy(), np.array([0])
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for bit in range(BITS - 1 - used, -2, -1):
        sizes = (hi_a - lo_a) * (hi_b - lo_b)
        leaf = sizes <= LEAF if bit >= 0 else np.ones(len(sizes), bool)
        if leaf.any():
            count = sizes[leaf]
            which = np.repeat(np.flatnonzero(leaf), count)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = (hi_b - lo_b)[which]
            i, j = lo_a[which] + nth // width, lo_b[which] + nth % width
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            left.append(i[near])
            right.append(j[near])
        keep = ~leaf
        if not keep.any():
            break
        lo_a, hi_a, lo_b, hi_b, error = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, error))
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        mid_a, mid_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        same = lo_a == lo_b
        other = ~same
        nodes = [
            (lo_a, mid_a, lo_b, mid_b, error), (mid_a, hi_a, mid_b, hi_b, error), (lo_a, mid_a, mid_b, hi_b, error + 1),
            tuple(x[other] for x in (mid_a, hi_a, lo_b, mid_b, error + 1)),
        ]
        lo_a, hi_a, lo_b, hi_b, error = (np.concatenate(x) for x in zip(*nodes))
        keep = (hi_a > lo_a) & (hi_b > lo_b) & (error <= budget)
        lo_a, hi_a, lo_b, hi_b, error = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, error))
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _stars(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return label


def _joined(batches: Iterable[pa.RecordBatch], used: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; rows come sorted by key and value."""
    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        # columns: block, key, low, high, value, node; runs of one row have no pair
        if not len(rows):
            return
        cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        for s, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
            own = rows[s:e]
            values = own[:, 4].astype(np.uint64)
            order = np.argsort(values, kind="stable")
            left, right = trie_pairs(values[order], used[int(own[0, 0])], budget)
            if len(left):
                nodes = own[order, 5]
                top = _stars(left, right, len(nodes))
                moved = top != np.arange(len(nodes))
                out_a.append(nodes[moved])
                out_b.append(nodes[top[moved]])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    rest = np.zeros((0, 6), np.int64)
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        rows = np.concatenate([rest, rows])
        if not len(rows):
            continue
        last = int(np.flatnonzero((rows[:, :4] == rows[-1, :4]).all(1))[0])
        yield from links(rows[:last])
        rest = rows[last:]
    yield from links(rest)


def _turned(fp: Column, by: int) -> Column:
    """The bits rotated left."""
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def links(nodes: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): links between the rows of ``nodes`` (fp, node; distinct fps) that connect all within ``budget`` bits.

    The trie is distributed by its upper levels. Bits are cut into ``budget`` + 1 blocks; two
    fingerprints within the budget agree on one block at least, so for each block one trie has that
    block on top and only node pairs without an error there are followed: a part for each value.
    A part of over PART fingerprints is split by further bits, into all pairs of its nodes
    that the budget allows. Each part yields the links to the smallest member, not all pairs.
    """
    blocks = budget + 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    sizes = [b - a for a, b in zip(edges, edges[1:])]
    tries = nodes.select("node", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), _turned(F.col("fp"), edges[i]).alias("value")) for i in range(blocks)])).alias("t"))
    tries = tries.select("node", F.col("t.block").cast("long").alias("block"), F.col("t.value").alias("value")).withColumn(
        "key", F.expr("case block " + " ".join(f"when {i} then shiftrightunsigned(value, {BITS - s})" for i, s in enumerate(sizes)) + " end"))
    counts = tries.groupBy("block", "key").count()
    depth = F.least(F.lit(16), F.ceil(F.log2(F.col("count") / PART))).cast("int")
    hot = counts.where(F.col("count") > PART).select("block", "key", depth.alias("depth"))
    deep = tries.join(hot, ["block", "key"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    size = F.expr("case block " + " ".join(f"when {i} then {s}" for i, s in enumerate(sizes)) + " end")
    below = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(
        F.expr("shiftrightunsigned(shiftleft(value, _size), 64 - depth)"))
    one = F.expr("transform(sequence(0, depth - 1), a -> shiftleft(1L, a))")
    masks = F.when(F.col("depth") == 0, F.array(F.lit(0).cast("long"))).otherwise(_ball(one, budget))
    parts = (
        deep.withColumn("_size", size).withColumn("_below", below)
        .withColumn("_mask", F.explode(masks)).withColumn("_other", F.col("_below").bitwiseXOR(F.col("_mask")))
        .select("block", "key", F.least("_below", "_other").alias("low"), F.greatest("_below", "_other").alias("high"), "value", "node")
        .repartition("block", "key", "low", "high").sortWithinPartitions("block", "key", "low", "high")
    )
    ship_package(nodes.sparkSession)
    return parts.mapInArrow(lambda it: _joined(it, sizes, budget), "a long, b long")


def _ball(one: Column, budget: int) -> Column:
    """All masks of ``budget`` bits at most, from the masks of one bit."""
    masks = F.array(F.lit(0).cast("long"))
    for _ in range(budget):
        masks = F.array_distinct(F.concat(masks, F.flatten(F.transform(masks, lambda m: F.transform(one, lambda x: m.bitwiseOR(x))))))
    return masks


def near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    Rows of one fingerprint are one node, named by its smallest doc_id; nodes within ``budget`` bits
    are linked, and component_id is the smallest doc_id that a row reaches. A NULL text is empty;
    without words the fingerprint is zero. Rows without doc_id have a fingerprint and no component
    of their own: they get that of rows with the same fingerprint, NULL if there are none. Repeated
    rows are returned each.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    spark = docs.sparkSession
    rows = materialise(fingerprints(docs), f"{shared_folder(spark)}/fingerprints")
    nodes = materialise(
        rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), f"{shared_folder(spark)}/nodes")
    found = components(links(nodes, budget))
    named = nodes.join(found, "node", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("_fp"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
