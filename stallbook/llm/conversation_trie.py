"""Prefix trie of rebuilt conversations: ternary search trees per range shard, merged at their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W
from pyspark.sql.types import FractionalType

from stallbook.llm.common import materialise, numbered, shared_folder, ship_package

#: turns of a segment; a longer conversation is several segments
SEGMENT = 512
#: turns of a tree; the sequences of a shard are cut into as many trees as needed
TREE_TURNS = 200_000
#: parts into which the turns are cut for counting, by their place in a conversation
PARTS = 64
#: bytes of conversation ids that are joined before they are hashed
JOINED = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words), one row a turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))


def _placed(turns: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 0) and ``pos_total``; a conversation of many turns is cut by quantiles of ``turn``."""
    top = turns.agg(F.max("turn")).first()[0]
    cuts = [] if top is None else sorted({*turns.approxQuantile("turn", [i / PARTS for i in range(PARTS)], 0.5 / PARTS), float(top)})
    part = reduce(lambda a, c: a + (F.col("turn") >= c).cast("int"), cuts, F.lit(1))
    # turns of one number, or without one, are ordered by their digests
    whole = not isinstance(turns.schema["turn"].dataType, FractionalType)
    single = [i + 2 for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], top + 1])) if whole and b - a <= 1] if cuts else []
    part = F.coalesce(part, F.lit(0))
    within = F.when(part.isin([0, *single]), F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")).otherwise(F.lit(0))
    return numbered(turns, ["conv_id"], part * 256 + within, [F.asc_nulls_first("turn"), "digest"], "pos")


def rebuilt(conversations: DataFrame, family: int = 20, draws: int = 4) -> DataFrame:
    """(conv_id, pos, digest, words, length): every conversation with its first turns taken from the head of its family.

    Of conversation c, the first h = crc32(c) % draws turns come from conversation c - c % family,
    the others are its own. Turns are ordered by ``turn`` (NULL first), then by a digest of role and
    text. Each conversation has one more row without pos, so that one without turns is there too.
    """
    placed = materialise(_placed(_turns(conversations)), f"{shared_folder(conversations.sparkSession)}/placed")
    convs = placed.where("pos = 0").select("conv_id", F.col("pos_total").alias("total")).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % draws).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    heads = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("total").alias("_total"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("_total", F.lit(0)))).withColumn(
        "length", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    first = placed.where((F.col("pos") < draws - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    borrowed = convs.where("taken > 0").select("conv_id", "base", "taken", "length").join(first, "base").where("pos < taken")
    # a long conversation is joined in parts
    own = placed.withColumn("_part", F.expr(f"pos div {SEGMENT}")).join(
        convs.select("conv_id", "h", "taken", "length", F.explode(F.expr(f"sequence(0L, (total - 1) div {SEGMENT})")).alias("_part")), ["conv_id", "_part"])
    columns = ["conv_id", "pos", "digest", "words", "length"]
    return (
        own.where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(*columns)
        .unionByName(borrowed.select(*columns))
        .unionByName(convs.select("conv_id", "length"), allowMissingColumns=True))


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, p1, p2, seq, e1, e2, goes_on): the names of the nodes before and at the end of each segment.

    A node is named by the exclusive or of two hashes of the turns up to it, each hashed with its
    place, so no conversation is read in order to name its nodes.
    """
    z = [F.xxhash64(F.lit(i), "digest", "pos").alias(f"z{i}") for i in (1, 2)]
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "z1", "z2", "words"))
    segments = (
        turns.select("*", *z, F.coalesce(F.expr(f"pos div {segment}"), F.lit(0).cast("long")).alias("seg"))
        .groupBy("conv_id", "seg").agg(
            F.sort_array(F.collect_list(turn)).alias("seq"), F.max("length").alias("length"),
            *[F.coalesce(F.bit_xor(F.when(F.col("pos").isNotNull(), F.col(f"z{i}"))), F.lit(0).cast("long")).alias(f"x{i}") for i in (1, 2)])
        .withColumn("seq", F.transform("seq", lambda t: F.struct(t["z1"].alias("z1"), t["z2"].alias("z2"), t["words"].alias("w"))))
        .withColumn("goes_on", F.col("seg") < F.expr(f"(length - 1) div {segment}")))
    before = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    long_ = segments.where(f"length > {segment}").select(
        "*", *[F.coalesce(F.bit_xor(f"x{i}").over(before), zero).alias(f"p{i}") for i in (1, 2)])
    one = segments.where(f"length <= {segment}").select("*", zero.alias("p1"), zero.alias("p2"))
    return one.unionByName(long_).select(
        "conv_id", "seg", "p1", "p2", "seq", "goes_on", *[F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"e{i}") for i in (1, 2)])


class TernaryTree:
    """A ternary search tree over sequences of turn codes; nodes are numbered as they come, parents first."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down = [-1], [-1], [-1], [-1]
        self.parent, self.at, self.n, self.first = [-1], [-1], [0], [None]

    def insert(self, codes: list[int], begin: int, end: int, n: int, first: int) -> int:
        """Adds ``n`` conversations, the smallest of them ``first``, along codes[begin:end]; returns the last node."""
        code, low, high, down = self.code, self.low, self.high, self.down
        node = 0
        for i in range(begin, end):
            self._count(node, n, first)
            c, child, came = codes[i], down[node], None
            while child >= 0 and code[child] != c:
                came = (low if c < code[child] else high), child
                child = came[0][child]
            if child < 0:
                child = len(code)
                for column, value in ((code, c), (low, -1), (high, -1), (down, -1), (self.parent, node), (self.at, i), (self.n, 0), (self.first, None)):
                    column.append(value)
                if came:
                    came[0][came[1]] = child
                else:
                    down[node] = child
            node = child
        self._count(node, n, first)
        return node

    def _count(self, node: int, n: int, first: int) -> None:
        self.n[node] += n
        if self.first[node] is None or first < self.first[node]:
            self.first[node] = first


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves, so that sorted sequences make a balanced tree."""
    ranges = [(0, n)]
    while ranges:
        s, e = ranges.pop()
        if s < e:
            middle = (s + e) // 2
            yield middle
            ranges += [(middle + 1, e), (s, middle)]


_NODE = {k: pa.int64() for k in ("x1", "x2", "up1", "up2", "depth", "tree", "first", "up_first", "n", "words", "kids", "leaves", "saved")}


def _tree(group: tuple[int, int, int], segment: int, tree: int, z: list[np.ndarray], begins: list[int], n: list[int], first: list[int], on: list[bool]) -> pa.RecordBatch:
    """The nodes of the sorted sequences of one tree.

    Nodes on the way to the first or last sequence, or to one that goes on, have a subtree that may
    reach beyond the tree; they come with ``open`` and sums over their finished children only.
    """
    seg, p1, p2 = group
    z1, z2, words = z
    order = np.lexsort((z2, z1))
    new = np.append(True, (np.diff(z1[order]) != 0) | (np.diff(z2[order]) != 0))[: len(order)]
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    codes = codes.tolist()
    built = TernaryTree()
    last = {}
    ends = [0] * (len(begins) - 1)
    for i in medians(len(ends)):
        ends[i] = built.insert(codes, begins[i], begins[i + 1], n[i], first[i])
    size = len(built.code)
    open_ = [False] * size
    open_[0] = True
    for node in {ends[0], ends[-1], *[e for e, goes in zip(ends, on) if goes]}:
        while not open_[node]:
            open_[node] = True
            node = built.parent[node]
    v1, v2, w = z1.tolist(), z2.tolist(), words.tolist()
    x1, x2, depth = [p1] * size, [p2] * size, [seg * segment] * size
    for node in range(1, size):
        up, at = built.parent[node], built.at[node]
        x1[node], x2[node], depth[node] = x1[up] ^ v1[at], x2[up] ^ v2[at], depth[up] + 1
    own = [0, *[w[at] for at in built.at[1:]]]
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in range(size - 1, 0, -1):
        if open_[node]:
            continue
        saved[node] += (built.n[node] - 1) * own[node]
        leaves[node] = leaves[node] or 1
        up = built.parent[node]
        kids[up] += 1
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    if seg:  # the segment before counts the members of this node
        built.n[0], built.first[0] = 0, None
    ups = [max(p, 0) for p in built.parent]
    columns = {
        "x1": x1, "x2": x2, "up1": [None, *[x1[p] for p in ups[1:]]], "up2": [None, *[x2[p] for p in ups[1:]]], "depth": depth,
        "tree": [tree] * size, "first": built.first, "up_first": [None, *[None if open_[p] else built.first[p] for p in ups[1:]]],
        "n": built.n, "words": own, "kids": kids, "leaves": leaves, "saved": saved}
    return pa.RecordBatch.from_arrays([*[pa.array(columns[k], t) for k, t in _NODE.items()], pa.array(open_)], [*_NODE, "open"])


def _trees(batches: Iterable[pa.RecordBatch], segment: int, most: int) -> Iterator[pa.RecordBatch]:
    """Trees of the sorted rows (seg, p1, p2, seq, n, first, goes_on) of a shard; one for each group and ``most`` turns."""
    number = TaskContext.get().partitionId() << 32
    held: list = []
    group, size = None, 0

    def built() -> pa.RecordBatch:
        lengths = np.concatenate([h[0] for h in held])
        rest = [sum((h[k] for h in held), []) for k in (2, 3, 4)]
        return _tree(group, segment, number, [np.concatenate([h[1][k] for h in held]) for k in range(3)], np.append(0, np.cumsum(lengths)).tolist(), *rest)

    for batch in batches:
        seg, p1, p2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        seq = batch.column(3)
        lengths = np.diff(seq.offsets.to_numpy())
        flat = seq.flatten()
        z = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
        n, first, on = (batch.column(k).to_pylist() for k in (4, 5, 6))
        upto = np.append(0, np.cumsum(lengths))
        change = (np.diff(seg) != 0) | (np.diff(p1) != 0) | (np.diff(p2) != 0)
        cuts = np.unique(np.concatenate([[0, len(seg)], np.flatnonzero(change) + 1, np.searchsorted(upto, np.arange(most, upto[-1], most))]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = int(seg[s]), int(p1[s]), int(p2[s])
            if held and (own != group or size + upto[e] - upto[s] > most):
                yield built()
                number += 1
                held, size = [], 0
            group = own
            held.append((lengths[s:e], [c[upto[s]: upto[e]] for c in z], n[s:e], first[s:e], on[s:e]))
            size += int(upto[e] - upto[s])
    if held:
        yield built()


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e1, e2, conv_id, ids): runs of ids of one node as text; rows come sorted."""
    for batch in batches:
        e1, e2, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero(np.append(True, (np.diff(e1) != 0) | (np.diff(e2) != 0))).tolist() if len(conv) else []
        step = JOINED // 20
        starts = [i for s, e in zip(cuts, [*cuts[1:], len(conv)]) for i in range(s, e, step)]
        ids = [",".join(map(str, conv[s:min(e, s + step)].tolist())) for s, e in zip(starts, _ends(starts, cuts, len(conv)))]
        yield pa.RecordBatch.from_arrays([pa.array(e1[starts]), pa.array(e2[starts]), pa.array(conv[starts]), pa.array(ids, pa.string())], ["e1", "e2", "conv_id", "ids"])


def _ends(starts: list[int], cuts: list[int], n: int) -> list[int]:
    """Where the run of each start ends."""
    return np.append(cuts, n)[np.searchsorted(cuts, starts, "right")].tolist()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e1, e2, sha) of all ids of a node; its runs come in order and are hashed one after the other."""
    key, sha = None, hashlib.sha256()
    for batch in batches:
        out = []
        for *own, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)]):
            if own != key:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = own, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _shas(out)
    if key:
        yield _shas([(*key, sha.hexdigest())])


def _shas(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["e1", "e2", "sha"])


def _border(nodes: DataFrame, folder: str) -> DataFrame:
    """The open nodes, merged by name and finished: each adds up what hangs below it, at twice the distance in every round."""
    merged = materialise(
        nodes.where("open").groupBy("x1", "x2").agg(
            F.max("depth").alias("depth"), F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.min("first").alias("first"),
            *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], F.max("words").alias("words")), f"{folder}/merged")
    below = merged.where("depth > 0").groupBy(F.col("up1").alias("x1"), F.col("up2").alias("x2")).agg(F.count("*").alias("_kids"))
    kids = F.col("kids") + F.coalesce("_kids", F.lit(0))
    own = materialise(
        merged.join(below, ["x1", "x2"], "left").withColumn("kids", kids)
        .withColumn("leaves", F.when(F.col("kids") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")))
        .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words")).drop("_kids", "words"), f"{folder}/own")
    sums = own.select("x1", "x2", "up1", "up2", "leaves", "saved")
    step = 0
    while not sums.where("up1 IS NOT NULL").isEmpty():
        further = sums.select(F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("up1").alias("_up1"), F.col("up2").alias("_up2"))
        more = sums.where("up1 IS NOT NULL").groupBy(F.col("up1").alias("x1"), F.col("up2").alias("x2")).agg(
            F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        sums = materialise(
            sums.join(further, ["up1", "up2"], "left").join(more, ["x1", "x2"], "left").select(
                "x1", "x2", F.col("_up1").alias("up1"), F.col("_up2").alias("up2"),
                *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]), f"{folder}/sums{step}")
        step += 1
    above = own.select(F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("first").alias("up_first"))
    return own.drop("leaves", "saved").join(above, ["up1", "up2"], "left").join(sums.drop("up1", "up2"), ["x1", "x2"])


def prefix_trie(
    conversations: DataFrame, family: int = 20, draws: int = 4, segment: int = SEGMENT, tree_turns: int = TREE_TURNS,
) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations (``rebuilt``) of ``conversations`` (conv_id, turn, role, text).

    Sequences of turns are counted once per different sequence, sorted over range shards, and each
    shard builds ternary search trees of bounded size. A tree finishes the nodes whose subtree lies
    within it; the others, on the way to its first and last sequence, are merged by name over all
    trees and summed up along the merged paths.

    NULL role or text is empty; turns of one number are ordered by a digest of both; repeated rows
    are turns each. Rows without conv_id belong to no conversation. Without conversations there is
    no node. Other columns are not read. Returns conv_id (smallest member), depth, parent_conv_id (NULL at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    folder = shared_folder(spark)
    segments = materialise(_segments(rebuilt(conversations, family, draws), segment), f"{folder}/segments")
    distinct = segments.groupBy("seg", "p1", "p2", "seq").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("goes_on").alias("goes_on"))
    place = ["seg", "p1", "p2", "seq"]
    schema = ", ".join(f"{k} long" for k in _NODE) + ", open boolean"
    nodes = materialise(
        distinct.repartitionByRange(*place).sortWithinPartitions(*place).select(*place, "n", "first", "goes_on").mapInArrow(
            lambda it: _trees(it, segment, tree_turns), schema),
        f"{folder}/nodes")
    border = materialise(_border(nodes, folder), f"{folder}/border")
    # children of a merged node look it up in their own tree, so that no node gathers all its children
    named = nodes.where("open").select("x1", "x2", "tree").join(border.select("x1", "x2", F.col("first").alias("_first")), ["x1", "x2"])
    named = named.select(F.col("x1").alias("up1"), F.col("x2").alias("up2"), "tree", "_first")
    inner = nodes.where("NOT open").join(named, ["up1", "up2", "tree"], "left").withColumn("up_first", F.coalesce("up_first", "_first"))
    columns = ["x1", "x2", "depth", "first", "up_first", "n", "kids", "leaves", "saved"]
    ends = segments.where("NOT goes_on").select("e1", "e2", "conv_id")
    by_node = ends.repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id")
    runs = by_node.mapInArrow(_joined, "e1 long, e2 long, conv_id long, ids string")
    shas = runs.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "conv_id").mapInArrow(_hashed, "e1 long, e2 long, sha string")
    shas = shas.select(F.col("e1").alias("x1"), F.col("e2").alias("x2"), "sha")
    everything = inner.select(*columns).unionByName(border.select(*columns)).join(shas, ["x1", "x2"], "left")
    return everything.select(
        F.col("first").alias("conv_id"), "depth", F.col("up_first").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest, turn,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS p FROM own),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1)))),
             4294967295::BIGINT) % 4 AS h
  FROM own GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, p.p, p.digest, p.words FROM convs c JOIN placed p ON p.conv_id = c.base AND p.p < c.h
  UNION ALL SELECT c.conv_id, p.p + 1000000, p.digest, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.p >= c.h),
sequences AS (
  SELECT c.conv_id, coalesce(list(t.digest ORDER BY t.p) FILTER (t.p IS NOT NULL), []) AS seq,
         coalesce(list(t.words ORDER BY t.p) FILTER (t.p IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
depths AS (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM sequences),
paths AS (
  SELECT conv_id, depth, array_to_string(seq[1:depth], ',') AS node, CASE WHEN depth > 0 THEN array_to_string(seq[1:depth - 1], ',') END AS above,
         CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words, depth = len(seq) AS ends FROM depths),
nodes AS (
  SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT a.depth, a.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n_convs - 1) * u.words) AS saved
  FROM nodes u LEFT JOIN children c ON c.depth = u.depth AND c.node = u.node
  JOIN paths a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.depth, a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.above
LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
JOIN sums s ON s.depth = n.depth AND s.node = n.node
"""
