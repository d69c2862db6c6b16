"""Removal of repeated byte strings by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallbook.llm import wordhash
from stallbook.llm.common import materialise, shared_folder, ship_package, whole_text
from stallbook.llm.induced_sort import common_with_previous, suffix_array

#: bytes of the strings by which windows are dealt to shards
GRAM = 32
#: bytes whose windows are looked at together
SLICE = 1 << 19
#: segments among which equal ones are merged before they are shuffled
HELD = 100_000
#: bytes of one suffix array; the segments of an anchor with more go on window by window
SHARD = 1 << 20
#: anchors (a number each) up to which their list is broadcast; beyond it segments are shuffled for the join
BROADCAST_ANCHORS = 100_000
_OTHER = np.random.default_rng(100).permutation(256).astype(np.uint8)
_VERSION_BITS = 23


def _version() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text").bitwiseAND(F.lit((1 << _VERSION_BITS) - 1).cast("long"))


def _anchored(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, count): runs of windows of ``length`` bytes that choose the same anchor.

    A window's anchor is the GRAM bytes in it with the smallest hash, the leftmost of equal ones, so
    equal windows have equal anchors. ``ends``: the end of the text that holds each byte.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    starts = np.arange(n - GRAM + 1)
    grams = wordhash.spans(wordhash.prefix(data), starts, starts + GRAM)
    least = (grams & ~np.uint64(0xFFFFF)) | starts.astype(np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span:])
    valid = np.arange(len(least)) + length <= ends[: len(least)]
    change = np.flatnonzero((least[1:] != least[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.append(first, len(least)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    return grams[(least[first] & np.uint64(0xFFFFF)).astype(np.int64)], first, count


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, index of the text, its place in the text, end of the text) of bounded parts; long texts overlap."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        sizes = np.array([len(p[2]) for p in parts])
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        return (data, np.repeat([p[0] for p in parts], sizes),
                np.arange(len(data)) - np.repeat(begins, sizes) + np.repeat([p[1] for p in parts], sizes),
                np.repeat(begins + sizes, sizes))

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), SLICE - length + 1):
            part = text[at: at + SLICE]
            if parts and size + len(part) > SLICE:
                yield joined()
                parts, size = [], 0
            parts.append((i, at, part))
            size += len(part)
    if parts:
        yield joined()


def _runs(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchored runs of all texts. Of equal anchors in a batch one is to be counted, the others are known to repeat."""
    for batch in batches:
        ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at in range(0, batch.num_rows, 1024):
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2).slice(at, 1024)]
            found = []
            for data, owner, place, ends in _slices(texts, length):
                h, first, count = _anchored(data, ends, length)
                found.append((h, owner[first], place[first], count))
            if not found:
                continue
            h, owner, start, count = (np.concatenate(x) for x in zip(*found))
            _, one, seen = np.unique(h, return_index=True, return_counts=True)
            repeats = np.ones(len(h), np.int8)
            repeats[one] = np.where(seen > 1, 2, 0)
            where = (versions[at + owner] << 40) | (start << 8) | count
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids[at + owner]), pa.array(where), pa.array(repeats)],
                ["h", "doc_id", "place", "repeats"])


def _repeating(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors that occur twice; rows to be counted come sorted by anchor."""
    rest = None
    for batch in batches:
        h, repeats = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        known = repeats > 0
        counted = np.flatnonzero(repeats != 1)
        twice = h[counted][1:] == h[counted][:-1]
        known[counted[1:][twice]] = True
        known[counted[:-1][twice]] = True
        if rest is not None and len(counted) and h[counted[0]] == rest[0]:
            known[counted[0]] = True
            if rest[1] is not None:
                yield rest[1].select(["h", "doc_id", "place"])
        if len(counted):
            last = counted[-1]
            rest = (h[last], None if known[last] else batch.slice(int(last), 1))
        yield batch.filter(pa.array(known)).select(["h", "doc_id", "place"])


def _segments(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each run; of equal segments that follow soon only the earliest, the others are repeats (h NULL)."""
    h, doc, version, start, count, data = columns = [[] for _ in range(6)]
    known: dict[tuple[int, bytes], int] = {}
    for batch in batches:
        for doc_id, v, text, runs in zip(*(batch.column(i) for i in range(4))):
            doc_id, v, text = doc_id.as_py(), v.as_py(), text.as_buffer().to_pybytes()
            for run in runs.as_py():
                s, n = (run["place"] >> 8) & 0xFFFFFFFF, run["place"] & 0xFF
                key = (run["h"], text[s: s + n + length - 1])
                for column, value in zip(columns, (run["h"], doc_id, v, s, n, key[1])):
                    column.append(value)
                new = len(h) - 1
                i = known.setdefault(key, new)
                if i != new:
                    first = (doc_id, v, s) < (doc[i], version[i], start[i])
                    later = i if first else new
                    h[later], data[later] = None, None
                    if first:
                        known[key] = new
            if len(h) >= HELD:
                yield _segment_batch(*columns)
                known.clear()
                for column in columns:
                    column.clear()
    yield _segment_batch(*columns)


_SEGMENT_NAMES = ["h", "doc_id", "version", "start", "n", "data"]
_SEGMENT_SCHEMA = "h long, doc_id long, version long, start long, n int, data binary"


def _segment_batch(*columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _SEGMENT_NAMES)


_WINDOW_NAMES = ["w1", "w2", "doc_id", "version", "start", "again"]
_WINDOW_SCHEMA = "w1 long, w2 long, doc_id long, version long, start long, again boolean"


def _windows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the segments by two hashes; of equal ones in a batch all but the earliest are known to repeat."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            pieces = [x.as_buffer().to_pybytes() for x in part.column(5)]
            data = np.frombuffer(b"".join(pieces), np.uint8)
            counts = part.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(p) for p in pieces], np.int64)
            owner = np.repeat(np.arange(len(pieces)), counts)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = (np.cumsum(sizes) - sizes)[owner] + offset
            w1, w2 = (wordhash.spans(wordhash.prefix(x), begin, begin + length).view(np.int64) for x in (data, _OTHER[data]))
            doc, version, start = (part.column(k).to_numpy(zero_copy_only=False)[owner] for k in (1, 2, 3))
            start = start + offset
            order = np.lexsort((start, version, doc, w2, w1))
            columns = [c[order] for c in (w1, w2, doc, version, start)]
            again = np.append(False, (np.diff(columns[0]) == 0) & (np.diff(columns[1]) == 0))[: len(order)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(again)], _WINDOW_NAMES)


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All but the earliest of equal windows; rows come sorted by hashes, then by place."""
    last = None
    for batch in batches:
        w1, w2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        again = np.append(last is not None and len(w1) > 0 and last == (w1[0], w2[0]), (np.diff(w1) == 0) & (np.diff(w2) == 0))[: len(w1)]
        if len(w1):
            last = (w1[-1], w2[-1])
        yield batch.filter(pa.array(again.astype(bool))).select(["doc_id", "version", "start"])


def _in_hot_anchors(segments: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """(segments of the other anchors, segments of those with more than ``shard`` bytes)."""
    hot = segments.groupBy("h").agg(F.sum(F.octet_length("data")).alias("_bytes")).where(F.col("_bytes") > shard).select("h")
    hot = materialise(hot, f"{shared_folder(segments.sparkSession)}/hot")
    known = F.broadcast(hot) if hot.count() <= BROADCAST_ANCHORS else hot
    return segments.join(known, "h", "left_anti").select(*_SEGMENT_NAMES), segments.join(known, "h", "left_semi").select(*_SEGMENT_NAMES)


def _repeats(batches: Iterable[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows that start earlier elsewhere; rows come sorted by anchor, then by place."""
    names = ["doc_id", "version", "start", "n"]

    def batch_of(doc, version, start, n) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, version, start, n), kinds)], names)

    def grouped() -> Iterator[list[tuple]]:
        """Different segments of one anchor, each with its earliest place; equal ones are yielded as repeats."""
        own: list[tuple] = []
        seen: set[bytes] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own and own[-1][0] != row[0]:
                    yield own
                    own, seen = [], set()
                if row[5] in seen:
                    same.append(row)
                else:
                    seen.add(row[5])
                    own.append(row)
        if own:
            yield own

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        pieces = [r[5] for r in rows]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(rows)), sizes)
        offset = np.arange(len(data)) - begins[owner]
        whole = offset < np.array([r[4] for r in rows])[owner]
        # the order of places: documents in order, then the start
        docs = sorted({r[1:3] for r in rows})
        rank = {d: i for i, d in enumerate(docs)}
        place = (np.array([rank[r[1:3]] for r in rows])[owner] << 40) + np.array([r[3] for r in rows])[owner] + offset
        suffixes = suffix_array(data, length)
        shared = common_with_previous(data, suffixes, length)
        ordered = suffixes[whole[suffixes]]
        # windows within their segment are neighbours in the array if they are equal
        classes = np.cumsum(~shared[suffixes])[whole[suffixes]]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1])
        first = np.repeat(np.minimum.reduceat(place[ordered], begin), np.diff(np.append(begin, len(ordered))))
        hit = np.sort(ordered[place[ordered] != first])
        if not len(hit):
            return batch_of([], [], [], [])
        cut = np.concatenate([[0], np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1])
        n = np.diff(np.append(cut, len(hit)))
        at = hit[cut]
        return batch_of([rows[o][1] for o in owner[at]], [rows[o][2] for o in owner[at]],
                        (np.array([r[3] for r in rows])[owner[at]] + offset[at]), n)

    same: list[tuple] = []
    rows: list[tuple] = []
    size = 0

    def flush_same() -> pa.RecordBatch:
        done = batch_of([r[1] for r in same], [r[2] for r in same], [r[3] for r in same], [r[4] for r in same])
        same.clear()
        return done

    for own in grouped():
        if len(same) > 10_000:
            yield flush_same()
        if len(own) < 2:
            continue
        more = sum(len(r[5]) for r in own)
        if rows and size + more > limit:
            yield shard(rows)
            rows, size = [], 0
        rows += own
        size += more
    if rows:
        yield shard(rows)
    yield flush_same()


def _cut(batches: Iterable[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, runs in zip(*(batch.column(i) for i in range(3))):
            data = text.as_buffer().to_pybytes()
            runs = sorted((r["start"], r["start"] + r["n"] + length - 1) for r in runs.as_py() or [])
            kept, at, removed, spans = [], 0, 0, 0
            upto = -1
            for s, e in runs:
                e = min(e, len(data))
                if s > upto:
                    spans += 1
                    kept.append(data[at:s])
                    removed += e - s
                elif e > upto:
                    removed += e - upto
                upto = max(upto, e)
                at = upto
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((doc_id.as_py(), len(data), removed, spans, hashlib.sha256(left).hexdigest(), *[left] * with_text))
        columns = list(zip(*out)) or [()] * (5 + with_text)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])


def dedup_strings(docs: DataFrame, length: int = 100, with_text: bool = False, shard: int = SHARD) -> DataFrame:
    """Removes from every row of ``docs`` (doc_id, text) each byte in a string of ``length`` bytes that starts earlier too.

    Earlier is a smaller doc_id, or an earlier start in the same text; texts are judged as they came
    in, matches overlap and never cross texts.

    Every window of ``length`` bytes goes to the shard of its anchor (the 32 bytes with the smallest
    hash in it), so equal windows meet, and only windows whose anchor occurs twice go anywhere. A
    copy of a whole text goes by its hash; of equal pieces in one batch or shard the earliest
    stands for all, so large groups of copies and frequent passages arrive once per batch. The
    different pieces of an anchor form a shard's text. Its suffix array is made by induced sorting;
    with the permuted common prefixes, windows that share ``length`` bytes are neighbours, and all
    but the earliest are repeats. The segments of an anchor with more than ``shard`` bytes, such as
    a phrase of many texts in different surroundings, do not meet in one array: their windows are dealt by two
    64-bit hashes of the whole window, and all but the earliest of equal ones are repeats.

    A NULL text is empty. Rows without doc_id are not compared and lose nothing. Rows of one doc_id
    with different texts are ordered by a hash of the text; equal rows are one document and lose the
    same bytes. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept
    (binary: a cut may part a character).
    """
    if not GRAM <= length <= GRAM + 200:
        raise ValueError(f"length is from {GRAM} to {GRAM + 200}")
    spark = docs.sparkSession
    ship_package(spark)
    folder = shared_folder(spark)
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("version", _version())
    real = rows.where("doc_id IS NOT NULL")
    binary = F.col("text").cast("binary").alias("data")

    place = F.struct("doc_id", "version")
    keyed = real.where(F.octet_length("text") >= length).select(
        "doc_id", "version", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    firsts = keyed.groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    copies = materialise(
        keyed.join(firsts, "sha").where(place != F.col("first")).select("doc_id", "version", "size").distinct(), f"{folder}/copies")

    anchors = real.select("doc_id", "version", binary).mapInArrow(
        lambda it: _runs(it, length), "h long, doc_id long, place long, repeats byte")
    dealt = anchors.repartition(
        F.when(F.col("repeats") == 1, F.xxhash64("doc_id", "place")).otherwise(F.col("h")))
    twice = dealt.sortWithinPartitions("h").mapInArrow(_repeating, "h long, doc_id long, place long")
    version = F.shiftright("place", 40)
    candidates = materialise(
        twice.join(copies.select("doc_id", F.col("version").alias("_v")), (twice.doc_id == copies.doc_id) & (version == F.col("_v")), "left_anti"),
        f"{folder}/candidates")

    by_text = candidates.groupBy("doc_id", version.alias("version")).agg(F.collect_list(F.struct("h", "place")).alias("runs"))
    segments = real.select("doc_id", "version", binary).join(by_text, ["doc_id", "version"]).select(
        "doc_id", "version", "data", "runs").mapInArrow(lambda it: _segments(it, length), _SEGMENT_SCHEMA)
    segments = materialise(segments, f"{folder}/segments")
    bounded, hot = _in_hot_anchors(segments.where("h IS NOT NULL"), shard)
    shards = bounded.repartition("h").sortWithinPartitions("h", "doc_id", "version", "start")
    found = shards.mapInArrow(lambda it: _repeats(it, length, shard), "doc_id long, version long, start long, n long")
    windows = materialise(hot.mapInArrow(lambda it: _windows(it, length), _WINDOW_SCHEMA), f"{folder}/windows")
    dealt = windows.where("NOT again").repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc_id", "version", "start")
    single = dealt.mapInArrow(_later, "doc_id long, version long, start long").unionByName(
        windows.where("again").select("doc_id", "version", "start"))
    one = F.lit(1).cast("long").alias("n")
    repeats = (
        found.unionByName(single.select("doc_id", "version", "start", one))
        .unionByName(segments.where("h IS NULL").select("doc_id", "version", "start", F.col("n").cast("long").alias("n")))
        .unionByName(copies.select("doc_id", "version", F.lit(0).cast("long").alias("start"),
                                   (F.col("size") - (length - 1)).cast("long").alias("n")))
    )
    removed = materialise(
        repeats.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("runs")), f"{folder}/removed")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.select("doc_id", "version", binary).join(removed, ["doc_id", "version"], "left").select(
        "doc_id", "data", "runs").mapInArrow(lambda it: _cut(it, length, with_text), schema)
