"""A word bigram model with deleted interpolation, over the counts of a whole corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from stallbook.llm import wordhash
from stallbook.llm.common import materialise, shared_folder, ship_package, whole_text

#: bytes of text that are counted together before counts are shuffled
CHUNK = 4 << 20
#: steps of a factor of two in which the held-out probabilities are tallied
TALLY = 8
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x2545F4914F6CDD1D)
_ZERO = -(1 << 14)


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as rows of chunks, each with its compressed texts."""
    ids: list = []
    train: list[bool] = []
    texts: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        columns = [[uuid.uuid4().int >> 65], [list(ids)], [[len(t) for t in texts]], [list(train)], [data]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]
        for held in (ids, train, texts):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _CHUNK_NAMES)

    for batch in batches:
        for doc_id, learnt, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids.append(doc_id)
            train.append(learnt)
            texts.append(text.as_buffer().to_pybytes())
            size += len(texts[-1]) + 16
            if size >= CHUNK:
                yield flush()
                size = 0
    if ids:
        yield flush()


_CHUNK_NAMES = ["chunk", "doc_ids", "sizes", "train", "data"]
_CHUNK_SCHEMA = "chunk long, doc_ids array<long>, sizes array<int>, train array<boolean>, data binary"


class _Tokens:
    """The tokens of a chunk: words and one end per document; ``before`` is the token they follow."""

    def __init__(self, sizes: list[int], train: list[bool], data: bytes):
        raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
        ends = np.cumsum(np.asarray(sizes, np.int64))
        parts = list(wordhash.words(raw[e - s: e] for s, e in zip(sizes, ends.tolist())))
        h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.n_docs = len(sizes)
        bounds = np.searchsorted(owner, np.arange(self.n_docs), "right")
        self.tokens = np.insert(h, bounds, _END)
        self.owner = np.insert(owner, bounds, np.arange(self.n_docs))
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.owner)) + 1])
        self.before[first] = _START
        self.first = np.zeros(len(self.tokens), bool)
        self.first[first] = True
        self.train = np.asarray(train, bool)[self.owner]

    def pairs(self) -> np.ndarray:
        return wordhash.mix(self.before * _PAIR + self.tokens)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _asked(batches: Iterable[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """The distinct tokens (kind 1) and pairs (kind 2) of each chunk with their training counts, by shard."""
    for batch in batches:
        for row in _rows(batch):
            chunk = _Tokens(row["sizes"], row["train"], row["data"])
            out: dict[str, list] = {k: [] for k in ("kind", "shard", "chunk", "hashes", "counts")}
            for kind, values in ((1, chunk.tokens), (2, chunk.pairs())):
                distinct, place = np.unique(values, return_inverse=True)
                counts = np.bincount(place[chunk.train], minlength=len(distinct)).astype(np.uint32)
                shards = (distinct >> np.uint64(shift)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(distinct)]])
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    out["kind"].append(kind)
                    out["shard"].append(int(shards[s]))
                    out["chunk"].append(row["chunk"])
                    out["hashes"].append(_packed(np.diff(distinct[s:e], prepend=np.uint64(0))))
                    out["counts"].append(_packed(counts[s:e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["kind"], pa.int32()), pa.array(out["shard"], pa.int64()), pa.array(out["chunk"], pa.int64()),
                 pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary())], list(out))


def _answered(group: pa.Table) -> pa.Table:
    """The counts over all chunks of what each chunk has asked for in one shard."""
    parts = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in group["hashes"].to_pylist()]
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    own = np.concatenate([_unpacked(x, np.uint32) for x in group["counts"].to_pylist()])
    counts = np.bincount(place, own, len(distinct)).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    replies = [_packed(counts[place[e - len(p): e]]) for p, e in zip(parts, ends.tolist())]
    n = len(replies)
    totals = [int((counts > 0).sum())] + [0] * (n - 1), [int(counts.sum())] + [0] * (n - 1)
    return pa.table({"kind": group["kind"], "shard": group["shard"], "chunk": group["chunk"], "reply": pa.array(replies, pa.binary()),
                     "types": pa.array(totals[0], pa.int64()), "tokens": pa.array(totals[1], pa.int64())})


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, _Tokens, np.ndarray, np.ndarray, np.ndarray]]:
    """Each chunk with the training counts of its tokens, of the pairs, and of the contexts (without the start)."""
    for batch in batches:
        for row in _rows(batch):
            chunk = _Tokens(row["sizes"], row["train"], row["data"])
            replies = sorted(row["replies"], key=lambda r: (r["kind"], r["shard"]))
            found = []
            for kind, values in ((1, chunk.tokens), (2, chunk.pairs())):
                _, place = np.unique(values, return_inverse=True)
                counts = np.concatenate([_unpacked(r["reply"], np.uint64) for r in replies if r["kind"] == kind])
                found.append(counts[place].astype(np.float64))
            single, pair = found
            context = np.empty_like(single)
            context[1:] = single[:-1]
            context[chunk.first] = np.nan
            yield row, chunk, single, pair, context


def _bucket(context: np.ndarray) -> np.ndarray:
    """Contexts by the powers of two of their frequency; 0 for an unseen one."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _share(part: np.ndarray, whole) -> np.ndarray:
    return np.where(np.asarray(whole) > 0, part / np.maximum(whole, 1), 0.0)


def _tallied(batches: Iterable[pa.RecordBatch], documents: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """Held-out counts: each training token with itself deleted from the counts, by bucket and the two probabilities."""
    def steps(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-300)) * TALLY), _ZERO).astype(np.int64)

    for _, chunk, single, pair, context in _counted(batches):
        own = chunk.train
        left = np.where(np.isnan(context), documents, context)[own] - 1
        cells = np.stack([_bucket(left), steps(_share(pair[own] - 1, left)), steps(_share(single[own] - 1, tokens - 1))], 1)
        key = (cells[:, 0] << 40) + ((cells[:, 1] - _ZERO) << 20) + (cells[:, 2] - _ZERO)
        distinct, counts = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(counts.astype(np.int64))], ["cell", "n"])


def interpolation_weights(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights of pair, single and uniform probability for each bucket, by expectation-maximisation."""
    bucket, two, one = cells >> 40, ((cells >> 20) & 0xFFFFF) + _ZERO, (cells & 0xFFFFF) + _ZERO
    value = lambda q: np.where(q == _ZERO, 0.0, 2.0 ** (np.maximum(q, -8000) / TALLY))
    parts = np.stack([value(two), value(one), np.full(len(cells), 1 / (types + 1))], 1)
    weights = np.full((64, 3), 1 / 3)
    for _ in range(rounds):
        shares = weights[bucket] * parts
        shares *= (n / shares.sum(1))[:, None]
        sums = np.full((64, 3), 1e-3)
        np.add.at(sums, bucket, shares)
        weights = sums / sums.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def score(docs: DataFrame, trained: str = "train") -> DataFrame:
    """log10 probability of every whole text of ``docs`` (doc_id, text, boolean ``trained``).

    Tokens are words and one end per text; a token's probability mixes its share after the token
    before, its share among all training tokens, and 1 / (V + 1). Shares are maximum-likelihood
    estimates from the counts of all training rows. The three weights depend on how often the
    context occurs (powers of two) and maximise the likelihood of the training tokens, each with
    its own occurrence deleted from the counts, by expectation-maximisation.

    Every token and pair is counted, none is capped or cut off. Chunks of CHUNK bytes pre-aggregate
    their distinct tokens and pairs and ask one shard per hash range for the counts over all chunks,
    so no frequent word meets in one task; there are as many shards as chunks. The held-out counts
    come to the driver as a tally over probability steps, whose size does not grow with the corpus.

    A NULL text is empty (its end alone is scored); a NULL ``trained`` row is not learnt from; repeated
    rows count each. Returns doc_id, n_tokens, n_known, train_tokens, base_score (add one), score.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = shared_folder(spark)
    rows = docs.select("doc_id", F.coalesce(F.col(trained), F.lit(False)).alias("train"), whole_text().cast("binary").alias("data"))
    chunks = materialise(rows.mapInArrow(_chunks, _CHUNK_SCHEMA), f"{folder}/chunks")
    n_chunks = chunks.count()
    shift = 64 - max(4, (n_chunks - 1).bit_length())
    asked = chunks.mapInArrow(lambda it: _asked(it, shift), "kind int, shard long, chunk long, hashes binary, counts binary")
    replies = materialise(
        asked.groupBy("kind", "shard").applyInArrow(
            _answered, "kind int, shard long, chunk long, reply binary, types long, tokens long"), f"{folder}/replies")
    sums = replies.where("kind = 1").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = (int(x or 0) for x in sums)
    documents = int(rows.where("train").count())
    by_chunk = replies.groupBy("chunk").agg(F.collect_list(F.struct("kind", "shard", "reply")).alias("replies"))
    counted = materialise(chunks.join(by_chunk, "chunk"), f"{folder}/counted")
    tally = (
        counted.mapInArrow(lambda it: _tallied(it, documents, tokens), "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    order = np.argsort(tally["cell"].to_numpy())
    weights = interpolation_weights(tally["cell"].to_numpy()[order], tally["n"].to_numpy()[order], types)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk, single, pair, context in _counted(batches):
            context = np.where(np.isnan(context), documents, context)
            mixed = weights[_bucket(context)]
            p = mixed[:, 0] * _share(pair, context) + mixed[:, 1] * _share(single, tokens) + mixed[:, 2] / (types + 1)
            base = np.log10((single + 1) / (tokens + types + 1))
            n = chunk.n_docs
            columns = [
                pa.array(row["doc_ids"], pa.int64()), pa.array(np.bincount(chunk.owner, minlength=n).astype(np.int64)),
                pa.array(np.bincount(chunk.owner, single > 0, n).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)),
                pa.array(np.bincount(chunk.owner, base, n)), pa.array(np.bincount(chunk.owner, np.log10(p), n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(
        scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
