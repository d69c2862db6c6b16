"""A factorisation machine that scores the quality of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stallbook.llm import wordhash
from stallbook.llm.common import ship_package, whole_text

#: hashed words
WORDS = 1 << 15
#: steps of each structure statistic, which are one-hot features
STEPS = 12
STATS = (
    "letters", "upper", "digits", "spaces", "marks", "symbols", "word_length", "distinct", "top_word", "line_length",
    "size", "repeats",
)
FEATURES = WORDS + STEPS * len(STATS)
#: texts turned into features at once, and their bytes; a longer text is handled alone
BATCH = 256
BATCH_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:'\"()-"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _MARK)


def _structure(data: bytes, counts: np.ndarray, n_words: int, repeats: int) -> np.ndarray:
    """The statistics, each from 0 to 1."""
    size = max(len(data), 1)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(int(hist[_LETTER].sum()), 1)
    words = max(n_words, 1)
    lines = 1 + int(hist[10])
    return np.array([
        letters / size, hist[_UPPER].sum() / letters, min(1, 4 * hist[_DIGIT].sum() / size), 2 * hist[_BLANK].sum() / size,
        min(1, 5 * hist[_MARK].sum() / size), min(1, 5 * hist[_SYMBOL].sum() / size), min(1, size / words / 20),
        len(counts) / words, (counts.max() if len(counts) else 0) / words, min(1, np.log2(size / lines + 1) / 14),
        min(1, np.log2(size + 1) / 24), repeats / words,
    ])


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of every text: hashed words by share (unit length), statistics in steps."""
    owner_parts, hash_parts = [], []
    for h, owner in wordhash.words(texts):
        hash_parts.append(h)
        owner_parts.append(owner)
    h = np.concatenate(hash_parts) if hash_parts else np.zeros(0, np.uint64)
    owner = np.concatenate(owner_parts) if owner_parts else np.zeros(0, np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        own = h[bounds[i]: bounds[i + 1]]
        _, distinct = np.unique(own, return_counts=True)
        index, counts = np.unique((own % np.uint64(WORDS)).astype(np.int64), return_counts=True)
        stats = _structure(text, distinct, len(own), int((own[1:] == own[:-1]).sum()))
        steps = np.minimum((np.clip(stats, 0, 1) * STEPS).astype(np.int64), STEPS - 1)
        values = counts / max(np.sqrt((counts.astype(float) ** 2).sum()), 1)
        yield (np.concatenate([index, WORDS + np.arange(len(STATS)) * STEPS + steps]),
               np.concatenate([values, np.full(len(STATS), 0.5)]))


@dataclass
class FactorisationMachine:
    """Bias, weights and factors; ``raw`` takes time linear in the features of a text."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
        """Score before the logistic function, and the factor sums: the pairwise part is half of
        the squared sum less the sum of squares."""
        scaled = self.factors[index] * value[:, None]
        sums = scaled.sum(0)
        pairs = 0.5 * float((sums * sums).sum() - (scaled * scaled).sum())
        return self.bias + float(self.weights[index] @ value) + pairs, sums

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value)[0], -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 8, rate: float = 0.1,
          penalty: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """Adaptive gradient steps on the logistic loss."""
    rng = np.random.default_rng(seed)
    share = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, rank)))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-3), np.full((FEATURES, rank), 1e-3), 1e-3
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, value, y = rows[i]
            raw, sums = fm.raw(index, value)
            slope = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y
            own = fm.factors[index]
            step_w = slope * value + penalty * fm.weights[index]
            step_v = slope * value[:, None] * (sums - own * value[:, None]) + penalty * own
            seen_b += slope * slope
            seen_w[index] += step_w * step_w
            seen_v[index] += step_v * step_v
            fm.bias -= rate * slope / np.sqrt(seen_b)
            fm.weights[index] -= rate * step_w / np.sqrt(seen_w[index])
            fm.factors[index] -= rate * step_v / np.sqrt(seen_v[index])
    fm.weights, fm.factors = fm.weights.astype(np.float32), fm.factors.astype(np.float32)
    return fm


def held_out(doc_id: str = "doc_id"):
    """Rows of which no label is learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        data = x.as_buffer().to_pybytes() if x.is_valid else b""
        if held and (len(held) == BATCH or size + len(data) > BATCH_BYTES):
            yield at, held
            at, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield at, held


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _texts(batch, 2):
            rows = list(features(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1].tolist() for r in rows], pa.list_(pa.float32()))], ["key", "quality", "index", "value"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> FactorisationMachine:
    """Learns from at most ``max_rows`` labelled rows that are not held out.

    The sample is the documented bound: the labelled rows with the smallest hash of doc_id. Only its
    features come to the driver. Rows whose label is NULL are left out; without any the model says
    one half; of several labels of an id the largest counts.
    """
    ship_package(docs.sparkSession)
    chosen = (
        labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select("doc_id", whole_text().cast("binary").alias("_text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select(F.xxhash64("doc_id").alias("key"), "quality", "_text").mapInArrow(
        _sampled, "key long, quality int, index array<int>, value array<float>").toArrow().combine_chunks()
    sample = [
        (index.values.to_numpy(), value.values.to_numpy().astype(float), quality)
        for _, _, quality, index, value in sorted(
            (key, i, quality, rows["index"][i], rows["value"][i])
            for i, (key, quality) in enumerate(zip(rows["key"].to_pylist(), rows["quality"].to_pylist())))
    ]
    del rows
    pa.default_memory_pool().release_unused()
    return train(sample)


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.7, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Scores the whole text of every row of ``docs`` (doc_id, text).

    The model has a fixed size and is broadcast. A NULL text is the empty text, which has a score
    as well; repeated rows are scored each. Returns the columns ``kept``, score (0 to 1) and
    predicted (1 from ``threshold`` on).
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is kept goes to the workers once, not a second time for its score
    rows = docs.select(*dict.fromkeys((*kept, "text")))
    names, place = list(kept), rows.columns.index("text")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            for at, texts in _texts(batch, place):
                scores = [fm.score(i, v) for i, v in features(texts)]
                columns = [c.slice(at, len(texts)) for c in batch.columns[:len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*names, "score"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:len(names)]] + [T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
