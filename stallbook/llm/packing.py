"""Power-of-two decomposition of documents into training sequences."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallbook.llm.common import materialise, numbered, shared_folder, ship_package

_WORD = re.compile(r"[^ \t\r\n]+")
#: what str.split takes for white space and the tokenizers do not
_ODD = "\x1c\x1d\x1e\x1f"
_TAIL = ".,!?;:*#&%$|"
#: words, and words without the marks behind them, whose ids a worker keeps; beyond it starts afresh
CACHE_WORDS, CACHE_CORES = 400_000, 600_000
#: characters of texts whose unknown words are encoded together; a longer text is handled alone
TOGETHER = 1 << 18
#: bytes of ids that go on at once, where they are asked for
FLUSH = 1 << 20
#: parts of each length in which sequences are numbered; a fixed number
PARTS = 1024


class WordIds:
    """Token ids of texts as little-endian 32-bit integers, word by word with bounded caches.

    For tokenizers that drop white space, lower-case, and part letters and digits from marks, as
    word_bpe_49k.json: marks behind a letter or digit are tokens of their own. What counts is the
    last character after the tokenizer has normalised the word, which may be a combining mark.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        self.normal = normalizer.normalize_str if normalizer else str
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _cores(self, cores: set[str]) -> None:
        missing = [c for c in cores if c not in self.cores]
        if len(self.cores) + len(missing) > CACHE_CORES:
            self.cores, missing = {}, list(cores)
        # a run of letters is one piece, whose last token closes it: many are encoded as one text
        letters = [c for c in missing if c.isalpha() and (c.isascii() or self.normal(c).isalpha())]
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(letters) and ends[-1] == len(ids):
                data, at = ids.tobytes(), 0
                for c, end in zip(letters, (4 * ends).tolist()):
                    self.cores[c] = data[at:end]
                    at = end
                missing = [c for c in missing if c not in self.cores]
        for c, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
            self.cores[c] = array("I", e.ids).tobytes()

    def _closed(self, core: str) -> bool:
        """Whether marks behind the word begin a token."""
        last = core[-1]
        return (last if last.isascii() else self.normal(core)[-1:]).isalnum()

    def _learn(self, missing: set[str]) -> None:
        cut = {}
        for w in missing:
            core = w.rstrip(_TAIL)
            if core and len(core) < len(w) and self._closed(core) and "<|" not in w:
                cut[w] = (core.lower() if core.isascii() else core, w[len(core):])
            else:
                cut[w] = (w.lower() if w.isascii() and "<|" not in w else w, "")
        self._cores({part for both in cut.values() for part in both if part})
        for w, (core, tail) in cut.items():
            self.words[w] = self.cores[core] + self.cores[tail] if tail else self.cores[core]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that none of them had before are learnt at once."""
        split = [_WORD.findall(t) if any(c in t for c in _ODD) else t.split() for t in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.words)
        if missing:
            if len(self.words) + len(missing) > CACHE_WORDS:
                self.words, missing = {}, wanted
            self._learn(missing)
        return [b"".join(map(self.words.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as full pieces of ``longest`` (a power of two), then its binary digits, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _encoded(doc_ids: list, texts: Iterable[str | None], encode: WordIds) -> Iterator[tuple[int | None, bytes]]:
    """Each document with its ids; texts are encoded in groups of bounded size."""
    ids: list = []
    held: list[str] = []
    size = 0
    for doc_id, text in zip(doc_ids, texts):
        text = text or ""
        if held and size + len(text) > TOGETHER:
            yield from zip(ids, encode.many(held))
            ids, held, size = [], [], 0
        ids.append(doc_id)
        held.append(text)
        size += len(text)
    yield from zip(ids, encode.many(held))


def _pieces(batches: Iterable[pa.RecordBatch], path: str, end_id: int, longest: int, ids: bool) -> Iterator[pa.RecordBatch]:
    pa.default_memory_pool().release_unused()  # what earlier tasks of the worker left
    encode = _encoder(path)
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}

        def flush() -> pa.RecordBatch:
            names = [*list(out)[:5], *["ids"] * ids]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names)
            for values in out.values():
                values.clear()
            return done

        held = 0
        for doc_id, data in _encoded(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), encode):
            data += end
            start = 0
            for length in binary_lengths(len(data) // 4, longest):
                part = data[4 * start: 4 * (start + length)]
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(len(data) // 4)
                if ids:
                    out["ids"].append(part)
                    held += len(part)
                start += length
            if held > FLUSH:
                yield flush()
                held = 0
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = 4096, with_ids: bool = False) -> DataFrame:
    """Splits every row of ``docs`` (doc_id, text) into pieces whose lengths are powers of two.

    A document's tokens, with ``end_id`` behind them, are cut into pieces of ``longest`` (a power of
    two) and then by the binary digits of the rest, largest first. Every piece is one sequence: no
    sequence crosses documents and none has padding. Sequences are numbered by length, longest
    first, so equal lengths form one bucket of consecutive ids.

    A NULL text is empty (one piece, the end id); repeated rows are packed each. Returns doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset (0), and with ``with_ids`` the ids as
    little-endian 32-bit integers.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    path, ids = tokenizer_path, with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, path, end_id, longest, ids), schema)
    # tokens are made once; the numbers come from the written pieces
    pieces = materialise(pieces, f"{shared_folder(docs.sparkSession)}/pieces")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    bucket = (F.lit(longest.bit_length()) - F.log2("length").cast("int")) * PARTS + part
    rows = numbered(pieces, [], bucket, ["doc_id", "start", "ids_crc32"], "sequence_id")
    return rows.drop("sequence_id_total").withColumn("offset", F.lit(0).cast("long"))
