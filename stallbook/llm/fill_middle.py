"""Fill-in-the-middle texts: cuts at token boundaries, found by rank in a compressed boundary set."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallbook.llm.common import ship_package, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: per cent of the texts that stay plain, and of the cut ones that begin with the suffix
PLAIN_SHARE, SPM_SHARE = 50, 80
#: values of one container, and the most values that an array container holds
CHUNK, ARRAY_MOST = 1 << 16, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of output texts that are held before they are handed on
_HELD = 8 << 20


class BoundarySet:
    """A set of offsets, in chunks of 65 536 values, each held in the smallest of three containers.

    An array holds the low 16 bits of its values, a bitmap one bit a value with set bits counted up
    to each 64-bit word, a run container starts and lengths with the values before each run.
    ``select(k)``, the k-th smallest value from 0, is a search in the cumulative cardinalities of
    the containers and a select within one of them.
    """

    def __init__(self, values: np.ndarray):
        high = values >> 16
        self.keys, begins = np.unique(high, return_index=True)
        self.before = np.append(begins, len(values))
        self.containers = [self._container((values[s:e] & 0xFFFF).astype(np.uint16)) for s, e in zip(self.before[:-1], self.before[1:])]

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        first = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
        if 4 * len(first) < min(2 * len(low), CHUNK // 8):
            return "run", low[first], first
        if len(low) <= ARRAY_MOST:
            return "array", low
        bits = np.zeros(CHUNK, bool)
        bits[low] = True
        words = np.packbits(bits, bitorder="little").reshape(-1, 8)
        return "bitmap", words, np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        kind, *data = self.containers[at]
        k -= int(self.before[at])
        if kind == "array":
            low = int(data[0][k])
        elif kind == "run":
            starts, before = data
            run = int(np.searchsorted(before, k, "right")) - 1
            low = int(starts[run]) + k - int(before[run])
        else:
            words, before = data
            word = int(np.searchsorted(before, k, "right")) - 1
            low = 64 * word + int(np.flatnonzero(np.unpackbits(words[word], bitorder="little"))[k - int(before[word])])
        return int(self.keys[at]) * CHUNK + low


def token_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets behind every token of a text: words with the white space before them, and white space at the end."""
    space = _SPACE[data]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(data)) if len(data) and space[-1] else ends


def cut(text: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, characters before the middle, of the middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    lead = (data & 0xC0) != 0x80
    ends = token_ends(data)
    h1, h2, h3, h4 = draws
    n = len(ends)
    if not text or h3 % 100 >= PLAIN_SHARE or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    # offsets in characters: those before the byte offset
    bounds = BoundarySet(ends if lead.all() else np.cumsum(lead)[ends - 1])
    places = [bounds.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    at = np.append(np.flatnonzero(lead), len(data))
    a, b = (int(at[p]) for p in places)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SPM_SHARE:
        return n, "spm", places[0], places[1] - places[0], s + suffix + p + prefix + m + middle
    return n, "psm", places[0], places[1] - places[0], p + prefix + s + suffix + m + middle


def _cuts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
    for batch in batches:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

        draws = [c.to_pylist() for c in batch.columns[2:]]
        for doc_id, text, *own in zip(batch.column(0).to_pylist(), batch.column(1), *draws):
            rows.append((doc_id, *cut(text.as_buffer().to_pybytes(), tuple(own))))
            held += len(rows[-1][-1])
            if held > _HELD:
                yield flush()
                rows, held = [], 0
        yield flush()


def fill_in_middle(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Moves the middle of the texts of ``docs`` (doc_id, text) to their end, behind marks.

    A text of n tokens is cut behind two numbers of tokens, both drawn from a hash of ``seed`` and
    doc_id, so that a row comes out alike in any run. Tokens are words with the white space before
    them, and white space at the end. Half of the texts, empty texts and texts with a mark inside
    stay as they are. No shuffle; each text is one row's work.

    A NULL text is empty, a NULL doc_id is drawn for like an empty id, so its rows have one draw;
    repeated rows come out alike. Other columns are not read. Returns doc_id, n, form (plain, psm,
    spm), prefix_chars, middle_chars (code points, NULL if plain), output.
    """
    ship_package(docs.sparkSession)
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", whole_text().cast("binary").alias("data"), *draws)
    out = rows.mapInArrow(_cuts, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text before it was cut; a cut text holds each mark once, since texts with marks stay plain."""
    part = "substring({0}, instr({0}, '{1}') + 3{2})"
    after = part.format(output, MIDDLE, "")
    between = lambda a, b: part.format(output, a, f", instr({output}, '{b}') - instr({output}, '{a}') - 3")
    return F.expr(
        f"case {form} when 'psm' then {between(PREFIX, SUFFIX)} || {after} || {between(SUFFIX, MIDDLE)}"
        f" when 'spm' then {between(PREFIX, MIDDLE)} || {after} || {between(SUFFIX, PREFIX)} else {output} end")


FILL_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS sha,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
draws AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || sha[1:8])::BIGINT AS h1, ('0x' || sha[9:16])::BIGINT AS h2,
         ('0x' || sha[17:24])::BIGINT AS h3, ('0x' || sha[25:32])::BIGINT AS h4 FROM tokens),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
