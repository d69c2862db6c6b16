"""The corpus operators against SQL, brute force and round trips, on the smallest tables and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
import oracle
from stallbook.llm import (
    group_join, imatch, license_scan, line_dedup, lm_deleted, lsa_decontam, packing, quality_fm, sharding, simhash_trie, suffix_dedup,
)
from stallbook.llm.induced_sort import suffix_array
from stallbook.llm.queries import CATALOGUE

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
#: nulls, empty and long texts, ties, repeated rows, repeated ids, and a clashing extra column
ROWS = [
    (1, f"head one\n{PASSAGE}\ntail", "a", "x"), (2, f"other\n{PASSAGE}\nend " * 2, "a", "x"), (3, None, None, "x"), (4, "", "b", "x"),
    (5, LONG, "b", None), (6, "a" * 400, "b", "x"), (7, "Released under the MIT License.", "a", "x"), (8, "one", "a", "x"),
    (8, "one", "a", "x"), (9, "same id", "a", "x"), (9, "same id, other text", "c", "x"), (None, "no id", "a", "x"), (10, "one", "a", "x"),
    (11, "é" * 60 + " \x1c weird space  x İ it's 12abc!!", "c", "x"),
]
SCHEMA = "doc_id long, text string, source string, version string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOGUE.oracles))
def test_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF_DIR), SF_DIR, CATALOGUE.queries[name], CATALOGUE.oracles[name]) is None


def _edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + after[:half]


def test_imatch_by_brute_force(spark, docs):
    got = {r.doc_id: r for r in CATALOGUE.queries["op2_imatch"](spark, SF_DIR).collect()}
    n = len(docs)
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    counts = Counter(w for _, t in docs for w in words(t))
    band = {w for w, c in counts.items() if imatch.LEAST_SHARE * n <= c <= imatch.MOST_SHARE * n}

    def whole(text):
        held = sorted((np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42))) for w in words(text) & band))
        return len(held)

    assert len(got) == n
    for doc_id, text, edited in _edited(docs):
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint[:8] == "--------") == (whole(text) == 0)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for doc_id, text in docs:
        assert by_text.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())


def test_imatch_edges(edge, none):
    rows = imatch.fingerprints_with_edits(edge, 0.0, 1.0).collect()
    assert len(rows) == len(ROWS) and imatch.fingerprints_with_edits(none).count() == 0
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4)} == {"-" * 8 * (1 + imatch.SUBSETS)}


def test_texts_are_encoded_together(monkeypatch):
    texts = ["Ein Wort, zwei Wörter!", "", "wort zwei cafe\u0301... \x1c x", "\u0301, <|x|>"] * 3
    assert packing.WordIds(PATH).many(texts) == [packing.WordIds(PATH)(t) for t in texts]
    calls = []
    encode = packing.WordIds(PATH)
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda missing: (calls.append(len(missing)), learn(missing)))
    # a group of texts is one request to the tokenizer
    assert [i for i, _ in packing._encoded([*range(12)], texts, encode)] == [*range(12)] and len(calls) == 1


def test_packing_round_trip(edge, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(edge, PATH, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and packing.pack(none, PATH).count() == 0
    for doc_id in (1, 3, 5, 6, 11):
        text = next(r[1] for r in ROWS if r[0] == doc_id) or ""
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == ids and all(r.length & (r.length - 1) == 0 for r in own)
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(ids) // 4 for r in own)


def test_sharding(spark, edge, none, docs):
    rows = sharding.interleave(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    shards = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(shards.values()) - min(shards.values()) <= 1
    for s in shards:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(shards[s]))
    texts = dict(docs)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert sharding.interleave(edge, 3).count() == len(ROWS) and sharding.interleave(none).count() == 0


def test_sharding_keeps_the_mixture(spark):
    many = spark.range(1200).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    rows = sharding.interleave(many, 12).collect()
    hot = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert max(hot.values()) - min(hot.values()) <= 2


def test_quality_on_held_out_labels(spark, edge, none):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in CATALOGUE.queries["op5_quality_fm"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)
    model = quality_fm.fit(edge, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    scores = quality_fm.score(edge, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores) and quality_fm.score(none, model).count() == 0


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = rng.normal(size=9)
    pairs = sum(fm.factors[i] @ fm.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    assert math.isclose(fm.raw(np.arange(9), x)[0], 0.3 + fm.weights @ x + pairs)


def test_language_model(spark, docs, edge, none):
    got = {r.doc_id: r for r in CATALOGUE.queries["op6_deleted_interpolation"](spark, SF_DIR).collect()}
    tokens = {d: [*t.encode().lower().split(), None] for d, t in docs}
    train = {d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2}
    counts = Counter(w for d in train for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, words in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert math.isclose(got[d].base_score, base, rel_tol=1e-9) and got[d].held_out == (d not in train)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    rows = lm_deleted.score(edge.selectExpr("*", "IF(doc_id = 1, NULL, true) AS train")).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 for r in rows)
    assert lm_deleted.score(none.selectExpr("*", "true AS train")).count() == 0


def _components(values, ids):
    top = list(range(len(values)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 2) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            top[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_by_brute_force(spark, docs, edge, none):
    got = {r.doc_id: r for r in CATALOGUE.queries["op7_simhash_trie"](spark, SF_DIR).collect()}

    def fingerprint(text):
        w = text.encode().lower().split()
        shingles = [b" ".join(w[i: i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    values = np.array([fingerprint(t) for _, t in docs], np.uint64)
    for (d, _), v, c in zip(docs, values, _components(values, [d for d, _ in docs])):
        assert (got[d].fingerprint, got[d].component_id) == (f"{int(v):016x}", c)
    assert simhash_trie.near_duplicates(edge).count() == len(ROWS) and simhash_trie.near_duplicates(none).count() == 0


def test_trie_join_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1, 1 << 62))
    values = {centre}
    while len(values) < 600:
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) & ((1 << 63) - 1))
    values = np.array(sorted(values), np.uint64)
    left, right = simhash_trie.trie_pairs(values, 0, 2)
    all_pairs = {(i, int(j)) for i in range(600) for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 2) + i + 1}
    assert set(zip(left.tolist(), right.tolist())) == all_pairs
    monkeypatch.setattr(simhash_trie, "PART", 16)
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "fp long, node long")
    edges = [(r.a, r.b) for r in simhash_trie.links(rows).collect()]
    top = {i: i for i in range(600)}
    for _ in range(600):
        changed = False
        for a, b in edges:
            m = min(top[a], top[b])
            changed |= top[a] != m or top[b] != m
            top[a] = top[b] = m
        if not changed:
            break
    assert [top[i] for i in range(600)] == _components(values, list(range(600)))


def test_decontamination_finds_contained_items(spark, docs, edge, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    held = {(d, i) for d, t in docs for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in CATALOGUE.queries["op8_lsa_decontamination"](spark, SF_DIR).collect()}
    assert held <= got and len(got) <= len(held) + 2
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lsa_decontam.contaminated(edge, bench).collect()} == {(1, 1), (2, 1)}
    assert lsa_decontam.contaminated(none, bench).count() == 0 and lsa_decontam.contaminated(edge, bench.limit(0)).count() == 0


def test_decontamination_finds_paraphrases(spark, docs):
    """Every seventh word replaced by one of another document, in the midst of a third document."""
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect() if len(r.text.split()) >= 25][:10]
    texts = [t.split() for _, t in docs if len(t.split()) > 200]
    made = []
    for n, (item_id, words) in enumerate(items):
        other, around = texts[n], texts[n + 20]
        changed = [other[50 + i] if i % 7 == 3 else w for i, w in enumerate(words)]
        made.append((10_000 + n, " ".join([*around[:80], *changed, *around[80:160]])))
    more = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in lsa_decontam.contaminated(more, bench).collect()}
    assert sum((d, i) in got for (d, _), (i, _) in zip(made, items)) >= 0.9 * len(items)


@pytest.mark.parametrize("seed", range(6))
def test_induced_sorting(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 2 + 60 * (seed % 2), 1500).astype(np.uint8)
    data = np.concatenate([data, data[200:700], np.full(90, 7, np.uint8), data[:300]])
    raw = data.tobytes()
    assert suffix_array(data).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def _stripped(docs):
    seen = set()
    for doc_id, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s: s + 100]
            if window in seen:
                gone[s: s + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield doc_id, len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()


def test_suffix_dedup_by_brute_force(spark, docs, edge, none):
    assert sorted(map(tuple, CATALOGUE.queries["op9_suffix_dedup"](spark, SF_DIR).collect())) == list(_stripped(docs))
    unique = [r for r in ROWS if r[0] in (1, 2, 3, 4, 5, 6, 7, 11)]
    got = {r.doc_id: tuple(r) for r in suffix_dedup.dedup_strings(edge).collect()}
    assert [got[r[0]] for r in unique] == list(_stripped([(r[0], r[1] or "") for r in unique]))
    assert suffix_dedup.dedup_strings(edge).count() == len(ROWS) and suffix_dedup.dedup_strings(none).count() == 0


def test_lines_and_licences_at_the_edges(edge, none):
    rows = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(edge).collect()}
    assert sum(r.n_removed for r in rows.values()) >= 1 and rows[3, None].n_removed == 0 and "version" in line_dedup.dedup_lines(edge).columns
    assert PASSAGE in next(r for r in rows.values() if r.doc_id == 1).text
    assert line_dedup.dedup_lines(none).count() == 0
    found = {r.doc_id: r.licenses for r in license_scan.license_scan(edge).collect()}
    assert found[7] == "MIT" and found[3] == "" and license_scan.license_scan(none).count() == 0


def test_pipeline_stages_follow_their_operators(spark):
    docs = corpus_pipeline.read(spark, SF_DIR, "documents")
    for (name, stage), nxt in zip(corpus_pipeline.STAGES[:-1], corpus_pipeline.STAGES[1:]):
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == corpus_pipeline.DOCUMENT
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= docs.count(), name
        docs = kept
    last = {r.doc_id for r in corpus_pipeline.packed(spark, docs, SF_DIR).collect()}
    assert last == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().collect()} == last


def _word_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def _first_of_near_copies(rows):
    """doc_ids that stay when all pairs of a five-word Jaccard similarity of 0.8 are linked."""
    sets = [_word_shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def _near_copies(rng):
    """A large group of near copies, chains of edits, an unlike group with one passage, and texts of a few words."""
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    base, passage, texts = words(300), words(40), []
    for _ in range(80):
        own = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 9)):
            own[at] = f"e{rng.integers(0, 10**9)}"
        texts.append(own)
    for _ in range(8):
        own = words(60)
        for _ in range(4):
            own = list(own)
            own[rng.integers(0, 60)] = f"e{rng.integers(0, 10**9)}"
            texts.append(own)
    texts += [passage + words(20) for _ in range(40)] + [words(120) for _ in range(20)] + [["a"], ["a"], ["a", "b"], [], []]
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[k])) for i, k in enumerate(order)]


def test_pipeline_near_dedup_by_brute_force(spark):
    docs = corpus_pipeline.read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, docs, SF_DIR).collect()]
    assert sorted(got) == sorted(_first_of_near_copies(rows))


@pytest.mark.parametrize("limit, rounds", [(128, 8), (4, 8), (4, 0)])
def test_shingle_join_by_brute_force(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(group_join, "LIMIT", limit)
    monkeypatch.setattr(group_join, "ROUNDS", rounds)
    rows = _near_copies(np.random.default_rng(7))
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, docs, SF_DIR).collect()]
    assert sorted(got) == sorted(_first_of_near_copies(rows))
    assert corpus_pipeline.one_of_near_duplicates(spark, docs.limit(0), SF_DIR).count() == 0


def test_pipeline_rows_without_or_with_repeated_ids(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    other = lambda k: " ".join(f"{k}{i}" for i in range(80))
    rows = [(None, f"{other('a')} {item} {other('b')}"), (1, other("c")), (1, f"{other('d')} {item} {other('e')}"), (None, other("f")),
            (2, other("g")), (2, other("g")), (2, other("h")), (3, other("h")), (None, other("g")), (None, other("f"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.without_benchmark(spark, docs, SF_DIR).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter(r for r in rows if item not in r[1])
    left = corpus_pipeline.one_of_near_duplicates(spark, docs, SF_DIR).collect()
    wanted = [rows[i] for i in (0, 1, 2, 3, 4, 6)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, wanted))


def test_every_licence_sentence_and_rule_fires(spark):
    sentences = license_scan.SENTENCES | license_scan.MORE_SENTENCES
    rules = [*license_scan.RULES, *license_scan.MORE_RULES]
    single = [(name, text, f"{text}{end}") for name, texts in sentences.items() for text in texts for end in ("", "\n\nUnlike words.", "\nnext line\n")]
    wrapped = [(name, text, "// Copyright\n// " + text.replace(" it ", " it\n// ")) for name, texts in sentences.items() for text in texts if ": " in text]
    cases = single + wrapped
    whole = [(name, ids, "\n\n".join(sentences[i][0] for i in ids)) for name, ids in rules]
    texts = [c[2] for c in cases] + [w[2] for w in whole] + ["SPDX-License-Identifier: Foo-1\nMIT", "SPDX-License-Identifier. Then. MIT."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(license_scan.license_scan(rows).collect())
    for (name, text, _), r in zip(cases, got):
        assert r.sentence_ids == name, (text, r)
    for (name, ids, _), r in zip(whole, got[len(cases):]):
        assert (r.licenses, r.n_unread, r.sentence_ids) == (name, 0, ",".join(ids)), (ids, r)
    assert [(r.licenses, r.n_unknown > 0) for r in got[-2:]] == [("", True)] * 2


def test_imatch_with_large_groups_of_copies(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rest = [f"rest{i % 20}x rest{i} own{i}" for i in range(120)]
    texts = [words("a", 30)] * 60 + [words("b", 30)] * 60 + rest
    for rows in (texts, [words("a", 30), words("b", 30), "B0 " + words("b", 30), "", None, "?!"]):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = {r.doc_id: r for r in imatch.fingerprints_with_edits(docs).collect()}
        terms = [frozenset((t or "").replace("?!", "").lower().split()) for t in rows]
        for i, a in enumerate(terms):
            for j, b in enumerate(terms[:i]):
                assert (got[i].fingerprint == got[j].fingerprint) == (a == b)
        assert all((got[i + 1].near_next == 1) == (a == b) for i, (a, b) in enumerate(zip(terms, terms[1:])))
    assert got[0].fingerprint[:8] == "-" * 8 != got[0].fingerprint[8:16]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert imatch.lexicon(docs).count() == 60 + len({w for t in rest for w in t.split() if not w.endswith("x")})


def test_a_kept_text_is_scored_from_its_own_column(spark):
    """The text goes to the workers once; a NULL text is kept as NULL and scored as the empty text."""
    fm = quality_fm.train([(*f, i % 2) for i, f in enumerate(quality_fm.features([b"gut und lang", b"x x x x", b""]))])
    docs = spark.createDataFrame([(1, "de", "gut und lang"), (2, None, None), (3, "en", "")], "doc_id long, lang string, text string")
    kept = quality_fm.score(docs, fm, kept=("doc_id", "text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "score", "predicted"] and "_text" not in kept._jdf.queryExecution().toString()
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[2].score == rows[3].score
    assert {r.doc_id: r.score for r in quality_fm.score(docs, fm).collect()} == {k: r.score for k, r in rows.items()}


def test_texts_are_held_by_bytes():
    texts = ["a" * (quality_fm.BATCH_BYTES * 2), None, "b", "c" * quality_fm.BATCH_BYTES, "d"]
    parts = list(quality_fm._texts(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 0))
    assert [(at, [len(t) for t in held]) for at, held in parts] == [(0, [len(texts[0])]), (1, [0, 1]), (3, [len(texts[3])]), (4, [1])]
