"""Grouped prefix join, fill-in-the-middle and the conversation trie against brute force, and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from stallbook.llm import conversation_trie, fill_middle, group_join
from stallbook.llm.queries import CATALOGUE

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
#: nulls, empty and long texts, marks, repeated rows and ids, and columns with clashing names
ROWS = [
    (1, "one two three four five six seven eight nine ten", "x"), (2, "ONE two three four five six seven eight nine ten", "x"), (3, None, None),
    (4, "", "x"), (5, LONG, "x"), (6, LONG + " tail", "x"), (7, "a", "x"), (7, "a", "x"), (8, "a b", "x"), (None, "a b", "x"), (None, None, "x"),
    (9, " \t\n", "x"), (10, "text with <P> inside", "x"), (11, "é ü \x1cß  x ", "x"), (12, "a" * 70_000 + " b", "x"),
]
SCHEMA = "doc_id long, text string, n string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("node", "row", "key", "h1", "_id", "data", "output")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_conversation_trie"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert oracle.compare(spark, oracle.connect(sf_dir), sf_dir, CATALOGUE.queries[name], CATALOGUE.oracles[name]) is None


# --- grouped prefix join -----------------------------------------------------------------------------


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def components(rows, size, share):
    """(set size, smallest doc_id) of every row by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset())
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s])
        for j, o in shared.items():
            if share[1] * o >= share[0] * (len(own) + len(sets[j]) - o):
                top[find(i)] = find(j)
        for s in own:
            holders[s].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def joined(docs, size, share):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in group_join.jaccard_join(docs, size, share).collect())


def test_join_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = Counter((d, *c) for (d, _), c in zip(rows, components(rows, 4, (85, 100))))
    got = CATALOGUE.queries["op11_group_join"](spark, "/root/testdata/sf0.01")
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == want


def near_copies(seed):
    """A large group of near copies with edits that others make too, chains of edits, and unlike texts with one passage."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    base, passage, texts = words(120), words(30), []
    for _ in range(150):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            own[at] = f"e{rng.integers(0, 9 if rng.random() < 0.5 else 10**9)}"
        texts.append(own)
    for _ in range(10):
        own = words(50)
        for _ in range(5):
            own = list(own)
            own[rng.integers(0, 50)] = f"e{rng.integers(0, 10**9)}"
            texts.append(own)
    texts += [passage + words(int(rng.integers(1, 30))) for _ in range(60)] + [["a"], ["A"], ["a", "b"], []]
    return [(int(i), " ".join(texts[k])) for i, k in enumerate(rng.permutation(len(texts)))]


@pytest.mark.parametrize("limit, rounds", [(512, 8), (8, 8), (2, 3), (2, 0)])
def test_large_buckets_lose_no_link(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(group_join, "LIMIT", limit)
    monkeypatch.setattr(group_join, "ROUNDS", rounds)
    rows = near_copies(limit + rounds)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, 4, (85, 100)) == Counter((d, *c) for (d, _), c in zip(rows, components(rows, 4, (85, 100))))


def test_near_copies_of_one_text_are_not_paired(spark, monkeypatch):
    compared = []
    compare = group_join._compared

    def counted(pairs, classes, extra):
        compared.append(pairs.count())
        return compare(pairs, classes, extra)

    monkeypatch.setattr(group_join, "_compared", counted)
    rng = np.random.default_rng(3)
    base, texts = [f"w{x}" for x in rng.integers(0, 50_000, 200)], []
    for i in range(80):
        own = list(base)
        own[rng.integers(0, 200)] = f"e{i % 40}"
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[2] for r in joined(docs, 4, (85, 100))} == {0}
    # all pairs would be some 3000
    assert sum(compared) < 4 * len(rows)


def test_join_at_the_edges(edge, none):
    got = joined(edge, 4, (85, 100))
    assert got == Counter({
        (1, 7, 1): 1, (2, 7, 1): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 997, 5): 1, (6, 998, 5): 1, (7, 1, 7): 2, (8, 1, 8): 1, (None, 1, 8): 1,
        (None, 0, None): 1, (9, 0, 9): 1, (10, 1, 10): 1, (11, 1, 11): 1, (12, 1, 12): 1})
    assert group_join.jaccard_join(none).count() == 0


def test_shingles_do_not_depend_on_how_texts_are_held():
    text = b"a b c d e f g h " * 40_000 + b"z"
    alone, among = next(group_join.shingles([text], 4)), list(group_join.shingles([b"a b c d e", text, b"", b"x y"], 4))
    assert (among[1] == alone).all() and len(alone) == 9 and len(among[0]) == 2 and len(among[2]) == 0 and len(among[3]) == 1


# --- fill in the middle -----------------------------------------------------------------------------


@pytest.mark.parametrize("kind, values", [
    ("run", np.arange(1, 50_000)), ("array", np.arange(0, 60_000, 17)), ("bitmap", np.flatnonzero(np.random.default_rng(1).random(65_536) < 0.4)),
])
def test_containers(kind, values):
    for shift in (0, 3 << 16):
        bounds = fill_middle.BoundarySet(values + shift)
        assert {c[0] for c in bounds.containers} == {kind} and len(bounds) == len(values)
        assert [bounds.select(k) for k in range(0, len(values), 7)] == (values + shift)[::7].tolist()
    mixed = np.concatenate([values, np.arange(65_536, 70_000), np.arange(200_000, 400_000, 3)])
    bounds = fill_middle.BoundarySet(mixed)
    assert len({c[0] for c in bounds.containers}) >= 2 and [bounds.select(k) for k in range(0, len(mixed), 101)] == mixed[::101].tolist()


def test_fill_middle_by_brute_force(edge, none):
    token = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    rows = [tuple(r) for r in fill_middle.fill_in_middle(edge).withColumn("back", fill_middle.restored()).collect()]
    assert len(rows) == len(ROWS) and fill_middle.fill_in_middle(none).count() == 0
    for (doc_id, text, _), (got_id, n, form, before, middle, output, back) in zip(ROWS, rows):
        text = text or ""
        parts = token.findall(text)
        sha = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(sha[8 * i: 8 * i + 8], 16) for i in range(4)]
        assert (got_id, n, back) == (doc_id, len(parts), text)
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            assert (form, before, middle, output) == ("plain", None, None, text)
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
        want = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
        assert (form, output, before, middle) == (*want, len(p), len(m))
    assert {r[2] for r in rows} >= {"plain", "spm"}


# --- conversation trie ------------------------------------------------------------------------------


def trie(rows):
    """The contract, node by node, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * words
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


CONVERSATION = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice(["hi", "no", "yes sir"], rng.integers(0, 3)))
    rows = [(c, t, "user" if t % 2 else None, text()) for c in range(0, 300, 3) for t in range(rng.integers(1, 7))]
    rows += [(c, t, "user", "the same") for c in range(1000, 1100) for t in range(4)]  # a large group of copies
    rows += [(2000, t, "user", f"turn {t}") for t in range(40)] + [(2001, t, "user", f"turn {t}") for t in range(38)] + [(2001, 38, "a", "other")]
    rows += [(3001, None, None, None), (3001, None, None, "x"), (3001, 5, "user", "y"), (3001, 5, "user", "y"), (None, 1, "user", "lost"), (4007, 1, "u", "one turn")]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("segment, turns", [(512, 200_000), (16, 50), (3, 7), (1, 1)])
def test_trie_by_brute_force(spark, segment, turns):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, CONVERSATION).withColumns({c: F.lit("x") for c in ("pos", "first", "seg", "words", "_bucket")})
    got = conversation_trie.prefix_trie(frame, segment=segment, tree_turns=turns)
    assert Counter(map(tuple, got.collect())) == trie(rows)


def test_trie_without_conversations(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], CONVERSATION)).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATION)).count() == 0


def test_medians_visit_all_once():
    assert sorted(conversation_trie.medians(37)) == list(range(37)) and next(conversation_trie.medians(37)) == 18
