import random

import numpy as np
import pytest

from weighbridge.llm import op3_neardup as nd


def brute(texts, width=4, per_cent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= per_cent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def family(r, words, copies, edits):
    base = [r.choice(words) for _ in range(150)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(r.randrange(0, edits)):
            own[r.randrange(len(own))] = r.choice(words)
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = [None, "", "  \n", "one", "one", "One two", "one two three", "a b c d", "A b\tc d"]
    out += family(r, words, 160, 12) + family(r, words, 60, 30)
    out += [passage + " " + " ".join(r.choice(words) for _ in range(r.randrange(20, 60))) for _ in range(120)]
    out += [out[12]] * 25
    return out


@pytest.mark.parametrize("group", [20_000, 50])
def test_against_brute_force(spark, tmp_path, texts, monkeypatch, group):
    monkeypatch.setattr(nd, "GROUP", group)
    monkeypatch.setattr(nd, "CHUNK", 64)
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, n int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in nd.query(spark, str(tmp_path)).collect()}
    want = dict(enumerate(brute(texts)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_repeated_ids_and_nulls(spark, tmp_path):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (None, None), (7, "q r s t u"), (7, "z y x w v")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in nd.query(spark, str(tmp_path)).collect())
    assert got == sorted([("1", 2, "1"), ("1", 2, "1"), ("None", 2, "1"), ("2", 0, "2"), ("None", 0, "None"), ("7", 2, "7"), ("7", 2, "7")])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert nd.query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("size", [50, 200, 500, 1000, 3000, 20000])
def test_signatures_tell_sets_of_any_size_apart(size):
    """Disjoint sets go after a batch; sets at or over the threshold stay, and few below it do."""
    r = np.random.default_rng(size)
    least = nd.least_matches(0.8)
    draw = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    packed = lambda found: nd.sig_bytes(nd.signature(found)).tobytes()
    a, b = [draw(size) for _ in range(20)], [draw(size) for _ in range(20)]
    x, y = [packed(z) for z in a], [packed(z) for z in b]
    equal = np.mean([np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)) for p, q in zip(x, y, strict=True)])
    assert equal < 0.02 and not nd.survivors(x, y, least).any()
    for similar, kept in ((0.8, 20), (0.85, 20), (0.4, 0)):
        both = round(size * 2 * similar / (1 + similar))
        near = [np.concatenate([z[:both], draw(size - both)]) for z in a]
        assert nd.survivors(x, [packed(z) for z in near], least).sum() == kept


def test_words_made_to_collide():
    """Thue-Morse words of two letters have equal polynomial hashes modulo a power of two."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    one, two = nd.shingle_sets([a, a.translate(str.maketrans("ab", "ba"))], 4)
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_pivots_that_are_not_broadcast(spark, monkeypatch):
    """Rows of a pivot are spread where there are too many pivots to send around; a long text is a text like any other."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(6) for t in family(r, words, 12, 14)] + [" ".join(r.choice(words) for _ in range(40000))] * 2
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node long")
    monkeypatch.setattr(nd.common, "small", lambda df, row_bytes: df)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in nd.near_duplicates(docs, width=4).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_many_texts_of_one_id(spark, monkeypatch):
    """Null ids and an id that repeats, each with many texts, among them near copies: every text is hashed once."""
    r = random.Random(12)
    words = ["w%d" % i for i in range(3000)]
    near = family(r, words, 30, 6)
    rows = [(None, " ".join(r.choice(words) for _ in range(40))) for _ in range(600)] + [(5, " ".join(r.choice(words) for _ in range(40))) for _ in range(300)]
    rows += [(None if i % 3 else 5, t) for i, t in enumerate(near[:20])] + [(100 + i, t) for i, t in enumerate(near[20:])] + [(7, rows[3][1]), (8, rows[700][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {}
    for (i, _), (n, top, _) in zip(rows, brute([t for _, t in rows]), strict=True):
        want.setdefault(top, []).append((i, n))
    small = {top: min((i for i, _ in own if i is not None), default=None) for top, own in want.items()}
    expected = sorted(((i, n, small[top]) for top, own in want.items() for i, n in own), key=str)
    for most in (nd.common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(nd.common, "BROADCAST_BYTES", most)
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in nd.near_duplicates(docs, width=4).collect()), key=str)
        assert got == expected


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("c", "other")], "doc_id string, text string")
    got = {x.doc_id: (x.component_id, x.kept) for x in nd.near_duplicates(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), None: ("a", False), "c": ("c", True)}
