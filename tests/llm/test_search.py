import math
import random
import re
from collections import Counter

from weighbridge.llm import op12_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FIELDS = ("item_id", "rank", "doc_id", "score")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for f in found if f[2]), sum(f[2] for f in found)
    df = Counter(t for f in found for t in f[1])
    asked = {}
    for i, t in {x for x in items if x[1] is not None}:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, tf, size in found:
            if size:
                m = 100 - 25 + (25 * size * n) // total
                s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, k in own.items() if tf[t])
                if s > 0:
                    scores.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:20])]
    return sorted(out, key=str)


def given(n=300, seed=1, ids=None):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(60)] + ["Éa", "éa", "中文", "a_b", "X", "x"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    ids = ids or list(range(n))
    docs = [(i, r.choice([text(3), text(40), text(40), ""])) for i in ids] + [(5, None), (None, text(30)), (None, text(3)), (7, text(9)), (7, "w1 w1"), (-3, "\x00x\x00"), (10**12, text(3000))]
    items = [(i, text(20)) for i in range(7)] + [(3, text(5)), (4, None), (None, text(4)), (11, "nowhere"), (12, ""), (13, "x " * 300)]
    return docs, items + items[:2]


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 1, "c") for i, t in docs], "doc_id long, text string, n long, window int, terms string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r[c] for c in FIELDS) for r in op12_search.search(d, b, **more).collect()), key=str)


def test_against_brute_force(spark):
    docs, items = given()
    assert run(spark, docs, items) == brute(docs, items)


def test_small_windows_parts_and_batches(spark, monkeypatch):
    """Ids that repeat and ids that lie far apart; an item batch a few items, a window a few documents."""
    monkeypatch.setattr(op12_search, "WINDOW", 8)
    monkeypatch.setattr(op12_search, "ITEMS_BYTES", 200)
    r = random.Random(2)
    docs, items = given(ids=[r.choice([9, 9, r.randrange(400), r.randrange(10**15)]) for _ in range(250)])
    assert run(spark, docs, items) == brute(docs, items)


def test_ties_and_copies(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(200, "other")]
    assert [x[2] for x in sorted(run(spark, docs, [(1, "same words")]), key=lambda x: x[1])] == list(range(1, 21))


def test_terms_of_bytes():
    texts = ["A b\x00C", "", "Éx—y 1_2", "z"]
    where, found = op12_search.terms_of([t.encode() for t in texts])
    assert [(n, t.decode()) for n, t in zip(where.tolist(), found.to_pylist(), strict=True)] == [(n, w) for n, t in enumerate(texts) for w in terms(t)]
    assert len(op12_search.terms_of([])[0]) == 0


def test_empty(spark):
    assert run(spark, [(1, None)], [(1, "a")]) == [] == run(spark, [(1, "a")], [])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op12_search.search(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
