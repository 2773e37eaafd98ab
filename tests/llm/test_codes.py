import math
import random
from hashlib import sha256

import numpy as np
import pytest

from weighbridge.llm import op13_codes


def brute(rows):
    """(vec_id, code, error, label_error) of all rows, and the codebooks' digest."""
    rows = [(i, v, w) for i, v, w in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not rows:
        return [], None
    wide = max({len(v) for _, v, _ in rows}, key=lambda n: (sum(len(v) == n for _, v, _ in rows), n))
    rows = sorted(((i, v, w) for i, v, w in rows if len(v) == wide), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(256 * c) if abs(c) < 2**52 else int(c) * 256 for c in v] for _, v, _ in rows]
    cuts = [(p * wide // 16, (p + 1) * wide // 16) for p in range(16)]
    books = [[v[a:z] for v in x[:64]] for a, z in cuts]

    def assigned():
        return [[min((sum((q - e) ** 2 for q, e in zip(v[a:z], entry, strict=True)), n) for n, entry in enumerate(book)) for book, (a, z) in zip(books, cuts, strict=True)] for v in x]

    for _ in range(2):
        told = assigned()
        for p, (a, z) in enumerate(cuts):
            for n in range(len(books[p])):
                own = [v[a:z] for v, t in zip(x, told, strict=True) if t[p][1] == n]
                if own:
                    books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    told = assigned()
    errors = [sum(d for d, _ in t) for t in told]
    by = {}
    for (_, _, w), e in zip(rows, errors, strict=True):
        by[w] = by.get(w, 0) + e
    most = (1 << 63) - 1
    out = [(i, "".join(f"{n:02x}" for _, n in t), min(most, e), min(most, by[w])) for (i, _, w), t, e in zip(rows, told, errors, strict=True)]
    return sorted(out, key=str), sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def run(spark, rows, kind="array<double>"):
    table = spark.createDataFrame([(i, v, w, 1, 2) for i, v, w in rows], f"vec_id long, embedding {kind}, label int, code int, error int").repartition(3)
    coded, books = op13_codes.compress(table)
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in coded.collect()), key=str), op13_codes.digest(books)


def given(n, wide, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(wide)], r.choice([None, 1, 1, 2])) for i in range(n)]
    return rows + [rows[3], (3, rows[7][1], 5), (None, rows[9][1], 1)] + [(n + i, rows[5][1], 1) for i in range(40)] + [(n + 50, None, 1), (n + 51, [0.0] * wide, 9), (n + 52, [float("nan")] * wide, 1), (n + 53, [1.0] * (wide - 1) + [None], 1), (n + 54, [float("inf")] + [1.0] * (wide - 1), 1), (n + 55, [], 1), (n + 56, [1.0], 1)]


@pytest.mark.parametrize(("n", "wide"), [(300, 32), (20, 64), (150, 21), (90, 7)])
def test_against_brute_force(spark, n, wide):
    rows = given(n, wide)
    assert run(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    r = random.Random(4)
    rows = given(80, 16) + [(1000 + i, [r.choice([1.0, 1e3, 3e6, -2e7]) * r.random() for _ in range(16)], 3) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    got = run(spark, [(0, [0.0] * 16, 1), (1, [1e300] * 16, 1), (2, [-1e300] * 16, 2)])[0]
    assert [g[2] for g in got] == [0, 0, 0]  # each is its own entry


def test_errors_beyond_64_bits(spark):
    rows = [(i, [float(i)] * 16, 1) for i in range(64)] + [(100, [1e15] * 16, 1), (101, [-1e15] * 16, 1)]
    assert run(spark, rows) == brute(rows)


def test_bounds_keep_the_nearest():
    r = np.random.default_rng(3)
    for _ in range(20):
        entries = r.integers(-90, 90, (64, 4)).tolist()
        x = r.integers(-120, 120, (200, 4))
        cells = op13_codes.Cells(entries, 4)
        far = ((x[:, None] - np.array(entries)[None]) ** 2).sum(axis=2)
        at, least = cells.nearest(x)
        assert (at == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
        assert len(cells.candidates(x)[0]) < 0.35 * far.size  # the filter rules most out


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op13_codes.common, "BROADCAST_BYTES", 0)
    rows = given(100, 16)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [])[0] == [] == run(spark, [(1, None, 1)])[0]
