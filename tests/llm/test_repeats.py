import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import op4_repeats


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = op4_repeats.LENGTH
    seen = {}
    for b in raw:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_cover():
    got = {(a - b) % op4_repeats.PERIOD for a in op4_repeats.COVER for b in op4_repeats.COVER}
    assert got == set(range(op4_repeats.PERIOD)) and op4_repeats.LENGTH > op4_repeats.PERIOD


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages = [word(n) for n in (398, 399, 400, 401, 450, 700, 1500)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "c" * 399, "xy" * 900]
    for k in range(40):
        parts = [word(r.randrange(0, 500))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, 60)
            parts += [p[a:] if r.random() < 0.5 else p, word(r.randrange(0, 90))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-1], texts[-2] + "z", "q" + texts[-3], texts[10][: len(texts[10]) // 2] + texts[11]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in op4_repeats.query(spark, str(tmp_path)).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    assert {i: got[i] for i in got if got[i] != want[i]} == {}
    assert sum(w[1] for w in want) > 10000


def test_small_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    base = "".join(r.choice("abcd ") for _ in range(3000))
    texts = [base[r.randrange(0, 1500) :][: r.randrange(0, 1400)] for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in op4_repeats.query(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_repeats.query(spark, str(tmp_path)).count() == 0


def test_passages_against_brute_force(spark, monkeypatch):
    """Stretches of 51 words or more that another document has too, over several blocks and within one."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 6)))
    shared = [[word() for _ in range(n)] for n in (25, 40, 50, 51, 52, 60, 90)]
    docs = []
    for _ in range(60):
        out = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            out += r.choice(shared) + [word() for _ in range(r.randint(0, 9))]
        docs.append(r.choice([" ", "\n", "  "]).join(out))
    docs += ["the " * 60, "the " * 55, "own " * 300, "", None]
    raw = [(d or "").split() for d in docs]
    where = {}
    for n, w in enumerate(raw):
        for i in range(len(w) - 50):
            where.setdefault(tuple(w[i : i + 51]), set()).add(n)
    want = []
    for w in raw:
        hit = [len(where[tuple(w[i : i + 51])]) > 1 for i in range(len(w) - 50)]
        want.append(sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)))
    for parts in (1, 9):
        table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(parts)
        got = {x.doc_id: x.n_passages for x in op4_repeats.remove_repeats(table).collect()}
        assert got == dict(enumerate(want))
    assert 20 < sum(1 for x in want if x) < 60


def test_strings_made_to_collide(spark):
    """Thue-Morse strings have equal polynomial hashes modulo a power of two, whatever the base and the letters are."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    h = op4_repeats.HASHER
    x, y = (h.windows(h.sums(np.frombuffer(t.encode(), np.uint8)), np.array([0]), 4096) for t in (a, b))
    assert x[0][0] != y[0][0] and x[1][0] != y[1][0]


def test_odd_ids_and_columns(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(900))
    rows = [(None, long, 1), (None, long + "x", 2), (3, long[100:700], 3), (3, None, 4), (3, "", 5), (4, long[:399], 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, block int")
    docs = docs.select("*", F.lit(1).alias("n_bytes"), F.lit("x").alias("kept"))
    got = sorted(((x.doc_id is None, x.doc_id, x.n_bytes, x.n_removed) for x in op4_repeats.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(True, None, 900, 900), (True, None, 901, 900), (False, 3, 600, 600), (False, 3, 0, 0), (False, 3, 0, 0), (False, 4, 399, 0)], key=str)
    assert op4_repeats.remove_repeats(docs.select(F.col("doc_id").alias("a key"), "text"), "a key").columns[0] == "a key"


def test_changed_input_is_an_error():
    x = op4_repeats.Asked((np.arange(9, dtype=np.uint64), np.arange(9, dtype=np.uint64)), 2, True)
    answers = {k: (op4_repeats.digest(*names), bytes(9)) for k, *names in x.parts()}
    assert not x.told(answers)[0].any()
    y = op4_repeats.Asked((np.arange(1, 10, dtype=np.uint64), np.arange(9, dtype=np.uint64)), 2, True)
    with pytest.raises(RuntimeError):
        y.told(answers)
