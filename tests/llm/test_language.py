import math
import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from weighbridge.llm import op10_language as lang

PATH = P.path("piece_bpe_32k.model")


PIECES = ["▁a", "▁", "a", "b", "ab", "▁ab", "ba"]


def made(seed=0):
    m = lang.Model(PIECES, ["x", "y"])
    m.logs = np.log(np.random.default_rng(seed).random(m.logs.shape))
    return m


def ways(m, word):
    """All segmentations of a word, each the list of its pieces' numbers."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES or n == 1:
            i = PIECES.index(word[:n]) if word[:n] in PIECES else len(PIECES)
            out += [[i, *rest] for rest in ways(m, word[n:])]
    return out


def test_forward_sums_all_segmentations():
    m = made()
    words = ["a", "ab", "abab", "abc", "bbab", "a\x00b", "cabbacababab"]
    for w, row in zip(words, m.score(words), strict=True):
        want = np.log(sum(np.exp(sum(m.logs[i] for i in way)) for way in ways(m, "▁" + w)))
        assert np.allclose(row, want)
    assert m.score([]).shape == (0, 2)


def test_long_words_lose_nothing():
    m = made(1)
    word = "".join(random.Random(3).choice("abcé") for _ in range(500))
    text, best = "▁" + word, [np.zeros(2)]
    for end in range(1, len(text) + 1):  # the recursion itself, one place at a time
        arcs = []
        for start in range(max(0, end - 3), end):
            if text[start:end] in PIECES or start == end - 1:
                i = PIECES.index(text[start:end]) if text[start:end] in PIECES else len(PIECES)
                arcs.append(best[start] + m.logs[i])
        best.append(np.logaddexp.reduce(arcs))
    got = m.score(["ab", word, word * 40])
    assert np.allclose(got[1], best[-1]) and np.isfinite(got).all() and got[2].max() < -745


def test_learning_is_the_expected_count():
    m = made(2)
    counts = {w: np.array([n, 2.0]) for n, w in enumerate(["abab", "bac", "aab", "b"], 1)}
    want = np.full_like(m.logs, lang.ADDED)
    for w, n in counts.items():
        every = ways(m, "▁" + w)
        p = np.array([np.exp(sum(m.logs[i] for i in way)) for way in every])
        for way, share in zip(every, p / p.sum(axis=0), strict=True):
            for i in way:
                want[i] += n * share
    m.learn(counts, epochs=1)
    assert np.allclose(np.exp(m.logs), want / want.sum(axis=0))


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    r = random.Random(2)
    said = {"en": "the of and that with tion ing er".split(), "de": "der und ich nicht ung keit sch ein".split(), "fr": "le les et que dans eau ment oi".split()}
    rows = []
    for i in range(400):
        k = r.choice(list(said))
        rows.append((i, " ".join("".join(r.choice(said[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 40))), k))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", None), (1003, "the and of that", None), (None, "der und nicht", "de"), (1004, "the " * 50000, "en"), (1005, "x" * 40000, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in lang.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    import zlib

    for i, _, k in rows[:400]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    held = [(i, k) for i, _, k in rows[:400] if got[i].held_out]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "en", "de", "en"]
    assert not math.isnan(got[1005].score)


def test_texts_without_blanks_and_many_scripts(spark):
    """Words of many hundred characters decide, and null ids do not make the sample larger."""
    r = random.Random(5)
    said = {"ja": "かなのはをがです", "ru": "ивонатерскл", "zh": "的一是不了人我在"}
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, "".join(r.choice(said[k]) for _ in range(r.randint(100, 700))), k) for i in range(300) for k in [r.choice(list(said))]], "doc_id long, text string, lang string")
    model = lang.train(docs, PATH, sample=20)
    test = spark.createDataFrame([(n, k, "".join(r.choice(said[k]) for _ in range(900))) for n, k in enumerate(list(said) * 5)], "doc_id long, k string, text string")
    got = lang.predict(test, model).join(test.select("doc_id", "k"), "doc_id").collect()
    assert len(got) == 15 and all(x.lang_pred == x.k for x in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang.predict(docs, lang.train(docs, PATH)).collect()[0].lang_pred == "und"
    none = docs.where("doc_id > 1")
    assert lang.predict(none, lang.train(none, PATH)).count() == 0
