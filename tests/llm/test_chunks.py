import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from weighbridge.llm import op11_chunks

PATH = P.path("byte_bpe_50k.json")


def texts() -> list:
    r = random.Random(5)
    words = ["the", "weighs", "l'été", "don't", "x1y2", "中文字符", "(see)", "…", "naïve", "we'll", "\U0001f600", "12345", "Ünïcode", "՘", "é"]
    prose = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", "\n", " \n\n ", ", ", "", "\t", "　"]) for _ in range(n))
    shared = [prose(600) for _ in range(4)]
    out = [None, "", " ", "a", "<|endoftext|>", "a  <|endoftext|>\n\n b<|endoftext|><|endoftext|>'s <|endoftext", "same", "same", "\x1c\x85 \t\n", " " * 9000, "a" * 20_000, "中" * 9000, "\n" * 5000 + "x"]
    for n in range(60):  # passages that documents share, at many offsets
        out.append("".join(prose(r.randrange(0, 80)) + r.choice(["", "<|endoftext|>", "'"]) + r.choice(shared)[r.randrange(0, 900) :] for _ in range(r.randrange(1, 5))))
    out += out[-40:] + [shared[0] * 12]
    return out


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_round_trip(spark, library):
    given = texts()
    docs = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in enumerate(given)], "doc_id long, text string, block string, n int, ids binary").repartition(5)
    told = op11_chunks.encode(docs, PATH)
    assert told.columns == ["doc_id", "n_tokens", "ids"]
    got = {r.doc_id: r for r in op11_chunks.decode(told, PATH).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False) == (t or "")


def test_any_shared_chunks_give_the_same_ids(library):
    """Whichever chunks come from elsewhere, the joins are repaired."""
    v = op11_chunks.Vocabulary(open(PATH, encoding="utf-8").read())
    r = random.Random(6)
    for whole in (texts()[14:34], texts()[8:14]):
        raw = [(t or "").encode() for t in whole]
        text, lengths = b"".join(raw), np.array([len(t) for t in raw])
        seen = list(dict.fromkeys(text[a:z] for _, chunks, _ in op11_chunks.parts(text, lengths, v) for a, z in chunks))
        for share in (0.0, 0.3, 0.7, 1.0):
            shared = {n: v.encode([c])[0] for n, c in enumerate(seen) if r.random() < share}
            for ids, t in zip(op11_chunks.Encoder(v).run(text, lengths, shared), whole, strict=True):
                assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_cuts_follow_content():
    r = random.Random(7)
    a, b, c = (bytes(r.randrange(97, 123) for _ in range(n)) for n in (20_000, 3000, 5000))
    cut = lambda data: {data[x:z] for x, z in op11_chunks.chunked(0, len(data), op11_chunks.candidates(np.frombuffer(data, np.uint8)))}
    assert len(cut(a) & cut(b + a + c)) >= len(cut(a)) - 3 and b"".join(sorted(cut(a), key=a.index)) == a
    data = ("é" * 50_000).encode()
    assert all(data[p] >> 6 != 2 for p in op11_chunks.candidates(np.frombuffer(data, np.uint8)))


def test_character_classes_are_the_librarys(library):
    split, newer = op11_chunks.splitter()
    named = regex.compile(op11_chunks.WORDS).findall
    steady = [chr(c) for a, z in op11_chunks.STEADY for c in range(a, z + 1)]
    assert not any(map(newer, steady)) and newer("\u0530") and newer("\uA7CE") and newer("\U0001F600")
    for c in steady:
        for t in (f"a{c}1 {c}.", f"{c}{c} {c}{c}x"):
            assert split(t) == named(t)
            assert [t[a:z] for _, (a, z) in library.pre_tokenizer.pre_tokenize_str(t)] == split(t)


def test_query_digests(spark, library, tmp_path):
    given = texts()[:20]
    spark.createDataFrame([(i, t) for i, t in enumerate(given)] + [(None, "null id"), (3, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op11_chunks.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(given) + 2
    for r in rows:
        t = "null id" if r.doc_id is None else given[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded_sha256 == sha256(t.encode()).hexdigest() and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_string_keys_and_names(spark, library):
    docs = spark.createDataFrame([("k1", "some text"), ("k2", None)], "`a key` string, `a text` string")
    got = {r[0]: list(r.ids) for r in op11_chunks.encode(docs, PATH, "a key", "a text").collect()}
    assert got == {"k1": library.encode("some text").ids, "k2": []}


def test_unknown_id_is_an_error(spark):
    for bad in (-1, 50257):
        with pytest.raises(Exception, match="not in the vocabulary"):
            op11_chunks.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), PATH).collect()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op11_chunks.decode(op11_chunks.encode(docs, PATH), PATH, digests=True).count() == 0
