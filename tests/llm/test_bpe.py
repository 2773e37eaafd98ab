import base64
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

from weighbridge.llm import op1_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "a", "Hello world  \n\n x", "l'été 12345  ça'll 'll", "\U0001f600 \U0001f600", "word " * 5000, "aé" * 3000, "same", "same", "\x1c\x85 \t\n", "中文 字符"]


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, enc):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, block string, codes int").repartition(3)
    got = {r.doc_id: r for r in op1_bpe.decode(op1_bpe.encode(docs, PATH, P.PATTERN), PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert list(got[i].ids) == enc.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].ids)
        assert bytes(got[i].decoded) == (t or "").encode()


def test_query_digests(spark, enc, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op1_bpe.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == sha256(t.encode()).hexdigest()
        assert r.ids_sha256 == sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op1_bpe.decode(op1_bpe.encode(docs, PATH, P.PATTERN), PATH, digests=True).count() == 0
