import base64
from hashlib import sha256

import public_tokenizers as P
import tiktoken

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, prose(i), "en", "src0", 0) for i in range(40)]
    rows += [(100 + i, prose(i) + " end", "en", "src0", 0) for i in range(5)]  # near copies
    rows += [(200, "too short", "en", "src1", 9), (201, None, None, None, None), (202, prose(3), "en", "src1", 0), (203, "mail me at x.y@z.org " + prose(203), "de", "src1", 0)]
    rows += [rows[7], (None, prose(500), "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, "")
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r[0] for r in rows} - {200, 201}
    one = corpus_pipeline.near_dedup(spark, good, "").collect()
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == [*range(40), 203] and len(one) == 42
    clean = corpus_pipeline.personal_data(spark, spark.createDataFrame(one, docs.schema), "")
    assert [r.text for r in clean.collect() if r.doc_id == 203] == ["mail me at <EMAIL> " + prose(203)] and clean.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert out and {r.doc_id for r in out} <= set(texts)
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_stage_removes_lines(spark):
    line = "a line that very many documents of the host have"
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"{line}\n{prose(i)}", "en", "src0", 0) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert got[0].text == f"{line}\n{prose(0)}" and all(got[i].text == prose(i) and got[i].n_chars == len(prose(i)) for i in range(1, 50))


def test_columns_that_clash(spark):
    """Columns that are called like any name the stages use come back as they were."""
    extra = ["_size", "_draw", "_source", "_copy", "_copies", "_target", "_i", "_h", "_m", "_s", "_r", "_k", "_c", "mark", "id", "host", "c0", "C1", "a.b", "n"]
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(*(f"{c}{i}" for c in extra), prose(i) + " me@x.org", "src0", i, 0) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in extra) + ", text string, source string, doc_id long, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert r[: len(extra)] == rows[r.doc_id][: len(extra)] and r.source == "src0", name
