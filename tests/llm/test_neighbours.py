import math
import random

import numpy as np
from pyspark.sql import functions as F

from weighbridge.llm import op6_neighbours as ann


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if j != i)
            out[i] = d[:k]
    return out


def test_recall_ties_and_bad_vectors(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(3000)]
    rows += [(3000 + i, rows[100][1]) for i in range(1500)]
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [1.0] * 15 + [None]), (9300, [float("nan")] * 16), (9400, [1.0] * 15 + [float("inf")]), (9500, [1.0] * 3), (None, [1.0] * 16), (9600, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for x in ann.query(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = brute(rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i in got[100]] == list(range(3000, 3010)) and [i for _, i in got[3100]][:2] == [100, 3000]
    for q in got:
        assert got[q] == sorted(got[q])
        near = dict((i, d) for d, i in want[q])
        assert all(abs(near[i] - d) < 1e-9 for d, i in got[q] if i in near)


def test_rows_that_repeat(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 21)] * 2 + [(100, [1.0, 2.0, 3.0, 4.5])]
    rows += [(i, [50 + r.random() for _ in range(4)]) for i in range(1001, 1100)] + [(200, [9.0, 9.0, 9.0, 9.0])]
    rows += [(300, [9.0, 9.0, 9.0, 9.0])] * 30 + [(i, [9.0, 9.0, 9.0, 9.0]) for i in range(301, 313)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for x in ann.query(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got[100] == list(range(1, 11)) and got[200] == list(range(300, 310)) and got[300] == [200, *range(301, 310)]


def test_ids_of_several_vectors():
    items = np.array([[float(i), 0.0] for i in range(1, 41)])
    ids = [[7]] * 30 + [[i] for i in range(100, 110)]
    assert ann.nearest(np.zeros((1, 2)), items, ids, 4) == [[(1.0, 7), (31.0, 100), (32.0, 101), (33.0, 102)]]
    assert ann.nearest(np.zeros((1, 2)), items, ids, 99)[0] == [(1.0, 7), *((31.0 + i, 100 + i) for i in range(10))]
    assert ann.nearest(np.zeros((1, 2)), items[:3], ids[:3], 4) == [[(1.0, 7)]]


def test_few_rows(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(x.query_id, x.rank, x.vec_id) for x in ann.query(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert ann.query(spark, str(tmp_path)).count() == 0
