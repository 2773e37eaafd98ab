"""Vector code compression: integer product codes, each part's nearest codebook entry found by VA-file filtering.

1. Components become integers; vectors are cut into PARTS parts. The codebook of a part starts as that part of the vectors
   with the ENTRIES smallest ids. Codebooks have ENTRIES entries of the width of a vector in all, so they go to all tasks.
2. Every coordinate of an entry is quantised to BITS bits: cells hold entries of neighbouring values, and a cell is known by
   the least and largest of them. For each part to be coded, a table a coordinate gives the least and largest square
   that an entry of a cell can add; sums over the entry's cells bound its distance from below and above. Only entries
   whose lower bound is not over the smallest upper bound are compared, by integer distances; ties go to the lower index.
3. A round sums the parts of each entry within a task, then over tasks, and replaces entries by the floor of their mean.
   What is exchanged is a row for each coordinate of each entry and task, whatever the number of vectors.
4. Errors are summed for each label before they go back to its rows: to all tasks if the labels are few, else by a join in
   which each label's rows are spread over SALTS keys.

Vectors that are null or empty, hold null or non-finite components, or have another length than most (than the longer, if equally
many) take no part. Part p covers the components p*width/16 to (p+1)*width/16, rounded down, so any width can be cut. Among equal ids the
smaller vector comes first and null ids come last. Rows that repeat are vectors of their own. Integers are exact up to 2**62, beyond which
components are cut to it; errors of over 2**63 - 1 are given as that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BITS = 4
SALTS = 32
#: Components under this are worked on in 64 bits: squared distances of up to 2**11 coordinates stay within them.
PLAIN = 1 << 25
MOST, LONGEST = 1 << 62, (1 << 63) - 1


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component: int64, or Python's integers where some are large."""
    if not values.size or np.abs(values).max() * SCALE < PLAIN:
        return np.floor(values * SCALE).astype(np.int64)
    exact = lambda x: math.floor(x * SCALE) if abs(x) < 2.0**60 else int(x) * SCALE
    return np.array([[max(-MOST, min(MOST, exact(x))) for x in row] for row in values.tolist()], object).reshape(values.shape)


class Cells:
    """One part's codebook with the cell of each coordinate of each entry."""

    def __init__(self, entries: list[list[int]], wide: int) -> None:
        self.entries = np.array(entries, object).reshape(len(entries), wide)
        self.plain = not self.entries.size or max(abs(x) for row in entries for x in row) < PLAIN
        kind = np.int64 if self.plain else object
        self.entries = self.entries.astype(kind)
        self.cell = np.zeros((len(entries), wide), np.int64)
        self.low, self.high = (np.zeros((wide, 1 << BITS), kind) for _ in range(2))
        for j in range(wide):
            values = sorted(set(self.entries[:, j].tolist()))
            at = {v: (n << BITS) // len(values) if len(values) > 1 << BITS else n for n, v in enumerate(values)}
            for v in reversed(values):
                self.low[j, at[v]] = v
            for v in values:
                self.high[j, at[v]] = v
            self.cell[:, j] = [at[v] for v in self.entries[:, j].tolist()]

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all pairs that the bounds do not rule out, by row and entry."""
        lower, upper = (np.zeros((len(x), len(self.entries)), x.dtype) for _ in range(2))
        for j in range(x.shape[1]):
            q = x[:, j, None]
            beyond = np.maximum(np.maximum(self.low[j] - q, q - self.high[j]), 0)
            across = np.maximum(abs(q - self.low[j]), abs(q - self.high[j]))
            lower += (beyond * beyond)[:, self.cell[:, j]]
            upper += (across * across)[:, self.cell[:, j]]
        return np.nonzero(lower <= upper.min(axis=1)[:, None])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row."""
        if not self.plain:
            x = x.astype(object)
        rows, entries = self.candidates(x)
        gap = x[rows] - self.entries[entries].astype(x.dtype)
        far = (gap * gap).sum(axis=1) if x.shape[1] else np.zeros(len(rows), np.int64)
        least = np.minimum.reduceat(far, np.searchsorted(rows, np.arange(len(x))))
        hit = np.flatnonzero(far == least[rows])
        return entries[hit[np.unique(rows[hit], return_index=True)[1]]], least


def bounds(wide: int) -> list[tuple[int, int]]:
    return [(p * wide // PARTS, (p + 1) * wide // PARTS) for p in range(PARTS)]


def rows_of(column: pa.Array, wide: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide))


def codebooks(vectors: DataFrame, wide: int, key: str, embedding: str) -> list[list[list[int]]]:
    """Entries by part: where they start, moved ROUNDS times."""
    first = vectors.orderBy(F.asc_nulls_last(key), embedding).limit(ENTRIES).select(embedding).collect()
    start = integers(np.array([r[0] for r in first], np.float64).reshape(-1, wide)).tolist()
    books = [[row[a:z] for row in start] for a, z in bounds(wide)]
    for _ in range(ROUNDS if first else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(books)

        @common.frugal
        def tally(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cells = [Cells(b, z - a) for b, (a, z) in zip(sent.value, bounds(wide), strict=True)]
            sums = [np.zeros((len(c.entries), c.entries.shape[1]), object) for c in cells]
            counts = np.zeros((PARTS, len(cells[0].entries)), np.int64)
            for b in batches:
                x = rows_of(b.column(embedding), wide)
                for p, (a, z) in enumerate(bounds(wide)) if len(x) else ():
                    at, _ = cells[p].nearest(x[:, a:z])
                    own = np.zeros(sums[p].shape, x.dtype)
                    np.add.at(own, at, x[:, a:z])
                    sums[p] += own.astype(object)
                    counts[p] += np.bincount(at, minlength=counts.shape[1])
            told = [(p, e, j, int(sums[p][e, j]), int(counts[p, e])) for p in range(PARTS) for e in np.flatnonzero(counts[p]).tolist() for j in range(sums[p].shape[1])]
            for a in range(0, len(told), 4096):
                columns = list(zip(*told[a : a + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()), strict=True)], ["part", "entry", "place", "total", "n"])

        told = vectors.select(embedding).mapInArrow(tally, "part int, entry int, place int, total decimal(38,0), n long")
        for p, e, j, total, n in told.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():  # coordinates of all entries
            books[p][e][j] = int(total) // n
    return books


def with_totals(rows: DataFrame, label: str, error: str, name: str) -> DataFrame:
    """rows with the sum of `error` over equal labels, nulls together. rows is a written table."""
    top = F.lit(LONGEST).cast("decimal(38,0)")
    total = F.least(F.sum(F.col(error).cast("decimal(38,0)")).cast("decimal(38,0)"), top).cast("long")
    totals = common.written(rows.groupBy(F.col(label).alias("_l")).agg(total.alias(name)), "labels")
    longest = totals.agg(F.coalesce(F.max(F.octet_length(F.col("_l").cast("string"))), F.lit(0))).first()[0]
    few = common.small(totals, 64 + longest)
    if few is not totals:
        return rows.join(few, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    spread = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_t", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_t") == F.col("_s"))).drop("_l", "_s", "_t")


def compress(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error, label_error of each vector that takes part; the codebooks)."""
    spark = vectors.sparkSession
    common.lean(spark)
    vectors, (k, e, w) = common.apart(vectors, key, embedding, label)
    kept = vectors.select(k, w, F.col(e).cast("array<double>").alias(e))
    kept = kept.where(F.expr(f"size({e}) > 0 and forall({e}, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"))
    most = kept.groupBy(F.size(e).alias("wide")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("wide")).limit(1).collect()
    wide = most[0]["wide"] if most else 1
    kept = kept.where(F.size(e) == wide)
    books = codebooks(kept, wide, k, e)
    sent = spark.sparkContext.broadcast(books)

    @common.frugal
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b, z - a) for b, (a, z) in zip(sent.value, bounds(wide), strict=True)]
        for b in batches:
            x = rows_of(b.column(e), wide)
            if len(x):
                told = [c.nearest(x[:, a:z]) for c, (a, z) in zip(cells, bounds(wide), strict=True)]
                at = np.stack([t[0] for t in told], axis=1).astype(np.uint8)
                error = [min(LONGEST, sum(int(t[1][n]) for t in told)) for n in range(len(x))]
                yield pa.RecordBatch.from_arrays([b.column(k), b.column(w), pa.array([r.tobytes().hex() for r in at]), pa.array(error, pa.int64())], [k, w, "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = common.written(kept.mapInArrow(code, f"{k} {kinds[k]}, {w} {kinds[w]}, code string, error long"), "codes")
    return with_totals(coded, w, "error", "label_error").select(F.col(k).alias(key), F.col(w).alias(label), "code", "error", "label_error"), books


def digest(books: list[list[list[int]]]) -> str:
    return sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """One assignment, and the codebook after it."""
    return f"""a{n} AS MATERIALIZED (SELECT vec_id, part, any_value(p.s) AS s, arg_min(entry, struct_pack(d := {_FAR}, e := entry)) AS entry, min({_FAR}) AS d FROM p JOIN c{n} c USING (part) GROUP BY vec_id, part),
 m{n} AS (SELECT part, entry, list(x ORDER BY j) AS s FROM (SELECT part, entry, j, floor(sum(s[j]) / count(*))::BIGINT AS x FROM a{n}, range(1, 1 + (SELECT max(len(s)) FROM p)) t(j) GROUP BY ALL) GROUP BY ALL),
 c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.s, c.s) AS s FROM c{n} c LEFT JOIN m{n} m USING (part, entry)),"""


_FAR = "list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * (len(v) // {PARTS}) + 1, (part + 1) * (len(v) // {PARTS})) AS s FROM v, range({PARTS}) t(part)),
 c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s FROM p QUALIFY entry < {ENTRIES}),
 {"".join(_round(n) for n in range(ROUNDS + 1))}
 h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, j, s[j] AS x FROM c{ROUNDS}, range(1, 1 + (SELECT max(len(s)) FROM p)) t(j))),
 o AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT o.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h"""
