"""Ranked lexical search: every document is scored for every item, window by window.

1. Items come in batches of a bounded size. The terms of a batch and their number in each item go to all tasks.
2. Each task finds the terms of its documents and keeps, for each document, how many it has and which of the batch's terms how
   often; these postings are written. N, L and every term's df are sums over them.
3. Postings meet by fixed windows of doc_id, wide enough for about WINDOW documents each; a window with more (ids that repeat,
   ids that lie close) is dealt to parts of about WINDOW by a hash of the row.
4. A task goes through its windows one after another. Within one, postings are ordered by term; an item adds those of its
   terms to an array of one score a document, which fits a core's cache, and notes in a bitset which stretches of 64
   documents it touched. Only these are harvested into the item's heap, which lives on from window to window.
5. The heaps of all tasks are ranked.

A null text has no terms; documents without terms take no part in N. Rows that repeat are documents of their own, so an id
may be ranked twice; null ids come last among equal scores. Rows of the items table that repeat count once; several texts
of one item_id are one item with the terms of all. Other columns do not matter, whatever they are called.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.llm import common

TOP = 20
#: Documents in a window, about: scores of a window are 32 KB.
WINDOW = 4096
#: Bytes of text in a batch of items, about.
ITEMS_BYTES = 8 << 20

_LETTER = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of the text, term) of each term of some texts, in order."""
    data = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    letter = _LETTER[data]
    edges = np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, lengths = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
    return np.searchsorted(ends, starts, side="right"), flat.dictionary_encode()


class Batch:
    """Items and their terms, numbered."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[object] = []
        by: dict[object, Counter] = {}
        for i, text in items:
            terms = terms_of([text.encode()])[1]
            by.setdefault(i, Counter()).update(terms.to_pylist())
        for i, terms in by.items():
            self.ids.append(i)
            numbers = [self.numbers.setdefault(t, len(self.numbers)) for t in terms]
            self.items.append((np.array(numbers, np.int64), np.array(list(terms.values()), np.int64)))


def batches_of(items: DataFrame, key: str, text: str) -> Iterator[Batch]:
    """Batches of about ITEMS_BYTES of text. More batches are made until none has twice as much, single items excepted."""
    rows = common.written(items.select(F.col(key).alias("item"), F.col(text).alias("t")).where(F.length("t") > 0).distinct(), "items")
    size = F.sum(F.octet_length("t"))
    n = max(1, -(-(rows.agg(size).first()[0] or 0) // ITEMS_BYTES))
    while True:
        batch = F.pmod(F.xxhash64("item"), F.lit(n))
        if rows.groupBy(batch.alias("b")).agg(size.alias("size"), F.count_distinct(F.coalesce(F.col("item").cast("string"), F.lit("-"))).alias("items")).where((F.col("size") > 2 * ITEMS_BYTES) & (F.col("items") > 1)).isEmpty():
            break
        n *= 2
    for b in range(n):
        held = rows.where(batch == b).collect()  # bounded, as just seen
        if held:
            yield Batch([tuple(r) for r in held])


class Scorer:
    """Goes through windows of documents and keeps the best of each item."""

    def __init__(self, batch: Batch, weights: np.ndarray, n: int, total: int, top: int) -> None:
        self.batch, self.weights, self.n, self.total, self.top = batch, weights, n, total, top
        self.heaps: list[list[tuple[int, int, object]]] = [[] for _ in batch.items]

    def window(self, ids: list, sizes: list[int], counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        m = np.array([100 - 25 + (25 * s * self.n) // self.total for s in sizes], np.int64)
        slots = np.repeat(np.arange(len(ids)), counts)
        gains = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[slots]))
        order = np.argsort(terms, kind="stable")
        slots, gains = slots[order], gains[order]
        begin = np.searchsorted(terms[order], np.arange(len(self.weights) + 1))
        stretch = slots >> 6
        scores, touched = np.zeros(-(-len(ids) // 64) * 64, np.int64), np.zeros(-(-len(ids) // 64), bool)
        for heap, (numbers, times) in zip(self.heaps, self.batch.items, strict=True):
            for a, z, k in zip(begin[numbers].tolist(), begin[numbers + 1].tolist(), times.tolist(), strict=True):
                if a < z:
                    scores[slots[a:z]] += gains[a:z] * k if k > 1 else gains[a:z]  # a document is there once a term
                    touched[stretch[a:z]] = True
            some = np.flatnonzero(touched)
            got = scores.reshape(-1, 64)[some]
            least = heap[0][0] if len(heap) == self.top else 1
            row, place = np.nonzero(got >= max(1, least))
            self._harvest(heap, ids, some[row] * 64 + place, got[row, place])
            scores.reshape(-1, 64)[some] = 0
            touched[some] = False

    def _harvest(self, heap: list, ids: list, slots: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.top:  # slots go up with the id
            best = np.argsort(-scores, kind="stable")[: self.top]
            slots, scores = slots[best], scores[best]
        for s, score in zip(slots.tolist(), scores.tolist(), strict=True):
            i = ids[s]
            entry = (score, -i if i is not None else -(1 << 64), i)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)


def postings(docs: DataFrame, batch, key: str, text: str) -> DataFrame:
    """Per row of docs: doc, n (its terms with repeats), and the numbers of the batch's terms in it with their occurrences."""
    docs, (key, text) = common.apart(docs, key, text)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = batch.value.numbers
        wide = max(1, len(numbers))
        for _, keys, texts in common.blocks_of(batches, "doc", text):
            where, found = terms_of([t.encode() for t in texts])
            n = np.bincount(where, minlength=len(texts))
            known = np.array([numbers.get(t, -1) for t in found.dictionary.to_pylist()], np.int64)
            term = known[found.indices.to_numpy()]
            own = term >= 0
            pairs, tf = np.unique(where[own] * wide + term[own], return_counts=True)
            counts = np.bincount(pairs // wide, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (pairs % wide, tf)]
            whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n.astype(np.int64)), *lists], ["doc", "n", "terms", "tfs"])
            for a in range(0, whole.num_rows, common.BATCH_ROWS):
                yield whole.slice(a, common.BATCH_ROWS)

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")


def frequencies(found: DataFrame, terms: int) -> dict[int, int]:
    """df of each term of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return {r[0]: r[1] for r in found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect()}


def dealt(found: DataFrame, low: int, high: int, rows: int) -> DataFrame:
    """found with its window and part: windows of one width over all ids; parts only where a window has too many rows."""
    width = min(max(1, -(-(high - low + 1) // max(1, -(-rows // WINDOW)))), (1 << 63) - 1)
    window = F.coalesce(F.expr(f"doc div {width}L"), F.lit(1 << 62))
    some = found.where(F.size("terms") > 0).withColumn("window", window)
    over = common.written(some.groupBy("window").agg(F.count("*").alias("held")).where(F.col("held") > WINDOW), "windows")
    if over.isEmpty():
        return some.withColumn("part", F.lit(0).cast("long"))
    parts = F.ceil(F.coalesce("held", F.lit(1)) / F.lit(WINDOW)).cast("long")
    return some.join(common.small(over, 32), "window", "left").withColumn("part", F.pmod(F.xxhash64("doc", "n", "terms", F.monotonically_increasing_id()), parts)).drop("held")


def scored(docs: DataFrame, batch: Batch, key: str, text: str, top: int) -> DataFrame | None:
    """(item number, doc, score): the best of each task for each item of the batch."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(batch)
    found = common.written(postings(docs, sent, key, text), "postings")
    rows, n, total, low, high = found.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.min("doc"), F.max("doc")).first()
    if not (n and batch.numbers):
        return None
    df = frequencies(found, len(batch.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(batch.numbers))], np.int64)
    weighed = spark.sparkContext.broadcast(weights)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, weighed.value, n, total, top)
        held: list[pa.RecordBatch] = []
        at = None

        def through() -> None:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                terms, tfs = (t.column(c).chunk(0).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                counts = t.column("terms").chunk(0).value_lengths().to_numpy()
                scorer.window(t.column("doc").to_pylist(), t.column("n").to_pylist(), counts, terms, tfs)

        for b in batches:
            keys = np.stack([b.column("window").to_numpy(), b.column("part").to_numpy()], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if z > a:
                    if at != tuple(keys[a]):
                        through()
                        held, at = [], tuple(keys[a])
                    held.append(b.slice(a, z - a))
        through()
        for item, heap in enumerate(scorer.heaps):
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int32()), pa.array([e[2] for e in heap], pa.int64()), pa.array([e[0] for e in heap], pa.int64())], ["item", "doc", "score"])

    spread = dealt(found, low or 0, high or 0, rows).repartition("window", "part")
    return spread.sortWithinPartitions("window", "part", F.asc_nulls_last("doc")).mapInArrow(run, "item int, doc long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """For each item its `top` documents: item_id, rank (from 1), doc_id, score, under the given names."""
    spark = docs.sparkSession
    common.lean(spark)
    kind = items.schema[item].dataType.simpleString()
    items, (own_item, own_text) = common.apart(items, item, item_text)
    out = spark.createDataFrame([], "no int, doc long, score long, id " + kind)
    for batch in batches_of(items, own_item, own_text):
        best = scored(docs, batch, key, text, top)
        if best is not None:
            ids = spark.createDataFrame(list(enumerate(batch.ids)), f"no int, id {kind}")  # as many as the batch has
            out = out.unionByName(best.withColumnRenamed("item", "no").join(F.broadcast(ids), "no"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
 d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
 s AS (SELECT count(*) AS cn, sum(len(terms)) AS cl FROM d WHERE len(terms) > 0),
 p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(cn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
 z AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * cn) // cl))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM z WHERE score > 0) WHERE rank <= {TOP}"""
