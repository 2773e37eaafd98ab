"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Each task cuts its documents into blocks, splits them into pre-tokens and keeps, for each block, the pre-token at
   every position as a number into the block's own list of distinct words.
2. The distinct words of all blocks meet by hash; each distinct word is encoded once, where it meets. A block sends a
   word once however often it has it, so a word that makes up a third of all text weighs no more than one row a block.
3. The ids go back to the block and are put together by position.
4. Decoding looks every id up in the table of token bytes, whose size is that of the vocabulary.

Nulls and empty texts have no ids and decode to nothing. Rows that repeat are kept as they are. Other columns than the
two named ones do not matter, whatever they are called. The input must be a plan that gives the same rows in the same
partitions when it is run again, such as a scan of a table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("codes", pa.binary()), ("words", pa.binary())])
WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])
#: Pre-tokens held as Python strings at once, and rows decoded at once.
HELD, ROWS = 65_536, 64
IDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])


def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _bucket_of(words: list[str], buckets: int) -> np.ndarray:
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)
    return (common.mixed(hashed) % np.uint64(buckets)).astype(np.uint32)


def _split(pattern: str, buckets: int, key: str, text: str):
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for block, keys, texts in common.blocks_of(batches, key, text):
            tokens: list[str] = []
            lengths, parts = [], []
            for t in texts:
                found = find(t)
                tokens += found
                lengths.append(len(found))
                if len(tokens) > HELD:
                    parts.append(pa.array(tokens, pa.string()))
                    tokens = []
            parts.append(pa.array(tokens, pa.string()))
            table = pa.concat_arrays(parts).dictionary_encode()
            codes, words = table.indices.to_numpy(), table.dictionary.to_pylist()
            del tokens, parts
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            words = [words[i] for i in often]
            docs = common.pack((keys, np.array(lengths, np.int64)))
            yield common.batch(BLOCK, [(block, docs, common.planes(rank[codes]), common.pack(words))])

    return run


def _distinct(buckets: int):
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = common.unpack(blob)
                at = _bucket_of(words, buckets)
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(buckets + 1))
                rows = [(k, block, common.pack([words[i] for i in order[cut[k] : cut[k + 1]]])) for k in range(buckets) if cut[k] < cut[k + 1]]
                yield common.batch(WORDS, rows)

    return run


def _encode(pattern: str, table):
    def run(group: pa.Table) -> pa.Table:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})._core_bpe.encode_single_piece
        known: dict[str, list[int]] = {}
        rows = []
        for bucket, block, blob in zip(*(group.column(c).to_pylist() for c in ("bucket", "block", "words")), strict=True):
            ids: list[int] = []
            sizes = []
            for word in common.unpack(blob):
                got = known.get(word)
                if got is None:
                    got = known[word] = encode(word.encode())
                ids += got
                sizes.append(len(got))
            rows.append((block, bucket, common.planes(np.array(sizes, np.uint32)), common.planes(np.array(ids, np.uint32))))
        return pa.Table.from_batches([common.batch(IDS, rows)])

    return run


def _join(buckets: int, key: str, kind: pa.DataType):
    out = pa.schema([(key, kind), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        replies = {k: (s, i) for k, s, i in zip(*(answers.column(c).to_pylist() for c in ("bucket", "sizes", "ids")), strict=True)}
        parts = []
        for docs, codes, words in zip(*(blocks.column(c).to_pylist() for c in ("docs", "codes", "words")), strict=True):
            keys, lengths = common.unpack(docs)
            words = common.unpack(words)
            order = np.argsort(_bucket_of(words, buckets), kind="stable")
            got = [replies[k] for k in sorted(replies)]
            sizes = np.concatenate([np.empty(0, np.uint32), *(common.unplanes(s, np.uint32) for s, _ in got)]).astype(np.int64)
            ids = np.concatenate([np.empty(0, np.uint32), *(common.unplanes(i, np.uint32) for _, i in got)]).astype(np.int32)
            if len(sizes) != len(words):
                raise RuntimeError("a block and the ids of its words differ: the input gave other rows when it was read again")
            begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            begin[order], size[order] = np.cumsum(sizes) - sizes, sizes
            codes = common.unplanes(codes, np.uint32)
            flat = ids[common.ragged(begin[codes], size[codes])]
            upto = np.concatenate([[0], np.cumsum(size[codes])])
            ends = upto[np.concatenate([[0], np.cumsum(lengths)])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            parts.append(pa.table([pa.array(keys, kind), pa.array(np.diff(ends), pa.int64()), lists], schema=out))
        return pa.concat_tables(parts) if parts else out.empty_table()

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its key, n_tokens long and ids array<int>. A null text counts as empty."""
    spark = docs.sparkSession
    common.lean(spark)
    rows = docs.select(key, text)
    kind, sql = {"long": (pa.int64(), "long"), "bigint": (pa.int64(), "long"), "int": (pa.int32(), "int"), "string": (pa.string(), "string")}[dict(rows.dtypes)[key]]
    buckets = common.bucket_count(rows)
    table = spark.sparkContext.broadcast(ranks(ranks_path))  # as large as the vocabulary, whatever the input
    blocks = rows.mapInArrow(_split(pattern, buckets, key, text), "block long, docs binary, codes binary, words binary")
    blocks = blocks.repartition("block")
    words = blocks.mapInArrow(_distinct(buckets), "bucket int, block long, words binary")
    ids = words.groupBy("bucket").applyInArrow(_encode(pattern, table), "block long, bucket int, sizes binary, ids binary")
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_join(buckets, key, kind), f"{key} {sql}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", digests: bool = False, keep: bool = False) -> DataFrame:
    """Adds decoded binary, the bytes of the ids of each row; with digests, adds ids_sha256 and decoded_sha256 instead
    and, unless keep is set, drops the ids. Null ids decode to nothing. Ids outside the vocabulary are an error."""
    common.lean(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(ranks(ranks_path))
    kept = [c for c in encoded.columns if not (digests and not keep and c == ids)]
    added = ["ids_sha256", "decoded_sha256"] if digests else ["decoded"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(table.value.values(), default=-1) + 1
        pieces: list[bytes | None] = [None] * size
        for piece, at in table.value.items():
            pieces[at] = piece
        lens = np.array([len(p or b"") for p in pieces], np.int64)
        starts = np.cumsum(lens) - lens
        flat = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            column = b.column(ids)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values) and (values.min() < 0 or values.max() >= size):
                raise ValueError("an id is not in the vocabulary")
            counts = np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)
            data = flat[common.ragged(starts[values], lens[values])].tobytes()
            ends = np.concatenate([[0], np.cumsum(counts)])
            cuts = np.concatenate([[0], np.cumsum(lens[values])])[ends]
            texts = [data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            if digests:
                wide = values.astype("<u4").tobytes()
                more = [pa.array([sha256(wide[4 * a : 4 * z]).hexdigest() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.string()), pa.array([sha256(t).hexdigest() for t in texts], pa.string())]
            else:
                more = [pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *more], [*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in kept), *(f"{c} {'string' if digests else 'binary'}" for c in added)])
    return encoded.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs, path, public_tokenizers.PATTERN), path, digests=True).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
