"""What the operators of this subpackage share: shared storage, packed blocks of documents, and exchanges by hash."""

from __future__ import annotations

import atexit
import ctypes
import functools
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.ship import ship

#: A word: what ASCII white space delimits.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text in a block, at least; a block also holds at least one whole document.
BLOCK_BYTES = 4 << 20


#: Rows and bytes of a batch that goes to a worker or comes back. Texts are long: Spark's own 10,000 rows of them would fill
#: tens of megabytes of buffers in the executor and again in the worker.
BATCH_ROWS, BATCH_BYTES = 512, "8m"


def lean(spark: SparkSession) -> None:
    """Small batches between executors and workers from now on in this session, and workers that know this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="weighbridge-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and the rows are fixed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table is broadcast up to so many bytes, by its number of rows and a bound on a row's size.
BROADCAST_BYTES = 4 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if it is small: so that a join with it need not shuffle whole texts. A larger one is joined
    by a shuffle. df is a written table, so counting it reads no columns."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named by their place, so that none clashes with a name of ours, and what some are called then.
    A name that docs does not have stays."""
    at = {c.lower(): f"c{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*(f"c{n}" for n in range(len(docs.columns)))), [at.get(n.lower(), n) for n in names]


def released() -> None:
    """Give freed memory back to the system: workers are reused, and the next step may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frugal(run: Callable) -> Callable:
    """A function over the batches of a partition that gives its memory back at the end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def pack(value: object, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(values: np.ndarray) -> bytes:
    """The bytes of an integer array, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values)
    flat = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(flat)


def unplanes(blob: bytes, dtype: type) -> np.ndarray:
    flat = zstandard.ZstdDecompressor().decompress(blob)
    wide = np.dtype(dtype).itemsize
    return np.frombuffer(flat, np.uint8).reshape(wide, -1).T.copy().view(dtype).reshape(-1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Hasher:
    """Hashes of all windows of a byte array, from running sums: two polynomials, over 64-bit words with an odd base and over
    the integers modulo a prime. Strings made to be equal in the first (Thue-Morse) differ in the second."""

    MULTIPLIER, PRIME = 6364136223846793005, np.uint64((1 << 31) - 1)

    def __init__(self) -> None:
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.small = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(34)
        self.up = self.down = self.rise = self.fall = np.ones(1, np.uint64)

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Modulo the prime, a Mersenne number."""
        x = (x & self.PRIME) + (x >> np.uint64(31))
        x = (x & self.PRIME) + (x >> np.uint64(31))
        return np.where(x >= self.PRIME, x - self.PRIME, x)

    def _grow(self, n: int) -> None:
        self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, m, np.uint64))]) for m in (self.MULTIPLIER, pow(self.MULTIPLIER, -1, 2**64)))
        base, powers = 1_220_703_125, []
        for m in (base, pow(base, -1, int(self.PRIME))):
            out, step = np.ones(1, np.uint64), m
            while len(out) < n:  # twice as many at a time
                out, step = np.concatenate([out, self._least(out * np.uint64(step))]), step * step % int(self.PRIME)
            powers.append(out[:n].astype(np.uint32))
        self.rise, self.fall = powers

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= len(data):
            self._grow(max(len(data) + 1, 1 << 20))
        wide, narrow = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
        for a in range(0, len(data), 1 << 15):  # what is in between stays in the cache
            z = min(len(data), a + (1 << 15))
            wide[a + 1 : z + 1] = self.letters[data[a:z]] * self.up[a:z]
            narrow[a + 1 : z + 1] = self._least(self.small[data[a:z]] * self.rise[a:z])
        return np.cumsum(wide, out=wide), np.cumsum(narrow, out=narrow)

    def windows(self, sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hash that both polynomials make, the second's own 31 bits) of the `length` bytes from each place."""
        end = at + length
        narrow = self._least(self._least(sums[1][end] - sums[1][at]) * self.fall[at])
        return mixed(((sums[0][end] - sums[0][at]) * self.down[at]) ^ (narrow * np.uint64(0x9E3779B97F4A7C15))), narrow


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[k] .. starts[k] + lengths[k] - 1 for every k, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True at each of n places within some half-open [start, end)."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def block_ids() -> Iterator[int]:
    """Ids for the blocks of the running task, the same when the task runs again over the same partition."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def blocks_of(batches: Iterator[pa.RecordBatch], key: str, text: str, least: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[str]]]:
    """(block id, keys, texts) with nulls as empty texts; about `least` characters each, never part of a document."""
    ids, keys, texts, size = block_ids(), [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t or "")
            size += len(texts[-1]) + 16
            if size >= least:
                yield next(ids), keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield next(ids), keys, texts


def key_type(rows: DataFrame, key: str) -> tuple[pa.DataType, str]:
    """The type of a key column in Arrow and in SQL."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[key].dataType
    return to_arrow_type(kind), kind.simpleString()


def bucket_count(df: DataFrame, per_partition: int = 2, least: int = 24) -> int:
    """Buckets of a hash exchange: they follow the number of input partitions, so a bucket stays as small at any size."""
    return max(least, per_partition * df.rdd.getNumPartitions())


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
