"""SHA-256 of large files, no task reading more than a split.

The digest goes through the bytes of a file in order, but all that it takes from one byte to the next is a state of 112 bytes.
Spark hands out splits of files that it reads by lines, so bytes come as lines, as they are; all splits at once put them together
to blocks, with their breaks put back, in the shared folder. Then the blocks of a file's splits are read one split after another,
each by a task that takes up the state which the split before it left; files go on side by side. The bytes of splits add up to
the size of the file, but for a last break; they do not where a file is unpacked or has longer lines than a task should hold.
Such files try the next break.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.ship import ship
from weighbridge.sources import shared

#: Names that Spark's reader of lines would decompress.
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd|lzo)$"
#: What lines end with, and the bytes up to which the reader of lines gives them.
BREAKS = ("\n", "\0", " ", "0", "A", "e")
LINE_BYTES = 16 << 20
#: Bytes of a split.
SPLIT_BYTES = 64 << 20
#: The mark that the reader of lines drops from the start of a file.
MARK = b"\xef\xbb\xbf"
#: Bytes held for a state, with room to spare.
STATE = 128


class Digest:
    """SHA-256 whose state can be taken out and taken up, as that of hashlib can't: OpenSSL's, which hashlib is linked with."""

    def __init__(self, state: bytes = b""):
        self._lib = library()
        self._held = ctypes.create_string_buffer(state, STATE)
        if not state:
            self._lib.SHA256_Init(self._held)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._held, data, len(data))

    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._held.raw, STATE)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()


@cache
def library() -> ctypes.CDLL:
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    return lib


@cache
def available() -> bool:
    """Whether states can be carried here."""
    try:
        first = Digest()
        first.update(MARK * 50)
        second = Digest(first.state())
        second.update(MARK * 7)
        return second.hexdigest() == hashlib.sha256(MARK * 57).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


@contextmanager
def _splits(spark: SparkSession, size: int, alone: bool) -> Iterator[None]:
    """Splits of that size, the same in every plan: not by the number of cores, which executors that join change. If alone, a task
    has one. Rows go to Python by 8 MB."""
    new = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size if alone else size // 16), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxRecordsPerFile": "0", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    old = {key: spark.conf.get(key, None) for key in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_BLOCKS = pa.schema([("file", pa.int64()), ("split", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a batch that follow each other in a split as one row, with the bytes of the split before it."""
    read: dict[tuple, int] = defaultdict(int)
    for b in batches:
        file, split = b.column("file").to_numpy(), b.column("split").to_numpy()
        new = (file[1:] != file[:-1]) | (split[1:] != split[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(file)] if len(file) else []
        for start, end in pairwise(cuts):
            key = int(file[start]), int(split[start])
            data = b"".join(b.column("bytes").slice(start, end - start).to_pylist())
            yield pa.RecordBatch.from_pylist([{"file": key[0], "split": key[1], "at": read[key], "n": len(data), "bytes": data}], schema=_BLOCKS)
            read[key] += len(data)


def _going_on(turn: dict[tuple, tuple[bytes, int, int]]) -> Callable:
    """A step over the blocks of tasks: splits in turn (file and split: state, bytes that they have, bytes that count) go on from
    their state."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: dict[tuple, Digest] = {}
        read: dict[tuple, int] = defaultdict(int)
        for b in batches:
            for file, split, at, data in zip(*(b.column(c).to_pylist() for c in ("file", "split", "at", "bytes")), strict=True):
                key = file, split
                if key not in turn:
                    continue
                state, _, counted = turn[key]
                if at != read[key]:
                    raise RuntimeError("blocks were read in another order")
                if key not in digests:
                    digests[key] = Digest(state)
                digests[key].update(data[: max(0, counted - at)])
                read[key] += len(data)
        if any(n != turn[key][1] for key, n in read.items()):
            raise RuntimeError("a split was not read whole")
        yield pa.RecordBatch.from_pylist([{"file": k[0], "split": k[1], "state": d.state()} for k, d in digests.items()], schema=pa.schema([("file", pa.int64()), ("split", pa.int64()), ("state", pa.binary())]))

    return step


def sha256(spark: SparkSession, folder: str, wanted: Column, **options: str) -> dict[str, str]:
    """The digest of each file of a folder that is wanted by its _metadata, by its path as that has it. Files that no break
    divides into lines of up to LINE_BYTES are left out."""
    ship(spark)
    path = F.col("_metadata.file_path")
    found: dict[str, str] = {}
    for sep in BREAKS:
        some = wanted & ~path.isin([*found])
        files = spark.read.options(**options).format("binaryFile").load(folder).where(some).select(F.xxhash64(path).alias("file"), path.alias("path"), "length").collect()
        if not files:
            break
        sizes = {f.file: f.length for f in files}
        if len(sizes) < len(files):
            raise RuntimeError("two paths have the same hash")
        lines = spark.read.options(**options, lineSep=sep, **{"mapreduce.input.linerecordreader.line.maxlength": str(LINE_BYTES)}).text(folder).where(some)
        raw = lines.select(F.xxhash64(path).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.concat(F.col("value").cast("binary"), F.lit(sep.encode())).alias("bytes"))
        with _splits(spark, SPLIT_BYTES, alone=False):
            blocks = shared.written(raw.mapInArrow(_blocks, "file long, split long, at long, n long, bytes binary"), "blocks")
        with _splits(spark, 1 << 30, alone=True):  # a task reads what one wrote
            told = _chained(spark, blocks, sizes)
        found |= {f.path: told[f.file] for f in files if f.file in told}
    return found


def _chained(spark: SparkSession, blocks: DataFrame, sizes: dict[int, int]) -> dict[int, str]:
    splits = blocks.select(F.spark_partition_id().alias("task"), "file", "split", "n").groupBy("task", "file", "split").agg(F.sum("n").alias("n")).orderBy("file", "split").collect()
    files, states, left, counted, waiting = defaultdict(list), {}, {}, {}, defaultdict(set)
    for s in splits:
        files[s.file].append(s)
    for file, own in files.items():
        more = sum(s.n for s in own) - sizes[file]
        if more not in (0, 1, -2, -3):
            continue
        digest = Digest()
        digest.update(MARK if more < 0 else b"")
        states[file], left[file] = digest.state(), own[::-1]
        for s in own:
            counted[file, s.split] = s.n
            waiting[s.task].add((file, s.split))
        counted[file, own[-1].split] -= more in (1, -2)  # no break at the end
    while left:
        ready = {(file, own[-1].split) for file, own in left.items()}
        tasks = [t for t, keys in waiting.items() if keys <= ready] or [t for t, keys in waiting.items() if keys & ready]
        now = {*tasks}
        turn = {(file, s.split): (states[file], s.n, counted[file, s.split]) for file, own in left.items() if (s := own[-1]).task in now}
        step = blocks.select("file", "split", "at", "bytes").mapInArrow(_going_on(turn), "file long, split long, state binary").rdd
        told = {(file, split): state for file, split, state in spark.sparkContext.runJob(step, lambda rows: [(r.file, r.split, bytes(r.state)) for r in rows], tasks)}
        if told.keys() != turn.keys():
            raise RuntimeError("a split was not read")
        for key, state in told.items():
            file = key[0]
            states[file] = state
            task = left[file].pop().task
            waiting[task].discard(key)
            if not waiting[task]:
                del waiting[task]
            if not left[file]:
                del left[file]
    return {file: Digest(state).hexdigest() for file, state in states.items()}
