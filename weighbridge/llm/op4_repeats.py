"""Removal of long repeated byte strings through a difference cover.

A byte is removed when a string of LENGTH bytes that covers it also starts anywhere else. Only equality of prefixes of
LENGTH bytes matters, so the difference-cover construction is cut down to what equality needs:

1. Sample: the places p of each document whose p mod PERIOD is in a difference cover. For any two places i and j there
   is a d < PERIOD with both i + d and j + d sampled. Name each sampled place by its next SHORT = LENGTH - PERIOD + 1 bytes;
   names meet by hash. A place can only start a repeated string if a sampled place after it, less than PERIOD away,
   has a repeated name. Elsewhere the text is done.
2. Recurse: sampled places with repeated names are named again by LONG = LENGTH + PERIOD - 1 bytes. A repeated longer name
   proves that every place less than PERIOD after it starts a repeated string, and all but the first of equals need
   no further work. What all strings of LENGTH bytes that start in one of HALVES before a sampled place have in common is
   named too: only where that is repeated there is something to compare.
3. Merge: the remaining places are named by their LENGTH bytes, and equal prefixes are compared.

Names are hashes of positions' bytes in place of ranks, of 56 bits where an equality by chance only means more to compare,
and of 88 bits elsewhere. A block sends a name once however often it has it, so a passage found in
a third of all documents weighs no more than one entry a block. Each bucket of names answers in the order in which it
was asked, so neither names nor answers carry positions; a digest of what was asked goes with each answer. What a
block has learnt goes on to its next round in packed bits. Blocks of text are shuffled once.

In the same exchanges, shorter passages that documents share are counted, not removed: strings of PASSAGE words. The least of
the hashes of a passage's strings of PART words is the same wherever it stands; passages for which it also stands in
another document are then named by all their words.

Nulls count as empty texts; texts under LENGTH bytes lose nothing; rows that repeat lose all they share, in each copy. Null
and repeated ids are ids like any other. An empty table gives no rows. Other columns than the two named do not matter.
The input must be a plan that gives the same rows in the same partitions when it is run again, such as a table scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

LENGTH = 400
#: Period of the cover; the perfect difference set of the prime 13 has 14 members mod 13 * 13 + 13 + 1.
PRIME = 13
PERIOD = PRIME * PRIME + PRIME + 1
SHORT, LONG = LENGTH - PERIOD + 1, LENGTH + PERIOD - 1
HALVES = ((0, PERIOD // 2), (PERIOD // 2 + 1, PERIOD - 1))
#: Words of a passage, and of its parts.
PASSAGE, PART = 51, 26
NAMES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("known", pa.binary())])
FLAGS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("asked", pa.int64()), ("flags", pa.binary())])
#: The bucket of what a block keeps for itself.
OWN = -1


def singer(q: int) -> np.ndarray | None:
    """The perfect difference set of the lines of the projective plane over the prime q, or None if none was found."""
    period = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # powers of x in GF(q)[x] / (x^3 - a x^2 - b x - c); the exponents whose x^2 part is 0 form a line
                u, v, w, line, order = 0, 0, 1, [], 0
                for e in range(period):
                    if u == 0:
                        line.append(e)
                    u, v, w = (v + a * u) % q, (w + b * u) % q, (c * u) % q
                    if u == v == 0 and e < period - 1:
                        order = 1
                        break
                if not order and len(line) == q + 1 and len({(x - y) % period for x in line for y in line}) == period:
                    return np.array(line)
    return None


HASHER = common.Hasher()


class Asked:
    """The distinct names of some places: ordered by bucket and name, with the way back to the places."""

    def __init__(self, names: tuple[np.ndarray, np.ndarray], buckets: int, wide: bool, owner: np.ndarray | None = None) -> None:
        first, more = names if wide else (names[0] & ~np.uint64(255), names[1])
        more = more & np.uint64(0xFFFFFF)
        order = np.lexsort((more, first)) if wide else np.argsort(first, kind="stable")
        one, two = first[order], more[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = one[1:] != one[:-1]
        if wide:
            fresh[1:] |= two[1:] != two[:-1]
        begin = np.flatnonzero(fresh)
        self.name, self.more, self.wide = one[begin], two[begin].astype(np.uint32), wide
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(fresh) - 1
        self.cuts = np.searchsorted(((self.name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))
        self.is_first = np.zeros(len(order), bool)
        self.is_first[order[begin]] = True
        if owner is None:  # met again at another place?
            again = np.diff(np.append(begin, len(order))) > 1
        else:  # met again in another document?
            own = owner[order]
            again = (np.maximum.reduceat(own, begin) != np.minimum.reduceat(own, begin)) if len(begin) else np.empty(0, bool)
        self.again = again[self.back]

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its names, the rest of these names or nothing)"""
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            own = slice(int(self.cuts[k]), int(self.cuts[k + 1]))
            yield k, self.name[own], self.more[own] if self.wide else self.more[:0]

    def told(self, answers: dict[int, tuple[int, bytes]], offset: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each place: is its name met again elsewhere, and is it other than the first of all its equals?"""
        bits = []
        for k, *names in self.parts():
            n = len(names[0])
            asked, flags = answers.get(k + offset, (None, b""))
            if asked != digest(*names):
                raise RuntimeError("a block and its answers differ: the input gave other rows when it was read again")
            bits.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * n).reshape(2, n))
        flags = np.concatenate(bits, axis=1)[:, self.back] if bits else np.zeros((2, 0), np.uint8)
        return (flags[0] > 0) | self.again, (flags[1] > 0) | ~self.is_first


def digest(names: np.ndarray, more: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(names.tobytes() + more.tobytes()) - (1 << 63)


class Block:
    """The documents of a block end to end, and what is known of their places in each round."""

    def __init__(self, blob: bytes, buckets: int) -> None:
        self.keys, self.lens, raw = common.unpack(blob)
        self.data, self.buckets = np.frombuffer(raw, np.uint8), buckets
        self.sums = HASHER.sums(self.data)
        self.begin = np.cumsum(self.lens) - self.lens
        #: for each place, the end of its document
        self.end = np.repeat(self.begin + self.lens, self.lens)
        places = np.arange(len(self.data))
        sampled = np.zeros(PERIOD, bool)
        sampled[COVER] = True
        self.sample = np.flatnonzero(sampled[(places - np.repeat(self.begin, self.lens)) % PERIOD] & (places + SHORT <= self.end) & (np.repeat(self.lens, self.lens) >= LENGTH))

    def asked(self, at: np.ndarray, length: int) -> Asked:
        return Asked(HASHER.windows(self.sums, at, length), self.buckets, length >= LENGTH)

    def clip(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """True at the places from `before` before to `after` after the given ones, within their documents."""
        start = np.repeat(self.begin, self.lens)[at]
        return common.covered(np.maximum(start, at - before), np.minimum(self.end[at], at + after + 1), len(self.data))

    def long(self, repeated: np.ndarray) -> np.ndarray:
        """The sampled places with repeated names that the longer name fits in."""
        kept = self.sample[repeated]
        return kept[kept + LONG <= self.end[kept]]

    def halves(self, repeated: np.ndarray) -> tuple[list[np.ndarray], Asked]:
        """For each of HALVES the sampled places it fits before, and the names of what strings that start there share."""
        kept = self.sample[repeated]
        first = np.repeat(self.begin, self.lens)[kept]
        fits = [kept[(kept - a >= first) & (kept - z + LENGTH <= self.end[kept])] for a, z in HALVES]
        names = [HASHER.windows(self.sums, at - a, LENGTH - (z - a)) for at, (a, z) in zip(fits, HALVES, strict=True)]
        return fits, Asked(tuple(np.concatenate(x) for x in zip(*names, strict=True)), self.buckets, False)

    def rest(self, repeated: np.ndarray, proved: np.ndarray, later: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places known to start a repeated string, and the places still to be compared."""
        long = self.long(repeated)
        known, skip = (self.clip(long[x], 0, PERIOD - 1) for x in (proved, proved & later))
        first = np.repeat(self.begin, self.lens)
        may = np.zeros(len(self.data), bool)
        for (a, z), at in zip(HALVES, self.halves(repeated)[0], strict=True):
            at, half = at[half[: len(at)]], half[len(at) :]
            may |= common.covered(np.maximum(first[at], at - z), np.maximum(first[at], at - a + 1), len(self.data))
        fits = np.arange(len(self.data)) + LENGTH <= self.end
        return np.flatnonzero(known), np.flatnonzero(may & fits & ~skip)

    def removed(self, known: np.ndarray, compared: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        at = np.concatenate([known, compared[repeated]])
        return common.covered(at, at + LENGTH, len(self.data))



class Passages:
    """The strings of PASSAGE words of a block's documents."""

    def __init__(self, x: Block) -> None:
        blank = BLANK[x.data]
        stop = np.ones(len(blank) + 1, bool)  # a blank or the start of a document ends a word
        stop[:-1] = blank
        stop[x.begin] = True
        opens = ~blank
        edge = np.zeros(len(blank) + 1, bool)
        edge[x.begin] = True
        opens[1:] &= blank[:-1] | edge[1:-1]
        start, stops = np.flatnonzero(opens), np.flatnonzero(stop)
        size = stops[np.searchsorted(stops, start, side="right")] - start
        self.buckets, self.docs = x.buckets, len(x.lens)
        self.owner = np.searchsorted(x.begin + x.lens, start, side="right")
        last = np.searchsorted(self.owner, self.owner, side="right")  # for each word, the end of its document
        self.words = HASHER.windows(x.sums, start, size)[0]
        self.sums = self._sums(self.words)
        at = np.arange(len(start))
        self.at = at[at + PASSAGE <= last]
        part = self.named(at[: max(0, len(at) - PART + 1)], PART)
        step = 1
        while 2 * step <= PASSAGE - PART + 1:  # the least of twice as many
            part = np.minimum(part[: len(part) - step], part[step:]) if len(part) > step else part[:0]
            step *= 2
        key = np.minimum(part[self.at], part[self.at + (PASSAGE - PART + 1 - step)])
        #: passages one after another with the same key are asked for once
        of = self.owner[self.at]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        self.group, self.key, self.of = np.cumsum(fresh) - 1, key[fresh], of[fresh]

    @staticmethod
    def _sums(words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * HASHER.up[: len(words)], out=out[1:])
        return out

    def named(self, at: np.ndarray, width: int, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums if sums is None else sums
        return common.mixed((sums[at + width] - sums[at]) * HASHER.down[at])

    def parts(self) -> Asked:
        return Asked((self.key, self.key), self.buckets, False, self.of)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        return self.at[repeated[self.group]]

    def whole(self, repeated: np.ndarray) -> Asked:
        at = self.candidates(repeated)
        more = self.named(at, PASSAGE, self._sums(common.mixed(self.words ^ np.uint64(0x94D049BB133111EB)))) if len(at) else at.astype(np.uint64)
        return Asked((self.named(at, PASSAGE), more), self.buckets, True, self.owner[at])

    def counted(self, repeated: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """For each document, how many stretches of passages that another document has too."""
        at = self.candidates(repeated)[shared]
        of = self.owner[at]
        return np.bincount(of[(np.diff(at, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0)], minlength=self.docs)


def _blocks(key: str, text: str):
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, texts in common.blocks_of(batches, key, text):
            raw = [t.encode() for t in texts]
            yield common.batch(schema, [(block, common.pack((keys, np.array([len(x) for x in raw], np.int64), b"".join(raw)), level=3))])

    return run


def _sent(asked: Asked, block: int, offset: int = 0) -> list[tuple]:
    return [(k + offset, block, common.pack((common.planes(names), common.planes(more))), None) for k, names, more in asked.parts()]


def _bits(*flags: np.ndarray) -> bytes:
    return common.pack([(len(x), np.packbits(x).tobytes()) for x in flags])


def _unbits(blob: bytes) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) for n, raw in common.unpack(blob)]


def _first(buckets: int):
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, docs in zip(b.column("block").to_pylist(), b.column("docs").to_pylist(), strict=True):
                x = Block(docs, buckets)
                yield common.batch(NAMES, _sent(x.asked(x.sample, SHORT), block) + _sent(Passages(x).parts(), block, buckets))

    return run


def _answers(table: pa.Table) -> dict[int, tuple[int, bytes]]:
    return {k: (asked, flags) for k, asked, flags in zip(*(table.column(c).to_pylist() for c in ("bucket", "asked", "flags")), strict=True)}


def _second(buckets: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, told = [], _answers(answers)
        for block, docs in zip(blocks.column("block").to_pylist(), blocks.column("docs").to_pylist(), strict=True):
            x = Block(docs, buckets)
            repeated, _ = x.asked(x.sample, SHORT).told(told)
            passages = Passages(x)
            shared, _ = passages.parts().told(told, buckets)
            rows += _sent(x.asked(x.long(repeated), LONG), block) + _sent(passages.whole(shared), block, buckets) + _sent(x.halves(repeated)[1], block, 2 * buckets)
            rows.append((block % buckets, block, None, _bits(repeated, shared)))
        return pa.Table.from_batches([common.batch(NAMES, rows)])

    return run


def _third(buckets: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, told = [], _answers(answers)
        for block, docs in zip(blocks.column("block").to_pylist(), blocks.column("docs").to_pylist(), strict=True):
            x = Block(docs, buckets)
            repeated, shared = _unbits(told[OWN][1])
            proved, later = x.asked(x.long(repeated), LONG).told(told)
            half, _ = x.halves(repeated)[1].told(told, 2 * buckets)
            rows += _sent(x.asked(x.rest(repeated, proved, later, half)[1], LENGTH), block)
            passages = Passages(x)
            count = passages.counted(shared, passages.whole(shared).told(told, buckets)[0])
            rows.append((block % buckets, block, None, common.pack((_bits(repeated, proved, later, half), count))))
        return pa.Table.from_batches([common.batch(NAMES, rows)])

    return run


def _meet(buckets: int, wide: bool):
    """The names of a bucket, compared; passages and halves have buckets of their own, and only those of halves are short where
    others are wide. What blocks keep for themselves is passed on."""

    def run(group: pa.Table) -> pa.Table:
        rows = [(block, OWN, 0, known) for block, known in zip(group.column("block").to_pylist(), group.column("known").to_pylist(), strict=True) if known is not None]
        blocks = np.array(group.column("block").to_pylist(), np.int64)
        raw = group.column("names").to_pylist()
        order = [int(i) for i in np.argsort(blocks, kind="stable") if raw[i] is not None]
        bucket = group.column("bucket")[0].as_py()
        long = wide and bucket < 2 * buckets
        parts = []
        for i in order:
            one, two = common.unpack(raw[i])
            parts.append((common.unplanes(one, np.uint64), common.unplanes(two, np.uint32)))
        names = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in parts)])
        if long:
            more = np.concatenate([np.empty(0, np.uint32), *(y for _, y in parts)])
            by = np.lexsort((more, names))  # equals stay in the order of their blocks
            same = (names[by][1:] == names[by][:-1]) & (more[by][1:] == more[by][:-1])
        else:
            by = np.argsort(names, kind="stable")
            same = names[by][1:] == names[by][:-1]
        flags = np.zeros((2, len(names)), np.uint8)
        flags[0, by[1:]] = same
        flags[1, by[1:]] = same
        flags[0, by[:-1]] |= same
        at = 0
        for i, own in zip(order, parts, strict=True):
            n = len(own[0])
            rows.append((int(blocks[i]), bucket, digest(*own), np.packbits(flags[:, at : at + n]).tobytes()))
            at += n
        return pa.Table.from_batches([common.batch(FLAGS, rows)])

    return run


def _finish(buckets: int, key: str, kind: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([(key, kind), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary()), ("n_passages", pa.int64())])

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, told = [], _answers(answers)
        for docs in blocks.column("docs").to_pylist():
            x = Block(docs, buckets)
            bits, passages = common.unpack(told[OWN][1])
            known, compared = x.rest(*_unbits(bits))
            gone = x.removed(known, compared, x.asked(compared, LENGTH).told(told)[0])
            for k, a, n, shared in zip(x.keys, x.begin.tolist(), x.lens.tolist(), passages.tolist(), strict=True):
                own = gone[a : a + n]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]).astype(np.int8)))
                spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                rows.append((k, n, int(own.sum()), spans, x.data[a : a + n][~own].tobytes(), shared))
        return pa.Table.from_batches([common.batch(schema, rows)])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its key, n_bytes, n_removed, spans (maximal removed runs, in bytes), kept (the other bytes) and
    n_passages (stretches of over PASSAGE - 1 words that also stand in another document)."""
    common.lean(docs.sparkSession)
    rows = docs.select(key, text)
    kind, sql = common.key_type(rows, key)
    buckets = common.bucket_count(rows)
    blocks = rows.mapInArrow(_blocks(key, text), "block long, docs binary").repartition(buckets, "block")
    names, flags = "bucket int, block long, names binary, known binary", "block long, bucket int, asked long, flags binary"

    def meet(asked: DataFrame, wide: bool) -> DataFrame:
        return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(buckets, wide), flags)

    def with_blocks(answers: DataFrame, f, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, schema)

    one = meet(blocks.mapInArrow(_first(buckets), names), False)
    two = meet(with_blocks(one, _second(buckets), names), True)
    three = meet(with_blocks(two, _third(buckets), names), True)
    return with_blocks(three, _finish(buckets, key, kind), f"`{key}` {sql}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, n_passages long")


BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
COVER = singer(PRIME)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
