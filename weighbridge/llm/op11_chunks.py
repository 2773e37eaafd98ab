"""Byte-pair encoding and decoding that encodes content-defined chunks once, wherever they are, and repairs their joins.

1. Documents are cut into chunks where a rolling hash of the last 32 bytes says so. Where documents share a passage, they
   share the cuts and so the chunks within it. Special tokens are cut out first: what stands between two is encoded on its own.
2. Each block of documents tells the 128-bit digests of its distinct chunks. Digests that several blocks tell are shared:
   one of the blocks, drawn by hash, encodes the chunk, and its ids go to the others. Only digests, and ids of shared
   chunks, are exchanged; a chunk in a third of all documents is one row a block.
3. A block encodes what nobody shares in runs of chunks that adjoin, repeated ones once, and puts the ids in order.
4. At a join both sides were encoded without the other. The text around it is encoded again, from the last place before
   it to the first place after it where no match of the split pattern can cross (a space or line break after a visible
   ASCII character), and both sides must have a token's edge there; if not, or if the stretches of two joins meet, the stretch
   grows on, to the ends of what special tokens cut out at most. So the ids are those of the whole text.
5. Decoding looks every id up in the table of token bytes, whose size is that of the vocabulary.

A null text counts as empty: no ids, and decodes to the empty text. Rows that repeat are kept as they are; other columns do not
matter, whatever they are called. The input must be a plan that gives the same rows in the same partitions when it is run
again, such as a scan of a table: blocks of another content stop with an error.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

#: A cut needs this many zero bits at the top of the 32-bit rolling hash, so chunks are about LEAST + 2 ** BITS bytes.
BITS, LEAST = 10, 256
#: Bytes that are encoded at once, and rows decoded at once.
AT_ONCE, ROWS = 1 << 21, 64
#: Fixed: how byte-level pre-tokenization cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in these ranges are of the same classes in all of Unicode's recent versions. The library may see others in another
#: way than the pattern above, so chunks that hold one go to the library whole.
STEADY = ((0x00, 0x52F), (0x20A0, 0xA7CD))
#: Words whose ids a worker remembers: so many of the latest, and as many before.
MEMORY = 1 << 17
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("text", pa.binary()), ("mark", pa.binary())])


@functools.cache
def splitter() -> tuple[Callable, Callable]:
    """(words of a text, whether it holds a character that is not steady). The classes are written out, since the standard
    library's expressions, which know none by name, take half the time."""
    import regex

    every = "".join(chr(c) for a, z in STEADY for c in range(a, z + 1))
    named = {name: "".join(re.escape(c) for c in regex.findall(name, every)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    pattern = WORDS.replace(r"\S", rf"[^{named[r'\s']}]").replace(r"[^\s", rf"[^{named[r'\s']}").replace(r"\s", rf"[{named[r'\s']}]")
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(f" ?{name}", f" ?[{named[name]}]").replace(name, named[name])
    return re.compile(pattern).findall, re.compile("[^" + "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in STEADY) + "]").search


class Vocabulary:
    """A tokenizer file: the library's encoder, and the bytes of each id."""

    def __init__(self, spec: str) -> None:
        read = json.loads(spec)
        added = read["added_tokens"]
        if read["model"]["type"] != "BPE" or read.get("normalizer") or (read["pre_tokenizer"] or {}).get("type") != "ByteLevel" or read["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer and a prefixed space is known")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in added):
            raise ValueError("only special tokens that match as they stand are known")
        self.spec = spec
        self.special = {t["content"].encode(): t["id"] for t in added}
        letters = byte_letters()
        pieces = {i: bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode() for word, i in read["model"]["vocab"].items()}
        pieces |= {i: content for content, i in self.special.items()}
        self.pieces = [pieces.get(i) for i in range(max(pieces, default=-1) + 1)]
        self.lengths = np.array([len(p or b"") for p in self.pieces], np.int64)
        self._engine = self._model = None
        self._ids: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._letters = {b: c for c, b in letters.items()}

    def engine(self):
        if self._engine is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
            from tokenizers import Tokenizer

            self._engine = Tokenizer.from_str(self.spec)
            self._engine.no_truncation()
            self._engine.no_padding()
            self._model = self._engine.model
        return self._engine

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_engine": None, "_model": None, "_ids": {}, "_older": {}}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, on its own."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size + len(texts[at]) <= AT_ONCE):
                held.append(texts[at].decode())
                size += len(texts[at])
                at += 1
            out += self._encode(held)
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each distinct word of the texts is looked up once, and encoded by the library's model if it isn't remembered."""
        split, newer = splitter()
        library = self.engine().encode_batch_fast
        words: list[str] = []
        upto = [0]
        whole = []
        for t in texts:
            if newer(t):
                whole.append(t)
            else:
                words += split(t)
            upto.append(len(words))
        table = pa.array(words, pa.string()).dictionary_encode()
        own = [self._word(w) for w in table.dictionary.to_pylist()]
        sizes = np.array([len(i) for i in own], np.int64)
        flat = np.array([i for ids in own for i in ids], np.int32)
        codes = table.indices.to_numpy()
        lengths = sizes[codes]
        ids = flat[common.ragged((np.cumsum(sizes) - sizes)[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.array(upto)]
        wholes = iter(library(whole, add_special_tokens=False))
        return [np.array(next(wholes).ids, np.int32) if newer(t) else ids[a:z] for t, a, z in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self._ids.get(word)
        if ids is None:
            ids = self._older.get(word)
            if ids is None:
                ids = tuple(t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._letters)))
            if len(self._ids) >= MEMORY:
                self._ids, self._older = {}, self._ids
            self._ids[word] = ids
        return ids

    def segments(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, -1) of what special tokens leave, and (start, end, id) of each of these, leftmost and longest first."""
        begin = 0
        while True:
            hits = [(at, -len(s), s) for s in self.special if (at := text.find(s, begin)) >= 0]
            if not hits:
                break
            at, _, s = min(hits)
            if at > begin:
                yield begin, at, -1
            begin = at + len(s)
            yield at, begin, self.special[s]
        if begin < len(text):
            yield begin, len(text), -1


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for themselves, then the others in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


_TABLE = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def candidates(data: np.ndarray) -> np.ndarray:
    """Places where the rolling hash of the 32 bytes before allows a cut, at the start of a code point. The hash of a byte
    and those before it, each shifted once more, is summed over 2, 4, 8, 16, 32 bytes."""
    h = _TABLE[data]
    for w in (1, 2, 4, 8, 16):
        shifted = h[:-w] << np.uint32(w)
        h[w:] += shifted
    at = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    at = at[at < len(data)]
    while len(at) and len(inner := np.flatnonzero(data[at] >> 6 == 2)):  # within a code point
        at[inner] += 1
        at = np.unique(at[at < len(data)])
    return at


def chunked(start: int, end: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) in chunks of LEAST bytes at least, the last one excepted."""
    out, begin = [], start
    for c in cuts[np.searchsorted(cuts, start + LEAST) : np.searchsorted(cuts, end)].tolist():
        if c - begin >= LEAST:
            out.append((begin, c))
            begin = c
    out.append((begin, end))
    return out


def parts(text: bytes, lengths: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """(document, chunks, -1) for each segment of each document of a block, and (document, [], id) for each special token."""
    cuts = candidates(np.frombuffer(text, np.uint8)) if text else np.empty(0, np.int64)
    at = 0
    for n, length in enumerate(lengths.tolist()):
        for a, z, special in vocabulary.segments(text[at : at + length]):
            yield (n, [], special) if special >= 0 else (n, chunked(at + a, at + z, cuts), -1)
        at += length


def safe_before(text: bytes, start: int, at: int) -> int:
    """The last place in [start, at] where no match of the pattern crosses, whatever is around: before a space or line break
    that follows a visible ASCII character; else start."""
    p = at
    while p > start:
        p = max(text.rfind(b" ", start, p + 1), text.rfind(b"\n", start, p + 1))
        if p <= start:
            return start
        if 0x21 <= text[p - 1] <= 0x7E:
            return p
        p -= 1
    return start


def safe_after(text: bytes, at: int, end: int) -> int:
    """The first such place in [at, end]; else end."""
    p = max(at, 1)
    while p < end:
        hits = [x for x in (text.find(b" ", p, end), text.find(b"\n", p, end)) if x >= 0]
        if not hits:
            return end
        p = min(hits)
        if p > 0 and 0x21 <= text[p - 1] <= 0x7E:
            return p
        p += 1
    return end


def stretches(text: bytes, units: list[tuple[int, int]], edge) -> list[tuple[int, int]]:
    """What is to be encoded again around the joins of a segment's units, apart and in order. edge(n, place) tells whether
    unit n has a token's edge at a place."""
    start, end = units[0][0], units[-1][1]
    out: list[tuple[int, int]] = []
    for n in range(1, len(units)):
        join = units[n][0]
        if out and join < out[-1][1]:
            continue  # within the stretch before
        low = safe_before(text, start, join - 1)
        while low > start and not edge(low):
            low = safe_before(text, start, low - 1)
        high = safe_after(text, join + 1, end)
        while high < end and not edge(high):
            high = safe_after(text, high + 1, end)
        if out and low < out[-1][1]:
            low = out.pop()[0]
        out.append((low, high))
    return out


class Encoder:
    """Ids of the documents of a block from ids of shared chunks and what it encodes itself."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def run(self, text: bytes, lengths: np.ndarray, shared: dict[int, np.ndarray]) -> list[np.ndarray]:
        """shared: ids by the number of a distinct chunk of this block."""
        told = list(parts(text, lengths, self.vocabulary))
        number: dict[bytes, int] = {}
        times: list[int] = []
        numbered = []
        for _, chunks, _ in told:
            own = [number.setdefault(text[a:z], len(number)) for a, z in chunks]
            for k in own:
                if k == len(times):
                    times.append(0)
                times[k] += 1
            numbered.append(own)
        # units: reused chunks alone, others in runs
        known: dict[bytes, np.ndarray] = {}
        units: list[list[tuple[int, int]]] = []
        wanted: dict[bytes, None] = {}
        for (_, chunks, _), own in zip(told, numbered, strict=True):
            made: list[tuple[int, int]] = []
            open_run = False
            for (a, z), k in zip(chunks, own, strict=True):
                if k in shared or times[k] > 1:
                    made.append((a, z))
                    open_run = False
                    if k in shared:
                        known[text[a:z]] = shared[k]
                elif open_run:
                    made[-1] = (made[-1][0], z)
                else:
                    made.append((a, z))
                    open_run = True
            units.append(made)
            for a, z in made:
                wanted[text[a:z]] = None
        todo = [t for t in wanted if t not in known]
        known |= zip(todo, self.vocabulary.encode(todo), strict=True)
        upto = {t: np.concatenate([[0], np.cumsum(self.vocabulary.lengths[ids])]) for t, ids in known.items()}
        plans = [stretches(text, made, self._edges(text, made, upto)) if len(made) > 1 else [] for made in units]
        again = dict.fromkeys(text[a:z] for plan in plans for a, z in plan)
        again = dict(zip(again, self.vocabulary.encode(list(again)), strict=True))
        out: list[list[np.ndarray]] = [[] for _ in range(len(lengths))]
        for (n, _, special), made, plan in zip(told, units, plans, strict=True):
            if special >= 0:
                out[n].append(np.array([special], np.int32))
                continue
            at = made[0][0]
            k = 0
            for low, high in [*plan, (made[-1][1], made[-1][1])]:
                while at < low:  # from the units themselves up to the stretch
                    while made[k][1] <= at:
                        k += 1
                    a, z = made[k]
                    own = upto[text[a:z]]
                    stop = min(low, z)
                    i, j = np.searchsorted(own, [at - a, stop - a])
                    if own[i] != at - a or own[j] != stop - a:
                        raise RuntimeError("a stretch ends within a token")
                    out[n].append(known[text[a:z]][i:j])
                    at = stop
                if high > low:
                    out[n].append(again[text[low:high]])
                    at = high
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    @staticmethod
    def _edges(text: bytes, made: list[tuple[int, int]], upto: dict[bytes, np.ndarray]):
        begins = np.array([a for a, _ in made])

        def edge(place: int) -> bool:
            a, z = made[int(np.searchsorted(begins, place, side="right")) - 1]
            own = upto[text[a:z]]
            i = int(np.searchsorted(own, place - a))
            return i < len(own) and own[i] == place - a

        return edge


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its key, n_tokens long and ids array<int>, as the library encodes by the file at path."""
    spark = docs.sparkSession
    common.lean(spark)
    docs, (own_key, own_text) = common.apart(docs, key, text)
    rows = docs.select(own_key, own_text)
    kind, sql = common.key_type(rows, own_key)
    with open(path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(file.read()))  # as large as the vocabulary, whatever the input

    @common.frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, texts in common.blocks_of(batches, own_key, own_text):
            raw = [t.encode() for t in texts]
            data = b"".join(raw)
            docs_ = common.pack((keys, np.array([len(t) for t in raw], np.int64)))
            yield common.batch(BLOCK, [(block, docs_, common.pack(data, 3), blake2b(data, digest_size=16).digest())])

    @common.frugal
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "n", "mark", "high", "low"]
        for b in batches:
            for block, docs_, blob, mark in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "text", "mark")), strict=True):
                data = common.unpack(blob)
                seen: dict[bytes, None] = dict.fromkeys(data[a:z] for _, chunks, _ in parts(data, common.unpack(docs_)[1], vocabulary.value) for a, z in chunks)
                if seen:
                    two = np.frombuffer(b"".join(blake2b(c, digest_size=16).digest() for c in seen), np.int64).reshape(-1, 2)
                    n = len(two)
                    whole = [np.full(n, block, np.int64), np.arange(n, dtype=np.int32), pa.array([mark] * n, pa.binary()), two[:, 0].copy(), two[:, 1].copy()]
                    for a in range(0, n, 8192):
                        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 8192]) if isinstance(x, np.ndarray) else x[a : a + 8192] for x in whole], names)

    def chunks_of(table: pa.Table) -> tuple[bytes, np.ndarray, list]:
        keys, lengths = common.unpack(table.column("docs")[0].as_py())
        return common.unpack(table.column("text")[0].as_py()), lengths, keys

    def publish(blocks: pa.Table, owned: pa.Table) -> pa.Table:
        schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("ids", pa.binary())])
        if not (blocks.num_rows and owned.num_rows):
            return schema.empty_table()
        data, lengths, _ = chunks_of(blocks)
        same(blocks, owned)
        seen = list(dict.fromkeys(data[a:z] for _, chunks, _ in parts(data, lengths, vocabulary.value) for a, z in chunks))
        ids = vocabulary.value.encode([seen[n] for n in owned.column("n").to_pylist()])
        return pa.table([owned.column("high"), owned.column("low"), pa.array([common.planes(i) for i in ids], pa.binary())], schema=schema)

    def same(blocks: pa.Table, told: pa.Table) -> None:
        if told.column("mark")[0].as_py() != blocks.column("mark")[0].as_py():
            raise RuntimeError("a block differs from what was told of it: the input gave other rows when it was read again")

    def assemble(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = pa.schema([(own_key, kind), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
        if not blocks.num_rows:
            return out.empty_table()
        data, lengths, keys = chunks_of(blocks)
        if replies.num_rows:
            same(blocks, replies)
        shared = {n: common.unplanes(i, np.int32) for n, i in zip(replies.column("n").to_pylist(), replies.column("ids").to_pylist(), strict=True)}
        ids = Encoder(vocabulary.value).run(data, lengths, shared)
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
        return pa.table([pa.array(keys, kind), pa.array(np.diff(ends), pa.int64()), lists], schema=out)

    blocks = rows.mapInArrow(pack, "block long, docs binary, text binary, mark binary").repartition("block")
    told = common.written(blocks.mapInArrow(digests, "block long, n int, mark binary, high long, low long"), "chunks")
    drawn = F.struct(F.xxhash64("block", "high").alias("draw"), "block", "n", "mark")
    held = told.groupBy("high", "low").agg(F.min(drawn).alias("owner"), F.count("*").alias("blocks")).where("blocks > 1")
    owned = held.select("owner.block", "owner.n", "owner.mark", "high", "low")
    encoded = common.written(blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(publish, "high long, low long, ids binary"), "shared")
    replies = told.join(encoded, ["high", "low"]).select("block", "n", "mark", "ids")
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(assemble, f"{own_key} {sql}, n_tokens long, ids array<int>")
    return out.withColumnRenamed(own_key, key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", digests: bool = False) -> DataFrame:
    """Adds decoded string, the text of the ids of each row, special tokens included; bytes that are no UTF-8 become U+FFFD, as
    the library has it. With digests, ids_sha256 (decimal, comma-joined) and decoded_sha256 stand in place of the ids. Null ids
    decode to nothing; an id outside the vocabulary is an error."""
    common.lean(encoded.sparkSession)
    with open(path, encoding="utf-8") as file:
        table = encoded.sparkSession.sparkContext.broadcast(Vocabulary(file.read()))
    kept = [c for c in encoded.columns if not (digests and c == ids)]
    added = ["ids_sha256", "decoded_sha256"] if digests else ["decoded"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, lens = table.value.pieces, table.value.lengths
        flat = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)
        starts = np.cumsum(lens) - lens
        known = np.array([p is not None for p in pieces], bool)
        decimals = [b"%d," % i for i in range(len(pieces))]
        digits, wide = np.frombuffer(b"".join(decimals), np.uint8), np.array([len(d) for d in decimals], np.int64)
        begins = np.cumsum(wide) - wide
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            column = b.column(ids)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values) and not (values.min() >= 0 and values.max() < len(pieces) and known[values].all()):
                raise ValueError("an id is not in the vocabulary")
            counts = np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)
            data = flat[common.ragged(starts[values], lens[values])].tobytes()
            ends = np.concatenate([[0], np.cumsum(counts)])
            cuts = np.concatenate([[0], np.cumsum(lens[values])])[ends]
            texts = [data[a:z].decode(errors="replace") for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            if digests:
                said = digits[common.ragged(begins[values], wide[values])].tobytes()
                shown = np.concatenate([[0], np.cumsum(wide[values])])[ends]
                more = [pa.array([sha256(said[a : max(a, z - 1)]).hexdigest() for a, z in zip(shown[:-1], shown[1:], strict=True)], pa.string()), pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            else:
                more = [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *more], [*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in kept), *(f"{c} string" for c in added)])
    return encoded.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path, digests=True)
