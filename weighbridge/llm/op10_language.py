"""Language identification by unigram pieces with all segmentations summed.

The pieces are those of a fixed public vocabulary; their probabilities are learned for each language. The probability of
a word is the sum over all ways to cut it into pieces, by the forward algorithm; words are independent, as no piece
crosses a word, so each distinct word of a task is scored once. A text's score for a language is the sum over its words.
A trie finds the pieces of many words at once, and the sums advance over all these words at once, in logarithms,
so a word may be of any length and no probability is lost.

Training takes labelled rows outside the held-out ones, at most about SAMPLE of each language by a hash of id and text, their
whole texts. Words are counted by language in Spark; starting from equal probabilities, expected piece counts come from the
forward-backward algorithm over distinct words (EPOCHS times) with ADDED to each count.

lang_pred is `und`, with score 0, for a null text or one without a letter. Ties go to the language that sorts first.
score is the posterior probability at equal priors. With no labelled rows all predictions are `und`. Null ids are held
in. Rows that repeat get the same result. Other columns do not matter; lang and ids are never inputs of a prediction.
The model has a number for each piece and language, on the driver and in each task; more than LANGUAGES labels are refused
with an error, as they are no set of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

SAMPLE = 150
FOLDS, HELD_OUT = 4, 2
EPOCHS = 2
ADDED = 0.05
#: Languages that a model may have.
LANGUAGES = 4000
SPACE = "▁"
#: Distinct words whose scores a task keeps, and characters of words that are scored at once.
KNOWN = 300_000
PIECE = 60_000


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Trie:
    """The pieces as a trie in two arrays: the child of a node for a character stands at base[node] + code, and is one if
    owner says so. Node 0 is the root; codes number the characters of the pieces from 1, 0 is any other character."""

    def __init__(self, pieces: list[str]) -> None:
        alphabet = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.longest = max(map(len, pieces), default=0)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, p in enumerate(pieces):
            at = 0
            for c in self.code[[ord(x) for x in p]].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                at = children[at][c]
            ends[at] = i
        size = 2 * len(children) + 2 * len(alphabet) + 16
        free = np.ones(size, bool)
        free[0], low = False, 1
        place, base = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        for node in sorted(range(len(children)), key=lambda n: (-len(children[n]), n)):  # the widest nodes first
            if not children[node]:
                break
            codes = np.array(sorted(children[node]))
            low += int(np.argmax(free[low:]))
            for a in range(max(low, int(codes[0])), size, 1024):  # places of the first child
                fits = a + np.flatnonzero(free[a : a + 1024]) - codes[0]
                fits = fits[fits + codes[-1] < size]
                if len(codes) > 1:
                    fits = fits[free[fits[:, None] + codes].all(axis=1)]
                if len(fits):
                    break
            base[node] = fits[0]
            free[fits[0] + codes] = False
            place[[children[node][c] for c in codes.tolist()]] = fits[0] + codes
        self.base = np.zeros(size + len(alphabet) + 1, np.int32)
        self.owner, self.piece = np.full_like(self.base, -1), np.full_like(self.base, -1)
        self.base[place] = base
        for node, own in enumerate(children):
            self.owner[[place[n] for n in own.values()]] = place[node]
        self.piece[[place[n] for n in ends]] = list(ends.values())

    def arcs(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, last character, piece) of all pieces in the text."""
        codes = self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        at, node = np.flatnonzero(codes), 0
        out = []
        for length in range(1, self.longest + 1):
            child = np.take(self.base, node) + codes[at]
            real = (self.owner[child] == node) & (codes[at] > 0)
            at, node = at[real], child[real]
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            out.append((at[hit] - (length - 1), at[hit], piece[hit].astype(np.int64)))
            inside = at + 1 < len(codes)
            at, node = at[inside] + 1, node[inside]
            if not len(at):
                break
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ordered(values: np.ndarray) -> np.ndarray:
    """The order of small numbers, equals as they were; two bytes each sort in linear time."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


class Lattice:
    """All pieces of many words: arcs between places, of which place 0 of a word stands before its first character. Places
    are numbered by their depth in the word, so the sums of all words advance together."""

    def __init__(self, model: Model, words: list[str]) -> None:
        text = "".join("\n" + SPACE + w for w in words)
        length = np.array([len(w) + 2 for w in words], np.int64)
        first = np.cumsum(length) - length
        depth = np.arange(len(text)) - np.repeat(first, length)
        start, end, piece = model.trie.arcs(text)
        bare = depth > 0  # characters that are no piece on their own
        bare[end[start == end]] = False
        bare = np.flatnonzero(bare)
        start, end, piece = np.append(start, bare) - 1, np.append(end, bare), np.append(piece, np.full(len(bare), len(model.pieces)))
        rank = np.empty(len(text), np.int64)
        rank[ordered(depth)] = np.arange(len(text))
        self.last, self.word = rank[first + length - 1], np.empty(len(text), np.int64)
        self.word[rank] = np.repeat(np.arange(len(words)), length)
        #: places of depth d are those from places[d] up to places[d + 1]
        self.places = np.append(0, np.cumsum(np.bincount(depth)))
        order = ordered(rank[end])
        self.start, self.end, self.piece = rank[start[order]], rank[end[order]], piece[order]

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """For each place, the log of the sum over all ways to get there."""
        out = np.zeros((len(self.word), logs.shape[1]))
        cuts = np.searchsorted(self.end, np.arange(len(self.word) + 1))
        for a, z in zip(self.places[1:-1].tolist(), self.places[2:].tolist(), strict=True):
            arcs = slice(cuts[a], cuts[z])
            x = out[self.start[arcs]] + logs[self.piece[arcs]]
            own = cuts[a:z] - cuts[a]
            top = np.maximum.reduceat(x, own)
            out[a:z] = top + np.log(np.add.reduceat(np.exp(x - top[self.end[arcs] - a]), own))
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """For each place, the log of the sum over all ways from there to the end of the word."""
        out = np.zeros((len(self.word), logs.shape[1]))
        order = ordered(self.start)
        start, end, piece = self.start[order], self.end[order], self.piece[order]
        for a, z in zip(self.places[-2::-1].tolist(), self.places[:0:-1].tolist(), strict=True):
            arcs = slice(*np.searchsorted(start, [a, z]))
            if arcs.start == arcs.stop:
                continue
            x = out[end[arcs]] + logs[piece[arcs]]
            own = np.flatnonzero(np.diff(start[arcs], prepend=-1))
            top = np.maximum.reduceat(x, own)
            of = np.repeat(np.arange(len(own)), np.diff(np.append(own, len(x))))
            out[start[arcs][own]] = top + np.log(np.add.reduceat(np.exp(x - top[of]), own))
        return out


class Model:
    """log probabilities of pieces by language, with one more row for a character that no piece has."""

    def __init__(self, pieces: list[str], langs: list[str]) -> None:
        self.pieces, self.langs = pieces, langs
        self.logs = np.full((len(pieces) + 1, len(langs)), -np.log(len(pieces) + 1))
        self.trie = Trie(pieces)

    def lattices(self, words: list[str]) -> Iterator[tuple[int, int, Lattice]]:
        """(from, to, the lattice of these words), by so many words at once that they have about PIECE characters."""
        upto = np.cumsum([len(w) + 2 for w in words]) // PIECE
        cuts = [*np.flatnonzero(np.diff(upto, prepend=-1)).tolist(), len(words)] if words else [0]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield a, z, Lattice(self, words[a:z])

    def score(self, words: list[str]) -> np.ndarray:
        """log P(word) by language, a row a word."""
        out = np.zeros((len(words), len(self.langs)))
        for a, z, lattice in self.lattices(words):
            out[a:z] = lattice.forward(self.logs)[lattice.last]
        return out

    def learn(self, counts: dict[str, np.ndarray], epochs: int = EPOCHS, added: float = ADDED) -> None:
        """counts: for each word its count in each language."""
        words = list(counts)
        weight = np.array([counts[w] for w in words]).reshape(len(words), len(self.langs))
        for _ in range(epochs):
            expected = np.full_like(self.logs, added)
            for a, _z, x in self.lattices(words):
                ahead, behind = x.forward(self.logs), x.backward(self.logs)
                of = x.word[x.end]
                share = weight[a + of] * np.exp(ahead[x.start] + self.logs[x.piece] + behind[x.end] - ahead[x.last[of]])
                for k in range(len(self.langs)):
                    expected[:, k] += np.bincount(x.piece, share[:, k], len(expected))
            self.logs = np.log(expected / expected.sum(axis=0))


def train(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows of docs that have a language; the caller leaves out the held-out ones."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    # one row more than there may be, so that the driver is safe whatever the column holds
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).take(LANGUAGES + 1)}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    model = Model(pieces, langs)
    if not langs:
        return model
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "k", "t"), 11) / F.lit(float(2**53))
    words = rows.where(draw < share[F.col("lang")]).select("lang", F.explode(F.regexp_extract_all("t", F.lit(common.WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    at = {k: i for i, k in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for r in counted.toLocalIterator():  # the words of a bounded sample
        counts.setdefault(r["word"], np.zeros(len(langs)))[at[r["lang"]]] += r["n"]
    # each language weighs the same, however much of it the sample has
    total = np.maximum(sum(counts.values(), np.zeros(len(langs))), 1.0)
    model.learn({w: n * (1e5 / total) for w, n in counts.items()})
    return model


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its key, lang_pred and score."""
    common.lean(docs.sparkSession)
    rows = docs.select(key, text)
    kind, sql = {"bigint": (pa.int64(), "long"), "int": (pa.int32(), "int"), "string": (pa.string(), "string")}[dict(rows.dtypes)[key]]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages
    schema = pa.schema([(key, kind), ("lang_pred", pa.string()), ("score", pa.float64())])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        own = shared.value
        langs = own.langs
        letter = regex.compile(r"\p{L}")
        known: dict[bytes, int] = {}
        table = np.zeros((0, len(langs)))
        for _, keys, texts in common.blocks_of(batches, key, text):
            said = np.array([bool(langs) and letter.search(t) is not None for t in texts], bool)
            words: list[bytes] = []
            ends = [0]
            for t, any_letter in zip(texts, said, strict=True):
                if any_letter:
                    words += t.encode().split()
                ends.append(len(words))
            coded = pa.array(words, pa.binary()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > KNOWN:
                known, table = {}, table[:0]
            new = [w for w in distinct if w not in known]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            table = np.concatenate([table, own.score([w.decode() for w in new])])
            rows_of = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
            out = []
            for n, k in enumerate(keys):
                if not said[n]:
                    out.append((k, "und", 0.0))
                    continue
                total = table[rows_of[ends[n] : ends[n + 1]]].sum(axis=0)
                best = int(np.argmax(total))
                out.append((k, langs[best], float(1.0 / np.exp(total - total[best]).sum())))
            yield common.batch(schema, out)

    return rows.mapInArrow(run, f"`{key}` {sql}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    model = train(docs.where(~held), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
