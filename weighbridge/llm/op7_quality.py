"""Quality rules: per-text counts, and lines that too many documents of a host share.

Lines are normalised (ASCII letters to lower case, digits to 0, white space to one blank) and hashed. For each host the
distinct documents of a line are counted, copies of one text as one document; counts are partial before the shuffle, so
a line that a third of all documents share is a row a task and no group is gathered. A line over MAX_DOCS is removed
from all documents of the host but the one with the smallest id. A document whose remaining words are under MIN_WORDS
or under KEEP_SHARE of its words is rejected, as is one that fails the per-text rules. judge() gives the verdicts and
what is to be removed, clean() the kept documents without these lines.

Texts that are null or empty have no words, so they fail the base rules. A null host is a host of its own; a null id is
the largest. Rows that repeat get the same verdict. Other columns do not matter. The result has no row for no input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

MAX_DOCS = 40
MIN_WORDS = 10
KEEP_SHARE = 0.25
#: With this seed the mark of a text and the hash of a line are what the built-in xxhash64 gives.
MARK_SEED = 42
REPEATED_PER_CENT = 20
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
NORMAL = bytes.maketrans(UPPER.encode(), LOWER.encode())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 5 - max(i, upto)
            upto = i + 5
    return total


def counts(text: str) -> tuple[tuple[int, ...], list[tuple[int, int]]]:
    """The five counts, and for each distinct normalised line its hash and how many words its occurrences have."""
    raw = text.encode()
    words = raw.split()
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            h = signed(xxhash.xxh64_intdigest(b" ".join(own).translate(NORMAL), MARK_SEED))
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(words), chars, symbols, dup, repeated_words(words)), list(lines.items())


def _measure(key: str, text: str, host: str, kind: pa.DataType):
    line = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
    schema = pa.schema([(key, kind), ("host", pa.string()), ("of", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("lines", line)])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, h, t in zip(*(b.column(c).to_pylist() for c in (key, host, text)), strict=True):
                own, lines = counts(t or "")
                rows.append((k, h, signed(xxhash.xxh64_intdigest((t or "").encode(), MARK_SEED)), *own, [{"line": x, "words": n} for x, n in lines]))
            yield common.batch(schema, rows)

    return run


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Per row of docs: its key, host, mark (xxhash64 of its text), the counts, n_removed_words, base_failed, kept and
    removed, the hashes of the lines that are to be removed (null for none)."""
    common.lean(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(host).cast("string").alias(host), F.col(text))
    kind, sql = {"bigint": (pa.int64(), "long"), "int": (pa.int32(), "int"), "string": (pa.string(), "string")}[dict(rows.dtypes)[key]]
    schema = f"`{key}` {sql}, host string, of long, {', '.join(f'{c} long' for c in COUNTS)}, lines array<struct<line: long, words: long>>"
    measured = common.written(rows.mapInArrow(_measure(key, text, host, kind), schema), "quality")
    lines = measured.select("host", "of", F.col(key).alias("id"), F.inline("lines"))
    # one row for each text that has the line; the smallest id of its copies
    texts = lines.groupBy("host", "line", "of").agg(F.min(F.col("id")).alias("id"))
    hot = texts.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("id").alias("first")).where(F.col("docs") > max_docs)
    hot = hot.select(F.col("host").alias("h"), F.col("line").alias("l"), "first")
    met = lines.join(hot, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).where(~F.col("id").eqNullSafe(F.col("first")))
    gone = met.groupBy("host", "of", "id").agg(F.collect_set(F.struct("line", "words")).alias("cut"))  # rows that repeat count once
    lost = F.aggregate("cut", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    gone = gone.select(F.col("host").alias("h"), F.col("of").alias("o"), F.col("id").alias("i"), lost.alias("lost"), F.col("cut")["line"].alias("removed"))
    out = measured.join(gone, F.col("host").eqNullSafe(F.col("h")) & (F.col("of") == F.col("o")) & F.col(key).eqNullSafe(F.col("i")), "left")
    lost = F.coalesce(F.col("lost"), F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PER_CENT * F.col("n_words"))
    left = F.col("n_words") - lost
    fine = (left >= MIN_WORDS) & (left >= F.lit(keep_share) * F.col("n_words"))
    return out.select(key, "host", F.col("of").alias("mark"), *COUNTS, lost.alias("n_removed_words"), failed.alias("base_failed"), (~failed & fine).alias("kept"), "removed")


def reject(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **how) -> DataFrame:
    """docs without the rows that are not kept; the columns are those of docs."""
    names = docs.columns
    docs, (key, text, host) = common.apart(docs, key, text, host)
    out = judge(docs, key, text, host, **how).where(~F.col("kept")).select(F.col(key).alias("_i"), F.col("host").alias("_h"), F.col("mark").alias("_m")).distinct()
    out = common.small(common.written(out, "rejected"), 128)
    same = docs[key].eqNullSafe(F.col("_i")) & docs[host].cast("string").eqNullSafe(F.col("_h")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_m"))
    return docs.join(out, same, "left_anti").toDF(*names)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", count: str = "n_chars", **how) -> DataFrame:
    """The rows of docs that are kept, each text without the lines that its host has in too many documents; the columns are
    those of docs. count, where docs has it, is the length of the new text where lines were removed."""
    given = docs.columns
    docs, (key, text, host, count) = common.apart(docs, key, text, host, count)
    out = judge(docs, key, text, host, **how).where(~F.col("kept") | F.col("removed").isNotNull())
    out = out.select(F.col(key).alias("_i"), F.col("host").alias("_h"), F.col("mark").alias("_m"), F.col("kept").alias("_k"), F.when(F.col("kept"), F.col("removed")).alias("_r"))
    out = common.written(out.dropDuplicates(["_i", "_h", "_m"]), "cleaned")
    same = docs[key].eqNullSafe(F.col("_i")) & docs[host].cast("string").eqNullSafe(F.col("_h")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_m"))
    # rows to be changed are a share of all rows, so they are joined as at size everywhere: by a shuffle that can spill
    joined = docs.join(out.hint("merge"), same, "left").where(F.coalesce(F.col("_k"), F.lit(True)))
    normal = lambda line: F.translate(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), UPPER, LOWER)
    left = F.filter(F.split(docs[text], "\n", -1), lambda line: ~F.array_contains(F.col("_r"), F.xxhash64(normal(line))))
    new = F.when(F.col("_r").isNull(), docs[text]).otherwise(F.array_join(left, "\n"))
    names = docs.columns
    out = joined.select(*(docs[c] for c in names if c != text), new.alias(text), F.col("_r").isNotNull().alias("_c"))
    if count in names:
        out = out.withColumn(count, F.when(F.col("_c"), F.length(text).cast(docs.schema[count].dataType)).otherwise(F.col(count)))
    return out.select(*names).toDF(*given)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l0 AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, host, text, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM l0),
l1 AS (SELECT doc_id, host, text, line, len(lw) AS n,
              regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm
       FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM l1 GROUP BY doc_id),
hot AS (SELECT host, norm, min(doc_id) AS first FROM l1 GROUP BY host, norm HAVING count(DISTINCT text) > {MAX_DOCS}),
gone AS (SELECT l1.doc_id, sum(n) AS lost FROM l1 JOIN hot USING (host, norm) WHERE l1.doc_id <> hot.first GROUP BY l1.doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
often AS (SELECT doc_id, win FROM g GROUP BY doc_id, win HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT g.doc_id, unnest(generate_series(g.i, g.i + 4)) AS p FROM g JOIN often USING (doc_id, win)) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PER_CENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - lost >= {MIN_WORDS} AND n_words - lost >= {KEEP_SHARE} * n_words AS kept
FROM f
"""
