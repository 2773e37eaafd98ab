"""Lines and records of text files by their place in the file, read by many tasks.

Spark hands out a file in splits; a task knows the place of a line in its split only. Splits are therefore summed up first, a
row each, and prefixes over these rows tell where each split begins: how many lines are before it, and, for quoted CSV, whether
it begins within a quoted field and how many records are before it. Only rows of splits are ordered; texts stay where they
are read, apart from the one record that a split begins and another ends.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighbridge.ship import ship
from weighbridge.sources import shared

#: Bytes of a row of a split in a broadcast, its path included.
SPLIT_BYTES = 512
BATCH = 128


def lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(path, split, at, value): lines in the order of the file within a split. at counts within a task."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def _upto(n: str, window) -> Column:
    return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, ordinal, value): the number of each line in its file, from 1, and over all files by path, from 0."""
    rows = lines(spark, path)
    held = rows.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    begun = held.withColumns({"before": _upto("n", Window.partitionBy("path").orderBy("split")), "all": _upto("n", Window.orderBy("path", "split"))})
    begun = shared.small(shared.written(begun.withColumnsRenamed({"path": "p", "split": "s"}), "splits"), SPLIT_BYTES)
    place = F.col("at") - F.col("first")
    inside = F.when(place.between(0, F.col("n") - 1), place).otherwise(F.raise_error(F.concat(F.lit("a split was read in another order: "), "path")))
    return rows.join(begun, (F.col("path") == F.col("p")) & (F.col("split") == F.col("s"))).select("path", (F.col("before") + inside + 1).alias("line"), (F.col("all") + inside).alias("ordinal"), "value")


def batched(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds batch: rows by ordinal in batches of exactly `size`, but for the last."""
    return rows.withColumn("batch", F.expr(f"ordinal div {size}"))


def judged_lines(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds problem: `invalid JSON`, `expected a JSON object`, null for an object; blank lines are left out."""
    read = F.try_parse_json(value)
    some = rows.where(F.trim(F.translate(value, "\t\r\n\f\v", "     ")) != "")
    return some.withColumn("problem", F.when(read.isNull(), "invalid JSON").when(~F.startswith(F.schema_of_variant(read), F.lit("OBJECT")), "expected a JSON object"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with path, line and ordinal; the first bad line that a task meets is an error that names path and line."""
    rows = judged_lines(numbered(spark, path))
    fine = F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("problem"))))
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return rows.select("path", "line", "ordinal", F.from_json(fine, kind).alias("r")).select("path", "line", "ordinal", "r.*")


def within(line: str, inside: bool) -> bool:
    """Whether the end of a line of CSV is within a quoted field, given whether its start is."""
    if '"' not in line:
        return inside
    i = 0
    while True:
        if not inside and line[i : i + 1] == '"':
            inside, i = True, i + 1
        if inside:
            i = line.find('"', i)
            if i < 0:
                return True
            if line[i + 1 : i + 2] == '"':
                i += 2
                continue
            inside, i = False, i + 1
        i = line.find(",", i)  # quotes that do not begin a field stand for themselves
        if i < 0:
            return False
        i += 1


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of each split of a task, one split after another."""
    from itertools import chain, groupby

    rows = chain.from_iterable(b.to_pylist() for b in batches)
    yield from groupby(rows, key=lambda r: (r["path"], r["split"]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for a start outside and within a quoted field: whether its end is within, how many records begin, and
    the place of the last that does."""
    for (path, split), rows in _groups(batches):
        ends, begun, last, n, first = [False, True], [0, 0], [-1, -1], 0, None
        for r in rows:
            line, first = r["value"], r["at"] if first is None else first
            for s in (0, 1):
                if not ends[s] and not _blank(line):
                    begun[s] += 1
                    last[s] = n
                ends[s] = within(line, ends[s])
            n += 1
        yield pa.RecordBatch.from_pylist([{"p": path, "s": split, "first": first, "n": n, "end0": ends[0], "end1": ends[1], "begun0": begun[0], "begun1": begun[1], "last0": last[0], "last1": last[1]}], schema=_SUMS)


_SUMS = pa.schema([("p", pa.string()), ("s", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()), ("begun0", pa.int64()), ("begun1", pa.int64()), ("last0", pa.int64()), ("last1", pa.int64())])


def _starts(sums: DataFrame) -> DataFrame:
    """For each split where it begins: within a quoted field or not, lines and records before it. A split whose two ends agree
    forgets its start; among those after it each either keeps or swaps, so the state is a parity since then."""
    order = Window.partitionBy("p").orderBy("s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("end0") & ~F.col("end1")
    known = sums.withColumn("agree", F.col("end0") == F.col("end1")).withColumn("era", F.sum(F.col("agree").cast("long")).over(order))
    era = Window.partitionBy("p", "era").orderBy("s")
    flips = F.sum((swaps & ~F.col("agree")).cast("long")).over(era)  # up to this split, since the last that forgets
    settled = F.first(F.when(F.col("agree"), F.col("end0")), ignorenulls=True).over(era.rowsBetween(Window.unboundedPreceding, 0))
    ended = known.withColumn("ends", F.coalesce(settled, F.lit(False)) != (flips % 2 == 1))
    state = F.coalesce(F.lag("ends").over(order), F.lit(False))
    of = lambda name: F.when(F.col("state"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    told = ended.withColumn("state", state).withColumns({"begun": of("begun"), "last": of("last"), "before": _upto("n", order)})
    begins = F.when(F.col("last") >= 0, F.col("before") + F.col("last") + 1)
    return told.select("p", "s", "first", "n", "state", "before", _upto("begun", order).alias("records"), F.last(begins, ignorenulls=True).over(before).alias("open"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of those that are not whole in a split, with the file's row number (from 1, the header's), and the
    number of the record's first line."""
    out = pa.schema([("path", pa.string()), ("row", pa.int64()), ("line", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
    for (path, split), rows in _groups(batches):
        held: list[str] = []
        done: list[dict] = []
        size = 0
        inside = None
        for r in rows:
            if inside is None:
                inside, row, place = r["state"], r["records"], r["before"]
                line, whole = (r["open"], False) if inside else (None, True)
            if r["at"] - r["first"] != place - r["before"]:
                raise RuntimeError(f"a split was read in another order: {path}")
            place += 1
            text = r["value"]
            if not inside:
                if _blank(text):
                    continue
                row, line, whole = row + 1, place, True
            held.append(text)
            inside = within(text, inside)
            if not inside:
                done.append({"path": path, "row": row, "line": line, "part": split, "whole": whole, "text": "\n".join(held)})
                size += len(done[-1]["text"])
                held = []
                if size > 1 << 20 or len(done) >= 4096:
                    yield pa.RecordBatch.from_pylist(done, schema=out)
                    done, size = [], 0
        if held:
            done.append({"path": path, "row": row, "line": line, "part": split, "whole": False, "text": "\n".join(held)})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, line, text) of each record of CSV files, the header's row being 1; blank lines are no records. A quoted field
    that never ends goes on to the end of its file."""
    ship(spark)
    rows = lines(spark, path, "\n")
    sums = rows.select("path", "split", "at", "value").mapInArrow(_summed, "p string, s long, first long, n long, end0 boolean, end1 boolean, begun0 long, begun1 long, last0 long, last1 long")
    starts = shared.written(_starts(sums), "splits")
    few = shared.small(starts, SPLIT_BYTES)
    placed = rows.join(few, (F.col("path") == F.col("p")) & (F.col("split") == F.col("s"))).drop("p", "s", "n")
    if few is starts:  # else rows stay where they are, in their order
        placed = placed.repartition("path", "split").sortWithinPartitions("path", "split", "at")
    told = placed.mapInArrow(_cut, "path string, row long, line long, part long, whole boolean, text string")
    pieces = told.where("not whole").groupBy("path", "row").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return told.where("whole").select("path", "row", "line", "text").unionByName(pieces)


def header(rows: DataFrame) -> list[str]:
    """The names in the headers of all files of records(), which must be the same and not repeat."""
    line = F.regexp_replace("text", r"^\ufeff|\r$", "")
    found = rows.where("row = 1").select(line.alias("text")).distinct().take(2)
    if len(found) > 1:
        raise ValueError("files have different headers")
    names = next(csv.reader([found[0][0]]), []) if found else []
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"a column name repeats: {names}")
    return names


def read_csv(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """CSV with a header, all columns text, missing values empty; with places also path, row and line, as _path, _row, _line.
    Values beyond the header's are left out. Split files are read by as many tasks as they have splits."""
    rows = records(spark, path)
    names = header(rows)
    kinds = pa.schema([("_path", pa.string()), ("_row", pa.int64()), ("_line", pa.int64()), *((f"c{n}", pa.string()) for n in range(len(names)))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            fields = []
            for text in b.column("text").to_pylist():
                found = next(csv.reader(io.StringIO(text, newline="")), [])
                fields.append((found + [""] * len(names))[: len(names)])
            columns = list(zip(*fields, strict=True)) if fields else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("row"), b.column("line"), *(pa.array(c, pa.string()) for c in columns)], schema=kinds)

    schema = ", ".join(["_path string", "_row long", "_line long", *(f"c{n} string" for n in range(len(names)))])
    out = rows.where("row > 1").mapInArrow(parse, schema).toDF("_path", "_row", "_line", *names)
    return out if places else out.drop("_path", "_row", "_line")
