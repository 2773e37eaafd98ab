"""Readers and writers of files: JSON, JSON lines, CSV, spreadsheets; modes of writing; column names of any case."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Sequence
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighbridge.sources import carried, shared, splits

#: Name spaces of the spreadsheet format, and how far repeated cells and rows are unrolled.
SHEET = {"table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}
REPEAT = 100


def read_object(path: str) -> dict:
    """A small JSON file on the driver that must hold an object."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not a JSON object")
    return value


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a known schema, gzipped or not; a line that is no object of it is an error; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; missing values are empty strings; header names are unique.
    A large file is read by as many tasks as it has splits (`splits.read_csv`)."""
    df = splits.read_csv(spark, path)
    return select_columns(df, required) if required else df


def select_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns whatever their case; one that is missing or could be two is an error."""
    out = []
    for name in wanted:
        found = [c for c in df.columns if c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"column {name}: {'ambiguous' if found else 'missing'}")
        out.append(F.col(f"`{found[0]}`").alias(name))
    return df.select(*out)


def read_sheets(path: str) -> dict[str, list[list[str]]]:
    """Tables of an OpenDocument spreadsheet by name: rows of texts without trailing blanks. Read on the driver, as such
    files are small; repeats are unrolled up to REPEAT times."""
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    key = lambda name: "{%s}%s" % (SHEET["table"], name)
    out = {}
    for sheet in root.iter(key("table")):
        rows: list[list[str]] = []
        for row in sheet.iter(key("table-row")):
            cells: list[str] = []
            for cell in row:
                if cell.tag in (key("table-cell"), key("covered-table-cell")):
                    text = "\n".join("".join(p.itertext()) for p in cell.iter("{%s}p" % SHEET["text"]))
                    cells += [text] * min(REPEAT, int(cell.get(key("number-columns-repeated"), "1")))
            while cells and not cells[-1]:
                cells.pop()
            rows += [cells] * min(REPEAT, int(row.get(key("number-rows-repeated"), "1")))
        while rows and not rows[-1]:
            rows.pop()
        out[sheet.get(key("name"), "")] = rows
    return out


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Never over what is there; the commit protocol makes the whole visible at once."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_same(df: DataFrame, path: str) -> bool:
    """Write, or find the same rows there already (False); other rows there are an error."""
    spark = df.sparkSession
    try:
        there = spark.read.schema(df.schema).parquet(path)
        there.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        write_new(df, path)
        return True
    if digest(there) != digest(df):
        raise ValueError(f"{path}: other rows are there")
    return False


def digest(df: DataFrame) -> tuple:
    """A digest of a frame's rows in any order: their number and the sum of their hashes."""
    h = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns)).cast("decimal(38,0)")
    return tuple(df.agg(F.count("*"), F.sum(h)).first())


#: Files of more bytes are read split by split, smaller ones whole.
WHOLE_BYTES = 128 << 20


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Each file of a folder with its size and digest, and the digest of all of them in the order of their names. A task reads a
    split of a large file; only packed files (`carried.PACKED`) and those without any of `carried.BREAKS` over long stretches
    are read whole. Spark lists no empty files."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    files = spark.read.options(**options).format("binaryFile").load(folder).withColumn("file", F.col("_metadata.file_path"))
    large = (F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.col("_metadata.file_path").rlike(carried.PACKED)
    found = carried.sha256(spark, folder, large, **options) if carried.available() else {}
    name = F.substring_index("path", "/", -1).alias("name")
    rows = files.where(~F.col("_metadata.file_path").isin([*found])).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if found:
        told = spark.createDataFrame(list(found.items()), "file string, sha256 string")
        rows = rows.unionByName(files.join(told, "file").select(name, F.col("length").alias("bytes"), "sha256"))
    rows = shared.written(rows, "inventory")
    whole = rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda r: F.concat_ws(":", r["name"], r["sha256"])), "\n"), 256).alias("all_sha256"))
    return rows.crossJoin(F.broadcast(whole))


#: The sheets with metric rows, and their columns.
METRIC_SHEETS = ("multiclass_classification", "binary_classification")
METRIC_COLUMNS = ("domain", "precision", "recall", "f1", "experiment")


def metric_rows(spark: SparkSession, sheets: dict[str, list[list[str]]]) -> DataFrame:
    """Published metric rows of the two sheets, comments and headings left out; a value's spread after ± is dropped."""
    rows = [(name, *r[:5]) for name in METRIC_SHEETS for r in sheets.get(name, []) if len(r) >= 5 and r[0] not in ("", "precision") and not r[0].startswith("#")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("sheet", *METRIC_COLUMNS)))
    return df.withColumns({c: F.trim(F.split_part(c, F.lit("±"), F.lit(1))).try_cast("double") for c in ("precision", "recall", "f1")})


def resolve(base: str, value: str) -> Path:
    """A path as a file in the folder of its configuration says it."""
    if not value.strip():
        raise ValueError("an empty path")
    return (Path(base).parent / Path(value).expanduser()).resolve()


def write_object(path: str, value: object, owner_only: bool = False) -> None:
    """A small JSON value with sorted keys, in place at once; owner_only leaves it to no one else."""
    target = Path(path)
    held = target.with_name(target.name + ".part")
    with os.fdopen(os.open(held, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600 if owner_only else 0o644), "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
    os.replace(held, target)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, the fields of each row by name; mode append adds to what is there."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)
