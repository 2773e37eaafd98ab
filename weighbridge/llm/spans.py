"""Places of regular expression matches with built-in functions only.

The pieces between matches and the matches themselves tell where each match is: an end is the sum of the lengths of all
pieces and matches up to it. Sums run over chunks of CHUNK, so a text with very many matches costs no square of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def running(values: Column) -> Column:
    """Running sums of an array<long>."""

    def plain(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("sum"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
        return F.aggregate(part, zero, step, lambda acc: acc["out"])

    at = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(CHUNK)).cast("int"))
    parts = F.transform(at, lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))
    total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)
    long = F.flatten(F.zip_with(parts, plain(F.transform(parts, total), F.lit(0).cast("long")), lambda p, upto: plain(p, upto - total(p))))
    return F.when(F.size(values) <= CHUNK, plain(values, F.lit(0).cast("long"))).otherwise(long)


def found(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """(lengths of a piece and the match after it, matches), both empty where guard says that there is no match."""
    matches = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    gaps = F.when(guard, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    return gaps, matches


def places(gaps: Column, matches: Column) -> Column:
    """array<struct<start, end, value>>, in code points, the end exclusive."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    return F.zip_with(running(lengths), matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans ready to be sorted: array<struct<start, kind_no, end, kind>>."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


TAGGED = "array<struct<start: bigint, kind_no: int, end: bigint, kind: string>>"


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def how_many(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
