"""Checks as queries: each returns what breaks a rule, or how often it is broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has; one shuffle of each side."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full").where("l is null or r is null")
    return both.select(F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"), key)


def alignment(panel: DataFrame, key: str, cell: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """For each request how many cells have it, and whether all agree on what must not vary."""
    same = F.struct(*fixed)
    return panel.groupBy(key).agg(F.count_distinct(F.struct(*cell)).alias("cells"), (F.min(same) == F.max(same)).alias("aligned"))


def recomputed(stored: DataFrame, fresh: DataFrame, on: Sequence[str], a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """How often stored and recomputed values differ; a row that one side lacks differs."""
    both = stored.join(fresh, list(on), "full")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("differing"))


def several_parents(rows: DataFrame, child: str, parent: str, level: str) -> DataFrame:
    by = rows.groupBy(F.col(child).cast("string").alias("child")).agg(F.count_distinct(parent).alias("parents")).where("parents > 1")
    return by.select(F.lit(level).alias("level"), "child", "parents")


def bad_contrasts(declared: DataFrame, models: DataFrame) -> DataFrame:
    """Declarations whose id repeats, or whose models are the same or unknown."""
    known = models.select(F.col("model"), F.lit(True).alias("known"))
    named = declared.join(known.select(F.col("model").alias("a"), F.col("known").alias("ka")), "a", "left").join(known.select(F.col("model").alias("b"), F.col("known").alias("kb")), "b", "left")
    again = declared.groupBy("id").agg(F.count("*").alias("times"))
    return named.join(again, "id").where("a = b or ka is null or kb is null or times > 1").select("id", "a", "b")


def within(rows: DataFrame, published: DataFrame, on: Sequence[str], value: str, other: str, tolerance: float) -> DataFrame:
    both = rows.join(published, list(on))
    return both.select(*on, other, (F.abs(F.col(value) - F.col(other)) <= tolerance).alias("within"))


def overlap(x: Column, y: Column) -> list[Column]:
    """both, either, subset (x in y) and jaccard (1 for two empty sets)."""
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return [both.cast("long").alias("both"), either.cast("long").alias("either"), (F.size(F.array_except(x, y)) == 0).alias("subset"), F.coalesce(F.try_divide(both, either), F.lit(1.0)).alias("jaccard")]


def keyed_differences(expected: DataFrame, found: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, problem) of two tables with one row a key: missing, unexpected, or each field that differs (nulls are equal).
    Coverage of a registry and a tree is this without fields; preflight against responses and provenance with them."""
    side = lambda rows, name: rows.select(key, F.struct(F.lit(True).alias("there"), *fields).alias(name))
    both = side(expected, "a").join(side(found, "b"), key, "full")
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    rules = [F.when(F.col("b").isNull(), F.lit("missing")), F.when(F.col("a").isNull(), F.lit("unexpected"))]
    rules += [F.when(here & ~F.col("a")[f].eqNullSafe(F.col("b")[f]), F.lit(f"{f} differs")) for f in fields]
    return both.select(key, F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def matched_once(rows: DataFrame, published: DataFrame, key: Sequence[str], value: str, other: str) -> DataFrame:
    """For each row how many published rows have its key, whether it is one, and whether all have its value."""
    both = rows.join(published.select(*key, other), list(key), "left")
    n = F.count(other)
    return both.groupBy(*key).agg(n.alias("published"), (n == 1).alias("once"), F.coalesce(F.every(F.col(other) == F.col(value)), F.lit(False)).alias("equal"))


def union_or_conflict(x: Column, y: Column) -> Column:
    """The union of two sets of features as a sorted array; null where they overlap, which is a conflict."""
    return F.when(F.size(F.array_intersect(x, y)) == 0, F.array_sort(F.array_union(x, y)))
