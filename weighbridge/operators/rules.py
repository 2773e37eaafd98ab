"""Validation of manifests by rules that are data: what each rule asks of a field, and how much it weighs.

A manifest is a row; its fields are laid out as (manifest, field, value) and meet the rules of their field. Kinds of rules:

required    a value that is not blank          one_of      one of the argument's, split by |
least, most a number not under, not over it    pattern     the whole value matches it
unique      no other manifest has the value    in_table    a value of the reference table that the argument names
frozen      the value that the frozen table has for this manifest and field

A missing value breaks `required` and `frozen` only, except that a number that cannot be read breaks `least` and `most`.
Levels: an error makes a manifest invalid, a blocker keeps a valid one from running, a warning does neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.sources import shared

RULES = "rule string, field string, kind string, argument string, level string"
KINDS = ("required", "one_of", "least", "most", "pattern", "unique", "in_table", "frozen")
LEVELS = ("error", "blocker", "warning")
RULE_BYTES = 1024


def laid_out(manifests: DataFrame, key: str) -> DataFrame:
    """(manifest, field, value), the values as text."""
    fields = [c for c in manifests.columns if c != key]
    return manifests.select(F.col(key).alias("manifest"), F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))))


def violations(manifests: DataFrame, key: str, rules: DataFrame, tables: DataFrame | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """(manifest, rule, level) of every rule that a manifest breaks. tables(name, value) are reference values, frozen(manifest,
    field, value) what was frozen. A rule about a field that manifests do not have is broken by all of them; a kind or level that is
    not known is an error."""
    spark = manifests.sparkSession
    known = F.when(F.col("kind").isin(*KINDS) & F.col("level").isin(*LEVELS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("rule of an unknown kind or level: "), "rule")))
    rules = shared.written(rules.withColumn("kind", known), "rules")
    table = shared.small(rules, RULE_BYTES)
    rows = laid_out(manifests, key).join(table, "field")
    value, argument, kind = F.col("value"), F.col("argument"), F.col("kind")
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    number, bound = value.try_cast("double"), argument.try_cast("double")
    off = F.when(kind == "required", blank).when(kind == "one_of", ~F.array_contains(F.split(argument, r"\|"), value)).when(kind == "least", ~F.coalesce(number >= bound, F.lit(False))).when(kind == "most", ~F.coalesce(number <= bound, F.lit(False))).when(kind == "pattern", ~F.regexp_like(value, F.concat(F.lit(r"\A(?:"), argument, F.lit(r")\z"))))
    there = value.isNotNull()
    found = rows.where(F.when(kind.isin("required"), off).otherwise(there & off)).select("manifest", "rule", "level")
    of = lambda k: rows.where(kind == k)
    # values are counted before anything meets its equals, so one that very many manifests share is a row
    unique = of("unique").where(there)
    repeated = unique.groupBy("rule", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = found.unionByName(unique.join(repeated, ["rule", "value"], "left_semi").select("manifest", "rule", "level"))
    tables = spark.createDataFrame([], "name string, value string") if tables is None else tables
    own = tables.select(F.col("name").alias("argument"), F.col("value").cast("string").alias("value")).distinct()
    found = found.unionByName(of("in_table").where(there).join(own, ["argument", "value"], "left_anti").select("manifest", "rule", "level"))
    frozen = laid_out(manifests.limit(0), key) if frozen is None else frozen
    was = frozen.select("manifest", "field", F.col("value").cast("string").alias("was"), F.lit(True).alias("held"))
    met = of("frozen").join(was, ["manifest", "field"], "left")
    found = found.unionByName(met.where(F.col("held").isNull() | ~F.col("was").eqNullSafe(value)).select("manifest", "rule", "level"))
    absent = rules.where(~F.col("field").isin(*(c for c in manifests.columns if c != key))).select("rule", "level")
    return found.unionByName(manifests.select(F.col(key).alias("manifest")).crossJoin(shared.small(shared.written(absent, "absent"), RULE_BYTES)))


def verdicts(manifests: DataFrame, key: str, found: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(manifest, verdict, errors, blockers, warnings) of every manifest."""
    counts = found.groupBy("manifest").agg(*(F.count_if(F.col("level") == level).alias(f"{level}s") for level in levels))
    names = [f"{level}s" for level in levels]
    out = manifests.select(F.col(key).alias("manifest")).join(counts, "manifest", "left").na.fill(0, names)
    verdict = F.when(F.col(names[0]) > 0, "invalid").when(F.col(names[1]) > 0, "blocked").otherwise("ready")
    return out.select("manifest", verdict.alias("verdict"), *names)
