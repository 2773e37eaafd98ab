"""Tables of a folder, and the panels derived from them.

A panel is a long table of responses, one row for each request, model and condition. The derived ones turn the labels and
documents tables into responses by integer arithmetic and concatenation, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.functions import contracts
from weighbridge.ship import ship

MODELS, CONDITIONS = 4, 4
#: Expressions that Spark and other SQL engines read alike, in the order in which they build on each other.
HASH = "(doc_id * 7919 + m * 10473 + c * 1299 + (doc_id % 31) * m * 17) % 1000"
TYPED = [
    ("h", HASH),
    ("model", "concat('m', cast(m as string))"),
    ("condition", "case c when 0 then 'compact_unconstrained' when 1 then 'compact_constrained' when 2 then 'full_unconstrained' else 'full_constrained' end"),
    ("request_id", "doc_id"),
    ("case_id", "doc_id - doc_id % 3"),
    ("domain", "lang"),
    ("criterion_id", "source"),
    ("expected_state", "case when quality = 1 then 'PRESENT_CURRENT' else 'ABSENT_EXPLICIT' end"),
    ("opposite", "case when quality = 1 then 'ABSENT_EXPLICIT' else 'PRESENT_CURRENT' end"),
    ("sure", "case when h >= 700 and h < 710 then '0' else concat('0.', cast(h % 10 as string)) end"),
    ("said", "case when h < 620 then expected_state when h >= 700 and h < 710 then 'NOT_DOCUMENTED' when h < 760 then 'UNCERTAIN' else opposite end"),
    ("gives_up", "case when h >= 700 and h < 720 then 'true' else 'false' end"),
    ("reason", "case when h % 17 = 0 then 'historical' when h >= 700 and h < 720 then 'model_abstention' when said = 'PRESENT_CURRENT' then 'explicit_present' when said = 'ABSENT_EXPLICIT' then 'explicit_negation' when said = 'UNCERTAIN' then 'ambiguous' else 'not_documented' end"),
    ("middle", "case when c >= 2 then concat('\"value\":null,\"unit\":null,\"evidence\":[],\"reason_code\":\"', reason, '\",') else '' end"),
    ("body", "concat('{\"criterion_id\":\"', criterion_id, '\",\"state\":\"', said, '\",', middle, '\"confidence\":', sure, ',\"abstain\":', gives_up, '}')"),
    ("raw_output", "case when c % 2 = 1 then body when h % 13 = 0 then null when h % 11 = 0 then concat(body, ' as asked') when h % 7 = 0 then concat('```json', chr(10), body, chr(10), '```') when h % 5 = 0 then concat('{\"state\":\"', said, '\"}') else body end"),
    ("runtime_failed", "raw_output is null"),
    ("finish_reason", "case when raw_output is null then null when h % 29 = 0 then 'length' else 'stop' end"),
    ("prompt_tokens", "50 + n_chars % 500"),
    ("output_tokens", "length(raw_output)"),
]
TYPED_COLUMNS = "request_id case_id domain criterion_id expected_state model condition raw_output runtime_failed finish_reason prompt_tokens output_tokens".split()
NOTES = [
    ("h", HASH),
    ("model", "concat('m', cast(m as string))"),
    ("condition", "case c when 0 then 'unconstrained' else 'constrained' end"),
    ("request_id", "doc_id"),
    ("note_cluster", "doc_id"),
    ("admission_cluster", "concat(source, '-', lang)"),
    ("subject_cluster", "source"),
    ("detection", "case when quality = 1 then 'yes' else 'no' end"),
    ("encounter", "case when quality = 0 then 'not_applicable' when toxic = 1 then 'yes' else 'no' end"),
    ("negation", "case when quality = 0 then 'not_applicable' when n_chars % 3 = 0 then 'yes' when n_chars % 3 = 1 then 'no' else 'unsure' end"),
    ("d", "case when h < 30 then 'abstain' when h < 150 then (case when detection = 'yes' then 'no' else 'yes' end) else detection end"),
    ("e", "case when d = 'abstain' then 'abstain' when h % 19 = 0 then 'maybe' when d = 'no' then (case when h % 23 = 0 then 'yes' else 'not_applicable' end) when h % 3 = 0 or encounter = 'not_applicable' then 'no' else encounter end"),
    ("n", "case when d = 'abstain' then 'abstain' when d = 'no' then 'not_applicable' when h % 5 = 0 or negation = 'not_applicable' then 'unsure' else negation end"),
    ("body", "concat('{\"detection\":\"', d, '\",\"encounter\":\"', e, '\",\"negation\":\"', n, '\"}')"),
    ("raw_output", "case when c = 1 then body when h % 13 = 0 then null when h % 11 = 0 then concat(body, ' done') when h % 4 = 0 then concat('```JSON ', chr(10), body, chr(10), '```') else body end"),
    ("runtime_failed", "raw_output is null"),
    ("finish_reason", "case when raw_output is null then null when h % 29 = 0 then 'length' else 'stop' end"),
]
NOTE_COLUMNS = "request_id note_cluster admission_cluster subject_cluster detection encounter negation model condition raw_output runtime_failed finish_reason".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as there are cores, at least: what a row costs afterwards is far more than its bytes say, by which a
    scan is split."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def labelled(joined: DataFrame, found: str, key: str) -> DataFrame:
    """Labels joined to what they are about: a label without it is an error, not a row less."""
    missing = F.raise_error(F.concat(F.lit("a label without a row: "), F.col(key).cast("string")))
    return joined.withColumn(key, F.when(F.col(found).isNull(), missing.cast(joined.schema[key].dataType)).otherwise(F.col(key)))


def _derived(spark: SparkSession, folder: str, steps: list[tuple[str, str]], conditions: int) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", F.lit(True).alias("found"))
    rows = labelled(table(spark, folder, "labels").join(docs, "doc_id", "left"), "found", "doc_id").drop("found")
    cells = F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1)))
    rows = rows.withColumn("m", cells).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(conditions - 1))))
    for name, expression in steps:
        rows = rows.withColumn(name, F.expr(expression))
    return rows


def typed_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, TYPED, CONDITIONS).select(TYPED_COLUMNS)


def note_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, NOTES, 2).select(NOTE_COLUMNS)


def score_typed(panel: DataFrame, raw: str = "raw_output") -> DataFrame:
    """The panel with v (the verdict), observed_label, state_correct and state_only_correct."""
    v = contracts.judged(F.col(raw), F.split_part(F.col("condition"), F.lit("_"), F.lit(1)), F.col("criterion_id"), F.col("runtime_failed"))
    scored = panel.withColumn("v", v)
    return scored.withColumns({
        "observed_label": contracts.observed_label(F.col("v"), F.col("runtime_failed")),
        "state_correct": contracts.is_correct(F.col("v"), F.col("expected_state")),
        "state_only_correct": F.coalesce(F.col("v.state_only") == F.col("expected_state"), F.lit(False)),
    })


def score_notes(panel: DataFrame, raw: str = "raw_output") -> DataFrame:
    """The panel with v, the prediction of each head (p_...) and joint."""
    scored = panel.withColumn("v", contracts.judged_note(F.col(raw), F.col("runtime_failed")))
    heads = {f"p_{h}": contracts.head(F.col("v"), h) for h in ("detection", "encounter", "negation")}
    return scored.withColumns(heads | {"joint": contracts.joint_correct(F.col("v"), F.col("detection"), F.col("encounter"), F.col("negation"))})
