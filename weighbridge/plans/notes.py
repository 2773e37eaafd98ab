"""Queries over the note panel: three hierarchical heads, joint agreement, baselines, identity across conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions import contracts
from weighbridge.operators import metrics
from weighbridge.plans import oracle
from weighbridge.plans.registry import query
from weighbridge.sources import tables

CELL = ("model", "condition")
LABELS = {"detection": ("yes", "no"), "encounter": ("yes", "no"), "negation": ("yes", "no", "unsure")}
HEAD_ROWS = "hd AS (SELECT model, condition, 'detection' AS head, detection AS g, p_detection AS p FROM s UNION ALL SELECT model, condition, 'encounter', encounter, p_encounter FROM s WHERE detection = 'yes' UNION ALL SELECT model, condition, 'negation', negation, p_negation FROM s WHERE detection = 'yes')"
LABEL_ROWS = "lb(head, label) AS (VALUES ('detection', 'yes'), ('detection', 'no'), ('encounter', 'yes'), ('encounter', 'no'), ('negation', 'yes'), ('negation', 'no'), ('negation', 'unsure'))"
PER_CLASS = "(SELECT c.model, c.condition, c.head, lb.label, count(*) FILTER (g = label) AS support, count(*) FILTER (p = label) AS predicted, count(*) FILTER (g = label AND p = label) AS tp FROM (SELECT DISTINCT model, condition, head FROM hd) c JOIN lb USING (head) JOIN hd USING (model, condition, head) GROUP BY ALL)"
RATES = "CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall"
CLASSES = f"{oracle.NOTES}, {HEAD_ROWS}, {LABEL_ROWS}, k AS {PER_CLASS}, k1 AS (SELECT *, {RATES} FROM k), k2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM k1)"


def scored(spark, sf: str) -> DataFrame:
    return tables.score_notes(tables.note_panel(spark, sf))


def heads(rows: DataFrame, *keep: str) -> DataFrame:
    """One row a head that counts: the lower heads only below a reference of yes; keep are further columns of rows."""
    each = [F.struct(F.lit(h).alias("head"), F.col(h).alias("g"), F.col(f"p_{h}").alias("p"), F.lit(h == "detection").alias("always")) for h in LABELS]
    return rows.select(*CELL, *keep, "request_id", "detection", F.inline(F.array(*each))).where(F.col("always") | (F.col("detection") == "yes"))


def labels(spark, of=LABELS) -> DataFrame:
    return spark.createDataFrame([(h, x) for h, xs in of.items() for x in xs], "head string, label string")


def per_class(spark, rows: DataFrame) -> DataFrame:
    """Counts for each head and each of its labels, labels that never occur included."""
    return class_rates(rows.groupBy(*CELL, "head", "g", "p").agg(F.count("*").alias("n")), labels(spark), CELL)


def class_rates(cells: DataFrame, of: DataFrame, keys) -> DataFrame:
    """Cells (keys, head, g, p, n) to support, predicted, tp and rates of each label of each head."""
    grid = cells.join(F.broadcast(of), "head")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    out = grid.groupBy(*keys, "head", "label").agg(n(F.col("g") == F.col("label"))("support"), n(F.col("p") == F.col("label"))("predicted"), n((F.col("g") == F.col("label")) & (F.col("p") == F.col("label")))("tp"))
    out = out.withColumns({"precision": metrics.ratio(F.col("tp"), F.col("predicted")), "recall": metrics.ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", metrics.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


@query("note_panel", oracle.NOTE_PANEL + " SELECT request_id, note_cluster, admission_cluster, subject_cluster, detection, encounter, negation, model, condition, raw_output, runtime_failed, finish_reason FROM notes")
def note_panel(spark, sf):
    return tables.note_panel(spark, sf)


@query("note_heads_metrics", f"{CLASSES} SELECT model, condition, head, label, support, predicted, tp, predicted - tp AS fp, support - tp AS fn, precision, recall, f1 FROM k2")
def note_heads_metrics(spark, sf):
    out = per_class(spark, heads(scored(spark, sf)))
    return out.select(*CELL, "head", "label", "support", "predicted", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "precision", "recall", "f1")


@query("note_primary_endpoints", f"{CLASSES} SELECT model, condition, head, round(avg(f1), 9) AS macro_f1, round(avg(recall), 9) AS balanced_accuracy FROM k2 GROUP BY ALL")
def note_primary_endpoints(spark, sf):
    return per_class(spark, heads(scored(spark, sf))).groupBy(*CELL, "head").agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.avg("recall"), 9).alias("balanced_accuracy"))


@query("five_endpoints", f"""{CLASSES}, e AS (SELECT model, condition, round(avg(f1) FILTER (head = 'detection'), 9) AS detection_macro_f1, round(avg(recall) FILTER (head = 'detection'), 9) AS detection_balanced_accuracy, round(avg(f1) FILTER (head = 'encounter'), 9) AS encounter_macro_f1, round(avg(f1) FILTER (head = 'negation'), 9) AS negation_macro_f1 FROM k2 GROUP BY ALL),
 j AS (SELECT model, condition, round(count(*) FILTER (joint) / count(*), 9) AS joint_exact_match FROM s GROUP BY ALL) SELECT * FROM e JOIN j USING (model, condition)""")
def five_endpoints(spark, sf):
    """Both endpoints of detection, the lower heads' macro F1 and the joint agreement, a row a model and condition."""
    rows = scored(spark, sf)
    mean = lambda c, h: F.round(F.avg(F.when(F.col("head") == h, F.col(c))), 9)
    by = per_class(spark, heads(rows)).groupBy(*CELL).agg(mean("f1", "detection").alias("detection_macro_f1"), mean("recall", "detection").alias("detection_balanced_accuracy"), mean("f1", "encounter").alias("encounter_macro_f1"), mean("f1", "negation").alias("negation_macro_f1"))
    joint = rows.groupBy(*CELL).agg(F.round(F.count_if("joint") / F.count("*"), 9).alias("joint_exact_match"))
    return by.join(joint, list(CELL))


@query("note_head_coverage", f"{oracle.NOTES}, {HEAD_ROWS} SELECT model, condition, head, count(*) AS n, count(*) FILTER (g = p) AS correct, count(*) FILTER (g = p) / count(*) AS accuracy, count(*) FILTER (p <> '__failure__') / count(*) AS coverage, CASE WHEN count(*) FILTER (p <> '__failure__') > 0 THEN 1 - count(*) FILTER (g = p) / count(*) FILTER (p <> '__failure__') END AS selective_risk FROM hd GROUP BY ALL")
def note_head_coverage(spark, sf):
    right, valid = F.count_if(F.col("g") == F.col("p")), F.count_if(F.col("p") != contracts.FAILED)
    return heads(scored(spark, sf)).groupBy(*CELL, "head").agg(F.count("*").alias("n"), right.alias("correct"), (right / F.count("*")).alias("accuracy"), (valid / F.count("*")).alias("coverage"), (1 - F.try_divide(right, valid)).alias("selective_risk"))


@query("note_conditional_metrics", CLASSES.replace("k AS (", "k AS (", 1).replace("FROM s UNION ALL", "FROM s WHERE p_detection <> '__failure__' UNION ALL").replace("WHERE detection = 'yes' UNION", "WHERE detection = 'yes' AND p_encounter <> '__failure__' UNION").replace("p_negation FROM s WHERE detection = 'yes')", "p_negation FROM s WHERE detection = 'yes' AND p_negation <> '__failure__')") + " SELECT model, condition, head, label, support, tp, precision, recall, f1 FROM k2")
def note_conditional_metrics(spark, sf):
    return per_class(spark, heads(scored(spark, sf)).where(F.col("p") != contracts.FAILED)).select(*CELL, "head", "label", "support", "tp", "precision", "recall", "f1")


@query("note_joint_agreement", f"""{oracle.NOTES} SELECT model, condition, count(*) AS n, count(*) FILTER (NOT runtime_failed) AS runtime_completed, count(*) FILTER (parse_valid) AS parse_valid, count(*) FILTER (schema_valid) AS schema_valid, count(*) FILTER (logical_valid) AS logical_valid, count(*) FILTER (abstained) AS abstained,
 count(*) FILTER (joint) AS joint_correct, count(*) FILTER (joint) / count(*) AS joint_rate, count(*) FILTER (logical_valid AND NOT abstained) AS covered, count(DISTINCT note_cluster) AS notes, count(DISTINCT admission_cluster) AS admissions, count(DISTINCT subject_cluster) AS subjects FROM s GROUP BY ALL""")
def note_joint_agreement(spark, sf):
    return scored(spark, sf).groupBy(*CELL).agg(
        F.count("*").alias("n"), F.count_if(~F.col("runtime_failed")).alias("runtime_completed"), F.count_if("v.parse_valid").alias("parse_valid"), F.count_if("v.schema_valid").alias("schema_valid"), F.count_if("v.logical_valid").alias("logical_valid"), F.count_if("v.abstained").alias("abstained"),
        F.count_if("joint").alias("joint_correct"), (F.count_if("joint") / F.count("*")).alias("joint_rate"), F.count_if(F.col("v.logical_valid") & ~F.col("v.abstained")).alias("covered"), *(F.count_distinct(f"{c}_cluster").alias(f"{c}s") for c in ("note", "admission", "subject")),
    )


@query("fence_loose_effect", f"{oracle.NOTE_PANEL}, u AS (SELECT *, {oracle.LOOSE} AS bare FROM notes), {oracle.judged_notes('u', 's')}, {oracle.judged_notes('u', 't', 'bare')} SELECT model, condition, count(*) FILTER (s.raw_output <> t.bare) AS removed, count(*) FILTER (s.joint) AS joint_raw, count(*) FILTER (t.joint) AS joint_bare, count(*) FILTER (t.joint AND NOT s.joint) AS rescued FROM s JOIN t USING (request_id, model, condition) GROUP BY ALL")
def fence_loose_effect(spark, sf):
    rows = tables.note_panel(spark, sf).withColumn("bare", contracts.unfenced_loose("raw_output"))
    each = [F.struct(F.lit(view).alias("view"), F.col(text).alias("text")) for view, text in (("raw", "raw_output"), ("bare", "bare.text"))]
    views = tables.score_notes(rows.withColumn("removed", F.col("bare.removed")).select("*", F.inline(F.array(*each))), "text")
    by = views.groupBy("request_id", *CELL).agg(F.bool_or("removed").alias("removed"), F.bool_or((F.col("view") == "raw") & F.col("joint")).alias("raw"), F.bool_or((F.col("view") == "bare") & F.col("joint")).alias("bare"))
    return by.groupBy(*CELL).agg(F.count_if("removed").alias("removed"), F.count_if("raw").alias("joint_raw"), F.count_if("bare").alias("joint_bare"), F.count_if(F.col("bare") & ~F.col("raw")).alias("rescued"))


GOLD = f"{oracle.NOTE_PANEL}, g AS (SELECT DISTINCT request_id, detection, encounter, negation FROM notes), h AS (SELECT 'detection' AS head, detection AS label FROM g UNION ALL SELECT 'encounter', encounter FROM g WHERE detection = 'yes' UNION ALL SELECT 'negation', negation FROM g WHERE detection = 'yes'), c AS (SELECT head, label, count(*) AS n FROM h GROUP BY ALL)"


def gold_heads(spark, sf: str) -> DataFrame:
    gold = tables.note_panel(spark, sf).where("model = 'm0' and condition = 'constrained'")
    each = [F.struct(F.lit(h).alias("head"), F.col(h).alias("label"), F.lit(h == "detection").alias("always")) for h in LABELS]
    return gold.select("detection", F.inline(F.array(*each))).where(F.col("always") | (F.col("detection") == "yes")).select("head", "label")


@query("note_majority_baseline", f"{GOLD} SELECT head, arg_min(label, (-n, label)) AS majority, max(n) AS correct, sum(n)::BIGINT AS n, max(n) / sum(n) AS accuracy FROM c GROUP BY ALL")
def note_majority_baseline(spark, sf):
    by = gold_heads(spark, sf).groupBy("head", "label").agg(F.count("*").alias("n"))
    return by.groupBy("head").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"), F.max("n").alias("correct"), F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("accuracy"))


@query("note_majority_unique", f"{GOLD}, t AS (SELECT head, n, max(n) OVER (PARTITION BY head) AS top FROM c) SELECT head, count(*) FILTER (n = top) AS modes, count(*) FILTER (n = top) = 1 AS is_unique FROM t GROUP BY ALL")
def note_majority_unique(spark, sf):
    by = gold_heads(spark, sf).groupBy("head", "label").agg(F.count("*").alias("n"))
    modes = by.groupBy("head").agg(F.max("n").alias("top"), F.collect_list("n").alias("all"))
    n = F.size(F.filter("all", lambda x: x == F.col("top"))).cast("long")
    return modes.select("head", n.alias("modes"), (n == 1).alias("is_unique"))


@query("note_constant_baseline", f"{oracle.NOTE_PANEL}, g AS (SELECT DISTINCT request_id, detection, encounter, negation FROM notes) SELECT count(*) AS n, count(*) FILTER (detection = 'yes') AS detection_correct, count(*) FILTER (detection = 'yes' AND encounter = 'yes' AND negation = 'no') AS joint_correct FROM g")
def note_constant_baseline(spark, sf):
    """The baseline that always answers yes, yes, no."""
    v = F.struct(F.lit("yes").alias("detection"), F.lit("yes").alias("encounter"), F.lit("no").alias("negation"), F.lit(True).alias("logical_valid"))
    gold = tables.note_panel(spark, sf).where("model = 'm0' and condition = 'constrained'").withColumn("k", v)
    joint = contracts.joint_correct(F.col("k"), F.col("detection"), F.col("encounter"), F.col("negation"))
    return gold.agg(F.count("*").alias("n"), F.count_if(F.col("detection") == F.col("k.detection")).alias("detection_correct"), F.count_if(joint).alias("joint_correct"))


@query("label_identity", f"""{oracle.NOTES} SELECT a.model, count(*) AS n, count(*) FILTER (a.p_detection = b.p_detection AND a.p_encounter = b.p_encounter AND a.p_negation = b.p_negation) AS same_all, count(*) FILTER (a.p_detection = b.p_detection) AS same_detection, count(*) FILTER (a.logical_valid AND b.logical_valid) AS both_valid,
 count(*) FILTER (a.logical_valid AND b.logical_valid AND a.jd = b.jd AND a.je = b.je AND a.jn = b.jn) AS same_if_both_valid, count(*) FILTER (a.joint AND b.joint) AS both_correct, count(*) FILTER (a.joint AND NOT b.joint) AS only_unconstrained, count(*) FILTER (NOT a.joint AND b.joint) AS only_constrained
 FROM s a JOIN s b ON a.request_id = b.request_id AND a.model = b.model AND a.condition = 'unconstrained' AND b.condition = 'constrained' GROUP BY ALL""")
def label_identity(spark, sf):
    triple, said = F.struct("p_detection", "p_encounter", "p_negation"), F.struct("v.detection", "v.encounter", "v.negation")
    side = F.struct(triple.alias("p"), said.alias("s"), F.col("v.logical_valid").alias("valid"), "joint")
    by = scored(spark, sf).groupBy("model", "request_id").pivot("condition", ["unconstrained", "constrained"]).agg(F.first(side))
    a, b = F.col("unconstrained"), F.col("constrained")
    both = a["valid"] & b["valid"]
    return by.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(a["p"] == b["p"]).alias("same_all"), F.count_if(a["p"]["p_detection"] == b["p"]["p_detection"]).alias("same_detection"), F.count_if(both).alias("both_valid"), F.count_if(both & (a["s"] == b["s"])).alias("same_if_both_valid"),
        F.count_if(a["joint"] & b["joint"]).alias("both_correct"), F.count_if(a["joint"] & ~b["joint"]).alias("only_unconstrained"), F.count_if(~a["joint"] & b["joint"]).alias("only_constrained"),
    )


@query("cluster_counts", f"{oracle.NOTE_PANEL} SELECT count(DISTINCT note_cluster) AS notes, count(DISTINCT admission_cluster) AS admissions, count(DISTINCT subject_cluster) AS subjects FROM notes")
def cluster_counts(spark, sf):
    return tables.note_panel(spark, sf).agg(*(F.count_distinct(f"{c}_cluster").alias(f"{c}s") for c in ("note", "admission", "subject")))


@query("model_ranking", f"{oracle.NOTES}, g AS (SELECT model, condition, count(*) FILTER (joint) AS correct FROM s GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY condition ORDER BY correct DESC) AS place, rank() OVER (PARTITION BY condition ORDER BY correct DESC) = 1 AS wins FROM g")
def model_ranking(spark, sf):
    from pyspark.sql import Window

    by = scored(spark, sf).groupBy(*CELL).agg(F.count_if("joint").alias("correct"))
    place = F.rank().over(Window.partitionBy("condition").orderBy(F.desc("correct")))
    return by.withColumns({"place": place.cast("long"), "wins": place == 1})
