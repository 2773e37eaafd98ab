"""Whole reports as one long table each: the panel is scored in one scan, written as counts, and fanned out to cells, domains,
pairs of models, contrasts, intervals and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.operators import metrics, paired, resample
from weighbridge.plans import notes, oracle, reports, responses
from weighbridge.plans import paired as tests
from weighbridge.plans.registry import ORACLE_SQL, query
from weighbridge.sources import shared

COLUMNS = {"section": "string", "model": "string", "other": "string", "condition": "string", "domain": "string", "metric": "string", "value": "double", "n": "long", "low": "double", "high": "double", "p": "double", "adjusted": "double"}
#: Quantiles between values of 9 digits have 12: rounded to fewer, some lie on a half, where engines differ.
FINE = 12
COUNTS = ("n", "n_present", "n_absent", "n_present_ok", "n_absent_ok")


def rows(frame: DataFrame, **values: Column | str) -> DataFrame:
    """Report rows: the given columns, those of the frame by name, null for the others."""
    there = values | {c: F.col(c) for c in frame.columns if c in COLUMNS and c not in values}
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return frame.select(*(as_column(there.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def stacked(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def long(frame: DataFrame, named: dict[str, str]) -> DataFrame:
    """A row for each metric of a wide frame; named: metric to its column."""
    return frame.select("*", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in named.items()))))


def tested(slim: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Exact tests of all pairs of models on the same requests, and their step-down values within a group of keys."""
    of = paired.discordance(slim, keys, "model", outcome, "request_id").select(*keys, "arm_a", "arm_b", F.round(paired.mcnemar(F.col("a_only"), F.col("b_only")), 9).alias("p"))
    return paired.holm(of, "p", ["arm_a", "arm_b"], keys).withColumn("adjusted", F.round("adjusted", 7))


NAMED = {"strict_micro": "micro", "state_macro": "macro"}
LONG = "unnest([{metric: 'strict_micro', value: strict_micro}, {metric: 'state_macro', value: state_macro}], recursive := true)"
TYPED_SQL = f"""WITH cl AS ({ORACLE_SQL["state_macro_micro"]}), dm AS ({oracle.SCORED}, g AS (SELECT model, condition, domain, count(*) AS n, {responses.COUNTS} FROM s GROUP BY ALL) SELECT model, condition, domain, n, {responses.SAFE_MACRO} AS state_macro, (n_present_ok + n_absent_ok) / n AS strict_micro FROM g),
 mi AS ({ORACLE_SQL["cluster_bootstrap_micro"]}), ma AS ({ORACLE_SQL["cluster_bootstrap_macro"].replace("), 8) AS", f"), {FINE}) AS")}), ho AS ({ORACLE_SQL["holm_adjusted"]}), pc AS (SELECT model, condition, n, {LONG} FROM cl), pd AS (SELECT model, condition, domain, n, {LONG} FROM dm),
 iv AS (SELECT condition, model_a, model_b, 'strict_micro' AS metric, low, high FROM mi UNION ALL SELECT condition, model_a, model_b, 'state_macro', low, high FROM ma)
SELECT 'cell' AS section, model, NULL AS other, condition, NULL AS domain, metric, round(value, 9) AS value, n, NULL AS low, NULL AS high, NULL AS p, NULL AS adjusted FROM pc UNION ALL SELECT 'domain', model, NULL, condition, domain, metric, round(value, 9), n, NULL, NULL, NULL, NULL FROM pd
UNION ALL SELECT 'pair', a.model, b.model, a.condition, NULL, a.metric, round(b.value - a.value, 9), NULL, low, high, CASE WHEN a.metric = 'strict_micro' THEN p END, CASE WHEN a.metric = 'strict_micro' THEN adjusted END
 FROM pc a JOIN pc b ON a.condition = b.condition AND a.metric = b.metric AND a.model < b.model JOIN iv ON iv.condition = a.condition AND iv.metric = a.metric AND model_a = a.model AND model_b = b.model JOIN ho ON ho.condition = a.condition AND arm_a = a.model AND arm_b = b.model"""


@query("typed_report", TYPED_SQL)
def typed_report(spark, sf):
    """Agreement of each cell, also by domain; for each two models the difference, its cluster interval, exact p and adjusted p."""
    scored = responses.scored(spark, sf)
    slim = shared.written(scored.select("request_id", "case_id", "domain", "model", "condition", "expected_state", "state_correct"), "scored")
    by = shared.written(metrics.by_state(slim, ["case_id", "domain", "model", "condition"]).select("case_id", "domain", "model", "condition", *COUNTS), "cells")
    total = [F.sum(c).alias(c) for c in COUNTS]
    sets = by.groupingSets([["model", "condition"], ["model", "condition", "domain"]], "model", "condition", "domain").agg(*total, F.grouping("domain").alias("whole"))
    cells = long(metrics.with_rates(sets), NAMED).withColumn("value", F.round("value", 9))
    shown = rows(cells, section=F.when(F.col("whole") == 1, "cell").otherwise("domain"))
    # a replicate, and the panel itself as replicate -1, give the differences of each two models
    cases = by.groupBy("case_id", "model", "condition").agg(*total)
    drawn = resample.resampled(cases, cases.select("case_id").distinct(), "case_id", tests.REPLICATES, ["model", "condition"], COUNTS)
    both = drawn.unionByName(by.groupBy("model", "condition").agg(*total).withColumn("replicate", F.lit(-1)))
    diff = resample.paired_differences(metrics.with_rates(both), ["replicate", "condition"], "model", ["micro", "macro"]).withColumns({c: F.round(c, 9) for c in ("micro", "macro")})
    own = lambda c: F.collect_list(F.when(F.col("replicate") >= 0, F.col(c)))
    point = lambda c: F.max(F.when(F.col("replicate") < 0, F.col(c)))
    linear = paired.interval_linear(own("macro"))
    found = diff.groupBy("condition", "arm_a", "arm_b").agg(point("micro").alias("v_micro"), point("macro").alias("v_macro"), paired.interval_by_index(own("micro")).alias("i_micro"), F.struct(paired.scaled_round(linear["low"], FINE).alias("low"), paired.scaled_round(linear["high"], FINE).alias("high")).alias("i_macro"))
    found = found.join(tested(slim, ["condition"], "state_correct"), ["condition", "arm_a", "arm_b"])
    each = [F.struct(F.lit(m).alias("metric"), F.col(f"v_{c}").alias("value"), F.col(f"i_{c}.low").alias("low"), F.col(f"i_{c}.high").alias("high"), *(F.when(F.lit(c == "micro"), F.col(x)).alias(x) for x in ("p", "adjusted"))) for m, c in NAMED.items()]
    pairs = found.select("condition", F.col("arm_a").alias("model"), F.col("arm_b").alias("other"), F.inline(F.array(*each)))
    return shown.unionByName(rows(pairs, section="pair"))


#: Contrasts of the paired experiment: weights of its four cells. A cell alone is one too.
CELLS = ("full_unconstrained", "full_constrained", "compact_unconstrained", "compact_constrained")
CONTRASTS = {
    "compact_minus_full_unconstrained": {"compact_unconstrained": 1, "full_unconstrained": -1},
    "compact_minus_full_constrained": {"compact_constrained": 1, "full_constrained": -1},
    "constraint_full": {"full_constrained": 1, "full_unconstrained": -1},
    "constraint_compact": {"compact_constrained": 1, "compact_unconstrained": -1},
    "interaction": {"compact_constrained": 1, "full_unconstrained": 1, "compact_unconstrained": -1, "full_constrained": -1},
} | {c: {c: 1} for c in CELLS}
TERMS = [(name, condition, weight) for name, terms in CONTRASTS.items() for condition, weight in terms.items()]
SUMS = ("n", "n_present", "n_absent", "p1", "a1", "p2", "a2")
_ENDPOINTS = "unnest([{metric: 'strict_micro', v: (p1 + a1) / n}, {metric: 'state_only_micro', v: (p2 + a2) / n}, {metric: 'strict_macro', v: (p1 / nullif(n_present, 0) + a1 / nullif(n_absent, 0)) / 2}, {metric: 'state_only_macro', v: (p2 / nullif(n_present, 0) + a2 / nullif(n_absent, 0)) / 2}], recursive := true)"
_IF = lambda state, right: f"count(*) FILTER (expected_state = '{state}' AND {right})"
ABLATION_SQL = f"""{tests.BOOT}, c4 AS (SELECT case_id, model, condition, count(*) AS n, count(*) FILTER (expected_state = 'PRESENT_CURRENT') AS n_present, count(*) FILTER (expected_state = 'ABSENT_EXPLICIT') AS n_absent, {_IF("PRESENT_CURRENT", "state_correct")} AS p1, {_IF("ABSENT_EXPLICIT", "state_correct")} AS a1, {_IF("PRESENT_CURRENT", "state_only_correct")} AS p2, {_IF("ABSENT_EXPLICIT", "state_only_correct")} AS a2 FROM s GROUP BY ALL),
 r4 AS (SELECT replicate, model, condition, {", ".join(f"sum(w * {c}) AS {c}" for c in SUMS)} FROM c4 JOIN w USING (case_id) GROUP BY ALL UNION ALL SELECT -1, model, condition, {", ".join(f"sum({c})" for c in SUMS)} FROM c4 GROUP BY ALL),
 u4 AS (SELECT replicate, model, condition, {_ENDPOINTS} FROM r4), tm(contrast, condition, weight) AS (VALUES {", ".join(map(str, TERMS))}),
 k4 AS (SELECT replicate, model, contrast, metric, CASE WHEN count(v) = count(*) THEN round(sum(v * weight), 9) END AS d FROM u4 JOIN tm USING (condition) GROUP BY ALL)
SELECT model, contrast, metric, max(d) FILTER (replicate < 0) AS value, round(quantile_cont(d, 0.025) FILTER (replicate >= 0), {FINE}) AS low, round(quantile_cont(d, 0.975) FILTER (replicate >= 0), {FINE}) AS high, count(d) FILTER (replicate >= 0) AS used, count(*) FILTER (replicate >= 0 AND d IS NULL) AS excluded FROM k4 GROUP BY ALL"""


@query("ablation_report", ABLATION_SQL)
def ablation_report(spark, sf):
    """Four endpoints of each cell and contrast with their intervals; replicates in which a macro mean has no row of a state are
    left out and counted."""
    present, absent = (F.col("expected_state") == s for s in (metrics.PRESENT, metrics.ABSENT))
    counts = {"n": F.count("*"), "n_present": F.count_if(present), "n_absent": F.count_if(absent), **{f"{k}{i}": F.count_if(c & F.col(right)) for i, right in ((1, "state_correct"), (2, "state_only_correct")) for k, c in (("p", present), ("a", absent))}}
    by = shared.written(responses.scored(spark, sf).groupBy("case_id", "model", "condition").agg(*(v.alias(c) for c, v in counts.items())), "cells")
    drawn = resample.resampled(by, by.select("case_id").distinct(), "case_id", tests.REPLICATES, ["model", "condition"], SUMS)
    both = drawn.unionByName(by.groupBy("model", "condition").agg(*(F.sum(c).alias(c) for c in SUMS)).withColumn("replicate", F.lit(-1)))
    macro = lambda i: (F.try_divide(F.col(f"p{i}"), F.col("n_present")) + F.try_divide(F.col(f"a{i}"), F.col("n_absent"))) / 2
    micro = lambda i: F.try_divide(F.col(f"p{i}") + F.col(f"a{i}"), F.col("n"))
    ends = {"strict_micro": micro(1), "state_only_micro": micro(2), "strict_macro": macro(1), "state_only_macro": macro(2)}
    each = both.select("replicate", "model", "condition", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in ends.items()))))
    terms = spark.createDataFrame(TERMS, "contrast string, condition string, weight int")
    value = F.when(F.count("v") == F.count("*"), F.round(F.sum(F.col("v") * F.col("weight")), 9)).alias("d")
    d = each.join(F.broadcast(terms), "condition").groupBy("replicate", "model", "contrast", "metric").agg(value)
    own = F.col("replicate") >= 0
    i = paired.interval_linear(F.collect_list(F.when(own, F.col("d"))))
    return d.groupBy("model", "contrast", "metric").agg(
        F.max(F.when(~own, F.col("d"))).alias("value"), paired.scaled_round(i["low"], FINE).alias("low"), paired.scaled_round(i["high"], FINE).alias("high"), F.count(F.when(own, F.col("d"))).alias("used"), F.count_if(own & F.col("d").isNull()).alias("excluded")
    )


FIVE = tuple(reports.MEANS)
_FIVE = f"unnest([{', '.join(f'{{metric: {m!r}, value: {m}}}' for m in FIVE)}], recursive := true)"
_JOINT = f"{oracle.NOTES}, q AS (SELECT a.condition, a.model AS arm_a, b.model AS arm_b, count(*) FILTER (a.joint AND NOT b.joint) AS a_only, count(*) FILTER (NOT a.joint AND b.joint) AS b_only FROM s a JOIN s b ON a.request_id = b.request_id AND a.condition = b.condition AND a.model < b.model WHERE a.condition = 'constrained' GROUP BY ALL), e AS (SELECT arm_a, arm_b, round({tests.EXACT}, 9) AS p FROM q), o AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, arm_a, arm_b) + 1) * p) AS z FROM e WHERE p IS NOT NULL) SELECT arm_a, arm_b, p, round(max(z) OVER (ORDER BY p, arm_a, arm_b ROWS UNBOUNDED PRECEDING), 7) AS adjusted FROM o UNION ALL SELECT arm_a, arm_b, p, NULL FROM e WHERE p IS NULL"
NOTE_SQL = f"""WITH fv AS ({ORACLE_SQL["five_endpoints"]}), pc AS (SELECT model, condition, {_FIVE} FROM fv), iv AS ({ORACLE_SQL["endpoint_bootstrap"]}), ho AS ({_JOINT})
SELECT 'cell' AS section, model, NULL AS other, condition, NULL AS domain, metric, round(value, 8) AS value, NULL AS n, NULL AS low, NULL AS high, NULL AS p, NULL AS adjusted FROM pc
UNION ALL SELECT 'pair', a.model, b.model, 'constrained', NULL, a.metric, round(b.value - a.value, 8), NULL, low, high, CASE WHEN a.metric = 'joint_exact_match' THEN p END, CASE WHEN a.metric = 'joint_exact_match' THEN adjusted END
 FROM pc a JOIN pc b ON a.condition = 'constrained' AND b.condition = 'constrained' AND a.metric = b.metric AND a.model < b.model JOIN iv ON iv.model_a = a.model AND iv.model_b = b.model AND iv.endpoint = a.metric JOIN ho ON arm_a = a.model AND arm_b = b.model"""


@query("note_report", NOTE_SQL)
def note_report(spark, sf):
    """The five endpoints of each cell; for each two models of the constrained condition the differences with their intervals, and
    exact and adjusted p of the joint agreement."""
    keep = ["request_id", "subject_cluster", "model", "condition", "joint", *notes.LABELS, *(f"p_{h}" for h in notes.LABELS)]
    slim = shared.written(notes.scored(spark, sf).select(keep), "scored")
    joint = slim.select("subject_cluster", "model", "condition", F.lit("joint").alias("head"), F.lit("yes").alias("g"), F.when(F.col("joint"), "yes").otherwise("no").alias("p"))
    each = notes.heads(slim, "subject_cluster").select(*joint.columns).unionByName(joint)
    cells = shared.written(each.groupBy(*joint.columns).agg(F.count("*").alias("n")), "cells")
    keys = ["model", "condition", "head", "g", "p"]
    narrow = cells.where("condition = 'constrained'")
    drawn = resample.resampled(narrow, narrow.select("subject_cluster").distinct(), "subject_cluster", reports.REPLICATES, keys, ["n"])
    both = drawn.unionByName(cells.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("replicate", F.lit(-1)))
    k = notes.class_rates(both, notes.labels(spark, notes.LABELS | {"joint": ("yes",)}), ["replicate", "model", "condition"])
    means = [F.coalesce(F.avg(F.when(F.col("head") == h, F.col(c))), F.lit(0.0)).alias(name) for name, (c, h) in reports.MEANS.items()]
    z = k.groupBy("replicate", "model", "condition").agg(*means)
    z = long(z, {m: m for m in FIVE}).select("replicate", "model", "condition", "metric", "value")
    shown = rows(z.where("replicate < 0").withColumn("value", F.round(F.round("value", 9), 8)), section="cell")
    diff = resample.paired_differences(z.where("condition = 'constrained'").withColumn("value", F.when(F.col("replicate") < 0, F.round("value", 9)).otherwise(F.col("value"))), ["replicate", "metric"], "model", ["value"]).withColumn("d", F.round("value", 8))
    of = F.collect_list(F.when(F.col("replicate") >= 0, F.col("d")))
    found = diff.groupBy("metric", "arm_a", "arm_b").agg(F.max(F.when(F.col("replicate") < 0, F.col("d"))).alias("value"), paired.interval_by_index(of, style="outer").alias("i"))
    found = found.join(tested(slim.where("condition = 'constrained'"), ["condition"], "joint").drop("condition"), ["arm_a", "arm_b"])
    own = lambda c: F.when(F.col("metric") == "joint_exact_match", F.col(c))
    pairs = found.select("metric", "value", F.col("arm_a").alias("model"), F.col("arm_b").alias("other"), "i.*", own("p").alias("p"), own("adjusted").alias("adjusted"))
    return shown.unionByName(rows(pairs, section="pair", condition="constrained"))
