"""Queries over the typed panel: contracts, labels, agreement, failures, fences, domains, contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions import contracts
from weighbridge.operators import metrics
from weighbridge.plans import oracle
from weighbridge.plans.registry import query
from weighbridge.sources import tables

CELL = ("model", "condition")


def scored(spark, sf: str) -> DataFrame:
    return tables.score_typed(tables.typed_panel(spark, sf))


def n_if(c: Column | str) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c)


@query("typed_panel", oracle.PANEL + " SELECT request_id, case_id, domain, criterion_id, expected_state, model, condition, raw_output, runtime_failed, finish_reason, prompt_tokens, output_tokens FROM panel")
def typed_panel(spark, sf):
    return tables.typed_panel(spark, sf)


MACRO = "(n_present_ok / n_present + n_absent_ok / n_absent) / 2"
COUNTS = "count(*) FILTER (expected_state = 'PRESENT_CURRENT') AS n_present, count(*) FILTER (expected_state = 'ABSENT_EXPLICIT') AS n_absent, count(*) FILTER (state_correct AND expected_state = 'PRESENT_CURRENT') AS n_present_ok, count(*) FILTER (state_correct AND expected_state = 'ABSENT_EXPLICIT') AS n_absent_ok"
SAFE_MACRO = "CASE WHEN n_present > 0 AND n_absent > 0 THEN (n_present_ok / n_present + n_absent_ok / n_absent) / 2 END"


@query("state_macro_micro", f"{oracle.SCORED}, g AS (SELECT model, condition, count(*) AS n, {COUNTS} FROM s GROUP BY ALL) SELECT model, condition, n, n_present_ok + n_absent_ok AS n_correct, {SAFE_MACRO} AS state_macro, (n_present_ok + n_absent_ok) / n AS strict_micro FROM g")
def state_macro_micro(spark, sf):
    return metrics.macro_micro(scored(spark, sf), CELL)


@query("typed_contract_counts", f"""{oracle.SCORED} SELECT model, condition, count(*) AS n, count(*) FILTER (NOT runtime_failed) AS runtime_completed, count(*) FILTER (parse_valid) AS parse_valid, count(*) FILTER (schema_valid) AS schema_valid, count(*) FILTER (logical_valid) AS logical_valid,
 count(*) FILTER (abstained) AS abstained, count(*) FILTER (abstained AND logical_valid) AS valid_abstained, count(*) FILTER (state_correct) AS correct, count(*) FILTER (state_correct) / count(*) AS agreement,
 CASE WHEN count(*) FILTER (logical_valid AND NOT abstained) > 0 THEN count(*) FILTER (state_correct) / count(*) FILTER (logical_valid AND NOT abstained) END AS agreement_if_valid FROM s GROUP BY ALL""")
def typed_contract_counts(spark, sf):
    usable = F.col("v.logical_valid") & ~F.col("v.abstained")
    return scored(spark, sf).groupBy(*CELL).agg(
        F.count("*").alias("n"), n_if(~F.col("runtime_failed")).alias("runtime_completed"), n_if("v.parse_valid").alias("parse_valid"), n_if("v.schema_valid").alias("schema_valid"), n_if("v.logical_valid").alias("logical_valid"),
        n_if("v.abstained").alias("abstained"), n_if(F.col("v.abstained") & F.col("v.logical_valid")).alias("valid_abstained"), n_if("state_correct").alias("correct"), F.try_divide(n_if("state_correct"), F.count("*")).alias("agreement"), F.try_divide(n_if("state_correct"), n_if(usable)).alias("agreement_if_valid"),
    )


@query("observed_label_confusion", f"{oracle.SCORED} SELECT model, condition, expected_state, observed_label, count(*) AS n FROM s GROUP BY ALL")
def observed_label_confusion(spark, sf):
    return metrics.confusion(scored(spark, sf), "expected_state", "observed_label", CELL)


@query("state_only_agreement", f"""{oracle.SCORED}, g AS (SELECT model, condition, expected_state, count(*) AS n, count(*) FILTER (state_only_correct) AS ok, count(*) FILTER (state_only IS NOT NULL) AS eligible, count(*) FILTER (state_correct) AS strict_ok FROM s GROUP BY ALL)
 SELECT model, condition, sum(ok)::BIGINT AS correct, sum(eligible)::BIGINT AS eligible, sum(ok) / sum(n) AS micro, CASE WHEN sum(eligible) > 0 THEN sum(ok) / sum(eligible) END AS micro_if_eligible, round(avg(ok / n), 9) AS macro, greatest(0, sum(ok) - sum(strict_ok))::BIGINT AS hidden FROM g GROUP BY ALL""")
def state_only_agreement(spark, sf):
    by = scored(spark, sf).groupBy(*CELL, "expected_state").agg(F.count("*").alias("n"), n_if("state_only_correct").alias("ok"), n_if(F.col("v.state_only").isNotNull()).alias("eligible"), n_if("state_correct").alias("strict_ok"))
    return by.groupBy(*CELL).agg(
        F.sum("ok").alias("correct"), F.sum("eligible").alias("eligible"), (F.sum("ok") / F.sum("n")).alias("micro"), F.try_divide(F.sum("ok"), F.sum("eligible")).alias("micro_if_eligible"), F.round(F.avg(F.col("ok") / F.col("n")), 9).alias("macro"), F.greatest(F.lit(0).cast("long"), F.sum("ok") - F.sum("strict_ok")).alias("hidden"),
    )


PARTITION = "CASE WHEN NOT schema_valid THEN failure ELSE 'schema_valid__state_' || CASE WHEN state_only_correct THEN 'correct' ELSE 'wrong' END || '__abstain_' || abstained || '__logical_' || CASE WHEN logical_valid THEN 'valid' ELSE 'invalid' END END"


@query("failure_partition", f"{oracle.SCORED}, g AS (SELECT model, condition, expected_state, {PARTITION} AS part, count(*) AS n FROM s GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY model, condition, expected_state) AS rate FROM g")
def failure_partition(spark, sf):
    part = contracts.partition(F.col("v"), F.col("runtime_failed"), F.col("expected_state")).alias("part")
    return metrics.shares(scored(spark, sf).select(*CELL, "expected_state", part), [*CELL, "expected_state"], "part")


@query("failure_partition_rates", f"""{oracle.SCORED}, t AS (SELECT model, condition, expected_state, count(*) AS d FROM s GROUP BY ALL), g AS (SELECT model, condition, expected_state, {PARTITION} AS part, count(*) AS n FROM s GROUP BY ALL),
 x AS (SELECT p.model, p.condition, p.part, t.expected_state, t.d, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT model, condition, part FROM g) p JOIN t USING (model, condition) LEFT JOIN g USING (model, condition, expected_state, part))
 SELECT model, condition, part, sum(n)::BIGINT AS n, sum(n) / sum(d) AS micro, round(avg(n / d), 9) AS macro FROM x GROUP BY ALL""")
def failure_partition_rates(spark, sf):
    part = contracts.partition(F.col("v"), F.col("runtime_failed"), F.col("expected_state")).alias("part")
    rows = scored(spark, sf).select(*CELL, "expected_state", part)
    return metrics.rates_by_reference(rows, CELL, "part", "expected_state")


@query("failure_mechanisms", f"""{oracle.PANEL}, a AS (SELECT *, CASE WHEN raw_output IS NULL THEN true ELSE json_valid(raw_output) END AS ok, CASE WHEN json_valid(raw_output) THEN raw_output::JSON END AS j FROM panel WHERE condition LIKE 'full%'),
 b AS (SELECT *, ok AND coalesce(json_type(j), '') <> 'OBJECT' AS not_object, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS ks FROM a), c AS (SELECT *, ks IS NOT NULL AS o, {oracle.FULL_KEYS} AS want FROM b)
 SELECT model, condition, count(*) FILTER (NOT ok) AS not_valid_json, count(*) FILTER (not_object) AS json_not_object, count(*) FILTER (o AND list_has_all(ks, ['type', 'properties']) AND NOT list_has_all(ks, want)) AS schema_echo,
 count(*) FILTER (o AND NOT list_has_all(ks, want)) AS missing_required_keys, count(*) FILTER (o AND NOT list_has_all(want, ks)) AS additional_keys, count(*) FILTER (o AND coalesce((j->'evidence')::VARCHAR, '') <> '[]') AS nonempty_or_invalid_evidence,
 count(*) FILTER (o AND coalesce(json_type(j->'value'), 'NULL') <> 'NULL') AS non_null_value, count(*) FILTER (o AND coalesce(json_type(j->'unit'), 'NULL') <> 'NULL') AS non_null_unit, count(*) FILTER (o AND (j->>'reason_code') IN {oracle.STATES}) AS state_label_used_as_reason_code FROM c GROUP BY ALL""")
def failure_mechanisms(spark, sf):
    rows = tables.typed_panel(spark, sf).where("condition like 'full%'").withColumn("f", contracts.mechanism_flags("raw_output"))
    return rows.groupBy(*CELL).agg(*(n_if(f"f.{m}").alias(m) for m in contracts.MECHANISMS))


@query("fence_strict_effect", f"{oracle.PANEL}, u AS (SELECT *, {oracle.STRICT} AS bare FROM panel), {oracle.scored('u', 's')}, {oracle.scored('u', 't', 'bare')} SELECT model, condition, count(*) FILTER (s.raw_output <> t.bare) AS removed, count(*) FILTER (s.state_correct) AS correct_raw, count(*) FILTER (t.state_correct) AS correct_bare, count(*) FILTER (t.state_correct AND NOT s.state_correct) AS rescued FROM s JOIN t USING (request_id, model, condition) GROUP BY ALL")
def fence_strict_effect(spark, sf):
    rows = tables.typed_panel(spark, sf).withColumn("bare", contracts.unfenced_strict("raw_output"))
    raw, bare = F.struct("raw_output", F.lit(False).alias("removed")), F.struct(F.col("bare.text").alias("raw_output"), F.col("bare.removed").alias("removed"))
    views = rows.select("*", F.inline(F.array(F.struct(F.lit("raw").alias("view"), raw.alias("t")), F.struct(F.lit("bare").alias("view"), bare.alias("t")))))
    judged = tables.score_typed(views.withColumn("text", F.col("t.raw_output")), "text")
    by = judged.groupBy("request_id", *CELL).agg(F.bool_or(F.col("t.removed")).alias("removed"), F.bool_or((F.col("view") == "raw") & F.col("state_correct")).alias("raw"), F.bool_or((F.col("view") == "bare") & F.col("state_correct")).alias("bare"))
    return by.groupBy(*CELL).agg(n_if("removed").alias("removed"), n_if("raw").alias("correct_raw"), n_if("bare").alias("correct_bare"), n_if(F.col("bare") & ~F.col("raw")).alias("rescued"))


GROUPS = "GROUPING SETS ((model, condition), (model, condition, domain), (model, condition, domain, criterion_id))"


@query("grouped_state_summary", f"{oracle.SCORED} SELECT model, condition, domain, criterion_id, count(*) AS n, count(*) FILTER (logical_valid) AS logical_valid, count(*) FILTER (state_correct) AS correct, count(*) FILTER (state_correct) / count(*) AS agreement FROM s GROUP BY {GROUPS}")
def grouped_state_summary(spark, sf):
    sets = [[F.col(c) for c in g] for g in (CELL, (*CELL, "domain"), (*CELL, "domain", "criterion_id"))]
    out = scored(spark, sf).groupingSets(sets, "model", "condition", "domain", "criterion_id")
    return out.agg(F.count("*").alias("n"), n_if("v.logical_valid").alias("logical_valid"), n_if("state_correct").alias("correct"), (n_if("state_correct") / F.count("*")).alias("agreement"))


DOMAIN = f"{oracle.SCORED}, g AS (SELECT model, condition, domain, count(*) AS n, {COUNTS} FROM s GROUP BY ALL), d AS (SELECT *, (n_present_ok + n_absent_ok) / n AS micro, {SAFE_MACRO} AS macro FROM g)"
EQUAL = f"{DOMAIN}, q AS (SELECT model, condition, sum(n)::BIGINT AS n, sum(n_present) AS n_present, sum(n_absent) AS n_absent, sum(n_present_ok) AS n_present_ok, sum(n_absent_ok) AS n_absent_ok, CASE WHEN count(macro) = count(*) THEN round(avg(macro), 9) END AS equal_macro, round(avg(micro), 9) AS equal_micro FROM d GROUP BY ALL)"


@query("equal_domain_vs_pooled", f"{EQUAL} SELECT model, condition, n, {SAFE_MACRO} AS pooled_macro, (n_present_ok + n_absent_ok) / n AS pooled_micro, equal_macro, equal_micro FROM q")
def equal_domain_vs_pooled(spark, sf):
    return metrics.equal_domain(scored(spark, sf), CELL, "domain")


@query("domain_agreement", f"{DOMAIN} SELECT model, condition, domain, n, n_present, n_absent, micro, macro FROM d")
def domain_agreement(spark, sf):
    return metrics.by_state(scored(spark, sf), (*CELL, "domain")).select(*CELL, "domain", "n", "n_present", "n_absent", "micro", "macro")


@query("domain_weights", f"""{oracle.PANEL}, r AS (SELECT DISTINCT request_id, domain, expected_state FROM panel), g AS (SELECT domain, expected_state, count(*) AS n FROM r GROUP BY ALL)
 SELECT domain, expected_state, n, 1 / (SELECT count(DISTINCT domain) FROM g) AS equal_weight, (sum(n) OVER (PARTITION BY domain)) / (SELECT sum(n) FROM g) AS pooled_weight, n / (sum(n) OVER (PARTITION BY expected_state)) AS within_state_weight FROM g""")
def domain_weights(spark, sf):
    return metrics.domain_weights(tables.typed_panel(spark, sf).select("request_id", "domain", "expected_state").distinct())


CONTRAST = f"{oracle.SCORED}, g AS (SELECT model, condition, count(*) AS n, {COUNTS} FROM s GROUP BY ALL), x AS (SELECT model, condition, {SAFE_MACRO} AS macro FROM g), k AS (SELECT a.model AS model_a, b.model AS model_b, a.condition, b.macro - a.macro AS diff FROM x a JOIN x b ON a.condition = b.condition AND a.model < b.model)"
PAIRED = f"{CONTRAST} SELECT u.model_a, u.model_b, split_part(u.condition, '_', 1) AS contract, round(u.diff, 9) AS diff_unconstrained, round(w.diff, 9) AS diff_constrained, @REVERSED@ AS reversed FROM k u JOIN k w ON u.model_a = w.model_a AND u.model_b = w.model_b AND w.condition = replace(u.condition, '_unconstrained', '_constrained') WHERE u.condition LIKE '%\\_unconstrained' ESCAPE '\\'"


def contrasts(spark, sf) -> DataFrame:
    return metrics.decoder_shift(metrics.macro_micro(scored(spark, sf), CELL), "state_macro")


@query("decoder_reversal_product", PAIRED.replace("@REVERSED@", "u.diff * w.diff < 0"))
def decoder_reversal_product(spark, sf):
    return contrasts(spark, sf).select("model_a", "model_b", "contract", F.round("u", 9).alias("diff_unconstrained"), F.round("w", 9).alias("diff_constrained"), (F.col("u") * F.col("w") < 0).alias("reversed"))


@query("decoder_reversal_sign", PAIRED.replace("@REVERSED@", "sign(u.diff) <> sign(w.diff)"))
def decoder_reversal_sign(spark, sf):
    return contrasts(spark, sf).select("model_a", "model_b", "contract", F.round("u", 9).alias("diff_unconstrained"), F.round("w", 9).alias("diff_constrained"), (F.signum("u") != F.signum("w")).alias("reversed"))


@query("contract_by_decoder_interaction", f"{CONTRAST} SELECT model, round(sum(macro * CASE condition WHEN 'compact_constrained' THEN 1 WHEN 'full_unconstrained' THEN 1 ELSE -1 END), 9) AS interaction FROM x GROUP BY ALL")
def contract_by_decoder_interaction(spark, sf):
    terms = spark.createDataFrame([("compact_constrained", 1), ("full_unconstrained", 1), ("compact_unconstrained", -1), ("full_constrained", -1)], "condition string, weight int")
    return metrics.linear(metrics.macro_micro(scored(spark, sf), CELL), terms, "condition", ["model"], "state_macro", "interaction")


@query("condition_diagnostics", f"""{oracle.SCORED} SELECT model, condition, count(*) AS n, count(*) FILTER (finish_reason = 'length') AS truncated, count(*) FILTER (finish_reason IS NULL) AS missing_finish, count(*) FILTER (schema_valid AND NOT logical_valid) AS illogical,
 CASE WHEN count(*) FILTER (schema_valid) > 0 THEN count(*) FILTER (schema_valid AND NOT logical_valid) / count(*) FILTER (schema_valid) END AS illogical_rate, sum(output_tokens)::BIGINT AS output_total, sum(output_tokens) / count(output_tokens) AS output_mean, count(*) - count(output_tokens) AS output_missing, sum(prompt_tokens)::BIGINT AS prompt_total FROM s GROUP BY ALL""")
def condition_diagnostics(spark, sf):
    return metrics.diagnostics(scored(spark, sf), CELL)


@query("compact_vs_full_pivot", f"{oracle.SCORED} SELECT model, count(*) FILTER (state_correct AND condition = 'compact_constrained') AS compact_constrained, count(*) FILTER (state_correct AND condition = 'compact_unconstrained') AS compact_unconstrained, count(*) FILTER (state_correct AND condition = 'full_constrained') AS full_constrained, count(*) FILTER (state_correct AND condition = 'full_unconstrained') AS full_unconstrained FROM s GROUP BY ALL")
def compact_vs_full_pivot(spark, sf):
    names = ["compact_constrained", "compact_unconstrained", "full_constrained", "full_unconstrained"]
    return scored(spark, sf).groupBy("model").pivot("condition", names).agg(n_if("state_correct"))


@query("token_audit", f"{oracle.PANEL} SELECT model, min(prompt_tokens) AS least, avg(prompt_tokens) AS mean, quantile_disc(prompt_tokens, 0.95)::DOUBLE AS p95, max(prompt_tokens) AS most, count(*) FILTER (prompt_tokens + 192 > 600) AS over_context FROM panel WHERE condition = 'full_unconstrained' GROUP BY ALL")
def token_audit(spark, sf):
    rows = tables.typed_panel(spark, sf).where("condition = 'full_unconstrained'")
    return metrics.audit(rows, "model", "prompt_tokens", reserve=192, limit=600)


@query("contexts_that_fit_all", f"{oracle.PANEL} SELECT request_id, bool_and(prompt_tokens + m * 10 + 192 <= 600) AS fits FROM panel WHERE c = 0 GROUP BY ALL")
def contexts_that_fit_all(spark, sf):
    rows = tables.typed_panel(spark, sf).where("condition = 'compact_unconstrained'")
    own = F.col("prompt_tokens") + F.substring("model", 2, 9).cast("int") * 10 + 192
    return rows.groupBy("request_id").agg(F.bool_and(own <= 600).alias("fits"))


@query("criterion_assessments", f"{oracle.SCORED} SELECT model, condition, CASE WHEN logical_valid AND NOT abstained THEN st WHEN runtime_failed THEN 'INFERENCE_FAILURE' WHEN abstained THEN 'MODEL_ABSTENTION' ELSE 'PARSE_FAILURE' END AS state, count(*) AS n, count(DISTINCT case_id) AS cases FROM s GROUP BY ALL")
def criterion_assessments(spark, sf):
    state = contracts.criterion_state(F.col("v"), F.col("runtime_failed"))
    return scored(spark, sf).groupBy(*CELL, state.alias("state")).agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))
