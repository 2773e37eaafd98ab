"""Queries of paired tests, corrections, rankings and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators import paired, resample
from weighbridge.plans import notes, oracle, responses
from weighbridge.plans.registry import query

#: Replicates of the contract analyses.
REPLICATES = 10_000
PAIRS = f"{oracle.SCORED}, q AS (SELECT a.condition, a.model AS arm_a, b.model AS arm_b, count(*) FILTER (a.state_correct AND NOT b.state_correct) AS a_only, count(*) FILTER (NOT a.state_correct AND b.state_correct) AS b_only, count(*) FILTER (a.state_correct AND b.state_correct) AS both, count(*) AS n FROM s a JOIN s b ON a.request_id = b.request_id AND a.condition = b.condition AND a.model < b.model GROUP BY ALL)"
EXACT = "CASE WHEN a_only + b_only > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))))) END"


def pairs(spark, sf) -> DataFrame:
    return paired.discordance(responses.scored(spark, sf), ["condition"], "model", "state_correct", "request_id")


@query("paired_discordance", f"{PAIRS} SELECT * FROM q")
def paired_discordance(spark, sf):
    return pairs(spark, sf)


@query("mcnemar_exact", f"{PAIRS} SELECT condition, arm_a, arm_b, round({EXACT}, 9) AS p FROM q")
def mcnemar_exact(spark, sf):
    return pairs(spark, sf).select("condition", "arm_a", "arm_b", F.round(paired.mcnemar(F.col("a_only"), F.col("b_only")), 9).alias("p"))


@query("holm_adjusted", f"{PAIRS}, e AS (SELECT condition, arm_a, arm_b, round({EXACT}, 9) AS p FROM q), o AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY condition) - row_number() OVER (PARTITION BY condition ORDER BY p, arm_a, arm_b) + 1) * p) AS z FROM e WHERE p IS NOT NULL) SELECT condition, arm_a, arm_b, p, round(max(z) OVER (PARTITION BY condition ORDER BY p, arm_a, arm_b ROWS UNBOUNDED PRECEDING), 7) AS adjusted FROM o UNION ALL SELECT condition, arm_a, arm_b, p, NULL FROM e WHERE p IS NULL")
def holm_adjusted(spark, sf):
    rows = mcnemar_exact(spark, sf)
    return paired.holm(rows, "p", ["arm_a", "arm_b"], ["condition"]).withColumn("adjusted", F.round("adjusted", 7))


DRAW = f"""cl AS (SELECT case_id, row_number() OVER (ORDER BY substr(sha256(case_id::VARCHAR), 1, 3), case_id) - 1 AS slot, count(*) OVER () AS size FROM (SELECT DISTINCT case_id FROM s)),
 dr AS (SELECT r, ('0x' || substr(sha256(concat_ws('|', r::VARCHAR, slot::VARCHAR)), 1, 8))::BIGINT % size AS pick FROM cl, range(0, {REPLICATES}) t(r)),
 w AS (SELECT r AS replicate, case_id, count(*) AS w FROM dr JOIN cl ON cl.slot = dr.pick GROUP BY ALL),
 cs AS (SELECT case_id, model, condition, count(*) AS n, {responses.COUNTS} FROM s GROUP BY ALL),
 rp AS (SELECT replicate, model, condition, sum(w * n) AS n, sum(w * n_present) AS n_present, sum(w * n_absent) AS n_absent, sum(w * n_present_ok) AS n_present_ok, sum(w * n_absent_ok) AS n_absent_ok FROM cs JOIN w USING (case_id) GROUP BY ALL),
 rr AS (SELECT replicate, model, condition, (n_present_ok + n_absent_ok) / n AS micro, {responses.SAFE_MACRO} AS macro FROM rp)"""
BOOT = f"{oracle.SCORED}, {DRAW}"


def replicates(spark, sf) -> DataFrame:
    """Micro and macro agreement of each replicate, model and condition, one draw for all cells."""
    rows = responses.scored(spark, sf)
    by = responses.metrics.by_state(rows, ["case_id", "model", "condition"])
    counts = ["n", "n_present", "n_absent", "n_present_ok", "n_absent_ok"]
    return responses.metrics.with_rates(resample.resampled(by, by.select("case_id").distinct(), "case_id", REPLICATES, ["model", "condition"], counts))


@query("bootstrap_weights", f"{BOOT} SELECT replicate, case_id, w FROM w")
def bootstrap_weights(spark, sf):
    rows = responses.tables.typed_panel(spark, sf).select("case_id").distinct()
    return paired.weights(rows, "case_id", REPLICATES)


@query("cluster_bootstrap_replicates", f"{BOOT} SELECT replicate, model, condition, round(micro, 9) AS micro, round(macro, 9) AS macro FROM rr")
def cluster_bootstrap_replicates(spark, sf):
    return replicates(spark, sf).select("replicate", "model", "condition", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


DIFF = f"{BOOT}, df AS (SELECT a.replicate, a.condition, a.model AS model_a, b.model AS model_b, round(b.micro - a.micro, 9) AS micro, round(b.macro - a.macro, 9) AS macro FROM rr a JOIN rr b ON a.replicate = b.replicate AND a.condition = b.condition AND a.model < b.model)"


def differences(spark, sf) -> DataFrame:
    diff = resample.paired_differences(replicates(spark, sf), ["replicate", "condition"], "model", ["micro", "macro"])
    return diff.select("replicate", "condition", F.col("arm_a").alias("model_a"), F.col("arm_b").alias("model_b"), F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


KEYS = ("condition", "model_a", "model_b")


@query("cluster_bootstrap_micro", f"{DIFF}, o AS (SELECT condition, model_a, model_b, list_sort(list(micro)) AS v FROM df GROUP BY ALL) SELECT condition, model_a, model_b, v[floor(0.025 * (len(v) - 1))::INT + 1] AS low, v[ceil(0.975 * (len(v) - 1))::INT + 1] AS high FROM o")
def cluster_bootstrap_micro(spark, sf):
    return differences(spark, sf).groupBy(*KEYS).agg(paired.interval_by_index(F.collect_list("micro")).alias("i")).select(*KEYS, "i.*")


@query("cluster_bootstrap_macro", f"{DIFF} SELECT condition, model_a, model_b, round(quantile_cont(macro, 0.025), 8) AS low, round(quantile_cont(macro, 0.975), 8) AS high, count(macro) AS used, count(*) - count(macro) AS excluded FROM df GROUP BY ALL")
def cluster_bootstrap_macro(spark, sf):
    p = paired.interval_linear(F.collect_list("macro"))
    return differences(spark, sf).groupBy(*KEYS).agg(paired.scaled_round(p["low"]).alias("low"), paired.scaled_round(p["high"]).alias("high"), F.count("macro").alias("used"), (F.count("*") - F.count("macro")).alias("excluded"))


@query("interval_outer_index", f"{DIFF}, o AS (SELECT condition, model_a, model_b, list_sort(list(micro)) AS v FROM df GROUP BY ALL) SELECT condition, model_a, model_b, v[floor(0.025 * len(v))::INT + 1] AS low, v[least(len(v) - 1, ceil(0.975 * len(v)) - 1)::INT + 1] AS high FROM o")
def interval_outer_index(spark, sf):
    return differences(spark, sf).groupBy(*KEYS).agg(paired.interval_by_index(F.collect_list("micro"), style="outer").alias("i")).select(*KEYS, "i.*")


@query("interval_inverted_cdf", f"{DIFF} SELECT condition, model_a, model_b, quantile_disc(micro, 0.025) AS low, quantile_disc(micro, 0.975) AS high FROM df GROUP BY ALL")
def interval_inverted_cdf(spark, sf):
    d = differences(spark, sf)
    return d.groupBy(*KEYS).agg(*(F.expr(f"percentile_disc({q}) within group (order by micro)").alias(n) for n, q in (("low", 0.025), ("high", 0.975))))


#: Pairs of models of a condition: their intervals hold together at the level divided by this.
FAMILY = 6


@query("interval_inverted_cdf_family", f"{DIFF} SELECT condition, model_a, model_b, quantile_disc(micro, {0.025 / FAMILY!r}) AS low, quantile_disc(micro, {1 - 0.025 / FAMILY!r}) AS high FROM df GROUP BY ALL")
def interval_inverted_cdf_family(spark, sf):
    """The same at the Bonferroni level of all pairs of a condition."""
    d = differences(spark, sf)
    return d.groupBy(*KEYS).agg(*(F.expr(f"percentile_disc({q!r}D) within group (order by micro)").alias(n) for n, q in (("low", 0.025 / FAMILY), ("high", 1 - 0.025 / FAMILY))))


@query("bootstrap_interaction", f"{BOOT}, x AS (SELECT replicate, model, round(sum(macro * CASE condition WHEN 'compact_constrained' THEN 1 WHEN 'full_unconstrained' THEN 1 ELSE -1 END), 9) AS z FROM rr GROUP BY ALL) SELECT model, round(quantile_cont(z, 0.025), 8) AS low, round(quantile_cont(z, 0.975), 8) AS high FROM x GROUP BY ALL")
def bootstrap_interaction(spark, sf):
    terms = spark.createDataFrame([("compact_constrained", 1), ("full_unconstrained", 1), ("compact_unconstrained", -1), ("full_constrained", -1)], "condition string, weight int")
    z = responses.metrics.linear(replicates(spark, sf), terms, "condition", ["replicate", "model"], "macro", "z")
    p = paired.interval_linear(F.collect_list("z"))
    return z.groupBy("model").agg(paired.scaled_round(p["low"]).alias("low"), paired.scaled_round(p["high"]).alias("high"))


STRATA = f"""{oracle.SCORED}, cl AS (SELECT domain, request_id, row_number() OVER (PARTITION BY domain ORDER BY substr(sha256(request_id::VARCHAR), 1, 3), request_id) - 1 AS slot, count(*) OVER (PARTITION BY domain) AS size FROM (SELECT DISTINCT domain, request_id FROM s)),
 dr AS (SELECT r, domain, ('0x' || substr(sha256(concat_ws('|', r::VARCHAR, domain, slot::VARCHAR)), 1, 8))::BIGINT % size AS pick FROM cl, range(0, {REPLICATES}) t(r)),
 w AS (SELECT r AS replicate, cl.domain, request_id, count(*) AS w FROM dr JOIN cl ON cl.slot = dr.pick AND cl.domain = dr.domain GROUP BY ALL),
 d AS (SELECT replicate, model, s.domain, sum(w * state_correct::INT) / sum(w) AS acc FROM s JOIN w ON s.request_id = w.request_id AND s.domain = w.domain WHERE condition = 'full_constrained' GROUP BY ALL),
 b AS (SELECT replicate, model, round(avg(acc), 9) AS score FROM d GROUP BY ALL)"""


def stratified(spark, sf) -> DataFrame:
    rows = responses.scored(spark, sf).where("condition = 'full_constrained'")
    by = rows.groupBy("domain", "request_id", "model").agg(F.count("*").alias("n"), F.count_if("state_correct").alias("ok"))
    sums = resample.resampled(by, by.select("domain", "request_id").distinct(), "request_id", REPLICATES, ["model", "domain"], ["n", "ok"], ["domain"])
    return sums.groupBy("replicate", "model").agg(F.round(F.avg(F.col("ok") / F.col("n")), 9).alias("score"))


@query("stratified_bootstrap", f"{STRATA} SELECT * FROM b")
def stratified_bootstrap(spark, sf):
    return stratified(spark, sf)


@query("bootstrap_midranks", f"{STRATA}, k AS (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY score DESC) + (count(*) OVER (PARTITION BY replicate, score) - 1) / 2 AS midrank, score = max(score) OVER (PARTITION BY replicate) AS top FROM b) SELECT model, avg(midrank) AS mean_rank, count(*) FILTER (top) / count(*) AS top_share, quantile_disc(midrank, 0.5) AS median_rank FROM k GROUP BY ALL")
def bootstrap_midranks(spark, sf):
    ranked = paired.midranks(stratified(spark, sf), ["replicate"], "score")
    from pyspark.sql import Window

    top = F.col("score") == F.max("score").over(Window.partitionBy("replicate"))
    return ranked.withColumn("top", top).groupBy("model").agg(F.avg("midrank").alias("mean_rank"), (F.count_if("top") / F.count("*")).alias("top_share"), F.expr("percentile_disc(0.5) within group (order by midrank)").alias("median_rank"))


NOTE_BOOT = f"""{oracle.NOTES}, cl AS (SELECT subject_cluster, row_number() OVER (ORDER BY substr(sha256(subject_cluster::VARCHAR), 1, 3), subject_cluster) - 1 AS slot, count(*) OVER () AS size FROM (SELECT DISTINCT subject_cluster FROM s)),
 dr AS (SELECT r, ('0x' || substr(sha256(concat_ws('|', r::VARCHAR, slot::VARCHAR)), 1, 8))::BIGINT % size AS pick FROM cl, range(0, {REPLICATES}) t(r)), w AS (SELECT r AS replicate, subject_cluster, count(*) AS w FROM dr JOIN cl ON cl.slot = dr.pick GROUP BY ALL),
 cs AS (SELECT subject_cluster, model, condition, count(*) AS n, count(*) FILTER (joint) AS ok FROM s GROUP BY ALL), rr AS (SELECT replicate, model, condition, round(sum(w * ok) / sum(w * n), 9) AS joint_rate FROM cs JOIN w USING (subject_cluster) GROUP BY ALL)"""


@query("subject_bootstrap_joint", f"{NOTE_BOOT} SELECT model, condition, round(quantile_cont(joint_rate, 0.025), 8) AS low, round(quantile_cont(joint_rate, 0.975), 8) AS high, count(*) AS replicates FROM rr GROUP BY ALL")
def subject_bootstrap_joint(spark, sf):
    rows = notes.scored(spark, sf)
    by = rows.groupBy("subject_cluster", "model", "condition").agg(F.count("*").alias("n"), F.count_if("joint").alias("ok"))
    sums = resample.resampled(by, by.select("subject_cluster").distinct(), "subject_cluster", REPLICATES, ["model", "condition"], ["n", "ok"]).withColumn("r", F.round(F.col("ok") / F.col("n"), 9))
    p = paired.interval_linear(F.collect_list("r"))
    return sums.groupBy("model", "condition").agg(paired.scaled_round(p["low"]).alias("low"), paired.scaled_round(p["high"]).alias("high"), F.count("*").alias("replicates"))
