"""Composed reports and the checks behind them: gate summary, policy leaderboard, domain reversals, endpoint intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.functions import contracts, scalars
from weighbridge.operators import invariants, paired, resample, traversal
from weighbridge.plans import notes, oracle, responses, trees
from weighbridge.plans.paired import PAIRS, pairs
from weighbridge.plans.registry import query
from weighbridge.sources import tables

BOTH = oracle.SCORED + ",\n" + oracle.chain(tables.NOTES, "q", 2) + f",\nnts AS (SELECT * FROM q{oracle.M})," + oracle.judged_notes("nts", "t")
GATE = f"""{BOTH}, r AS (SELECT 'typed_state' AS task, runtime_failed, parse_valid, schema_valid, logical_valid, abstained, state_correct AS ok FROM s WHERE condition = 'full_constrained' UNION ALL
 SELECT 'note_heads', runtime_failed, parse_valid, schema_valid, logical_valid, abstained, coalesce(logical_valid AND NOT abstained AND jd = detection AND je = encounter AND jn = negation, false) FROM t WHERE condition = 'constrained')
 SELECT coalesce(task, 'all') AS task, count(*) AS cases, count(*) FILTER (NOT runtime_failed) AS completed, count(*) FILTER (parse_valid) AS parse_valid, count(*) FILTER (schema_valid) AS schema_valid, count(*) FILTER (logical_valid) AS logical_valid, count(*) FILTER (abstained) AS abstained,
 count(*) FILTER (ok) AS correct, count(*) FILTER (ok) / count(*) AS agreement, count(*) FILTER (ok) / count(*) FILTER (logical_valid) AS agreement_if_sound FROM r GROUP BY GROUPING SETS ((task), ())"""


@query("gate_summary", GATE)
def gate_summary(spark, sf):
    """Both tasks of a compatibility gate, each and together; a note is right only if all three heads are."""
    flags = ["v.parse_valid", "v.schema_valid", "v.logical_valid", "v.abstained"]
    typed = responses.scored(spark, sf).where("condition = 'full_constrained'").select(F.lit("typed_state").alias("task"), "runtime_failed", *flags, F.col("state_correct").alias("ok"))
    v = F.col("v")
    exact = v["logical_valid"] & ~v["abstained"] & (v["detection"] == F.col("detection")) & (v["encounter"] == F.col("encounter")) & (v["negation"] == F.col("negation"))
    note = notes.scored(spark, sf).where("condition = 'constrained'").select(F.lit("note_heads").alias("task"), "runtime_failed", *flags, F.coalesce(exact, F.lit(False)).alias("ok"))
    n = {c: F.count_if(c) for c in ("parse_valid", "schema_valid", "logical_valid", "abstained")}
    by = typed.unionByName(note).groupingSets([[F.col("task")], []], "task")
    out = by.agg(F.count("*").alias("cases"), F.count_if(~F.col("runtime_failed")).alias("completed"), *(x.alias(c) for c, x in n.items()), F.count_if("ok").alias("correct"), (F.count_if("ok") / F.count("*")).alias("agreement"), F.try_divide(F.count_if("ok"), n["logical_valid"]).alias("agreement_if_sound"))
    return out.withColumn("task", F.coalesce("task", F.lit("all")))


@query("reference_counts", f"{oracle.PANEL}, r AS (SELECT DISTINCT request_id, case_id, domain, expected_state FROM panel) SELECT domain, expected_state, count(*) AS requests, count(DISTINCT case_id) AS cases FROM r GROUP BY GROUPING SETS ((domain, expected_state), (domain), (expected_state), ())")
def reference_counts(spark, sf):
    rows = tables.typed_panel(spark, sf).select("request_id", "case_id", "domain", "expected_state").distinct()
    sets = [[F.col("domain"), F.col("expected_state")], [F.col("domain")], [F.col("expected_state")], []]
    return rows.groupingSets(sets, "domain", "expected_state").agg(F.count("*").alias("requests"), F.count_distinct("case_id").alias("cases"))


@query("throughput", f"{oracle.PANEL} SELECT model, count(*) AS requests, (sum(prompt_tokens) + sum(coalesce(output_tokens, 0)))::BIGINT AS tokens, count(*) / (sum(prompt_tokens) / 1000) AS requests_per_second, (sum(prompt_tokens) + sum(coalesce(output_tokens, 0))) / (sum(prompt_tokens) / 1000) AS tokens_per_second FROM panel GROUP BY ALL")
def throughput(spark, sf):
    tokens, seconds = F.sum("prompt_tokens") + F.sum(F.coalesce("output_tokens", F.lit(0))), F.sum("prompt_tokens") / 1000
    return tables.typed_panel(spark, sf).groupBy("model").agg(F.count("*").alias("requests"), tokens.alias("tokens"), F.try_divide(F.count("*"), seconds).alias("requests_per_second"), F.try_divide(tokens, seconds).alias("tokens_per_second"))


@query("assessment_violations", f"{oracle.SCORED}, a AS (SELECT *, CASE WHEN logical_valid AND NOT abstained THEN st WHEN runtime_failed THEN 'INFERENCE_FAILURE' WHEN abstained THEN 'MODEL_ABSTENTION' ELSE 'PARSE_FAILURE' END AS state, request_id % 50 = 0 AS tampered FROM s) SELECT model, count(*) FILTER ((state = 'MODEL_ABSTENTION') <> (abstained <> tampered)) AS abstention_flag, count(*) FILTER ((state = 'INFERENCE_FAILURE') <> runtime_failed) AS failure_flag, count(*) FILTER (cf NOT BETWEEN 0 AND 1) AS confidence FROM a GROUP BY ALL")
def assessment_violations(spark, sf):
    """States whose flags do not agree; the abstention flag of every fiftieth request is turned round to have some."""
    rows = responses.scored(spark, sf)
    state = contracts.criterion_state(F.col("v"), F.col("runtime_failed"))
    flag = F.col("v.abstained") != (F.col("request_id") % 50 == 0)
    confidence = F.get_json_object("v.assembled", "$.confidence").try_cast("double")
    return rows.groupBy("model").agg(F.count_if((state == "MODEL_ABSTENTION") != flag).alias("abstention_flag"), F.count_if((state == "INFERENCE_FAILURE") != F.col("runtime_failed")).alias("failure_flag"), F.count_if(~confidence.between(0, 1)).alias("confidence"))


DOMAIN_DIFF = f"{responses.DOMAIN}, k AS (SELECT a.model AS model_a, b.model AS model_b, domain, condition, b.macro - a.macro AS diff FROM d a JOIN d b USING (domain, condition) WHERE a.model < b.model)"


@query("domain_reversals", f"{DOMAIN_DIFF} SELECT u.model_a, u.model_b, u.domain, u.diff * w.diff < 0 AS reversed, u.diff = 0 OR w.diff = 0 AS tied FROM k u JOIN k w ON u.model_a = w.model_a AND u.model_b = w.model_b AND u.domain = w.domain WHERE u.condition = 'full_unconstrained' AND w.condition = 'full_constrained'")
def domain_reversals(spark, sf):
    cells = responses.metrics.by_state(responses.scored(spark, sf).where("condition like 'full%'"), ("model", "condition", "domain"))
    side = cells.groupBy("model", "domain").pivot("condition", ["full_unconstrained", "full_constrained"]).agg(F.first("macro"))
    a = side.select(F.col("model").alias("model_a"), "domain", F.col("full_unconstrained").alias("ua"), F.col("full_constrained").alias("wa"))
    b = side.select(F.col("model").alias("model_b"), "domain", F.col("full_unconstrained").alias("ub"), F.col("full_constrained").alias("wb"))
    u, w = F.col("ub") - F.col("ua"), F.col("wb") - F.col("wa")
    return a.join(b, "domain").where("model_a < model_b").select("model_a", "model_b", "domain", (u * w < 0).alias("reversed"), ((u == 0) | (w == 0)).alias("tied"))


WANT = "CASE o_orderkey % 3 WHEN 0 THEN 'Refer' WHEN 1 THEN 'End of Decision Tree' ELSE 'Treat' END"
POLICY = f"{trees.RAWS}, {trees.machine_sql('strict', 'st')}, {trees.machine_sql('legacy', 'lg')}, {trees.machine_sql('period', 'pd')}, u AS (SELECT 'strict' AS policy, * FROM st UNION ALL SELECT 'legacy', * FROM lg UNION ALL SELECT 'period', * FROM pd), x AS (SELECT policy, o_orderpriority AS domain, coalesce(action = {WANT}, false) AS ok FROM u JOIN orders ON o_orderkey::VARCHAR = case_id)"


@query("policy_leaderboard", f"{POLICY}, g AS (SELECT policy, domain, count(*) AS n, count(*) FILTER (ok) AS k FROM x GROUP BY ALL) SELECT policy, sum(n)::BIGINT AS n, sum(k)::BIGINT AS correct, sum(k) / sum(n) AS pooled, round(avg(k / n), 9) AS domain_balanced FROM g GROUP BY ALL")
def policy_leaderboard(spark, sf):
    own = {"domain": F.col("o_orderpriority"), "want": contracts.terminal_label(F.expr(trees.EXPECTED))}
    every = trees.walked_by(spark, sf, "strict", "legacy", "period", keep=own)
    by = every.groupBy("policy", "domain").agg(F.count("*").alias("n"), F.count_if(F.col("action") == F.col("want")).alias("k"))
    return by.groupBy("policy").agg(F.sum("n").alias("n"), F.sum("k").alias("correct"), (F.sum("k") / F.sum("n")).alias("pooled"), F.round(F.avg(F.col("k") / F.col("n")), 9).alias("domain_balanced"))


REFERENCE = trees.machine_sql("strict", "g").replace(trees.ANSWER["strict"], "CASE WHEN (o_orderkey * k) % 3 = 0 THEN 'yes' ELSE 'no' END")


@query("reference_traversal", f"{trees.RAWS}, {REFERENCE} SELECT case_id, status, action, calls FROM g")
def reference_traversal(spark, sf):
    """Answers from membership of a question in the features of a case."""
    orders = tables.table(spark, sf, "orders")
    asked = F.array(*(F.lit(f"q{k}") for k in range(1, 7)))
    positive = F.filter(asked, lambda q: (F.col("o_orderkey") * F.substring(q, 2, 1).cast("int")) % 3 == 0)
    cases = orders.select(F.col("o_orderkey").cast("string").alias("case"), positive.alias("positive"), F.explode(asked).alias("question"))
    answers = cases.select("case", "question", F.when(F.array_contains("positive", F.col("question")), "yes").otherwise("no").alias("answer"))
    out = traversal.walk(spark, trees.MACHINE, "s1", answers)
    return out.select(F.col("case").alias("case_id"), "status", contracts.terminal_label(F.col("action")).alias("action"), F.col("calls").cast("long").alias("calls"))


@query("exhaustive_token_audit", "SELECT k AS question, count(*) AS n, min(o_orderkey % 50 + k) AS least, max(o_orderkey % 50 + k) AS most FROM orders, range(1, 7) t(k) GROUP BY ALL")
def exhaustive_token_audit(spark, sf):
    cases = tables.table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("question"))
    tokens = F.col("o_orderkey") % 50 + F.col("question")
    return cases.groupBy("question").agg(F.count("*").alias("n"), F.min(tokens).alias("least"), F.max(tokens).alias("most"))


@query("batch_manifest", "WITH f AS (SELECT DISTINCT doc_id // 4 AS batch FROM labels), e AS (SELECT unnest(range(0, (SELECT max(batch) FROM f) + 3)) AS batch) SELECT batch::BIGINT AS batch, 'missing' AS problem FROM e WHERE batch NOT IN (SELECT batch FROM f)")
def batch_manifest(spark, sf):
    """Batches that a manifest expects and that are not there, or are there and not expected."""
    found = tables.table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 4).alias("batch")).distinct()
    expected = found.agg(F.max("batch").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 2)).alias("batch"))
    both = expected.withColumn("e", F.lit(True)).join(found.withColumn("f", F.lit(True)), "batch", "full")
    return both.where("e is null or f is null").select("batch", F.when(F.col("f").isNull(), "missing").otherwise("unexpected").alias("problem"))


@query("frozen_counts", "SELECT 'region' AS name, count(*) AS observed, count(*) = 5 AS as_frozen FROM region UNION ALL SELECT 'nation', count(*), count(*) = 25 FROM nation UNION ALL SELECT 'labels', count(*), count(*) = 7 FROM labels")
def frozen_counts(spark, sf):
    out = None
    for name, frozen in (("region", 5), ("nation", 25), ("labels", 7)):
        own = tables.table(spark, sf, name).agg(F.lit(name).alias("name"), F.count("*").alias("observed"), (F.count("*") == frozen).alias("as_frozen"))
        out = own if out is None else out.unionByName(own)
    return out


@query("gold_hierarchy_violations", "SELECT count(*) AS n, count(*) FILTER (quality = 0 AND toxic = 1) AS violations FROM labels")
def gold_hierarchy_violations(spark, sf):
    return tables.table(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("violations"))


@query("rerun_determinism", f"{oracle.PANEL} SELECT model, count(*) AS n, count(*) FILTER (raw_output IS NOT DISTINCT FROM CASE WHEN request_id % 40 = 0 THEN upper(raw_output) ELSE raw_output END) AS same FROM panel WHERE condition = 'full_unconstrained' GROUP BY ALL")
def rerun_determinism(spark, sf):
    """A rerun, some of whose outputs differ, against the primary run."""
    rows = tables.typed_panel(spark, sf).where("condition = 'full_unconstrained'").select("model", "request_id", "raw_output")
    again = rows.select("model", "request_id", F.when(F.col("request_id") % 40 == 0, F.upper("raw_output")).otherwise(F.col("raw_output")).alias("rerun"))
    return rows.join(again, ["model", "request_id"]).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("raw_output").eqNullSafe(F.col("rerun"))).alias("same"))


@query("published_rows_match_once", f"{PAIRS}, p AS (SELECT condition, arm_a, arm_b, a_only FROM q WHERE a_only <> b_only UNION ALL SELECT condition, arm_a, arm_b, a_only + 1 FROM q WHERE a_only > b_only) SELECT q.condition, q.arm_a, q.arm_b, count(p.a_only) AS published, count(p.a_only) = 1 AS once, coalesce(bool_and(p.a_only = q.a_only), false) AS equal FROM q LEFT JOIN p USING (condition, arm_a, arm_b) GROUP BY ALL")
def published_rows_match_once(spark, sf):
    """Recomputed rows against published ones, some of which are missing, repeated or other."""
    fresh = pairs(spark, sf)
    key = ["condition", "arm_a", "arm_b"]
    published = fresh.where("a_only <> b_only").select(*key, F.col("a_only").alias("value"))
    published = published.unionByName(fresh.where("a_only > b_only").select(*key, (F.col("a_only") + 1).alias("value")))
    return invariants.matched_once(fresh, published, key, "a_only", "value")


@query("rendered_prompts", "SELECT doc_id, sha256('Criterion: ' || source || chr(10) || 'Note: ' || text || chr(10) || 'Answer in ' || upper(lang) || '.') AS prompt_sha256 FROM documents")
def rendered_prompts(spark, sf):
    shown = F.concat(F.lit("Criterion: "), "source", F.lit("\nNote: "), "text", F.lit("\nAnswer in "), F.upper("lang"), F.lit("."))
    return tables.table(spark, sf, "documents").select("doc_id", F.sha2(shown, 256).alias("prompt_sha256"))


@query("public_projection", "SELECT doc_id, lang, source, n_chars FROM documents")
def public_projection(spark, sf):
    """Documents without restricted columns; a result that still names one is an error."""
    out = tables.table(spark, sf, "documents").drop("text")
    if {"text", "raw_output", "note_context"} & set(out.columns):
        raise ValueError("a restricted column is left")
    return out


@query("report_lines", f"{oracle.SCORED}, g AS (SELECT model, condition, count(*) FILTER (state_correct) AS k, count(*) AS n FROM s GROUP BY ALL) SELECT '| ' || model || ' | ' || condition || ' | ' || k || ' / ' || n || ' |' AS line FROM g")
def report_lines(spark, sf):
    by = responses.scored(spark, sf).groupBy("model", "condition").agg(F.count_if("state_correct").alias("k"), F.count("*").alias("n"))
    return by.select(F.format_string("| %s | %s | %d / %d |", "model", "condition", "k", "n").alias("line"))


def markdown(rows: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small frame as a table; numbers to so many digits, missing ones as a dash. More than `most` rows are an error."""
    found = rows.orderBy(*rows.columns).take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a table")
    shown = [[f"{v:.{digits}f}" if isinstance(v, float) else "-" if v is None else str(v) for v in r] for r in found]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *shown])


#: Replicates of the endpoint report.
REPLICATES = 2_000
#: Each endpoint: the column that is averaged over the labels of a head. Joint agreement is the recall of its one label.
MEANS = {"detection_macro_f1": ("f1", "detection"), "detection_balanced_accuracy": ("recall", "detection"), "encounter_macro_f1": ("f1", "encounter"), "negation_macro_f1": ("f1", "negation"), "joint_exact_match": ("recall", "joint")}
ENDPOINTS = f"""{oracle.NOTES}, c AS (SELECT * FROM s WHERE condition = 'constrained'), hx AS (SELECT subject_cluster, model, 'detection' AS head, detection AS g, p_detection AS p FROM c UNION ALL SELECT subject_cluster, model, 'encounter', encounter, p_encounter FROM c WHERE detection = 'yes'
 UNION ALL SELECT subject_cluster, model, 'negation', negation, p_negation FROM c WHERE detection = 'yes' UNION ALL SELECT subject_cluster, model, 'joint', 'yes', CASE WHEN joint THEN 'yes' ELSE 'no' END FROM c),
 cx AS (SELECT subject_cluster, model, head, g, p, count(*) AS n FROM hx GROUP BY ALL), {notes.LABEL_ROWS[:-1]}, ('joint', 'yes')),
 cl AS (SELECT subject_cluster, row_number() OVER (ORDER BY substr(sha256(subject_cluster::VARCHAR), 1, 3), subject_cluster) - 1 AS slot, count(*) OVER () AS size FROM (SELECT DISTINCT subject_cluster FROM c)),
 dr AS (SELECT r, ('0x' || substr(sha256(concat_ws('|', r::VARCHAR, slot::VARCHAR)), 1, 8))::BIGINT % size AS pick FROM cl, range(0, {REPLICATES}) t(r)), w AS (SELECT r AS replicate, subject_cluster, count(*) AS w FROM dr JOIN cl ON cl.slot = dr.pick GROUP BY ALL),
 x AS (SELECT replicate, model, head, label, coalesce(sum(w * n) FILTER (g = label), 0) AS support, coalesce(sum(w * n) FILTER (p = label), 0) AS predicted, coalesce(sum(w * n) FILTER (g = label AND p = label), 0) AS tp FROM cx JOIN w USING (subject_cluster) JOIN lb USING (head) GROUP BY ALL),
 y AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM x), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM y),
 e AS (SELECT replicate, model, {", ".join(f"coalesce(avg({c}) FILTER (head = '{h}'), 0) AS {name}" for name, (c, h) in MEANS.items())} FROM f GROUP BY ALL), u AS (SELECT * FROM e UNPIVOT (v FOR endpoint IN ({", ".join(MEANS)}))),
 o AS (SELECT a.model AS model_a, b.model AS model_b, a.endpoint, list_sort(list(round(b.v - a.v, 8))) AS d FROM u a JOIN u b ON a.replicate = b.replicate AND a.endpoint = b.endpoint AND a.model < b.model GROUP BY ALL),
 b AS (SELECT model_a, model_b, endpoint, d[floor(0.025 * len(d))::INT + 1] AS low, d[least(len(d) - 1, ceil(0.975 * len(d)) - 1)::INT + 1] AS high FROM o)"""


@query("endpoint_bootstrap", f"{ENDPOINTS} SELECT * FROM b")
def endpoint_bootstrap(spark, sf):
    """Intervals of the differences in all five endpoints: weights meet confusion counts of subjects, not rows. A head that a
    replicate has no row for counts as 0."""
    rows = notes.scored(spark, sf).where("condition = 'constrained'")
    joint = rows.select("subject_cluster", "model", F.lit("joint").alias("head"), F.lit("yes").alias("g"), F.when(F.col("joint"), "yes").otherwise("no").alias("p"))
    each = notes.heads(rows, "subject_cluster").select(*joint.columns).unionByName(joint)
    cells = each.groupBy(*joint.columns).agg(F.count("*").alias("n"))
    sums = resample.resampled(cells, rows.select("subject_cluster").distinct(), "subject_cluster", REPLICATES, ["model", "head", "g", "p"], ["n"])
    k = notes.class_rates(sums, notes.labels(spark, notes.LABELS | {"joint": ("yes",)}), ["replicate", "model"])
    means = [F.coalesce(F.avg(F.when(F.col("head") == h, F.col(c))), F.lit(0.0)).alias(name) for name, (c, h) in MEANS.items()]
    z = k.groupBy("replicate", "model").agg(*means)
    z = z.select("replicate", "model", F.inline(F.array(*(F.struct(F.lit(name).alias("endpoint"), F.col(name).alias("v")) for name in MEANS))))
    diff = resample.paired_differences(z, ["replicate", "endpoint"], "model", ["v"]).select("endpoint", F.col("arm_a").alias("model_a"), F.col("arm_b").alias("model_b"), F.round("v", 8).alias("d"))
    return diff.groupBy("model_a", "model_b", "endpoint").agg(paired.interval_by_index(F.collect_list("d"), style="outer").alias("i")).select("model_a", "model_b", "endpoint", "i.*")


@query("interval_bounds", f"{ENDPOINTS} SELECT count(*) AS n, count(*) FILTER (low > high OR low < -1 OR high > 1) AS violations FROM b")
def interval_bounds(spark, sf):
    return endpoint_bootstrap(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.expr("low > high or low < -1 or high > 1")).alias("violations"))


@query("feature_count_mismatch", "SELECT count(*) AS n, count(*) FILTER (n_chars % 7 <> len(list_distinct(regexp_extract_all(text, '[A-Za-z]+')))) AS mismatches FROM documents")
def feature_count_mismatch(spark, sf):
    size = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))))
    return tables.table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") % 7 != size).alias("mismatches"))


@query("map_equality", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') = 0 AS same FROM lineitem GROUP BY ALL")
def map_equality(spark, sf):
    """Maps are compared by their sorted entries: one built in another order is the same map. Here lines by supplier against
    lines by supplier that were not returned, in the opposite order: the same where no line was returned."""
    lines = tables.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("m"))
    sets = [F.array_sort(F.collect_list(F.when(F.col(v) > 0, F.struct(F.col("l_suppkey").alias("key"), F.col(v).alias("value"))))).alias(v) for v in ("n", "m")]
    rows = lines.groupBy("l_orderkey").agg(*sets)
    a, b = F.map_from_entries("n"), F.map_from_entries(F.reverse("m"))
    return rows.select("l_orderkey", (F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))).alias("same"))


@query("model_midranks", f"{oracle.SCORED}, g AS (SELECT condition, model, count(*) FILTER (state_correct) AS k FROM s GROUP BY ALL) SELECT condition, model, rank() OVER (PARTITION BY condition ORDER BY k DESC) + (count(*) OVER (PARTITION BY condition, k) - 1) / 2 AS midrank FROM g")
def model_midranks(spark, sf):
    by = responses.scored(spark, sf).groupBy("condition", "model").agg(F.count_if("state_correct").alias("k"))
    return paired.midranks(by, ["condition"], "k").select("condition", "model", "midrank")


@query("running_agreement", f"{oracle.SCORED}, g AS (SELECT model, case_id // 128 AS batch, count(*) FILTER (state_correct) AS k, count(*) AS n FROM s WHERE condition = 'full_constrained' GROUP BY ALL) SELECT model, batch, sum(k) OVER w / sum(n) OVER w AS so_far FROM g WINDOW w AS (PARTITION BY model ORDER BY batch)")
def running_agreement(spark, sf):
    by = responses.scored(spark, sf).where("condition = 'full_constrained'").groupBy("model", F.floor(F.col("case_id") / 128).alias("batch")).agg(F.count_if("state_correct").alias("k"), F.count("*").alias("n"))
    upto = Window.partitionBy("model").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("model", "batch", (F.sum("k").over(upto) / F.sum("n").over(upto)).alias("so_far"))


@query("identity_digests", "SELECT c_custkey, regexp_full_match(sha256(c_name), '[0-9a-f]{64}') AS is_digest, trim(regexp_replace(lower(c_mktsegment || ' ' || c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def identity_digests(spark, sf):
    return tables.table(spark, sf, "customer").select("c_custkey", scalars.is_digest(F.sha2("c_name", 256)).alias("is_digest"), scalars.slug(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("slug"))
