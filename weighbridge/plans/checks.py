"""Integrity checks and set operations: what must hold of panels and tables, as counts of what does not."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weighbridge.functions import contracts, scalars
from weighbridge.operators import invariants, rules
from weighbridge.plans import oracle, responses
from weighbridge.plans.registry import query
from weighbridge.sources import tables


@query("panel_alignment", f"{oracle.PANEL} SELECT request_id, count(DISTINCT (model, condition)) AS cells, count(DISTINCT (case_id, domain, criterion_id, expected_state)) = 1 AS aligned FROM panel GROUP BY ALL")
def panel_alignment(spark, sf):
    return invariants.alignment(tables.typed_panel(spark, sf), "request_id", ["model", "condition"], ["case_id", "domain", "criterion_id", "expected_state"])


@query("duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return invariants.duplicates(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("id_symmetric_difference", "SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def id_symmetric_difference(spark, sf):
    return invariants.symmetric_difference(tables.table(spark, sf, "documents"), tables.table(spark, sf, "labels"), "doc_id")


@query("orphan_labels", "SELECT count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS orphans, count(DISTINCT l.doc_id) AS documents FROM labels l LEFT JOIN documents d USING (doc_id)")
def orphan_labels(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", F.lit(True).alias("known"))
    return tables.table(spark, sf, "labels").join(docs, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("orphans"), F.count_distinct("doc_id").alias("documents"))


@query("label_crosstab", "SELECT quality, toxic, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_crosstab(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang")
    return tables.table(spark, sf, "labels").join(docs, "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@query("stored_vs_recomputed", f"{oracle.SCORED}, x AS (SELECT *, state_correct <> (request_id % 97 = 0) AS stored FROM s) SELECT model, condition, count(*) AS n, count(*) FILTER (stored <> state_correct) AS differing FROM x GROUP BY ALL")
def stored_vs_recomputed(spark, sf):
    """Stored scores, some of them tampered with, against scores from the raw text."""
    rows = responses.scored(spark, sf)
    stored = rows.select("request_id", "model", "condition", (F.col("state_correct") != (F.col("request_id") % 97 == 0)).alias("stored"))
    return invariants.recomputed(stored, rows.select("request_id", "model", "condition", "state_correct"), ["request_id", "model", "condition"], "stored", "state_correct", ["model", "condition"])


@query("cluster_hierarchy_violations", f"{oracle.NOTE_PANEL} SELECT 'note' AS level, note_cluster::VARCHAR AS child, count(DISTINCT admission_cluster) AS parents FROM notes GROUP BY ALL HAVING count(DISTINCT admission_cluster) > 1 UNION ALL SELECT 'source', source, count(DISTINCT lang) FROM documents GROUP BY ALL HAVING count(DISTINCT lang) > 1")
def cluster_hierarchy_violations(spark, sf):
    a = invariants.several_parents(tables.note_panel(spark, sf), "note_cluster", "admission_cluster", "note")
    return a.unionByName(invariants.several_parents(tables.table(spark, sf, "documents"), "source", "lang", "source"))


@query("flag_lattice_violations", f"{oracle.SCORED} SELECT count(*) FILTER (logical_valid AND NOT schema_valid) AS logical_without_schema, count(*) FILTER (schema_valid AND NOT parse_valid) AS schema_without_parse, count(*) FILTER (state_correct AND (abstained OR NOT logical_valid)) AS correct_unusable, count(*) FILTER (runtime_failed AND parse_valid) AS failed_but_parsed FROM s")
def flag_lattice_violations(spark, sf):
    v, rows = F.col("v"), responses.scored(spark, sf)
    return rows.agg(F.count_if(v["logical_valid"] & ~v["schema_valid"]).alias("logical_without_schema"), F.count_if(v["schema_valid"] & ~v["parse_valid"]).alias("schema_without_parse"), F.count_if(F.col("state_correct") & (v["abstained"] | ~v["logical_valid"])).alias("correct_unusable"), F.count_if(F.col("runtime_failed") & v["parse_valid"]).alias("failed_but_parsed"))


@query("partition_is_exhaustive", f"{oracle.SCORED}, g AS (SELECT model, condition, {responses.PARTITION} AS part, count(*) AS n FROM s GROUP BY ALL) SELECT model, condition, sum(n)::BIGINT AS n, count(*) AS parts, sum(n) = any_value(total) AS exhaustive FROM g JOIN (SELECT model, condition, count(*) AS total FROM s GROUP BY ALL) USING (model, condition) GROUP BY ALL")
def partition_is_exhaustive(spark, sf):
    rows = responses.scored(spark, sf)
    part = contracts.partition(F.col("v"), F.col("runtime_failed"), F.col("expected_state"))
    by = rows.groupBy("model", "condition", part.alias("part")).agg(F.count("*").alias("n"))
    total = rows.groupBy("model", "condition").agg(F.count("*").alias("total"))
    return by.join(total, ["model", "condition"]).groupBy("model", "condition").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), (F.sum("n") == F.first("total")).alias("exhaustive"))


@query("unknown_contrast_models", f"{oracle.PANEL} SELECT id, a, b FROM (VALUES ('c1', 'm0', 'm1'), ('c2', 'm0', 'm9'), ('c3', 'm2', 'm2'), ('c1', 'm1', 'm2')) k(id, a, b) WHERE a = b OR a NOT IN (SELECT model FROM panel) OR b NOT IN (SELECT model FROM panel) OR id IN (SELECT id FROM (VALUES ('c1'), ('c2'), ('c3'), ('c1')) t(id) GROUP BY id HAVING count(*) > 1)")
def unknown_contrast_models(spark, sf):
    declared = spark.createDataFrame([("c1", "m0", "m1"), ("c2", "m0", "m9"), ("c3", "m2", "m2"), ("c1", "m1", "m2")], "id string, a string, b string")
    return invariants.bad_contrasts(declared, tables.typed_panel(spark, sf).select("model").distinct())


@query("tolerance_vs_published", f"{oracle.SCORED}, g AS (SELECT model, condition, count(*) AS n, {responses.COUNTS} FROM s GROUP BY ALL), x AS (SELECT model, condition, (n_present_ok + n_absent_ok) / n AS micro FROM g) SELECT model, condition, round(micro, 2) AS published, abs(micro - round(micro, 2)) <= 0.0025 AS within FROM x")
def tolerance_vs_published(spark, sf):
    micro = responses.metrics.macro_micro(responses.scored(spark, sf), responses.CELL)
    published = micro.select("model", "condition", F.round("strict_micro", 2).alias("published"))
    return invariants.within(micro, published, ["model", "condition"], "strict_micro", "published", 0.0025)


@query("set_overlap_jaccard", """WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS x, list(DISTINCT l_suppkey) FILTER (l_linestatus = 'O') AS y FROM lineitem GROUP BY ALL),
 b AS (SELECT k, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a) SELECT k AS l_orderkey, len(list_intersect(x, y)) AS both, len(list_distinct(list_concat(x, y))) AS either, list_has_all(y, x) AS subset, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 1.0 END AS jaccard FROM b""")
def set_overlap_jaccard(spark, sf):
    rows = tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("x"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("y"))
    return rows.select("l_orderkey", *invariants.overlap(F.col("x"), F.col("y")))


@query("percentile_nearest_rank", "SELECT lang, quantile_disc(n_chars, 0.5)::DOUBLE AS p50, quantile_disc(n_chars, 0.95)::DOUBLE AS p95, median(n_chars) AS median, avg(n_chars) AS mean FROM documents GROUP BY ALL")
def percentile_nearest_rank(spark, sf):
    disc = lambda q, n: F.expr(f"percentile_disc({q}) within group (order by n_chars)").alias(n)
    return tables.table(spark, sf, "documents").groupBy("lang").agg(disc(0.5, "p50"), disc(0.95, "p95"), F.median("n_chars").alias("median"), F.avg("n_chars").alias("mean"))


@query("batches_in_order", "SELECT floor(doc_id / 128)::BIGINT AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY ALL")
def batches_in_order(spark, sf):
    return tables.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 128).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("leaderboard", f"{oracle.SCORED}, g AS (SELECT model, count(*) AS n, count(*) FILTER (state_correct) AS ok FROM s WHERE condition = 'full_constrained' GROUP BY ALL) SELECT row_number() OVER (ORDER BY ok DESC, model) AS place, model, ok / n AS score FROM g")
def leaderboard(spark, sf):
    by = responses.scored(spark, sf).where("condition = 'full_constrained'").groupBy("model").agg((F.count_if("state_correct") / F.count("*")).alias("score"))
    return by.select(F.row_number().over(Window.orderBy(F.desc("score"), "model")).cast("long").alias("place"), "model", "score")




ROWS_OF = "o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') >= 2 AS met, max(l_quantity) >= 40 AS listed FROM lineitem GROUP BY ALL)"


@query("threshold_mismatch", f"WITH {ROWS_OF} SELECT count(*) AS n, count(*) FILTER (met <> listed) AS mismatches FROM o")
def threshold_mismatch(spark, sf):
    """Orders that reach the threshold by their lines against those that are listed as reaching it."""
    by = tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") == "N") >= 2).alias("met"), (F.max("l_quantity") >= 40).alias("listed"))
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("met") != F.col("listed")).alias("mismatches"))


@query("feature_union_conflicts", "WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R')) AS a, list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A')) AS b FROM lineitem GROUP BY ALL) SELECT l_orderkey, CASE WHEN len(list_intersect(coalesce(a, []), coalesce(b, []))) = 0 THEN array_to_string(list_sort(list_concat(coalesce(a, []), coalesce(b, []))), ',') END AS features FROM s")
def feature_union_conflicts(spark, sf):
    """Two feature sets of a case as one; null where one feature is in both."""
    of = lambda flag: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey"))))
    by = tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of("R").alias("a"), of("A").alias("b"))
    return by.select("l_orderkey", F.array_join(invariants.union_or_conflict(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("features"))


@query("registry_coverage", "WITH r AS (SELECT n_name FROM nation WHERE n_nationkey < 22), t AS (SELECT n_name FROM nation WHERE n_nationkey > 2) SELECT coalesce(r.n_name, t.n_name) AS n_name, CASE WHEN t.n_name IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM r FULL JOIN t ON r.n_name = t.n_name WHERE r.n_name IS NULL OR t.n_name IS NULL")
def registry_coverage(spark, sf):
    """Criteria of a registry that a tree lacks, and of the tree that the registry lacks."""
    nation = tables.table(spark, sf, "nation")
    return invariants.keyed_differences(nation.where("n_nationkey < 22").select("n_name"), nation.where("n_nationkey > 2").select("n_name"), "n_name", [])


PREFLIGHT = "p AS (SELECT doc_id AS request_id, n_chars AS tokens, sha256(text) AS prompt FROM documents WHERE doc_id % 11 <> 0), q AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS tokens, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) AS prompt FROM documents WHERE doc_id % 13 <> 0)"


@query("preflight_check", f"""WITH {PREFLIGHT}, b AS (SELECT coalesce(p.request_id, q.request_id) AS request_id, p.request_id AS l, q.request_id AS r, p.tokens IS DISTINCT FROM q.tokens AS t, p.prompt IS DISTINCT FROM q.prompt AS h FROM p FULL JOIN q ON p.request_id = q.request_id)
 SELECT request_id, 'missing' AS problem FROM b WHERE r IS NULL UNION ALL SELECT request_id, 'unexpected' FROM b WHERE l IS NULL UNION ALL SELECT request_id, 'tokens differs' FROM b WHERE l = r AND t UNION ALL SELECT request_id, 'prompt differs' FROM b WHERE l = r AND h""")
def preflight_check(spark, sf):
    """Token counts and prompt digests of a preflight against those of the responses, by request."""
    docs = tables.table(spark, sf, "documents").withColumnRenamed("doc_id", "request_id")
    saved = docs.where("request_id % 11 <> 0").select("request_id", F.col("n_chars").alias("tokens"), F.sha2("text", 256).alias("prompt"))
    text = F.when(F.col("request_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    run = docs.where("request_id % 13 <> 0").select("request_id", F.when(F.col("request_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("tokens"), F.sha2(text, 256).alias("prompt"))
    return invariants.keyed_differences(saved, run, "request_id", ["tokens", "prompt"])


@query("provenance_staleness", "SELECT n_nationkey AS name, 'digest differs' AS problem FROM nation WHERE n_nationkey % 4 = 0 AND lower(n_name) <> n_name UNION ALL SELECT n_nationkey, 'missing' FROM nation WHERE n_nationkey % 6 = 5 AND n_nationkey % 4 <> 0")
def provenance_staleness(spark, sf):
    """Stored digests of inputs against digests made now."""
    nation = tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), "n_name")
    stored = nation.select("name", F.sha2("n_name", 256).alias("digest"))
    now = nation.where("name % 6 <> 5 or name % 4 = 0").select("name", F.sha2(F.when(F.col("name") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")), 256).alias("digest"))
    return invariants.keyed_differences(stored, now, "name", ["digest"])


@query("canonical_digest", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""")
def canonical_digest(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", scalars.canonical_digest(source=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id")).alias("digest"))


#: Customers as manifests, and what is asked of them.
RULES = [
    ("name", "c_name", "pattern", "Customer#[0-9]+[0-8]", "error"),
    ("segment", "c_mktsegment", "one_of", "AUTOMOBILE|BUILDING|FURNITURE|MACHINERY", "warning"),
    ("segment_there", "c_mktsegment", "required", None, "error"),
    ("balance", "c_acctbal", "least", "0", "blocker"),
    ("balance_bound", "c_acctbal", "most", "9000", "warning"),
    ("nation", "c_nationkey", "in_table", "nation", "error"),
    ("nation_alone", "c_nationkey", "unique", None, "warning"),
    ("frozen_nation", "c_nationkey", "frozen", None, "blocker"),
    ("wrapper", "c_wrapper", "required", None, "warning"),
]
BROKEN = """WITH m AS (SELECT c_custkey AS manifest, CASE WHEN c_custkey % 37 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 41 <> 0 THEN c_mktsegment ELSE ' ' END AS seg, c_acctbal AS bal, CASE WHEN c_custkey % 43 <> 0 THEN c_nationkey + CASE WHEN c_custkey % 47 = 0 THEN 100 + c_custkey ELSE 0 END END AS nat FROM customer),
 z AS (SELECT c_custkey AS manifest, c_nationkey AS was FROM customer WHERE c_custkey % 53 <> 0),
 v AS (SELECT manifest, 'name' AS rule, 'error' AS level FROM m WHERE c_name IS NOT NULL AND NOT regexp_full_match(c_name, 'Customer#[0-9]+[0-8]') UNION ALL SELECT manifest, 'segment', 'warning' FROM m WHERE seg NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') UNION ALL SELECT manifest, 'segment_there', 'error' FROM m WHERE trim(seg) = ''
 UNION ALL SELECT manifest, 'balance', 'blocker' FROM m WHERE bal < 0 UNION ALL SELECT manifest, 'balance_bound', 'warning' FROM m WHERE bal > 9000 UNION ALL SELECT manifest, 'nation', 'error' FROM m WHERE nat NOT IN (SELECT n_nationkey FROM nation)
 UNION ALL SELECT manifest, 'nation_alone', 'warning' FROM m WHERE nat IN (SELECT nat FROM m WHERE nat IS NOT NULL GROUP BY nat HAVING count(*) > 1) UNION ALL SELECT manifest, 'frozen_nation', 'blocker' FROM m LEFT JOIN z USING (manifest) WHERE z.manifest IS NULL OR was IS DISTINCT FROM nat UNION ALL SELECT manifest, 'wrapper', 'warning' FROM m)"""


def manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Manifests out of customers, some damaged, and the rules that they break."""
    given = tables.table(spark, sf, "customer")
    damaged = {"c_name": F.expr("case when c_custkey % 37 <> 0 then c_name end"), "c_mktsegment": F.expr("case when c_custkey % 41 <> 0 then c_mktsegment else ' ' end"), "c_nationkey": F.expr("case when c_custkey % 43 <> 0 then c_nationkey + case when c_custkey % 47 = 0 then 100 + c_custkey else 0 end end")}
    rows = given.select("c_custkey", *(e.alias(c) for c, e in damaged.items()), "c_acctbal")
    references = tables.table(spark, sf, "nation").select(F.lit("nation").alias("name"), F.col("n_nationkey").alias("value"))
    frozen = rules.laid_out(given.where("c_custkey % 53 <> 0").select("c_custkey", "c_nationkey"), "c_custkey")
    return rows, rules.violations(rows, "c_custkey", spark.createDataFrame(RULES, rules.RULES), references, frozen)


@query("manifest_violations", BROKEN + " SELECT * FROM v")
def manifest_violations(spark, sf):
    return manifests(spark, sf)[1]


@query("manifest_verdicts", BROKEN + ", c AS (SELECT manifest, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'blocker') AS blockers, count(*) FILTER (level = 'warning') AS warnings FROM v GROUP BY ALL) SELECT manifest, CASE WHEN errors > 0 THEN 'invalid' WHEN blockers > 0 THEN 'blocked' ELSE 'ready' END AS verdict, errors, blockers, warnings FROM c")
def manifest_verdicts(spark, sf):
    rows, found = manifests(spark, sf)
    return rules.verdicts(rows, "c_custkey", found)
