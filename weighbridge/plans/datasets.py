"""Queries that build datasets: spans and windows, requests from feature lists, identifiers, digests, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions import contracts, scalars
from weighbridge.operators import candidates
from weighbridge.plans.registry import query
from weighbridge.sources import files, shared, tables
from weighbridge.streaming import ingest

MOST = 200
SPAN = "SELECT doc_id, text, n_chars, (doc_id * 37) % greatest(1, n_chars - 4) AS s, (doc_id * 37) % greatest(1, n_chars - 4) + 4 AS e FROM documents WHERE n_chars >= 8"
BOUNDS = f"""WITH d AS ({SPAN}), a AS (SELECT *, {MOST} - 4 AS spare, greatest(0, s - ({MOST} - 4) // 2) AS l0 FROM d), b AS (SELECT *, least(n_chars, e + spare - (s - l0)) AS u0 FROM a),
 w AS (SELECT *, CASE WHEN n_chars <= {MOST} THEN 0 WHEN u0 - l0 < {MOST} THEN greatest(0, u0 - {MOST}) ELSE l0 END AS lower, CASE WHEN n_chars <= {MOST} THEN n_chars ELSE u0 END AS upper FROM b)"""
TAGGED = "substr(text, lower + 1, s - lower) || '<T>' || substr(text, s + 1, e - s) || '</T>' || substr(text, e + 1, upper - e)"


def spanned(spark, sf) -> DataFrame:
    docs = tables.table(spark, sf, "documents").where("n_chars >= 8").select("doc_id", "text", "n_chars")
    start = (F.col("doc_id") * 37) % F.greatest(F.lit(1), F.col("n_chars") - 4)
    docs = docs.withColumns({"s": start, "e": start + 4})
    return docs.withColumn("w", scalars.window_bounds(F.col("n_chars"), F.col("s"), F.col("e"), MOST)).select("*", "w.lower", "w.upper")


@query("span_offset_audit", "WITH d AS (SELECT doc_id, text, regexp_extract(text, '[^ ]+') AS mention FROM documents), x AS (SELECT *, doc_id % 5 AS shift, strpos(text, mention) - 1 + doc_id % 5 AS s FROM d) SELECT count(*) AS n, count(*) FILTER (s + length(mention) <= length(text) AND length(mention) > 0 AND substr(text, s + 1, length(mention)) = mention) AS valid FROM x")
def span_offset_audit(spark, sf):
    docs = tables.table(spark, sf, "documents").select("text", F.regexp_extract("text", "[^ ]+", 0).alias("mention"), (F.col("doc_id") % 5).alias("shift"))
    start = F.instr("text", F.col("mention")) - 1 + F.col("shift")
    return docs.agg(F.count("*").alias("n"), F.count_if(scalars.span_holds(F.col("text"), start, start + F.length("mention"), F.col("mention"))).alias("valid"))


@query("span_window", f"{BOUNDS} SELECT doc_id, lower::BIGINT AS lower, upper::BIGINT AS upper FROM w")
def span_window(spark, sf):
    return spanned(spark, sf).select("doc_id", "lower", "upper")


@query("tagged_context", f"{BOUNDS} SELECT doc_id, sha256({TAGGED}) AS context_sha256 FROM w")
def tagged_context(spark, sf):
    text = scalars.tagged_slice(F.col("text"), F.col("s"), F.col("e"), F.col("lower"), F.col("upper"), ("<T>", "</T>"))
    return spanned(spark, sf).select("doc_id", F.sha2(text, 256).alias("context_sha256"))


@query("shared_context_choice", f"{BOUNDS}, m AS (SELECT doc_id, bool_and(n_chars // (3 + m) + 96 <= 700) AS fits FROM w, range(0, 4) t(m) GROUP BY ALL) SELECT CASE WHEN fits THEN 'full' ELSE 'window' END AS context_mode, count(*) AS n, sum(CASE WHEN fits THEN n_chars ELSE upper - lower END)::BIGINT AS characters FROM w JOIN m USING (doc_id) GROUP BY ALL")
def shared_context_choice(spark, sf):
    rows = spanned(spark, sf)
    models = F.sequence(F.lit(3), F.lit(6))
    fits = F.forall(models, lambda m: F.floor(F.col("n_chars") / m) + 96 <= 700)
    rows = rows.withColumn("fits", fits)
    return rows.groupBy(F.when(F.col("fits"), "full").otherwise("window").alias("context_mode")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("fits"), F.col("n_chars")).otherwise(F.col("upper") - F.col("lower"))).alias("characters"))


FEATURES = "WITH c AS (SELECT doc_id, quality, list_distinct(regexp_extract_all(text, '[A-Za-z]+')) AS f FROM labels JOIN documents USING (doc_id)), e AS (SELECT doc_id, quality, unnest(f) AS feature FROM c), k AS (SELECT feature FROM e GROUP BY ALL HAVING count(*) >= 3)"


def featured(spark, sf) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("f"))
    return tables.table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "quality", F.explode("f").alias("feature"))


@query("criteria_explode_requests", f"{FEATURES} SELECT doc_id AS case_id, feature AS criterion_id, CASE WHEN quality = 1 THEN 'PRESENT_CURRENT' ELSE 'ABSENT_EXPLICIT' END AS expected_state, 'r_' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, feature)), 1, 24) AS request_id FROM e JOIN k USING (feature)")
def criteria_explode_requests(spark, sf):
    rows = featured(spark, sf)
    criteria = rows.groupBy("feature").agg(F.count("*").alias("n")).where("n >= 3").select("feature")
    known = rows.join(criteria, "feature")
    return known.select(F.col("doc_id").alias("case_id"), F.col("feature").alias("criterion_id"), F.when(F.col("quality") == 1, "PRESENT_CURRENT").otherwise("ABSENT_EXPLICIT").alias("expected_state"), scalars.stable_id("r_", F.col("doc_id"), F.col("feature")).alias("request_id"))


@query("case_blueprints", f"{FEATURES} SELECT doc_id AS case_id, count(*) AS n, string_agg(feature || '=' || quality, ',' ORDER BY feature) AS states FROM e JOIN k USING (feature) GROUP BY ALL")
def case_blueprints(spark, sf):
    known = criteria_explode_requests(spark, sf)
    mapped = known.groupBy("case_id").agg(F.count("*").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion_id", (F.col("expected_state") == "PRESENT_CURRENT").cast("int").cast("string"))))).alias("m"))
    return mapped.select("case_id", "n", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("states"))


@query("unlisted_features", f"{FEATURES} SELECT doc_id AS case_id, count(*) AS unlisted FROM e WHERE feature NOT IN (SELECT feature FROM k) GROUP BY ALL")
def unlisted_features(spark, sf):
    rows = featured(spark, sf)
    criteria = rows.groupBy("feature").agg(F.count("*").alias("n")).where("n >= 3").select("feature")
    return rows.join(criteria, "feature", "left_anti").groupBy(F.col("doc_id").alias("case_id")).agg(F.count("*").alias("unlisted"))


@query("feature_cells", "SELECT doc_id, concat_ws('|', source, lang) AS leaves FROM documents")
def feature_cells(spark, sf):
    """Nested literal lists read back: ['src', ['lang', 'src'], ()] has two leaves."""
    docs = tables.table(spark, sf, "documents")
    cell = F.concat(F.lit("['"), "source", F.lit("', ['"), "lang", F.lit("', ' "), "source", F.lit(" '], ()]"))
    return docs.select("doc_id", F.array_join(contracts.leaves_of(cell), "|").alias("leaves"))


@query("stable_ids", "SELECT doc_id, 'd_' || substr(sha256(concat_ws(chr(31), source, doc_id::VARCHAR)), 1, 24) AS id, sha256(concat_ws(chr(0), 'note', 'set1', doc_id::VARCHAR)) AS namespaced FROM documents")
def stable_ids(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", scalars.stable_id("d_", F.col("source"), F.col("doc_id")).alias("id"), scalars.namespaced_id("note", F.col("doc_id"), "set1").alias("namespaced"))


@query("ordered_digest", "WITH p AS (SELECT source, doc_id // 4096 AS part, sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id) || chr(10)) AS d FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(d, chr(10) ORDER BY part) || chr(10)) AS digest FROM p GROUP BY ALL")
def ordered_digest(spark, sf):
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    parts = tables.table(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 4096).alias("part")).agg(scalars.ordered_digest(F.col("doc_id"), line).alias("d"))
    return parts.groupBy("source").agg(scalars.ordered_digest(F.col("part"), F.col("d")).alias("digest"))


@query("keyed_pseudonyms")
def keyed_pseudonyms(spark, sf):
    return tables.table(spark, sf, "customer").select("c_custkey", scalars.keyed_hash(b"0123456789abcdef", "customer", F.col("c_custkey")).alias("pseudonym"))


@query("at_least_k", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS present, count(*) FILTER (l_returnflag = 'N') >= 2 AS met FROM lineitem GROUP BY ALL")
def at_least_k(spark, sf):
    rows = tables.table(spark, sf, "lineitem").groupBy("l_orderkey")
    present = F.count_if(F.col("l_returnflag") == "N")
    return rows.agg(F.count("*").alias("n"), present.alias("present"), (present >= 2).alias("met"))


@query("node_field_differences", "WITH o AS (SELECT n_nationkey AS id, n_name, n_regionkey FROM nation WHERE n_nationkey < 22), w AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey > 2) SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN w USING (id) WHERE o.id IS NULL OR w.id IS NULL OR o.n_name IS DISTINCT FROM w.n_name OR o.n_regionkey IS DISTINCT FROM w.n_regionkey")
def node_field_differences(spark, sf):
    nation = tables.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "id")
    old = nation.where("id < 22").select("id", F.struct("n_name", "n_regionkey").alias("a"))
    new = nation.where("id > 2").select("id", F.struct(F.when(F.col("id") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"), "n_regionkey").alias("b"))
    both = old.join(new, "id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


@query("numeric_rules", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_retailprice < 1200 WHEN 1 THEN p_retailprice <= 1200 WHEN 2 THEN p_retailprice > 1200 WHEN 3 THEN p_retailprice >= 1200 WHEN 4 THEN p_retailprice = 1200 ELSE p_retailprice <> 1200 END AS holds FROM part")
def numeric_rules(spark, sf):
    operator = F.element_at(F.array(*map(F.lit, ("<", "<=", ">", ">=", "==", "!="))), (F.col("p_size") % 6 + 1).cast("int"))
    return tables.table(spark, sf, "part").select("p_partkey", scalars.compared(operator, F.col("p_retailprice"), F.lit(1200.0)).alias("holds"))


@query("zoned_timestamps", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events")
def zoned_timestamps(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    return tables.table(spark, sf, "events").select("event_id", scalars.zoned_timestamp(F.concat(text, zone)).cast("timestamp_ntz").alias("at"))


@query("event_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_hours(spark, sf):
    return tables.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("folder_inventory")
def folder_inventory(spark, sf):
    return files.inventory(spark, sf, "*.parquet")


@query("checkpoint_resume", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY ALL")
def checkpoint_resume(spark, sf):
    """The events table ingested as a stream in two runs over one checkpoint; the second finds nothing new."""
    base = shared.folder(spark, "ingest")
    events = tables.table(spark, sf, "events")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
        ingest.ingest(stream, f"{base}/rows", f"{base}/checkpoint")
    return ingest.landed(spark, f"{base}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


KINDS = ("symptom", "finding")
CANDIDATES = f"""WITH lb AS (SELECT l.doc_id AS label_id, CASE WHEN l.doc_id % 11 = 0 THEN l.doc_id + 1000000000 ELSE l.doc_id END AS note_id, mention, strpos(text, mention) - 1 + CASE WHEN l.doc_id % 7 = 0 THEN 1 WHEN l.doc_id % 17 = 0 THEN 10000000 ELSE 0 END AS s, quality, CASE WHEN l.doc_id % 13 = 0 THEN 'other' WHEN toxic = 1 THEN 'finding' ELSE 'symptom' END AS kind
  FROM labels l JOIN (SELECT doc_id, text, regexp_extract(text, '[^ ]+') AS mention FROM documents) USING (doc_id)),
 j AS (SELECT lb.*, s + length(mention) AS e, d.text, d.source, length(d.text) AS n FROM lb LEFT JOIN documents d ON d.doc_id = lb.note_id),
 r AS (SELECT *, CASE WHEN text IS NULL THEN 'missing note' WHEN s IS NULL OR s < 0 OR e <= s OR e > n THEN 'span outside the note' WHEN substr(text, s + 1, e - s) <> mention THEN 'span differs from its mention' WHEN e - s > {MOST} THEN 'span over the window' WHEN kind = 'other' THEN 'unknown kind' END AS reason FROM j),
 a AS (SELECT *, {MOST} - (e - s) AS spare, greatest(0, s - ({MOST} - (e - s)) // 2) AS l0 FROM r WHERE reason IS NULL), b AS (SELECT *, least(n, e + spare - (s - l0)) AS u0 FROM a),
 w AS (SELECT *, CASE WHEN n <= {MOST} THEN 0 WHEN u0 - l0 < {MOST} THEN greatest(0, u0 - {MOST}) ELSE l0 END AS lower, CASE WHEN n <= {MOST} THEN n ELSE u0 END AS upper FROM b),
 q AS (SELECT label_id, 'n_' || substr(sha256(concat_ws(chr(31), label_id::VARCHAR, kind)), 1, 24) AS request_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS detection, sha256(concat_ws(chr(0), 'subject', 'set1', source)) AS subject_cluster, sha256({TAGGED}) AS context_sha256 FROM w)"""


def annotated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Labels with spans, some of them bad, and the notes that they are about."""
    docs = tables.table(spark, sf, "documents")
    first = docs.select("doc_id", "text", F.regexp_extract("text", "[^ ]+", 0).alias("mention"))
    shift = F.expr("case when doc_id % 7 = 0 then 1 when doc_id % 17 = 0 then 10000000 else 0 end")
    rows = tables.table(spark, sf, "labels").join(first, "doc_id").withColumn("start", F.instr("text", F.col("mention")) - 1 + shift)
    labels = rows.select(F.col("doc_id").alias("label_id"), F.expr("case when doc_id % 11 = 0 then doc_id + 1000000000 else doc_id end").alias("note_id"), "mention", "start", (F.col("start") + F.length("mention")).alias("end"), F.expr("case when doc_id % 13 = 0 then 'other' when toxic = 1 then 'finding' else 'symptom' end").alias("kind"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("detection"))
    return labels, docs.select(F.col("doc_id").alias("note_id"), "text", F.col("source").alias("subject"))


@query("prepared_candidates", f"{CANDIDATES} SELECT label_id, NULL AS reason, request_id, detection, subject_cluster, context_sha256 FROM q UNION ALL SELECT label_id, reason, NULL, NULL, NULL, NULL FROM r WHERE reason IS NOT NULL")
def prepared_candidates(spark, sf):
    """Requests, and the rejected labels with their reasons, from one plan."""
    fine, bad = candidates.prepare(*annotated(spark, sf), KINDS, MOST, ("<T>", "</T>"), "set1")
    none = lambda name: F.lit(None).cast("string").alias(name)
    shown = fine.select("label_id", none("reason"), "request_id", "detection", "subject_cluster", F.sha2("context", 256).alias("context_sha256"))
    return shown.unionByName(bad.select("label_id", "reason", none("request_id"), none("detection"), none("subject_cluster"), none("context_sha256")))


@query("prepared_fingerprints", f"{CANDIDATES} SELECT subject_cluster, count(*) AS n, sum(('0x' || substr(sha256(request_id || ':' || context_sha256), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS fingerprint FROM q GROUP BY ALL")
def prepared_fingerprints(spark, sf):
    fine, _ = candidates.prepare(*annotated(spark, sf), KINDS, MOST, ("<T>", "</T>"), "set1")
    n, digest = candidates.fingerprint(F.concat_ws(":", "request_id", F.sha2("context", 256)))
    return fine.groupBy("subject_cluster").agg(n.alias("n"), digest.alias("fingerprint"))
