"""Secret scan: base patterns, and multipart credentials linked by an interval join.

Base spans (assign, access, hex) are reported wherever they are. Weak parts (identifiers such as client_id=..., secrets
such as key=..., endpoints such as https://...) mean nothing alone. They are laid out by document and position and
joined to all other parts of the document with at most SCOPE code points between them, through buckets of that width, so
the join grows with the parts and their lengths and not with the square of a document's. A weak identifier is reported if a secret is near, a
weak secret if an identifier or endpoint is near, an endpoint if both an identifier and a secret are near.

Null texts count as empty and have no spans. Rows that repeat get the same result. Null ids are ids like any other.
Only built-in functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common, spans

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
WEAK_ID = r"""(?i)(?<![A-Za-z0-9_])(?:access[_-]?key[_-]?id|client[_-]?id|account(?:[_-]?id)?|user(?:name|[_-]?id)?|login)["']?\x20?[:=]\x20?["']?[A-Za-z0-9@._-]{3,}+"""
WEAK_SECRET = r"""(?i)(?<![A-Za-z0-9_])(?:(?:access|private|signing|auth|shared)[_-]?key|pwd|pass(?:phrase)?|credential|signature|auth)["']?\x20?[:=]\x20?["']?[A-Za-z0-9+/_.=~!@#$%^&*-]{6,}+"""
ENDPOINT = r"""(?i)(?<![A-Za-z0-9_])(?:(?:https?|ftp|s3|postgres(?:ql)?|mysql|redis|amqp)://[^\s"'<>]{3,}+|(?:endpoint|hostname|host|server|base[_-]?url)["']?\x20?[:=]\x20?["']?[A-Za-z0-9._:/-]{4,}+)"""
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
SCOPE = 300


def parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key, a mark of its text, base spans and weak spans; the text is left behind."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(F.col(key).alias("id"), F.xxhash64(text_of).alias("mark"), text_of.alias("t"))
    sets = F.contains(F.col("t"), F.lit("=")) | F.contains(F.col("t"), F.lit(":"))
    patterns = {"assign": (ASSIGN, sets), "access": (ACCESS, F.contains(F.col("t"), F.lit("AKIA"))), "hex": (HEX, F.lit(True)), "weak_id": (WEAK_ID, sets), "weak_secret": (WEAK_SECRET, sets), "endpoint": (ENDPOINT, sets)}
    cut = {k: spans.found(F.col("t"), p, guard) for k, (p, guard) in patterns.items()}
    raw = raw.select("id", "mark", *(x.alias(f"{k}_{n}") for k, pair in cut.items() for n, x in zip("gm", pair, strict=True)))
    placed = raw.select("id", "mark", *(spans.places(F.col(f"{k}_g"), F.col(f"{k}_m")).alias(k) for k in KINDS))
    long_enough = F.filter(F.col("assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    placed = placed.withColumn("assign", long_enough)
    tagged = {k: spans.tagged(F.col(k), k, n) for n, k in enumerate(KINDS)}
    return placed.select("id", "mark", F.array_sort(F.concat(*(tagged[k] for k in KINDS[:3]))).alias("base"), F.concat(*(tagged[k] for k in KINDS[3:])).alias("weak"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of each (id, mark) that have their complement within reach."""
    every = found.where(F.size("weak") > 0).dropDuplicates(["id", "mark"])
    laid = every.select("id", "mark", F.inline(F.concat("base", "weak")))
    roles = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))
    laid = laid.select("id", "mark", "start", "kind_no", "end", "kind", roles[F.col("kind")].alias("role"))
    laid = laid.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") + scope) / scope))))
    weak = laid.where(F.col("kind_no") >= 3)
    near = laid.select(F.col("id").alias("i"), F.col("mark").alias("m"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r"), F.col("bucket").alias("b"))
    later = F.greatest("start", "s")  # two parts within reach share its bucket, and meet there only
    met = weak.join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")) & (F.col("bucket") == F.col("b")) & (F.col("bucket") == F.floor(later / scope)) & (later - F.least("end", "e") <= scope) & (F.col("role") != F.col("r")))
    has = met.groupBy("id", "mark", "start", "kind_no", "end", "kind").agg(F.max(F.col("r") == "id").alias("with_id"), F.max(F.col("r") == "secret").alias("with_secret"), F.max(F.col("r") == "endpoint").alias("with_endpoint"))
    whole = F.when(F.col("kind") == "weak_id", F.col("with_secret")).when(F.col("kind") == "weak_secret", F.col("with_id") | F.col("with_endpoint")).otherwise(F.col("with_id") & F.col("with_secret"))
    return has.where(whole).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "kind_no", "end", "kind")).alias("linked"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its key, base and spans (base and linked), each array<struct<start, kind_no, end, kind>>."""
    found = common.written(parts(docs, key, text), "secrets")
    linked = link(found).select(F.col("id").alias("i"), F.col("mark").alias("m"), "linked")
    out = found.join(linked, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as {spans.TAGGED})"))))
    return out.select(F.col("id").alias(key), "base", every.alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [spans.how_many(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *n, F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"))


def _sql_pattern(pattern: str) -> str:
    """A pattern as an SQL literal for an engine without possessive runs and looks behind, with the same matches: a part
    starts with a letter, and a word's edge is one of ASCII letters there."""
    return "'" + re.sub(r"(?<=[\]}])(\+?)\+", r"\1", pattern).replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''") + "'"


_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT), strict=True))
_FOUND = " UNION ALL ".join(f"SELECT r, {n} AS no, '{k}' AS kind, '{ROLE[k]}' AS role, regexp_extract_all(t, {_sql_pattern(p)}) AS ms, string_split_regex(t, {_sql_pattern(p)}) AS gs FROM d" for n, (k, p) in enumerate(_PATTERNS.items()))
#: Every pair of parts of a document is looked at.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_FOUND}),
u AS (SELECT r, no, kind, role, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g FROM m WHERE len(ms) > 0),
p AS (SELECT *, sum(length(g) + length(v)) OVER (PARTITION BY r, no ORDER BY i)::BIGINT AS e FROM u),
s AS MATERIALIZED (SELECT r, no, kind, role, e - length(v) AS a, e FROM p WHERE no <> 0 OR length(regexp_extract(v, {_sql_pattern(ASSIGN)}, 2)) >= 6),
near AS (SELECT w.r, w.no, w.kind, w.a, w.e, bool_or(o.role = 'id') AS i, bool_or(o.role = 'secret') AS k, bool_or(o.role = 'endpoint') AS h
         FROM s w JOIN s o ON w.r = o.r AND w.role <> o.role AND greatest(w.a, o.a) - least(w.e, o.e) <= {SCOPE}
         WHERE w.no >= 3 GROUP BY ALL),
kept AS (SELECT r, no, kind, a, e FROM s WHERE no < 3 UNION ALL
         SELECT r, no, kind, a, e FROM near WHERE CASE kind WHEN 'weak_id' THEN k WHEN 'weak_secret' THEN i OR h ELSE i AND k END),
l AS (SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, no, e) FILTER (no < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, no, e) AS spans
      FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l USING (r)
"""
