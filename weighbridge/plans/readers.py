"""Queries that write a table as files and read it back by lines and records, with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.plans.registry import query
from weighbridge.sources import shared, splits, tables
from weighbridge.streaming import ingest


def ordered_lines(spark, rows: DataFrame, key: str, line: Column) -> str:
    """A folder of text files whose lines, file by file, are the rows in the order of their key."""
    path = shared.folder(spark, "lines")
    rows.orderBy(key).select(line.alias("value")).write.text(path)
    return path


@query("source_ordinals", "SELECT o_orderkey, row_number() OVER w - 1 AS ordinal, (row_number() OVER w - 1) // 128 AS batch FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def source_ordinals(spark, sf):
    """Orders as JSON lines, read back with their ordinals and in batches of exactly 128."""
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    path = ordered_lines(spark, orders, "o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    return splits.batched(splits.read_json_lines(spark, path, "o_orderkey long, o_orderstatus string")).select("o_orderkey", "ordinal", "batch")


BAD = {7: '{"o_orderkey": 1', 11: "[1]", 13: "", 17: "nothing"}


@query("json_line_problems", f"""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey FROM orders)
 SELECT ordinal, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 THEN 'expected a JSON object' ELSE 'invalid JSON' END AS problem FROM o WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR (o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0)""")
def json_line_problems(spark, sf):
    """Orders as JSON lines, some of them cut off, no objects or blank: where each problem is."""
    line = F.to_json(F.struct("o_orderkey"))
    for divisor, bad in reversed(BAD.items()):
        line = F.when(F.col("o_orderkey") % divisor == 0, bad).otherwise(line)
    path = ordered_lines(spark, tables.table(spark, sf, "orders"), "o_orderkey", line)
    return splits.judged_lines(splits.numbered(spark, path)).where("problem is not null").select("ordinal", "problem")


@query("quoted_csv", "SELECT doc_id::VARCHAR AS doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(source, '') AS source FROM documents")
def quoted_csv(spark, sf):
    """Documents as CSV, whose texts have commas, quotes and line breaks, read back by splits."""
    path = shared.folder(spark, "csv")
    docs = tables.table(spark, sf, "documents").select("doc_id", "text", "source")
    docs.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    return splits.read_csv(spark, path).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "source")


@query("stale_batches", """WITH o AS (SELECT o_orderkey // 512 AS batch, round(o_totalprice * 100)::BIGINT AS cents FROM orders), b AS (SELECT batch, count(*) AS n, sum(cents)::BIGINT AS cents FROM o GROUP BY ALL)
 SELECT batch, 'p1' AS run, 'landed' AS outcome, n, cents FROM b WHERE batch % 2 = 0 UNION ALL SELECT batch, 'p2', CASE WHEN batch % 2 = 1 THEN 'landed' WHEN batch % 5 = 0 THEN 'stale' ELSE 'skipped' END, n, CASE WHEN batch % 2 = 1 THEN cents + CASE WHEN batch % 5 = 0 THEN n ELSE 0 END ELSE cents END FROM b""")
def stale_batches(spark, sf):
    """Orders land in batches. A first run has every other batch; a second has all, a fifth of them with changed amounts: what is
    finished is skipped, what came in other rows is stale, and what has landed stays as it was."""
    base = shared.folder(spark, "batches")
    orders = tables.table(spark, sf, "orders").select(F.expr("o_orderkey div 512").alias("batch"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    tampered = orders.withColumn("cents", F.col("cents") + F.when(F.col("batch") % 5 == 0, 1).otherwise(0))
    for name, rows in (("p1", orders.where("batch % 2 = 0")), ("p2", tampered)):
        rows.write.parquet(f"{base}/{name}")
        stream = spark.readStream.schema(orders.schema).parquet(f"{base}/{name}")
        ingest.resume(stream, f"{base}/sink", f"{base}/checkpoint-{name}", "orders", name)
    there = spark.read.option("recursiveFileLookup", "true").schema(orders.schema).parquet(f"{base}/sink/rows").groupBy("batch").agg(F.sum("cents").alias("cents"))
    return ingest.log(spark, f"{base}/sink").select("batch", "run", "outcome", "n").join(there, "batch")
