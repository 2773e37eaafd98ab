"""Mixing sources to target weights: repetition rates from token counts, then whole copies and one seeded draw.

Sizes are summed by source before anything is shuffled, so a source with a third of all rows is one row a task. The
sources share `share` times all sizes by weight; a target stops at `cap` times its source's size and the excess goes to
the others by weight until none is above. In sorted order of cap over weight that has a closed form: the first k
sources are full, the others get one common level times their weight. That order is one task's, over a row of two numbers a source: good for
some millions of sources, whatever the documents. A document is taken floor(rate) times, and once
more if a draw seeded by its id and text falls under the fraction; so reruns agree, and equal rows share a draw.

A null text has size 0 and is taken like any other. A null source is a source of its own, last in order. Sources of
size 0 have rate 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes(source, size) to (source, source_size, target): one row per source."""
    by = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    ranked = by.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(fill), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    filled = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    first = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    return filled.withColumn("at", first).select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")
    seeded = F.md5(F.concat_ws(":", F.lit(SEED), F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    return docs.withColumns({"_size": words, "_draw": F.conv(F.substring(seeded, 1, 13), 16, 10).cast("double") / F.lit(float(2**52)), "_source": F.col(source)})


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """docs with _size, _source_size, _target and _copies, how often the mix takes the row."""
    rows = sized(docs, text, source, key)
    by = targets(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size")), **how)
    by = common.written(by, "targets")
    longest = by.agg(F.coalesce(F.max(F.octet_length("source")), F.lit(0))).first()[0]
    by = common.small(by, longest + 64)
    by = by.select(F.col("source").alias("_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    joined = rows.join(by, F.col("_source").eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("_copies", (whole + (F.col("_draw") < rate - whole).cast("long")).cast("long")).drop("_of", "_draw", "_source")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns are those of docs, whatever they are called."""
    plain, (text, source, key) = common.apart(docs, text, source, key)
    taken = copies(plain, text, source, key, **how).where(F.col("_copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*plain.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = copies(docs)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * {CAP} AS most,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce((sum(most) OVER p)::BIGINT, 0))
                / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER p)::BIGINT, 0)) AS level
      FROM w WINDOW p AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             least(most::DOUBLE, coalesce(max(level) FILTER (WHERE level * weight <= most) OVER () * weight, most::DOUBLE)) AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.draw,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
