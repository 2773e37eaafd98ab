"""Checkpointed ingestion: batches of a stream land once each, however often the run is resumed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.sources import shared


def ingest(stream: DataFrame, sink: str, checkpoint: str, partition: str = "batch") -> None:
    """Write what is new and stop. A batch goes to a folder of its own number, replaced as a whole, so a batch that was
    cut off half-way and comes again leaves no double rows; finished batches are in the checkpoint and not read again."""

    def land(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/{partition}={number}")

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What is known of a batch: where its rows come from, a digest of them in any order, and the part of a run that brought it.
REGISTRY = "batch long, provenance string, digest string, n long, part string"


def digests(rows: DataFrame, provenance: str) -> DataFrame:
    """(batch, provenance, digest, n) of each batch of rows. A row counts by all its columns, by name."""
    names = sorted(c for c in rows.columns if c != "batch")
    whole = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    by = rows.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.sum(whole).alias("sum"))
    return by.select("batch", F.lit(provenance).alias("provenance"), F.sha2(F.concat_ws("|", F.lit(provenance), "n", "sum"), 256).alias("digest"), "n")


def registry(spark: SparkSession, sink: str) -> DataFrame:
    """What has landed in a sink, a row a batch."""
    try:
        return spark.read.option("recursiveFileLookup", "true").schema(REGISTRY).parquet(f"{sink}/registry")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY)


def resume(stream: DataFrame, sink: str, checkpoint: str, provenance: str, run: str) -> None:
    """Land the batches of a stream that are not finished. Rows carry the number of their batch, and a batch comes whole in one
    of the stream's own batches. One that is in the registry under the same digest is skipped; under another it is stale: its
    rows are kept apart and what has landed stays. run names the checkpoint. Each of the stream's batches has folders of its
    own, replaced as a whole, rows first and the registry last, and does not look at what it registered itself: one that was
    cut off anywhere and comes again leaves the same behind."""

    def land(rows: DataFrame, number: int) -> None:
        spark, part = rows.sparkSession, f"{run}-{number}"
        rows = rows.withColumn("batch", F.col("batch").cast("long"))
        now = digests(rows, provenance)
        before = registry(spark, sink).where(F.col("part") != part).select("batch", F.col("digest").alias("finished"))
        told = now.join(before, "batch", "left").withColumn("outcome", F.when(F.col("finished").isNull(), "landed").when(F.col("finished") == F.col("digest"), "skipped").otherwise("stale"))
        told = shared.written(told.select("batch", "provenance", "digest", "n", F.lit(part).alias("part"), "outcome"), "batches")
        for outcome, place in (("landed", "rows"), ("stale", "stale")):
            own = told.where(F.col("outcome") == outcome)
            rows.join(own.select("batch"), "batch", "left_semi").write.mode("overwrite").parquet(f"{sink}/{place}/{part}")
        told.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{sink}/log/{part}")
        told.where("outcome = 'landed'").drop("outcome").write.mode("overwrite").parquet(f"{sink}/registry/{part}")

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log(spark: SparkSession, sink: str) -> DataFrame:
    """(batch, provenance, digest, n, part, outcome, run) of all that was offered."""
    return spark.read.option("recursiveFileLookup", "true").schema(REGISTRY + ", outcome string, run string").parquet(f"{sink}/log")


def unfinished(spark: SparkSession, sink: str, expected: DataFrame) -> DataFrame:
    """(batch, why) of the batches of expected(batch, digest) that cannot be used: missing, or of another content."""
    met = expected.select("batch", F.col("digest").alias("want")).join(registry(spark, sink).select("batch", "digest"), "batch", "left")
    why = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("want"), "stale")
    return met.select("batch", why.alias("why")).where("why is not null")


def landed(spark, sink: str) -> DataFrame:
    return spark.read.parquet(sink)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type of a stream, rows later than `late` left out; an aggregate with a watermark."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")
