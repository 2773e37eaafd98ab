"""Requests out of annotated notes: joined, verified, windowed, tagged and fingerprinted in one plan, rejected rows kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions import scalars


def judged(labels: DataFrame, notes: DataFrame, kinds: Sequence[str], most: int) -> DataFrame:
    """labels(label_id, note_id, mention, start, end, kind, ...) with the text and cluster of notes(note_id, text, subject) and
    the first reason that speaks against each, null for none. Spans are in characters, their end exclusive."""
    met = labels.join(notes, "note_id", "left")
    size, text = F.length("text"), F.col("text")
    start, end = F.col("start"), F.col("end")
    outside = start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > size)
    reason = F.when(text.isNull(), "missing note").when(outside, "span outside the note").when(~scalars.span_holds(text, start, end, F.col("mention")), "span differs from its mention")
    return met.withColumn("reason", reason.when(end - start > most, "span over the window").when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind"))


def prepare(labels: DataFrame, notes: DataFrame, kinds: Sequence[str], most: int, tags: Sequence[str], space: str) -> tuple[DataFrame, DataFrame]:
    """(requests, rejected). Requests have request_id, subject_cluster and context: the window of the note around the tagged
    span; rejected have their label's columns and the reason."""
    rows = judged(labels, notes, kinds, most)
    fine = rows.where("reason is null").drop("reason")
    fine = fine.withColumn("w", scalars.window_bounds(F.length("text"), F.col("start"), F.col("end"), most))
    context = scalars.tagged_slice(F.col("text"), F.col("start"), F.col("end"), F.col("w.lower"), F.col("w.upper"), tags)
    ids = {"request_id": scalars.stable_id("n_", F.col("label_id"), F.col("kind")), "subject_cluster": scalars.namespaced_id("subject", F.col("subject"), space), "context": context}
    return fine.withColumns(ids).drop("w", "text", "subject"), rows.where("reason is not null").select(*labels.columns, "reason")


def fingerprint(line: Column) -> tuple[Column, Column]:
    """(number, digest) of rows in any order, as aggregates: digests of the lines are added up, so no group is gathered."""
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.count("*"), F.sum(part).cast("string")
