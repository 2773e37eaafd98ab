"""Agreement, classification and weighting metrics over scored responses.

Every operator counts once per group before it divides, so a failure or an abstention stays in the denominator, and only
counts are shuffled. Rates over nothing are null; precision, recall and F1 over nothing are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENT, ABSENT = "PRESENT_CURRENT", "ABSENT_EXPLICIT"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def by_state(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by reference state, micro and macro; macro is null where a state is missing."""
    is_p, is_a, ok = F.col("expected_state") == PRESENT, F.col("expected_state") == ABSENT, F.col("state_correct")
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(is_p).alias("n_present"), F.count_if(is_a).alias("n_absent"), F.count_if(is_p & ok).alias("n_present_ok"), F.count_if(is_a & ok).alias("n_absent_ok"))
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    macro = (F.try_divide(F.col("n_present_ok"), F.col("n_present")) + F.try_divide(F.col("n_absent_ok"), F.col("n_absent"))) / 2
    return counts.withColumns({"micro": F.try_divide(F.col("n_present_ok") + F.col("n_absent_ok"), F.col("n")), "macro": macro})


def macro_micro(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = by_state(scored, keys)
    return out.select(*keys, "n", (F.col("n_present_ok") + F.col("n_absent_ok")).alias("n_correct"), F.col("macro").alias("state_macro"), F.col("micro").alias("strict_micro"))


def equal_domain(scored: DataFrame, keys: Sequence[str], domain: str) -> DataFrame:
    """Pooled metrics beside the mean of within-domain metrics, null if any domain's is; one pass over the rows."""
    d = by_state(scored, [*keys, domain])
    total = [F.sum(c).alias(c) for c in ("n", "n_present", "n_absent", "n_present_ok", "n_absent_ok")]
    mean = F.when(F.count("macro") == F.count("*"), F.round(F.avg("macro"), 9)).alias("equal_macro")
    out = with_rates(d.groupBy(*keys).agg(*total, mean, F.round(F.avg("micro"), 9).alias("equal_micro")))
    return out.select(*keys, "n", F.col("macro").alias("pooled_macro"), F.col("micro").alias("pooled_micro"), "equal_macro", "equal_micro")


def confusion(rows: DataFrame, gold: str, observed: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, gold, observed).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    by = rows.groupBy(*keys, part).agg(F.count("*").alias("n"))
    return by.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def rates_by_reference(rows: DataFrame, keys: Sequence[str], part: str, reference: str) -> DataFrame:
    """For each part: its count, its rate over all rows and its mean rate over reference strata, absent ones as 0."""
    cells = rows.groupBy(*keys, reference, part).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    cells = cells.withColumns({"d": F.sum("n").over(Window.partitionBy(*keys, reference)), "total": F.sum("n").over(group), "strata": F.size(F.collect_set(F.struct(reference)).over(group))})
    macro = F.round(F.sum(F.col("n") / F.col("d")) / F.max("strata"), 9)
    return cells.groupBy(*keys, part).agg(F.sum("n").alias("n"), (F.sum("n") / F.max("total")).alias("micro"), macro.alias("macro"))


def domain_weights(requests: DataFrame) -> DataFrame:
    by = requests.groupBy("domain", "expected_state").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    domains = F.size(F.collect_set("domain").over(whole))
    return by.select("domain", "expected_state", "n", (F.lit(1) / domains).alias("equal_weight"), (F.sum("n").over(Window.partitionBy("domain")) / F.sum("n").over(whole)).alias("pooled_weight"), (F.col("n") / F.sum("n").over(Window.partitionBy("expected_state"))).alias("within_state_weight"))


def decoder_shift(cells: DataFrame, value: str) -> DataFrame:
    """For each pair of models and each contract, the difference of the value without (u) and with (w) the constraint."""
    a = cells.select(F.col("model").alias("model_a"), "condition", F.col(value).alias("a"))
    b = cells.select(F.col("model").alias("model_b"), "condition", F.col(value).alias("b"))
    diff = a.join(b, "condition").where("model_a < model_b").withColumn("diff", F.col("b") - F.col("a"))
    parts = diff.withColumns({"contract": F.split_part("condition", F.lit("_"), F.lit(1)), "decoder": F.split_part("condition", F.lit("_"), F.lit(2))})
    return parts.groupBy("model_a", "model_b", "contract").agg(F.max(F.when(F.col("decoder") == "unconstrained", F.col("diff"))).alias("u"), F.max(F.when(F.col("decoder") == "constrained", F.col("diff"))).alias("w"))


def linear(cells: DataFrame, terms: DataFrame, on: str, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The weighted sum of cells, weights from a table of terms."""
    return cells.join(F.broadcast(terms), on).groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col("weight")), 9).alias(name))


def diagnostics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    illogical, fits = F.count_if(F.col("v.schema_valid") & ~F.col("v.logical_valid")), F.count_if(F.col("v.schema_valid"))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("finish_reason") == "length").alias("truncated"), F.count_if(F.col("finish_reason").isNull()).alias("missing_finish"), illogical.alias("illogical"), F.try_divide(illogical, fits).alias("illogical_rate"),
        F.sum("output_tokens").cast("long").alias("output_total"), (F.sum("output_tokens") / F.count("output_tokens")).alias("output_mean"), (F.count("*") - F.count("output_tokens")).alias("output_missing"), F.sum("prompt_tokens").cast("long").alias("prompt_total"),
    )


def audit(rows: DataFrame, key: str, tokens: str, reserve: int, limit: int) -> DataFrame:
    """Spread of token counts, the nearest-rank 95th percentile, and how many do not fit with the reserve."""
    return rows.groupBy(key).agg(F.min(tokens).alias("least"), F.avg(tokens).alias("mean"), F.expr(f"percentile_disc(0.95) within group (order by {tokens})").alias("p95"), F.max(tokens).alias("most"), F.count_if(F.col(tokens) + reserve > limit).alias("over_context"))


def classes(rows: DataFrame, keys: Sequence[str], gold: str, predicted: str, labels: DataFrame | None = None, over: str = "gold") -> DataFrame:
    """Per class: support, predicted, tp, fp, fn, precision, recall, f1. Labels are a table (label), or those of the
    reference (over='gold') or of both (over='union'). A prediction outside the labels, or null, is a false negative only."""
    cells = rows.groupBy(*keys, F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    support = cells.groupBy(*keys, F.col("g").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.where("p is not null").groupBy(*keys, F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    if labels is not None:
        base = (cells.select(*keys).distinct().crossJoin(F.broadcast(labels)) if keys else labels).join(support, [*keys, "label"], "left").join(said, [*keys, "label"], "left")
    else:
        base = support.join(said, [*keys, "label"], "left" if over == "gold" else "full")
    base = base.na.fill(0, ["support", "tp", "predicted"])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    out = base.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"), "precision": precision, "recall": recall})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averaged(per_class: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro means, balanced accuracy and support-weighted means and deviations."""
    weighted = {f"weighted_{c}": F.sum(F.col(c) * F.col("support")) / F.sum("support") for c in ("precision", "recall", "f1")}
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("f1") * F.col("f1") * F.col("support")) / F.sum("support") - F.pow(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), F.lit(2))))
    means = {f"macro_{c}": F.avg(c) for c in ("precision", "recall", "f1")}
    return per_class.groupBy(*keys).agg(F.count("*").alias("labels"), *(F.round(v, 9).alias(k) for k, v in (means | weighted).items()), F.round(spread, 6).alias("weighted_f1_std"))
