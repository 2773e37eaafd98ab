"""Paired statistics, intervals over replicates, and the weights of a cluster bootstrap as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.operators import resample


def discordance(cells: DataFrame, keys: Sequence[str], arm: str, outcome: str, on: str) -> DataFrame:
    """For each pair of arms: how often only the first, only the second, or both are right on the same unit. The arms of a unit
    meet in a list, as long as there are arms: a join of the units with themselves may be broadcast by the size of their files."""
    there = " and ".join(f"`{c}` is not null" for c in [*keys, on, arm])
    met = cells.where(there).groupBy(*keys, on).agg(F.collect_list(F.struct(F.col(arm).alias("arm"), F.col(outcome).alias("ok"))).alias("_m"))
    after = lambda a: F.transform(F.filter("_m", lambda b: b["arm"] > a["arm"]), lambda b: F.struct(a["arm"].alias("arm_a"), b["arm"].alias("arm_b"), a["ok"].alias("a"), b["ok"].alias("b")))
    pairs = met.select(*keys, F.inline(F.flatten(F.transform("_m", after))))
    return pairs.groupBy(*keys, "arm_a", "arm_b").agg(F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count("*").alias("n"))


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided p, null without discordance: twice the lower binomial tail at one half, at most 1, in logarithms."""
    n, k = a_only + b_only, F.least(a_only, b_only)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    start = -n * F.lit(0.6931471805599453)
    zero = F.struct(start.alias("log"), F.exp(start).alias("tail"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (acc["tail"] + F.exp(log)).alias("tail"))

    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.aggregate(steps, zero, add, lambda acc: acc["tail"])))


def holm(rows: DataFrame, p: str, tie: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """Adds adjusted: step-down p values within a family; null p stays null and does not count."""
    order = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *tie)
    m = F.count(p).over(Window.partitionBy(*family))
    step = rows.withColumn("adjusted", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return step.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.max("adjusted").over(order.rowsBetween(Window.unboundedPreceding, 0))))


def weights(clusters: DataFrame, cluster: str, replicates: int, strata: Sequence[str] = ()) -> DataFrame:
    """clusters(strata, cluster), one row each, to (replicate, strata, cluster, w): how often each replicate draws a cluster.
    A slot draws by a hash of replicate and slot, so any engine draws alike; only weights over 0 are kept. A row for each
    weight: to list them; `resample.resampled` adds up without."""
    return resample.weights(clusters, cluster, replicates, strata)


def interval_by_index(values: Column, low: float = 0.025, style: str = "inner") -> Column:
    """(low, high) order statistics of a list: style `inner` takes floor(q(n-1)) and ceil((1-q)(n-1)); style `outer`
    takes floor(qn) and ceil((1-q)n)-1."""
    s, n = F.array_sort(values), F.size(values)
    if style == "inner":
        a, b = F.floor(F.lit(low) * (n - 1)), F.ceil(F.lit(1 - low) * (n - 1))
    else:
        a, b = F.floor(F.lit(low) * n), F.least(n - 1, F.ceil(F.lit(1 - low) * n) - 1)
    return F.struct(F.element_at(s, (a + 1).cast("int")).alias("low"), F.element_at(s, (b + 1).cast("int")).alias("high"))


def interval_linear(values: Column, low: float = 0.025) -> Column:
    """(low, high) quantiles of a list, interpolated as a + (b - a) * share, so that between equal neighbours they are exactly
    these; null for an empty list."""
    s, n = F.array_sort(values), F.size(values)

    def at(q: float) -> Column:
        place = F.lit(q) * (n - 1)
        a, b = F.element_at(s, (F.floor(place) + 1).cast("int")), F.element_at(s, (F.ceil(place) + 1).cast("int"))
        return F.when(n > 0, a + (b - a) * (place - F.floor(place)))

    return F.struct(at(low).alias("low"), at(1 - low).alias("high"))


def scaled_round(value: Column, digits: int = 8) -> Column:
    """Rounds a double by its scaled value, halves away from 0, as SQL engines do that do not go through its decimal digits:
    interpolated quantiles of rounded values lie on halves often enough for the two to differ."""
    return F.signum(value) * F.floor(F.abs(value) * 10.0**digits + 0.5) / 10.0**digits


def midranks(rows: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Adds midrank: rank by descending score, ties share the mean of their places."""
    order, same = Window.partitionBy(*keys).orderBy(F.desc(score)), Window.partitionBy(*keys, score)
    return rows.withColumn("midrank", F.rank().over(order) + (F.count("*").over(same) - 1) / 2)
