"""Replay of saved decisions under another reading of their answers.

A case's log meets its machine, a row a domain, and is gone through in the order of its rounds until the new reading ends
the walk. A log that does not fit is not repaired: what is wrong with it is its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.sources import shared

ACTIVE, COMPLETED, OUTPUT, RUNTIME, TREE = "ACTIVE", "COMPLETED", "OUTPUT_FAILURE", "RUNTIME_FAILURE", "TREE_FAILURE"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: within a function over an array, what is named twice is worked out twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def packed(states: DataFrame, questions: DataFrame) -> DataFrame:
    """Machines as in traversal.walk_tables, a row each: domain, root, machine (state to its questions in order and targets)."""
    asked = questions.groupBy("domain", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "question"))), lambda q: q["question"]).alias("questions"))
    rule = F.struct("questions", "minimum", "yes_kind", "yes_to", "no_kind", "no_to")
    entries = states.join(asked, ["domain", "state"]).groupBy("domain")
    return entries.agg(F.max(F.when(F.col("root"), F.col("state"))).alias("root"), F.map_from_entries(F.collect_list(F.struct("state", rule))).alias("machine"))


def replay(machines: DataFrame, cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each of cases(case, domain) by its decisions(case, domain, round, state, question, answer, frozen, runtime_failed).

    answer is what the new reading makes of a saved output, null where it does not accept it; frozen is the answer that the
    saved run went on with. Result: case, domain, status, action, consumed, unconsumed, failure_state, failure_question and
    problem. Rounds that repeat or leave a gap, a log that ends before the walk, one that goes on after it, and a decision about
    another domain, state or question than the walk is at, or whose new answer is not the frozen one, are problems; a log with
    one has neither status nor action."""
    log = decisions.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("round", "state", "question", "answer", "frozen", "runtime_failed", F.col("domain").alias("of")))).alias("log"))
    table = shared.small(shared.written(machines, "machines"), 4096)
    rows = cases.join(log, "case", "left").join(table, "domain", "left").withColumn("log", F.coalesce("log", F.array().cast(log.schema["log"].dataType)))
    none = F.lit(None).cast("string")
    zero = F.struct(F.when(F.col("root").isNull(), TREE).otherwise(ACTIVE).alias("status"), F.col("root").alias("state"), F.lit(0).alias("at"), F.lit(0).alias("yes"), F.lit(0).alias("consumed"), F.array().cast("array<string>").alias("visited"), none.alias("action"), none.alias("failure_question"), none.alias("problem"))

    def step(acc: Column, d: Column) -> Column:
        def asked(x: Column) -> Column:
            rule, yes = x["rule"], x["yes"]
            question = F.get(rule["questions"], acc["at"])
            wrong = F.when(~d["of"].eqNullSafe(F.col("domain")), "another domain").when(~d["state"].eqNullSafe(acc["state"]), "another state").when(~d["question"].eqNullSafe(question), "another question")
            wrong = wrong.when(~d["runtime_failed"] & d["answer"].isNotNull() & ~d["answer"].eqNullSafe(d["frozen"]), "another answer")
            enough, last = yes >= rule["minimum"], acc["at"] + 1 >= F.size(rule["questions"])
            kind, to = (F.when(enough, rule[f"yes_{x}"]).otherwise(rule[f"no_{x}"]) for x in ("kind", "to"))
            moves = enough | last
            visited = F.when(moves, F.concat(acc["visited"], F.array(acc["state"]))).otherwise(acc["visited"])
            return _once(F.struct(yes.alias("yes"), wrong.alias("wrong"), moves.alias("moves"), kind.alias("kind"), to.alias("to"), visited.alias("visited")), moved)

        def moved(x: Column) -> Column:
            lost = x["moves"] & (x["kind"] == "state") & (F.array_contains(x["visited"], x["to"]) | F.try_element_at("machine", x["to"]).isNull())
            status = F.when(x["wrong"].isNotNull(), acc["status"]).when(d["runtime_failed"], RUNTIME).when(d["answer"].isNull(), OUTPUT).when(lost, TREE).when(x["moves"] & (x["kind"] == "terminal"), COMPLETED).otherwise(ACTIVE)
            return _once(status, lambda status: ended(status, x))

        def ended(status: Column, x: Column) -> Column:
            goes = status == ACTIVE
            return F.struct(
                status.alias("status"), F.when(goes & x["moves"], x["to"]).otherwise(acc["state"]).alias("state"), F.when(goes & ~x["moves"], acc["at"] + 1).when(goes, 0).otherwise(acc["at"]).alias("at"), F.when(goes & x["moves"], 0).otherwise(x["yes"]).alias("yes"), (acc["consumed"] + 1).alias("consumed"), x["visited"].alias("visited"),
                F.when(status == COMPLETED, x["to"]).alias("action"), F.when(status.isin(OUTPUT, RUNTIME), d["question"]).alias("failure_question"), x["wrong"].alias("problem"),
            )

        rule, yes = F.try_element_at("machine", acc["state"]), acc["yes"] + F.when(d["answer"] == "yes", 1).otherwise(0)
        new = _once(F.struct(rule.alias("rule"), yes.alias("yes")), asked)
        return F.when((acc["status"] != ACTIVE) | acc["problem"].isNotNull(), acc).otherwise(new)

    rounds = F.transform("log", lambda d: d["round"])
    n = F.size("log")
    told = rows.withColumn("r", F.aggregate("log", zero, step)).withColumn("n", n)
    shape = F.when(F.size(F.array_distinct(rounds)) < n, "duplicate round").when((n > 0) & (F.array_max(rounds) - F.array_min(rounds) + 1 != n), "gap in rounds")
    ends = F.when(F.col("r.status") == ACTIVE, "log ended before the walk").when((F.col("r.status") == COMPLETED) & (F.col("r.consumed") < n), "log goes on after the walk")
    told = told.withColumn("problem", F.coalesce(shape, F.col("r.problem"), ends))
    fine = lambda c: F.when(F.col("problem").isNull(), F.col(f"r.{c}")).alias(c)
    stopped = F.when(F.col("problem").isNull() & F.col("r.status").isin(OUTPUT, RUNTIME, TREE), F.col("r.state")).alias("failure_state")
    return told.select("case", "domain", fine("status"), fine("action"), fine("consumed"), F.when(F.col("problem").isNull(), F.col("n") - F.col("r.consumed")).alias("unconsumed"), stopped, fine("failure_question"), "problem")
