"""Decision trees and threshold machines, walked for all cases at once.

A tree is small and known to the driver, so its depth bounds the number of rounds and its edges are literal maps. The answers
of a case are gathered once, into a map or a list; a round then is a projection, so a walk of any depth is one shuffle, and none
where the table of cases has its answers already (columns `told` and `said`). Nothing recurses over rows, and there is no limit
on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.sources import shared

EMPTY = "cast(array() as array<string>)"


class Tree:
    """nodes: id -> (type, criterion, action); edges: (node, branch) -> (target, actions); states: (node, state) -> branches."""

    def __init__(self, root: str, nodes: dict[str, tuple], edges: dict[tuple[str, str], tuple[str, list[str]]], states: dict[tuple[str, str], list[str]]) -> None:
        self.root, self.nodes, self.edges, self.states = root, nodes, edges, states

    def problems(self) -> list[tuple[str, str]]:
        """(node, what is wrong): dangling edges, nodes that cannot be reached, cycles, states without a branch."""
        out = [(n, "dangling_edge") for (n, _), (t, _) in self.edges.items() if t not in self.nodes]
        reached, todo, on_path = set(), [(self.root, ())], set()
        while todo:
            at, path = todo.pop()
            if at in path:
                on_path.add(at)
                continue
            reached.add(at)
            todo += [(t, (*path, at)) for (n, _), (t, _) in self.edges.items() if n == at and t in self.nodes]
        out += [(n, "unreachable") for n in self.nodes if n not in reached] + [(n, "cycle") for n in on_path]
        out += [(n, f"unknown_branch:{b}") for (n, _), bs in self.states.items() for b in bs if (n, b) not in self.edges]
        return sorted(set(out))

    def lookups(self) -> tuple[Column, Column, Column]:
        """Literal maps: node to (type, criterion, action); node and branch to (target, actions); node and state to branches."""
        text = lambda v: F.lit(v).cast("string")
        many = lambda v: F.array(*map(F.lit, v)) if v else F.expr(EMPTY)
        nodes = _map({n: F.struct(text(t).alias("type"), text(c).alias("criterion"), text(a).alias("action")) for n, (t, c, a) in self.nodes.items()}, "struct<type: string, criterion: string, action: string>")
        edges = _map({_pair(n, b): F.struct(text(t).alias("target"), many(a).alias("actions")) for (n, b), (t, a) in self.edges.items()}, "struct<target: string, actions: array<string>>")
        return nodes, edges, _map({_pair(n, s): many(sorted(b)) for (n, s), b in self.states.items()}, "array<string>")


def _pair(a: str, b: str) -> str:
    return f"{a}\x1f{b}"


def _map(items: dict[str, Column], kind: str) -> Column:
    return F.create_map(*(x for k, v in items.items() for x in (F.lit(k), v))) if items else F.expr(f"cast(map() as map<string, {kind}>)")


def expand(tree: Tree, cases: DataFrame, answers: DataFrame | None = None, overrides: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every path of every case over all branches that its states admit.

    cases(case, ...), answers(case, criterion, state); a criterion without an answer is NOT_DOCUMENTED. Without answers, cases
    have them as a map `told`. overrides(case, node, branch) forces a branch; a map `forced` of the cases does so too. Result:
    case, the columns to keep, path, actions, n_branches by decision (resolved has 1) and failure, which is null for a path that
    ends well."""
    nodes, edges, states = tree.lookups()
    rows = cases
    if answers is not None:
        told = answers.groupBy("case").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "state"))).alias("told"))
        rows = cases.select("case", *keep).join(told, "case", "left")
    if overrides is not None:
        rows = rows.join(overrides.groupBy("case").agg(F.map_from_entries(F.collect_list(F.struct("node", "branch"))).alias("forced")), "case", "left")
    elif "forced" not in rows.columns:
        rows = rows.withColumn("forced", F.expr("cast(null as map<string, string>)"))
    # node is where a walk stands, null once it has ended; ended walks go along unchanged
    rows = rows.select("case", *keep, "told", "forced", F.lit(tree.root).alias("node"), F.expr(EMPTY).alias("path"), F.expr(EMPTY).alias("actions"), F.expr("cast(array() as array<struct<node: string, n: int>>)").alias("decisions"), F.lit(None).cast("string").alias("failure"), F.lit(None).cast("string").alias("leaf"))
    for depth in range(1, 2 * len(tree.nodes) + 2):
        node, at, gained = F.col("node"), F.col("at"), F.col("edge")["actions"]
        rows = rows.withColumn("at", F.try_element_at(nodes, node))
        why = F.when(F.array_contains("path", node), "cycle_or_step_limit").when(at.isNull(), "dangling_edge").when(at["type"] == "configuration_gap", "configuration_gap").when((at["type"] == "terminal") & at["action"].isNull(), "terminal_missing_action").when((at["type"] == "path_end") & (F.size("actions") == 0), "path_end_without_encoded_action")
        rows = rows.withColumn("why", F.when(node.isNotNull(), why))
        state = F.coalesce(F.try_element_at("told", at["criterion"]), F.lit("NOT_DOCUMENTED"))
        forced = F.try_element_at("forced", node)
        branches = F.when(forced.isNotNull(), F.array(forced)).otherwise(F.coalesce(F.try_element_at(states, F.concat_ws("\x1f", node, state)), F.expr(EMPTY)))
        asks = F.col("why").isNull() & (at["type"] == "criterion")
        rows = rows.withColumn("branches", F.when(asks, branches))
        rows = rows.withColumn("why", F.when(F.size("branches") == 0, "no_admissible_branch").otherwise(F.col("why")))
        rows = rows.withColumn("branch", F.explode_outer(F.when(F.col("why").isNull(), F.col("branches"))))
        rows = rows.withColumn("edge", F.try_element_at(edges, F.concat_ws("\x1f", node, F.col("branch"))))
        ended = node.isNotNull() & F.col("branch").isNull()
        lost = F.col("branch").isNotNull() & F.col("edge").isNull()
        ends_well = F.when((at["type"] == "terminal") & F.col("why").isNull(), F.concat("actions", F.array(at["action"]))).otherwise(F.col("actions"))
        rows = rows.select(
            "case", *keep, "told", "forced", F.when(F.col("branch").isNotNull(), F.col("edge")["target"]).alias("node"), F.when(node.isNull() | (F.coalesce("why", F.lit("")) == "cycle_or_step_limit"), F.col("path")).otherwise(F.concat("path", F.array(node))).alias("path"),
            F.when(ended, ends_well).otherwise(F.concat("actions", F.coalesce(gained, F.expr(EMPTY)))).alias("actions"), F.when(F.col("branch").isNotNull(), F.concat("decisions", F.array(F.struct(node.alias("node"), F.size("branches").alias("n"))))).otherwise(F.col("decisions")).alias("decisions"),
            F.when(lost, F.concat(F.lit("branch_missing_target:"), "branch")).otherwise(F.coalesce("failure", "why")).alias("failure"), F.when(ended | lost, node).otherwise(F.col("leaf")).alias("leaf"),
        )
        if not _deeper(tree, depth):
            break
    return rows.select("case", *keep, "path", "actions", "decisions", "failure", "leaf")


def _deeper(tree: Tree, depth: int) -> bool:
    """Whether a path of the tree may still go on after so many nodes; trees with cycles stop a step after a repeat."""
    front = {tree.root}
    for _ in range(depth):
        front = {t for (n, _), (t, _) in tree.edges.items() if n in front}
    return bool(front)


def action_id(sequence):
    return F.when(F.size(sequence) == 1, sequence[0]).otherwise(F.concat(F.lit("action_sequence_"), F.substring(F.sha2(F.array_join(sequence, "\x1f"), 256), 1, 16)))


def results(paths: DataFrame) -> DataFrame:
    """One row a case: reachable paths and leaves, action ids, resolved and unresolved nodes, depth, ambiguity, failures."""
    fine = F.col("failure").isNull()
    several = F.filter("decisions", lambda d: d["n"] > 1)
    first = F.when(F.size(several) > 0, F.array_position(F.transform("decisions", lambda d: d["n"] > 1), True) - 1)
    # A decision counts by its first place on any path, as every path to it has the same prefix length only in a tree.
    by = paths.groupBy("case").agg(
        F.array_sort(F.collect_set(F.when(fine, F.array_join("path", ">")))).alias("paths"), F.array_sort(F.collect_set(F.when(fine, F.col("leaf")))).alias("leaves"), F.array_sort(F.collect_set(F.when(fine, action_id(F.col("actions"))))).alias("action_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.filter("decisions", lambda d: d["n"] == 1), lambda d: d["node"]))))).alias("resolved"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(several, lambda d: d["node"]))))).alias("unresolved"),
        F.min(first).alias("first_unresolved"), F.max(F.size("decisions")).alias("longest"), F.array_sort(F.collect_set(F.when(~fine, F.concat_ws(":", "leaf", "failure")))).alias("failures"),
    )
    n = F.size("action_ids")
    return by.select("case", "paths", "leaves", "action_ids", "resolved", "unresolved", F.coalesce("first_unresolved", F.col("longest").cast("long")).alias("resolved_depth"), n.alias("n_actions"), F.log2(F.greatest(F.lit(1), n)).alias("ambiguity"), ((n == 1) & (F.size("failures") == 0)).alias("unique_action"), "failures")


def critical(tree: Tree, cases: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(case, node): unresolved nodes for which forcing one branch or another leads to other sets of action sequences. What a case
    says goes along with its unresolved nodes, so the trials of a node stay where it is."""
    if answers is not None:
        told = answers.groupBy("case").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "state"))).alias("told"))
        cases = cases.select("case").join(told, "case", "left")
    several = F.filter("decisions", lambda d: d["n"] > 1)
    base = expand(tree, cases.withColumn("says", F.col("told")), keep=["says"]).select("case", "says", F.explode(F.transform(several, lambda d: d["node"])).alias("asked"))
    base = base.groupBy("case", "asked").agg(F.first("says").alias("told"))
    edges = cases.sparkSession.createDataFrame(list(tree.edges), "asked string, choice string")
    runs = base.join(F.broadcast(edges), "asked").withColumn("forced", F.create_map("asked", "choice"))
    paths = expand(tree, runs, keep=["asked", "choice"])
    sets = paths.groupBy("case", "asked", "choice").agg(F.array_sort(F.collect_set(F.when(F.col("failure").isNull(), F.array_join("actions", "\x1f")))).alias("actions"))
    by = sets.groupBy("case", "asked").agg(F.size(F.collect_set("actions")).alias("n"))
    return by.where("n > 1").select("case", F.col("asked").alias("node"))


def _asked(state: Column, asked: Column, minimum: Column) -> Column:
    """(state, o): what a state makes of the column `said`, asking its questions, structs of `at` and `question`, in order: calls,
    how many are yes, and how it ends."""
    zero = F.struct(F.lit(0).alias("calls"), F.lit(0).alias("yes"), F.lit(None).cast("string").alias("end"))
    entries = F.array_sort(F.flatten(F.transform(asked, lambda a: F.transform(F.filter("said", lambda x: x["question"] == a["question"]), lambda x: F.struct(a["at"].alias("at"), x["answer"].alias("answer"))))))

    def ask(acc, x):
        yes = acc["yes"] + (x["answer"] == "yes").cast("int")
        end = F.when(~F.coalesce(x["answer"].isin("yes", "no"), F.lit(False)), "INVALID_OUTPUT").when(yes >= minimum, "yes").when(x["at"] + 1 >= F.size(asked), "no")
        return F.when(acc["end"].isNotNull(), acc).otherwise(F.struct((acc["calls"] + 1).alias("calls"), yes.alias("yes"), end.alias("end")))

    return F.struct(state.alias("state"), F.aggregate(entries, zero, ask).alias("o"))


def gathered(answers: DataFrame) -> DataFrame:
    """answers(case, question, answer) to (case, said), a list a case."""
    return answers.groupBy("case").agg(F.collect_list(F.struct("question", "answer")).alias("said"))


def walk(spark: SparkSession, machine: Sequence[dict], root: str, answers: DataFrame) -> DataFrame:
    """Threshold machine: each state asks its questions in order until enough are yes, then takes its yes or no target.

    machine: state, questions (ids in order), minimum, yes and no, each ('state'|'terminal', name). answers(case, question,
    answer); an answer other than yes and no, or null, ends the case as INVALID_OUTPUT. Result: case, status, action, calls,
    visited, branches."""
    return walk_cases(machine, root, gathered(answers))


def walk_cases(machine: Sequence[dict], root: str, cases: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """walk() of cases(case, said), which have their answers already as a list of structs (question, answer): projections only. The
    columns to keep go along."""
    targets = _map({m["state"]: F.struct(*(F.lit(v).alias(k) for k, v in zip(("yes_kind", "yes_to", "no_kind", "no_to"), (*m["yes"], *m["no"]), strict=True))) for m in machine}, "struct<yes_kind: string, yes_to: string, no_kind: string, no_to: string>")
    outcomes = [_asked(F.lit(m["state"]), F.array(*(F.struct(F.lit(i).alias("at"), F.lit(q).alias("question")) for i, q in enumerate(m["questions"]))), F.lit(m["minimum"])) for m in machine]
    states = [m["state"] for m in machine]
    rows = cases.select("case", *keep, F.map_from_entries(F.array(*outcomes)).alias("known"), F.lit(root).alias("state"), F.lit(0).alias("calls"), F.expr(EMPTY).alias("visited"), F.expr(EMPTY).alias("branches"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("action"))
    for _ in machine:  # a walk that has ended keeps its status and goes along
        rows = rows.withColumns({"o": F.try_element_at("known", F.col("state")), "to": F.try_element_at(targets, F.col("state"))})
        branch = F.coalesce(F.col("o")["end"], F.lit("INVALID_OUTPUT"))
        yes = branch == "yes"
        rows = rows.withColumns({"branch": branch, "kind": F.when(yes, F.col("to")["yes_kind"]).otherwise(F.col("to")["no_kind"]), "next": F.when(yes, F.col("to")["yes_to"]).otherwise(F.col("to")["no_to"]), "seen": F.concat("visited", F.array("state"))})
        bad = F.col("branch") == "INVALID_OUTPUT"
        loops = (F.col("kind") == "state") & (F.array_contains("seen", F.col("next")) | ~F.col("next").isin(states))
        status = F.when(bad, "INVALID_OUTPUT").when(loops, "TREE_FAILURE").when(F.col("kind") == "terminal", "COMPLETED")
        live = F.col("status").isNull()
        rows = rows.withColumn("now", F.when(live, status))
        rows = rows.select(
            "case", *keep, "known", F.when(live, F.col("next")).otherwise(F.col("state")).alias("state"), F.when(live, F.col("calls") + F.coalesce(F.col("o")["calls"], F.lit(0))).otherwise(F.col("calls")).alias("calls"), F.when(live, F.col("seen")).otherwise(F.col("visited")).alias("visited"),
            F.when(live & ~bad, F.concat("branches", F.array(F.concat_ws(":", "state", "branch")))).otherwise(F.col("branches")).alias("branches"), F.coalesce("status", "now").alias("status"), F.when(live & (F.col("now") == "COMPLETED"), F.col("next")).otherwise(F.col("action")).alias("action"),
        )
    return rows.select("case", *keep, "status", "action", "calls", "visited", "branches")


def walk_tables(states: DataFrame, questions: DataFrame, cases: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Machines as data, as many as there are domains: every case walks that of its own.

    states(domain, state, root, minimum, yes_kind, yes_to, no_kind, no_to): one root a domain; kinds are 'state' and 'terminal'.
    questions(domain, state, question, at); cases(case, domain); answers(case, question, answer), without which cases have theirs
    as `said`, a list of structs (question, answer). What a case says is counted per state first; a round then joins the cases that
    still walk with the table of transitions, by domain and state: a broadcast where that table is small, else a shuffle. The
    walks that end leave the loop, which ends when none is left. Result as walk(), and the domain; a case whose domain has no
    root, or more than one, is a TREE_FAILURE without calls."""
    states, questions = shared.written(states, "states"), shared.written(questions, "questions")
    table = shared.small(states, 256)
    if answers is not None:
        cases = cases.join(gathered(answers), "case", "left")
    asked = questions.groupBy("domain", "state").agg(F.array_sort(F.collect_list(F.struct("at", "question"))).alias("asked")).join(states.select("domain", "state", "minimum"), ["domain", "state"])
    asked = shared.written(asked.groupBy("domain").agg(F.collect_list(F.struct("state", "asked", "minimum")).alias("asks")), "asked")
    outcomes = F.transform("asks", lambda m: _asked(m["state"], m["asked"], m["minimum"]))
    met = cases.join(shared.small(asked, 4096), "domain", "left").select("case", "domain", F.map_from_entries(outcomes).alias("known"))
    roots = states.where("root").groupBy("domain").agg(F.when(F.count("*") == 1, F.max("state")).alias("state"))
    blank = {"calls": F.lit(0), "visited": F.expr(EMPTY), "branches": F.expr(EMPTY), "status": F.lit(None).cast("string"), "action": F.lit(None).cast("string")}
    live = met.join(shared.small(shared.written(roots, "roots"), 128), "domain", "left").withColumns(blank)
    shown = ["case", "domain", "status", "action", "calls", "visited", "branches"]
    done = live.where("state is null").withColumn("status", F.lit("TREE_FAILURE")).select(shown)
    live = shared.written(live.where("state is not null"), "walks")
    while not live.isEmpty():
        met = live.join(table, ["domain", "state"], "left").withColumn("o", F.try_element_at("known", F.col("state")))
        branch = F.coalesce(F.col("o")["end"], F.lit("INVALID_OUTPUT"))
        yes = branch == "yes"
        met = met.withColumns({"branch": branch, "kind": F.when(yes, F.col("yes_kind")).otherwise(F.col("no_kind")), "next": F.when(yes, F.col("yes_to")).otherwise(F.col("no_to"))})
        missing = F.col("minimum").isNull()  # no such state
        bad = F.col("branch") == "INVALID_OUTPUT"
        seen = F.concat("visited", F.array("state"))
        loops = (F.col("kind") == "state") & F.array_contains(seen, F.col("next"))
        status = F.when(missing, "TREE_FAILURE").when(bad, "INVALID_OUTPUT").when(loops, "TREE_FAILURE").when(F.col("kind") == "terminal", "COMPLETED")
        step = met.select(
            "case", "domain", "known", F.when(missing, F.col("state")).otherwise(F.col("next")).alias("state"), (F.col("calls") + F.when(missing, 0).otherwise(F.coalesce(F.col("o")["calls"], F.lit(0)))).alias("calls"), F.when(missing, F.col("visited")).otherwise(seen).alias("visited"),
            F.when(missing | bad, F.col("branches")).otherwise(F.concat("branches", F.array(F.concat_ws(":", "state", "branch")))).alias("branches"), status.alias("status"), F.when(status == "COMPLETED", F.col("next")).alias("action"),
        )
        step = shared.written(step, "walks")
        done = done.unionByName(step.where("status is not null").select(shown))
        live = step.where("status is null")
    return done
