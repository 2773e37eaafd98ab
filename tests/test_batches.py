import random

import pytest
from pyspark.sql import functions as F

from weighbridge.operators import forests, traversal
from weighbridge.streaming import ingest

KIND = "batch long, v long"


def offered(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/{name}")


def there(spark, sink, place="rows"):
    return sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", "true").schema(KIND).parquet(f"{sink}/{place}").collect())


def outcomes(spark, sink, run):
    return {r.batch: r.outcome for r in ingest.log(spark, sink).where(F.col("run") == run).collect()}


def test_finished_batches_are_skipped_and_stale_ones_rejected(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    first = [(0, 1), (0, 2), (1, 5)]
    ingest.resume(offered(spark, tmp_path, "a", first), sink, f"{tmp_path}/ca", "p", "a")
    ingest.resume(offered(spark, tmp_path, "b", [(0, 2), (0, 1), (1, 6), (2, 9)]), sink, f"{tmp_path}/cb", "p", "b")
    assert outcomes(spark, sink, "a") == {0: "landed", 1: "landed"} and outcomes(spark, sink, "b") == {0: "skipped", 1: "stale", 2: "landed"}
    assert there(spark, sink) == sorted([*first, (2, 9)]) and there(spark, sink, "stale") == [(1, 6)]
    ingest.resume(offered(spark, tmp_path, "c", [(0, 1), (0, 2)]), sink, f"{tmp_path}/cc", "other", "c")  # the same rows from elsewhere
    assert outcomes(spark, sink, "c") == {0: "stale"}
    expected = ingest.digests(spark.createDataFrame([*first, (2, 9), (3, 1)], KIND), "p")
    assert [(r.batch, r.why) for r in ingest.unfinished(spark, sink, expected).collect()] == [(3, "missing")]
    assert sorted((r.batch, r.why) for r in ingest.unfinished(spark, sink, ingest.digests(spark.createDataFrame([(0, 1), (1, 5)], KIND), "p")).collect()) == [(0, "stale")]


@pytest.mark.parametrize("place", ["rows", "log", "registry"])
def test_a_restart_leaves_the_same(spark, tmp_path, monkeypatch, place):
    """A run that fails while or after it writes a place, and is started again."""
    from pyspark.sql import DataFrameWriter

    sink, write, failed = f"{tmp_path}/sink", DataFrameWriter.parquet, []

    def broken(self, path, *a, **b):
        write(self, path, *a, **b)
        if f"/{place}/" in path and not failed:
            failed.append(path)
            raise RuntimeError("executor lost")

    stream = offered(spark, tmp_path, "a", [(0, 1), (0, 2)])
    offered(spark, tmp_path, "a", [(1, 5)])
    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(Exception, match="executor lost"):
        ingest.resume(stream, sink, f"{tmp_path}/ca", "p", "a")
    ingest.resume(stream, sink, f"{tmp_path}/ca", "p", "a")
    assert there(spark, sink) == [(0, 1), (0, 2), (1, 5)] and outcomes(spark, sink, "a") == {0: "landed", 1: "landed"}
    assert sorted(r.batch for r in ingest.registry(spark, sink).collect()) == [0, 1]


def closure(edges):
    reach = {e for e in edges}
    while more := {(a, z) for a, b in reach for c, z in edges if b == c} - reach:
        reach |= more
    return reach


def test_reach_and_cycles_equal_brute_force(spark):
    r = random.Random(4)
    graphs = {t: {(r.randrange(12), r.randrange(12)) for _ in range(r.choice([5, 12, 20]))} for t in range(6)}
    graphs[6] = {(i, i + 1) for i in range(9)} | {(9, 9)}
    graphs[7] = {(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 3), (5, 0)}
    edges = spark.createDataFrame([(t, a, z) for t, g in graphs.items() for a, z in g], "tree long, node long, target long")
    got = {(x.tree, x.node) for x in forests.on_cycles(edges).collect()}
    assert got == {(t, a) for t, g in graphs.items() for a, z in closure(g) if a == z}
    roots = spark.createDataFrame([(t, 0) for t in graphs], "tree long, root long")
    got = {(x.tree, x.node) for x in forests.reached(edges, roots).collect()}
    assert got == {(t, 0) for t in graphs} | {(t, z) for t, g in graphs.items() for a, z in closure(g) if a == 0}


def test_a_clean_tree_has_no_problems(spark):
    nodes = spark.createDataFrame([("t", "a", "criterion", "c", None), ("t", "b", "terminal", None, "do"), ("t", "c", "path_end", None, None)], "tree string, node string, kind string, criterion string, action string")
    edges = spark.createDataFrame([("t", "a", "yes", "b"), ("t", "a", "no", "c")], "tree string, node string, branch string, target string")
    states = spark.createDataFrame([("t", "a", s, b) for s in ("P", "U") for b in ("yes", "no")], "tree string, node string, state string, branch string")
    roots = spark.createDataFrame([("t", "a"), ("u", "x")], "tree string, root string")
    found = {(x.tree, x.node, x.problem) for x in forests.problems(nodes, edges, states, roots, ("P", "U")).collect()}
    assert found == {("u", "x", "missing root")}


def test_walk_tables_equals_walk(spark):
    machine = [{"state": "s1", "questions": ["q1", "q2"], "minimum": 1, "yes": ("state", "s2"), "no": ("terminal", "End")}, {"state": "s2", "questions": ["q3"], "minimum": 1, "yes": ("terminal", "Go"), "no": ("state", "s1")}]
    r = random.Random(5)
    answers = spark.createDataFrame([(str(i), f"q{k}", r.choice(["yes", "no", "no", None, "x"])) for i in range(80) for k in (1, 2, 3) if r.random() < 0.95], "case string, question string, answer string")
    want = {x.case: tuple(x) for x in traversal.walk(spark, machine, "s1", answers).collect()}
    states = spark.createDataFrame([("d", m["state"], m["state"] == "s1", m["minimum"], *m["yes"], *m["no"]) for m in machine] + [("e", "s1", True, 1, "state", "gone", "state", "gone")], "domain string, state string, root boolean, minimum int, yes_kind string, yes_to string, no_kind string, no_to string")
    questions = spark.createDataFrame([("d", m["state"], q, i) for m in machine for i, q in enumerate(m["questions"])] + [("e", "s1", "q1", 0)], "domain string, state string, question string, at int")
    cases = answers.select("case").distinct().withColumn("domain", F.lit("d")).unionByName(spark.createDataFrame([("none", "nowhere"), ("lost", "e")], "case string, domain string"))
    said = answers.unionByName(spark.createDataFrame([("lost", "q1", "yes")], answers.schema))
    got = {x.case: x for x in traversal.walk_tables(states, questions, cases, said).collect()}
    assert {c: (x.case, x.status, x.action, x.calls, x.visited, x.branches) for c, x in got.items() if x.domain == "d"} == want
    assert got["none"].status == got["lost"].status == "TREE_FAILURE" and got["none"].calls == 0 and got["lost"].branches == ["s1:yes"]
