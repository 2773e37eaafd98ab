import gzip
import hashlib
import hmac
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from weighbridge.functions import scalars
from weighbridge.operators import forests, metrics, paired, resample, traversal
from weighbridge.plans import trees
from weighbridge.sources import files
from weighbridge.streaming import ingest


def test_exact_mcnemar(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 9), (40, 60), (500, 480), (0, 30)]

    def exact(a, b):
        n = a + b
        return None if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n)

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    for r, (a, b) in zip(rows.select("i", paired.mcnemar(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect(), pairs, strict=True):
        want = exact(a, b)
        assert (r.p is None) == (want is None) and (want is None or abs(r.p - want) < 1e-9)


def test_holm_is_monotone_and_skips_nulls(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.9)], "id string, p double")
    got = {r.id: r.adjusted for r in paired.holm(rows, "p", ["id"]).collect()}
    assert got["a"] == 0.04 and abs(got["c"] - 0.09) < 1e-12 and abs(got["b"] - 0.09) < 1e-12 and got["e"] == 0.9 and got["d"] is None


def test_midranks(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 2.0), (1, "d", 1.0)], "r int, m string, s double")
    assert {x.m: x.midrank for x in paired.midranks(rows, ["r"], "s").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


def test_interval_rules(spark):
    values = spark.createDataFrame([(float(i),) for i in range(1, 41)], "v double")
    got = values.agg(paired.interval_by_index(F.collect_list("v")).alias("i"), paired.interval_by_index(F.collect_list("v"), style="outer").alias("o")).first()
    assert tuple(got.i) == (1.0, 40.0) and tuple(got.o) == (2.0, 39.0)


def test_linear_interval(spark):
    rows = spark.createDataFrame([("a", 0.207145445)] * 9 + [("b", float(i)) for i in range(41)] + [("c", None)], "k string, v double")
    got = {r.k: (r.i.low, r.i.high) for r in rows.groupBy("k").agg(paired.interval_linear(F.collect_list("v")).alias("i")).collect()}
    assert got == {"a": (0.207145445, 0.207145445), "b": (1.0, 39.0), "c": (None, None)}


def test_bootstrap_equals_rematerialised_rows(spark):
    r = random.Random(1)
    rows = [(f"s{i % 7}", r.random() < 0.6) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster string, ok boolean")
    clusters = df.select("cluster").distinct()
    sums = df.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    got = {x.replicate: (x.n, x.k) for x in resample.resampled(sums, clusters, "cluster", 15, [], ["n", "k"]).collect()}
    joined = sums.join(paired.weights(clusters, "cluster", 15), "cluster").groupBy("replicate").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("k")).alias("k"))
    assert got == {x.replicate: (x.n, x.k) for x in joined.collect()}
    ids = sorted({c for c, _ in rows}, key=lambda c: (hashlib.sha256(c.encode()).hexdigest()[:3], c))
    for rep in range(15):
        sample = [ids[int(hashlib.sha256(f"{rep}|{slot}".encode()).hexdigest()[:8], 16) % len(ids)] for slot in range(len(ids))]
        again = [ok for c in sample for d, ok in rows if d == c]
        assert got[rep] == (len(again), sum(again))


def test_blocks_of_clusters_and_strata(spark, monkeypatch):
    """Many blocks, strata that are null or small, cells that few clusters have, names like the operator's own."""
    monkeypatch.setattr(resample, "BLOCK", 8)
    monkeypatch.setattr(resample, "CHUNK", 7)
    monkeypatch.setattr(resample, "SLOTS", 5)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", "b", "b"]), i, r.choice(["x", "y", None]), r.randrange(5)) for i in range(90) for _ in range(3)] + [("a", 500, "rare", 4), (None, 501, "x", 9), ("c", 502, "x", 1)]
    sums = spark.createDataFrame(rows, "at string, block long, cell string, size int").groupBy("at", "block", "cell").agg(F.sum("size").alias("size"))
    clusters = sums.select("at", "block").distinct()
    got = {(x.replicate, x.at, x.cell): x["size"] for x in resample.resampled(sums, clusters, "block", 20, ["at", "cell"], ["size"], ["at"]).collect()}
    named = clusters.withColumnsRenamed({"at": "stratum", "block": "c"})
    drawn = paired.weights(named, "c", 20, ["stratum"])
    want = sums.withColumnsRenamed({"at": "stratum", "block": "c"}).join(drawn, ["stratum", "c"]).groupBy("replicate", "stratum", "cell").agg(F.sum(F.col("w") * F.col("size")).alias("n"))
    assert got == {(x.replicate, x.stratum, x.cell): x.n for x in want.collect()} and any(k[2] == "rare" for k in got) and len([k for k in got if k[2] == "rare"]) < 20


def test_a_draw_costs_the_same_at_any_number_of_clusters(spark):
    for n in (4_000, 16_000):
        dealt = resample.dealt_out(spark.range(n).withColumnRenamed("id", "_c"), 20, [])
        total = dealt.agg(F.sum(F.length("counts") + F.length("places")).alias("bytes"), F.sum(F.length("places")).alias("draws"), F.count("*").alias("rows")).first()
        assert total.draws == 20 * n and total.bytes < 1.2 * total.draws and total.rows <= 16 * (n // 256 + 1)


def test_differences_of_all_pairs(spark):
    rows = spark.createDataFrame([(1, "b", 3.0), (1, "a", 1.0), (1, "c", None), (2, "a", 1.0)], "r int, m string, v double")
    got = {(x.r, x.arm_a, x.arm_b, x.v) for x in resample.paired_differences(rows, ["r"], "m", ["v"]).collect()}
    assert got == {(1, "a", "b", 2.0), (1, "a", "c", None), (1, "b", "c", None)}


def test_no_clusters(spark):
    sums = spark.createDataFrame([], "c string, k string, n long")
    assert resample.resampled(sums, sums.select("c"), "c", 5, ["k"], ["n"]).count() == 0


def test_failures_count_as_false_negatives(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b"), ("b", "x")], "g string, p string")
    got = {r.label: r for r in metrics.classes(rows, [], "g", "p").collect()}
    assert set(got) == {"a", "b"} and got["a"].fn == 1 and got["a"].fp == 0 and got["b"].fn == 1 and got["b"].precision == 1.0
    fixed = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    got = {r.label: r for r in metrics.classes(rows, [], "g", "p", labels=fixed).collect()}
    assert got["c"].support == 0 and got["c"].f1 == 0.0
    assert {r.label for r in metrics.classes(rows, [], "g", "p", over="union").collect()} == {"a", "b", "x"}


def test_macro_needs_both_states_and_domains_weigh_the_same(spark):
    rows = [("d1", "PRESENT_CURRENT", True)] * 3 + [("d1", "ABSENT_EXPLICIT", False)] + [("d2", "PRESENT_CURRENT", False)] + [("d2", "ABSENT_EXPLICIT", True)] * 3
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, domain string, expected_state string, state_correct boolean")
    got = metrics.equal_domain(df, ["model"], "domain").first()
    assert got.pooled_macro == 0.75 and got.pooled_micro == 0.75 and got.equal_macro == 0.5
    one = metrics.equal_domain(df.where("not (domain = 'd1' and expected_state = 'ABSENT_EXPLICIT')"), ["model"], "domain").first()
    assert one.equal_macro is None and one.pooled_macro is not None


def test_tree_walks(spark):
    cases = spark.createDataFrame([("k",), ("u",)], "case string")
    answers = spark.createDataFrame([("k", "c1", "ABSENT_EXPLICIT"), ("k", "c2", "PRESENT_CURRENT"), ("u", "c1", "UNCERTAIN"), ("u", "c2", "PRESENT_CURRENT")], "case string, criterion string, state string")
    got = {r.case: r for r in traversal.results(traversal.expand(trees.TREE, cases, answers)).collect()}
    assert got["k"].action_ids == ["treat"] and got["k"].unique_action and got["k"].unresolved == [] and got["k"].resolved_depth == 2
    assert got["u"].unresolved == ["n1", "n3"] and got["u"].n_actions == 3 and got["u"].resolved_depth == 0 and "scan" in got["u"].action_ids
    assert {(r.case, r.node) for r in traversal.critical(trees.TREE, cases, answers).collect()} == {("u", "n1"), ("u", "n3")}
    cyclic = traversal.Tree("a", {"a": ("criterion", "x", None)}, {("a", "yes"): ("a", [])}, {("a", "NOT_DOCUMENTED"): ["yes"]})
    assert [r.failure for r in traversal.expand(cyclic, cases, answers).collect()] == ["cycle_or_step_limit"] * 2
    assert ("a", "cycle") in cyclic.problems() and traversal.Tree("a", {"a": ("terminal", None, "k")}, {}, {}).problems() == []


def test_threshold_machine_stops_early(spark):
    said = {"q1": "yes", "q2": "yes", "q3": None, "q4": "no", "q5": "yes", "q6": "no"}
    answers = spark.createDataFrame([("c", q, a) for q, a in said.items()] + [("d", q, "no") for q in said] + [("e", "q1", None), ("f", "unknown", "yes")], "case string, question string, answer string")
    got = {r.case: r for r in traversal.walk(spark, trees.MACHINE, "s1", answers).collect()}
    assert (got["c"].action, got["c"].calls, got["c"].visited) == ("End", 3, ["s1", "s2"])
    assert (got["d"].action, got["d"].calls) == ("No specific action required", 5) and got["e"].status == got["f"].status == "INVALID_OUTPUT"


def test_keyed_hash_and_ids(spark):
    salt = b"0123456789abcdef"
    row = spark.createDataFrame([("é", 5)], "a string, b int").select(scalars.keyed_hash(salt, "ns", F.col("a"), F.col("b")).alias("h"), scalars.stable_id("p", F.col("a"), F.col("b")).alias("i")).first()
    assert row.h == hmac.new(salt, "ns\x1fé\x1f5".encode(), "sha256").hexdigest()
    assert row.i == "p" + hashlib.sha256("é\x1f5".encode()).hexdigest()[:24]
    with pytest.raises(ValueError):
        scalars.keyed_hash(b"short", "ns", F.lit(1))


def test_window_moves_in_at_the_edges(spark):
    cases = [(50, 10, 20, 100), (1000, 0, 10, 100), (1000, 990, 1000, 100), (1000, 500, 511, 100)]
    for n, s, e, most in cases:
        w = spark.range(1).select(scalars.window_bounds(F.lit(n).cast("long"), F.lit(s).cast("long"), F.lit(e).cast("long"), most).alias("w")).first().w
        assert 0 <= w.lower <= s and e <= w.upper <= n and w.upper - w.lower == min(n, most)


def test_zoned_timestamps_slugs_and_comparison(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05",), ("2024-13-02T03:04:05Z",)], "t string")
    assert [r[0] is not None for r in rows.coalesce(1).select(scalars.zoned_timestamp(F.col("t"))).collect()] == [True, True, False, False]
    one = spark.range(1).select(scalars.slug(F.lit(" Low Back-Pain! ")), scalars.rendered(F.lit(False)), scalars.compared(F.lit("??"), F.lit(1), F.lit(2))).first()
    assert tuple(one) == ("low_back_pain", "false", None)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Row_ID,text\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["row_id", "TEXT"]).collect()
    assert [tuple(r) for r in got] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    (tmp_path / "b.csv").write_text("x,X\n1,2\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "b.csv"))
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "c.jsonl.gz"), "a int").collect()) == [1, 2]
    (tmp_path / "d.jsonl").write_text("[1]\nnot json\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "d.jsonl"), "a int").collect()
    (tmp_path / "e.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.read_object(str(tmp_path / "e.json"))
    rows = spark.range(5)
    assert files.write_same(rows, str(tmp_path / "out")) and not files.write_same(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        files.write_same(spark.range(6), str(tmp_path / "out"))
    assert files.inventory(spark, str(tmp_path), "*.csv").count() == 2


def test_spreadsheet(tmp_path):
    t, x = files.SHEET["table"], files.SHEET["text"]
    cell = lambda s, n=1: f'<t:table-cell t:number-columns-repeated="{n}">' + (f"<x:p>{s}</x:p>" if s else "") + "</t:table-cell>"
    xml = f'<d xmlns:t="{t}" xmlns:x="{x}"><t:table t:name="S"><t:table-row>{cell("a")}{cell("b", 2)}{cell("", 900)}</t:table-row><t:table-row t:number-rows-repeated="2">{cell("c")}</t:table-row><t:table-row t:number-rows-repeated="9999">{cell("")}</t:table-row></t:table></d>'
    with zipfile.ZipFile(tmp_path / "s.ods", "w") as z:
        z.writestr("content.xml", xml)
    assert files.read_sheets(str(tmp_path / "s.ods")) == {"S": [["a", "b", "b"], ["c"], ["c"]]}


def test_ingestion_resumes_without_double_rows(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(10).coalesce(1).write.parquet(str(source))
    for extra in (0, 0, 5):
        if extra:
            spark.range(100, 100 + extra).coalesce(1).write.mode("append").parquet(str(source))
        ingest.ingest(spark.readStream.schema("id long").parquet(str(source)), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    assert ingest.landed(spark, str(tmp_path / "rows")).count() == 15


def test_stream_of_hours(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.hourly(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("hours").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_span_longer_than_the_window(spark):
    from weighbridge.functions import scalars

    rows = spark.createDataFrame([(50, 0, 30)], "n long, s long, e long")
    bounds = lambda most: rows.select(scalars.window_bounds(F.col("n"), F.col("s"), F.col("e"), most).alias("w")).first().w
    assert tuple(bounds(30)) == (0, 30) and tuple(bounds(60)) == (0, 50)
    with pytest.raises(Exception, match="longer than the window"):
        bounds(20)


def test_label_without_a_document_is_an_error(spark):
    from weighbridge.sources import tables

    joined = spark.createDataFrame([(1, True), (2, None)], "doc_id long, found boolean")
    assert tables.labelled(joined.where("doc_id = 1"), "found", "doc_id").count() == 1
    with pytest.raises(Exception, match="a label without a row: 2"):
        tables.labelled(joined, "found", "doc_id").collect()


def test_keyed_pseudonyms_are_hmac(spark):
    import hashlib
    import hmac

    from weighbridge.functions import scalars

    got = {r.id: r.h for r in spark.range(9).select("id", scalars.keyed_hash(b"0123456789abcdef", "customer", F.col("id")).alias("h")).collect()}
    assert got == {i: hmac.new(b"0123456789abcdef", f"customer\x1f{i}".encode(), hashlib.sha256).hexdigest() for i in range(9)}


def test_formats(spark):
    from weighbridge.functions import scalars

    row = spark.range(1).select(scalars.percent(F.lit(0.1234)), scalars.percent(F.lit(None).cast("double")), scalars.interval(F.lit(-0.5), F.lit(0.25)), scalars.interval(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert tuple(row) == ("12.3%", "-", "[-0.500, 0.250]", "-")


def test_canonical_digest_orders_every_level(spark):
    a = spark.sql("select struct(2 as b, struct(1 as z, array(struct('q' as y, 'p' as x)) as a) as a) as v, map('k', map('b', 1, 'a', 2), 'c', map('d', 3)) as m, 1 as n")
    b = spark.sql("select struct(struct(array(struct('p' as x, 'q' as y)) as a, 1 as z) as a, 2 as b) as v, map('c', map('d', 3), 'k', map('a', 2, 'b', 1)) as m, 1 as n")
    got = [df.select(scalars.canonical_digest({f.name: f.dataType for f in df.schema}, v=F.col("v"), m=F.col("m"), n=F.col("n"))).first()[0] for df in (a, b)]
    text = '{"m":{"c":{"d":3},"k":{"a":2,"b":1}},"n":1,"v":{"a":{"a":[{"x":"p","y":"q"}],"z":1},"b":2}}'
    assert got == [hashlib.sha256(text.encode()).hexdigest()] * 2


def test_large_percents_and_folded_slugs(spark):
    row = spark.range(1).select(scalars.percent(F.lit(12.5)), scalars.slug(F.lit("Straße ﬁne ıx"))).first()
    assert tuple(row) == ("1250.0%", "strasse_fine_x")


def test_walks_of_cases_with_their_answers_need_no_shuffle(spark):
    cases = spark.createDataFrame([("a", [("q1", "yes"), ("q2", "yes"), ("q4", "no")]), ("b", [("q1", "no")]), ("c", None)], "case string, said array<struct<question: string, answer: string>>")
    out = traversal.walk_cases(trees.MACHINE, "s1", cases)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = traversal.walk(spark, trees.MACHINE, "s1", cases.select("case", F.inline("said")))
    assert {tuple(map(str, r)) for r in out.where("case <> 'c'").collect()} == {tuple(map(str, r)) for r in want.collect()}
    assert out.where("case = 'c'").first().status == "INVALID_OUTPUT"
    told = spark.createDataFrame([("u", {"c1": "UNCERTAIN", "c2": "PRESENT_CURRENT", "c3": "UNCERTAIN"})], "case string, told map<string, string>")
    found = traversal.critical(trees.TREE, told)
    assert {r.node for r in found.collect()} == {r.node for r in traversal.critical(trees.TREE, told.select("case"), told.select("case", F.explode("told").alias("criterion", "state"))).collect()}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_tables_of_trees_are_not_broadcast(spark):
    nodes = spark.createDataFrame([(t, n, "criterion", "c", "a") for t in range(3) for n in range(2)], "tree long, node long, kind string, criterion string, action string")
    edges = spark.createDataFrame([(t, n, b, 1 - n) for t in range(3) for n in range(2) for b in ("yes", "no")], "tree long, node long, branch string, target long")
    states = spark.createDataFrame([(0, 0, "s0", "yes")], "tree long, node long, state string, branch string")
    roots = spark.createDataFrame([(t, 0) for t in range(3)], "tree long, root long")
    out = forests.problems(nodes, edges, states, roots, ("s0",))
    assert out.where("problem = 'on a cycle'").count() == 6
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_units_and_clusters_are_not_broadcast(spark):
    """Small as these are: by the size of its file, a table of millions of units looks as small."""
    rows = [(c, u, m, (u * 7 + n * 3) % 4 < 2 if u % 5 else None) for c in "xy" for u in range(20) for n, m in enumerate("abc")] + [(None, 1, "a", True), ("x", None, "b", True), ("x", 3, None, True), ("x", 4, "b", False)]
    cells = spark.createDataFrame(rows, "c string, u long, m string, ok boolean")
    out = paired.discordance(cells, ["c"], "m", "ok", "u")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    a, b = (cells.select("c", "u", F.col("m").alias(f"arm_{x}"), F.col("ok").alias(x)) for x in "ab")
    want = a.join(b, ["c", "u"]).where("arm_a < arm_b").groupBy("c", "arm_a", "arm_b").agg(F.expr("count_if(a and not b)"), F.expr("count_if(b and not a)"), F.expr("count_if(a and b)"), F.count("*"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 6
    sums = cells.where("u is not null").groupBy("u", "m").agg(F.count("*").alias("n"))
    drawn = resample.resampled(sums, sums.select("u").distinct(), "u", 5, ["m"], ["n"])
    assert drawn.count() and "BroadcastHashJoin" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_step_down_values_read_their_rows_once(spark):
    rows = spark.createDataFrame([("f", "a", 0.04), ("f", "b", None), ("f", "c", 0.01), ("f", "d", 0.01), ("g", "a", None), ("g", "b", 0.6)], "k string, t string, p double")
    out = paired.holm(rows, "p", ["t"], ["k"])
    assert {(r.k, r.t): r.adjusted for r in out.collect()} == {("f", "a"): 0.04, ("f", "b"): None, ("f", "c"): 0.03, ("f", "d"): 0.03, ("g", "a"): None, ("g", "b"): 0.6}
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
