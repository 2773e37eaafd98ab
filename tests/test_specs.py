import pytest

from weighbridge.operators import traversal
from weighbridge.plans import reports
from weighbridge.sources import specs

LINEAR = [
    {"name": "red flags", "criteria": ["a", "b", "c"], "min_criteria": 2, "yes_action": "Refer", "no_node": "pain"},
    {"name": "pain", "yes_action": "scan", "no_node": "End"},
    {"name": "scan", "yes_action": "Operate", "no_node": "No specific action required"},
]


def test_linear_machine(spark):
    m = specs.linear_machine("back", LINEAR)
    assert [x["state"] for x in m] == ["back.n01", "back.n02", "back.n03"] and m[0]["questions"] == ["back.n01.c01", "back.n01.c02", "back.n01.c03"]
    assert m[0]["yes"] == ("terminal", "Refer") and m[0]["no"] == ("state", "back.n02") and m[1]["yes"] == ("state", "back.n03") and m[2]["no"] == ("terminal", "End of Decision Tree")
    answers = spark.createDataFrame([("k", q, "no") for x in m for q in x["questions"]], "case string, question string, answer string")
    got = traversal.walk(spark, m, "back.n01", answers).first()
    assert got.status == "COMPLETED" and got.action == "End of Decision Tree" and got.calls == 4


@pytest.mark.parametrize("change", [
    lambda n: n[1].update(name="red flags"), lambda n: n[1].update(no_node="nowhere"), lambda n: n[0].update(min_criteria=4), lambda n: n[1].update(min_criteria=1), lambda n: n[2].update(no_node="pain"), lambda n: n[0].update(name=" "),
])
def test_linear_machine_rejects(change):
    nodes = [dict(n) for n in LINEAR]
    change(nodes)
    with pytest.raises(ValueError):
        specs.linear_machine("back", nodes)


def test_sectioned_machine():
    slugs = {"symptoms": "symptoms", "more tests": "more"}
    sections = {"Symptoms": {"nodes": [{"name": "x", "yes_action": "MORE Tests", "no_node": "y"}, {"name": "y", "yes_action": "Watch", "no_node": "End"}]}, "More tests ": {"nodes": [{"name": "x", "yes_action": "Treat", "no_node": "End"}]}}
    m = specs.sectioned_machine("d", sections, slugs)
    assert m[0]["yes"] == ("state", "d.more.n01") and m[0]["no"] == ("state", "d.symptoms.n02") and specs.unreachable(m) == []
    with pytest.raises(ValueError):
        specs.sectioned_machine("d", {"Symptoms": sections["Symptoms"]}, slugs)


def test_tree_from_spec():
    t = specs.tree({"root_id": "a", "nodes": [{"node_id": "a", "node_type": "criterion", "criterion_id": "c", "state_branch_map": {"S": ["yes"]}, "branches": {"yes": "t"}, "branch_actions": {"yes": [{"action_id": "k"}]}}, {"node_id": "t", "node_type": "terminal", "terminal_action_id": "go"}]})
    assert t.edges["a", "yes"] == ("t", ["k"]) and t.states["a", "S"] == ["yes"] and t.problems() == []
    with pytest.raises(ValueError):
        specs.tree({"root_id": "a", "nodes": [{"node_id": "a", "node_type": "terminal"}] * 2})


def test_feature_names_and_target_texts():
    assert specs.legacy_feature_name({"normalization_metadata": {"legacy_name": "n"}}) == "n"
    assert specs.legacy_feature_name({"source_reference": "file:part/the name/x"}) == "the name/x"
    with pytest.raises(ValueError):
        specs.legacy_feature_name({"source_reference": "none"})
    criteria = [{"criterion_id": "a", "criterion_text": "A"}, {"criterion_id": "b", "criterion_text": "B", "aggregation_rule": {"components": [{"criterion_id": "b1", "criterion_text": "B1"}]}}]
    assert specs.target_texts(criteria) == {"a": "A", "b1": "B1"}


def test_markdown(spark):
    shown = reports.markdown(spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 2)], "x string, y double, z int"))
    assert shown.splitlines() == ["| x | y | z |", "| --- | --- | --- |", "| a | 1.000 | 2 |", "| b | 0.500 | - |"]


def test_too_many_rows_for_a_table(spark):
    with pytest.raises(ValueError):
        reports.markdown(spark.range(4), most=3)


def test_loose_tree(spark):
    from weighbridge.operators import loose

    seen = lambda value: sorted(tuple(r) for r in loose.audit(loose.nodes(spark, value)).collect())
    good = {"nodes": [{"name": "A b", "yes_action": "x", "no_node": "a-B 2"}, {"name": "A b 2", "yes_action": "y", "no_node": "End of decision tree"}]}
    assert seen(good) == [] and seen({}) == [("", "", "error", "no sections")]
    bad = {"S": {"nodes": [{"name": "a", "yes_action": "", "no_node": "zz"}, {"name": "b", "yes_action": "Continue to node c", "criteria": ["q"], "min_criteria": True}]}}
    assert seen(bad) == [
        ("S", "a", "error", "no such node"),
        ("S", "a", "error", "no yes_action"),
        ("S", "b", "error", "min_criteria does not suit the criteria"),
        ("S", "b", "error", "out of reach"),
        ("S", "b", "warning", "criteria of an aggregate need definitions"),
        ("S", "b", "warning", "no no_node"),
        ("S", "b", "warning", "the action goes on to a node that is not named"),
    ]
    # two names without an ASCII letter are two nodes; equal names are not
    two = {"nodes": [{"name": "\u03b1", "yes_action": "x", "no_node": "\u03b2"}, {"name": "\u03b2", "yes_action": "x", "no_node": "end of decision tree"}]}
    assert seen(two) == []
    assert ("T", "a", "error", "names repeat") in seen({"T": {"nodes": [{"name": "a", "yes_action": "x"}, {"name": "A", "yes_action": "x", "criteria": "q"}]}})


def test_small_files(spark, tmp_path):
    import json
    import os

    from weighbridge.sources import files

    path = tmp_path / "o.json"
    files.write_object(str(path), {"b": 1, "a": "é"}, owner_only=True)
    assert path.read_text() == '{\n  "a": "é",\n  "b": 1\n}\n' and os.stat(path).st_mode & 0o777 == 0o600
    files.write_lines(spark.createDataFrame([(1, None)], "z int, a string"), str(tmp_path / "l"))
    files.write_lines(spark.createDataFrame([(2, "x")], "z int, a string"), str(tmp_path / "l"), "append")
    lines = sorted(x for p in (tmp_path / "l").glob("part*") for x in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"a": "x", "z": 2}, {"a": None, "z": 1}] and lines[0].startswith('{"a"')
    assert files.resolve(str(tmp_path / "c" / "conf.json"), "../d.csv") == (tmp_path / "d.csv").resolve()
    sheets = {"binary_classification": [["precision", "x", "x", "x", "x"], ["# note", "", "", "", ""], ["back", "0.5 ± 0.1", "0.25", "n/a", "e1"], ["short"]], "other": [["back", "1", "1", "1", "e"]]}
    assert [tuple(r) for r in files.metric_rows(spark, sheets).collect()] == [("binary_classification", "back", 0.5, 0.25, None, "e1")]
