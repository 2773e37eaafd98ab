import pytest

from weighbridge.operators import rules


def test_every_kind_of_rule(spark):
    rows = spark.createDataFrame([(1, "a", "5", "x"), (2, "b", "1", "x"), (3, None, None, "y"), (4, " ", "no", None)], "id int, v string, n string, u string")
    asked = [("there", "v", "required", None, "error"), ("of", "v", "one_of", "a| ", "warning"), ("least", "n", "least", "2", "blocker"), ("most", "n", "most", "4", "warning"), ("like", "v", "pattern", "[a-c]", "warning"), ("alone", "u", "unique", None, "error"), ("in", "u", "in_table", "t", "error"), ("froze", "n", "frozen", None, "blocker"), ("gone", "q", "required", None, "warning")]
    tables = spark.createDataFrame([("t", "x"), ("other", "y")], "name string, value string")
    frozen = spark.createDataFrame([(1, "n", "5"), (2, "n", "2"), (3, "n", None)], "manifest int, field string, value string")
    found = rules.violations(rows, "id", spark.createDataFrame(asked, rules.RULES), tables, frozen)
    got = sorted((x.manifest, x.rule) for x in found.collect())
    want = [(1, "alone"), (1, "most"), (2, "alone"), (2, "froze"), (2, "least"), (2, "of"), (3, "in"), (3, "there"), (4, "froze"), (4, "least"), (4, "like"), (4, "most"), (4, "there")]
    assert got == sorted([*want, *((i, "gone") for i in (1, 2, 3, 4))])
    told = {x.manifest: (x.verdict, x.errors, x.blockers, x.warnings) for x in rules.verdicts(rows, "id", found).collect()}
    assert told == {1: ("invalid", 1, 0, 2), 2: ("invalid", 1, 2, 2), 3: ("invalid", 2, 0, 1), 4: ("invalid", 1, 2, 3)}
    only = spark.createDataFrame([("least", "n", "least", "2", "blocker")], rules.RULES)
    assert {x.manifest: x.verdict for x in rules.verdicts(rows, "id", rules.violations(rows, "id", only)).collect()} == {1: "ready", 2: "blocked", 3: "ready", 4: "blocked"}


def test_unknown_rules_are_errors(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, v string")
    for bad in (("r", "v", "smells", None, "error"), ("r", "v", "required", None, "fatal")):
        with pytest.raises(Exception, match="unknown kind or level"):
            rules.violations(rows, "id", spark.createDataFrame([bad], rules.RULES)).collect()
