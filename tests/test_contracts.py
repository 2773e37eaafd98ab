import json

import pytest

from weighbridge.functions import contracts as c

FULL = {"criterion_id": "c1", "state": "PRESENT_CURRENT", "value": None, "unit": None, "evidence": [], "reason_code": "explicit_present", "confidence": 0.9, "abstain": False}
COMPACT = {k: FULL[k] for k in ("criterion_id", "state", "confidence", "abstain")}
NAMES = c.VERDICT.names


def judged(raw, contract="full", failed=False, criterion="c1"):
    return dict(zip(NAMES, c.judge(raw if raw is None or isinstance(raw, str) else json.dumps(raw), contract, criterion, failed), strict=True))


def test_full_record():
    v = judged(FULL)
    assert v["state"] == "PRESENT_CURRENT" and v["logical_valid"] and not v["abstained"] and v["failure"] is None
    assert judged(FULL | {"reason_code": "historical"})["failure"] == "logical_failure"
    for wrong in ({"evidence": ["x"]}, {"confidence": True}, {"confidence": 1.01}, {"confidence": "1"}, {"abstain": 0}, {"state": "CONFLICT"}, {"criterion_id": "c2"}, {"value": 1}, {"extra": 1}, {"reason_code": None}):
        assert judged(FULL | wrong)["failure"] == "schema_failure", wrong
    assert judged({k: v for k, v in FULL.items() if k != "unit"})["failure"] == "schema_failure"


@pytest.mark.parametrize("raw", ["", "{", "x", '{"a":1} x', "```json\n{}\n```"])
def test_parse_failures(raw):
    v = judged(raw)
    assert v["failure"] == "parse_failure" and not v["parse_valid"]


@pytest.mark.parametrize("raw", ["[]", "null", "1", "NaN", '"s"', "{}"])
def test_json_that_is_no_record(raw):
    v = judged(raw)
    assert v["failure"] == "schema_failure" and v["parse_valid"]


def test_runtime_failure_comes_first():
    assert judged(None)["failure"] == judged(FULL, failed=True)["failure"] == "runtime_failure"
    assert judged(FULL, failed=True)["state_only"] is None


def test_abstention():
    gives_up = FULL | {"state": "NOT_DOCUMENTED", "reason_code": "model_abstention", "confidence": 0, "abstain": True}
    v = judged(gives_up)
    assert v["abstained"] and v["logical_valid"] and v["state"] is None and v["state_only"] == "NOT_DOCUMENTED"
    assert judged(gives_up | {"confidence": 0.1})["failure"] == judged(gives_up | {"state": "UNCERTAIN"})["failure"] == "logical_failure"
    assert judged(gives_up | {"abstain": False})["failure"] == "logical_failure"


def test_compact_record_is_completed_and_never_repaired():
    v = judged(COMPACT, "compact")
    assert v["logical_valid"] and json.loads(v["assembled"]) == FULL
    assert judged(FULL, "compact")["failure"] == judged(COMPACT, "full")["failure"] == "schema_failure"
    v = judged(COMPACT | {"abstain": True}, "compact")
    assert v["abstained"] and v["failure"] == "logical_failure"
    assert judged(json.dumps(COMPACT).replace("0.9", "NaN"), "compact")["failure"] == "schema_failure"


def test_last_of_double_keys_wins():
    assert judged('{"criterion_id":"x",' + json.dumps(COMPACT)[1:], "compact")["logical_valid"]


@pytest.mark.parametrize("said,valid,sound", [
    (("yes", "yes", "no"), True, True), (("yes", "no", "unsure"), True, True), (("no", "not_applicable", "not_applicable"), True, True), (("abstain", "abstain", "abstain"), True, True), (("yes", "abstain", "yes"), True, True),
    (("no", "yes", "not_applicable"), True, False), (("yes", "not_applicable", "no"), True, False), (("abstain", "yes", "no"), True, False), (("yes", "unsure", "no"), False, False), (("YES", "yes", "no"), False, False),
])
def test_note_contract(said, valid, sound):
    raw = json.dumps(dict(zip(("detection", "encounter", "negation"), said, strict=True)))
    v = dict(zip(c.NOTE_VERDICT.names, c.judge_note(raw, False), strict=True))
    assert v["schema_valid"] == valid and v["logical_valid"] == sound and v["abstained"] == (valid and "abstain" in said)
    assert c.judge_note(raw, True)[-1] == "runtime_failure" and c.judge_note("x", False)[-1] == "parse_failure" and c.judge_note("[1]", False)[-1] == "schema_failure"


@pytest.mark.parametrize("raw,body", [("```json\n{}\n```", "{}"), ("```\n{\"a\":1}\n```", '{"a":1}'), (" \n```json\r\n{}\r\n```\n", "{}")])
def test_strict_fence_accepts(raw, body):
    assert c.unfence_strict(raw) == (body, True)


@pytest.mark.parametrize("raw", [None, "", "{}", "```json{}```", "```JSON\n{}\n```", "```json \n{}\n```", "```json\n[]\n```", "```json\n{\n```", "a\n```json\n{}\n```", "```json\n{}\n```\nb", "```json\n{}\n``` ```", "``json\n{}\n``", "```json\n{}\n```\n```json\n{}\n```", "```json\n\"```\"\n```", "```yaml\n{}\n```", "```json\n{}", "```json\n\n```"])
def test_strict_fence_leaves_alone(raw):
    assert c.unfence_strict(raw) == (raw, False)


def test_loose_fence():
    assert c.unfence_loose(" ```JSON \t\n[1\n``` \n") == ("[1", True)
    assert c.unfence_loose("```yaml\n{}\n```")[1] is False and c.unfence_loose(None) == (None, False)


def test_leaves():
    assert c.leaves("['a', ['b', ('c', 'a')], ' d ', '']") == (["a", "b", "c", "d"], True)
    assert c.leaves("plain text") == (["plain text"], False) and c.leaves(None) == c.leaves("  ") == ([], False) and c.leaves("{'b', 'a'}")[0] == ["a", "b"]
    with pytest.raises(ValueError):
        c.leaves("[{'a': 1}]")


def test_binary_answers(spark):
    said = ["Yes", " no ", "YES.", "\nNo.\t", "No..", "No,", "**No**", "Answer: No", "", None, "éyes", "yes and no"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, raw string").coalesce(1)
    got = rows.select("i", c.strict_answer(F.col("raw")), c.legacy_answer(F.col("raw")), c.period_answer(F.col("raw")), c.failure_class(F.col("raw"), F.lit(False))).orderBy("i").collect()
    assert [r[1] for r in got] == ["yes", "no"] + [None] * 10
    assert [r[2] for r in got] == ["yes", "no", "yes", "no", "no", "no", "no", "no", "no", "no", "no", "yes"]
    assert [r[3] for r in got] == ["yes", "no", "yes", "no"] + [None] * 8
    assert [r[4] for r in got][2:] == ["binary_with_single_terminal_period"] * 2 + ["other_text_with_standalone_binary_token"] * 4 + ["no_standalone_binary_token"] * 3 + ["other_text_with_standalone_binary_token"]
