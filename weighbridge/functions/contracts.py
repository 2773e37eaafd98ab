"""Judging of model responses against output contracts.

Responses are arbitrary text, and what counts is Python's reading of JSON (last duplicate key wins, NaN is a number, no
trailing text), so the judges are Arrow-batched UDFs; everything after them is built-in expressions on their structs.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States that a response may give, each with the reason code that goes with it.
REASON_OF_STATE = {
    "PRESENT_CURRENT": "explicit_present",
    "ABSENT_EXPLICIT": "explicit_negation",
    "HISTORICAL": "historical",
    "FAMILY_HISTORY_OR_OTHER_EXPERIENCER": "other_experiencer",
    "UNCERTAIN": "ambiguous",
    "NOT_DOCUMENTED": "not_documented",
}
ABSTENTION = "model_abstention"
NO_STATE = "NOT_DOCUMENTED"
#: Labels of the three heads of the note contract.
HEADS = {"detection": ("yes", "no", "abstain"), "encounter": ("yes", "no", "not_applicable", "abstain"), "negation": ("yes", "no", "unsure", "not_applicable", "abstain")}
#: What a failed or abstained head predicts; the end label and the names that stand for it.
FAILED = "__failure__"
END = "End of Decision Tree"
ENDS = ("End", "No specific action required")
#: Fixed patterns: the strict and the loose enclosing fence.
STRICT_FENCE = re.compile(r"```(?:json)?\r?\n(.*?)\r?\n```", re.DOTALL)
LOOSE_FENCE = re.compile(r"\s*```(?:json)?[ \t]*\r?\n(.*?)\r?\n```\s*", re.DOTALL | re.IGNORECASE)



def _struct(strings: str, booleans: str, order: str) -> T.StructType:
    kinds = dict.fromkeys(strings.split(), T.StringType()) | dict.fromkeys(booleans.split(), T.BooleanType())
    return T.StructType([T.StructField(n, kinds[n]) for n in order.split()])


VALID = "parse_valid schema_valid logical_valid abstained"
VERDICT = _struct("state failure state_only assembled", VALID, f"state {VALID} failure state_only assembled")
NOTE_VERDICT = _struct("detection encounter negation failure", VALID, f"detection encounter negation {VALID} failure")
_BAD = object()


def read(raw: str | None) -> object:
    """The JSON value of the whole text, or _BAD."""
    try:
        return json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return _BAD


def _number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and 0 <= v <= 1


def _one_of(allowed) -> Callable[[object], bool]:
    return lambda v: isinstance(v, str) and v in allowed


#: What each field of a record must be; the compact record has the first four, the full one all.
FIELDS: dict[str, Callable[[object], bool]] = {
    "criterion_id": lambda v: isinstance(v, str),
    "state": _one_of(REASON_OF_STATE),
    "confidence": _number,
    "abstain": lambda v: isinstance(v, bool),
    "value": lambda v: v is None,
    "unit": lambda v: v is None,
    "evidence": lambda v: v == [],
    "reason_code": _one_of({*REASON_OF_STATE.values(), ABSTENTION}),
}
COMPACT = tuple(FIELDS)[:4]


def judge(raw: str | None, contract: str, criterion: str, runtime_failed: bool) -> tuple:
    """One response against the `full` or the `compact` contract, in the order of VERDICT."""
    if runtime_failed or raw is None:
        only = None if runtime_failed else _only_state(read(raw), criterion)
        return None, False, False, False, False, "runtime_failure", only, None
    value = read(raw)
    only = _only_state(value, criterion)
    if value is _BAD:
        return None, False, False, False, False, "parse_failure", only, raw if contract == "full" else None
    names = COMPACT if contract == "compact" else tuple(FIELDS)
    right = isinstance(value, dict) and set(value) == set(names) and value["criterion_id"] == criterion and all(FIELDS[n](value[n]) for n in names)
    if not right:
        return None, True, False, False, False, "schema_failure", only, raw if contract == "full" else None
    if contract == "compact":
        reason = ABSTENTION if value["abstain"] else REASON_OF_STATE[value["state"]]
        value = value | {"value": None, "unit": None, "evidence": [], "reason_code": reason}
        raw = json.dumps(value, sort_keys=True, separators=(",", ":"))
    if value["abstain"]:
        sound = (value["state"], value["reason_code"], value["confidence"]) == (NO_STATE, ABSTENTION, 0)
    else:
        sound = value["reason_code"] == REASON_OF_STATE[value["state"]]
    return None if value["abstain"] else value["state"], True, True, sound, value["abstain"], None if sound else "logical_failure", only, raw


def _only_state(value: object, criterion: str) -> str | None:
    fine = isinstance(value, dict) and value.get("criterion_id") == criterion and FIELDS["state"](value.get("state"))
    return value["state"] if fine else None


def heads_agree(detection: str, encounter: str, negation: str) -> bool:
    """Whether the lower heads suit the first, abstention allowed."""
    if detection == "yes":
        return "not_applicable" not in (encounter, negation)
    rest = {"no": "not_applicable", "abstain": "abstain"}[detection]
    return encounter == negation == rest


def judge_note(raw: str | None, runtime_failed: bool) -> tuple:
    """One response against the three-head contract, in the order of NOTE_VERDICT."""
    if runtime_failed or raw is None:
        return None, None, None, False, False, False, False, "runtime_failure"
    value = read(raw)
    if value is _BAD:
        return None, None, None, False, False, False, False, "parse_failure"
    if not (isinstance(value, dict) and set(value) == set(HEADS) and all(_one_of(allowed)(value[h]) for h, allowed in HEADS.items())):
        return None, None, None, True, False, False, False, "schema_failure"
    said = tuple(value[h] for h in HEADS)
    sound = heads_agree(*said)
    return *said, True, True, sound, "abstain" in said, None if sound else "logical_failure"


def unfence_strict(raw: str | None) -> tuple[str | None, bool]:
    """Without the one fence around a complete JSON object; anything else stays as it is."""
    m = STRICT_FENCE.fullmatch(raw.strip()) if isinstance(raw, str) else None
    if m is None or "```" in m[1] or not isinstance(read(m[1]), dict):
        return raw, False
    return m[1], True


def unfence_loose(raw: str | None) -> tuple[str | None, bool]:
    """Without a fence around the whole text, whatever it holds."""
    m = LOOSE_FENCE.fullmatch(raw) if isinstance(raw, str) else None
    return (raw, False) if m is None else (m[1], True)


def leaves(cell: str | None) -> tuple[list[str], bool]:
    """The strings in a cell that holds a Python literal of nested lists, tuples or sets, each once in order; and whether
    there were lists in lists. A cell that is no literal is one string; a mapping anywhere is an error."""
    text = (cell or "").strip()
    if not text:
        return [], False
    try:
        value = ast.literal_eval(text)
    except (SyntaxError, ValueError):
        value = text
    out: dict[str, None] = {}
    nested = False
    todo: list[tuple[object, int]] = [(value, 0)]
    while todo:
        item, depth = todo.pop()
        if isinstance(item, dict):
            raise ValueError("a mapping is no feature")
        if isinstance(item, list | tuple | set):
            nested |= depth > 0
            todo += [(x, depth + 1) for x in reversed(sorted(item, key=repr) if isinstance(item, set) else list(item))]
        elif s := str(item).strip():
            out[s] = None
    return list(out), nested


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names, dtype=object)


def _text(v: object) -> str | None:
    return v if isinstance(v, str) else None


@F.pandas_udf(VERDICT)
def judged(raw: pd.Series, contract: pd.Series, criterion: pd.Series, runtime_failed: pd.Series) -> pd.DataFrame:
    return _frame([judge(_text(r), c, k, bool(f)) for r, c, k, f in zip(raw, contract, criterion, runtime_failed, strict=True)], VERDICT)


@F.pandas_udf(NOTE_VERDICT)
def judged_note(raw: pd.Series, runtime_failed: pd.Series) -> pd.DataFrame:
    return _frame([judge_note(_text(r), bool(f)) for r, f in zip(raw, runtime_failed, strict=True)], NOTE_VERDICT)


UNFENCED = _struct("text", "removed", "text removed")


@F.pandas_udf(UNFENCED)
def unfenced_strict(raw: pd.Series) -> pd.DataFrame:
    return _frame([unfence_strict(_text(r)) for r in raw], UNFENCED)


@F.pandas_udf(UNFENCED)
def unfenced_loose(raw: pd.Series) -> pd.DataFrame:
    return _frame([unfence_loose(_text(r)) for r in raw], UNFENCED)


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaves_of(cell: pd.Series) -> pd.Series:
    return pd.Series([leaves(_text(c))[0] for c in cell])


MECHANISMS = ("not_valid_json", "json_not_object", "schema_echo", "missing_required_keys", "additional_keys", "nonempty_or_invalid_evidence", "non_null_value", "non_null_unit", "state_label_used_as_reason_code")
FLAGS = _struct("", " ".join(MECHANISMS), " ".join(MECHANISMS))


def mechanisms(raw: str | None) -> tuple[bool, ...]:
    """What is wrong with a response to the full contract; several may hold. A missing response is no JSON object."""
    value = read(raw) if raw is not None else None
    if value is _BAD:
        return (True, *[False] * 8)
    if not isinstance(value, dict):
        return (False, True, *[False] * 7)
    keys, wanted = set(value), set(FIELDS)
    return False, False, {"type", "properties"} <= keys and not wanted <= keys, bool(wanted - keys), bool(keys - wanted), value.get("evidence") != [], value.get("value") is not None, value.get("unit") is not None, FIELDS["state"](value.get("reason_code"))


@F.pandas_udf(FLAGS)
def mechanism_flags(raw: pd.Series) -> pd.DataFrame:
    return _frame([mechanisms(_text(r)) for r in raw], FLAGS)


def observed_label(v: Column, runtime_failed: Column) -> Column:
    """One label a response: the first failure in order of precedence, abstention, or the state."""
    return (
        F.when(runtime_failed, "INFERENCE_FAILURE").when(v["abstained"], "MODEL_ABSTENTION").when(~v["parse_valid"], "PARSE_FAILURE")
        .when(~v["schema_valid"], "SCHEMA_FAILURE").when(~v["logical_valid"], "LOGICAL_FAILURE").otherwise(v["state"])
    )


def criterion_state(v: Column, runtime_failed: Column) -> Column:
    return F.when(v["logical_valid"] & ~v["abstained"], v["state"]).when(runtime_failed, "INFERENCE_FAILURE").when(v["abstained"], "MODEL_ABSTENTION").otherwise("PARSE_FAILURE")


def partition(v: Column, runtime_failed: Column, expected: Column) -> Column:
    """The cell of the exhaustive failure partition."""
    rest = F.concat(F.lit("schema_valid__state_"), F.when(v["state_only"] == expected, "correct").otherwise("wrong"), F.lit("__abstain_"), v["abstained"].cast("string"), F.lit("__logical_"), F.when(v["logical_valid"], "valid").otherwise("invalid"))
    return F.when(runtime_failed | (v["failure"] == "runtime_failure"), "runtime_failure").when(~v["parse_valid"], "parse_failure").when(~v["schema_valid"], "schema_failure").otherwise(rest)


def is_correct(v: Column, expected: Column) -> Column:
    return F.coalesce(v["logical_valid"] & ~v["abstained"] & (v["state"] == expected), F.lit(False))


def head(v: Column, name: str) -> Column:
    """The prediction of a head: failed unless the record is sound and the head answers."""
    answers = {"detection": ["yes", "no"], "encounter": ["yes", "no"], "negation": ["yes", "no", "unsure"]}[name]
    usable = v["logical_valid"] & v[name].isin(answers)
    return F.when(usable if name == "detection" else usable & (v["detection"] == "yes"), v[name]).otherwise(FAILED)


def joint_correct(v: Column, detection: Column, encounter: Column, negation: Column) -> Column:
    """All heads right; below a reference of no, only the first counts."""
    rest = (detection == "no") | ((v["encounter"] == encounter) & (v["negation"] == negation))
    return F.coalesce(v["logical_valid"] & (v["detection"] == detection) & rest, F.lit(False))


WHITE = r"[\s\x1c-\x1f\x85\xa0]"


def strict_answer(raw: Column) -> Column:
    bare = F.lower(F.regexp_replace(raw, rf"^{WHITE}+|{WHITE}+\z", ""))
    return F.when(bare.isin("yes", "no"), bare)


def legacy_answer(raw: Column) -> Column:
    """The first standalone yes or no, else no."""
    found = F.lower(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)(?U)\b(yes|no)\b", 1))
    return F.when(found != "", found).otherwise("no")


def period_answer(raw: Column) -> Column:
    """Yes or no with at most one final period, white space around it aside."""
    bare = F.regexp_replace(raw, rf"^{WHITE}+|{WHITE}+\z", "")
    return F.when(bare.rlike(r"(?i)\A(yes|no)\.?\z"), F.lower(F.regexp_replace(bare, r"\.\z", "")))


def failure_class(raw: Column, runtime_failed: Column) -> Column:
    token = F.coalesce(raw, F.lit("")).rlike(r"(?i)(?U)\b(yes|no)\b")
    return F.when(runtime_failed, "runtime_failure").when(period_answer(raw).isNotNull(), "binary_with_single_terminal_period").when(token, "other_text_with_standalone_binary_token").otherwise("no_standalone_binary_token")


def terminal_label(label: Column) -> Column:
    """Names of the end become one."""
    bare = F.regexp_replace(label, rf"^{WHITE}+|{WHITE}+\z", "")
    return F.when(bare.isin(*ENDS), END).otherwise(bare)
