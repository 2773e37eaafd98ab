"""SQL of the panels and their scores, on which the queries' SQL builds. It is written for DuckDB and shares nothing with
the operators but the arithmetic that derives the panels' raw text."""

from __future__ import annotations

from weighbridge.sources import tables


def chain(steps: list[tuple[str, str]], name: str, conditions: int) -> str:
    out = [f"{name}0 AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars, m, c FROM labels l JOIN documents USING (doc_id), range(0, {tables.MODELS}) a(m), range(0, {conditions}) b(c))"]
    for i, (column, expression) in enumerate(steps):
        out.append(f"{name}{i + 1} AS (SELECT *, {expression.replace('as string', 'as varchar')} AS {column} FROM {name}{i})")
    return ",\n".join(out)


FULL_KEYS = "['abstain','confidence','criterion_id','evidence','reason_code','state','unit','value']"
COMPACT_KEYS = "['abstain','confidence','criterion_id','state']"
STATES = "('PRESENT_CURRENT','ABSENT_EXPLICIT','HISTORICAL','FAMILY_HISTORY_OR_OTHER_EXPERIENCER','UNCERTAIN','NOT_DOCUMENTED')"
REASON = "CASE {} WHEN 'PRESENT_CURRENT' THEN 'explicit_present' WHEN 'ABSENT_EXPLICIT' THEN 'explicit_negation' WHEN 'HISTORICAL' THEN 'historical' WHEN 'FAMILY_HISTORY_OR_OTHER_EXPERIENCER' THEN 'other_experiencer' WHEN 'UNCERTAIN' THEN 'ambiguous' WHEN 'NOT_DOCUMENTED' THEN 'not_documented' END"


def scored(source: str, name: str, raw: str = "raw_output") -> str:
    """CTEs that judge the typed responses of a CTE by the JSON functions of the engine."""
    return f"""
{name}_a AS (SELECT *, coalesce(json_valid({raw}), false) AS parse_valid, CASE WHEN json_valid({raw}) THEN {raw}::JSON END AS j FROM {source}),
{name}_b AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN list_sort(json_keys(j)) END AS ks, j->>'state' AS st, j->>'reason_code' AS rc,
   TRY_CAST(j->>'confidence' AS DOUBLE) AS cf, j->>'abstain' AS ab FROM {name}_a),
{name}_c AS (SELECT *, coalesce((j->>'criterion_id') = criterion_id AND st IN {STATES}, false) AS named FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN named THEN st END AS state_only, coalesce(named AND cf BETWEEN 0 AND 1 AND json_type(j->'abstain') = 'BOOLEAN' AND
   CASE WHEN condition LIKE 'compact%' THEN ks = {COMPACT_KEYS} ELSE ks = {FULL_KEYS} AND json_type(j->'value') = 'NULL' AND json_type(j->'unit') = 'NULL' AND (j->'evidence')::VARCHAR = '[]' END, false) AS schema_valid FROM {name}_c),
{name}_e AS (SELECT *, schema_valid AND ab = 'true' AS abstained, schema_valid AND CASE WHEN ab = 'true' THEN st = 'NOT_DOCUMENTED' AND cf = 0 AND (condition LIKE 'compact%' OR rc = 'model_abstention')
   ELSE condition LIKE 'compact%' OR rc = {REASON.format("st")} END AS logical_valid FROM {name}_d),
{name} AS (SELECT *, coalesce(logical_valid AND NOT abstained AND st = expected_state, false) AS state_correct, coalesce(state_only = expected_state, false) AS state_only_correct,
   CASE WHEN runtime_failed THEN 'INFERENCE_FAILURE' WHEN abstained THEN 'MODEL_ABSTENTION' WHEN NOT parse_valid THEN 'PARSE_FAILURE' WHEN NOT schema_valid THEN 'SCHEMA_FAILURE' WHEN NOT logical_valid THEN 'LOGICAL_FAILURE' ELSE st END AS observed_label,
   CASE WHEN runtime_failed THEN 'runtime_failure' WHEN NOT parse_valid THEN 'parse_failure' WHEN NOT schema_valid THEN 'schema_failure' WHEN NOT logical_valid THEN 'logical_failure' END AS failure FROM {name}_e)"""


def judged_notes(source: str, name: str, raw: str = "raw_output") -> str:
    return f"""
{name}_a AS (SELECT *, coalesce(json_valid({raw}), false) AS parse_valid, CASE WHEN json_valid({raw}) THEN {raw}::JSON END AS j FROM {source}),
{name}_b AS (SELECT *, j->>'detection' AS jd, j->>'encounter' AS je, j->>'negation' AS jn, CASE WHEN json_type(j) = 'OBJECT' THEN list_sort(json_keys(j)) END AS ks FROM {name}_a),
{name}_c AS (SELECT *, coalesce(ks = ['detection','encounter','negation'] AND jd IN ('yes','no','abstain') AND je IN ('yes','no','not_applicable','abstain') AND jn IN ('yes','no','unsure','not_applicable','abstain'), false) AS schema_valid FROM {name}_b),
{name}_d AS (SELECT *, schema_valid AND CASE jd WHEN 'yes' THEN je <> 'not_applicable' AND jn <> 'not_applicable' WHEN 'no' THEN je = 'not_applicable' AND jn = 'not_applicable' ELSE je = 'abstain' AND jn = 'abstain' END AS logical_valid,
   schema_valid AND 'abstain' IN (jd, je, jn) AS abstained FROM {name}_c),
{name} AS (SELECT *, CASE WHEN logical_valid AND jd IN ('yes','no') THEN jd ELSE '__failure__' END AS p_detection,
   CASE WHEN logical_valid AND jd = 'yes' AND je IN ('yes','no') THEN je ELSE '__failure__' END AS p_encounter,
   CASE WHEN logical_valid AND jd = 'yes' AND jn IN ('yes','no','unsure') THEN jn ELSE '__failure__' END AS p_negation,
   coalesce(logical_valid AND jd = detection AND (detection = 'no' OR (je = encounter AND jn = negation)), false) AS joint FROM {name}_d)"""


N, M = len(tables.TYPED), len(tables.NOTES)
PANEL = "WITH " + chain(tables.TYPED, "p", tables.CONDITIONS) + f",\npanel AS (SELECT * FROM p{N})"
SCORED = PANEL + "," + scored("panel", "s")
STRICT = "CASE WHEN starts_with(raw_output, '```json' || chr(10)) AND ends_with(raw_output, chr(10) || '```') THEN substr(raw_output, 9, length(raw_output) - 12) ELSE raw_output END"
NOTE_PANEL = "WITH " + chain(tables.NOTES, "p", 2) + f",\nnotes AS (SELECT * FROM p{M})"
NOTES = NOTE_PANEL + "," + judged_notes("notes", "s")
LOOSE = "CASE WHEN starts_with(raw_output, '```JSON ' || chr(10)) AND ends_with(raw_output, chr(10) || '```') THEN substr(raw_output, 10, length(raw_output) - 13) ELSE raw_output END"
