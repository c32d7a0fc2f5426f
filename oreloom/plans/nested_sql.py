"""The flat child records of problem 1 as one query over DuckDB's JSON functions, level by level."""

from __future__ import annotations

_WS = "E' \\t\\n\\r\\x0b\\x0c'"


def _members(source: str, name_field: str, own: tuple[str, ...]) -> str:
    """(trace_id, parent, name, content) of all members of ``source`` (trace_id, parent, j), whatever the shape of j."""
    fields = "[" + ", ".join(f"'{f}'" for f in (name_field, *own)) + "]"
    bare = f"trim(CASE WHEN json_type(m) = 'OBJECT' THEN m->>'$.{name_field}' WHEN json_type(m) IN ('VARCHAR', 'UBIGINT', 'BIGINT') THEN m->>'$' END, {_WS})"
    return f"""
  SELECT trace_id, parent, {bare} AS name, m AS content FROM (SELECT trace_id, parent, unnest(json_extract(j, '$[*]')) AS m FROM {source} WHERE json_type(j) = 'ARRAY')
  UNION ALL SELECT trace_id, parent, trim(j->>'$.{name_field}', {_WS}), j FROM {source} WHERE json_type(j) = 'OBJECT' AND list_has_any(json_keys(j), {fields})
  UNION ALL SELECT trace_id, parent, trim(k, {_WS}), json_extract(j, '$."' || k || '"') FROM (SELECT trace_id, parent, j, unnest(json_keys(j)) AS k FROM {source} WHERE json_type(j) = 'OBJECT' AND NOT list_has_any(json_keys(j), {fields}))
  UNION ALL SELECT trace_id, parent, trim(j->>'$', {_WS}), j FROM {source} WHERE json_type(j) IN ('VARCHAR', 'UBIGINT', 'BIGINT')"""


def _levels() -> str:
    """The members of every level, as common table expressions."""
    decoded = "CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j->>'$' AS JSON) ELSE j END"
    return f"""
WITH raw AS (SELECT DISTINCT trace_id, stages, edges FROM xgb_traces),
stage_j AS (SELECT trace_id, '' AS parent, CASE WHEN json_type(j) = 'OBJECT' AND json_keys(j) = ['items'] THEN j->'items' ELSE j END AS j FROM (
  SELECT trace_id, {decoded} AS j FROM (SELECT trace_id, try_cast(stages AS JSON) AS j FROM raw))),
stage AS (SELECT * FROM ({_members('stage_j', 'stage', ('probability', 'threshold', 'selected', 'in_ground_truth', 'val_f1', 'val_support', 'sections'))}) WHERE name <> ''),
section_j AS (SELECT trace_id, name AS parent, content->'sections' AS j FROM stage WHERE json_type(content) = 'OBJECT'),
section AS (SELECT * FROM ({_members('section_j', 'section', ('weight', 'evidence'))}) WHERE name <> ''),
evidence_j AS (SELECT trace_id, {{'stage': parent, 'section': name}} AS parent, content->'evidence' AS j FROM section WHERE json_type(content) = 'OBJECT'),
evidence AS (SELECT * FROM ({_members('evidence_j', 'page', ('table_id', 'quote'))}) WHERE name <> ''),
edge_j AS (SELECT trace_id, {decoded} AS j FROM (SELECT trace_id, try_cast(edges AS JSON) AS j FROM raw)),
edge_m AS (
  SELECT trace_id, m, m AS content, NULL AS k FROM (SELECT trace_id, unnest(json_extract(j, '$[*]')) AS m FROM edge_j WHERE json_type(j) = 'ARRAY')
  UNION ALL SELECT trace_id, j, j, NULL FROM edge_j WHERE json_type(j) = 'OBJECT' AND list_has_any(json_keys(j), ['src', 'dst', 'from_type', 'to_type', 'support', 'score'])
  UNION ALL SELECT trace_id, NULL, json_extract(j, '$."' || k || '"'), k FROM (SELECT trace_id, j, unnest(json_keys(j)) AS k FROM edge_j WHERE json_type(j) = 'OBJECT' AND NOT list_has_any(json_keys(j), ['src', 'dst', 'from_type', 'to_type', 'support', 'score']))),
edge AS (
  SELECT trace_id, content,
    trim(CASE WHEN k IS NOT NULL THEN split_part(k, '|', 1) WHEN json_type(m) = 'ARRAY' THEN m->>'$[0]' WHEN json_type(m) = 'OBJECT' THEN coalesce(m->>'$.src', m->>'$.from_type') END, {_WS}) AS a,
    trim(CASE WHEN k IS NOT NULL THEN CASE WHEN contains(k, '|') THEN substr(k, instr(k, '|') + 1) END WHEN json_type(m) = 'ARRAY' THEN m->>'$[1]' WHEN json_type(m) = 'OBJECT' THEN coalesce(m->>'$.dst', m->>'$.to_type') END, {_WS}) AS b
  FROM edge_m)
"""


def child_records_sql() -> str:
    return f"""{_levels()}
SELECT DISTINCT trace_id, 'stage' AS child_kind, '' AS parent_key, name AS item_key FROM stage
UNION SELECT trace_id, 'section', parent, name FROM section
UNION SELECT trace_id, 'evidence', parent.stage || '/' || parent.section, name FROM evidence
UNION SELECT trace_id, 'edge', '', a || '>' || b FROM edge WHERE a <> '' AND b <> ''
"""


def flat_sql(kind: str) -> str:
    """The flat rows of one kind with their plain fields; a member that is no object has none."""
    text = lambda f: f"CASE WHEN json_type(content) = 'OBJECT' AND json_type(content->'$.{f}') NOT IN ('OBJECT', 'ARRAY') THEN content->>'$.{f}' END"
    number = lambda *fs: ", ".join(f"try_cast({text(f)} AS DOUBLE) AS {f}" for f in fs)
    rows = {
        "stages": f"name AS stage, {number('probability', 'threshold', 'val_f1', 'val_support')}, try_cast({text('selected')} AS BOOLEAN) AS selected, try_cast({text('in_ground_truth')} AS BOOLEAN) AS in_ground_truth FROM stage",
        "sections": f"parent AS stage, name AS section, {number('weight')} FROM section",
        "evidence": f"parent.stage AS stage, parent.section AS section, try_cast(name AS BIGINT) AS page, {text('table_id')} AS table_id, {text('quote')} AS quote FROM evidence",
        "edges": f"a AS src, b AS dst, {number('support', 'score')} FROM edge WHERE a <> '' AND b <> ''",
    }
    return f"{_levels()}\nSELECT DISTINCT trace_id, {rows[kind]}"


def rejects_sql() -> str:
    broken = lambda f: f"SELECT DISTINCT trace_id, '{f}' AS field, length({f}) AS n_chars FROM xgb_traces WHERE trim({f}, {_WS}) <> '' AND NOT json_valid({f})"
    return f"{broken('stages')} UNION {broken('edges')}"
