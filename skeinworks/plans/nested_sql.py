"""SQL for DuckDB that says the same as the queries over nested records, by a recursive walk with its JSON functions."""

from __future__ import annotations

from skeinworks.operators.shred import TABLES

FIELDS = ["trajectory_id", "env", "split", "goal", "blocks", "leakage_flags"]


def said(v: str) -> str:
    """What JSON text in a string says, where that is an object or a list."""
    text = f"json_extract_string({v}, '$')"
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND json_valid({text}) THEN CASE WHEN json_type({text}::json) IN ('OBJECT', 'ARRAY', 'NULL') THEN {text}::json ELSE {v} END ELSE {v} END"


def elements(v: str) -> str:
    """The elements of a list in any of its shapes, as a list of structs (position, value)."""
    listed = f"list_transform(range(json_array_length({v})::bigint), lambda i: {{'pos': i::bigint, 'v': json_extract({v}, '$[' || i || ']')}})"
    keyed = f"list_transform(json_keys({v}), lambda k: {{'pos': k::bigint, 'v': json_extract({v}, '$.\"' || k || '\"')}})"
    lone = f"[{{'pos': 0::bigint, 'v': {v}}}]"
    numbered = f"len(list_filter(json_keys({v}), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0"
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN {listed} WHEN 'OBJECT' THEN CASE WHEN {numbered} THEN {keyed} ELSE {lone} END WHEN 'NULL' THEN [] ELSE {lone} END"


def entries(v: str) -> str:
    """Keys and values of an object, or the elements of a list without a key."""
    keyed = f"list_transform(json_keys({v}), lambda k: {{'k': k, 'v': json_extract({v}, '$.\"' || k || '\"')}})"
    listed = f"list_transform(range(json_array_length({v})::bigint), lambda i: {{'k': NULL::varchar, 'v': json_extract({v}, '$[' || i || ']')}})"
    return f"CASE json_type({v}) WHEN 'OBJECT' THEN {keyed} WHEN 'ARRAY' THEN {listed} ELSE [] END"


HAS_FIELD = f"len(list_intersect(json_keys(j), {FIELDS})) > 0"
#: DuckDB takes a comma before a closing bracket for JSON; strings are set aside to find these.
STRICT = r"""NOT regexp_matches(regexp_replace(raw, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[}\]]')"""
#: Entities: ``line_no, entity, path, v`` of records, blocks, objects, flags and pieces of evidence.
WALK = f"""
WITH RECURSIVE wrapped AS (
  SELECT line_no, raw::json AS j FROM raw_trajectories WHERE raw IS NOT NULL AND json_valid(raw) AND {STRICT}
  UNION ALL
  SELECT line_no, {said("json_extract(j, '$.record')")} FROM wrapped
  WHERE json_type(j) = 'OBJECT' AND NOT ({HAS_FIELD}) AND json_type(json_extract(j, '$.record')) IN ('OBJECT', 'VARCHAR')
), records AS (
  SELECT line_no, j FROM wrapped WHERE json_type(j) = 'OBJECT' AND {HAS_FIELD}
), block_lists AS (
  SELECT line_no, {said("json_extract(j, '$.blocks')")} AS v FROM records WHERE json_extract(j, '$.blocks') IS NOT NULL
), flat_blocks AS (
  SELECT line_no, unnest({elements("v")}, recursive := true) FROM block_lists
), blocks AS (
  SELECT line_no, 'block' AS entity, pos::varchar AS path, v FROM flat_blocks WHERE json_type(v) <> 'NULL'
), flat_flags AS (
  SELECT line_no, unnest({elements("json_extract(j, '$.leakage_flags')")}, recursive := true) FROM records WHERE json_extract(j, '$.leakage_flags') IS NOT NULL
), flags AS (
  SELECT line_no, 'flag' AS entity, pos::varchar AS path, v FROM flat_flags WHERE json_type(v) <> 'NULL'
), flat_evidence AS (
  SELECT line_no, path AS above, unnest({elements("json_extract(v, '$.evidence')")}, recursive := true) FROM flags WHERE json_type(v) = 'OBJECT' AND json_extract(v, '$.evidence') IS NOT NULL
), evidence AS (
  SELECT line_no, 'evidence' AS entity, above || '.' || pos AS path, v FROM flat_evidence WHERE json_type(v) <> 'NULL'
), scene AS (
  SELECT line_no, path, {said("json_extract(v, '$.metadata')")} AS v, 'scene' AS place FROM blocks WHERE json_type(v) = 'OBJECT' AND json_extract(v, '$.metadata') IS NOT NULL
  UNION ALL
  SELECT line_no, CASE place WHEN 'objects' THEN path || '.' || e.pos ELSE path END, e.v, CASE WHEN place = 'objects' THEN 'object' WHEN e.k IN ('objects', 'contents') THEN 'objects' ELSE 'scene' END
  FROM (
    SELECT line_no, path, place, unnest(CASE place
      WHEN 'objects' THEN list_transform(list_filter({elements("v")}, lambda x: json_type(x.v) = 'OBJECT'), lambda x: {{'pos': x.pos, 'k': NULL::varchar, 'v': x.v}})
      ELSE list_transform({entries("v")}, lambda x: {{'pos': NULL::bigint, 'k': x.k, 'v': x.v}}) END) AS e
    FROM scene
  )
), objects AS (
  SELECT line_no, 'object' AS entity, path, v FROM scene WHERE place = 'object'
), entities AS (
  SELECT line_no, 'trajectory' AS entity, NULL::varchar AS path, j AS v FROM records
  UNION ALL SELECT * FROM blocks UNION ALL SELECT * FROM objects UNION ALL SELECT * FROM flags UNION ALL SELECT * FROM evidence
)
"""


def scalar(v: str) -> str:
    """A scalar as text; null where it is an object, a list, null or missing."""
    return f"CASE WHEN json_type({v}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL WHEN json_type({v}) = 'VARCHAR' THEN json_extract_string({v}, '$') ELSE {v}::varchar END"


def flat(entity: str, fields: list[str]) -> str:
    columns = []
    for field in fields:
        v, parts = "v", field.split(".")
        for part in parts:
            step = f"json_extract({v}, '$[{part}]')" if part.isdigit() else f"json_extract({v}, '$.\"{part}\"')"
            v = said(step) if (entity, part) == ("block", "metadata") else step
        columns.append(f"{scalar(v)} AS {field.replace('.', '_')}")
    ordinal = "regexp_extract(path, '([0-9]+)$', 1)::int"
    parent = r"nullif(regexp_replace(coalesce(path, ''), '\.?[0-9]+$', ''), '')"
    return f"{WALK} SELECT line_no, path, {parent} AS parent_path, {ordinal} AS ordinal, {scalar('v')} AS value, {', '.join(columns)} FROM entities WHERE entity = '{entity}' AND line_no IS NOT NULL"


ORACLES = {"p2_found": f"{WALK} SELECT line_no, entity AS child, path AS child_path FROM entities WHERE entity <> 'trajectory'", **{f"p2_{name}": flat(entity, fields) for name, (entity, fields) in TABLES.items()}}
