"""Functions of the engine as temporary SQL functions: SQL bodies only, so they stay inside the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from oreloom.functions.text import ID_GROUPS, ID_REMOVABLE, ID_SYNONYMS


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(mapping: dict[str, str | None]) -> str:
    return f"map({', '.join(f'{_text(k)}, {_text(v)}' for k, v in mapping.items())})"


def _list(values: object) -> str:
    return ", ".join(map(_text, values))


def _create(spark: SparkSession, name: str, body: str, kind: str = "STRING") -> str:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(raw STRING) RETURNS {kind} RETURN {body}")
    return name


def register_stage(spark: SparkSession, name: str, mapping: dict[str, str | None], noise: list[str]) -> str:
    """A stage mapping under a name: the entry of the id, else of the id without noise words, else of its last known word."""
    plain, table = "lower(trim(raw))", _map(mapping)
    words = f"filter(split({plain}, '_'), w -> w NOT IN ({_list(noise)}))"
    last = f"get(filter(reverse({words}), w -> map_contains_key({table}, w)), 0)"
    joined = f"array_join({words}, '_')"
    key = f"CASE WHEN map_contains_key({table}, {plain}) THEN {plain} WHEN map_contains_key({table}, {joined}) THEN {joined} ELSE {last} END"
    return _create(spark, name, f"try_element_at({table}, {key})")


def register_functions(spark: SparkSession) -> list[str]:
    """normalize_id, first_number, parse_number, content_id, table_number: their names. They last as long as the session."""
    lowered = "regexp_replace(regexp_replace(regexp_replace(lower(raw), '_unit$', ''), '_\\\\d+$', ''), '_[a-b]$', '')"
    words = f"filter(split({lowered}, '_'), t -> t NOT IN ({_list(ID_REMOVABLE)}))"
    synonyms = _map(ID_SYNONYMS)
    mapped = f"filter(transform({words}, t -> CASE WHEN map_contains_key({synonyms}, t) THEN try_element_at({synonyms}, t) ELSE t END), t -> t IS NOT NULL)"
    group = f"get(filter(array({_list(ID_GROUPS)}), g -> array_contains({mapped}, g)), 0)"
    ids = f"CASE WHEN size({words}) = 0 THEN {lowered} WHEN size({mapped}) = 0 THEN array_join({words}, '_') ELSE coalesce({group}, array_join({mapped}, '_')) END"
    return [
        _create(spark, "normalize_id", ids),
        _create(spark, "first_number", "try_cast(nullif(regexp_extract(raw, '(\\\\d+\\\\.?\\\\d*)', 1), '') AS DOUBLE)", "DOUBLE"),
        _create(spark, "parse_number", "try_cast(translate(trim(raw), ',%$', '') AS DOUBLE)", "DOUBLE"),
        _create(spark, "content_id", "sha2(CAST(raw AS BINARY), 256)"),
        _create(spark, "table_number", "nullif(regexp_extract(raw, '(?i)(?:table|tabla|tableau)\\\\s+(\\\\d+[-.]\\\\d+)', 1), '')"),
    ]
