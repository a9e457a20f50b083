"""Problem 4: object results as flat tables of objects, components and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.operators.nested import Nesting, Repeated, child_table, flatten_records, nested_tables
from granary.session import table

OBJECTS = Nesting((Repeated("object"), Repeated("component", ("surface", "components")), Repeated("mark", ("marks",))), ("objects", "results"))
_CORNERS = ("x1", "y1", "x2", "y2")
COLUMNS: dict[str, dict] = {
    "object": {
        "object_id": ("object_id", "bigint"), "fruit": ("fruit", "string"), "detection_confidence": ("detection_confidence", "double"),
        **{f"box_{c}": ((f"box.{i}", f"box.{c}"), "double") for i, c in enumerate(_CORNERS, 1)},
        "predicted_stage": ("predicted_stage", "string"), "score_unripe": ("score_unripe", "double"),
        "score_ripe": ("score_ripe", "double"), "score_overripe": ("score_overripe", "double"),
        "processing_ms": ("processing_ms", "double"), "surface_status": ("surface.status", "string"),
    },
    "component": {"area": ("area", "bigint"), **{c: (f"bbox.{i}", "bigint") for i, c in enumerate(("left", "top", "width", "height"), 1)}},
    "mark": {"kind": ("kind", "string"), "z": ("z", "double")},
}
NUMBERS = ["object_no", "component_no", "mark_no"]


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_rows").where("result_id is not null").select("result_id", "object_results_json")


def flat_results(spark: SparkSession, sf: str) -> DataFrame:
    """The triples of all results, grouped by the element they stand in."""
    return flatten_records(_results(spark, sf), ["result_id"], "object_results_json", OBJECTS)


def result_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All three tables, and what their columns leave out, from one parse."""
    return nested_tables(_results(spark, sf), ["result_id"], "object_results_json", OBJECTS, COLUMNS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each object, component and mark, by its number and those of its parents."""
    return flat_results(spark, sf).select("result_id", *NUMBERS).distinct()


def _one(spark: SparkSession, sf: str, name: str, depth: int) -> DataFrame:
    return child_table(flat_results(spark, sf), OBJECTS, name, COLUMNS[name]).dropDuplicates(["result_id", *NUMBERS[:depth]])


def p4_objects(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, sf, "object", 1)


def p4_components(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, sf, "component", 2)


def p4_marks(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, sf, "mark", 3)


QUERIES = {"p4_found": p4_found, "p4_objects": p4_objects, "p4_components": p4_components, "p4_marks": p4_marks}


def _elements(source: str, keys: str) -> str:
    """SQL of the object elements ``x`` of a list ``j`` with their number: of an array, a bare element, or an object keyed by
    numbers."""
    numbered = "regexp_full_match(json_keys(j)[1], '[0-9]+')"
    named = "json_extract(j, '$.\"' || k || '\"')"
    return f"""SELECT {keys}, no, x FROM (
      SELECT {keys}, generate_subscripts(json_extract(j, '$[*]'), 1)::BIGINT AS no, unnest(json_extract(j, '$[*]')) AS x FROM {source} WHERE json_type(j) = 'ARRAY'
      UNION ALL SELECT {keys}, 1, j FROM {source} WHERE json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0 AND NOT {numbered}
      UNION ALL SELECT {keys}, k::BIGINT, {named} FROM (SELECT {keys}, j, unnest(json_keys(j)) AS k FROM {source} WHERE json_type(j) = 'OBJECT' AND {numbered}) WHERE regexp_full_match(k, '[0-9]+')
    ) WHERE json_type(x) = 'OBJECT'"""


_JSON = f"""WITH RECURSIVE
u AS (SELECT DISTINCT result_id, object_results_json AS t FROM result_rows WHERE result_id IS NOT NULL
  UNION ALL SELECT result_id, json_extract_string(t, '$') FROM u WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'VARCHAR' END),
w AS (SELECT result_id, t::JSON AS j FROM u WHERE CASE WHEN json_valid(t) THEN json_type(t) IN ('ARRAY', 'OBJECT') END
  UNION ALL SELECT result_id, coalesce(json_extract(j, '$.objects'), json_extract(j, '$.results')) FROM w WHERE json_type(j) = 'OBJECT' AND len(list_intersect(json_keys(j), ['objects', 'results'])) > 0),
o AS (SELECT result_id, no AS object_no, x FROM ({_elements("(SELECT * FROM w WHERE json_type(j) <> 'OBJECT' OR len(list_intersect(json_keys(j), ['objects', 'results'])) = 0)", 'result_id')})),
oc AS (SELECT result_id, object_no, json_extract(x, '$.surface.components') AS j FROM o),
c AS (SELECT result_id, object_no, no AS component_no, x FROM ({_elements('oc', 'result_id, object_no')})),
cm AS (SELECT result_id, object_no, component_no, json_extract(x, '$.marks') AS j FROM c),
m AS (SELECT result_id, object_no, component_no, no AS mark_no, x FROM ({_elements('cm', 'result_id, object_no, component_no')}))
"""


def _table_sql(source: str, keys: str, name: str) -> str:
    """SQL of one table; a field is a scalar or null."""
    def one(path: str, kind: str) -> str:
        steps = "".join(f"[{int(x) - 1}]" if x.isdigit() else f".{x}" for x in path.split("."))
        text = f"CASE WHEN json_type(x, '${steps}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(x, '${steps}') END"
        return f"try_cast({text} AS {'varchar' if kind == 'string' else kind})"

    parts = [f"coalesce({', '.join(one(p, kind) for p in ([paths] if isinstance(paths, str) else paths))}) AS \"{c}\"" for c, (paths, kind) in COLUMNS[name].items()]
    return f"{_JSON} SELECT DISTINCT {keys}, {', '.join(parts)} FROM {source}"


SQL: dict[str, str] = {
    "p4_found": _JSON + "SELECT DISTINCT * FROM (SELECT result_id, object_no, 0::BIGINT AS component_no, 0::BIGINT AS mark_no FROM o UNION ALL SELECT result_id, object_no, component_no, 0 FROM c UNION ALL SELECT result_id, object_no, component_no, mark_no FROM m)",
    "p4_objects": _table_sql("o", "result_id, object_no", "object"),
    "p4_components": _table_sql("c", "result_id, object_no, component_no", "component"),
    "p4_marks": _table_sql("m", "result_id, object_no, component_no, mark_no", "mark"),
}
