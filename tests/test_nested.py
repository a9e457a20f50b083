import json
import math
import re

import pytest
from hypothesis import given, settings, strategies as st

from granary.operators.nested import Nesting, Repeated, child_table, flatten, flatten_records
from granary.plans.nested import OBJECTS


def elements(x):
    if isinstance(x, list):
        return list(enumerate(x, 1))
    if isinstance(x, dict) and x:
        return [(int(k), v) for k, v in x.items()] if all(re.fullmatch("[0-9]+", k) for k in x) else [(1, x)]
    return []


def brute(text):
    try:
        o = json.loads(text)
        while isinstance(o, str):
            o = json.loads(o)
    except ValueError:
        return set()
    while isinstance(o, dict) and ("objects" in o or "results" in o):
        o = o["objects"] if "objects" in o else o["results"]
    out = set()
    for a, x in elements(o):
        if isinstance(x, dict):
            out.add((a,))
            s = x.get("surface")
            for b, c in elements(s.get("components")) if isinstance(s, dict) else []:
                if isinstance(c, dict):
                    out.add((a, b))
                    out |= {(a, b, m) for m, k in elements(c.get("marks")) if isinstance(k, dict)}
    return out


def keys(text):
    return [tuple(r[1]) for r in flatten(text, OBJECTS)]


CASES = [
    None, "", "   ", "null", "[]", "{}", "[", '[{"a":1}', '[{"a":1}] x', '[{"a":1},]', "[1 2]", '{"a" 1}', '{"a":tru}', '["\x01"]', "[01]", "nan", "[NaN]",
    '[{"fruit":"apple"},null,{"x":NaN,"y":-Infinity}]', '{"fruit":"apple"}', '{"objects":[{"a":1}]}', '{"version":2,"results":{"objects":[{"a":1},{"b":2}]}}', '{"results":[{"a":1}]}', '{"objects":null}', '{"version":1,"objects":[]}',
    '{"1":{"a":1},"3":{"b":2},"4":null}', '[{"surface":{"components":{"2":{"marks":[{},null,{"kind":"x"}]},"5":{}}}}]', '[{"surface":{"components":{"area":3,"marks":{"kind":"y"}}}}]', '[{"surface":null},{"surface":{"components":null}},{"surface":{"components":{}}},[{"a":1}],5,"x"]',
    '[{"box":{"x1":1,"objects":[{"a":1}]},"surface":{"components":[[{"marks":[{}]}],{"bbox":[1,2],"marks":[[],{}]}]}}]', '{"objects":{"fruit":"a"}}', '{"objects":{"1":{"fruit":"a"}}}',
]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("wrap", [False, True])
def test_against_json_module(text, wrap):
    if text is not None and wrap:
        text = json.dumps(text)
    got = keys(text)
    assert len(got) == len(set(got)) and set(got) == (brute(text) if text else set())


leaf = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=True) | st.text(max_size=6)
mark = st.dictionaries(st.sampled_from(["kind", "z", "m"]), leaf, max_size=2) | st.none()
component = st.fixed_dictionaries({}, optional={"area": leaf, "bbox": st.lists(leaf, max_size=2), "marks": st.lists(mark, max_size=3) | st.none() | mark}) | st.none()
thing = st.fixed_dictionaries({"fruit": st.text(max_size=3)}, optional={"surface": st.fixed_dictionaries({}, optional={"status": leaf, "components": st.lists(component, max_size=3) | st.none()}) | st.none(), "box": st.dictionaries(st.text(max_size=2), leaf, max_size=2)}) | st.none()


@settings(max_examples=150, deadline=None)
@given(st.lists(thing, max_size=3), st.integers(0, 3), st.integers(0, 200))
def test_random_records_and_their_prefixes(x, form, cut):
    o = [x, {"objects": x}, {"v": 1, "results": {"objects": x}}, json.dumps(x)][form]
    text = json.dumps(o, indent=form or None)
    assert set(keys(text)) == brute(text)
    assert set(keys(text[:cut])) == brute(text[:cut])


def test_tables(spark):
    text = '[{"fruit":"a\\"b","n":null,"box":[1,2.5],"surface":{"status":"ok","components":[{"area":7,"bbox":{"x":1},"marks":[{"kind":"scar","z":NaN}]}]}}]'
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (None, "[{}]", "z")], "k long, fields string, level string")
    nest = Nesting((Repeated("object"), Repeated("component", ("surface", "components")), Repeated("mark", ("marks",))))
    flat = flatten_records(df, ["k"], "fields", nest)
    rows = {(r.k, r.level, r.object_no, r.component_no, r.mark_no): r.fields for r in flat.collect()}
    assert set(rows) == {(1, 0, 1, 0, 0), (1, 1, 1, 1, 0), (1, 2, 1, 1, 1), (None, 0, 1, 0, 0)}
    assert rows[1, 0, 1, 0, 0] == {"fruit": 'a"b', "n": None, "box.1": "1", "box.2": "2.5", "surface.status": "ok"}
    assert rows[1, 1, 1, 1, 0] == {"area": "7", "bbox.x": "1"}
    m = child_table(flat, nest, "mark", {"kind": ("kind", "string"), "z": ("z", "double"), "none": ("nope", "int")}).first()
    assert (m.k, m.object_no, m.component_no, m.mark_no, m.kind, m.none) == (1, 1, 1, 1, "scar", None) and math.isnan(m.z)
    assert flatten_records(df.limit(0), ["k"], "fields", nest).count() == 0


def test_inner_path_and_repeated_keys(spark):
    nest = Nesting((Repeated("item", ("data", "items")),))
    assert [r[1:3] for r in flatten('{"meta":{"items":[{}]},"data":{"n":1,"items":[{"a":1},{"b":{"c":[true]}}]}}', nest)] == [[(1,), ["a"]], [(2,), ["b.c.1"]]]
    df = spark.createDataFrame([('[{"a":1,"a":2}]',)], "t string")
    assert flatten_records(df, [], "t", Nesting((Repeated("o"),))).first().fields == {"a": "2"}


def test_all_tables_come_from_one_parse(spark):
    from granary.operators.nested import nested_tables
    from granary.plans.nested import COLUMNS

    text = '[{"object_id": 4, "box": {"x1": 1, "y1": 2.5}, "extra": {"deep": [7, null]}, "surface": {"status": "ok", "components": [{"area": 9, "bbox": [1, 2, 3, 4], "marks": {"kind": "spot", "z": NaN, "note": ""}}]}}, {"box": [5, 6, 7, 8]}]'
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "[", "z")], "result_id bigint, t string, level string")
    got = nested_tables(df, ["result_id"], "t", OBJECTS, COLUMNS)
    o = {r.object_no: r for r in got["object"].collect()}
    assert (o[1].object_id, o[1].box_x1, o[1].box_y1, o[1].box_x2, o[1].surface_status) == (4, 1.0, 2.5, None, "ok") and o[2].box_y2 == 8.0
    assert [(r.component_no, r.area, r.left, r.height) for r in got["component"].collect()] == [(1, 9, 1, 4)]
    (m,) = got["mark"].collect()
    assert m.kind == "spot" and math.isnan(m.z) and m.mark_no == 1
    assert {(r.object_no, r.path, r.value) for r in got["object_other"].collect()} == {(1, "extra.deep.1", "7"), (1, "extra.deep.2", None)}
    assert [(r.path, r.value) for r in got["mark_other"].collect()] == [("note", "")] and got["component_other"].count() == 0
