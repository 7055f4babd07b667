"""Flattening of nested documents: links, labels and odd spellings."""

import json

from declarium.operators import nested

SCHEMA = "index_id bigint, project string, index_json string, loaded_at timestamp_ntz, rel string"


def deep(levels):
    group = {"path": f"g{levels}", "name": "x"}
    for i in reversed(range(levels)):
        group = {"path": f"g{i}", "children": [group, None]}
    return group


def test_links(spark):
    doc = {
        "items": [{"ordinal": "7 ", "signature": {"params": [{"name": "a"}, None, {"name": "c"}]}}, None, {"ordinal": 8, "signature": {"params": {"name": "only"}}}, {"ordinal": 9}],
        "groups": {"path": "a", "op_arrays": {"sig:->x": [1, "2", None], "sig:->y": 3}, "children": [{"path": "a.b", "children": {"name": "c", "op_arrays": None}}, None]},
        "pipelines": {"one": {"stages": [7], "edges": {"after": 7, "from_key": "k", "to_key": None}}, "two": {"edges": [None, {"to_key": "z"}]}},
    }
    rows = [(1, "p", json.dumps(doc), None, "clash"), (1, "p", json.dumps(doc), None, "clash"), (2, "p", json.dumps(doc)[:-9], None, ""), (3, None, None, None, ""), (4, "p", "[1]", None, ""), (5, "p", '{"items": NaN}', None, ""), (None, "p", "{}", None, ""), (6, "p", "{}", None, "")]
    found = {tuple(r) for r in nested.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, *x) for x in [
        ("param", "7", "0"), ("param", "7", "2"), ("param", "8", "0"), ("group", "", "a"), ("group", "a", "a.b"), ("group", "a.b", "a.b.c"),
        ("op_array", "a", "sig:->x|1"), ("op_array", "a", "sig:->x|2"), ("op_array", "a", "sig:->y|3"), ("edge", "one", "7|k|"), ("edge", "two", "||z"),
    ]}


def test_labels_hold_the_tree(spark):
    docs = spark.createDataFrame([(1, "p", json.dumps({"groups": [deep(40), deep(3)]}), None, "")], SCHEMA)
    rows = nested.nodes(docs).where("type = 'group'").collect()
    for a in rows:
        for b in rows:
            if a.pre < b.pre:
                assert b.post <= a.post or b.pre > a.post
    found = {(r.parent_key, r.child_key) for r in nested.found(docs).collect()}
    assert {("", "g0"), ("g38", "g39"), ("g39", "g40")} <= found
    assert set(nested.tables(docs)) == set(nested.NODE_TYPES)


def test_empty(spark):
    assert nested.found(spark.createDataFrame([], SCHEMA)).collect() == []
