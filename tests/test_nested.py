import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from paperloom.operators import nested

NAMES = {"fields": "fields", "tables": "tables", "rows": "table_rows", "mismatches": "mismatches", "component_fields": "component_fields"}
A = {"id": "x", "fields": {"a": {"v": "1", "p": 1}, "b": {"v": "2"}}, "tables": [{"n": "t", "rows": [{"l": "q"}, None, {"l": "r"}]}, None, {"n": "u", "rows": []}], "mismatches": {"f": "a", "component_fields": ["a", "b"]}}
B = {"result": {"id": "y", "fields": [{"name": "a", "v": "3", "p": 2}, None, {"name": "c", "v": "4"}], "tables": json.dumps([{"n": "t", "rows": [{"l": "s"}]}]), "mismatches": [{"f": "z", "component_fields": None}, {"f": "w", "detail": {"deep": 5}}]}}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "rid long, js string, CHILD string")


def test_records_and_parents(spark):
    got = nested.shred(frame(spark, [json.dumps(A), "```json\n" + json.dumps(B) + "\n```", None, "", "no json", "﻿" + json.dumps(A)]), "rid", "js")
    keys = {(r.doc_key, r.child, r.parent_key, r.child_key) for r in nested.child_keys(got, NAMES).collect()}
    of = lambda i: {k[1:] for k in keys if k[0] == i}
    assert of(0) == {
        ("fields", "", "a"), ("fields", "", "b"), ("tables", "", "0"), ("tables", "", "2"), ("table_rows", "0", "0"), ("table_rows", "0", "2"), ("mismatches", "", "0"), ("component_fields", "0", "0"), ("component_fields", "0", "1"),
    }
    assert of(1) == {("fields", "", "a"), ("fields", "", "c"), ("tables", "", "0"), ("table_rows", "0", "0"), ("mismatches", "", "0"), ("mismatches", "", "1")}
    assert of(5) == of(0) and not of(2) and not of(3)
    assert [r.doc_key for r in got.records.where("child = '_rejected'").collect()] == [4]


def test_columns_and_foreign_keys(spark):
    got = nested.shred(frame(spark, [json.dumps(A), json.dumps(B)]), "rid", "js")
    fields = {(r.doc_key, r.child_key): r for r in got.table("fields").collect()}
    assert fields[0, "a"].v == "1" and fields[0, "a"].p == 1 and fields[1, "a"].p == 2
    flags = {(r.doc_key, r.child_key): r for r in got.table("mismatches").collect()}
    assert flags[1, "1"].detail_deep == 5  # a singleton descendant is inlined
    rows, tables = got.table("rows"), got.table("tables").selectExpr("doc_key", "row AS parent_row")
    assert rows.join(tables, ["doc_key", "parent_row"]).count() == rows.count() == 3


def test_recursive_shared_and_clashing(spark):
    doc = {"node": {"row": "own", "kids": [{"row": "k", "kids": [{"row": "kk"}]}]}, "extra": 1}
    got = nested.shred(frame(spark, [json.dumps(doc)]), "rid", "js")
    assert "kids" in got.layout.tables
    kids = got.table("kids")
    assert sorted(r.kids_row for r in kids.collect()) == ["k", "kk"] and kids.where("parent = 'kids'").count() == 1


def test_empty(spark):
    got = nested.shred(frame(spark, ["x"]).limit(0), "rid", "js")
    assert got.records.count() == 0 and got.table("fields").count() == 0


scalars = st.one_of(st.none(), st.integers(-5, 5), st.text("ab{[ ", max_size=4), st.booleans())
docs = st.recursive(scalars, lambda s: st.one_of(st.lists(s, max_size=3), st.dictionaries(st.sampled_from("abcdef"), s, max_size=4)), max_leaves=20)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from("abcdef"), docs, max_size=4), min_size=1, max_size=6))
def test_any_shape_keeps_its_leaves(objs):
    edges = nested._Edges()
    for o in objs:
        edges.record(nested.ROOT, o, "object")
    layout = nested.analyse([(*k, *v) for k, v in edges.n.items()])

    def leaves(v):
        v = nested._opened(v)
        if isinstance(v, dict):
            return sum(map(leaves, v.values()))
        if isinstance(v, list):
            return sum(map(leaves, v))
        return v is not None

    for o in objs:
        w = nested._Walker(layout)
        w.record(nested.ROOT, (None, None, ""), nested.ROOT, "", o)
        rows = set(w.row)
        assert len(rows) == len(w.row) == len(w.starts)
        assert all(up is None or up in rows for up in w.up_row)
        only = nested._Walker(layout, frozenset(w.table))
        only.record(nested.ROOT, (None, None, ""), nested.ROOT, "", o)
        assert (only.table, only.up_key, only.key) == (w.table, w.up_key, w.key)


def test_deep_text_is_rejected_not_lost(spark):
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    got = nested.shred(frame(spark, [deep, json.dumps(A)]), "rid", "js")
    assert {r.doc_key for r in got.records.where("child = '_rejected'").select("doc_key").collect()} <= {0}


def test_key_attribute_despite_a_dirty_entry():
    edges = [(nested.ROOT, "fields", "keyed", 5, 1), (nested.ROOT, "fields", "list", 3, 1), ("fields", "", "entry:list", 20, 1), ("fields", "", "entry:keyed", 9, 1)]
    edges += [("fields", "name", "str:list", 19, 1), ("fields", "name", "null:list", 1, 1), ("fields", "value", "str:list", 20, 1), ("fields", "value", "str:keyed", 9, 1), ("fields", "a_note", "str:list", 18, 1)]
    assert nested.analyse(edges).key_attribute == {"fields": "name"}


def test_no_value_is_lost_to_another(spark, tmp_path):
    doc = {"kids": [{"a_b": 1, "a": {"b": 2, "c/d": 3}, "a/b": 4, "a_c/d": 5}, {"big": 2**70}, {"big": 7}]}
    got = nested.shred(frame(spark, [json.dumps(doc), json.dumps(doc)]).selectExpr("cast(null as long) AS rid", "js"), "rid", "js")
    for shredded in (got, got.store(str(tmp_path / "tables"))):
        kids = shredded.table("kids").collect()
        assert len(kids) == 6 and len({(r.doc_row, r.row) for r in kids}) == 6
        values = sorted(v for k, v in kids[0].asDict().items() if k not in ("doc_key", "doc_row") and isinstance(v, int))
        assert values == [1, 2, 3, 4, 5] and {r.big for r in kids} == {None, str(2**70), "7"}
        root = shredded.table("$").selectExpr("doc_row", "row AS parent_row")
        assert shredded.table("kids").join(root, ["doc_row", "parent_row"]).count() == 6
        assert nested.child_keys(shredded, {"kids": "k"}).count() == 6
