import json
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.operators.nested import KEYS, TABLES, decode, flatten_record, flatten_records, parse, table_of, tables_of
from inkwell.plans.data_queries import QUERIES

RECORD = {
    "wrap": [{"pages": [{"title": "T", "redirect": {"title": "R"}, "revision": {
        "sha1": " ab c\n", "text": {"sections": {"id": 1, "text": "one", "children": [{"id": 2, "notes": [{"id": 9, "label": "n"}]}, None, {"id": 3, "sections": []}]}}}},
        {"title": None, "revisions": [{"sha1": "d", "children": [[{"id": 4}], {"heading": "h"}]}, {"sha1": None, "sections": {"id": 5}}]}]}],
    "siteinfo": {"spaces": [{"key": 0}]},
}


def sections(rows):
    return sorted(((r[11], r[5], r[6]) for r in rows if r[1] == "section"), key=str)


def test_sections_of_every_layout():
    assert sections(flatten_record(1, json.dumps(RECORD))) == sorted([("abc", 1, 0), ("abc", 2, 1), ("abc", 3, 1), ("d", 4, 0), ("d", None, 0), (None, 5, 0)], key=str)


def test_encoded_again_and_damaged():
    text = json.dumps(RECORD)
    assert sections(flatten_record(1, json.dumps(json.dumps(text)))) == sections(flatten_record(1, text))
    for bad in (None, "", "null", "[]", "3", text[:-3], '"x', json.dumps("plain words")):
        assert list(flatten_record(1, bad)) == []
    assert decode("{") is None


def test_labels_are_unique_and_name_parents():
    rows = list(flatten_record(1, json.dumps(RECORD)))
    labels = [r[2] for r in rows]
    assert len(set(labels)) == len(labels)
    for r in rows:
        if r[4]:
            assert r[2].startswith(r[4] + ".") and r[4] in labels


def test_tables(spark):
    text = json.dumps(RECORD)
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "z"), (None, text, "q")], "record_id bigint, payload string, kind string")
    assert table_of(df, "page").where("record_id = 1").count() == 2
    assert {(r.title, r.redirect) for r in table_of(df, "page").collect()} == {("T", "R"), (None, None)}
    assert table_of(df, "note").where("record_id = 1").collect()[0].heading == "n"
    assert table_of(df, "section").where("record_id is null").count() == 6
    assert flatten_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [300, 50_000])
def test_very_deep(depth):
    text = '{"page": {"revision": {"sha1": "s", "sections": ' + "".join(f'{{"id": {i}, "sections": [' for i in range(depth)) + "]}" * depth + "}}}"
    rows = list(flatten_record(1, text, ["sha1", "id", "parent_id"], ("section",)))
    assert rows == [("s", i, max(0, i - 1)) for i in range(depth)]
    for _ in range(10 if depth < 1000 else 1):
        text = json.dumps(text)
    assert len(list(flatten_record(1, text, ["id"], ("section",)))) == depth
    assert decode(text[:-3]) is None


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(0, 30), st.sampled_from(["", ",", "}", "]", '"', "1", " "]))
def test_parser_agrees_with_json(value, cut, more):
    text = json.dumps(value, indent=cut % 3 or None)
    assert parse(text) == value
    damaged = text[:cut] + more + text[cut + 1 :]
    try:
        want = json.loads(damaged)
    except ValueError:
        with pytest.raises(ValueError):
            parse(damaged)
    else:
        assert repr(parse(damaged)) == repr(want)


def test_odd_numbers_and_texts():
    text = '{"page": {"title": "a\\ud800b", "revision": {"sha1": 7, "sections": [{"id": 1e400}, {"id": "\u00b2"}, {"id": " 12 "}, {"id": 3.0}, {"id": 99999999999999999999}, {"id": NaN}, {"id": true}]}}}'
    assert [r[0] for r in flatten_record(1, text, ["id"], ("section",))] == [None, None, 12, 3, None, None, None]
    assert [r[0] for r in flatten_record(1, text, ["title"], ("page",))] == ["a\ufffdb"]


def test_all_tables_from_one_reading(spark, data):
    records = spark.read.parquet(f"{data}/raw_record.parquet")
    for kind, rows in tables_of(records).items():
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, table_of(records, kind).collect()))
    assert set(tables_of(records)) == set(TABLES) and set(KEYS) <= set(rows.columns)


def walked(folder):
    """(record_id, key, object, objects around it from the top) by plain recursion, each record once."""
    found = []

    def walk(record_id, key, value, around):
        if isinstance(value, list):
            for x in value:
                walk(record_id, key, x, around)
        elif isinstance(value, dict):
            found.append((record_id, key, value, around))
            for k, v in value.items():
                walk(record_id, k, v, [*around, (key, value)])

    for record_id, value in {(r["record_id"], r["payload"]) for r in pq.read_table(f"{folder}/raw_record.parquet").to_pylist()}:
        try:
            while isinstance(value, str):
                value = json.loads(value)
        except ValueError:
            continue
        walk(record_id, None, value, [])
    return found


def test_revisions_and_notes_of_all_records(spark, data):
    objects = walked(data)
    revisions, notes = QUERIES["p5_revisions"](spark, data).collect(), QUERIES["p5_notes"](spark, data).collect()
    of = lambda *keys: [x for x in objects if x[1] in keys]
    want = Counter((r, "".join(v["sha1"].split()) if v.get("sha1") else v.get("sha1")) for r, _, v, _ in of("revision", "revisions"))
    assert Counter((r.record_id, r.sha1) for r in revisions) == want and want
    want = Counter((r, v.get("id"), v.get("label"), next(o["id"] for k, o in reversed(a) if k in ("sections", "children"))) for r, _, v, a in of("note", "notes"))
    assert Counter((r.record_id, r.id, r.heading, r.parent_id) for r in notes) == want and want


def test_parents_are_rows_of_the_tables(spark, data):
    tables = {kind: QUERIES[f"p5_{kind}s"](spark, data).collect() for kind in ("page", "revision", "section", "note")}
    keys = {(kind, r.record_id, r.label) for kind, rows in tables.items() for r in rows}
    assert all((r.parent_kind, r.record_id, r.parent_label) in keys for kind in ("revision", "section", "note") for r in tables[kind])
