import json
import time

import pytest

from matchloom.operators.nested import UNREADABLE, entity_columns, entity_table, flatten_records
from matchloom.operators.nested import _Reader

UNITS = dict(key="tag", entities=["unit", "units", "cargo"], embedded=["payload"], inherit=["who"])


def flat(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, rec string")
    return flatten_records(df, "rec", ["i"], **options)


def held(value, out, parent=None):
    """Brute force: (parent, child) of all cargo."""
    for name in ("unit", "units", "cargo"):
        x = value.get(name)
        for u in x if isinstance(x, list) else [] if x is None else [x]:
            tag = u.get("tag") if isinstance(u, dict) else u
            if name == "cargo":
                out.append((str(parent), str(tag)))
            if isinstance(u, dict):
                held(u, out, tag)
    return out


def test_units_at_any_depth(spark):
    deep = {"tag": 1}
    for i in range(2, 60):
        deep = {"tag": i, "cargo": [deep, i * 1000]}
    events = [
        {"who": 1, "unit": deep},
        {"who": "2", "units": [{"tag": 7, "cargo": {"tag": 8}}, {"tag": 9, "cargo": None}, {"tag": 10, "cargo": []}, {"tag": 11, "pos": {"x": 3, "y": None}}]},
        {"units": [{"tag": 5, "cargo": [6, {"tag": 7, "cargo": [8]}]}], "killer": {"unit": {"tag": 99}}},
        {},
    ]
    texts = [json.dumps(e) for e in events] + [json.dumps({"payload": json.dumps(events[1])}), json.dumps({"payload": "{cut"}), None, "", "{cut", "[", "NaN", '{"a": NaN}', "3", "null"]
    rows = flat(spark, texts, **UNITS).collect()
    got = sorted((r["i"], r["parent_key"], r["key"]) for r in rows if r["entity"] == "cargo" and r["parent_entity"] in ("unit", "units", "cargo"))
    want = sorted((i, *p) for i, e in [*enumerate(events), (4, events[1])] for p in held(e, []))
    assert got == want
    eleven = next(r for r in rows if r["key"] == "11" and r["i"] == 1)
    assert eleven["fields"] == {"tag": "11", "pos.x": "3", "pos.y": None} and eleven["root"] == {"who": "2"}
    assert {r["i"] for r in rows if r["node"] == 0} == {0, 1, 2, 3, 4, 5, 12, 13}


def test_map_entries_and_lists(spark):
    a = {"1-S2-1-5": {"nickname": "x", "color": {"a": 1}}, "2-S2-1-6": {"nickname": None}}
    b = [{"toon": "1-S2-1-5", "playerID": 1}]
    c = {"players": [{"toon": "1-S2-1-5", "profile": {"playerID": "2"}}]}
    rows = flat(spark, [json.dumps(x) for x in (a, b, c)], key="toon", entry=r"^\d+-S\d+-\d+-\d+$").where("node > 0").collect()
    assert sorted((r["i"], r["key"]) for r in rows) == [(0, "1-S2-1-5"), (0, "2-S2-1-6"), (1, "1-S2-1-5"), (2, "1-S2-1-5")]
    assert next(r for r in rows if r["i"] == 2)["fields"]["profile.playerID"] == "2"


def test_clash_empty_and_long(spark):
    df = spark.createDataFrame([(1, "{}")], "node int, rec string")
    with pytest.raises(ValueError):
        flatten_records(df, "rec", ["node"], "k")
    assert flat(spark, ["{}"], key="k").limit(0).count() == 0
    long = json.dumps({"unit": {"tag": 1, "cargo": list(range(20_000))}})
    assert flat(spark, [long], **UNITS).where("entity = 'cargo'").count() == 20_000


def test_very_deep_records(spark):
    """20,000 levels of units, and of plain objects, in a moment and in full."""
    n = 20_000
    units = '{"unit":' + '{"tag":1,"cargo":[' * n + "]}" * n + "}"
    plain = '{"x":1,"a":' * n + "2" + "}" * n
    start = time.perf_counter()
    reader = _Reader(frozenset(UNITS["entities"]), frozenset(), None)
    assert len(reader.read(units)) == n + 1
    nodes = reader.read(plain)
    assert sum(len(x.fields) for x in nodes) == n + 1
    assert time.perf_counter() - start < 10  # about a second; the machine may be busy
    assert flat(spark, [units], **UNITS).where("entity = 'cargo'").count() == n - 1


def test_unreadable_texts_are_reported(spark):
    texts = ["{", "NaN", '{"a":1,}', '{"a" 1}', "", "1 2", '"\u0001"', "01", '{"a":"\\ud800"}', '{"ok":1}']
    rows = flat(spark, texts, key="k", unreadable=True).collect()
    assert {r["i"] for r in rows if r["entity"] == UNREADABLE} == set(range(8)) and all(r["fields"]["reason"] for r in rows if r["entity"] == UNREADABLE)
    assert {r["i"] for r in rows if r["entity"] == ""} == {8, 9}


def test_typed_tables(spark):
    a = {"unit": {"tag": 1, "pos": {"x": 3}, "hp": 2.5, "up": True, "name": None}}
    b = {"unit": {"tag": "q", "pos": {"x": 4}, "hp": 7, "up": False, "cargo": [{"tag": 5}]}}
    nodes = flat(spark, [json.dumps(a), json.dumps(b)], **UNITS)
    types = {(r["entity"], r["field"]): r["type"] for r in entity_columns(nodes).collect()}
    assert types == {("unit", "tag"): "string", ("unit", "pos.x"): "bigint", ("unit", "hp"): "double", ("unit", "up"): "boolean", ("unit", "name"): "string", ("cargo", "tag"): "bigint"}
    t = entity_table(nodes, "unit", {f: k for (e, f), k in types.items() if e == "unit"}, ["i"])
    assert [(r["tag"], r["pos_x"], r["hp"], r["up"], r["name"]) for r in t.orderBy("i").collect()] == [("1", 3, 2.5, True, None), ("q", 4, 7.0, False, None)]
    assert [tuple(r) for r in entity_table(nodes, "cargo", {"tag": "bigint"}).select("parent", "parent_entity", "parent_key", "tag").collect()] == [(1, "unit", "q", 5)]
