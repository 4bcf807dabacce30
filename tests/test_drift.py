import datetime
import json

from graphweft.operators import drift as D

T0 = datetime.datetime(2030, 1, 1)
SCHEMA = "stream_id int, file_no int, opened_at timestamp, line_no int, payload string, field string"


def files(spark, *streams):
    rows = []
    for s, contents in enumerate(streams, 1):
        for k, objects in enumerate(contents):
            rows += [(s, 100 - k, T0 + datetime.timedelta(hours=30 * k), i, o if isinstance(o, str) or o is None else json.dumps(o), "clash") for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return sorted(tuple(r) for r in D.schema_changes(df).collect())


def recs(start, n, **fields):
    return [{"pe": 0, "timestep": t} | {k: f(t) for k, f in fields.items()} for t in range(start, start + n)]


def test_changes_between_files(spark):
    x, y = (lambda t: t + 0.5), (lambda t: t * 3)
    a = recs(0, 10, edges=x, nspins=y, abort=lambda t: t * 1.25)
    b = recs(4, 10, edge_ms=lambda t: f"{t + 0.5:.3f} ms", nspins=lambda t: float(t * 3), hits=lambda t: t + 1000)
    b[0]["edge_ms"] = "n/a"
    c = recs(9, 10, edges=x, nspins=lambda t: None, hits=lambda t: {"ms": 1})
    got = changes(files(spark, [a + a[:2], b + [None, "broken {", "[1]"], c]))
    assert got == [
        (1, 98, "renamed", "edge_ms", "edges"), (1, 98, "type_changed", "edge_ms", "edges"), (1, 98, "type_changed", "hits", "hits"),
        (1, 99, "added", "", "hits"), (1, 99, "removed", "abort", ""), (1, 99, "renamed", "edges", "edge_ms"), (1, 99, "type_changed", "edges", "edge_ms"), (1, 99, "type_changed", "nspins", "nspins"),
    ]


def test_one_to_one_and_stray_agreement(spark):
    a = recs(0, 8, p=lambda t: t + 0.25, q=lambda t: t + 0.25)
    b = recs(2, 8, r=lambda t: t + 0.25)
    got = [x[2:] for x in changes(files(spark, [a, b]))]
    assert sorted(x[0] for x in got) == ["removed", "renamed"]
    assert changes(files(spark, [recs(0, 8, p=lambda t: t + 0.25), recs(7, 8, r=lambda t: t + 0.25)])) == [(1, 99, "added", "", "r"), (1, 99, "removed", "p", "")]


def test_consistent_table_follows_chains_of_names(spark):
    a, b, c = recs(0, 6, edges=float), recs(3, 6, edge_ms=float), recs(6, 6, links=lambda t: f"{t}.0", hits=int)
    a.append({"pe": 5, "timestep": 0})
    every = D.consistent_table(files(spark, [a, b, c])).collect()
    rows = {r["timestep"]: r for r in every if r["pe"] == 0}
    assert [(r["edges"], r["other"]) for r in every if r["pe"] == 5] == [(None, {})]
    assert len(rows) == 12 and all(rows[t]["edges"] == float(t) for t in range(12)) and rows[11]["hits"] == 11 and rows[0]["hits"] is None and all(r["other"] == {} for r in every)


def test_empty(spark):
    assert changes(files(spark)) == []
    assert D.consistent_table(files(spark)).count() == 0


def test_consistent_table_keeps_what_a_double_cannot(spark):
    values = {0: True, 1: [1.5, 2.5, 3.5], 2: {"ms": 4.5, "share": 0.25}, 3: "n/a", 4: "5.5 ms", 5: 6.5, 6: "7.5", 7: 2**53 + 1, 8: False, 9: None}
    a = [{"pe": 0, "timestep": t, "abort": v} for t, v in values.items()]
    b = [{"pe": 0, "timestep": 1, "abort": 9.5}, {"pe": 0, "timestep": 8, "abort": 8.5}]
    rows = {r["timestep"]: (r["abort"], r["other"].get("abort")) for r in D.consistent_table(files(spark, [a, b])).collect()}
    assert rows == {
        0: (1.0, "true"), 1: (9.5, "[1.5,2.5,3.5]"), 2: (4.5, '{"ms":4.5,"share":0.25}'), 3: (None, "n/a"), 4: (5.5, "5.5 ms"),
        5: (6.5, None), 6: (7.5, None), 7: (2.0**53, str(2**53 + 1)), 8: (8.5, "false"), 9: (None, None),
    }


def test_columns_have_the_types_of_their_fields(spark):
    a = [{"pe": 0, "timestep": t, "hits": t, "ok": t % 2 == 0, "note": f"n{t}", "odd `name`: a,b<c>": t + 0.5, "PE": t, "Note": 1.5, "other": 7, "seq": [1, {"y": t}]} for t in range(4)]
    a[2]["hits"] = 2.5
    df = D.consistent_table(files(spark, [a]))
    # of Note and note the first in order is the column
    assert dict(df.dtypes) == {"stream_id": "int", "pe": "bigint", "timestep": "bigint", "Note": "double", "hits": "bigint", "odd `name`: a,b<c>": "double", "ok": "boolean", "seq": "string", "other": "map<string,string>"}
    rows = {r["timestep"]: r for r in df.collect()}
    assert [rows[1][c] for c in ("hits", "ok", "odd `name`: a,b<c>", "Note", "seq")] == [1, False, 1.5, 1.5, '[1,{"y":1}]']
    assert rows[1]["other"] == {"PE": "1", "other": "7", "note": "n1"} and rows[2]["hits"] is None and rows[2]["other"]["hits"] == "2.5"


def test_layouts_are_read():
    nested = "OBJECT<m: VOID, n: OBJECT<o: DECIMAL(5,2)>>"
    layout = f"OBJECT<``: OBJECT<>, a: BIGINT, `b ``c``: d`: DOUBLE, e: ARRAY<OBJECT<x: STRING>>, f: {nested}, g: VOID, h: BOOLEAN, `i<j>`: ARRAY<VARIANT>>"
    assert D.read_layout(layout) == [("", "object", "OBJECT<>"), ("a", "integer", None), ("b `c`: d", "double", None), ("e", "array", None), ("f", "object", nested), ("g", None, None), ("h", "boolean", None), ("i<j>", "array", None)]
    assert D.read_layout("OBJECT<>") == []
