from hypothesis import given, settings
from hypothesis import strategies as st

from graphweft.sources import trace_parser as P
from graphweft.sources import traces


def reason(kind, line):
    got = P.parse_line(kind, line)
    return got.reason if isinstance(got, P.TraceSyntaxError) else None


def test_valid_lines():
    got = P.parse_line("vertex", '  007 ," 3 ",12,2,0, -1.5e3 ,1,"nan"')
    assert (got.step, got.owner, got.vec_id, got.vec[0]) == (7, 3, 12, -1500.0) and got.vec[1] != got.vec[1]
    assert P.parse_line("vertex", "1,2,3,1,0,.25").vec == [0.25] and P.parse_line("vertex", "1,2,3,1,0,4.").vec == [4.0]
    assert P.parse_line("vertex", "1,2,3,0").vec == [] and P.parse_line("edge", "1,2,3").edges == []
    assert P.parse_line("edge", '1,2,3,"BIDIRECTIONAL:4:5",IN:0:4294967295').edges == [("BIDIRECTIONAL", 4, 5), ("IN", 0, 4294967295)]


def test_reasons():
    for kind, line, want in [
        ("vertex", '1,2,3,1,0,"4.5', "quoting"), ("vertex", '1,2,3,1,0,"4.5"x', "quoting"), ("vertex", '1,2,3,1,0,4"5', "quoting"), ("edge", '"1"",2,3', "quoting"),
        ("vertex", "1,2,3", "columns"), ("vertex", "1,2,3,1,0", "columns"), ("vertex", "1,2,3,2,0,1.0", "columns"), ("edge", "1,2", "columns"), ("vertex", "", "columns"), ("edge", None, "columns"),
        ("vertex", "1,2,3,x,0,1.0", "value"), ("vertex", "1,2,3,1,1,1.0", "value"), ("vertex", "1,2,3,1,0,NaN", "value"), ("vertex", "1,2,3,1,0,1e", "value"), ("vertex", "2147483648,2,3,0", "value"),
        ("vertex", "1,1073741824,3,0", "value"), ("vertex", "1,2,2305843009213693952,0", "value"), ("vertex", "1,2,３,0", "value"), ("edge", "1,2,3,in:4:5", "value"), ("edge", "1,2,3,IN:4:4294967296", "value"), ("edge", "1,2,3,", "value"),
        ("vertex", '1,2,"3""",0', "value"), (None, "1,2,3", "kind"),
    ]:
        assert reason(kind, line) == want, (kind, line)


def by_hand(line):
    """The fields of a line by a plain state machine, or None if its quoting is broken."""
    out, field, state = [], "", "start"
    for ch in line + ",":
        if state in ("start", "bare") and ch == ",":
            out.append(field.strip(" \t"))
            field, state = "", "start"
        elif state == "start" and ch in " \t":
            continue
        elif state == "start" and ch == '"':
            state = "quoted"
        elif state in ("start", "bare"):
            if ch == '"':
                return None
            field, state = field + ch, "bare"
        elif state == "quoted":
            if ch == '"':
                state = "maybe"
            else:
                field += ch
        elif state in ("maybe", "after"):
            if ch == '"' and state == "maybe":
                field, state = field + '"', "quoted"
            elif ch == ",":
                out.append(field.strip(" \t"))
                field, state = "", "start"
            elif ch in " \t":
                state = "after"
            else:
                return None
    return out if state == "start" else None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='1a", \t', max_size=14))
def test_fields_against_a_state_machine(line):
    p = P.Parser(line)
    try:
        p.split()
        got = [f for f, _ in p.fields]
    except P.TraceSyntaxError as e:
        assert e.reason == "quoting"
        got = None
    assert got == by_hand(line)


def test_recovery_in_raw_text():
    text = '1,2,3,1,0,1.0\n1,2,"3,1,0,1.0\nnot a record\n4,5,6,0\n7,8,9,0\n1,2,"a\nb\nc",0\n\n" 1 ",2,3,0\r\n1,"2'
    got = [(at, lines, getattr(r, "reason", "")) for at, lines, r in P.parse_text("vertex", text)]
    at = text.index
    # a broken quote, a line behind it, a quoted field over three lines, an empty line, a broken quote at the end
    assert got == [(0, 1, ""), (14, 1, "quoting"), (at("not"), 1, "columns"), (at("4,5"), 1, ""), (at("7,8"), 1, ""), (at('1,2,"a'), 3, "value"), (at("\n\n") + 1, 1, "columns"), (at('" 1'), 1, ""), (at('1,"2'), 1, "quoting")]
    assert list(P.parse_text("edge", "")) == [] and [n for _, n, _ in P.parse_text("edge", "\n\n")] == [1, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['1,2,3,0', '1,2,3,1,0,"4', 'junk,line', '"', 'x"y', '1,2,"3",0', '4"', '', '5,6,7,1,0,"a ""b', '",0', '"1","2","3",0']), max_size=9))
def test_no_line_of_raw_text_is_lost(lines):
    text = "\n".join([*lines, "1,2,3,0"])
    got = list(P.parse_text("vertex", text))
    assert sum(n for _, n, _ in got) == len(lines) + 1
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    found = {starts.index(at): (n, r) for at, n, r in got}
    for i, x in enumerate([*lines, "1,2,3,0"]):
        alone = P.parse_line("vertex", x)
        if isinstance(alone, P.TraceRecord):  # a broken quote swallows no valid record
            assert found[i] == (1, alone)
        elif i in found and found[i][0] == 1:
            assert found[i][1].reason == alone.reason


def test_rows_are_anchors():
    kinds, lines = ["vertex", "edge", "vertex", None, "edge"], ['1,2,3,1,0,"4', '"1",2,3,IN:4:5', None, "1", '1,2,"3']
    got = list(P.parse_rows(kinds, lines))
    assert [getattr(r, "reason", r) for r in got] == [getattr(r, "reason", r) for r in map(P.parse_line, kinds, lines)] == ["quoting", got[1], "columns", "kind", "quoting"]


def test_texts_of_files(spark):
    rows = [(1, 1, "vertex", "1,2,3,0"), (1, 2, "vertex", '1,"2'), (1, 3, "vertex", "junk"), (1, 3, "vertex", "junk"), (1, 700, "vertex", "4,5,6,0"), (2, 1, "edge", "1,2,3,IN:1:2")]
    texts = traces.joined_lines(spark.createDataFrame(rows, "file_id int, line_no int, kind string, line string"))
    got = {(r["file_id"], r["line_no"]): r["reason"] for r in P.parse_texts(texts).collect()}
    assert got == {(1, 1): None, (1, 2): "quoting", (1, 3): "columns", (1, 700): None, (2, 1): None}
    odd = spark.createDataFrame([(1, 1, None, "a\nb"), (2, 1, "edge", None), (3, 5, "edge", "")], "file_id int, line_no int, kind string, text string")
    assert [(r["line_no"], r["reason"]) for r in P.parse_texts(odd).collect()] == [(1, "kind"), (2, "kind")]


def test_table(spark):
    rows = [(1, 1, "vertex", "1,2,3,1,0,1.0", "x"), (1, 2, "vertex", "bad", "x"), (1, 2, "vertex", "bad", "x"), (1, 3, "edge", "1,2,3,BI:1:2", "x"), (1, 4, None, None, None)]
    parsed = P.parse_trace_lines(spark.createDataFrame(rows, "file_id int, line_no int, kind string, line string, reason string"))
    assert sorted((r["line_no"], r["reason"]) for r in P.failures(parsed).collect()) == [(2, "columns"), (4, "kind")]
    assert P.vertices(parsed).first()["vec"] == [1.0] and P.edges(parsed).first()["edges"][0]["offset"] == 2
    assert P.parse_trace_lines(parsed.select("file_id", "line_no", "kind").withColumn("line", parsed["kind"]).limit(0)).count() == 0
