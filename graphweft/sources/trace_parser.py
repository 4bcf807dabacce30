"""Trace lines to typed records, with the lines that can't be read set apart and located.

A recursive-descent parser over the grammar

    record  = field *( "," field )
    field   = blanks ( quoted / bare ) blanks
    quoted  = DQUOTE *( any but DQUOTE / DQUOTE DQUOTE ) DQUOTE
    bare    = *( any but "," and DQUOTE )
    vertex  = step owner id n *( slot value )          edge = step owner id *( DIR ":" pe ":" offset )

An error ends the record at hand only: the parser notes where and why, and resumes at the next anchor, so that a broken quote
can't swallow the records behind it. Anchors are validated starts of records. Of a batch of table rows, which the parser reads
as one text, each row's start is one, as the table vouches for it. In raw text (:func:`parse_text`) it is a line start behind
which the grammar reads the head of a record, three valid whole numbers for step, owner and id; lines that the parser skips
on its way to an anchor are errors of their own, so no line is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.session import spread

#: Fixed limits of the format: whole numbers are below these.
STEP_LIMIT, OWNER_LIMIT, ID_LIMIT, OFFSET_LIMIT = 2**31, 2**30, 2**61, 2**32
DIRECTIONS = frozenset(("IN", "OUT", "BI", "BIDIRECTIONAL"))
BLANKS = " \t"
UNENDED = "a quoted field doesn't end"

_WHOLE = re.compile(r"[0-9]+\Z")
_VALUE = re.compile(r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|nan|inf)\Z")
_BARE = {False: re.compile(r'[^,"]*'), True: re.compile(r'[^,"\n]*')}
_IN_QUOTES = re.compile(r'[^"]*')


class TraceSyntaxError(Exception):
    """Why (``quoting``, ``columns``, ``value`` or ``kind``) and where (0-based position in the line) a record fails."""

    def __init__(self, reason: str, at: int, detail: str):
        super().__init__(f"{reason} at {at}: {detail}")
        self.reason, self.at, self.detail = reason, at, detail


@dataclass
class TraceRecord:
    step: int
    owner: int
    vec_id: int
    vec: list[float] | None = None
    edges: list[tuple[str, int, int]] | None = None


@dataclass
class Parser:
    """Parses the record at ``begin`` of ``text``, which ends before ``stop``, or before the first line end outside quotes if
    ``by_line``; ``fields`` keeps (text, position in the record) of each field as read, ``at`` is where reading stands."""

    text: str
    begin: int = 0
    stop: int = -1
    by_line: bool = False
    fields: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self):
        self.at = self.begin
        if self.stop < 0:
            self.stop = len(self.text)

    def record(self, kind: str | None) -> TraceRecord:
        self.split()
        if kind == "vertex":
            return self.vertex()
        if kind == "edge":
            return self.edge()
        raise TraceSyntaxError("kind", 0, f"no such kind of record: {kind}")

    def error(self, at: int, detail: str) -> TraceSyntaxError:
        return TraceSyntaxError("quoting", at - self.begin, detail)

    def next_is(self, mark: str) -> bool:
        return self.at < self.stop and self.text[self.at] == mark

    def ended(self) -> bool:
        return self.at >= self.stop or (self.by_line and self.text[self.at] == "\n")

    def split(self, most: int | None = None) -> None:
        """Reads all fields, or the first ``most``."""
        if most is None and not self.by_line and self.text.find('"', self.begin, self.stop) < 0:  # no quoted field can begin
            start = 0
            for part in self.text[self.begin : self.stop].split(","):
                self.fields.append((part.strip(BLANKS), start))
                start += len(part) + 1
            self.at = self.stop
            return
        while True:
            self.field()
            if self.ended() or len(self.fields) == most:
                return
            self.at += 1  # the comma

    def field(self) -> None:
        self.blanks()
        begin = self.at
        if self.next_is('"'):
            text = self.quoted()
            self.blanks()
            if not self.ended() and not self.next_is(","):
                raise self.error(self.at, "a quoted field goes on after its end")
        else:
            self.at = _BARE[self.by_line].match(self.text, begin, self.stop).end()
            if self.next_is('"'):
                raise self.error(self.at, "a quote inside an unquoted field")
            text = self.text[begin : self.at]
        self.fields.append((text.strip(BLANKS), begin - self.begin))

    def quoted(self) -> str:
        opened, parts = self.at, []
        self.at += 1
        while True:
            end = _IN_QUOTES.match(self.text, self.at, self.stop).end()
            parts.append(self.text[self.at : end])
            self.at = end + 1
            if end >= self.stop:
                self.at = self.stop
                raise self.error(opened, UNENDED)
            if not self.next_is('"'):
                return "".join(parts)
            parts.append('"')
            self.at += 1

    def blanks(self) -> None:
        while self.at < self.stop and self.text[self.at] in BLANKS:
            self.at += 1

    def vertex(self) -> TraceRecord:
        f = self.fields
        if len(f) < 4:
            raise TraceSyntaxError("columns", self.at - self.begin, f"a vertex line of {len(f)} fields")
        if len(f) % 2:
            raise TraceSyntaxError("columns", self.at - self.begin, f"an odd number of fields, {len(f)}")
        n = _whole(f[3][0], STEP_LIMIT)
        pairs = (len(f) - 4) // 2
        if n is not None and n != pairs:
            raise TraceSyntaxError("columns", f[3][1], f"{n} elements announced, {pairs} there")
        head = self.head()
        if n is None:
            raise TraceSyntaxError("value", f[3][1], "the number of elements")
        vec = []
        for i in range(pairs):
            slot, at = f[4 + 2 * i]
            if _whole(slot, STEP_LIMIT) != i:
                raise TraceSyntaxError("value", at, f"slot {i}")
            text, at = f[5 + 2 * i]
            if not _VALUE.match(text):
                raise TraceSyntaxError("value", at, f"the value of slot {i}")
            vec.append(float(text))
        return TraceRecord(*head, vec=vec)

    def edge(self) -> TraceRecord:
        if len(self.fields) < 3:
            raise TraceSyntaxError("columns", self.at - self.begin, f"an edge line of {len(self.fields)} fields")
        head = self.head()
        return TraceRecord(*head, edges=[self.entry(text, at) for text, at in self.fields[3:]])

    def head(self) -> tuple[int, int, int]:
        got = [_whole(text, limit) for (text, _), limit in zip(self.fields, (STEP_LIMIT, OWNER_LIMIT, ID_LIMIT))]
        for value, (_, at), name in zip(got, self.fields, ("step", "owner", "id")):
            if value is None:
                raise TraceSyntaxError("value", at, name)
        return got[0], got[1], got[2]

    @staticmethod
    def entry(text: str, at: int) -> tuple[str, int, int]:
        parts = text.split(":")
        if len(parts) != 3 or parts[0] not in DIRECTIONS:
            raise TraceSyntaxError("value", at, "an edge")
        pe, offset = _whole(parts[1], OWNER_LIMIT), _whole(parts[2], OFFSET_LIMIT)
        if pe is None or offset is None:
            raise TraceSyntaxError("value", at, "an edge's target")
        return parts[0], pe, offset


def _whole(text: str, limit: int) -> int | None:
    if not _WHOLE.match(text):
        return None
    digits = text.lstrip("0")
    if len(digits) > 19:
        return None
    value = int(digits or "0")
    return value if value < limit else None


def _try(parser: Parser, kind: str | None) -> TraceRecord | TraceSyntaxError:
    try:
        return parser.record(kind)
    except TraceSyntaxError as e:
        return e


def parse_line(kind: str | None, line: str | None) -> TraceRecord | TraceSyntaxError:
    """One line; a null line counts as an empty one, which has too few columns."""
    return _try(Parser(line or ""), kind)


def parse_rows(kinds: Sequence[str | None], lines: Sequence[str | None]) -> Iterator[TraceRecord | TraceSyntaxError]:
    """The record or error of each row, read as one text with the rows' starts as anchors; a null row counts as an empty one."""
    text = "".join(x or "" for x in lines)
    begin = 0
    for kind, line in zip(kinds, lines):
        stop = begin + len(line or "")
        yield _try(Parser(text, begin, stop), kind)
        begin = stop  # whatever became of the record, reading resumes at the next anchor


def _is_anchor(text: str, at: int) -> bool:
    p = Parser(text, at, by_line=True)
    p.stop = _line_end(text, at)
    try:
        p.split(most=3)
        p.head()
    except TraceSyntaxError:
        return False
    return len(p.fields) == 3


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def parse_text(kind: str, text: str) -> Iterator[tuple[int, int, TraceRecord | TraceSyntaxError]]:
    """Raw text as (position, lines taken, record or error): every line of it, in order.

    A record takes a line. A quoted field that its line doesn't end goes on over line ends as long as these are no anchors; if
    it ends well there the record takes all its lines, otherwise only the line it began in, and each line behind is read by
    itself up to the next anchor. A carriage return before a line end belongs to it; a line end at the end of the text begins no
    line."""
    at, anchor = 0, -1
    while at < len(text):
        end, taken = _line_end(text, at), 1
        got = _try(Parser(text, at, end - (text[end - 1 : end] == "\r" and end > at)), kind)
        if isinstance(got, TraceSyntaxError) and got.detail == UNENDED:
            anchor = max(anchor, end + 1)
            while anchor < len(text) and not _is_anchor(text, anchor):
                anchor = _line_end(text, anchor) + 1
            if anchor > end + 1:
                longer = Parser(text, at, min(anchor - 1, len(text)), by_line=True)
                again = _try(longer, kind)
                if not (isinstance(again, TraceSyntaxError) and again.reason == "quoting"):
                    got, end = again, _line_end(text, longer.at)
                    taken = text.count("\n", at, end) + 1
        yield at, taken, got
        at = end + 1


def parse_texts(texts: DataFrame) -> DataFrame:
    """texts: file_id, line_no (of a text's first line), kind, text. Every line of every text in the form of
    :func:`parse_trace_lines`; a record of several lines stands under its first, and ``lines`` says how many it took.
    Defined cases: a null or empty text has no lines; a kind other than vertex and edge (or null) fails with ``kind``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                got = list(parse_text(row["kind"], row["text"] or ""))
                for i in range(0, len(got), 2000):
                    part = got[i : i + 2000]
                    first = row["line_no"] + sum(n for _, n, _ in got[:i])
                    numbers = [first + sum(n for _, n, _ in part[:j]) for j in range(len(part))] if any(n != 1 for _, n, _ in part) else range(first, first + len(part))
                    keys = [pa.array([row["file_id"]] * len(part), b.schema.field(0).type), pa.array(list(numbers), b.schema.field(1).type), pa.array([row["kind"]] * len(part), pa.string())]
                    yield _batch_of(keys, [r for _, _, r in part], pa.array([n for _, n, _ in part], pa.int32()))

    kept = texts.select("file_id", "line_no", "kind", "text")
    return kept.mapInArrow(parse, _out(kept) + ", lines int")


_RESULT = "step int, owner int, vec_id long, vec array<double>, edges array<struct<dir:string,pe:int,offset:bigint>>, reason string, error_at int, error string"
_EDGE_TYPE = pa.list_(pa.struct([("dir", pa.string()), ("pe", pa.int32()), ("offset", pa.int64())]))
_RESULT_TYPES = {"step": pa.int32(), "owner": pa.int32(), "vec_id": pa.int64(), "vec": pa.list_(pa.float64()), "edges": _EDGE_TYPE, "reason": pa.string(), "error_at": pa.int32(), "error": pa.string()}


def _out(rows: DataFrame) -> str:
    """The schema of results, with the types that the rows' keys have."""
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("file_id", "line_no")) + ", kind string, " + _RESULT


def _batch_of(keys: list[pa.Array], results: Sequence[TraceRecord | TraceSyntaxError], lines: pa.Array | None = None) -> pa.RecordBatch:
    rows = []
    for got in results:
        if isinstance(got, TraceRecord):
            edges = None if got.edges is None else [{"dir": d, "pe": p, "offset": o} for d, p, o in got.edges]
            rows.append((got.step, got.owner, got.vec_id, got.vec, edges, None, None, None))
        else:
            rows.append((None, None, None, None, None, got.reason, got.at, got.detail))
    columns = zip(*rows) if rows else [()] * len(_RESULT_TYPES)
    arrays = [*keys, *(pa.array(list(v), t) for v, t in zip(columns, _RESULT_TYPES.values()))]
    names = ["file_id", "line_no", "kind", *_RESULT_TYPES]
    return pa.record_batch([*arrays, lines] if lines is not None else arrays, names=[*names, "lines"] if lines is not None else names)


def parse_trace_lines(lines: DataFrame) -> DataFrame:
    """Every line as a typed record or with its reason (``reason``, ``error_at``, ``error``; null for valid lines).

    The first reason that applies is given: quoting, columns, value. Defined cases: a null or empty line fails with
    ``columns``; a kind other than vertex and edge (or null) fails with ``kind`` once its quoting is sound; repeated rows
    give repeated results; other columns of the input are left out. Lines are parsed where they are read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                yield _batch_of(part.columns[:3], list(parse_rows(part.column(2).to_pylist(), part.column(3).to_pylist())))

    text = spread(lines.select("file_id", "line_no", "kind", "line"))
    return text.mapInArrow(parse, _out(text))


def failures(parsed: DataFrame) -> DataFrame:
    """The lines that fail, once each: file_id, line_no, reason, error_at, error."""
    return parsed.where("reason is not null").select("file_id", "line_no", "reason", "error_at", "error").distinct()


def vertices(parsed: DataFrame) -> DataFrame:
    """The valid vertex lines as rows."""
    return parsed.where("reason is null and kind = 'vertex'").select("file_id", "line_no", "step", "owner", "vec_id", F.size("vec").alias("nelements"), "vec")


def edges(parsed: DataFrame) -> DataFrame:
    """The valid edge lines as rows."""
    return parsed.where("reason is null and kind = 'edge'").select("file_id", "line_no", "step", "owner", "vec_id", "edges")
