"""Schemas that drift between the files of a stream: one consistent table, and every change from file to file.

Each file's schema is profiled (fields, the JSON type of most of their values, what nests in them). A file is held against
the one opened before it in its stream by similarity flooding: the two schemas are graphs of fields, types and nesting,
match scores start from names, types and the values that both files hold for the same records, flow between neighbouring
pairs until they settle, and a consistent one-to-one set of correspondences is selected. A correspondence between a field
gone and a new one must also hold its exact check: the same numbers in the records of both files.

Sizes: JSON is taken apart where it is read, and no payload is shuffled. For the profiles a row travels as the hashes of its
payload and the types of its fields, placed once by file and span of lines, which serves both the dropping of repeated rows
and the votes; for the comparison as the numbers of fields gone or new, an array per record. File order comes from windows
over slices of time, so that a stream with a third of all files isn't one task; what reaches Python is one row per file and
layout of fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import cut

#: A rename needs this share of the comparable values, and at least so many, to be the same.
SAME_SHARE, SAME_LEAST = 0.6, 2
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*[A-Za-z%/]*\s*$"
_BARE_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_FIRST_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def _documents(files: DataFrame, *keep: str) -> DataFrame:
    """keep..., doc: the parsed payload of each row, null if it is broken. It comes out of a generator, so that conditions on
    it aren't moved below and each payload is parsed once."""
    return files.select(*keep, F.explode(F.array(F.try_parse_json("payload"))).alias("doc"))


def kind_of(shape: F.Column) -> F.Column:
    """The JSON type of a value by its variant type; null for null."""
    whole = F.regexp_extract(shape, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(shape == "BIGINT", "integer")
        .when(shape.startswith("DECIMAL"), F.when(whole.try_cast("int") > 18, "integer").otherwise("double"))
        .when(shape.isin("DOUBLE", "FLOAT"), "double").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object")
    )


#: JSON types by the names they have in a layout.
_KINDS = {"BIGINT": "integer", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}
_TYPE_NAME = re.compile(r"[A-Z_]+(?:\(\d+,\d+\))?")


def read_layout(layout: str) -> list[tuple[str, str | None, str | None]]:
    """(field, type, layout of what nests in it) of an object's layout as a variant's type is written."""

    def kind(at: int) -> tuple[str, int]:
        m = _TYPE_NAME.match(layout, at)
        name, at = m.group(), m.end()
        if at < len(layout) and layout[at] == "<":
            at = members(at)[1] if name == "OBJECT" else kind(at + 1)[1] + 1
        return name, at

    def members(at: int) -> tuple[list[tuple[str, str, int, int]], int]:
        out, at = [], at + 1
        while layout[at] != ">":
            if layout[at] == "`":
                end = at + 1
                while layout[end] != "`" or layout[end + 1 : end + 2] == "`":
                    end += 2 if layout[end] == "`" else 1
                field, at = layout[at + 1 : end].replace("``", "`"), end + 1
            else:
                end = layout.index(":", at)
                field, at = layout[at:end], end
            begin = at + 2
            name, at = kind(begin)
            out.append((field, name, begin, at))
            if layout[at] == ",":
                at += 2
        return out, at + 1

    def json_type(name: str) -> str | None:
        if name.startswith("DECIMAL"):
            digits, scale = name[8:-1].split(",")
            return "integer" if scale == "0" and int(digits) > 18 else "double"
        return _KINDS.get(name)

    found = members(layout.index("<"))[0] if layout.startswith("OBJECT<") else []
    return [(f, json_type(k), layout[i:j] if k == "OBJECT" else None) for f, k, i, j in found]


def _count_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(stream, file_no, opened, f, kind, shape, n) for stream, file_no, opened, layout, n in pdf.itertuples(index=False) for f, kind, shape in read_layout(layout or "")]
        yield pd.DataFrame(rows, columns=["stream_id", "file_no", "opened_at", "field", "type", "shape", "n"])


def count_fields(files: DataFrame) -> DataFrame:
    """stream_id, file_no, opened_at, field, type, shape, n: how many values of each type a field has in a file. Rows repeated
    unchanged count once."""
    written = F.schema_of_variant("doc")
    # numbers by their JSON type, so that few layouts differ; a layout with quoted names is left as it is, and read so
    even = F.regexp_replace(F.regexp_replace(written, r": DECIMAL\((?:19|[23][0-9]),0\)", ": BIGINT"), r": DECIMAL\([0-9,]+\)", ": DOUBLE")
    layout = F.when(F.instr(written, "`") > 0, written).otherwise(even)
    docs = _documents(files, "stream_id", "file_no", "opened_at", "line_no", "payload").select("stream_id", "file_no", "opened_at", "line_no", F.xxhash64("payload").alias("h1"), F.hash("payload").alias("h2"), layout.alias("layout"))
    placed = docs.repartition("stream_id", "file_no", F.floor(F.col("line_no") / 4096))
    once = placed.dropDuplicates(["stream_id", "file_no", "line_no", "h1", "h2"])
    counted = once.groupBy("stream_id", "file_no", "opened_at", "layout").agg(F.count("*").alias("n")).select("stream_id", "file_no", "opened_at", "layout", "n")
    opened = files.schema["opened_at"].dataType.simpleString()
    return counted.mapInPandas(_count_fields, f"stream_id int, file_no int, opened_at {opened}, field string, type string, shape string, n long")


def carried_number(kind: F.Column, text: F.Column) -> F.Column:
    """The number a value carries, written as a number or a string, with or without a unit; of lists and objects the first
    inside them; null for anything else."""
    nested = kind.isin("array", "object")
    return F.when(nested, F.regexp_extract(text, _FIRST_NUMBER, 1)).when(kind != "boolean", F.regexp_extract(text, _NUMBER, 1)).try_cast("double")


def profile_files(counts: DataFrame) -> DataFrame:
    """stream_id, file_no, opened_at, field, type (of most non-null values; ties by name; null if all are null), shape."""
    by_type = counts.groupBy("stream_id", "file_no", "field", "type").agg(F.sum("n").alias("n"), F.max("opened_at").alias("opened_at"), F.max("shape").alias("shape"))
    best = F.max(F.when(F.col("type").isNotNull(), F.struct("n", "type")))
    return by_type.groupBy("stream_id", "file_no", "field").agg(F.max("opened_at").alias("opened_at"), best["type"].alias("type"), F.max("shape").alias("shape"))


def file_order(profile: DataFrame) -> DataFrame:
    """stream_id, file_no, opened_at, prev_file: the file opened before each in its stream (ties by file_no).

    Windows run within a stream and day; the last file of the day before comes from a second window over one row a day."""
    files = profile.groupBy("stream_id", "file_no").agg(F.max("opened_at").alias("opened_at")).withColumn("day", F.to_date("opened_at"))
    inside = Window.partitionBy("stream_id", "day").orderBy("opened_at", "file_no")
    days = files.groupBy("stream_id", "day").agg(F.max(F.struct("opened_at", "file_no"))["file_no"].alias("last_file"))
    before = days.select(F.col("stream_id").alias("s"), F.col("day").alias("d"), F.lag("last_file").over(Window.partitionBy("stream_id").orderBy("day")).alias("carried"))
    within = files.withColumn("lagged", F.lag("file_no").over(inside))
    joined = within.join(before, (F.col("stream_id") == F.col("s")) & F.col("day").eqNullSafe(F.col("d")), "left")
    return joined.select("stream_id", "file_no", "opened_at", F.coalesce("lagged", "carried").alias("prev_file"))


def _file_pairs(profile: DataFrame, order: DataFrame) -> DataFrame:
    """stream_id, prev_file, file_no, fields: per pair of files the array of (name, in_prev, in_cur, types, shapes)."""
    pairs = order.where("prev_file is not null").select("stream_id", "prev_file", "file_no")
    cur = profile.join(pairs, ["stream_id", "file_no"]).select("stream_id", "prev_file", "file_no", "field", F.lit(True).alias("cur"), "type", "shape")
    prev = profile.withColumnRenamed("file_no", "prev_file").join(pairs, ["stream_id", "prev_file"]).select("stream_id", "prev_file", "file_no", "field", F.lit(False).alias("cur"), "type", "shape")
    side = lambda c, at: F.max(F.when(F.col("cur") == F.lit(at), F.col(c)))
    by_field = cur.unionByName(prev).groupBy("stream_id", "prev_file", "file_no", "field").agg(
        F.max(~F.col("cur")).alias("in_prev"), F.max("cur").alias("in_cur"), side("type", False).alias("prev_type"), side("type", True).alias("cur_type"),
        side("shape", False).alias("prev_shape"), side("shape", True).alias("cur_shape"),
    )
    one = F.struct("field", "in_prev", "in_cur", "prev_type", "cur_type", "prev_shape", "cur_shape")
    return by_field.groupBy("stream_id", "prev_file", "file_no").agg(F.array_sort(F.collect_list(one)).alias("fields"))


def _agreements(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """stream_id, file_no, agree: per pair of files the array of (gone, new, both, same) over the records both files hold.

    Only files of pairs that have both gone and new fields are taken apart again, and only those fields' numbers kept."""
    names = lambda old, new: F.transform(F.filter("fields", lambda x: (x["in_prev"] == F.lit(old)) & (x["in_cur"] == F.lit(new))), lambda x: x["field"])
    open_pairs = pairs.select("stream_id", "prev_file", "file_no", names(True, False).alias("gone"), names(False, True).alias("new")).where("size(gone) > 0 and size(new) > 0")
    asks = lambda file, names, old: open_pairs.select("stream_id", F.col(file).alias("file_no"), F.struct(F.col("file_no").alias("pair"), F.lit(old).alias("old"), F.col(names).alias("names")).alias("ask"))
    per_file = asks("prev_file", "gone", True).unionByName(asks("file_no", "new", False)).groupBy("stream_id", "file_no").agg(F.collect_list("ask").alias("asks"))
    docs = _documents(files.join(per_file, ["stream_id", "file_no"]), "stream_id", "asks").select("stream_id", "asks", F.try_variant_get("doc", "$.pe", "bigint").alias("pe"), F.try_variant_get("doc", "$.timestep", "bigint").alias("timestep"), F.expr("try_variant_get(doc, '$', 'map<string,variant>')").alias("values"))
    # one transform after the other, so that each value's type and text are made once
    value = lambda n: F.col("values")[n]
    texts = lambda ask: F.transform(ask["names"], lambda n, i: F.struct(i.alias("i"), F.schema_of_variant(value(n)).alias("shape"), F.try_variant_get(value(n), "$", "string").alias("text")))
    kinds = lambda ask: F.transform(texts(ask), lambda r: F.struct(r["i"].alias("i"), kind_of(r["shape"]).alias("kind"), r["text"].alias("text")))
    numbers = lambda ask: F.filter(F.transform(kinds(ask), lambda r: F.struct(r["i"].alias("i"), carried_number(r["kind"], r["text"]).alias("x"))), lambda e: e["x"].isNotNull())
    read = docs.where("pe is not null and timestep is not null").select("stream_id", "pe", "timestep", F.explode("asks").alias("ask"), "values").select("stream_id", F.col("ask.pair").alias("pair"), "pe", "timestep", F.col("ask.old").alias("old"), numbers(F.col("ask")).alias("found")).where("size(found) > 0")
    of = lambda old: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("old") == F.lit(old), F.col("found")))))
    records = read.groupBy("stream_id", "pair", "pe", "timestep").agg(of(True).alias("gone"), of(False).alias("new")).where("size(gone) > 0 and size(new) > 0")
    crossed = records.select("stream_id", "pair", F.explode("gone").alias("g"), "new").select("stream_id", "pair", "g", F.explode("new").alias("n"))
    close = F.abs(F.col("g.x") - F.col("n.x")) <= F.lit(1e-9) * F.greatest(F.abs("g.x"), F.abs("n.x"), F.lit(1e-3))
    counted = crossed.groupBy("stream_id", F.col("pair").alias("file_no"), F.col("g.i").alias("g"), F.col("n.i").alias("n")).agg(F.count("*").alias("both"), F.count_if((F.col("g.x") == F.col("n.x")) | close).alias("same"))
    # fields travel as their places in the lists of their pair
    named = counted.join(open_pairs.select("stream_id", "file_no", F.col("gone").alias("olds"), F.col("new").alias("news")), ["stream_id", "file_no"])
    return named.groupBy("stream_id", "file_no").agg(F.collect_list(F.struct(F.get("olds", "g").alias("gone"), F.get("news", "n").alias("new"), "both", "same")).alias("agree"))


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, without case and separators."""
    a, b = (re.sub(r"[^a-z0-9]", "", x.lower()) for x in (a, b))
    if a == b:
        return 1.0
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


class SchemaGraph:
    """Fields (and what nests in them) as nodes, with their type and parent as neighbours."""

    def __init__(self, fields: Sequence[tuple[str, str | None, str | None]]):
        self.names: list[str] = []
        self.types: list[str] = []
        self.parents: list[int] = []
        for name, kind, shape in fields:
            self.names.append(name)
            self.types.append(kind or "null")
            self.parents.append(-1)
            top = len(self.names) - 1
            for child in re.findall(r"[<,]\s*([^:<>,]+):", shape or ""):
                self.names.append(child)
                self.types.append("nested")
                self.parents.append(top)

    def type_matrix(self, kinds: list[str]) -> np.ndarray:
        return np.array([[float(t == k) for k in kinds] for t in self.types]).reshape(len(self.names), len(kinds))

    def parent_matrix(self) -> np.ndarray:
        m = np.zeros((len(self.names), len(self.names)))
        for i, p in enumerate(self.parents):
            if p >= 0:
                m[i, p] = 1
        return m


def flood(a: SchemaGraph, b: SchemaGraph, start: np.ndarray, most: int = 200, settled: float = 1e-4) -> np.ndarray:
    """Match scores of every node of ``a`` with every node of ``b``: scores flow between pairs of fields, the pairs of their
    types and the pairs of their parents and children, each share divided by how many pairs it is split among, until they
    change by less than ``settled``."""
    kinds = sorted({*a.types, *b.types})
    ta, tb, pa, pb = a.type_matrix(kinds), b.type_matrix(kinds), a.parent_matrix(), b.parent_matrix()
    split_t = np.maximum(ta.sum(0)[:, None] * tb.sum(0)[None, :], 1)
    split_c = np.maximum(pa.sum(0)[:, None] * pb.sum(0)[None, :], 1)
    same_type = np.eye(len(kinds)) * 0.5 + 0.1
    s, t = start.copy(), same_type.copy()
    for _ in range(most):
        s1 = start + s + ta @ (t / split_t) @ tb.T + pa @ (s / split_c) @ pb.T + pa.T @ s @ pb
        t1 = same_type + t + ta.T @ s @ tb / split_t
        s1, t1 = s1 / max(s1.max(initial=0), 1e-12), t1 / max(t1.max(initial=0), 1e-12)
        moved = np.abs(s1 - s).max(initial=0) + np.abs(t1 - t).max(initial=0)
        s, t = s1, t1
        if moved < settled:
            break
    return s


def match_schemas(fields: Sequence[dict], agree: Sequence[dict]) -> list[tuple[str, str]]:
    """The renames of one pair of files as (old, new), by flooding, consistent selection and the exact check."""
    gone = [f for f in fields if f["in_prev"] and not f["in_cur"]]
    new = [f for f in fields if f["in_cur"] and not f["in_prev"]]
    if not gone or not new:
        return []
    a = SchemaGraph([(f["field"], f["prev_type"], f["prev_shape"]) for f in fields if f["in_prev"]])
    b = SchemaGraph([(f["field"], f["cur_type"], f["cur_shape"]) for f in fields if f["in_cur"]])
    seen = {(x["gone"], x["new"]): (x["both"], x["same"]) for x in agree}
    kept = {f["field"] for f in fields if f["in_prev"] and f["in_cur"]}
    start = np.zeros((len(a.names), len(b.names)))
    for i, x in enumerate(a.names):
        for j, y in enumerate(b.names):
            if (a.parents[i] < 0) != (b.parents[j] < 0):
                continue
            if a.parents[i] < 0 and (x in kept or y in kept):
                start[i, j] = float(x == y)
                continue
            both, same = seen.get((x, y), (0, 0))
            start[i, j] = 0.3 * name_similarity(x, y) + 0.7 * (same / both if both else 0.0)
    score = flood(a, b, start)
    at_a, at_b = ({n: i for i, (n, p) in enumerate(zip(g.names, g.parents)) if p < 0} for g in (a, b))
    ranked = sorted(((score[at_a[g["field"]], at_b[n["field"]]], g["field"], n["field"]) for g in gone for n in new), key=lambda r: (-r[0], r[1], r[2]))
    taken_a, taken_b, out = set(), set(), []
    for _, g, n in ranked:
        both, same = seen.get((g, n), (0, 0))
        if g in taken_a or n in taken_b or same < SAME_LEAST or same < SAME_SHARE * both:
            continue
        taken_a.add(g)
        taken_b.add(n)
        out.append((g, n))
    return out


def changes_of(fields: Sequence[dict], agree: Sequence[dict]) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) of one pair of files."""
    renames = match_schemas(fields, agree)
    by_name = {f["field"]: f for f in fields}
    old, new = {g for g, _ in renames}, {n for _, n in renames}
    out = [("renamed", g, n) for g, n in renames]
    out += [("removed", f["field"], "") for f in fields if f["in_prev"] and not f["in_cur"] and f["field"] not in old]
    out += [("added", "", f["field"]) for f in fields if f["in_cur"] and not f["in_prev"] and f["field"] not in new]
    for g, n in [*renames, *((f["field"], f["field"]) for f in fields if f["in_prev"] and f["in_cur"])]:
        before, after = by_name[g]["prev_type"], by_name[n]["cur_type"]
        if before is not None and after is not None and before != after:
            out.append(("type_changed", g, n))
    return out


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for stream, file_no, prev, fields, agree in zip(pdf["stream_id"], pdf["file_no"], pdf["prev_file"], pdf["fields"], pdf["agree"]):
            rows += [(stream, file_no, prev, *c) for c in changes_of(json.loads(fields), json.loads(agree) if agree else [])]
        yield pd.DataFrame(rows, columns=["stream_id", "file_no", "prev_file", "change", "old_field", "new_field"])


def _changes(files: DataFrame, profile: DataFrame, order: DataFrame) -> DataFrame:
    pairs = cut(_file_pairs(profile, order))
    both = pairs.join(_agreements(files, pairs), ["stream_id", "file_no"], "left")
    plain = both.select("stream_id", "file_no", "prev_file", F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields"), F.to_json("agree").alias("agree"))
    return plain.mapInPandas(_compare, "stream_id int, file_no int, prev_file int, change string, old_field string, new_field string")


def schema_changes(files: DataFrame) -> DataFrame:
    """Each file against the one before it in its stream: stream_id, file_no, change, old_field, new_field.

    Changes: renamed, removed (new_field ''), added (old_field ''), type_changed. Defined cases: a stream's first file has
    no changes; files opened at the same time are ordered by file_no; a field whose values are all null has no type and
    changes none; files without any readable object don't take part; an empty table gives no rows.
    """
    profile = cut(profile_files(count_fields(files)))
    return _changes(files, profile, file_order(profile)).drop("prev_file")


def canonical_names(profile: DataFrame, order: DataFrame, changes: DataFrame) -> DataFrame:
    """stream_id, file_no, field, name: every field of every file under the first name it had in its stream.

    A field's life begins where its name is first seen, added, or renamed into; a life that begins with a rename points to
    the life of the old name, and pointers are doubled until all of them end at a first life."""
    files = order.withColumn("at", F.struct("opened_at", "file_no")).select("stream_id", "file_no", "at")
    begins = changes.where("change in ('renamed', 'added')").join(files, ["stream_id", "file_no"]).select("stream_id", F.col("new_field").alias("field"), "at", F.when(F.col("change") == "renamed", F.col("old_field")).alias("old"))
    first = profile.join(files, ["stream_id", "file_no"]).groupBy("stream_id", "field").agg(F.min("at").alias("at")).join(begins.select("stream_id", "field", "at"), ["stream_id", "field", "at"], "left_anti").withColumn("old", F.lit(None).cast("string"))
    lives = cut(begins.unionByName(first).select("stream_id", "field", "at", "old"))
    seen = profile.join(files, ["stream_id", "file_no"]).select("stream_id", "file_no", "field", "at")
    upto = Window.partitionBy("stream_id", "field").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)

    def life_at(asked: DataFrame) -> DataFrame:
        """asked(stream_id, field, at, ...) with ``life``: the latest begin of the name at or before."""
        marks = lives.select("stream_id", "field", "at", F.lit(0).alias("kind"), F.lit(None).cast("struct<x:string>").alias("ask"), F.col("at").alias("begin"))
        asks = asked.select("stream_id", "field", "at", F.lit(1).alias("kind"), F.struct(*[c for c in asked.columns if c not in ("stream_id", "field", "at")]).alias("ask"), F.lit(None).cast(lives.schema["at"].dataType).alias("begin"))
        marks = marks.withColumn("ask", F.lit(None).cast(asks.schema["ask"].dataType))
        return marks.unionByName(asks).withColumn("life", F.last("begin", ignorenulls=True).over(upto)).where("kind = 1").select("stream_id", "field", "at", "ask.*", "life")

    renamed = lives.where("old is not null").select("stream_id", F.col("old").alias("field"), "at", F.struct(F.col("field").alias("f"), F.col("at").alias("b")).alias("child"))
    up = life_at(renamed).select("stream_id", "child", F.struct(F.col("field").alias("f"), F.col("life").alias("b")).alias("parent"))
    links = cut(up)
    while True:  # as many rounds as the logarithm of the longest chain of renames
        tops = links.select("stream_id", F.col("child").alias("parent"), F.col("parent").alias("top"))
        longer = links.join(tops, ["stream_id", "parent"], "left").select("stream_id", "child", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved"))
        longer = cut(longer)
        links = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    now = life_at(seen).withColumn("child", F.struct(F.col("field").alias("f"), F.col("life").alias("b")))
    return now.join(links, ["stream_id", "child"], "left").select("stream_id", "file_no", "field", F.coalesce("parent.f", "field").alias("name"))


#: Names that become columns of the consistent table, at most; were there more, those of the fewest files would stay in
#: ``other``.
MOST_COLUMNS = 500


def column_types(profile: DataFrame, names: DataFrame, most: int = MOST_COLUMNS) -> dict[str, str]:
    """Each name with the type its fields had: bigint, double, boolean or string, numbers before other types."""
    joined = profile.join(names, ["stream_id", "file_no", "field"]).where("field not in ('pe', 'timestep') and type is not null")
    kinds = joined.groupBy("name").agg(F.collect_set("type").alias("types"), F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most).collect()

    def one(types: set[str]) -> str:
        if types & {"integer", "double"}:
            return "bigint" if types == {"integer"} else "double"
        return "boolean" if types == {"boolean"} else "string"

    return {r["name"]: one(set(r["types"])) for r in sorted(kinds)}


def consistent_table(files: DataFrame, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """All records of all files in one table: stream_id, pe, timestep, one typed column per field, and a map of the rest.

    Each field stands under the first name it had in its stream. A column is bigint if its fields were integers in every file,
    double if they were numbers in any, boolean or string otherwise. A record that several files hold comes once, each value
    from the latest file that has one. A numeric column has the latest number; where there is none, the latest boolean as 0
    or 1. ``other`` keeps the latest text that its column can't carry whole (booleans, lists, objects, stray texts and
    numbers with a unit in numeric columns, whole numbers that a double would round), and is empty without one. Names that
    differ only by spelling, and columns that would clash with stream_id, pe, timestep or other regardless of case, stay
    apart there too: of such names the first in order is the column, the rest are kept in ``other``."""
    profile = cut(profile_files(count_fields(files)))
    order = cut(file_order(profile))
    changes = cut(_changes(files, profile, order))
    named = cut(canonical_names(profile, order, changes))
    types, taken = {}, {"stream_id", "pe", "timestep", "other"}
    for name, kind in column_types(profile, named, most_columns).items():
        if name.lower() not in taken:
            types[name] = kind
            taken.add(name.lower())
    names = named.groupBy("stream_id", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))
    docs = _documents(files.join(names, ["stream_id", "file_no"]), "stream_id", "file_no", "opened_at", "names").select("stream_id", "names", F.struct("opened_at", "file_no").alias("at"), F.try_variant_get("doc", "$.pe", "bigint").alias("pe"), F.try_variant_get("doc", "$.timestep", "bigint").alias("timestep"), F.expr("try_variant_get(doc, '$', 'map<string,variant>')").alias("values"))
    entry = lambda e: F.struct(F.col("names")[e["key"]].alias("name"), F.schema_of_variant(e["value"]).alias("shape"), F.try_variant_get(e["value"], "$", "string").alias("text"))
    shaped = F.transform(F.filter(F.map_entries("values"), lambda e: ~e["key"].isin("pe", "timestep")), entry)
    entries = F.transform(shaped, lambda e: F.struct(e["name"].alias("name"), kind_of(e["shape"]).alias("kind"), e["text"].alias("text")))
    # whole records travel, to where both aggregations find them together
    records = docs.where("pe is not null and timestep is not null").select("stream_id", "pe", "timestep", "at", entries.alias("entries")).repartition("stream_id", "pe", "timestep")
    values = records.select("stream_id", "pe", "timestep", "at", F.explode_outer("entries").alias("e")).select("stream_id", "pe", "timestep", "at", "e.name", "e.kind", "e.text")
    column = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.col("name")] if types else F.lit(None).cast("string")
    kind, text = F.col("kind"), F.col("text")
    number = carried_number(kind, text)
    x = F.when(column == "double", number).when((column == "bigint") & (number == F.floor(number)) & (F.abs(number) < 2**53), number)
    numeric = F.when(kind == "string", text.rlike(_BARE_NUMBER)).when(kind == "integer", F.abs(number) < 2**53).otherwise(kind == "double")
    carried = F.when(column == "string", True).when(column == "boolean", kind == "boolean").otherwise(x.isNotNull() & numeric)
    flag = F.when(kind == "boolean", (text == "true").cast("double"))
    read = values.withColumn("x", x).withColumn("flag", flag).withColumn("left", F.when(~F.coalesce(carried, F.lit(False)), text))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c]
    latest = read.groupBy("stream_id", "pe", "timestep", "name").agg(last("x").alias("x"), last("flag").alias("flag"), last("text").alias("text"), last("left").alias("left"))
    other = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("left").isNotNull(), F.struct("name", "left")))))
    of_type = {"double": F.coalesce("x", "flag"), "bigint": F.coalesce("x", "flag").cast("bigint"), "boolean": F.col("flag") == 1, "string": F.col("text")}
    return latest.groupBy("stream_id", "pe", "timestep").agg(*[F.max(F.when(F.col("name") == n, of_type[t])).alias(n) for n, t in types.items()], other.alias("other"))
