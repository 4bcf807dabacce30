"""Differences between two copies of a dataset.

Both copies are reduced to one row per key (repeats are dropped before the shuffle by partial aggregation), joined with a
null-safe full outer join, and compared field by field into an array of (field, left value, right value).

The join key is a struct: a struct is never null, and Spark compares the nulls inside it as equal, so the join is
null-safe and still an equi-join that re-uses the partitioning and the order left by the aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF_TYPE = "array<struct<field:string,left:string,right:string>>"
TOLERANCE = 1e-6

#: How an edge list spells a direction as seen from its row's vertex, as a two-bit code: 1 in, 2 out, 3 both.
DIRECTION_CODES = {"IN": 1, "OUT": 2, "BI": 3, "BIDIRECTIONAL": 3}


def values_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """True if both are null, both NaN, equal, or at most ``tolerance`` apart; never null."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))


def _difference(field: Column | str, a: Column, b: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), a.cast("string").alias("left"), b.cast("string").alias("right"))


def scalar_rule(name: str) -> Callable[[Column, Column], Column]:
    """Rule for a column that must be the same on both sides (null equals null)."""

    def rule(a: Column, b: Column) -> Column:
        x, y = a[name], b[name]
        return F.when(~x.eqNullSafe(y), F.array(_difference(name, x, y))).otherwise(F.array().cast(DIFF_TYPE))

    return rule


def length_rule(name: str, field: str) -> Callable[[Column, Column], Column]:
    """Rule for the length of an array column; a null array has no length."""

    def rule(a: Column, b: Column) -> Column:
        x, y = (F.when(s[name].isNotNull(), F.size(s[name])) for s in (a, b))
        return F.when(~x.eqNullSafe(y), F.array(_difference(field, x, y))).otherwise(F.array().cast(DIFF_TYPE))

    return rule


def slots_rule(name: str, tolerance: float = TOLERANCE) -> Callable[[Column, Column], Column]:
    """Rule for an array of numbers: one difference ``name.K`` for each slot K that both sides have."""

    def rule(a: Column, b: Column) -> Column:
        both = F.least(F.size(a[name]), F.size(b[name]))
        zipped = F.arrays_zip(a[name].alias("l"), b[name].alias("r"))
        marked = F.transform(zipped, lambda p, i: F.when((i < both) & ~values_equal(p["l"], p["r"], tolerance), _difference(F.concat(F.lit(f"{name}."), i.cast("string")), p["l"], p["r"])))
        return F.coalesce(F.filter(marked, lambda d: d.isNotNull()), F.array().cast(DIFF_TYPE))

    return rule


def one_row_per_key(df: DataFrame, key: Sequence[Column], values: Sequence[Column]) -> DataFrame:
    """``df`` as (k, v), v the greatest of the key's value structs: put a version column first to keep the latest."""
    return df.select(F.struct(*key).alias("k"), F.struct(*values).alias("v")).groupBy("k").agg(F.max("v").alias("v"))


def compare_copies(left: DataFrame, right: DataFrame, rules: Sequence[Callable[[Column, Column], Column]], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows that one copy lacks and rows whose values differ, from two inputs of the form (k struct, v struct).

    Result: k, status (``missing_in_<name>`` or ``differs``), diffs (array of field, left, right; empty for missing rows).
    Equal rows aren't returned. Defined cases: null keys match null keys; empty inputs give every row of the other copy;
    repeated keys are the caller's to reduce with :func:`one_row_per_key`.
    """
    a, b = left.select("k", F.col("v").alias("va")), right.select("k", F.col("v").alias("vb"))
    joined = a.join(b, "k", "full_outer")
    diffs = F.concat(*(r(F.col("va"), F.col("vb")) for r in rules)) if rules else F.array().cast(DIFF_TYPE)
    status = F.when(F.col("va").isNull(), f"missing_in_{names[0]}").when(F.col("vb").isNull(), f"missing_in_{names[1]}").otherwise("differs")
    none = F.array().cast(DIFF_TYPE)
    found = joined.select("k", status.alias("status"), F.when(F.col("va").isNull() | F.col("vb").isNull(), none).otherwise(diffs).alias("diffs"))
    return found.where((F.col("status") != "differs") | (F.size("diffs") > 0))


def actor_of(vec: Column) -> Column:
    """Slot 0 as the vertex's identity; null where it is null, NaN, infinite or not whole."""
    s = F.get(vec, F.lit(0))
    return F.when((s == F.floor(s)) & (F.abs(s) <= F.lit(2.0**53)), s.cast("long"))


def _vertex_key() -> list[Column]:
    uid = actor_of(F.col("vec"))
    return [F.col("step").cast("int").alias("step"), uid.alias("uid"), F.when(uid.isNull(), F.col("vec_id")).alias("alt")]


def vertex_rows(vertices: DataFrame) -> DataFrame:
    """Vertex trace as (k, v), one row per (step, slot 0).

    Of several versions of a key the latest dumped is kept. A row without a usable slot 0 (null, NaN, not whole, no vec)
    is keyed by its vec_id instead, so no two of them are taken for one another.
    """
    return one_row_per_key(vertices, _vertex_key(), [F.col("dumped_at"), F.col("vec_id"), F.col("vec")])


def vertex_names(vertices: DataFrame) -> DataFrame:
    """(step, vec_id, uid): the identity behind each id of one copy, ids without one left out."""
    return vertices.select("step", "vec_id", actor_of(F.col("vec")).alias("uid")).where("uid is not null and step is not null and vec_id is not null").groupBy("step", "vec_id").agg(F.max("uid").alias("uid"))


def edge_rows(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge trace of one copy as (k, v) with v.pairs the set of 4 * target + direction code.

    Each list entry and the row's own vertex are looked up in the copy's vertices in one join, then gathered by row; a set
    takes repeated rows and any order of the list as one. A vertex that the copy doesn't hold is named by its id as
    -1 - vec_id. Null and empty lists are both "no edges". A hot target splits under adaptive skew handling, as the
    aggregation after the join needs another exchange anyway.
    """
    code = F.coalesce(*(F.when(F.upper(F.trim(F.col("e.dir"))) == d, F.lit(c)) for d, c in DIRECTION_CODES.items()), F.lit(0))
    target = F.col("e.pe").cast("long") * F.lit(2**32) + F.col("e.offset")
    own = F.struct(F.lit(None).cast("string").alias("dir"), F.lit(None).cast("int").alias("pe"), F.lit(None).cast("long").alias("offset"))
    listed = F.concat(F.array(own), F.coalesce(F.col("edges"), F.array().cast("array<struct<dir:string,pe:int,offset:bigint>>")))
    flat = edges.select("step", "vec_id", F.posexplode(listed).alias("i", "e")).select("step", "vec_id", F.when(F.col("i") == 0, F.lit(-1)).otherwise(code).cast("tinyint").alias("code"), F.when(F.col("i") == 0, F.col("vec_id")).otherwise(target).alias("at"))
    names = vertex_names(vertices).select(F.col("step").alias("s"), F.col("vec_id").alias("at_id"), "uid")
    named = flat.join(names, (F.col("step") == F.col("s")) & (F.col("at") == F.col("at_id")), "left").select("step", "vec_id", "code", "uid", F.coalesce(F.col("uid"), F.lit(-1) - F.col("at"), F.lit(-1)).alias("target"))
    rows = named.groupBy("step", "vec_id").agg(F.max(F.when(F.col("code") == -1, F.col("uid"))).alias("uid"), F.collect_set(F.when(F.col("code") >= 0, F.col("target") * 4 + F.col("code"))).alias("pairs"))
    # two ids of one vertex in a copy: the union of their lists
    key = F.struct(F.col("step").cast("int").alias("step"), "uid", F.when(F.col("uid").isNull(), F.col("vec_id")).alias("alt"))
    return rows.select(key.alias("k"), "pairs").groupBy("k").agg(F.struct(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")).alias("v"))


def edges_rule(a: Column, b: Column) -> Column:
    """``edges`` if a target is in one list only, ``dir`` if a target of both lists has another direction."""
    pa, pb = a["pairs"], b["pairs"]
    ta, tb = (F.array_distinct(F.transform(p, lambda x: F.shiftright(x, 2))) for p in (pa, pb))
    only_a, only_b = F.array_except(ta, tb), F.array_except(tb, ta)
    lists = F.when((F.size(only_a) > 0) | (F.size(only_b) > 0), F.array(_difference("edges", F.array_join(F.array_sort(only_a).cast("array<string>"), " "), F.array_join(F.array_sort(only_b).cast("array<string>"), " ")))).otherwise(F.array().cast(DIFF_TYPE))

    # set operations only, which hash: a hub's list may have as many turned entries as others have
    kept = F.flatten(F.transform(F.array_intersect(ta, tb), lambda t: F.array(*[t * 4 + c for c in range(4)])))
    turned_a, turned_b = F.array_intersect(F.array_except(pa, pb), kept), F.array_intersect(F.array_except(pb, pa), kept)
    say = lambda p: F.array_join(F.transform(F.array_sort(p), lambda x: F.concat_ws(":", F.shiftright(x, 2).cast("string"), x.bitwiseAND(3).cast("string"))), " ")
    turned = F.when((F.size(turned_a) > 0) | (F.size(turned_b) > 0), F.array(_difference("dir", say(turned_a), say(turned_b)))).otherwise(F.array().cast(DIFF_TYPE))
    return F.concat(lists, turned)


def compare_vertex_traces(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Differences of two vertex traces, matched by (step, slot 0)."""
    return compare_copies(vertex_rows(a), vertex_rows(b), [scalar_rule("vec_id"), length_rule("vec", "nelements"), slots_rule("vec", tolerance)])


def compare_edge_traces(edges_a: DataFrame, edges_b: DataFrame, vertices_a: DataFrame, vertices_b: DataFrame) -> DataFrame:
    """Differences of two edge traces; rows and targets are matched through each copy's own vertices."""
    return compare_copies(edge_rows(edges_a, vertices_a), edge_rows(edges_b, vertices_b), [edges_rule])


def trace_differences(vertices_a: DataFrame, vertices_b: DataFrame, edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """All differences of two copies of a run: record, step, uid, status, diffs."""
    parts = (("vertex", compare_vertex_traces(vertices_a, vertices_b)), ("edge", compare_edge_traces(edges_a, edges_b, vertices_a, vertices_b)))
    shaped = [d.select(F.lit(r).alias("record"), F.col("k.step").alias("step"), F.col("k.uid").alias("uid"), "status", "diffs") for r, d in parts]
    return shaped[0].unionByName(shaped[1])


def difference_fields(differences: DataFrame) -> DataFrame:
    """One row per missing row or differing field: record, step, uid, field."""
    fields = F.when(F.col("status") == "differs", F.transform("diffs", lambda d: d["field"])).otherwise(F.array("status"))
    return differences.select("record", "step", "uid", F.explode(fields).alias("field"))


def compare_many(copies: dict[str, tuple[DataFrame, DataFrame]], against: str | None = None) -> DataFrame:
    """left, right, record, step, uid, status, diffs: the differences of several copies (name -> vertices, edges), each with
    each, or each with the one named ``against``. Missing rows are named by the copy's side, a for left and b for right."""
    names = sorted(copies)
    pairs = [(against, n) for n in names if n != against] if against is not None else [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = None
    for a, b in pairs:
        (va, ea), (vb, eb) = copies[a], copies[b]
        one = trace_differences(va, vb, ea, eb).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least two copies are needed")
    return out
