"""The graph as DataFrames: vertices(id, owner, part, created, attributes...) and edges(src, dst, dir, kind).

Ids hold the owner above and an offset below 32 bits and stay under 2^61. An edge's direction is as seen from ``src``. Edges
are stored once, canonically (src <= dst); :func:`adjacency` gives the view from both ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import cut

#: Fixed codes of direction and kind.
NO_EDGE, IN, OUT, BI = 0, 1, 2, 3
IMPLICIT, EXPLICIT = 0, 1
ID_BITS, DIR_BITS = 61, 2


def make_id(owner: Column, offset: Column) -> Column:
    """The id of the owner's vertex at ``offset``."""
    return F.shiftleft(owner.cast("long"), 32).bitwiseOR(offset.cast("long"))


def owner_of(vertex: Column) -> Column:
    return F.shiftright(vertex, 32).cast("int")


def offset_of(vertex: Column) -> Column:
    return vertex.bitwiseAND(F.lit(0xFFFFFFFF))


def flip(direction: Column) -> Column:
    """The direction as seen from the other end: in becomes out, both stays."""
    return (direction.bitwiseAND(1) * 2 + F.shiftright(direction.cast("int"), 1)).cast("tinyint")


def pack_edge(vertex: Column, kind: Column, direction: Column) -> Column:
    """One long of a neighbour's id (61 bits), the edge's kind (1 bit) and direction (2 bits)."""
    return F.shiftleft(direction.cast("long"), 62).bitwiseOR(F.shiftleft(kind.cast("long"), 61)).bitwiseOR(vertex)


def unpack_edge(word: Column) -> tuple[Column, Column, Column]:
    """(vertex, kind, direction) of a packed edge."""
    return word.bitwiseAND(F.lit(2**ID_BITS - 1)), F.shiftrightunsigned(word, 61).bitwiseAND(1).cast("tinyint"), F.shiftrightunsigned(word, 62).cast("tinyint")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices)

    def adjacency(self) -> DataFrame:
        return adjacency(self.edges)


def create_vertices(rows: DataFrame, owner: Column | None = None, first: int = 0, created: int = 0, part: Column | None = None) -> DataFrame:
    """``rows`` as vertices with new ids, dense from ``first`` within each owner.

    Numbers are given per owner and input partition and shifted by what the partitions before hold, so an owner with a
    third of all rows isn't numbered by one task. The result is cut, as numbering must not be done twice."""
    own = rows.withColumn("owner", (owner if owner is not None else F.lit(0)).cast("int")).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    own = cut(own)
    sizes = own.groupBy("owner", "_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("owner").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("owner", "_p").orderBy("_m")) - 1 + F.col("_before") + first
    numbered = own.join(sizes, ["owner", "_p"]).withColumn("id", make_id(F.col("owner"), place))
    names = [c for c in rows.columns if c not in ("id", "owner", "part", "created")]
    return numbered.select("id", "owner", (part if part is not None else F.lit(None)).cast("long").alias("part"), F.lit(created).alias("created"), *names)


def vertices_before(vertices: DataFrame, step: int) -> DataFrame:
    """The scan of a step: vertices created in earlier ones."""
    return vertices.where(F.col("created") < step)


def vertex_by_id(vertices: DataFrame, vertex: int) -> DataFrame:
    return vertices.where(F.col("id") == vertex)


def vertices_in_part(vertices: DataFrame, part: int) -> DataFrame:
    return vertices.where(F.col("part") == part)


def count_by_owner(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("owner").agg(F.count("*").alias("n"))


def changed(new: Column, old: Column) -> Column:
    """Whether setting ``new`` over ``old`` is a change; null and NaN equal themselves."""
    return ~new.eqNullSafe(old)


def equal_vertices(left: DataFrame, right: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """id, same: whether all attributes of the vertices with one id agree."""
    r = right.select(F.col("id"), F.struct(*attributes).alias("_r"))
    return left.select("id", F.struct(*attributes).alias("_l")).join(r, "id").select("id", F.col("_l").eqNullSafe(F.col("_r")).alias("same"))


def add_vertices(left: DataFrame, right: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Element-wise sum of the attributes of vertices with one id; a side that lacks the id adds nothing."""
    both = left.select("id", *attributes).unionByName(right.select("id", *attributes))
    return both.groupBy("id").agg(*[F.sum(a).alias(a) for a in attributes])


def vertex_text(attributes: Sequence[str]) -> Column:
    """``0: %f, 1: %f, ...`` of the attributes; null ones are left out."""
    return F.concat_ws(", ", *[F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{i}: "), F.format_string("%f", F.col(a).cast("double")))) for i, a in enumerate(attributes)])


def canonical_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Edges once each with src <= dst, direction flipped where the ends were; the last written (by ``order``) of a pair
    stands, without an order the directions of its writings are joined. Rows with a null end are left out."""
    turn = F.col("src") > F.col("dst")
    kind = F.col("kind") if "kind" in edges.columns else F.lit(EXPLICIT)
    direction = F.col("dir").cast("tinyint") if "dir" in edges.columns else F.lit(BI).cast("tinyint")
    flat = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.when(turn, flip(direction)).otherwise(direction).alias("dir"), kind.cast("tinyint").alias("kind"), *([F.col(order).alias("_o")] if order else []))
    if order:
        return flat.groupBy("src", "dst").agg(F.max(F.struct("_o", "dir", "kind")).alias("_l")).select("src", "dst", "_l.dir", "_l.kind")
    return flat.groupBy("src", "dst").agg(F.bit_or("dir").cast("tinyint").alias("dir"), F.max("kind").alias("kind"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, dir, kind from both ends, self edges once. One pass: no second read of the edges."""
    one = F.struct("src", "dst", "dir", "kind")
    two = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), flip(F.col("dir")).alias("dir"), "kind")
    return edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array(one)).otherwise(F.array(one, two))).alias("e")).select("e.*")


def delete_vertices(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without the vertices of ``gone`` (column id) and without the edges that touch them."""
    ids = gone.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.vertices.join(ids, "id", "left_anti"), edges.select(graph.edges.columns))


def map_vertices(vertices: DataFrame, **new: Column) -> DataFrame:
    """The vertices with attributes set anew; others and ids stay."""
    return vertices.withColumns(new)


def apply_updates(vertices: DataFrame, updates: DataFrame) -> DataFrame:
    """The vertices with those of ``updates`` (the same columns, an id at most once) put in place of the ones with their ids,
    or added."""
    return vertices.join(updates.select("id"), "id", "left_anti").select(vertices.columns).unionByName(updates.select(vertices.columns))


def upsert_edges(edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, active) after ``changes`` (src, dst, dir; of one pair at most one): an edge is made, or takes the direction
    given, or goes if that is 0. Explicit edges neither go nor turn. active: the ids of ends for which whether the edge comes
    in has changed."""
    new = canonical_edges(changes).select("src", "dst", F.col("dir").alias("new_dir"), F.lit(True).alias("asked"))
    both = edges.join(new, ["src", "dst"], "full_outer")
    fixed = F.coalesce(F.col("kind") == EXPLICIT, F.lit(False))
    after = F.when(F.col("asked") & ~fixed, F.col("new_dir")).otherwise(F.col("dir"))
    told = both.select("src", "dst", F.coalesce("dir", F.lit(NO_EDGE).cast("tinyint")).alias("old"), after.alias("dir"), F.coalesce("kind", F.lit(IMPLICIT).cast("tinyint")).alias("kind"))
    inward = lambda d: F.col(d).bitwiseAND(1) != 0
    outward = lambda d: F.col(d).bitwiseAND(2) != 0
    ends = F.array_compact(F.array(F.when(inward("old") != inward("dir"), F.col("src")), F.when(outward("old") != outward("dir"), F.col("dst"))))
    return told.where(F.col("dir") != NO_EDGE).select("src", "dst", "dir", "kind"), told.select(F.explode(ends).alias("id")).distinct()


def add_explicit_edges(graph: Graph, new: DataFrame) -> Graph:
    """The graph with the edges of ``new`` (src, dst, dir). An edge that is there stays as it is; the base vertex of an
    explicit edge must not be in a partition."""
    wrong = new.join(graph.vertices.where("part is not null").select(F.col("id").alias("src")), "src", "left_semi")
    if not wrong.isEmpty():
        raise ValueError("explicit edges from vertices that are in a partition")
    fresh = canonical_edges(new).withColumn("kind", F.lit(EXPLICIT).cast("tinyint"))
    return graph.with_edges(graph.edges.unionByName(fresh.join(graph.edges, ["src", "dst"], "left_anti").select("src", "dst", "dir", "kind")))
