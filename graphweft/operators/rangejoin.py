"""Implicit edges: range, temporal and band self-joins pruned by grid cells.

A bare distance predicate plans as a nested loop over all pairs. Here each row is put in the cell of its coordinates (cells
at least a radius wide), the left side is repeated into the neighbouring cells, and an equi-join on the cell leaves only
candidates for the exact predicate. Only one side is repeated, so no pair comes twice. Rows with a null, NaN or infinite
coordinate are near nothing. A crowded cell splits under adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft import model
from graphweft.model import BI, IMPLICIT, OUT


@dataclass(frozen=True)
class Grid:
    """Cells of ``size`` over the coordinate columns; ``wrap``: the domain's width per axis if it closes on itself (a
    multiple of ``size``)."""

    columns: tuple[str, ...]
    size: float
    wrap: tuple[float, ...] | None = None

    def cell(self, row: Callable[[str], Column], axis: int, shift: Column | int = 0) -> Column:
        at = F.floor(row(self.columns[axis]) / F.lit(float(self.size))) + shift
        return F.pmod(at, F.lit(int(round(self.wrap[axis] / self.size)))) if self.wrap else at

    def part(self, row: Callable[[str], Column] = F.col, per_axis: int = 1_000_000) -> Column:
        """The partition number of a row: its cells in row-major order; null without usable coordinates."""
        out = F.lit(0).cast("long")
        for i in range(len(self.columns)):
            out = out * per_axis + self.cell(row, i)
        return out

    def usable(self, row: Callable[[str], Column] = F.col) -> Column:
        ok = F.lit(True)
        for c in self.columns:
            x = row(c).cast("double")
            ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        return ok


def squared_distance(a: Callable[[str], Column], b: Callable[[str], Column], columns: Sequence[str], wrap: Sequence[float] | None = None) -> Column:
    total = None
    for i, c in enumerate(columns):
        d = a(c) - b(c)
        if wrap:
            d = F.least(F.abs(d), F.lit(float(wrap[i])) - F.abs(d))
        total = d * d if total is None else total + d * d
    return total


def candidate_pairs(left: DataFrame, right: DataFrame, grid: Grid, equal: Sequence[tuple[Column, Column]] = ()) -> DataFrame:
    """Pairs (a struct, b struct) from equal or neighbouring cells that agree on ``equal`` (pairs of columns of a and b)."""
    axes = range(len(grid.columns))
    a = left.where(grid.usable()).select(F.struct(*left.columns).alias("a"))
    b = right.where(grid.usable()).select(F.struct(*right.columns).alias("b"))
    col = lambda side: (lambda c: F.col(side)[c])
    for i in axes:
        if grid.wrap and round(grid.wrap[i] / grid.size) < 3:  # neighbours on both sides would be the same cell
            near = F.sequence(F.lit(0), F.lit(int(round(grid.wrap[i] / grid.size)) - 1))
            a = a.select("*", F.explode(near).alias(f"c{i}"))
        else:
            a = a.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias(f"s{i}")).withColumn(f"c{i}", grid.cell(col("a"), i, F.col(f"s{i}"))).drop(f"s{i}")
        b = b.withColumn(f"d{i}", grid.cell(col("b"), i))
    on = F.lit(True)
    for i in axes:
        on = on & (F.col(f"c{i}") == F.col(f"d{i}"))
    for x, y in equal:
        on = on & (x == y)
    return a.join(b, on).select("a", "b")


def range_join(left: DataFrame, right: DataFrame, columns: Sequence[str], radius: float, equal: Sequence[tuple[Column, Column]] = (), strict: bool = False, wrap: Sequence[float] | None = None, predicate: Column | None = None) -> DataFrame:
    """Pairs (a, b) at most ``radius`` apart (``strict``: less). ``equal`` and ``predicate`` are over a.* and b.*."""
    grid = Grid(tuple(columns), float(radius), tuple(wrap) if wrap else None)
    pairs = candidate_pairs(left, right, grid, equal)
    d2 = squared_distance(lambda c: F.col("a")[c], lambda c: F.col("b")[c], columns, wrap)
    near = d2 < F.lit(float(radius) ** 2) if strict else d2 <= F.lit(float(radius) ** 2)
    return pairs.where(near if predicate is None else near & predicate)


def bucket_join(left: DataFrame, right: DataFrame, bucket: Callable[[Callable[[str], Column]], Column], interacting: Callable[[Column], Column], predicate: Column, equal: Sequence[tuple[Column, Column]] = ()) -> DataFrame:
    """Pairs (a, b) for which ``predicate`` (over a.* and b.*) holds and whose buckets may interact: ``interacting`` gives the
    array of buckets that a bucket may interact with, which counts both ways whichever side names the other. ``bucket`` makes
    a row's bucket from a function that gives its columns; rows whose bucket is null are in none."""
    col = lambda side: (lambda c: F.col(side)[c])
    a = left.select(F.struct(*left.columns).alias("a")).withColumn("ka", bucket(col("a"))).where("ka is not null")
    b = right.select(F.struct(*right.columns).alias("b")).withColumn("kb", bucket(col("b"))).where("kb is not null")
    same = F.lit(True)
    for x, y in equal:
        same = same & (x == y)
    one = a.withColumn("k", F.explode(F.array_distinct(interacting(F.col("ka"))))).join(b, (F.col("k") == F.col("kb")) & same)
    two = b.withColumn("k", F.explode(F.array_distinct(interacting(F.col("kb"))))).join(a, (F.col("k") == F.col("ka")) & same)
    only_two = two.where(~F.array_contains(interacting(F.col("ka")), F.col("kb")))
    return one.select("a", "b").unionByName(only_two.select("a", "b")).where(predicate)


def containment_edges(inside: DataFrame, places: DataFrame) -> DataFrame:
    """src, dst, dir: from each thing to the place it is in one step later, and from the place to the thing one step later.
    inside: id, t, place; places: id, t, place."""
    one = lambda x, y: x.select(F.col("id").alias("src"), (F.col("t") + 1).alias("t"), "place").join(y.select(F.col("id").alias("dst"), "t", "place"), ["t", "place"]).select("src", "dst", F.lit(OUT).cast("tinyint").alias("dir"))
    return one(inside, places).unionByName(one(places, inside))


def band_join(left: DataFrame, right: DataFrame, column: str, width: float, equal: Sequence[tuple[Column, Column]] = ()) -> DataFrame:
    """Pairs (a, b) whose ``column`` differs by at most ``width``."""
    return candidate_pairs(left, right, Grid((column,), float(width)), equal).where(F.abs(F.col("a")[column] - F.col("b")[column]) <= F.lit(float(width)))


def temporal_join(rows: DataFrame, time: str, columns: Sequence[str], radius: float, step: int = 1, strict: bool = False, later_columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs (a, b) with b exactly one ``step`` later than a and near it: directed edges from earlier to later."""
    later = rows if later_columns is None else rows.select("*", *[F.col(x).alias(c) for c, x in zip(columns, later_columns) if x != c])
    pairs = range_join(rows.withColumn("_t", F.col(time) + step), later, columns, radius, [(F.col("a._t"), F.col(f"b.{time}"))], strict)
    return pairs.withColumn("dir", F.lit(OUT).cast("tinyint"))


def implicit_edges(vertices: DataFrame, columns: Sequence[str], radius: float, edge: Column | None = None, equal: Sequence[str] = (), self_edges: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Canonical implicit edges: pairs within ``radius`` (and equal in ``equal``) for which ``edge``, a direction over a.*
    and b.* as seen from a, isn't 0. ``only``: ids of which at least one end must be. Self pairs are candidates."""
    rows = vertices.where("part is not null") if "part" in vertices.columns else vertices
    left = rows if only is None else rows.join(only.select("id").distinct(), "id", "left_semi")
    pairs = range_join(left, rows, columns, radius, [(F.col("a")[c], F.col("b")[c]) for c in equal])
    if only is None:
        pairs = pairs.where("a.id < b.id" if not self_edges else "a.id <= b.id")
    elif not self_edges:
        pairs = pairs.where("a.id <> b.id")
    direction = (edge if edge is not None else F.lit(BI)).cast("tinyint")
    flat = pairs.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), direction.alias("dir"), F.lit(IMPLICIT).cast("tinyint").alias("kind")).where("dir <> 0")
    return model.canonical_edges(flat) if only is not None else flat


def refresh_edges(edges: DataFrame, vertices: DataFrame, changed: DataFrame, columns: Sequence[str], radius: float, **how) -> DataFrame:
    """Implicit edges after the vertices of ``changed`` (column id) moved, appeared or went: edges that touch none of them
    stay as they are, the others are derived again. Explicit edges stay."""
    ids = changed.select("id").distinct()
    touched = edges.where(F.col("kind") == IMPLICIT)
    kept = touched.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns)
    fresh = implicit_edges(vertices, columns, radius, only=ids, **how)
    return kept.unionByName(edges.where(F.col("kind") != IMPLICIT)).unionByName(fresh.select(edges.columns))
