"""Scalar functions as column expressions: hashes, random numbers, bits, movement, grids, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def djb2(text: Column) -> Column:
    """djb2 over the text's characters, as an unsigned 32-bit number."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def pairwise_hash(x: Column, a: int, b: int, width: int, prime: int = 4294967311) -> Column:
    """((a x + b) mod P) mod w, in decimals, so that no product overflows."""
    whole = lambda n: F.lit(n).cast("decimal(10,0)")
    return F.pmod(F.pmod(x.cast("decimal(20,0)") * whole(a) + whole(b), whole(prime)), whole(width)).cast("int")


def edge_key(a: Column, b: Column) -> Column:
    """The absolute difference of two ids as a 32-bit number."""
    d = (b - a).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.abs(F.when(d >= 2**31, d - 2**32).otherwise(d))


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys only: the first 13 hexadecimal digits of the md5 of their texts, joined by
    bars, so that any SQL engine can draw the same."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def lcg_next(state: Column) -> Column:
    """One step of the linear congruential generator, 32 bits."""
    return (state * 214013 + 2531011).bitwiseAND(F.lit(0xFFFFFFFF))


def lcg_draw(state: Column) -> tuple[Column, Column]:
    """(number, next state): two steps, 15 bits of each, the second above the first."""
    one = lcg_next(state)
    two = lcg_next(one)
    bits = lambda g: F.shiftright(g, 16).bitwiseAND(F.lit(0x7FFF))
    return F.shiftleft(bits(two), 32) + bits(one), two


def get_bit(matrix: Column, row: Column | int, col: Column | int, width: int = 4) -> Column:
    return matrix.bitwiseAND(set_mask(row, col, width)) != 0


def set_mask(row: Column | int, col: Column | int, width: int = 4) -> Column:
    at = (row if isinstance(row, Column) else F.lit(row)) * width + (col if isinstance(col, Column) else F.lit(col))
    return F.call_function("shiftleft", F.lit(1), at.cast("int"))


def pattern_distance(a: Column, b: Column) -> Column:
    """In how many places two adjacency matrices differ."""
    return F.bit_count(a.bitwiseXOR(b))


def pattern_edges(matrix: Column, width: int = 4) -> Column:
    """Edges of an adjacency matrix: bits of the lower triangle, the diagonal with it."""
    mask = sum(1 << (i * width + j) for i in range(width) for j in range(i + 1))
    return F.bit_count(matrix.bitwiseAND(F.lit(mask)))


def move_toward(p: tuple[Column, Column], dst: tuple[Column, Column], dim: tuple[float, float] | None = None, reach: float = 0.2) -> tuple[Column, Column]:
    """The next position: at most ``reach`` along the way to ``dst``, folded into the domain. An actor that has arrived (on
    either axis, to 1e-9) is at its destination and stays."""
    arrived = (F.abs(p[0] - dst[0]) < 1e-9) | (F.abs(p[1] - dst[1]) < 1e-9)
    x, y = (F.when(arrived, d).otherwise(q) for q, d in zip(p, dst))
    vx, vy = dst[0] - x, dst[1] - y
    length = F.sqrt(vx * vx + vy * vy) / reach
    out = []
    for at, v, i in ((x, vx, 0), (y, vy, 1)):
        unit = F.when(length > 0, v / length).otherwise(F.lit(0.0))
        new = at + F.when(F.abs(v) > F.abs(unit), unit).otherwise(v)
        out.append(wrap(new, dim[i]) if dim else new)
    return out[0], out[1]


def wrap(x: Column, dim: float) -> Column:
    """``x`` folded into [0, dim)."""
    return F.pmod(x, F.lit(float(dim)))


def cell_id(row: Column, col: Column, width: int) -> Column:
    return row * width + col


def moore_neighborhood(row: Column, col: Column, width: int, height: int) -> Column:
    """The ids of a cell's neighbours, itself included, clipped at the border."""
    rows = F.sequence(F.greatest(row - 1, F.lit(0)), F.least(row + 1, F.lit(height - 1)))
    cols = F.sequence(F.greatest(col - 1, F.lit(0)), F.least(col + 1, F.lit(width - 1)))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: r * width + c)))


def bites(demand: Column, supply: Column) -> Column:
    """d s / (d + s); 0 where both are 0."""
    return F.when(demand + supply > 0, demand * supply / (demand + supply)).otherwise(0.0)


def infection_probability(force: Column, dt: float) -> Column:
    return 1 - F.exp(-force * dt)


def checksum(text: Column) -> Column:
    return F.crc32(text)
