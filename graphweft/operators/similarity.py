"""Radius search of a stated query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries and rows that a task holds at once, about.
QUERY_BLOCK, ROW_BLOCK = 4096, 65_536


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def radius_search(queries: DataFrame, rows: DataFrame, key: str, vector: str, radius: float) -> DataFrame:
    """query, key, for rows other than the query itself at most ``radius`` (Euclidean) from it.

    In many dimensions cells prune nothing, so blocks of queries are held against blocks of rows by matrix products, each
    pair of blocks in a task of its own: a query travels once per block of rows and a row once per block of queries. Only
    the two numbers of blocks reach the driver. Null vectors, vectors with null entries and those of another length than
    the query's match nothing."""
    clean = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    q, r = (x.where(clean & F.col(key).isNotNull()).select(key, F.col(vector).alias("vector"), F.size(vector).alias("size")) for x in (queries, rows))
    n_q, n_r = -(-q.count() // QUERY_BLOCK) or 1, -(-r.count() // ROW_BLOCK) or 1
    block = lambda n, salt: F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", block(n_q, "q")).withColumn("rb", each(n_r))
    right = r.withColumn("rb", block(n_r, "r")).withColumn("qb", each(n_q))
    q_type, r_type = (to_arrow_type(x.schema[key].dataType) for x in (q, r))

    def search(qs: pa.Table, rs: pa.Table) -> pa.Table:
        found = []
        for n in set(qs["size"].to_pylist()) & set(rs["size"].to_pylist()) if qs.num_rows and rs.num_rows else ():
            a, b = (x.filter(pa.compute.equal(x["size"], n)) for x in (qs, rs))
            u, v = _matrix(a["vector"]), _matrix(b["vector"])
            ids, own = (x[key].to_numpy() for x in (a, b))
            for i in range(0, len(v), 2000):
                # candidates by the expanded form, then the exact distance
                x = v[i : i + 2000]
                d2 = (u * u).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * u @ x.T
                at, to = np.nonzero(d2 <= radius * radius * (1 + 1e-9) + 1e-9)
                exact = np.sqrt(((u[at] - x[to]) ** 2).sum(1)) <= radius
                keep = exact & (ids[at] != own[i + to])
                found.append((ids[at][keep], own[i + to][keep]))
        at, to = ([f[j] for f in found] for j in (0, 1))
        join = lambda xs, like: pa.array(np.concatenate(xs) if xs else [], like)
        return pa.table({"query": join(at, q_type), key: join(to, r_type)})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(search, f"query {q.schema[key].dataType.simpleString()}, `{key}` {r.schema[key].dataType.simpleString()}")
