import pytest

from graphweft.plans import tables


def test_throughput_takes_every_pe(spark, tmp_path):
    inf = float("inf")
    rows = [(1, 1, 0, 0, 4.0, 10), (2, 1, 0, 1, 6.0, 20), (3, 1, 1, 0, 5.0, 30), (4, 1, 1, 2, 8.0, 40), (4, 1, 1, 2, 8.0, 40), (5, 1, 1, 3, inf, 50), (6, 2, 7, 0, 2.0, 60), (7, 1, 2, 0, None, 70)]
    spark.createDataFrame(rows, "record_id long, run_id int, pe int, timestep int, total double, nneighbors long").write.parquet(str(tmp_path / "perf_records.parquet"))
    got = sorted(map(tuple, tables.throughput_summary(spark, str(tmp_path)).collect()))
    assert got == [(1, 14.0, 100, pytest.approx(4000 / 23, abs=1e-6)), (2, 2.0, 60, 500.0)]


def test_ranks_converge(spark, tmp_path):
    edges = [(0, 1), (1, 2), (2, 0), (3, 0), (0, 1), (0, 3)]
    keys = [(k, k) for k in range(4)]
    for name, rows, schema in [
        ("lineitem", [(i, s) for i, (s, _) in enumerate(edges)], "l_orderkey int, l_suppkey int"), ("orders", [(i, c) for i, (_, c) in enumerate(edges)], "o_orderkey int, o_custkey int"),
        ("customer", keys, "c_custkey int, c_nationkey int"), ("supplier", keys, "s_suppkey int, s_nationkey int"), ("nation", [(k, f"n{k}") for k, _ in keys], "n_nationkey int, n_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = dict(map(tuple, tables.rank_names(spark, str(tmp_path)).collect()))
    links, rank = set(edges), [0.25] * 4
    for _ in range(500):
        rank = [0.15 / 4 + 0.85 * sum(rank[s] / sum(x == s for x, _ in links) for s, d in links if d == k) for k in range(4)]
    assert got == {f"n{k}": pytest.approx(rank[k], abs=2e-4) for k in range(4)}
