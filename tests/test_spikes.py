import math
import random

import numpy as np

from graphweft.operators import spikes as S

SCHEMA = "record_id long, run_id int, pe int, timestep int, total double, edges double, neighbor_updates double, nneighbors int, rows string, received_at long"


def record(i, t, total=100.0, edges=10.0, nu=5.0, n=3, run=1, pe=0):
    return (i, run, pe, t, total, edges, nu, n, "clash", i)


def found(spark, rows, **settings):
    return set(map(tuple, S.find_spikes(spark.createDataFrame(rows, SCHEMA), settings=S.SpikeSettings(**settings)).collect()))


def series(n, seed=1, level=lambda t: 100.0, **kw):
    rnd = random.Random(seed)
    return [record(1000 * kw.get("run", 1) + t, t, level(t) * rnd.uniform(0.9, 1.1), level(t) * rnd.uniform(0.09, 0.11), level(t) * rnd.uniform(0.04, 0.06), **kw) for t in range(n)]


def change(rows, t, **values):
    names = ("record_id", "run_id", "pe", "timestep", "total", "edges", "neighbor_updates", "nneighbors")
    rows[t] = tuple(values.get(n, v) for n, v in zip(names, rows[t])) + rows[t][8:]


def test_kinds_of_cases(spark):
    rows = series(120)
    change(rows, 10, total=1000.0)
    change(rows, 20, total=-1.0)
    change(rows, 30, edges=math.inf)
    change(rows, 40, neighbor_updates=math.nan)
    change(rows, 50, edges=150.0)
    change(rows, 60, total=None, edges=None)
    change(rows, 70, edges=0.5)
    for t in range(80, 86):
        change(rows, t, total=101.5)
    rows += [r[:9] + (9999,) for r in rows[8:12]]  # delivered again
    want = {(1010, "total"), (1020, "total"), (1030, "edges"), (1040, "neighbor_updates"), (1050, "edges"), (1070, "edges")} | {(1000 + t, "total") for t in range(80, 86)}
    assert found(spark, rows) == want


def test_lasting_levels_and_quiet_sources_are_no_cases(spark):
    rows = series(100, level=lambda t: 100.0 if t < 50 else 1500.0)
    quiet = [record(5000 + t, t, 100.0 + t % 7, 0.0, 0.0, n=0, run=2) for t in range(40)]
    five = series(40, run=3)
    for t in range(10, 15):
        change(five, t, total=77.0)
    assert found(spark, rows + quiet + five) == set()


def test_chunks_give_the_same(spark):
    rows = series(700)
    for t in (5, 99, 100, 101, 255, 256, 640):
        change(rows, t, total=2000.0)
    for t in range(253, 260):
        change(rows, t, edges=12.0)
    assert found(spark, rows, chunk=128, halo=40) == found(spark, rows) == {(1000 + t, "total") for t in (5, 99, 100, 101, 255, 256, 640)} | {(1000 + t, "edges") for t in range(253, 260)}


def test_empty_and_null_keys(spark):
    assert found(spark, []) == set()
    assert found(spark, [record(None, 1), record(1, None), record(2, 3, run=None)]) == set()


def test_records_without_a_place_are_judged_by_themselves(spark):
    rows = [record(1, None, total=-5.0), record(2, 3, run=None, edges=math.inf), record(3, None, total=4.0, edges=9.0), record(4, None, total=None), record(None, None, total=-1.0), record(5, None, total=math.nan, edges=1.0)]
    assert found(spark, rows + rows) == {(1, "total"), (2, "edges"), (3, "edges"), (3, "neighbor_updates"), (5, "total")}


def test_sparse_timesteps_give_the_same_in_chunks_of_any_size(spark):
    rows = [record(t, 100 * t, *[x * (1 + 0.01 * ((t * 7919) % 13)) for x in (100.0, 10.0, 5.0)]) for t in range(-300, 1100)]
    stuck = range(1018, 1025)
    for t in stuck:
        rows[t + 300] = record(t, 100 * t, total=101.5)
    change(rows, 363, total=900.0)
    want = {(t, "total") for t in stuck} | {(t, f) for t in stuck for f in ("edges", "neighbor_updates")} | {(63, "total")}
    for chunk in (64, 1024, 100_000):
        assert found(spark, rows, chunk=chunk) == want


def test_stuck_values_by_innovation_variance():
    x = np.array([[1.0], [1.0], [1.0], [1.0], [1.0], [1.0], [2.0], [3.0], [3.0], [3.0], [3.0], [3.0], [3.0 + 1e-12], [1e-200], [2e-200], [3e-200], [4e-200], [5e-200], [6e-200]])
    one = np.zeros(len(x), dtype=int)
    assert np.flatnonzero(S.stuck_of(x, one, 6)).tolist() == [0, 1, 2, 3, 4, 5]
    assert not S.stuck_of(x, np.arange(len(x)) // 4, 6).any() and not S.stuck_of(x[:3], one[:3], 6).any()


def test_a_spike_in_a_noisy_source_after_a_gap():
    y = np.array([[0.27 * (-1) ** t if t < 40 or t >= 160 else math.nan] for t in range(200)])
    y[100] = math.log(5.9)
    assert np.flatnonzero(S.spikes_of(y, np.zeros(200, dtype=int), S.SpikeSettings())).tolist() == [100]
