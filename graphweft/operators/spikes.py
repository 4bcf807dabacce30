"""Implausible spikes in measurements, per source, by state-space forecasting.

Each source (and field) is a local-level model on the logarithm of its readings: a Kalman filter runs over the source in
both directions, standardises every innovation with an observation variance that it learns from the readings it accepts,
withholds the readings whose standardised innovation is above the threshold, and takes a new level over only after
``relevel`` flagged readings in a row agree with each other (a lasting change of level isn't a spike). A reading is
reported as a spike if the forecasts from before and from after both reject it and both put it a factor of ``factor`` or
more away. Stuck values are where the innovation variance of a random-walk filter of the raw reading vanishes: over a
window of innovations it is nil, and the readings of the window, compared exactly, are the same.

Sources are cut into chunks of some ``chunk`` logged timesteps with a halo of at least ``halo`` logged timesteps on either
side, so that a source with a third of all rows spreads over many tasks. Both are counted in timesteps that hold a record,
however far apart they are: which of 64 neighbouring timesteps a source has is a bit mask, aggregated before its shuffle, and
running sums of the masks' bits in two levels (4096 masks, then their sums) number them. Repeated deliveries are dropped
when a chunk is gathered. Inside a task the filter runs over many chunks at once as numpy vectors, one step per position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stands for the logarithm of a reading of zero.
LOG_ZERO = float(np.log(1e-6))


@dataclass(frozen=True)
class SpikeSettings:
    """``factor``: how many times too large or small a spike is. ``threshold``: standardised innovation above which an
    update is withheld. ``drift``: variance the level gains per record. ``noise``, ``least_noise``: first and least
    observation variance; the largest is (ln factor / threshold)^2, and an innovation of ln factor is withheld whatever the
    variance of level and noise together, so a spike is never within the noise. ``relevel``:
    agreeing flagged readings in a row that make a new level. ``stuck``: equal readings in a row that are a fault."""

    factor: float = 5.0
    threshold: float = 6.0
    drift: float = 4e-4
    noise: float = 0.01
    least_noise: float = 4e-4
    relevel: int = 6
    stuck: int = 6
    start: int = 11
    chunk: int = 1024
    halo: int = 64


def kalman_pass(y: np.ndarray, s: SpikeSettings) -> tuple[np.ndarray, np.ndarray]:
    """One direction over ``y`` (positions x series, NaN: no reading): the forecast level of each reading, and whether the
    filter rejects it."""
    steps, n = y.shape
    level = np.full(n, np.nan)
    head = np.full((s.start, n), np.nan)
    filled = np.zeros(n, dtype=np.int64)
    for row in y:  # the first readings of each series, for a start that a spike can't upset
        use = ~np.isnan(row) & (filled < s.start)
        head[filled[use], np.nonzero(use)[0]] = row[use]
        filled += use
        if (filled >= s.start).all():
            break
    some = filled > 0
    level[some] = np.nanmedian(head[:, some], axis=0)
    most = (np.log(s.factor) / s.threshold) ** 2
    p, r = np.full(n, 4 * s.noise), np.full(n, s.noise)
    run, run_level = np.zeros(n), np.zeros(n)
    forecast, rejected = np.full(y.shape, np.nan), np.zeros(y.shape, dtype=bool)
    near, far = np.log(2.5), np.log(s.factor) - 1e-9
    for t in range(steps):
        row = y[t]
        have = ~np.isnan(row)
        p = p + s.drift
        forecast[t] = level
        innovation = np.where(have, row - level, 0.0)
        var = p + r
        bad = have & ((np.abs(innovation) > s.threshold * np.sqrt(var)) | (np.abs(innovation) >= far))
        rejected[t] = bad
        good = have & ~bad
        gain = np.where(good, p / var, 0.0)
        level = level + gain * innovation
        p = np.minimum(p * (1 - gain), 1.0)
        r = np.where(good, np.clip(0.95 * r + 0.05 * innovation * innovation, s.least_noise, most), r)
        agrees = bad & (run > 0) & (np.abs(row - run_level) < near)
        run = np.where(agrees, run + 1, np.where(bad, 1.0, np.where(good, 0.0, run)))
        run_level = np.where(agrees, run_level + (row - run_level) / np.maximum(run, 1), np.where(bad, row, run_level))
        moved = run >= s.relevel
        if moved.any():
            level, p, run = np.where(moved, run_level, level), np.where(moved, r, p), np.where(moved, 0.0, run)
    return forecast, rejected


def spikes_of(log_values: np.ndarray, series: np.ndarray, s: SpikeSettings) -> np.ndarray:
    """Which readings are spikes. ``log_values``: (readings x fields), NaN for those that can't be judged; ``series``:
    ascending series number of each reading, readings in time order."""
    found = np.zeros(log_values.shape, dtype=bool)
    if not len(series):
        return found
    first = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
    length = np.diff(np.r_[first, len(series)])
    order = np.argsort(length, kind="stable")
    far = np.log(s.factor) - 1e-9
    k = log_values.shape[1]
    at = 0
    while at < len(order):
        longest_allowed = max(int(length[order[at]] * 1.25), 64)
        upto = min(at + 2048, int(np.searchsorted(length[order], longest_allowed, side="right")))
        block = order[at : max(upto, at + 1)]
        at += len(block)
        n, steps = len(block), int(length[block].max())
        pos = np.arange(steps)[:, None]
        there = pos < length[block][None, :]
        index = np.where(there, first[block][None, :] + pos, 0)
        y = np.where(there[:, :, None], log_values[index], np.nan).reshape(steps, n * k)
        ahead, bad_ahead = kalman_pass(y, s)
        # backwards, each series is shifted to its end first
        back_pos = length[block][None, :] - 1 - pos
        back_index = np.where(there, first[block][None, :] + back_pos, 0)
        z = np.where(there[:, :, None], log_values[back_index], np.nan).reshape(steps, n * k)
        behind_r, bad_r = kalman_pass(z, s)
        put = np.where(there, back_pos, 0)
        behind, bad_behind = (np.take_along_axis(x.reshape(steps, n, k), put[:, :, None], axis=0) for x in (behind_r, bad_r))
        ahead, bad_ahead, y3 = ahead.reshape(steps, n, k), bad_ahead.reshape(steps, n, k), y.reshape(steps, n, k)
        hit = bad_ahead & bad_behind & (np.abs(y3 - ahead) >= far) & (np.abs(y3 - behind) >= far)
        found[index[there]] = hit[there]
    return found


def stuck_of(values: np.ndarray, series: np.ndarray, least: int) -> np.ndarray:
    """Which readings are one of ``least`` or more equal ones in a row. A random-walk filter without observation noise
    forecasts each reading by the one before; where the variance of its last ``least`` - 1 innovations, relative to the
    readings, vanishes, the readings of the window are stuck if they are exactly equal. Null (NaN) readings end a row."""
    out = np.zeros(values.shape, dtype=bool)
    n, window = len(series), least - 1
    if n < least:
        return out
    inside = np.r_[False, series[1:] == series[:-1]]
    for f in range(values.shape[1]):
        x = values[:, f]
        before = np.r_[np.nan, x[:-1]]
        with np.errstate(all="ignore"):
            innovation = np.where(x == before, 0.0, (x - before) / np.maximum(np.abs(x), np.abs(before)))
        innovation[~inside | np.isnan(innovation)] = np.inf
        variance = np.lib.stride_tricks.sliding_window_view(np.square(innovation), window).mean(axis=1)
        ends = np.flatnonzero(variance < 1e-20) + window - 1
        same = np.cumsum(np.r_[0, inside & (x == before)])
        ends = ends[same[ends + 1] - same[ends + 1 - window] == window]
        marks = np.zeros(n + 1, dtype=np.int64)
        np.add.at(marks, ends - window, 1)
        np.add.at(marks, ends + 1, -1)
        out[:, f] = np.cumsum(marks)[:-1] > 0
    return out


def _judge(batch: pa.RecordBatch, fields: Sequence[str], total: str, idle: str, s: SpikeSettings) -> pa.RecordBatch:
    lists = batch.column(0)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    number = lambda name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: E731  nulls become NaN
    step, record = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("timestep", "record_id"))
    order = np.lexsort((record, step, owner))
    owner, step, record = owner[order], step[order], record[order]
    keep = np.r_[True, (owner[1:] != owner[:-1]) | (step[1:] != step[:-1]) | (record[1:] != record[:-1])][: len(order)]
    order, owner, record = order[keep], owner[keep], record[keep]
    core = flat.field("core").to_numpy(zero_copy_only=False).astype(bool)[order]
    x = np.column_stack([number(f)[order] for f in fields])
    null = np.column_stack([np.asarray(flat.field(f).is_null(nan_is_null=False))[order] for f in fields])
    quiet = (number(idle)[order] == 0)[:, None] & np.array([f != total for f in fields])[None, :]
    finite = np.isfinite(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(finite & (x >= 0) & ~quiet, np.maximum(np.log(np.where(x > 0, x, 1.0)), LOG_ZERO), np.nan)
        logs = np.where(x == 0, np.where(quiet, np.nan, LOG_ZERO), logs)
    case = ~null & (~finite | (x < 0))
    if total in fields:
        whole = x[:, fields.index(total)]
        sound = np.isfinite(whole) & (whole >= 0)
        for j, f in enumerate(fields):
            if f != total:
                case[:, j] |= ~null[:, j] & sound & (x[:, j] > whole)
    case |= spikes_of(logs, owner, s) & ~null
    case |= stuck_of(x, owner, s.stuck) & ~null & ~quiet
    hit = case & core[:, None]
    row, col = np.nonzero(hit)
    return pa.record_batch([pa.array(record[row], pa.int64()), pa.array(np.array(fields, dtype=object)[col], pa.string())], names=["record_id", "field"])


def _chunks(placed: DataFrame, source: Sequence[str], s: SpikeSettings) -> DataFrame:
    """source..., bucket, at: the chunks that the 64 timesteps of a bucket go to, and whether they are of the chunk's core
    or its halo. A bucket is whole in one core; it is in the halo of the chunk before (after) if fewer than ``halo`` logged
    timesteps lie between."""
    mask = F.bit_or(F.expr("shiftleft(1L, timestep & 63)"))
    buckets = placed.groupBy(*source, "bucket").agg(F.bit_count(mask).alias("n")).withColumn("block", F.shiftright("bucket", 12))
    earlier = Window.partitionBy(*source).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = buckets.groupBy(*source, "block").agg(F.sum("n").alias("all")).select(*source, "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy(*source, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ended = buckets.join(blocks, [*source, "block"]).withColumn("end", F.col("base") + F.sum("n").over(within)).withColumn("begin", F.col("end") - F.col("n"))
    whole = Window.partitionBy(*source, "chunk")
    numbered = ended.withColumn("chunk", F.floor(F.col("begin") / s.chunk)).withColumn("first", F.min("begin").over(whole)).withColumn("last", F.max("end").over(whole))
    to = lambda step, core: F.struct((F.col("chunk") + step).alias("chunk"), F.lit(core).alias("core"))
    spread = F.array_compact(F.array(to(0, True), F.when(F.col("begin") < F.col("first") + s.halo, to(-1, False)), F.when(F.col("end") > F.col("last") - s.halo, to(1, False))))
    return numbered.select(*source, "bucket", spread.alias("spread"))


def find_spikes(readings: DataFrame, fields: Sequence[str] = ("total", "edges", "neighbor_updates"), source: Sequence[str] = ("run_id", "pe"), total: str = "total", idle: str = "nneighbors", settings: SpikeSettings = SpikeSettings()) -> DataFrame:
    """The readings of ``fields`` that can't be right: (record_id, field), one row each.

    A reading is one if it is negative, infinite or NaN; if it is greater than a sound ``total`` of its record; if it is a
    spike; or if it is stuck. The last two don't apply to fields other than ``total`` while ``idle`` is 0. Defined cases:
    a null reading is never one and ends a row of stuck values; records delivered again are judged once; records without
    source or timestep belong to no series and are judged by the first two rules alone; those without a record_id can't be
    named and are left out; an empty table gives no rows. ``settings.chunk`` is at least 64, ``halo`` at least ``stuck``.
    """
    if settings.chunk < 64 or settings.halo < settings.stuck:
        raise ValueError("chunk is at least 64, halo at least the length of a stuck row")
    kept = readings.where(F.col("record_id").isNotNull()).select(*source, "timestep", "record_id", *[F.col(f).cast("double").alias(f) for f in fields], idle)
    has_place = F.col("timestep").isNotNull()
    for c in source:
        has_place &= F.col(c).isNotNull()
    placed = kept.where(has_place).withColumn("bucket", F.shiftright("timestep", 6))
    at = placed.join(_chunks(placed, source, settings), [*source, "bucket"]).withColumn("at", F.explode("spread"))
    rows = F.struct("timestep", "record_id", *fields, idle, F.col("at.core").alias("core"))
    series = at.groupBy(*source, F.col("at.chunk").alias("chunk")).agg(F.collect_set(rows).alias("rows")).select("rows")
    names = list(fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                yield _judge(b.slice(i, 1000), names, total, idle, settings)

    unsound = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    beyond = lambda f: F.col(f) > F.when(~unsound(F.col(total)), F.col(total)) if total in names and f != total else F.lit(False)
    cases = F.array_compact(F.array(*[F.when(unsound(F.col(f)) | F.coalesce(beyond(f), F.lit(False)), F.lit(f)) for f in names]))
    alone = kept.where(~has_place).select("record_id", F.explode(cases).alias("field"))
    return series.mapInArrow(judge, "record_id long, field string").unionByName(alone).distinct()
