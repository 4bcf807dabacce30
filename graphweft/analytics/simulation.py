"""Step-indexed simulations: epidemics on moving actors and on a grid, particles, agents in patches, and small dynamics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.scalars import bites, infection_probability, moore_neighborhood, move_toward, uniform, wrap
from graphweft.operators.neighbors import khop
from graphweft.operators.rangejoin import range_join
from graphweft.session import cut


def epidemic(actors: DataFrame, steps: int, radius: float, dim: tuple[float, float] | None = None) -> DataFrame:
    """step, actor, px, py, infected for steps 0 .. ``steps``, from actors(actor, px, py, infected, dst_x, dst_y).

    At t + 1 an actor is infected if it was, or if an infected actor's position one step back (at 0: its start) lies within
    ``radius`` of where it itself was; then it moves toward its destination. Actors with null or NaN positions keep
    themselves and infect no one."""
    now = cut(actors.select("actor", "px", "py", F.col("px").alias("qx"), F.col("py").alias("qy"), F.coalesce(F.col("infected").cast("int"), F.lit(0)).alias("infected"), "dst_x", "dst_y"))
    out = now.select(F.lit(0).alias("step"), "actor", "px", "py", "infected")
    for t in range(steps):
        ill = now.where("infected = 1").select(F.col("qx").alias("px"), F.col("qy").alias("py"))
        caught = range_join(ill, now.where("infected = 0").select("actor", "px", "py"), ["px", "py"], radius).select(F.col("b.actor").alias("actor")).distinct().withColumn("hit", F.lit(1))
        nx, ny = move_toward((F.col("px"), F.col("py")), (F.col("dst_x"), F.col("dst_y")), dim)
        now = cut(now.join(caught, "actor", "left").select("actor", nx.alias("nx"), ny.alias("ny"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.greatest("infected", F.coalesce("hit", F.lit(0))).alias("infected"), "dst_x", "dst_y").withColumnsRenamed({"nx": "px", "ny": "py"}))
        out = out.unionByName(now.select(F.lit(t + 1).alias("step"), "actor", "px", "py", "infected"))
    return out


def grid_adjacency(cells: DataFrame, width: int, height: int) -> DataFrame:
    """src, dst of a grid's four-neighbourhood, from cells(id) with id = row * width + col."""
    row, col = F.expr(f"id div {width}"), F.expr(f"id % {width}")
    near = F.array_compact(F.array(F.when(row > 0, F.col("id") - width), F.when(row < height - 1, F.col("id") + width), F.when(col > 0, F.col("id") - 1), F.when(col < width - 1, F.col("id") + 1)))
    return cells.select(F.col("id").alias("src"), F.explode(near).alias("dst"))


def grid_epidemic(spark, side: int) -> DataFrame:
    """id, step: when the infection that starts in cell 0 reaches each cell of a side x side grid."""
    cells = spark.range(side * side)
    return khop(grid_adjacency(cells, side, side), cells.where("id = 0"), 2 * side).withColumnRenamed("dist", "step")


def nbody(particles: DataFrame, steps: int, radius: float = 10.0, domain: float = 100.0, most: float = 0.001) -> DataFrame:
    """t, id, px, py, vx, vy for t = 0 .. steps: particles(id, px, py, vx, vy) that pull each other within ``radius``.

    Per axis the pull of another particle is 1 / distance on that axis (none where it is 0); a pull longer than ``most`` is
    scaled to it, keeping its signs. Positions fold into the domain; the radius isn't measured across its border."""
    now = cut(particles.select("id", "px", "py", "vx", "vy"))
    out = now.select(F.lit(0).alias("t"), "id", "px", "py", "vx", "vy")
    for t in range(1, steps + 1):
        pairs = range_join(now.select("id", "px", "py"), now.select("id", "px", "py"), ["px", "py"], radius, strict=True, predicate=F.col("a.id") != F.col("b.id"))
        pull = lambda c: F.sum(F.when(F.col(f"b.{c}") != F.col(f"a.{c}"), 1 / (F.col(f"b.{c}") - F.col(f"a.{c}"))).otherwise(0.0))
        force = pairs.groupBy(F.col("a.id").alias("id")).agg(pull("px").alias("fx"), pull("py").alias("fy"))
        size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        capped = force.select("id", *[F.when(size > most, F.col(f) * most / size).otherwise(F.col(f)).alias(f) for f in ("fx", "fy")])
        moved = now.join(capped, "id", "left").select("id", "px", "py", (F.col("vx") + F.coalesce("fx", F.lit(0.0))).alias("vx"), (F.col("vy") + F.coalesce("fy", F.lit(0.0))).alias("vy"))
        now = cut(moved.select("id", wrap(F.col("px") + F.col("vx"), domain).alias("px"), wrap(F.col("py") + F.col("vy"), domain).alias("py"), "vx", "vy"))
        out = out.unionByName(now.select(F.lit(t).alias("t"), "id", "px", "py", "vx", "vy"))
    return out


@dataclass(frozen=True)
class PatchModel:
    """Rates of the vector-borne epidemic. ``alpha``: relative risk of being bitten by activity; ``substeps``: ODE steps to
    an agent step of ``dt_h`` days."""

    width: int = 64
    height: int = 64
    dt_h: float = 1 / 8
    substeps: int = 50
    alpha: tuple[float, ...] = (0.1, 0.6, 1.0, 0.4)
    psi_v: float = 0.3
    mu_v: float = 1 / 14
    nu_v: float = 0.1
    sigma_v: float = 0.5
    sigma_h: float = 19.0
    beta_hv: float = 0.24
    beta_vh: float = 0.33
    nu_h: float = 0.1
    mu_h: float = 1 / 6
    k_v: float = 1000.0
    stay: float = 1.0

    @property
    def dt_v(self) -> float:
        return self.dt_h / self.substeps


def mosquito_steps(s: np.ndarray, e: np.ndarray, i: np.ndarray, n: np.ndarray, ihh: np.ndarray, nhh: np.ndarray, m: PatchModel) -> tuple[np.ndarray, ...]:
    """The (S, E, I) compartments of many patches after the substeps of one agent step, by fourth-order Runge-Kutta.

    Compartments advance one after the other: E sees the new S, I the new E; the total is renewed after each substep. A
    patch without agents has no force of infection."""
    r_v = m.psi_v - m.mu_v
    for _ in range(m.substeps):
        with np.errstate(divide="ignore", invalid="ignore"):
            want, have = m.sigma_v * n, m.sigma_h * nhh
            got = np.where(want + have > 0, want * have / (want + have), 0.0)
            force = np.where((n > 0) & (nhh > 0), got / n * m.beta_hv * (ihh / nhh), 0.0)
        born = (m.psi_v - r_v * n / m.k_v) * n
        ks = [np.zeros_like(s)]
        for part in (0.0, 0.5, 0.5, 1.0):
            ks.append(m.dt_v * (born - (force + m.mu_v) * (s + part * ks[-1])))
        s_new = s + (ks[1] + 2 * (ks[2] + ks[3]) + ks[4]) / 6
        es = [np.zeros_like(s)]
        for part, k in zip((0.0, 0.5, 0.5, 1.0), ks):
            es.append(m.dt_v * (force * (s_new + part * k) - (m.nu_v + m.mu_v) * (e + part * es[-1])))
        e_new = e + (es[1] + 2 * (es[2] + es[3]) + es[4]) / 6
        js = [np.zeros_like(s)]
        for part, k in zip((0.0, 0.5, 0.5, 1.0), es):
            js.append(m.dt_v * (m.nu_v * (e_new + part * k) - m.mu_v * (i + part * js[-1])))
        i = i + (js[1] + 2 * (js[2] + js[3]) + js[4]) / 6
        s, e = s_new, e_new
        n = s + e + i
    return s, e, i, n


def patch_epidemic(patches: DataFrame, agents: DataFrame, steps: int, m: PatchModel = PatchModel(), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(patches, agents) after ``steps``: patches(patch_id, sv, ev, iv) and agents(agent_id, patch, home, health, activity,
    stay) with health 0 susceptible, 1 exposed, 2 infectious, 3 recovered.

    A step counts agents by patch (weighted by the risk of their activity), advances the patches' mosquitoes, lets agents
    catch, develop and recover, and moves those whose stay is over to a cell next to home with a new activity. All chance is
    a hash of agent, step and seed."""
    alpha = F.array(*[F.lit(float(a)) for a in m.alpha])
    pa_, ag = cut(patches.select("patch_id", "sv", "ev", "iv")), cut(agents)

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s, e, i, n = mosquito_steps(*[p[c].to_numpy(float) for c in ("sv", "ev", "iv")], (p["sv"] + p["ev"] + p["iv"]).to_numpy(float), p["ihh"].to_numpy(float), p["nhh"].to_numpy(float), m)
            yield pd.DataFrame({"patch_id": p["patch_id"], "sv": s, "ev": e, "iv": i, "nv": n, "nhh": p["nhh"]})

    for t in range(steps):
        risk = F.get(alpha, F.col("activity"))
        counts = ag.groupBy(F.col("patch").alias("patch_id")).agg(F.sum(risk).alias("nhh"), F.sum(F.when(F.col("health") == 2, risk).otherwise(0.0)).alias("ihh"))
        fed = pa_.join(counts, "patch_id", "left").na.fill(0.0, ["nhh", "ihh"])
        after = fed.mapInPandas(advance, "patch_id long, sv double, ev double, iv double, nv double, nhh double")
        b = bites(m.sigma_v * F.col("nv"), m.sigma_h * F.col("nhh"))
        force = F.when((F.col("nhh") > 0) & (F.col("nv") > 0), b / F.col("nhh") * m.beta_vh * F.col("iv") / F.col("nv")).otherwise(0.0)
        after = cut(after.withColumn("lambda_h", force))
        draw = lambda k: uniform("agent_id", F.lit(t), F.lit(seed), F.lit(k))
        j = ag.join(after.select(F.col("patch_id").alias("patch"), "lambda_h"), "patch", "left")
        catch = draw("catch") < infection_probability(F.coalesce("lambda_h", F.lit(0.0)) * risk, m.dt_h)
        health = F.when((F.col("health") == 0) & catch, 1).when((F.col("health") == 1) & (draw("turn") < 1 - np.exp(-m.dt_h * m.nu_h)), 2).when((F.col("health") == 2) & (draw("heal") < 1 - np.exp(-m.dt_h * m.mu_h)), 3).otherwise(F.col("health"))
        around = moore_neighborhood(F.expr(f"home div {m.width}"), F.expr(f"home % {m.width}"), m.width, m.height)
        goes = F.col("stay") <= m.dt_h
        there = F.get(around, F.floor(draw("where") * F.size(around)).cast("int"))
        ag = cut(j.select("agent_id", F.when(goes, there).otherwise(F.col("patch")).alias("patch"), "home", health.alias("health"), F.when(goes, F.floor(draw("what") * len(m.alpha)).cast("int")).otherwise(F.col("activity")).alias("activity"), F.when(goes, -F.log1p(-draw("stay")) * m.stay).otherwise(F.col("stay") - m.dt_h).alias("stay")))
        pa_ = after.select("patch_id", "sv", "ev", "iv")
    return pa_, ag


def chain_growth(spark, n: int, owners: int = 2) -> DataFrame:
    """id, owner: actors 0 and 1, and i + 2 for every actor i that has i + 1 as a neighbour, up to ``n`` of them.

    Each step joins the newest actors with their neighbours by id; the new ones belong to the owner of the one that made
    them."""
    rows = cut(spark.range(min(2, n)).select("id", (F.col("id") % owners).cast("int").alias("owner"), F.lit(False).alias("made")))
    while True:
        next_ids = rows.select((F.col("id") - 1).alias("id"))
        born = rows.where("not made").join(next_ids, "id", "left_semi").where(F.col("id") + 2 < n).select((F.col("id") + 2).alias("id"), "owner", F.lit(False).alias("made"))
        born = cut(born)
        if born.isEmpty():
            return rows.select("id", "owner")
        makers = born.select((F.col("id") - 2).alias("id"))
        rows = cut(rows.join(makers.withColumn("m", F.lit(True)), "id", "left").select("id", "owner", (F.col("made") | F.coalesce("m", F.lit(False))).alias("made")).unionByName(born))


def pursuit(spark, n: int) -> DataFrame:
    """actor, pos: where actor 0, that follows actor 1, and actor 1, that flees it, end on a line of ``n`` places. Each
    moves on by one for as long as the other is within two places."""
    state = spark.createDataFrame([(0, 0), (1, 1)], "actor int, pos long")
    from graphweft.operators.bsp import run_supersteps

    links = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    limit = F.lit(n - 2).cast("long") + F.col("id")
    done, _ = run_supersteps(state.withColumnRenamed("actor", "id"), links, F.col("s.pos"), F.max, {"pos": lambda o: F.when((F.abs(o - F.col("pos")) <= 2) & (F.col("pos") < limit), F.col("pos") + 1).otherwise(F.col("pos"))}, max_steps=n + 2, frontier_only=False)
    return done.withColumnRenamed("id", "actor")


def layered_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layer vertices, layer edges): a vertex in the layer for each base vertex, and edges that mirror the base's.

    vertices: id, layer_id. Base edges are sent as messages to the layer through both ends' layer ids."""
    ids = vertices.select("id", "layer_id")
    e = edges.join(ids.select(F.col("id").alias("src"), F.col("layer_id").alias("ls")), "src").join(ids.select(F.col("id").alias("dst"), F.col("layer_id").alias("ld")), "dst")
    return ids.select(F.col("layer_id").alias("id")), e.select(F.col("ls").alias("src"), F.col("ld").alias("dst"), "dir")


def pi_estimate(spark, n: int, seed: int = 0) -> DataFrame:
    """pi: four times the share of ``n`` hashed points that fall into the unit circle."""
    x, y = (uniform("id", F.lit(seed), F.lit(a)) for a in "xy")
    return spark.range(n).agg((4 * F.count_if(x * x + y * y <= 1) / F.lit(n)).alias("pi"))
