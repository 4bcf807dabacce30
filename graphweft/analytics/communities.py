"""Cliques and clique-percolation communities, frequent subgraph patterns and their anomalies, graph convolution."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.scalars import pattern_distance, pattern_edges
from graphweft.operators.bsp import connected_components
from graphweft.operators.neighbors import oriented, triangles
from graphweft.operators.rangejoin import range_join
from graphweft.session import cut


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """members: every k-clique once, as its vertices in order (k >= 2).

    Grows cliques along edges oriented by degree; a candidate must be joined to every member. Each extension is an equi-join
    on the last member and semi joins on the others."""
    o = cut(oriented(edges))
    grown = o.select(F.array("lo", "hi").alias("m"))
    for size in range(2, k):
        step = grown.withColumn("lo", F.element_at("m", -1)).join(o, "lo").select("m", F.col("hi").alias("x"))
        for i in range(size - 1):
            step = step.withColumn("lo", F.col("m")[i]).join(o.withColumnRenamed("hi", "x"), ["lo", "x"], "left_semi").select("m", "x")
        grown = step.select(F.concat("m", F.array("x")).alias("m"))
    return grown.select(F.array_sort("m").alias("members"))


def supernode_key(members: Column) -> Column:
    """A clique's key: its members, padded, so that keys sort as the member lists do."""
    return F.array_join(F.transform(members, lambda x: F.lpad(x.cast("string"), 19, "0")), "-")


def communities(edges: DataFrame, k: int = 4) -> DataFrame:
    """vertex, community, size: vertices of k-cliques that hang together over k - 1 shared members. A community is named by
    the least clique in it; a vertex may be in several.

    Cliques that share k - 1 members are linked through those members: each (k - 1)-subset links its cliques to the least of
    them, so a subset in many cliques makes as many links, not all pairs."""
    supers = cut(cliques(edges, k).withColumn("key", supernode_key(F.col("members"))))
    subset = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: supernode_key(F.filter("members", lambda x, j: j != i)))).alias("subset")
    keyed = supers.select("key", subset)
    lead = keyed.groupBy("subset").agg(F.min("key").alias("lead"))
    links = keyed.join(lead, "subset").where("key <> lead").select(F.col("key").alias("src"), F.col("lead").alias("dst")).distinct()
    label = connected_components(links, supers.select(F.col("key").alias("id")))
    found = supers.join(label.withColumnRenamed("v", "key"), "key").select(F.explode("members").alias("vertex"), F.col("component").alias("community")).distinct()
    sizes = found.groupBy("community").agg(F.count("*").alias("size"))
    return found.join(sizes, "community").select("vertex", "community", "size")


def pattern_histogram(adjacency: DataFrame, most: int = 4, owners: DataFrame | None = None) -> DataFrame:
    """(owner,) code, n: how often each adjacency code comes up in the walk over subgraphs of up to ``most`` vertices that
    starts at every vertex, goes on from the vertex last reached, and adds a vertex or an edge each step.

    Every state counts, the single vertex included. Walks with the same vertices, code and end are carried as one row with
    their number. Bit 4 i + j of a code is the edge from the i-th to the j-th vertex."""
    links = cut(adjacency.select(F.col("src").alias("last"), F.col("dst").alias("to")).distinct().repartition("last"))
    starts = links.select(F.col("last").alias("id")).distinct() if owners is None else owners.select("id", "owner")
    by = [] if owners is None else ["owner"]
    states = starts.select(*by, F.array("id").alias("v"), F.lit(0).cast("long").alias("code"), F.col("id").alias("last"), F.lit(1).cast("long").alias("w"))
    counted = None
    while True:
        states = cut(states)
        part = states.groupBy(*by, "code").agg(F.sum("w").alias("n"))
        counted = part if counted is None else counted.unionByName(part)
        open_states = states.where(F.size("v") < most)
        if open_states.isEmpty():
            break
        i = (F.array_position("v", F.col("last")) - 1).cast("int")
        grown = F.when(F.array_contains("v", F.col("to")), F.col("v")).otherwise(F.concat("v", F.array("to")))
        step = open_states.join(links, "last").select(*by, "v", "code", "last", "to", "w", i.alias("i"), grown.alias("g"))
        step = step.withColumn("j", (F.array_position("g", F.col("to")) - 1).cast("int"))
        one = F.lit(1).cast("long")
        bit = F.call_function("shiftleft", one, (F.col("i") * 4 + F.col("j")).cast("int"))
        back = F.call_function("shiftleft", one, (F.col("j") * 4 + F.col("i")).cast("int"))
        fresh = step.where(F.col("code").bitwiseAND(bit) == 0)
        states = fresh.select(*by, F.col("g").alias("v"), F.col("code").bitwiseOR(bit).bitwiseOR(back).alias("code"), F.col("to").alias("last"), "w").groupBy(*by, "v", "code", "last").agg(F.sum("w").alias("w"))
    return counted.groupBy(*by, "code").agg(F.sum("n").alias("n"))


def ranked_patterns(histogram: DataFrame) -> DataFrame:
    """code, n, edges, score = n * edges."""
    return histogram.withColumn("edges", pattern_edges(F.col("code"))).withColumn("score", F.col("n") * F.col("edges"))


def top_patterns(histogram: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` best patterns by score, ties by code, with their rank from 1: a partial top-n in each task."""
    return ranked_patterns(histogram).orderBy(F.desc("score"), "code").limit(n).withColumn("place", F.struct((-F.col("score")).alias("s"), "code")).transform(_with_rank)


def _with_rank(top: DataFrame) -> DataFrame:
    places = top.agg(F.array_sort(F.collect_list("place")).alias("places"))  # of at most n rows
    return top.join(F.broadcast(places)).withColumn("rank", F.array_position("places", F.col("place")).cast("int")).drop("place", "places")


def pattern_anomalies(histogram: DataFrame, top: int = 6, most_distance: int = 2) -> DataFrame:
    """code, n, near_rank, distance: patterns that aren't among the best but within ``most_distance`` bits of one of them;
    the best-ranked such one is named. Codes are at most 2^16, so the comparison is between bounded tables."""
    best = top_patterns(histogram, top).select(F.col("code").alias("best"), "rank")
    near = histogram.join(F.broadcast(best)).withColumn("distance", pattern_distance(F.col("code"), F.col("best")))
    judged = near.groupBy("code", "n").agg(F.min("distance").alias("least"), F.min(F.when(F.col("distance").between(1, most_distance), F.struct("rank", "distance"))).alias("hit"))
    return judged.where("least > 0 and hit is not null").select("code", "n", F.col("hit.rank").alias("near_rank"), F.col("hit.distance").alias("distance"))


#: Fixed weights of the convolution, three features to two.
GCN_WEIGHTS = ((0.1, 0.02), (0.3, 0.4), (0.2, 0.1))


def convolve(adjacency: DataFrame, features: DataFrame, names: Sequence[str], weights=GCN_WEIGHTS) -> DataFrame:
    """id, pooled_0, pooled_1: the column-wise maximum of A X W over each vertex's closed neighbourhood.

    A holds self edges and the edges among the neighbours; X W is made first, so only two numbers per vertex move. Row i of
    v's neighbourhood sums over the vertices joined to both: v and i themselves, and the third of each triangle over their
    edge. Triangles are found along oriented edges, so a hub makes no wedges. Vertices without features add nothing."""
    made = features.select(F.col("id").alias("k"), *[sum((F.col(n) * w[j] for n, w in zip(names, weights)), F.lit(0.0)).alias(f"w{j}") for j in range(2)])
    links = cut(adjacency.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    entry = lambda v, i, k: F.struct(F.col(v).alias("v"), F.col(i).alias("i"), F.col(k).alias("k"))
    of_edge = [entry(v, i, k) for v, i in (("src", "dst"), ("dst", "src")) for k in (v, i)]
    of_triangle = [entry(*x) for x in itertools.permutations("abc")]
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("k")), F.struct(F.col("dst").alias("v"), F.col("src").alias("k")))).alias("e")
    own = links.select(ends).select("e.*").unionByName(features.select(F.col("id").alias("v"), F.col("id").alias("k")))
    own = own.join(features.select(F.col("id").alias("v")), "v", "left_semi").select("v", F.col("v").alias("i"), "k")
    rows = links.select(F.explode(F.array(*of_edge)).alias("e")).select("e.*").unionByName(triangles(links).select(F.explode(F.array(*of_triangle)).alias("e")).select("e.*")).unionByName(own)
    return rows.join(made, "k").groupBy("v", "i").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1")).groupBy(F.col("v").alias("id")).agg(F.max("w0").alias("pooled_0"), F.max("w1").alias("pooled_1"))


def lonely_supernodes(pooled: DataFrame, radius: float) -> DataFrame:
    """Supernodes with no other within ``radius`` in their two features."""
    near = range_join(pooled, pooled, ["pooled_0", "pooled_1"], radius, predicate=F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("id")).distinct()
    return pooled.join(near, "id", "left_anti")
