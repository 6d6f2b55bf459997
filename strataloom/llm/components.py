"""Consolidating pairwise links into groups by randomized graph contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import Scratch

#: Rounds after which contraction is taken to be broken; each removes a constant share of the vertices.
MAX_ROUNDS = 200


def hash_order(vertex: Column, round_: int) -> Column:
    """A fresh pseudo-random order of the vertices for every round."""
    return F.struct(F.xxhash64(vertex, F.lit(round_)).alias("h"), vertex.alias("w"))


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(v, root)`` for every end of ``edges`` (u, v: any hashable type, without loops, nulls or repeats, u < v).

    Each round hooks every vertex to whichever of itself and its neighbours comes first in that round's hash order,
    relabels both ends of every edge, drops loops and repeated edges, and keeps the round's mapping. Vertices that lose
    their last edge are done. Afterwards the mappings are expanded from the last round back to the first. Every round
    is written to the shared folder; nothing but counts reaches the driver. A vertex with any number of links is
    reduced by partial aggregation before the shuffle, and skewed joins are split by adaptive execution.
    """
    maps: list[DataFrame] = []
    left = edges.count()
    for i in range(MAX_ROUNDS):
        if not left:
            break
        ends = edges.select(F.col("u").alias("v"), F.col("v").alias("w")).unionByName(edges.select("v", F.col("u").alias("w")))
        hooked = ends.groupBy("v").agg(F.min(hash_order(F.col("w"), i)).alias("m"))
        own = hash_order(F.col("v"), i)
        first = F.when(F.col("m") < own, F.col("m")["w"]).otherwise(F.col("v"))
        hook = scratch.cut(hooked.select("v", first.alias("to")), "map")
        maps.append(hook)
        a = hook.select(F.col("v").alias("u"), F.col("to").alias("a"))
        b = hook.select("v", F.col("to").alias("b"))
        new = (
            edges.join(a, "u").join(b, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        new = scratch.cut(new, "edges")
        scratch.drop(edges if i else None)
        edges, left = new, new.count()
    else:
        raise RuntimeError(f"contraction did not end after {MAX_ROUNDS} rounds")
    if not maps:
        return edges.select("v", F.col("v").alias("root"))
    found = maps.pop().select("v", F.col("to").alias("root"))
    while maps:
        later = found.select(F.col("v").alias("to"), "root")
        step = maps.pop().join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root"))
        found = scratch.cut(step, "expand") if len(maps) % 4 == 0 and maps else step
    return found


def group_identities(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(identity, group_identity)`` for every string linked to another one, directly or indirectly.

    links may repeat, name an end twice or hold nulls (no link; an end linked only to itself is not in the result).
    group_identity is the smallest identity of the group by bytes. Vertices are 64-bit hashes during contraction; a
    collision between two identities is looked for and raises the seed, so it cannot join two groups. Empty in, empty
    out.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = scratch.cut(
        links.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null and l <> r")
        .select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct(),
        "links",
    )
    names = scratch.cut(pairs.select(F.explode(F.array("l", "r")).alias("identity")).distinct(), "names")
    for seed in range(100):
        key = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
        if names.groupBy(key("identity").alias("h")).count().where("count > 1").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("no hash without collisions")
    u, v = key("l"), key("r")
    edges = scratch.cut(pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")), "edges")
    roots = contract(edges, scratch)
    labelled = scratch.cut(names.withColumn("v", key("identity")).join(roots, "v").select("identity", "root"), "labelled")
    smallest = labelled.groupBy("root").agg(F.min("identity").alias("group_identity"))
    return labelled.join(smallest, "root").select("identity", "group_identity")
