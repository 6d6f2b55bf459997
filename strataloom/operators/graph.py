"""Reachability, components, levels and fixed points over edge tables.

Every loop writes its state to the shared folder (``Scratch``) and looks only at counts on the driver. Vertices may be
of any hashable, orderable type. Null ends are dropped, repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataloom.operators.ordering import running_total
from strataloom.runtime import Scratch

ROUNDS = 10_000


def clean(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(v, component)``: connected components, named by their smallest vertex.

    Large-star and small-star in turn: every vertex links its greater neighbours, then its smaller ones, to the least of
    them, until each hangs on the least vertex of its component.
    """
    scratch = Scratch(edges.sparkSession, "components")
    every = scratch.cut(vertices(clean(edges)), "vertices")
    now = scratch.cut(clean(edges).where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.cut(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        new = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        seen = Observation()  # measured while the table is written
        new = scratch.cut(new.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")), "small")
        scratch.drop(large, now)
        now, last, mark = new, mark, (seen.get["n"], seen.get["h"])
        if mark == last or not mark[0]:
            break
    else:
        raise RuntimeError("no fixed point")
    return every.join(now.select(F.col("a").alias("v"), "b"), "v", "left").select("v", F.coalesce("b", "v").alias("component"))


def reachable(edges: DataFrame, roots: DataFrame, root: str = "v") -> DataFrame:
    """``(v, depth)``: everything reachable from the roots, with the number of steps; roots have 0."""
    scratch = Scratch(edges.sparkSession, "reach")
    e = scratch.cut(clean(edges), "edges")
    frontier = scratch.cut(roots.select(F.col(root).alias("v")).where("v is not null").distinct().withColumn("depth", F.lit(0)), "seen")
    seen = frontier
    for depth in range(1, ROUNDS):
        step = e.join(frontier.select(F.col("v").alias("src")), "src").select(F.col("dst").alias("v")).distinct()
        frontier = scratch.cut(step.join(seen, "v", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = scratch.cut(seen, "seen")
    else:
        raise RuntimeError("no fixed point")
    return seen


def reachable_while_live(edges: DataFrame, roots: DataFrame, root: str = "v") -> DataFrame:
    """As ``reachable``, for edges (src, dst, needs) of which some hold only once ``needs`` is live; until nothing changes."""
    scratch = Scratch(edges.sparkSession, "live")
    e = scratch.cut(edges.select("src", "dst", "needs").where("src is not null and dst is not null").distinct(), "edges")
    live = roots.select(F.col(root).alias("v")).distinct()
    size = -1
    for _ in range(ROUNDS):
        held = e.where("needs is null").select("src", "dst").unionByName(e.where("needs is not null").join(live.select(F.col("v").alias("needs")), "needs", "left_semi").select("src", "dst"))
        live = scratch.cut(reachable(held, live).select("v"), "live")
        n = live.count()
        if n == size:
            return live
        size = n
    raise RuntimeError("no fixed point")


def only_through(edges: DataFrame, roots: DataFrame, others: DataFrame, root: str = "v") -> DataFrame:
    """Vertices that the roots reach and the others do not: what only tests use."""
    return reachable(edges, roots, root).select("v").join(reachable(edges, others, root).select("v"), "v", "left_anti")


def strong_components(edges: DataFrame) -> DataFrame:
    """``(v, scc)``: strongly connected components, named by their greatest vertex.

    Rounds of colouring: vertices without an edge in or out are components of their own and are peeled off; the rest
    take the greatest colour that reaches them; within a colour, what reaches its owner backwards is its component.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    e = clean(edges)
    left = scratch.cut(vertices(e), "vertices")
    e = scratch.cut(e.where("src <> dst"), "edges")
    out = None
    for _ in range(ROUNDS):
        while True:  # trim
            inner = left.join(e.select(F.col("src").alias("v")).distinct(), "v", "left_semi").join(e.select(F.col("dst").alias("v")).distinct(), "v", "left_semi")
            inner = scratch.cut(inner, "inner")
            alone = left.join(inner, "v", "left_anti")
            if alone.isEmpty():
                break
            done = scratch.cut(alone.select("v", F.col("v").alias("scc")), "done")
            out = done if out is None else out.unionByName(done)
            left = inner
            e = scratch.cut(e.join(left.select(F.col("v").alias("src")), "src", "left_semi").join(left.select(F.col("v").alias("dst")), "dst", "left_semi"), "edges")
        if left.isEmpty():
            break
        colour = scratch.cut(left.withColumn("c", F.col("v")), "colour")
        while True:
            got = e.join(colour.select(F.col("v").alias("src"), F.col("c").alias("n")), "src").groupBy(F.col("dst").alias("v")).agg(F.max("n").alias("n"))
            new = scratch.cut(colour.join(got, "v", "left").select("v", F.greatest("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("up")), "colour")
            stop = new.where("up").isEmpty()
            colour = new.select("v", "c")
            if stop:
                break
        s, t = colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), colour.select(F.col("v").alias("dst"), F.col("c").alias("ct"))
        same = scratch.cut(e.join(s, "src").join(t, "dst").where("cs = ct").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "same")
        found = reachable(same, colour.where("v = c").select("v")).select("v").join(colour, "v").select("v", F.col("c").alias("scc"))
        found = scratch.cut(found, "found")
        out = found if out is None else out.unionByName(found)
        left = scratch.cut(left.join(found, "v", "left_anti"), "left")
        e = scratch.cut(e.join(left.select(F.col("v").alias("src")), "src", "left_semi").join(left.select(F.col("v").alias("dst")), "dst", "left_semi"), "edges")
        if left.isEmpty():
            break
    else:
        raise RuntimeError("no fixed point")
    return out if out is not None else left.select("v", F.col("v").alias("scc"))


def source_components(edges: DataFrame, order: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """``(v, scc, members)``: one representative of each strong component that no other component points to.

    order: (v, rank), the representative has the least; vertices only in ``order`` count as components of their own.
    owners: further edges that only tie what they own to its owner (a dead type covers its members).
    """
    e = clean(edges if owners is None else edges.select("src", "dst").unionByName(owners.select("src", "dst")))
    scc = strong_components(e)
    every = order.select("v", "rank").join(scc, "v", "left").select("v", "rank", F.coalesce("scc", "v").alias("scc"))
    entered = e.join(scc.select(F.col("v").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("v").alias("dst"), F.col("scc").alias("b")), "dst").where("a <> b").select(F.col("b").alias("scc")).distinct()
    sources = every.join(entered, "scc", "left_anti")
    return sources.groupBy("scc").agg(F.min(F.struct("rank", "v")).alias("m"), F.count("*").alias("members")).select(F.col("m.v").alias("v"), "scc", "members")


def levels(edges: DataFrame) -> DataFrame:
    """``(v, level)``: longest way down dependency edges (src needs dst); vertices without needs have 0.

    Edges within a cycle count as 0: strong components are levelled as one vertex. Each round settles the vertices whose
    needs are all settled.
    """
    scratch = Scratch(edges.sparkSession, "levels")
    e = clean(edges)
    every = scratch.cut(vertices(e), "vertices")
    scc = scratch.cut(strong_components(e), "scc")
    e = e.join(scc.select(F.col("v").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("v").alias("dst"), F.col("scc").alias("b")), "dst")
    e = scratch.cut(e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges")
    left = scratch.cut(every.join(scc, "v").select(F.col("scc").alias("v")).distinct(), "left")
    out, level = None, 0
    while not left.isEmpty():
        waits = e.select(F.col("src").alias("v")).distinct()
        ready = scratch.cut(left.join(waits, "v", "left_anti").withColumn("level", F.lit(level)), "ready")
        out = ready if out is None else out.unionByName(ready)
        left = scratch.cut(left.join(ready, "v", "left_anti"), "left")
        e = scratch.cut(e.join(ready.select(F.col("v").alias("dst")), "dst", "left_anti"), "edges")
        level += 1
    if out is None:
        return every.withColumn("level", F.lit(0))
    return scc.join(out.withColumnRenamed("v", "scc"), "scc").select("v", "level")


def refine(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``(v, class)``: the coarsest refinement of classes (v, class) in which equals have equal successor classes.

    Colour refinement by hashing the own class with the sorted successors'; stops when a round makes no new class.
    """
    scratch = Scratch(edges.sparkSession, "refine")
    e = scratch.cut(clean(edges), "edges")
    now = scratch.cut(classes.select("v", F.xxhash64(F.col("class").cast("string")).alias("class")), "classes")
    n = now.select("class").distinct().count()
    for _ in range(ROUNDS):
        succ = e.join(now.select(F.col("v").alias("dst"), "class"), "dst").groupBy("src", "class").count()
        # An order-free sum over successor classes; a vertex of any degree is combined before the shuffle.
        sign = succ.groupBy(F.col("src").alias("v")).agg(F.sum(F.xxhash64("class", "count").cast("decimal(20,0)")).cast("string").alias("sign"))
        new = scratch.cut(now.join(sign, "v", "left").select("v", F.xxhash64("class", F.coalesce("sign", F.lit(""))).alias("class")), "classes")
        m = new.select("class").distinct().count()
        now = new
        if m == n:
            return now
        n = m
    raise RuntimeError("no fixed point")


def spread_bits(edges: DataFrame, bits: DataFrame) -> DataFrame:
    """``(v, bits)``: each vertex's bits or'ed with those of everything it reaches (src takes from dst), to a fixed point."""
    scratch = Scratch(edges.sparkSession, "bits")
    e = scratch.cut(clean(edges), "edges")
    now = scratch.cut(bits.select("v", F.col("bits").cast("bigint").alias("bits")), "bits")
    for _ in range(ROUNDS):
        got = e.join(now.select(F.col("v").alias("dst"), F.col("bits").alias("more")), "dst").groupBy(F.col("src").alias("v")).agg(F.bit_or("more").alias("more"))
        new = now.join(got, "v", "left").withColumn("new", F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0))))
        new = scratch.cut(new.select("v", F.col("new").alias("bits"), (F.col("new") != F.col("bits")).alias("up")), "bits")
        if new.where("up").isEmpty():
            return new.select("v", "bits")
        now = new.select("v", "bits")
    raise RuntimeError("no fixed point")


def totals_through(parts: DataFrame, own: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(v, total)``: own amounts (v, amount) plus those of everything a vertex embeds (src embeds dst), each counted
    once; parts embedded by several vertices belong to none of them."""
    scratch = Scratch(parts.sparkSession, "totals")
    e = clean(parts).where("src <> dst")
    shared = e.groupBy("dst").count().where("count > 1").select("dst")
    e = scratch.cut(e.join(shared, "dst", "left_anti"), "edges")
    pairs = scratch.cut(e.select("src", "dst"), "closure")
    new = pairs
    for _ in range(rounds):  # every vertex has one owner left, so the closure has as many rows as vertices have ancestors
        step = new.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        new = scratch.cut(step.distinct().join(pairs, ["src", "dst"], "left_anti"), "new")
        if new.isEmpty():
            break
        pairs = scratch.cut(pairs.unionByName(new), "closure")
    else:
        raise RuntimeError("no fixed point")
    owned = pairs.where("src <> dst").join(own.select(F.col("v").alias("dst"), "amount"), "dst").groupBy(F.col("src").alias("v")).agg(F.sum("amount").alias("more"))
    return own.join(owned, "v", "left").select("v", (F.col("amount") + F.coalesce("more", F.lit(0))).alias("total"))


def ancestors(nodes: DataFrame, node: str, start: str, end: str, within: list[str]) -> DataFrame:
    """``(within..., node, depth)``: how many nodes of the same tree enclose each one, from nested-set bounds.

    Enclosing intervals are those opened and not yet closed: a running count over opens and closes, no interval join. It is
    taken over range partitions, so a tree may hold any share of the nodes.
    """
    at = F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d"), (-F.col(end)).alias("o")), F.struct(F.col(end).alias("p"), F.lit(-1).alias("d"), (-F.col(start)).alias("o"))))
    marks = nodes.select(*within, node, at.alias("x")).select(*within, node, "x.*")
    counted = running_total(marks, Scratch(nodes.sparkSession, "ancestors"), within, [F.col("p"), F.col("d").desc(), F.col("o"), F.col(node)], "d", "depth")
    return counted.where("d = 1").select(*within, node, F.col("depth").cast("int").alias("depth"))


def first_of_group(matches: DataFrame, left: str, right: str, labels: DataFrame, keep: list[Column]) -> DataFrame:
    """One row a component: its first match by (left, right) with ``keep``, and the number of its members."""
    l = labels.select(F.col("v").alias("_v"), "component")
    first = matches.join(l, F.col(left) == F.col("_v")).groupBy("component").agg(F.min_by(F.struct(*keep), F.struct(left, right)).alias("m"))
    size = labels.groupBy("component").agg(F.count("*").alias("members"))
    return first.join(size, "component").select("component", "m.*", "members")
