"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.tokens import VOCABULARY, token_counts
from strataloom.operators.ordering import running_total
from strataloom.runtime import BROADCAST_ROWS, Scratch

#: Newton steps at most, and the relative error of a source's tokens at which it counts as solved.
STEPS, CLOSE = 60, 1e-6


def source_name(source: Column) -> Column:
    """The name in lower case, without outer blanks, hyphens and blanks as underscores; blank is null."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))), "[- ]", "_")
    return F.when(name != "", name)


@dataclass
class Dual:
    """State of one source's dual: the tilt, the bracket it lies in, and what the last step measured."""

    target: float
    cap: int
    unit: float  # tokens that count as one; the source's mean size
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False


def rate(size: Column, tilt: Column, unit: Column, cap: Column) -> Column:
    """The tilted document rate: exp(tilt * size / unit), at most cap. The exponent is bounded against overflow."""
    return F.least(cap.cast("double"), F.exp(F.least(F.greatest(tilt * size / unit, F.lit(-700.0)), F.lit(700.0))))


def solve(counts: DataFrame, duals: dict[str, Dual]) -> int:
    """Newton on the convex dual, all sources at once, until every one is solved; returns the steps taken.

    counts: (source, n_tokens, n), the distinct sizes of each source with their numbers. A step is one distributed
    aggregation: at the current tilt the tokens sum(w t) and their derivative sum(w t**2) over documents below the cap.
    The tokens grow with the tilt, so every measurement also narrows a bracket; a Newton step that leaves it, or that
    has no curvature, is replaced by bisection or doubling. The first step also measures the tokens at an infinite tilt,
    where every document is at the cap: where they stay below the target the dual has no maximum, its tilt is infinite,
    and the source is short.
    """
    for step in range(STEPS):
        live = {s: d for s, d in duals.items() if not d.done}
        if not live:
            return step
        pick = lambda f: F.create_map(*[x for s, d in live.items() for x in (F.lit(s), F.lit(f(d)))])[F.col("source")]  # noqa: B023,E731
        w = rate(F.col("n_tokens"), pick(lambda d: d.tilt), pick(lambda d: d.unit), pick(lambda d: float(d.cap)))
        rows = (
            counts.where(F.col("source").isin(list(live)))
            .withColumn("w", w)
            .groupBy("source")
            .agg(
                F.sum(F.col("w") * F.col("n_tokens") * F.col("n")).alias("tokens"),
                F.sum(F.when(F.col("w") < pick(lambda d: float(d.cap)), F.col("w") * F.col("n_tokens") * F.col("n_tokens") * F.col("n"))).alias("slope"),
                F.sum(pick(lambda d: float(d.cap)) * F.col("n_tokens") * F.col("n")).alias("limit"),
            )
            .collect()  # a row a source of the target table
        )
        for r in rows:
            d, got, slope = duals[r["source"]], r["tokens"], (r["slope"] or 0.0) / duals[r["source"]].unit
            if r["limit"] < d.target:
                d.tilt, d.done = math.inf, True
                continue
            if abs(got - d.target) <= CLOSE * d.target:
                d.done = True
                continue
            if got < d.target:
                d.low = d.tilt
            else:
                d.high = d.tilt
            new = d.tilt + (d.target - got) / slope if slope > 0 else math.nan
            if not d.low < new < d.high:
                new = (d.low + d.high) / 2 if math.isfinite(d.low + d.high) else (2 * d.low + 1 if math.isinf(d.high) and d.low > -0.5 else d.low + 1 if math.isinf(d.high) else d.high - max(1.0, abs(d.high)))
            d.tilt = new
            d.done = d.high - d.low < 1e-12 * max(1.0, abs(new))
    return STEPS


def mix_sources(
    documents: DataFrame, key: str, text: str, source: str, targets: DataFrame, name: str = "source", share: str = "target_share", repeats: str = "max_repeats", vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often each document is used, and what share each source reaches.

    copies: ``(key, source, n_tokens, rate, copies)`` for every document with text and a source in ``targets``.
    report: ``(source, target_share, max_repeats, documents, available_tokens, target_tokens, mixed_tokens,
    actual_share, short)``, one row a target; short tells that the source's dual has no maximum: it stays below its
    target even with every document used max_repeats times.

    The mix is as large as all documents that have text (more than blanks) and a source, named in targets or not. Each
    source's rates minimise the relative entropy to using every document once, under its token target and the cap: the
    solution is exp(tilt * tokens) cut off at the cap. A short source takes every document max_repeats times; its gap is
    reported, not handed to the others. Rates become whole copies by systematic rounding: in order of size, a document
    gets the extra copy in which the running sum of fractions passes the next half, so every stretch of sizes gets its
    number of copies; the order is kept over range partitions. What a few very long documents then leave a source short
    or over is made up by one copy more or less of documents no longer than the mean. Null or blank sources and texts take no part; names are compared in one spelling; a share of 0 or null, or no repeats, gives no copies. targets is
    the list of sources: more than ``BROADCAST_ROWS`` of them are refused.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = targets.select(source_name(F.col(name)).alias("s"), F.col(share).alias("p"), F.col(repeats).alias("m")).where("s is not null").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} targets")
    wanted = {r["s"]: (float(r["p"] or 0.0), max(0, int(r["m"] or 0))) for r in rows}
    used = documents.where(F.col(text).rlike(r"\S")).withColumn("_source", source_name(F.col(source))).where("_source is not null")
    sizes = token_counts(used, text, [key, "_source"], vocabulary).withColumnRenamed("_source", "source")
    sizes = scratch.cut(sizes, "sizes")
    counts = scratch.cut(sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "counts")
    have = {
        r["source"]: r
        for r in counts.groupBy(F.when(F.col("source").isin(list(wanted)), F.col("source")).alias("source"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()
    }
    total = sum(r["t"] for r in have.values())
    duals: dict[str, Dual] = {}
    for s, (p, m) in wanted.items():
        r = have.get(s)
        if r and p > 0 and m > 0 and r["t"]:
            duals[s] = Dual(p * total, m, r["t"] / r["n"])
    solve(counts, duals)
    short = [s for s, (p, _) in wanted.items() if p * total > 0 and (s not in duals or duals[s].tilt == math.inf)]
    facts = spark.createDataFrame(
        [(s, p, m, int(have[s]["n"]) if s in have else 0, int(have[s]["t"]) if s in have else 0, p * total, duals[s].tilt if s in duals else None, duals[s].unit if s in duals else None) for s, (p, m) in wanted.items()],
        "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, target_tokens double, tilt double, unit double",
    )
    f = F.broadcast(facts.select("source", "max_repeats", "tilt", "unit"))  # at most BROADCAST_ROWS rows, checked above
    w = F.when(F.col("tilt").isNull(), 0.0).when(F.col("tilt") == math.inf, F.col("max_repeats").cast("double")).otherwise(
        rate(F.col("n_tokens"), F.col("tilt"), F.col("unit"), F.col("max_repeats"))
    )
    rated = sizes.join(f, "source").withColumn("rate", w).withColumn("_rest", F.col("rate") - F.floor("rate"))
    order = [F.col("n_tokens"), F.xxhash64(F.lit("copies"), key), F.col(key)]
    placed = running_total(rated, scratch, ["source"], order, "_rest", "_sum")
    extra = F.floor(F.col("_sum") + F.col("_rest") + 0.5) - F.floor(F.col("_sum") + 0.5)
    copies = placed.withColumn("copies", F.least(F.floor("rate") + extra, F.col("max_repeats")).cast("int"))
    copies = scratch.cut(copies.select(key, "source", "n_tokens", "rate", "copies", F.monotonically_increasing_id().alias("_row")), "copies")
    copies = _evened(copies, facts, scratch)
    mixed = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    got = facts.drop("tilt", "unit").join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("bigint"))
    whole = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    report = got.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(whole or 1))).withColumn("short", F.col("source").isin(short))
    return copies, report


def _evened(copies: DataFrame, facts: DataFrame, scratch: Scratch) -> DataFrame:
    """The copies with the gap that rounding left in each source closed to less than a document of mean size: in order of a
    hash, documents up to that size get one copy more, or less, as long as their running total stays within the gap."""
    f = facts.where("tilt is not null").select("source", "target_tokens", "max_repeats", "unit")
    gap = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("have")).join(f, "source").select("source", "max_repeats", "unit", (F.col("target_tokens") - F.col("have")).alias("gap"))
    gap = F.broadcast(scratch.cut(gap, "gaps"))  # a row a target, of which there are at most BROADCAST_ROWS
    more = F.col("gap") > 0
    may = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= F.col("unit")) & ((more & (F.col("copies") < F.col("max_repeats"))) | (~more & (F.col("copies") > 0)))
    some = copies.join(gap, "source").where(may).select("_row", "source", "n_tokens", "gap")
    placed = running_total(some, scratch, ["source"], [F.xxhash64(F.lit("even"), "_row"), F.col("_row")], "n_tokens", "_before")
    step = placed.where(F.col("_before") + F.col("n_tokens") <= F.abs("gap")).select("_row", F.signum("gap").cast("int").alias("_step"))
    evened = copies.join(step, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0)))
    return scratch.cut(evened.drop("_row", "_step"), "copies")
