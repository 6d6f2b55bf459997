"""How names are used: counts, callbacks, constant arguments, relational division, scores and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import name_prefix


def use_counts(uses: DataFrame, keys: list[str], called: str) -> DataFrame:
    """``(keys..., refs, calls, callback)``: how often a name is used and called; it is only ever passed on if it is used
    more than once and never called."""
    c = uses.groupBy(*keys).agg(F.count("*").alias("refs"), F.count_if(called).alias("calls"))
    return c.withColumn("callback", (F.col("calls") == 0) & (F.col("refs") > 1))


def used_once(functions: DataFrame, uses: DataFrame, keys: list[str], own: int = 1) -> DataFrame:
    """Functions whose name, by ``keys``, occurs once besides the ``own`` times in its declaration."""
    return functions.join(uses.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == own + 1).select(*keys), keys, "left_semi")


def always_zero(calls: DataFrame, keys: list[str], arg: str, zero: Column, least: int = 2) -> DataFrame:
    """``(keys..., n, arg)``: parameters that at least ``least`` calls give the same value, for which ``zero`` holds, and no
    call another."""
    g = calls.groupBy(*keys).agg(F.count("*").alias("n"), F.min(arg).alias(arg), F.max(arg).alias("_max"), F.bool_and(zero).alias("_zero"), F.count(arg).alias("_given"))
    return g.where((F.col("n") >= least) & (F.col(arg) == F.col("_max")) & F.col("_zero") & (F.col("_given") == F.col("n"))).select(*keys, "n", arg)


def division(have: DataFrame, wanted: DataFrame, owner: list[str], group: list[str], member: str) -> DataFrame:
    """``(group..., owner...)``: the owners that have every member their group wants (an interface and its
    implementations). have: (owner..., member), with ``group`` among the owner's columns or not; wanted: (group..., member).
    Both sides are counted in partial aggregates; a group is never gathered."""
    size = wanted.select(*group, member).distinct().groupBy(*group).agg(F.count("*").alias("_all"))
    shared = [c for c in group if c in have.columns]
    met = have.select(*dict.fromkeys([*owner, *shared, member])).distinct().join(wanted.select(*group, member).distinct(), [*shared, member])
    n = met.groupBy(*dict.fromkeys([*group, *owner])).agg(F.count("*").alias("_n"))
    return n.join(size, group).where("_n = _all").select(*dict.fromkeys([*group, *owner]))


def only_one(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Rows whose group has no other row: an interface with exactly one implementation."""
    return pairs.join(pairs.groupBy(*group).count().where("count = 1").select(*group), group, "left_semi")


def scored(points: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """``(keys..., points)`` of those whose points add up to at least ``least``."""
    return points.groupBy(*keys).agg(F.sum(value).alias("points")).where(F.col("points") >= least)


def mixed_prefixes(names: DataFrame, group: list[str], name: str, items: int = 6, prefixes: int = 3, each: int = 2) -> DataFrame:
    """``(group..., items, prefixes)``: groups of at least ``items`` names of which at least ``prefixes`` first words begin
    ``each`` names or more; names of one word have no prefix."""
    p = names.select(*group, name_prefix(F.col(name)).alias("_p")).groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    a = p.groupBy(*group).agg(F.sum("_n").alias("items"), F.sort_array(F.collect_list(F.when((F.col("_n") >= each) & F.col("_p").isNotNull(), F.col("_p")))).alias("prefixes"))
    return a.where((F.col("items") >= items) & (F.size("prefixes") >= prefixes))
