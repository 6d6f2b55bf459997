"""Queries on the graph of matches between blocks and on the tree of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.paths import canonical_identity
from strataloom.operators import graph as G
from strataloom.plans.registry import registrar
from strataloom.plans.sql_text import CANONICAL_IDENTITY
from strataloom.plans.text_queries import BLOCKS_SQL, blocks
from strataloom.runtime import table

QUERIES, SQL, query = registrar()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed: left to right of every match with both ends."""
    m = table(spark, d, "matches").where("left_identity is not null and right_identity is not null")
    return m.select(canonical_identity(F.col("left_identity")).alias("src"), canonical_identity(F.col("right_identity")).alias("dst")).distinct()


def downward(spark: SparkSession, d: str) -> DataFrame:
    """The same without cycles: from the greater identity to the smaller one."""
    return edges(spark, d).where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


_E = f"e as (select distinct {CANONICAL_IDENTITY('left_identity')} src, {CANONICAL_IDENTITY('right_identity')} dst from matches where left_identity is not null and right_identity is not null)"
_D = _E + ", d as (select distinct greatest(src, dst) src, least(src, dst) dst from e where src <> dst)"
_CLOSURE = _E + ", c as (select src, dst from e union select c.src, e.dst from c join e on e.src = c.dst)"


@query(
    f"""with recursive {_E}, s as (select src, dst from e union select dst, src from e), c as (select src, dst from s union select c.src, s.dst from c join s on s.src = c.dst)
    select src v, least(src, min(dst)) component from c group by src"""
)
def match_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(edges(spark, d))


@query(
    f"""with recursive {_E}, s as (select src, dst from e union select dst, src from e), c as (select src, dst from s union select c.src, s.dst from c join s on s.src = c.dst),
    l as (select src v, least(src, min(dst)) component from c group by src)
    select component, arg_min(struct_pack(l := e.src, r := e.dst), (e.src, e.dst)).l first_left, arg_min(struct_pack(l := e.src, r := e.dst), (e.src, e.dst)).r first_right,
    (select count(*) from l x where x.component = l.component) members from e join l on l.v = e.src group by component"""
)
def match_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a group of matches: its first match and the number of its members."""
    e = edges(spark, d)
    return G.first_of_group(e, "src", "dst", G.components(e), [F.col("src").alias("first_left"), F.col("dst").alias("first_right")])


@query(
    f"""with recursive {_E}, b as (select distinct {CANONICAL_IDENTITY('identity')} v from {BLOCKS_SQL} where is_test),
    r as (select v from b union select e.dst from r join e on e.src = r.v) select v from r"""
)
def reachable_from_tests(spark: SparkSession, d: str) -> DataFrame:
    roots = blocks(spark, d, "identity", "is_test").where("is_test").select(canonical_identity(F.col("identity")).alias("v"))
    return G.reachable(edges(spark, d), roots).select("v")


@query(
    f"""with recursive {_E}, b as (select distinct {CANONICAL_IDENTITY('identity')} v from {BLOCKS_SQL} where is_test), n as (select src v from e union select dst from e),
    r as (select v from b union select e.dst from r join e on e.src = r.v) select v from n where v not in (select v from r)"""
)
def unreachable(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the graph that no test block leads to."""
    e = edges(spark, d)
    roots = blocks(spark, d, "identity", "is_test").where("is_test").select(canonical_identity(F.col("identity")).alias("v"))
    return G.vertices(e).join(G.reachable(e, roots), "v", "left_anti")


@query(
    f"""with recursive {_E}, b as (select {CANONICAL_IDENTITY('identity')} v, bool_and(is_test) t from {BLOCKS_SQL} where identity is not null group by 1),
    r as (select v from b where t union select e.dst from r join e on e.src = r.v), o as (select v from b where not t union select e.dst from o join e on e.src = o.v) select v from r where v not in (select v from o)"""
)
def test_only(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that test blocks lead to and other blocks do not."""
    b = blocks(spark, d, "identity", "is_test").where("identity is not null").groupBy(canonical_identity(F.col("identity")).alias("v")).agg(F.bool_and("is_test").alias("t"))
    return G.only_through(edges(spark, d), b.where("t").select("v"), b.where("not t").select("v"))


@query(
    f"""with recursive {_CLOSURE}, n as (select src v from e union select dst from e)
    select v, greatest(v, coalesce(max(a.dst), v)) scc from n left join (select x.src, x.dst from c x join c y on y.src = x.dst and y.dst = x.src) a on a.src = v group by v"""
)
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(edges(spark, d))


@query(
    f"""with recursive {_CLOSURE}, n as (select src v from e union select dst from e),
    s as (select v, greatest(v, coalesce(max(a.dst), v)) scc from n left join (select x.src, x.dst from c x join c y on y.src = x.dst and y.dst = x.src) a on a.src = v group by v),
    i as (select distinct y.scc from e join s x on x.v = e.src join s y on y.v = e.dst where x.scc <> y.scc)
    select min(v) v, scc, count(*) members from s where scc not in (select scc from i) group by scc"""
)
def source_components(spark: SparkSession, d: str) -> DataFrame:
    """One block for each strong component that nothing else points to."""
    e = edges(spark, d)
    return G.source_components(e, G.vertices(e).withColumn("rank", F.col("v")))


@query(
    f"""with recursive {_D}, n as (select src v from d union select dst from d), l as (select v, 0 lv from n where v not in (select src from d) union select d.src, l.lv + 1 from l join d on d.dst = l.v)
    select v, max(lv)::int level from l group by v"""
)
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.levels(downward(spark, d))


@query(
    f"""with recursive {_D}, n as (select src v from d union select dst from d), c as (select src, dst from d union select c.src, d.dst from c join d on d.src = c.dst),
    b as (select v, (1 << (length(v) % 16))::bigint bit from n), r as (select src v, dst from c union select v, v from n)
    select r.v, bit_or(b.bit) bits from r join b on b.v = r.dst group by r.v"""
)
def spread_effects(spark: SparkSession, d: str) -> DataFrame:
    """Bits of a block and of everything below it."""
    e = downward(spark, d)
    return G.spread_bits(e, G.vertices(e).withColumn("bits", F.expr("shiftleft(cast(1 as bigint), cast(length(v) % 16 as int))")))


@query(
    """with o as (select 'c' || c_custkey v, 0::bigint amount, 'n' || c_nationkey up from customer union all select 'n' || n_nationkey, 0, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 0, null from region
      union all select 'o' || o_orderkey, 1, 'c' || o_custkey from orders)
    select 'c' || o_custkey v, count(*)::bigint total from orders group by 1 union all select 'n' || c_nationkey, count(*) from orders join customer on c_custkey = o_custkey group by 1
    union all select 'r' || n_regionkey, count(*) from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1
    union all select 'o' || o_orderkey, 1 from orders
    union all select 'c' || c_custkey, 0 from customer where c_custkey not in (select o_custkey from orders)
    union all select 'n' || n_nationkey, 0 from nation where n_nationkey not in (select c_nationkey from customer join orders on c_custkey = o_custkey)
    union all select 'r' || r_regionkey, 0 from region where r_regionkey not in (select n_regionkey from nation join customer on c_nationkey = n_nationkey join orders on c_custkey = o_custkey)"""
)
def totals_through_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders under every customer, nation and region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, n, r, o = (table(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    own = o.select(name("o", "o_orderkey").alias("v"), F.lit(1).alias("amount"))
    for t, p, k in ((c, "c", "c_custkey"), (n, "n", "n_nationkey"), (r, "r", "r_regionkey")):
        own = own.unionByName(t.select(name(p, k).alias("v"), F.lit(0).alias("amount")))
    e = o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    e = e.unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    e = e.unionByName(n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")))
    return G.totals_through(e, own)


@query(
    """with b as (select run_id, any_value(repo) repo, any_value(module_dir) m, any_value(started_at) s, any_value(finished_at) f from scan_runs where run_id is not null group by run_id),
    k as (select * from b where s is not null and f is not null and f > s and repo is not null and m is not null)
    select x.repo, x.m module_dir, x.run_id, count(y.run_id)::int depth from k x left join k y on y.repo = x.repo and y.m = x.m and y.s <= x.s and y.f > x.s and y.run_id <> x.run_id
      and (y.s < x.s or y.f > x.f or (y.f = x.f and y.run_id < x.run_id)) group by all"""
)
def open_runs(spark: SparkSession, d: str) -> DataFrame:
    """How many runs of the module were under way when each one started."""
    from strataloom.operators.ordering import keep_best

    cols = ["repo", "module_dir", "started_at", "finished_at"]
    r = keep_best(table(spark, d, "scan_runs").where("run_id is not null"), ["run_id"], [F.col("started_at")], cols).dropna(subset=cols).where("finished_at > started_at")
    # Closes at the moment of an open come first, as an interval ends before the point at its end.
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = r.select("repo", "module_dir", "run_id", (micros("started_at") * 2 + 1).alias("s"), (micros("finished_at") * 2).alias("e"))
    return G.ancestors(r, "run_id", "s", "e", ["repo", "module_dir"])
