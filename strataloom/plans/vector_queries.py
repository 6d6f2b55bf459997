"""Queries on blocks and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.paths import canonical_identity
from strataloom.operators import graph as G
from strataloom.operators import vectors as V
from strataloom.plans.registry import registrar
from strataloom.plans.sql_text import CANONICAL_IDENTITY
from strataloom.plans.text_queries import BLOCKS_SQL, blocks
from strataloom.runtime import table

QUERIES, SQL, query = registrar()


#: Gates moved down so that the invented vectors have pairs on either side.
GATES = V.Gates(shift=-0.08)


def units(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "identity", "relative_path", "package_dir", "lang", "repo", "is_test").where("identity is not null and relative_path is not null and package_dir is not null and repo is not null")
    one = b.groupBy(canonical_identity(F.col("identity")).alias("id")).agg(F.min_by(F.struct(F.col("relative_path").alias("path"), F.col("package_dir").alias("dir"), "lang", "repo", "is_test"), "block_id").alias("u"))
    return one.select("id", "u.*").withColumn("changed", F.lit(True))


def packed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").where("vec_id is not null and identity is not null and channel is not null").dropDuplicates(["vec_id"])
    return V.packed(v.withColumn("id", canonical_identity(F.col("identity"))), "id", "channel", ["chunk_ix", "vec_id"], "vec", 64)


_U = f"""u as (select {CANONICAL_IDENTITY('identity')} id, arg_min(relative_path, block_id) path, arg_min(package_dir, block_id) dir, arg_min(lang, block_id) lang, arg_min(repo, block_id) repo, arg_min(is_test, block_id) t
  from {BLOCKS_SQL} where identity is not null and relative_path is not null and package_dir is not null and repo is not null group by 1),
  x as (select vec_id, any_value({CANONICAL_IDENTITY('identity')}) id, any_value(channel) ch, any_value(chunk_ix) ci, any_value(vec)::double[] v from vectors where vec_id is not null and len(vec) = 64
    and len(list_filter(vec, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(vec, lambda e: e <> 0)) > 0 group by vec_id),
  y as (select *, row_number() over (partition by id, ch order by ci, vec_id) - 1 k from x),
  h as (select id, list_filter(string_split(dir, '/'), lambda p: p <> '') parts from u where id in (select id from x)),
  p as (select a.id l, b.id r, case when a.path = b.path then 0 when a.dir = b.dir then 1 else 1 + greatest(len(ha.parts) - n, len(hb.parts) - n) end tier, a.t t1, b.t t2
    from u a join u b on a.repo = b.repo and a.lang = b.lang and a.id < b.id join h ha on ha.id = a.id join h hb on hb.id = b.id,
    lateral (select count(*) n from range(1, least(len(ha.parts), len(hb.parts)) + 1) g(i) where ha.parts[1:i] = hb.parts[1:i])),
  s as (select l, r, a.k lc, b.k rc, least(list_cosine_similarity(a.v, b.v), 1) c from p join y a on a.id = l and a.ch = 'source' join y b on b.id = r and b.ch = 'source' where tier <= 2),
  e as (select l, r, max(c) c, arg_min(lc, (-round(c, 9), lc, rc)) lc, arg_min(rc, (-round(c, 9), lc, rc)) rc from s where c > 0 group by all),
  f as (select l, r, max(least(list_cosine_similarity(a.v, b.v), 1)) c from p join y a on a.id = l and a.ch = 'description' join y b on b.id = r and b.ch = 'description' where tier <= 2 and t1 = t2 group by all),
  m as (select p.l \"left\", p.r \"right\", tier::int tier, round(coalesce(e.c, 0), 6) embedding, coalesce(lc, 0)::int left_chunk, coalesce(rc, 0)::int right_chunk, round(greatest(coalesce(f.c, 0), 0), 6) description, t1, t2
    from p left join e on e.l = p.l and e.r = p.r left join f on f.l = p.l and f.r = p.r where tier <= 2)"""
_PASS = """(embedding >= case when t1 or t2 then least((case tier when 0 then 0.970 when 1 then 0.975 else 0.980 end) - 0.08 + 0.025, 0.999) else (case tier when 0 then 0.970 when 1 then 0.975 else 0.980 end) - 0.08 end
  or description >= (case tier when 0 then 0.950 when 1 then 0.960 else case when t1 and t2 then 0.960 else 0.958 end end) - 0.08 + case when t1 and t2 then 0.015 else 0 end)"""
_PAIRS = f"""select "left", "right", tier, embedding, left_chunk, right_chunk, description from m where {_PASS}"""


@query(f"with {_U} {_PAIRS}")
def tiered_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: pairs of blocks near each other in the tree that pass the gate of either channel."""
    return V.similar_blocks(units(spark, d), packed(spark, d), GATES)


@query(f"with {_U} {_PAIRS}".replace("- 0.08 ", "").replace("- 0.08)", ")"))
def tiered_block_pairs_at_gates(spark: SparkSession, d: str) -> DataFrame:
    """The same at the gates as they are, which few of the invented vectors pass."""
    return V.similar_blocks(units(spark, d), packed(spark, d), V.Gates())


@query(f"with {_U} {_PAIRS}")
def tiered_block_pairs_in_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same result from an earlier state and the pairs with a changed side."""
    u, v = units(spark, d), packed(spark, d)
    u = u.withColumn("changed", F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    before = V.similar_blocks(u.where("not changed").withColumn("changed", F.lit(True)), v, GATES)
    return before.unionByName(V.similar_blocks(V.near_changes(u), v, GATES))


@query(
    f"""with recursive {_U}, g as ({_PAIRS}), n as (select "left" a, "right" b from g union select "right", "left" from g), c as (select a, b from n union select c.a, n.b from c join n on n.a = c.b)
    select a id, least(a, min(b)) component, count(*) filter (where b <> a) + 1 members from c group by a"""
)
def tiered_block_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of blocks from an earlier state's pairs and those with a changed side."""
    pairs = tiered_block_pairs_in_steps(spark, d).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    groups = G.components(pairs).select(F.col("v").alias("id"), "component")
    return groups.join(groups.groupBy("component").agg(F.count("*").alias("members")), "component").select("id", "component", "members")


@query(
    f"""with {_U.split('h as (')[0].rstrip().rstrip(',')} select id, ch channel, count(*) n, round(sum(list_sum(list_transform(v, lambda e: e / sqrt(list_sum(list_transform(v, lambda z: z * z))))))  , 4) total from x group by all"""
)
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").where("vec_id is not null and identity is not null").dropDuplicates(["vec_id"]).where(F.size("vec") == 64)
    u = v.select(canonical_identity(F.col("identity")).alias("id"), "channel", V.unit_vector(F.col("vec")).alias("u")).where("u is not null")
    return u.groupBy("id", "channel").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)), 4).alias("total"))
