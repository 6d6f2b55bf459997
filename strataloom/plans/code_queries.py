"""Queries on source texts: rules, functions, clones of behaviour, dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.frontends import scan as C
from strataloom.functions.text import line_count
from strataloom.operators import chunks, clones, graph, sequences, usage
from strataloom.operators import findings as R
from strataloom.plans.registry import registrar
from strataloom.plans.sql_text import PIECES
from strataloom.plans.text_queries import BLOCKS_SQL, blocks
from strataloom.runtime import Scratch, table

QUERIES, SQL, query = registrar()


def _code(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "content", "lang", "is_test", "package_dir", "relative_path", "repo", "line", "symbol")


@query()
def code_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all rules that look at one text."""
    return C.findings(_code(spark, d), ["block_id", "relative_path"], "content", "lang", "is_test")


@query()
def code_findings_by_kind(spark: SparkSession, d: str) -> DataFrame:
    f = C.findings(_code(spark, d), ["relative_path"], "content", "lang", "is_test")
    return f.groupBy("kind").agg(F.count("*").alias("n"))


@query()
def code_functions(spark: SparkSession, d: str) -> DataFrame:
    return C.functions(_code(spark, d), ["block_id"], "content", "lang")


@query()
def behaviour_clones(spark: SparkSession, d: str) -> DataFrame:
    """Functions that do the same as another one, whatever their names; each tied to one source."""
    f = C.functions(_code(spark, d), ["block_id", "package_dir", "repo", "relative_path"], "content", "lang").where("statements >= 3")
    f = Scratch(spark, "functions").cut(f.dropna(subset=["package_dir", "repo", "relative_path"]), "functions")  # parsed once
    often = clones.repeated_only(f, "digest")
    return clones.clone_sources(often, "digest", "package_dir", "line", "end_line", ["repo", "relative_path", "block_id"], ["name", "effects"]).select("block_id", "name", "source_block_id", "effects")


@query()
def canonical_forms(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at least 50 tokens by canonical form: how many share it, and how many differ in more than local names."""
    c = C.canonical(_code(spark, d), ["block_id"], "content", "lang")
    return c.groupBy("digest").agg(F.count("*").alias("blocks"), F.countDistinct("fingerprint").alias("fingerprints"), F.min("block_id").alias("first_block"))


@query(f"select block_id from {BLOCKS_SQL} where body is not null and length(body) - length(replace(body, chr(10), '')) + case when body <> '' and not suffix(body, chr(10)) then 1 else 0 end > 100")
def oversized_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "content").where("content is not null").where(line_count(F.col("content")) > 100).select("block_id")


@query(
    f"""with m as (select repo, package_dir, split_part(symbol, '.', 1) r, count(*) n from {BLOCKS_SQL} where contains(symbol, '.') and package_dir is not null and repo is not null group by all) select repo, package_dir, r receiver, n methods from m where n > 3"""
)
def god_receivers(spark: SparkSession, d: str) -> DataFrame:
    """Receivers with many methods (more than 3 here; the rule's own limit is 40)."""
    b = _code(spark, d).where("contains(symbol, '.') and package_dir is not null and repo is not null")
    return b.groupBy("repo", "package_dir", F.substring_index("symbol", ".", 1).alias("receiver")).agg(F.count("*").alias("methods")).where("methods > 3")


@query()
def dead_functions(spark: SparkSession, d: str) -> DataFrame:
    """Dead code: functions of a package that nothing leads to from tests and exported names; one for each dead source."""
    code = _code(spark, d).where("package_dir is not null and repo is not null")
    scratch = Scratch(spark, "dead")
    f = scratch.cut(C.functions(code, ["repo", "package_dir", "is_test", "block_id"], "content", "lang"), "functions")
    name = F.concat_ws("::", "repo", "package_dir", "name")
    v = f.select(name.alias("v"), "is_test", "exported", "name", F.col("block_id").alias("rank"))
    roots = v.where("is_test or exported or name in ('main', 'init')").select("v")
    c = C.calls(code, ["repo", "package_dir"], "content", "lang")
    known = v.select("v").distinct()
    e = c.select(F.concat_ws("::", "repo", "package_dir", "caller").alias("src"), F.concat_ws("::", "repo", "package_dir", "callee").alias("dst"))
    e = scratch.cut(e.join(known.select(F.col("v").alias("dst")), "dst", "left_semi"), "calls")
    dead = scratch.cut(v.groupBy("v").agg(F.min("rank").alias("rank")).join(graph.reachable(e, roots).select("v"), "v", "left_anti"), "dead")
    inner = e.join(dead.select(F.col("v").alias("src")), "src", "left_semi").join(dead.select(F.col("v").alias("dst")), "dst", "left_semi")
    return graph.source_components(inner, dead).select("v", "members")


@query(
    f"""with t as (select block_id, repo, relative_path, unnest(regexp_extract_all(body, '"[^"\\n]{{16,}}"')) lit from {BLOCKS_SQL} where body is not null and repo is not null),
    n as (select *, row_number() over (partition by repo, lit order by relative_path, block_id) k from (select distinct repo, relative_path, block_id, lit from t)) select block_id, lit from n where k = 3"""
)
def repeated_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """The third block of a repository with the same literal of at least 16 characters."""
    b = _code(spark, d).where("content is not null and repo is not null")
    t = b.select("repo", "relative_path", "block_id", F.explode(F.regexp_extract_all("content", F.lit(r'"[^"\n]{16,}"'), F.lit(0))).alias("lit")).distinct()
    return sequences.nth_occurrence(t, ["repo", "lit"], ["relative_path", "block_id"], 3).select("block_id", "lit")


_BODIES = f"(select block_id, body from {BLOCKS_SQL} where body <> '')"


@query(f"with recursive {PIECES(_BODIES)} select block_id, ix::int chunk_ix, (e - s)::int bytes from p")
def input_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the pieces of each block, at the limits that model inputs are cut by."""
    b = blocks(spark, d, "content").where("content <> ''")
    return chunks.exploded(b, ["block_id"], "content").select("block_id", "chunk_ix", F.octet_length("piece").alias("bytes"))


@query(f"with recursive {PIECES(_BODIES)} select block_id, count(*) pieces, max(e - s)::int largest, sum(e - s)::bigint bytes from p group by 1")
def input_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as overlapping pieces of at most 2,000 bytes."""
    b = blocks(spark, d, "content").where("content <> ''")
    return chunks.exploded(b, ["block_id"], "content").groupBy("block_id").agg(F.count("*").alias("pieces"), F.max(F.octet_length("piece")).alias("largest"), F.sum(F.octet_length("piece")).alias("bytes"))


_NAME = "regexp_extract(symbol, '[^.]*$', 0)"


@query(
    f"""with f as (select repo, package_dir, {_NAME} name, block_id from {BLOCKS_SQL} where repo is not null and package_dir is not null),
    w as (select repo, package_dir, unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*')) name from {BLOCKS_SQL} where body is not null and repo is not null and package_dir is not null),
    c as (select repo, package_dir, name, count(*) n from w group by all) select f.block_id from f join c using (repo, package_dir, name) where c.n = 2"""
)
def single_use_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions named twice in their package: where they stand and where they are used."""
    b = _code(spark, d).where("repo is not null and package_dir is not null")
    f = b.select("repo", "package_dir", F.regexp_extract("symbol", r"[^.]*$", 0).alias("name"), "block_id")
    w = b.where("content is not null").select("repo", "package_dir", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return usage.used_once(f, w, ["repo", "package_dir", "name"]).select("block_id")


@query()
def test_units(spark: SparkSession, d: str) -> DataFrame:
    """Close tests of a package as units: connected, cut at 8 tests or 400 lines, worth merging."""
    t = _code(spark, d).where("is_test and content is not null and package_dir is not null and repo is not null")
    t = t.select("repo", "package_dir", "block_id", "line", F.size(F.split("content", "\n")).alias("lines"), F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)).alias("calls"))
    pairs = R.close_pairs(t, ["repo", "package_dir"], "block_id", "calls", "lines", overlap=0.2)
    groups = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("v").alias("block_id"), "component")
    units = sequences.cut_at_caps(groups.join(t.drop("calls"), "block_id"), ["component"], ["line", "block_id"], "lines", 8, 400)
    u = units.groupBy("component", "unit").agg(F.count("*").alias("tests"), F.sum("lines").alias("lines"))
    return u.where((F.col("tests") > 1) & (F.col("lines") - F.floor(F.col("lines") / F.col("tests")) >= 15))


@query(
    """with p as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) i from events)
    select s.event_id, (select arg_min(x.event_id, x.i) from p x where x.user_id = s.user_id and x.i > s.i and x.event_type = 'purchase') purchase from p s where event_type = 'signup'
    and exists (select 1 from p x where x.user_id = s.user_id and x.i > s.i and x.event_type = 'purchase' and not exists (select 1 from p e where e.user_id = s.user_id and e.event_type = 'error' and e.i > s.i and e.i < x.i))"""
)
def unbroken_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signups with a later purchase of the user and no error in between."""
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("i", F.row_number().over(w)).withColumn("at", F.struct("i", "event_id"))
    key, order = ["user_id"], ["ts", "event_id"]
    p = sequences.next_matching(e, key, order, F.col("event_type") == "purchase", "at")
    b = sequences.next_matching(e, key, order, F.col("event_type") == "error", "i")
    e = e.withColumn("p", p).withColumn("b", b).where("event_type = 'signup' and p is not null and (b is null or b > p.i)")
    return e.select("event_id", F.col("p.event_id").alias("purchase"))
