"""Queries on sources, stores and model calls, and the aggregations over them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators import models as M
from strataloom.operators import usage as U
from strataloom.plans.registry import registrar
from strataloom.plans.text_queries import BLOCKS_SQL, blocks
from strataloom.runtime import Scratch, table
from strataloom.sources import files as S
from strataloom.sources import stores as K

QUERIES, SQL, query = registrar()


@query("select doc_id, source, n_chars from documents where doc_id is not null")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A gzip JSON snapshot, written, validated and read back; one of another policy is ignored."""
    s = K.Snapshots(spark, Scratch(spark, "snapshots").path("documents"), keep=2)
    t = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "source", "n_chars")
    s.write(t, {"model": "a"})
    s.write(t.limit(0), {"model": "b"})
    return s.latest({"model": "a"})


_USABLE = "len(list_filter(vec, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(vec, lambda e: e <> 0)) > 0"


@query(f"select vec_id, len(vec)::int dims, true as unit from (select vec_id, any_value(vec) vec from vectors where vec_id is not null group by 1) where vec is not null and {_USABLE}")
def vector_records(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as binary records and back: normalised, unusable ones gone."""
    v = table(spark, d, "vectors").where("vec_id is not null").dropDuplicates(["vec_id"])
    back = K.decode_vectors(K.encode_vectors(v, "vec_id", "vec"), "vec_id")
    n = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return back.select("vec_id", F.size("vec").alias("dims"), (F.abs(n - 1) < 1e-5).alias("unit"))


@query("select c_custkey, c_mktsegment from customer")
def entry_store(spark: SparkSession, d: str) -> DataFrame:
    """Entries put twice and asked for by key: the last one of each counts."""
    e = K.Entries(spark, Scratch(spark, "entries").path("customers"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    e.put(c.withColumn("c_mktsegment", F.lit("old")), "c_custkey")
    e.put(c, "c_custkey")
    return e.get(c, "c_custkey").select("c_custkey", "c_mktsegment")


@query("select n_name, n_regionkey from nation")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """A stream of concatenated JSON documents."""
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    one = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.to_json(F.struct("n_name", "n_regionkey"))), "\n").alias("text"))
    return S.json_stream(one, "text", n.schema)


_TREE = """(select distinct file_path path from documents where file_path is not null)"""


@query(
    f"""with p as (select path, list_last(string_split(path, '/')) b, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end dir from {_TREE})
    select path, case when b like '%.ts' or b like '%.tsx' then 'ts' when b like '%.py' then 'py' when b like '%.go' then 'go' end lang from p
    where not (b like '%.d.ts' or b like '%.gen.ts' or contains(b, '.min.')) and (b like '%.ts' or b like '%.tsx' or b like '%.py' or b like '%.go')
    and (starts_with(path, 'src/') or starts_with(path, 'pkg/')) and not regexp_matches(dir, '(^|/)([._][^/]*|node_modules|vendor|testdata)(/|$)')"""
)
def scripts_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Script files of two subtrees, without skipped directories."""
    p = table(spark, d, "documents").where("file_path is not null").select(F.col("file_path").alias("path"), F.lit("").alias("content")).distinct()
    return S.scripts(p, ["./src/...", "pkg/..."]).select("path", "lang")


@query(f"select sha1(encode('blob ' || strlen(body)) || '\\x00'::blob || encode(body)) id, block_id from {BLOCKS_SQL} where body is not null")
def blob_names(spark: SparkSession, d: str) -> DataFrame:
    """Git's names of the contents of blocks."""
    b = blocks(spark, d, "content").where("content is not null")
    return b.select(S.blob_id(F.col("content")).alias("id"), "block_id")


@query(f"select block_id, description is not null has_text, description is not null embedded from {BLOCKS_SQL}")
def embedded_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions embedded once for each distinct text, in bounded batches."""
    b = blocks(spark, d, "description")
    e = M.once_per_content(b, "description", lambda i: M.embed(i, M.HashEmbedder()))
    return e.select("block_id", F.col("description").isNotNull().alias("has_text"), F.col("vec").isNotNull().alias("embedded"))


class _Echo:
    """Offline stand-in that answers with the length of the prompt, and badly to some prompts."""

    def ask(self, prompt: str) -> str:
        return '{"length": "many"}' if len(prompt) % 7 == 0 else f'{{"length": {len(prompt)}}}'


@query(
    """with q as (select distinct pair_id || coalesce(left_hash, '') p from pairs where pair_id is not null) select count(*) filter (where length(p) % 7 <> 0) answered, count(*) filter (where length(p) % 7 = 0) unresolved from q"""
)
def model_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Requests asked, decoded strictly and asked again; how many were answered."""
    p = table(spark, d, "pairs").where("pair_id is not null").select(F.concat("pair_id", F.coalesce("left_hash", F.lit(""))).alias("prompt")).distinct()
    r = p.withColumn("key", M.request_key({"v": 1}, ["prompt"]))
    answers, rest = M.run_tasks(r, "key", "prompt", _Echo(), T.StructType([T.StructField("length", T.LongType())]), lambda a: a["length"] > 0)
    n = answers.agg(F.count("*").alias("answered"))
    return n.join(F.broadcast(rest.agg(F.count("*").alias("unresolved"))))


class _Describer:
    """Offline stand-in: the first words of the text, which for some texts are too few."""

    def ask(self, prompt: str) -> str:
        body = prompt.split("\n\n", 1)[1]
        return json.dumps({"description": " ".join(re.findall("[A-Za-z0-9_]+", body)[:12])})


_SAID = "regexp_extract_all(body, '[A-Za-z0-9_]+')[1:12]"


@query(
    f"""select block_id, case when len({_SAID}) >= 4 and length(array_to_string({_SAID}, ' ')) <= 240 then array_to_string({_SAID}, ' ') end said from {BLOCKS_SQL} where body is not null"""
)
def described_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks described once for each distinct content; descriptions outside the limits are asked for again, then given up."""
    b = blocks(spark, d, "content").where("content is not null")
    return M.once_per_content(b, "content", lambda i: M.described(i, _Describer(), {"v": 1})).select("block_id", F.col("description").alias("said"))


@query()
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    """Balanced batches of at most 16 requests and 64,000 bytes."""
    b = blocks(spark, d, "content").where("content is not null").select("block_id", F.octet_length("content").alias("size"))
    return M.balanced_batches(b, "block_id", "size").groupBy("lane", "batch").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


# Aggregations.


@query(f"select package_dir, split_part(symbol, '.', 1) receiver, count(*) methods, count(distinct relative_path) files from {BLOCKS_SQL} where contains(symbol, '.') and package_dir is not null group by 1, 2")
def methods_of_receivers(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "package_dir", "symbol", "relative_path").where("contains(symbol, '.') and package_dir is not null")
    return b.groupBy("package_dir", F.substring_index("symbol", ".", 1).alias("receiver")).agg(F.count("*").alias("methods"), F.countDistinct("relative_path").alias("files"))


_CALLS = r"([A-Za-z_][A-Za-z0-9_]*)(\(?)"


@query(
    f"""with t as (select package_dir, regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*\\(?') a from {BLOCKS_SQL} where body is not null and package_dir is not null),
    w as (select package_dir, unnest(a) x from t), c as (select package_dir, rtrim(x, '(') name, count(*) refs, count(*) filter (where x like '%(') calls from w group by all)
    select package_dir, name, refs, calls, calls = 0 and refs > 1 callback from c"""
)
def uses_and_calls(spark: SparkSession, d: str) -> DataFrame:
    """How often each name is used and called in a package, and whether it is only ever passed on."""
    b = blocks(spark, d, "package_dir", "content").where("content is not null and package_dir is not null")
    w = b.select("package_dir", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*\(?"), F.lit(0))).alias("x"))
    w = w.select("package_dir", F.rtrim("x", F.lit("(")).alias("name"), F.col("x").endswith("(").alias("called"))
    return U.use_counts(w, ["package_dir", "name"], "called")


_GIVEN = r"\b([A-Za-z_][A-Za-z0-9_]*)\((nil|null|None|0|false|False|[A-Za-z_][A-Za-z0-9_]*)\)"


@query(
    f"""with t as (select repo, package_dir, unnest(regexp_extract_all(body, '{_GIVEN}')) x from {BLOCKS_SQL} where body is not null and package_dir is not null and repo is not null),
    c as (select repo, package_dir, regexp_extract(x, '{_GIVEN}', 1) name, regexp_extract(x, '{_GIVEN}', 2) arg from t)
    select repo, package_dir, name, count(*) n, min(arg) arg from c group by all having count(*) >= 2 and count(distinct arg) = 1"""
)
def always_same_value(spark: SparkSession, d: str) -> DataFrame:
    """Functions of a package that are always called with the same one argument."""
    b = blocks(spark, d, "repo", "package_dir", "content").dropna()
    x = b.select("repo", "package_dir", F.explode(F.regexp_extract_all("content", F.lit(_GIVEN), F.lit(0))).alias("x"))
    c = x.select("repo", "package_dir", F.regexp_extract("x", _GIVEN, 1).alias("name"), F.regexp_extract("x", _GIVEN, 2).alias("arg"))
    return U.always_zero(c, ["repo", "package_dir", "name"], "arg", F.lit(True))


_POINTS = {r"\bif\b": 1, r"\b(?:switch|case)\b": 2, r"&&|\|\|": 3}


@query(
    f"""with p as (select block_id, {' + '.join(f"{n} * len(regexp_extract_all(body, '{p}'))" for p, n in _POINTS.items())} points from {BLOCKS_SQL} where body is not null)
    select block_id, points::bigint points from p where points >= 3"""
)
def complexity_points(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose points for branches add up to at least 3."""
    b = blocks(spark, d, "content").where("content is not null")
    each = F.explode(F.array(*[F.regexp_count("content", F.lit(p)).cast("bigint") * n for p, n in _POINTS.items()]))
    return U.scored(b.select("block_id", each.alias("points")), ["block_id"], "points")


@query(
    f"""with b as (select distinct repo, package_dir, lang from {BLOCKS_SQL} where repo is not null and package_dir is not null and lang is not null), w as (select repo, count(distinct lang) n from b group by 1),
    d as (select repo, package_dir from b join w using (repo) group by repo, package_dir, n having count(*) = n)
    select repo, package_dir, count(*) over (partition by repo) = 1 alone from d"""
)
def implements_all(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: the packages with blocks in every language of their repository, and whether one is alone in that."""
    b = blocks(spark, d, "repo", "package_dir", "lang").dropna()
    every = U.division(b, b.select("repo", "lang"), ["package_dir"], ["repo"], "lang")
    return every.join(U.only_one(every, ["repo"]).withColumn("alone", F.lit(True)), ["repo", "package_dir"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))


@query(f"select match_id from (select match_id, any_value(left_identity) l from matches where match_id is not null group by 1) where l is not null and l not in (select identity from {BLOCKS_SQL} where identity is not null)")
def missing_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Matches whose left end, as spelled, is no block: requested less present."""
    m = table(spark, d, "matches").where("match_id is not null and left_identity is not null").groupBy("match_id").agg(F.max("left_identity").alias("identity"))
    return m.join(blocks(spark, d, "identity").select("identity"), "identity", "left_anti").select("match_id")
