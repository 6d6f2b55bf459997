"""Queries on clones, findings, votes and states of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.paths import canonical_identity, canonical_path
from strataloom.operators import clones as C
from strataloom.operators import deltas as D
from strataloom.operators import findings as R
from strataloom.operators.incremental import baselines, successful_runs
from strataloom.operators.ordering import keep_best, running_total
from strataloom.plans.registry import registrar
from strataloom.plans.sql_text import CANONICAL_IDENTITY, CANONICAL_PATH
from strataloom.plans.text_queries import BLOCKS_SQL, blocks
from strataloom.runtime import Scratch, table

QUERIES, SQL, query = registrar()


# Clones.

_SPANS = f"""s as (select block_id, package_dir p, line s, line + len(string_split(body, chr(10))) - 1 e, body k, repo, relative_path rp from {BLOCKS_SQL}
  where body is not null and body <> '' and package_dir is not null and repo is not null and relative_path is not null and line is not null)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "package_dir", "line", "content", "repo", "relative_path").dropna().where("content <> ''")
    return b.withColumn("end_line", F.col("line") + F.size(F.split("content", "\n")) - 1)


@query(
    f"""with {_SPANS}, w as (select *, row_number() over (order by repo, rp, s, block_id) o from s),
    c as (select *, first(o) over (partition by k order by o) f, first(p) over (partition by k order by o) hp,
      min((e, o)) over (partition by k, p order by o rows between unbounded preceding and 1 preceding) me,
      min((-s, o)) over (partition by k, p order by o rows between unbounded preceding and 1 preceding) ms from w),
    t as (select *, min(case when p <> hp then o end) over (partition by k order by o rows between unbounded preceding and 1 preceding) sec from c),
    r as (select block_id, case when me[1] < s then me[2] when -ms[1] > e then ms[2] when f <> o and hp <> p then f else sec end src from t)
    select r.block_id, w.block_id source_block_id from r join w on w.o = r.src"""
)
def clone_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every copied block with the one block it is tied to."""
    out = C.clone_sources(_spans(spark, d), "content", "package_dir", "line", "end_line", ["repo", "relative_path", "line", "block_id"])
    return out.select("block_id", "source_block_id")


@query(f"select sha256(body) digest, count(*) copies from {BLOCKS_SQL} where body is not null group by 1 having count(*) >= 2")
def clone_classes(spark: SparkSession, d: str) -> DataFrame:
    return C.class_sizes(blocks(spark, d, "content"), "content")


@query(f"select block_id from {BLOCKS_SQL} b where content_hash is not null and lower(content_hash) in (select lower(content_hash) from {BLOCKS_SQL} group by 1 having count(*) >= 2)")
def repeated_signatures(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "content_hash").select("block_id", F.lower("content_hash").alias("signature"))
    return C.repeated_only(b, "signature").select("block_id")


@query(
    f"""with {_SPANS}, w as (select *, row_number() over (partition by repo, rp order by e - s desc, s, block_id) o from s)
    select block_id from w where not exists (select 1 from w x where x.repo = w.repo and x.rp = w.rp and x.o < w.o and x.s <= w.s and x.e >= w.e)"""
)
def uncovered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a file, the longest first, that lie in no earlier one."""
    s = _spans(spark, d).drop("content", "package_dir")
    return C.uncovered(s, ["repo", "relative_path"], [(F.col("line") - F.col("end_line")).alias("w"), F.col("line").alias("s"), F.col("block_id").alias("b")], "line", "end_line").select("block_id")


# Findings.

_REPORT = r"^([^ :]+\.(?:go|ts|py)):([0-9]+):([0-9]+): ([a-z_]+)$"
_F = f"""f as (select doc_id, file, line, col, kind, kind || ' in document ' || doc_id message from (
  select doc_id, regexp_extract(l, '{_REPORT}', 1) file, try_cast(regexp_extract(l, '{_REPORT}', 2) as int) line, try_cast(regexp_extract(l, '{_REPORT}', 3) as int) col, regexp_extract(l, '{_REPORT}', 4) kind
  from (select doc_id, unnest(string_split(text, chr(10))) l from documents where text is not null)) where kind <> '' and line is not null and col is not null)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings that documents list, a line each."""
    l = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(_REPORT))
    at = lambda i: F.regexp_extract("l", _REPORT, i)
    f = l.select("doc_id", at(1).alias("file"), F.expr(f"try_cast(regexp_extract(l, r'{_REPORT}', 2) as int)").alias("line"), F.expr(f"try_cast(regexp_extract(l, r'{_REPORT}', 3) as int)").alias("col"), at(4).alias("kind"))
    return f.dropna(subset=["line", "col"]).withColumn("message", F.concat("kind", F.lit(" in document "), F.col("doc_id").cast("string")))


def directives(spark: SparkSession, d: str) -> DataFrame:
    """A directive for each finding at an even column, and one for the line below for the others."""
    f = findings(spark, d)
    target = F.when(F.col("col") % 2 == 0, F.col("line")).otherwise(F.col("line") + 1)
    return f.select("file", (F.col("line") - 1).alias("line"), target.alias("target"), F.col("kind").alias("rule"), F.when(F.col("col") > 10, "as agreed").alias("reason")).distinct()


_V = _F + """, d as (select distinct file, line - 1 line, case when col % 2 = 0 then line else line + 1 end target, kind rule, case when col > 10 then 'as agreed' end reason
  from f),
  v as (select * from d where reason is not null and rule not in ('stale_ignore', 'invalid_ignore', 'parse_error'))"""


@query(f"with {_F} select doc_id, file, line, col, kind from f")
def listed_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("doc_id", "file", "line", "col", "kind")


@query(f"with {_V} select * from d where rule in ('stale_ignore', 'invalid_ignore', 'parse_error') or reason is null".replace("select * from d", "select file, line, rule, case when reason is null then 'needs a reason' else 'cannot be suppressed' end problem from d"))
def invalid_directives(spark: SparkSession, d: str) -> DataFrame:
    return R.valid_directives(directives(spark, d))[1].select("file", "line", "rule", "problem")


@query(
    f"""with {_V} select doc_id, file, line, col, kind from f where (file, line, kind) not in (select file, target, rule from v)
    and not (kind = 'oversized_owner_file' and file in (select file from v where rule = 'oversized_owner_file'))"""
)
def unsuppressed_findings(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = R.valid_directives(directives(spark, d))
    return R.suppress(findings(spark, d), valid).select("doc_id", "file", "line", "col", "kind")


@query(
    f"""with {_V} select file, target, rule from v where not exists (select 1 from f where f.file = v.file and f.kind = v.rule and (f.line = v.target or v.rule = 'oversized_owner_file')) and rule <> 'dead_code'"""
)
def stale_directives(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = R.valid_directives(directives(spark, d))
    return R.stale(findings(spark, d), valid, True, F.col("rule") != "dead_code").select("file", "target", "rule")


@query(
    f"""with {_V} select file, line, kind from f where (file, line, kind) not in (select file, target, rule from v) and not (kind = 'oversized_owner_file' and file in (select file from v where rule = 'oversized_owner_file'))
    union all select file, line, 'invalid_ignore' from d where rule in ('stale_ignore', 'invalid_ignore', 'parse_error') or reason is null
    union all select file, line, 'stale_ignore' from v where not exists (select 1 from f where f.file = v.file and f.kind = v.rule and (f.line = v.target or v.rule = 'oversized_owner_file'))"""
)
def united_streams(spark: SparkSession, d: str) -> DataFrame:
    """What a report holds: findings no directive covers, and directives that are invalid or of no use."""
    f, valid = findings(spark, d), R.valid_directives(directives(spark, d))
    kept = R.suppress(f, valid[0]).select("file", "line", "kind")
    bad = valid[1].select("file", "line", F.lit("invalid_ignore").alias("kind"))
    return kept.unionByName(bad).unionByName(R.stale(f, valid[0], True).select("file", "line", F.lit("stale_ignore").alias("kind")))


@query(f"with {_F} select kind, count(*) over (partition by kind) n, row_number() over (partition by kind order by file, line, col, message) place, file || ':' || line || ':' || col || ': ' || message as text from f")
def findings_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return R.report(findings(spark, d))


@query(
    f"""with {_F}, k as (select kind, row_number() over (order by kind) r from (select distinct kind from f)), n as (select count(*) n, count(distinct kind) k from f),
    p as (select *, row_number() over (order by file, line, col, message) r from f)
    select 0 place, '{{"issues":[' as text union all select n + 1, '],"rules":{{' from n union all select n + k + 2, '}}}}' from n
    union all select r, case when r > 1 then ',' else '' end || to_json({{'position': file || ':' || line || ':' || col, 'kind': kind, 'message': message}})::varchar from p
    union all select n + 1 + r, case when r > 1 then ',' else '' end || '"' || kind || '":' || to_json({{'finds': 'lines with ' || kind, 'fix': 'see the guide'}})::varchar from k, n"""
)
def findings_json(spark: SparkSession, d: str) -> DataFrame:
    """The lines of one JSON document with all findings and the rules they name."""
    f = findings(spark, d)
    rules = f.select("kind").distinct().withColumn("finds", F.concat(F.lit("lines with "), "kind")).withColumn("fix", F.lit("see the guide"))
    return R.as_json(f, rules)


@query(f"with {_F} select row_number() over (order by file, line, col, message, doc_id) place, doc_id, file, line, col from f")
def ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    """The total order of findings as places, over range partitions."""
    f = findings(spark, d).withColumn("one", F.lit(1)).withColumn("all", F.lit(1))
    order = [F.col(c) for c in ("file", "line", "col", "message", "doc_id")]
    r = running_total(f, Scratch(spark, "order"), ["all"], order, "one", "before")
    # Equal rows are told apart by nothing; they share their place's stretch in any order.
    return r.select((F.col("before") + 1).alias("place"), "doc_id", "file", "line", "col")


_MIN = "epoch_us({0}) // 60000000"


@query(
    f"""with r as (select run_id, any_value(repo) repo, any_value(module_dir) m, any_value({_MIN.format('started_at')}) s, any_value({_MIN.format('finished_at')}) e from scan_runs where run_id is not null group by run_id),
    p as (select repo, module_dir m, {_MIN.format('arrived_at')} t from source_files where arrived_at is not null)
    select run_id from r where repo is not null and m is not null and s is not null and e is not null and s <= e
    and not exists (select 1 from p where p.repo = r.repo and p.m = r.m and p.t between (r.s + r.e) // 2 and r.e)"""
)
def runs_without_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Runs in whose second half no file of their module arrived: an interval anti-join by minutes."""
    minute = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 60_000_000)
    cols = ["repo", "module_dir", "started_at", "finished_at"]
    r = keep_best(table(spark, d, "scan_runs").where("run_id is not null"), ["run_id"], [F.xxhash64(*cols)], cols).dropna()
    r = r.select("run_id", F.concat_ws("\x01", "repo", "module_dir").alias("m"), minute("started_at").alias("s"), minute("finished_at").alias("e")).where("s <= e")
    r = r.withColumn("s", F.floor((F.col("s") + F.col("e")) / 2))
    p = table(spark, d, "source_files").dropna(subset=["repo", "module_dir", "arrived_at"]).select(F.concat_ws("\x01", "repo", "module_dir").alias("m"), minute("arrived_at").alias("t"))
    return R.not_containing(r, p, "m", "s", "e", "t", 60).select("run_id")


# Votes.

_VOTE = """v as (select pair_id, row_number() over (partition by pair_id order by scanned_at, match_id) n, case when structural_score >= 0.05 then 'repeated' else 'distinct' end verdict
  from (select match_id, any_value(pair_id) pair_id, any_value(scanned_at) scanned_at, any_value(structural_score) structural_score from matches where match_id is not null group by match_id) where pair_id is not null)"""


@query(
    f"""with {_VOTE} select a.pair_id, case when a.verdict = 'repeated' and b.verdict is distinct from 'repeated' then 'distinct' else a.verdict end verdict from v a left join v b on b.pair_id = a.pair_id and b.n = 2 where a.n = 1"""
)
def two_vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The first two scans of a pair as votes: a repetition must be found twice."""
    cols = ["pair_id", "scanned_at", "structural_score"]
    m = keep_best(table(spark, d, "matches").where("match_id is not null"), ["match_id"], [F.col("loaded_at")], cols).where("pair_id is not null")
    w = W.partitionBy("pair_id").orderBy("scanned_at", "match_id")
    v = m.withColumn("n", F.row_number().over(w)).where("n <= 2").withColumn("verdict", F.when(F.col("structural_score") >= 0.05, "repeated").otherwise("distinct"))
    return R.agree(v, "pair_id", "verdict", "n", F.lit("distinct"), F.col("v1") == "repeated")


@query(
    f"""with b as (select * from {BLOCKS_SQL} where package_dir is not null),
    a as (select package_dir, list_sort(list_distinct(list(symbol))) m, count(*) * 3 s from b where not is_test group by 1), c as (select package_dir, list_distinct(list(symbol)) m, count(*) * 4 s from b where lang = 'go' group by 1)
    select package_dir, array_to_string(list_filter(a.m, lambda x: list_contains(c.m, x)), ' ') members, least(a.s, c.s) saved from a join c using (package_dir)
    where len(list_filter(a.m, lambda x: list_contains(c.m, x))) >= 2 and least(a.s, c.s) >= 15"""
)
def group_consensus(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "package_dir", "symbol", "is_test", "lang").where("package_dir is not null")
    one = b.where("not is_test").groupBy("package_dir").agg(F.sort_array(F.collect_set("symbol")).alias("members"), (F.count("*") * 3).alias("saved"))
    two = b.where("lang = 'go'").groupBy("package_dir").agg(F.collect_set("symbol").alias("members"), (F.count("*") * 4).alias("saved"))
    return R.agree_groups(one, two, "package_dir", "members", "saved").select("package_dir", F.array_join("members", " ").alias("members"), "saved")


_CALLS = r"([A-Za-z_][A-Za-z0-9_]*)\("


@query(
    f"""with t as (select block_id, repo, package_dir, len(string_split(body, chr(10))) l, list_distinct(regexp_extract_all(body, '{_CALLS}', 1)) c from {BLOCKS_SQL} where is_test and body is not null and package_dir is not null and repo is not null)
    select a.repo, a.package_dir, a.block_id a, b.block_id b, len(list_intersect(a.c, b.c))::bigint n from t a join t b on a.package_dir = b.package_dir and a.repo = b.repo and a.block_id < b.block_id
    where len(list_intersect(a.c, b.c)) > 0 and len(list_intersect(a.c, b.c)) >= least(2, len(a.c), len(b.c)) and len(list_intersect(a.c, b.c)) >= 0.4 * greatest(len(a.c), len(b.c)) and a.l + b.l <= 400"""
)
def close_tests(spark: SparkSession, d: str) -> DataFrame:
    """Test blocks of a package that call much the same."""
    t = blocks(spark, d, "repo", "package_dir", "content", "is_test").where("is_test and content is not null and package_dir is not null and repo is not null")
    t = t.select("block_id", "repo", "package_dir", F.size(F.split("content", "\n")).alias("lines"), F.regexp_extract_all("content", F.lit(_CALLS), F.lit(1)).alias("calls"))
    return R.close_pairs(t, ["repo", "package_dir"], "block_id", "calls", "lines")


# States.

def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks as of seven tenths of the time between the first and the last load, and now."""
    b = table(spark, d, "blocks").where("block_id is not null")
    span = b.agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).first()
    cut = span["a"] + (span["b"] - span["a"]) * 0.7 if span["a"] else None
    cols = ["identity", "content_hash", "loaded_at", "repo"]
    return (keep_best(x, ["block_id"], [F.col("loaded_at")], cols) for x in (b.where(F.col("loaded_at") <= F.lit(cut)), b))


_SNAP = """t as (select min(loaded_at) a, max(loaded_at) b from blocks where block_id is not null), u as (select a + to_microseconds(((epoch_us(b) - epoch_us(a)) * 0.7)::bigint) cut from t),
  o as (select block_id, arg_max(identity, loaded_at) identity, arg_max(content_hash, loaded_at) h from blocks, u where block_id is not null and loaded_at <= cut group by 1),
  n as (select block_id, arg_max(identity, loaded_at) identity, arg_max(content_hash, loaded_at) h from blocks where block_id is not null group by 1)"""


@query(f"with {_SNAP} select block_id from n where not exists (select 1 from o where o.identity is not distinct from n.identity and o.h is not distinct from n.h)")
def changed_blocks(spark: SparkSession, d: str) -> DataFrame:
    before, now = _snapshots(spark, d)
    return D.changed(now, before, ["identity", "content_hash"]).select("block_id")


@query(
    f"""with {_SNAP}, c as (select identity from n where not exists (select 1 from o where o.identity is not distinct from n.identity and o.h is not distinct from n.h)),
    m as (select match_id, any_value({CANONICAL_IDENTITY('left_identity')}) l, any_value({CANONICAL_IDENTITY('right_identity')}) r from matches where match_id is not null group by 1)
    select match_id from m where l in (select identity from n) and r in (select identity from n) and l not in (select identity from c where identity is not null) and r not in (select identity from c where identity is not null)"""
)
def restored_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of which neither end changed and both still exist."""
    before, now = _snapshots(spark, d)
    ids = D.changed(now, before, ["identity", "content_hash"]).select("identity").where("identity is not null")
    m = keep_best(table(spark, d, "matches").where("match_id is not null"), ["match_id"], [F.col("loaded_at")], ["left_identity", "right_identity"])
    m = m.select("match_id", canonical_identity(F.col("left_identity")).alias("l"), canonical_identity(F.col("right_identity")).alias("r"))
    return D.restored(m, ids, now.select("identity"), "l", "r").select("match_id")


@query(
    f"""with {_SNAP}, b as (select identity, max(h) h from o where identity is not null group by 1)
    select n.block_id, coalesce(n.h, b.h) content_hash from n left join b on b.identity = n.identity"""
)
def carried_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Missing hashes filled from the earlier state of the same identity (its greatest)."""
    before, now = _snapshots(spark, d)
    b = before.where("identity is not null").groupBy("identity").agg(F.max("content_hash").alias("content_hash"))
    return D.carried_over(now.select("block_id", "identity", "content_hash"), b, ["identity"], ["content_hash"]).select("block_id", "content_hash")


_RUN_FILES = f"""g as (select distinct run_id, repo, module_dir, started_at, finished_at from scan_runs where status = 'ok' and source_digest is not null and finished_at is not null),
  k as (select x.run_id, max_by(y.run_id, (y.finished_at, y.run_id)) base from g x join g y on x.repo = y.repo and x.module_dir = y.module_dir and y.finished_at <= x.started_at and y.run_id <> x.run_id group by 1),
  s as (select run_id, {CANONICAL_PATH('file_path')} path, max(lower(sha256)) h from source_files where sha256 is not null and file_path is not null group by 1, 2)"""


@query(
    f"""with {_RUN_FILES}, n as (select k.run_id, s.path, s.h from k join s using (run_id)), b as (select k.run_id, s.path source, s.h from k join s on s.run_id = k.base),
    same as (select n.run_id, n.path, b.source, n.h from n join b on b.run_id = n.run_id and b.h = n.h and b.source = n.path),
    fn as (select *, row_number() over (partition by run_id, h order by path) r from n where (run_id, path) not in (select run_id, path from same)),
    fb as (select *, row_number() over (partition by run_id, h order by source) r from b where (run_id, source) not in (select run_id, source from same))
    select run_id, path, source, 'same' how from same union all select fn.run_id, fn.path, fb.source, case when fb.source is null then 'new' else 'moved' end from fn left join fb on fb.run_id = fn.run_id and fb.h = fn.h and fb.r = fn.r"""
)
def reused_files(spark: SparkSession, d: str) -> DataFrame:
    """For each run, which file of its baseline every file's results can be taken from."""
    scratch = Scratch(spark, "reuse")
    good = scratch.cut(successful_runs(table(spark, d, "scan_runs")), "runs")
    base = scratch.cut(baselines(good, scratch), "base")
    s = table(spark, d, "source_files").where("sha256 is not null and file_path is not null").groupBy("run_id", canonical_path(F.col("file_path")).alias("path")).agg(F.max(F.lower("sha256")).alias("h"))
    now = base.join(s, "run_id").select("run_id", "path", "h")
    before = base.join(s.withColumnRenamed("run_id", "baseline"), "baseline").select("run_id", "path", "h")
    return D.reused_files(now, before, "path", "h", ["run_id"])


@query(
    """with d as (select o_custkey k, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) v, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' del from orders group by 1)
    select coalesce(c_custkey, k) c_custkey, case when k is not null then v else c_mktsegment end c_mktsegment from customer full join d on k = c_custkey where not coalesce(del, false)"""
)
def overlaid_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with upserts and deletions from their last orders."""
    last = keep_best(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderpriority", "o_orderstatus"])
    delta = last.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), (F.col("o_orderstatus") == "F").alias("gone"))
    return D.overlay(table(spark, d, "customer"), delta, "c_custkey", "c_mktsegment", "gone")


_FACTS = f"""f as (select distinct pair_id, unnest([{{'i': left_identity, 'h': lower(left_hash)}}, {{'i': right_identity, 'h': lower(right_hash)}}]) x from pairs where pair_id is not null),
  c as (select identity, max(lower(content_hash)) h from {BLOCKS_SQL} where identity is not null group by 1)"""


@query(f"with {_FACTS} select pair_id, bool_and(f.x.h is not distinct from c.h) holds from f left join c on c.identity = f.x.i group by 1")
def pair_facts_hold(spark: SparkSession, d: str) -> DataFrame:
    """Whether both hashes a pair was found with are still those of its blocks, absent ones included."""
    p = table(spark, d, "pairs").where("pair_id is not null")
    f = p.select("pair_id", F.explode(F.array(*[F.struct(F.col(f"{s}_identity").alias("identity"), F.lower(f"{s}_hash").alias("h")) for s in ("left", "right")])).alias("x")).select("pair_id", "x.*").distinct()
    now = blocks(spark, d, "identity", "content_hash").where("identity is not null").groupBy("identity").agg(F.max(F.lower("content_hash")).alias("h"))
    return D.facts_match(f, now, "pair_id", ["identity"], "h")


@query(
    f"""with c as (select identity, max(lower(content_hash)) h from {BLOCKS_SQL} where identity is not null group by 1), p as (select distinct * from pairs where pair_id is not null),
    g as (select split_part(left_identity, '/', 1) || '/' || split_part(left_identity, '/', 2) grp, pair_id, left_identity li, lower(left_hash) lh, right_identity ri, lower(right_hash) rh from p where left_identity is not null),
    v as (select g.*, a.h is not null and b.h is not null ok from g left join c a on a.identity = li and a.h = lh left join c b on b.identity = ri and b.h = rh)
    select distinct pair_id from v where grp in (select grp from v group by 1 having bool_and(ok))"""
)
def replayable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the top directories in which every pair's hashes still hold: all or nothing."""
    p = table(spark, d, "pairs").where("pair_id is not null and left_identity is not null").distinct()
    p = p.select("pair_id", F.substring_index("left_identity", "/", 2).alias("grp"), "left_identity", F.lower("left_hash").alias("lh"), "right_identity", F.lower("right_hash").alias("rh"))
    now = blocks(spark, d, "identity", "content_hash").where("identity is not null").groupBy("identity").agg(F.max(F.lower("content_hash")).alias("h"))
    return D.replayable(p, [("left_identity", "lh"), ("right_identity", "rh")], now, "identity", "h", ["grp"]).select("pair_id").distinct()


@query(f"with {_RUN_FILES} select run_id, sha256(sum(('0x' || substr(md5(length(path) || ':' || path || length(h) || ':' || h), 1, 15))::bigint) || ':' || sum(('0x' || substr(md5(length(path) || ':' || path || length(h) || ':' || h), 16, 15))::bigint) || ':' || count(*)) digest, count(*) \"rows\" from s where run_id is not null group by 1")
def source_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the files of every run, whatever their order."""
    s = table(spark, d, "source_files").where("run_id is not null and sha256 is not null and file_path is not null").groupBy("run_id", canonical_path(F.col("file_path")).alias("path")).agg(F.max(F.lower("sha256")).alias("h"))
    return D.digest(s, ["path", "h"], ["run_id"])


@query(
    """with m as (select md5(coalesce(length(l_orderkey::varchar) || ':' || l_orderkey::varchar, '-') || coalesce(length(l_partkey::varchar) || ':' || l_partkey::varchar, '-') || coalesce(length(l_linenumber::varchar) || ':' || l_linenumber::varchar, '-') || coalesce(length(l_returnflag) || ':' || l_returnflag, '-')) h from lineitem),
    b as (select ('0x' || substr(h, 31, 2))::int b, sum(('0x' || substr(h, 1, 15))::bigint) x, sum(('0x' || substr(h, 16, 15))::bigint) y, count(*) n from m group by 1)
    select sha256(string_agg(t, chr(10) order by t)) digest, sum(n)::bigint \"rows\" from (select b || ':' || x || ':' || y || ':' || n t, n from b)"""
)
def lineitem_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a whole table that gathers no rows."""
    return D.table_digest(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])


@query(
    """with r as (select coalesce(length(l_orderkey::varchar) || ':' || l_orderkey::varchar, '-') || coalesce(length(l_linenumber::varchar) || ':' || l_linenumber::varchar, '-') || coalesce(length(l_partkey::varchar) || ':' || l_partkey::varchar, '-') || coalesce(length(l_returnflag) || ':' || l_returnflag, '-') t, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_returnflag) - 1) // 4096 c, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_returnflag) i from lineitem),
    c as (select c, sha256(string_agg(t, chr(10) order by i)) t, count(*) n from r group by c)
    select case when count(*) > 1 then sha256(string_agg(t, chr(10) order by c)) else any_value(t) end digest, sum(n)::bigint \"rows\" from c"""
)
def sorted_lineitem_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a whole table in order, as a tree of digests."""
    return D.sorted_digest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])


@query(
    f"""with {_SNAP}, b as (select identity, max(lower(h)) h from o where identity is not null group by 1), c as (select identity, max(lower(h)) h from n where identity is not null group by 1),
    l as (select distinct pair_id, unnest([left_identity, right_identity]) i from pairs where pair_id is not null),
    f as (select l.pair_id, l.i, b.h from l left join b on b.identity = l.i)
    select f.pair_id, count(*) filter (where f.h is null) absent, bool_and(f.h is not distinct from c.h) holds from f left join c on c.identity = f.i group by 1"""
)
def recorded_facts(spark: SparkSession, d: str) -> DataFrame:
    """What each pair found when it looked up its ends in an earlier state, and whether that still holds."""
    before, now = (x.where("identity is not null").groupBy("identity").agg(F.max(F.lower("content_hash")).alias("h")) for x in _snapshots(spark, d))
    l = table(spark, d, "pairs").where("pair_id is not null").select("pair_id", F.explode(F.array("left_identity", "right_identity")).alias("identity"))
    r = Scratch(spark, "facts").cut(D.recorded(l, before, "pair_id", ["identity"], "h"), "recorded")
    absent = r.groupBy("pair_id").agg(F.count_if(F.col("h").isNull()).alias("absent"))
    return absent.join(D.facts_match(r, now, "pair_id", ["identity"], "h"), "pair_id")


@query(f"with {_RUN_FILES}, n as (select k.run_id, s.path, s.h from k join s using (run_id)), b as (select k.run_id, s.path, s.h from k join s on s.run_id = k.base) select n.run_id, n.path file, b.path || ' of ' || b.h finding from n join b on b.run_id = n.run_id and b.h = n.h and b.path = n.path")
def repointed_findings(spark: SparkSession, d: str) -> DataFrame:
    """A finding for every file of a run's baseline, carried to the run where the file is the same."""
    scratch = Scratch(spark, "repoint")
    good = scratch.cut(successful_runs(table(spark, d, "scan_runs")), "runs")
    base = scratch.cut(baselines(good, scratch), "base")
    s = table(spark, d, "source_files").where("sha256 is not null and file_path is not null").groupBy("run_id", canonical_path(F.col("file_path")).alias("path")).agg(F.max(F.lower("sha256")).alias("h"))
    now = base.join(s, "run_id").select("run_id", "path", "h")
    before = base.join(s.withColumnRenamed("run_id", "baseline"), "baseline").select("run_id", "path", "h")
    found = before.select("run_id", F.col("path").alias("file"), F.concat("path", F.lit(" of "), "h").alias("finding"))
    reuse = D.reused_files(now, before, "path", "h", ["run_id"]).where("how = 'same'")
    return D.repointed(found, reuse, ["run_id"], "file")


@query("select case when count(*) = count(distinct match_id) then 'holds' else 'rows differs' end status from matches")
def attestation(spark: SparkSession, d: str) -> DataFrame:
    """The stamp of the matches, taken over distinct ones, against the table as it is."""
    m = table(spark, d, "matches")
    stamp = m.agg(F.countDistinct("match_id").alias("rows"), F.lit("v1").alias("model"))
    return D.attest(stamp, m.agg(F.count("*").alias("rows"), F.lit("v1").alias("model")), ["model", "rows"])


@query(
    """with n as (select max(loaded_at) now from documents) select doc_id from documents, n where loaded_at is not null and loaded_at < now - case when source is not null then interval 30 day else interval 7 day end"""
)
def prunable_entries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    now = F.lit(docs.agg(F.max("loaded_at")).first()[0])
    return D.unused(docs, "loaded_at", now, F.col("source").isNotNull()).select("doc_id")

