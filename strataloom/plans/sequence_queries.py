"""Queries on ordered rows: events of a user, runs of a module, lines of a document, blocks of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.text import listing
from strataloom.operators import sequences as S
from strataloom.operators import usage as U
from strataloom.operators.ordering import keep_best
from strataloom.plans.registry import registrar
from strataloom.plans.text_queries import BLOCKS_SQL, NAME_SQL, WORDS_SQL, blocks, name_of
from strataloom.runtime import table

QUERIES, SQL, query = registrar()


USER, TIME = ["user_id"], ["ts", "event_id"]
OVER = "over (partition by user_id order by ts, event_id)"


@query(
    """with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) i, event_type t from events),
    l as (select user_id, list(t order by i) a from e group by user_id),
    w as (select array_to_string(a[s:s + n - 1], '>') pattern, n width from (select a, unnest(range(1, len(a) + 1)) s from l), (select unnest(range(3, 13)) n) where s + n - 1 <= len(a))
    select width::int width, pattern, count(*) n from w group by all having count(*) > 1"""
)
def repeated_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 3 to 12 consecutive events that occur more than once."""
    w = S.sliding_windows(table(spark, d, "events"), USER, TIME, "event_type")
    return w.groupBy("width", F.array_join("items", ">").alias("pattern")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"""select event_id from (select event_id, value, event_type, lag(event_type) {OVER} p, lead(event_type) {OVER} n from events)
    where event_type in ('purchase', 'signup') and value >= case when p in ('purchase', 'signup') or n in ('purchase', 'signup') then 9 else 15 end"""
)
def neighbour_minimum(spark: SparkSession, d: str) -> DataFrame:
    """Structured events above a size that is lower next to another structured one."""
    return S.sized_by_neighbours(table(spark, d, "events"), USER, TIME, F.col("event_type").isin("purchase", "signup"), F.col("value")).select("event_id")


@query(
    f"""with g as (select user_id, event_id, ts, case when ts - lag(ts) {OVER} <= interval 12 hour then 0 else 1 end s from events),
    r as (select user_id, ts, sum(s) {OVER.replace(')', ' rows unbounded preceding)')} run from g)
    select user_id, run::bigint run, min(ts) first_ts, count(*) n from r group by all having count(*) > 10"""
)
def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of a user without a gap of more than 12 hours, if longer than 10."""
    gap = F.col("ts") - S.previous("ts", USER, TIME) > F.expr("interval 12 hours")
    r = S.islands(table(spark, d, "events"), USER, TIME, F.coalesce(gap, F.lit(True)))
    return r.groupBy("user_id", "run").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).where("n > 10")


@query(
    f"""with b as (select block_id, repo, relative_path, line from {BLOCKS_SQL} where repo is not null and relative_path is not null and line is not null),
    g as (select *, case when line - lag(line) over w <= 60 then 0 else 1 end s from b window w as (partition by repo, relative_path order by line, block_id)),
    r as (select *, sum(s) over (partition by repo, relative_path order by line, block_id rows unbounded preceding) run from g)
    select repo, relative_path, run::bigint run, min(line) first_line, max(line) last_line, count(*) n from r group by all having count(*) > 1"""
)
def adjacent_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a file that follow each other within 60 lines, as groups."""
    b = blocks(spark, d, "repo", "relative_path", "line").dropna(subset=["repo", "relative_path", "line"])
    key, order = ["repo", "relative_path"], ["line", "block_id"]
    r = S.islands(b, key, order, F.col("line") - S.previous("line", key, order) > 60)
    return r.groupBy(*key, "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n")).where("n > 1")


@query(
    f"""with g as (select *, case when event_type = lag(event_type) {OVER} then 0 else 1 end s from events),
    r as (select *, sum(s) {OVER.replace(')', ' rows unbounded preceding)')} run from g),
    a as (select user_id, run, any_value(event_type) kind, count(*) n, min(event_id) first_event from r group by user_id, run)
    select user_id, kind, n, first_event, next_kind from (select *, lead(kind) over (partition by user_id order by run) next_kind from a) where n >= 2"""
)
def guard_runs(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of at least two equal events, with the kind that ends them."""
    e = table(spark, d, "events")
    r = S.islands(e, USER, TIME, F.col("event_type") != S.previous("event_type", USER, TIME))
    a = r.groupBy("user_id", "run").agg(F.any_value("event_type").alias("kind"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return a.withColumn("next_kind", S.following("kind", USER, ["run"])).where("n >= 2").drop("run")


@query(f"select event_id from (select event_id, event_type = lag(event_type) {OVER} same from events) where same")
def adjacent_equal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type is not null").withColumn("p", S.previous("event_type", USER, TIME)).where("p = event_type").select("event_id")


@query(
    f"""select event_id from (select event_id, event_type, lead(event_type) {OVER} n,
      count(*) filter (where event_type = 'signup') over (partition by user_id order by ts, event_id rows between 2 following and unbounded following) later from events)
    where event_type = 'signup' and n = 'purchase' and coalesce(later, 0) = 0"""
)
def used_once_next(spark: SparkSession, d: str) -> DataFrame:
    """Signups followed at once by a purchase and by no further signup."""
    w = W.partitionBy(*USER).orderBy(*TIME).rowsBetween(2, W.unboundedFollowing)
    e = table(spark, d, "events").withColumn("n", S.following("event_type", USER, TIME)).withColumn("later", F.count(F.when(F.col("event_type") == "signup", 1)).over(w))
    return e.where("event_type = 'signup' and n = 'purchase' and coalesce(later, 0) = 0").select("event_id")


@query(
    f"""with r as (select *, sum((event_type = 'error')::int) {OVER.replace(')', ' rows unbounded preceding)')} ep from events),
    n as (select event_id, row_number() over (partition by user_id, ep, event_type order by ts, event_id) k from r where event_type <> 'error')
    select event_id from n where k = 2"""
)
def repeat_since_invalidation(spark: SparkSession, d: str) -> DataFrame:
    """The second event of a kind since the user's last error."""
    e = table(spark, d, "events").where("event_type is not null")
    return S.since_last(e, USER, TIME, F.col("event_type") == "error", ["event_type"], 2).select("event_id")


@query(
    """select e.event_id, (select arg_min(p.event_id, (p.ts, p.event_id)) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and (p.ts, p.event_id) > (e.ts, e.event_id)) next_purchase
    from events e where e.event_type = 'error'"""
)
def next_purchase(spark: SparkSession, d: str) -> DataFrame:
    """For every error the user's next purchase: a forward as-of join."""
    e = table(spark, d, "events")
    return e.withColumn("next_purchase", S.next_matching(e, USER, TIME, F.col("event_type") == "purchase", "event_id")).where("event_type = 'error'").select("event_id", "next_purchase")


_LINES = """(select doc_id, i line_no, l[i] line from (select doc_id, l, unnest(range(1, len(l) + 1)) i from (select doc_id, string_split(text, chr(10)) l from documents where text is not null)))"""


@query(f"select doc_id, line_no::int line_no, line from (select *, row_number() over (partition by line order by doc_id, line_no) n from {_LINES} where length(line) >= 16) where n = 3")
def third_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Where a line of at least 16 characters occurs for the third time."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.length("line") >= 16)
    return S.nth_occurrence(lines.select("doc_id", (F.col("i") + 1).alias("line_no"), "line"), ["line"], ["doc_id", "line_no"], 3)


@query(
    """select run_id, repo, module_dir from (select *, row_number() over (partition by repo, module_dir order by started_at desc, run_id desc) n
    from (select distinct run_id, repo, module_dir, started_at from scan_runs where started_at is not null)) where n <= 16"""
)
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The newest 16 runs of each module."""
    r = keep_best(table(spark, d, "scan_runs").where("run_id is not null and started_at is not null"), ["run_id"], [F.col("started_at")], ["repo", "module_dir", "started_at"])
    return S.newest(r, ["repo", "module_dir"], [F.col("started_at").desc(), F.col("run_id").desc()], 16).select("run_id", "repo", "module_dir")


@query(
    """with l as (select o_orderkey, list({'q': l_quantity, 'n': l_linenumber, 'p': l_partkey} order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) a from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 1 group by 1)
    select o_orderkey, array_to_string(list_transform(a[1:3], lambda x: x.q::int::varchar || ' at ' || x.n::varchar), ', ') largest from l"""
)
def largest_parts(spark: SparkSession, d: str) -> DataFrame:
    """The three largest lines of each order, stable by line number."""
    l = table(spark, d, "lineitem").where("l_quantity > 1").select("l_orderkey", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    w = W.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_suppkey")
    top = l.withColumn("n", F.row_number().over(w)).where("n <= 3")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" at "), F.col("l_linenumber").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"])
    known = table(spark, d, "orders").select("o_orderkey")
    return top.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(parts, ", ").alias("largest")).join(known, "o_orderkey", "left_semi")


@query(
    """select file_path, obs_id from (select *, row_number() over (partition by repo, file_path order by arrived_at, obs_id) n from source_files where repo is not null and file_path is not null) where n = 1"""
)
def first_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paths of a repository, the first arrival winning."""
    s = table(spark, d, "source_files").where("repo is not null and file_path is not null").select("repo", "file_path", "arrived_at", "obs_id")
    return S.first_wins(s, ["repo", "file_path"], ["arrived_at", "obs_id"]).select("file_path", "obs_id")


@query(
    """with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) i from events where user_id is not null),
    f as (select user_id, event_id, i, 1 unit, 1 items, coalesce(value::bigint, 0) total from (select *, floor(value) fv from e) where i = 1
      union all select e.user_id, e.event_id, e.i, case when f.items = 8 or f.total + coalesce(floor(e.value)::bigint, 0) > 400 then f.unit + 1 else f.unit end,
        case when f.items = 8 or f.total + coalesce(floor(e.value)::bigint, 0) > 400 then 1 else f.items + 1 end,
        case when f.items = 8 or f.total + coalesce(floor(e.value)::bigint, 0) > 400 then coalesce(floor(e.value)::bigint, 0) else f.total + coalesce(floor(e.value)::bigint, 0) end
      from f join e on e.user_id = f.user_id and e.i = f.i + 1)
    select event_id, unit::int unit from f""".replace("coalesce(value::bigint, 0) total", "coalesce(fv::bigint, 0) total")
)
def capped_units(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in order, cut at 8 events or a value of 400."""
    e = table(spark, d, "events").where("user_id is not null").select("user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("size"))
    return S.cut_at_caps(e, USER, TIME, "size", 8, 400).select("event_id", "unit")


@query(
    """with recursive d as (select strlen(text)::bigint b, row_number() over (order by strlen(text), doc_id) i from documents where text is not null),
    r as (select i, b, 1 unit, 1 items, b total from d where i = 1
      union all select d.i, d.b, case when items = 128 or total + d.b > 64000 then unit + 1 else unit end, case when items = 128 or total + d.b > 64000 then 1 else items + 1 end,
        case when items = 128 or total + d.b > 64000 then d.b else total + d.b end from r join d on d.i = r.i + 1)
    select 0 lane, unit, count(*) items, sum(b)::bigint bytes, min(b)::int least, max(b)::int most from r group by unit"""
)
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most 128 documents or 64,000 bytes, in order of length."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length("text").alias("bytes"))
    b = S.running_batches(t, ["bytes", "doc_id"], "bytes", 128, 64_000)
    return b.groupBy("lane", "unit").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))


@query(
    f"""with w as (select repo, package_dir, {WORDS_SQL.format(NAME_SQL)} w from {BLOCKS_SQL} where package_dir is not null and repo is not null and symbol is not null),
    c as (select repo, package_dir, case when len(w) >= 2 then w[1] end p, count(*) n from w group by all),
    a as (select repo, package_dir, sum(n)::bigint items, list(p order by p) filter (where n >= 2 and p is not null) l from c group by all)
    select repo, package_dir, items, case len(l) when 1 then l[1] else array_to_string(l[1:-2], ', ') || ' and ' || l[-1] end prefixes from a where items >= 6 and len(l) >= 3"""
)
def mixed_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Packages of at least 6 blocks whose names begin with at least three words that occur twice."""
    b = blocks(spark, d, "repo", "package_dir", "symbol").dropna()
    a = U.mixed_prefixes(b.withColumn("name", name_of(F.col("symbol"))), ["repo", "package_dir"], "name")
    return a.select("repo", "package_dir", "items", listing(F.col("prefixes")).alias("prefixes"))
