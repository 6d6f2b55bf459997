"""Queries on identifiers, paths, lines, tokens and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import paths as P
from strataloom.functions import text as X
from strataloom.operators import models as M
from strataloom.operators.ordering import keep_best
from strataloom.plans.registry import registrar
from strataloom.runtime import table

QUERIES, SQL, query = registrar()


#: The latest row of every block, for SQL.
BLOCKS_SQL = """(
  select block_id, any_value(identity) identity, any_value(symbol) symbol, any_value(package_dir) package_dir, any_value(relative_path) relative_path,
         any_value(lang) lang, any_value(content) body, any_value(content_hash) content_hash, any_value(line) line, any_value(is_test) is_test,
         any_value(repo) repo, any_value(description) description, max(loaded_at) loaded_at
  from blocks where block_id is not null group by block_id)"""

WORDS_SQL = """list_filter(string_split(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '_'), lambda w: w <> '')"""
DIR_SQL = "case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '' end"
NAME_SQL = "list_last(string_split(symbol, '.'))"


def blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest row of every block, with the columns asked for only."""
    want = [c for c in columns if c != "block_id"]
    return keep_best(table(spark, d, "blocks").where("block_id is not null"), ["block_id"], [F.col("loaded_at"), F.xxhash64(*want)], want)


def name_of(symbol):
    """The last part of Receiver.Name."""
    return F.substring_index(symbol, ".", -1)


@query(f"select block_id, array_to_string({WORDS_SQL.format(NAME_SQL)}, ' ') words, len({WORDS_SQL.format(NAME_SQL)})::int n from {BLOCKS_SQL}")
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    w = X.words(name_of(F.col("symbol")))
    return blocks(spark, d, "symbol").select("block_id", F.array_join(w, " ").alias("words"), F.size(w).alias("n"))


@query(
    f"""select block_id, list_has_any({WORDS_SQL.format(NAME_SQL)}, ['helper','manager','processor','util','utils','base','impl','wrapper','queue','worker']) generic,
    regexp_matches({NAME_SQL}, '^Is[A-Z0-9_]') predicate, case when len({WORDS_SQL.format(NAME_SQL)}) >= 2 then ({WORDS_SQL.format(NAME_SQL)})[1] end prefix,
    list_contains({WORDS_SQL.format(NAME_SQL)}, 'snapshot') snapshot from {BLOCKS_SQL}"""
)
def identifier_tests(spark: SparkSession, d: str) -> DataFrame:
    n = name_of(F.col("symbol"))
    generic = F.arrays_overlap(X.words(n), F.array(*map(F.lit, (*X.GENERIC, "queue", "worker"))))
    return blocks(spark, d, "symbol").select("block_id", generic.alias("generic"), X.predicate_name(n).alias("predicate"), X.name_prefix(n).alias("prefix"), X.has_word(n, "snapshot").alias("snapshot"))


@query(
    f"""select block_id, len(list_filter(regexp_extract_all(body, '[A-Za-z0-9_$\\x{{80}}-\\x{{10ffff}}]+'), lambda t: t = {NAME_SQL}))::int n from {BLOCKS_SQL} where body is not null"""
)
def whole_identifier_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """How often the name of a block stands in its content as a whole identifier."""
    b = blocks(spark, d, "symbol", "content").where("content is not null")
    return b.select("block_id", X.occurrences(F.col("content"), name_of(F.col("symbol"))).cast("int").alias("n"))


@query(
    f"""with t as (select block_id, regexp_extract_all(body, '[A-Za-z0-9_]+|[^ \\t\\r\\n]')[1:64] k from {BLOCKS_SQL} where body <> ''),
    b as (select block_id, list_transform(string_split(trim(regexp_replace(hex(encode(array_to_string(k, ' '))), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::hugeint) x from t where len(k) > 0)
    select block_id, list_reduce(list_prepend(14695981039346656037::hugeint, x), lambda h, c: (xor(h, c) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::varchar hash from b"""
)
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a of the first 64 tokens of every block."""
    b = blocks(spark, d, "content").where("content <> ''").select("block_id", F.slice(X.tokens(F.col("content")), 1, 64).alias("k")).where(F.size("k") > 0)
    return b.select("block_id", X.fnv1a(F.array_join("k", " ")).alias("hash"))


@query(
    f"""with t as (select block_id, repo, package_dir, list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+|[^ \\t\\r\\n]')) k from {BLOCKS_SQL} where body <> '' and repo is not null and package_dir is not null),
    n as (select *, row_number() over (partition by repo, package_dir order by block_id) i from t)
    select a.block_id, round(len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))), 9) similarity
    from n a join n b on a.repo = b.repo and a.package_dir = b.package_dir and b.i = a.i - 1 where len(a.k) > 0 and len(b.k) > 0"""
)
def neighbour_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the token sets of each block and the one before it in its package."""
    b = blocks(spark, d, "repo", "package_dir", "content").dropna().where("content <> ''")
    w = W.partitionBy("repo", "package_dir").orderBy("block_id")
    b = b.withColumn("k", F.array_distinct(X.tokens(F.col("content")))).withColumn("p", F.lag("k").over(w))
    return b.where("size(k) > 0 and size(p) > 0").select("block_id", F.round(X.jaccard(F.col("k"), F.col("p")), 9).alias("similarity"))


@query(
    """with a as (select event_id, value x, row_number() over (partition by user_id order by ts, event_id) n from events)
    select event_id, x < n lt, x <= n le, x > n gt, x >= n ge, x = n eq, x <> n ne from a"""
)
def ordered_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons by operator text, each taken from its mirror with the sides exchanged."""
    a = table(spark, d, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    names = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}
    return a.select("event_id", *[X.compare(F.col("n"), X.REVERSED[op], F.col("value")).alias(name) for name, op in names.items()])


@query(
    f"""with d as (select doc_id, file_path, list_last(string_split(file_path, '/')) b, string_split({DIR_SQL.format('file_path')}, '/') dirs from documents where file_path is not null),
    l as (select *, case when b like '%.d.ts' or b like '%.gen.ts' or contains(b, '.min.') then null when b like '%.ts' or b like '%.tsx' then 'ts' when b like '%.py' then 'py' when b like '%.go' then 'go' end lang from d)
    select doc_id, lang, {DIR_SQL.format('file_path')} dir, case lang when 'ts' then regexp_matches(b, '\\.(test|spec)\\.tsx?$') or list_contains(dirs, '__tests__')
      when 'py' then b like 'test\\_%' escape '\\' or b like '%\\_test.py' escape '\\' or b = 'conftest.py' or list_contains(dirs, 'tests') else b like '%\\_test.go' escape '\\' end is_test from l"""
)
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return table(spark, d, "documents").where("file_path is not null").select("doc_id", X.script_language(p).alias("lang"), X.directory(p).alias("dir"), X.test_file(p).alias("is_test"))


@query(
    """select doc_id, (length(text) - length(replace(text, chr(10), '')) + case when text <> '' and not suffix(text, chr(10)) then 1 else 0 end)::int lines,
    regexp_matches(array_to_string(string_split(text, chr(10))[1:5], chr(10)), '@generated|DO NOT EDIT|Code generated') generated from documents where text is not null"""
)
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.line_count(t).cast("int").alias("lines"), X.generated_file(t).alias("generated"))


@query(
    """select doc_id, i::int line_no, i::varchar || ': ' || string_split(text, chr(10))[i] line from
    (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents where text is not null and doc_kind = 'source_file')"""
)
def numbered_source_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and doc_kind = 'source_file'")
    return rows.select("doc_id", F.posexplode(X.numbered_lines(F.col("text"))).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


@query(
    f"""with t as (select block_id, regexp_extract_all(body, '[A-Za-z0-9_]+|[^ \\t\\r\\n]') k from {BLOCKS_SQL} where body is not null),
    s as (select block_id, len(k)::int tokens, case when len(k) < 5 then 0 else len(list_distinct(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], chr(1))))) end::int shingles from t)
    select * from s where tokens >= 50"""
)
def block_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at least 50 tokens with the size of their set of 5-token sequences."""
    t = blocks(spark, d, "content").where("content is not null").select("block_id", X.tokens(F.col("content")).alias("t")).where(F.size("t") >= 50)
    return t.select("block_id", F.size("t").alias("tokens"), F.size(X.shingles(F.col("t"))).alias("shingles"))


_PARTS = "list_filter(string_split({0}, '/'), lambda p: p <> '')"
_M = """(select match_id, any_value(left_identity) li, any_value(right_identity) ri, any_value(locality_tier) stored from matches where match_id is not null group by match_id)"""
_CANON = "regexp_replace(replace(split_part({0}, '::', 1), '\\', '/'), '^(\\./)+', '')"


@query(
    f"""with p as (select match_id, {_CANON.format('li')} l, {_CANON.format('ri')} r from {_M} where li is not null and ri is not null),
    q as (select match_id, l, r, {_PARTS.format(DIR_SQL.format('l'))} a, {_PARTS.format(DIR_SQL.format('r'))} b from p),
    c as (select *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) n from q)
    select match_id, (case when l = r then 0 when a = b then 1 else 1 + greatest(len(a) - n, len(b) - n) end)::int tier from c"""
)
def locality_tiers(spark: SparkSession, d: str) -> DataFrame:
    m = keep_best(table(spark, d, "matches").where("match_id is not null"), ["match_id"], [F.col("loaded_at")], ["left_identity", "right_identity"])
    m = m.where("left_identity is not null and right_identity is not null")
    l, r = (F.substring_index(P.canonical_identity(F.col(c)), "::", 1) for c in ("left_identity", "right_identity"))
    m = m.select("match_id", l.alias("l"), r.alias("r"))
    return m.select("match_id", P.locality_tier(F.col("l"), F.col("r"), X.directory(F.col("l")), X.directory(F.col("r"))).alias("tier"))


@query(
    """select pair_id, 'sim-' || substr(sha256(e[1] || '\\x00'::blob || e[2]), 1, 16) made from (select pair_id, list_sort([encode(li) || '\\x00'::blob || encode(lh), encode(ri) || '\\x00'::blob || encode(rh)]) e from
    (select pair_id, any_value(left_identity) li, any_value(left_hash) lh, any_value(right_identity) ri, any_value(right_hash) rh from pairs where pair_id is not null group by pair_id)
    where li is not null and lh is not null and ri is not null and rh is not null)"""
)
def pair_names(spark: SparkSession, d: str) -> DataFrame:
    """Order-free names of pairs."""
    p = table(spark, d, "pairs").where("pair_id is not null").groupBy("pair_id").agg(*[F.any_value(c, True).alias(c) for c in ("left_identity", "left_hash", "right_identity", "right_hash")])
    return p.dropna().select("pair_id", X.pair_id(*map(F.col, ("left_identity", "left_hash", "right_identity", "right_hash"))).alias("made"))


@query(
    f"""select block_id, nullif(trim(regexp_replace(description, '\\s+', ' ', 'g')), '') description, coalesce(len(string_split(nullif(trim(regexp_replace(description, '\\s+', ' ', 'g')), ''), ' ')) between 4 and 40
    and length(nullif(trim(regexp_replace(description, '\\s+', ' ', 'g')), '')) <= 240, false) valid from {BLOCKS_SQL} where description is not null"""
)
def description_records(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions in one form, with whether they keep the limits of 4 to 40 words and 240 characters."""
    s = blocks(spark, d, "description").where("description is not null").select("block_id", X.squeeze(F.col("description")).alias("description"))
    return s.withColumn("valid", X.description_fits(F.col("description")))


@query(
    f"""select block_id, array_to_string(list_filter(regexp_extract_all(body, '%[-+# 0]*[0-9*]*(?:\\.[0-9*]+)?[a-zA-Z%]'), lambda x: not suffix(x, '%')), ' ') directives
    from {BLOCKS_SQL} where contains(body, 'Printf(') or contains(body, 'Errorf(')"""
)
def printf_directives(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "content").where("contains(content, 'Printf(') or contains(content, 'Errorf(')")
    return b.select("block_id", F.array_join(X.printf_directives(F.col("content")), " ").alias("directives"))


@query(
    """select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, case when json_valid(props) then len(json_keys(props)) = 1 and json_keys(props)[1] = 'k' and try_cast(json_extract_string(props, '$.k') as bigint) is not null else false end strict from events"""
)
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    """Decode with a schema; strict tells whether the record is that of the schema and no more."""
    kind = T.StructType([T.StructField("k", T.LongType())])
    record = M.decode_strict(F.col("props"), kind)
    return table(spark, d, "events").select("event_id", F.from_json("props", kind).getField("k").alias("k"), record.isNotNull().alias("strict"))


@query(
    """with a as (select event_id, case when value > 100 then true when value < 20 then false end p, case event_type when 'error' then true when 'view' then false end q from events)
    select event_id, p and q both_true, p or q either, not p negated from a"""
)
def three_valued(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("value") > 100, True).when(F.col("value") < 20, False)
    q = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "view", False)
    return table(spark, d, "events").select("event_id", X.both_known(p, q).alias("both_true"), X.either_known(p, q).alias("either"), (~p).alias("negated"))


@query(
    """with t as (select max(arrived_at) now from source_files) select obs_id, (date_diff('hour', arrived_at, now) >= 24)::boolean due_day, arrived_at < now - interval 30 day unused, arrived_at < now - interval 7 day unknown
    from source_files, t where obs_id is not null"""
)
def retention_ages(spark: SparkSession, d: str) -> DataFrame:
    """Age of rows against retention limits of a day, a week and 30 days, counted from the newest arrival."""
    s = table(spark, d, "source_files").where("obs_id is not null")
    now = F.lit(s.agg(F.max("arrived_at")).first()[0])
    whole = F.date_trunc("hour", now.cast("timestamp")).cast("long") - F.date_trunc("hour", F.col("arrived_at").cast("timestamp")).cast("long")
    age = lambda n: F.col("arrived_at") < now - F.make_dt_interval(F.lit(n))
    return s.select("obs_id", (whole >= 24 * 3600).alias("due_day"), age(30).alias("unused"), age(7).alias("unknown"))


@query(
    f"""select relative_path || ':' || line::varchar || ':' || '1' pos, block_id from {BLOCKS_SQL} where relative_path is not null and line is not null"""
)
def positions(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "relative_path", "line").where("relative_path is not null and line is not null")
    return b.select(X.position(F.col("relative_path"), F.col("line"), F.lit(1)).alias("pos"), "block_id")


@query(
    f"""with n as (select package_dir, list_sort(list_distinct(list(lang))) l, count(*) c from {BLOCKS_SQL} where package_dir is not null group by package_dir)
    select package_dir, case len(l) when 1 then l[1] else array_to_string(l[1:-2], ', ') || ' and ' || l[-1] end langs, c::varchar || ' block' || case when c = 1 then '' else 's' end size from n"""
)
def listings(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "package_dir", "lang").where("package_dir is not null").groupBy("package_dir").agg(F.sort_array(F.collect_set("lang")).alias("l"), F.count("*").alias("c"))
    return b.select("package_dir", X.listing(F.col("l")).alias("langs"), X.plural(F.col("c"), "block").alias("size"))
