"""The relation of findings: ordering, suppression, staleness, coverage, votes, grouping and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.ordering import running_total
from strataloom.runtime import Scratch

#: Kinds that no directive may suppress (fixed values).
PROTECTED = ("stale_ignore", "invalid_ignore", "parse_error")
#: The kind that a directive anywhere in the file suppresses (fixed value).
FILE_KIND = "oversized_owner_file"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "col", "message")


def valid_directives(directives: DataFrame, protected: tuple[str, ...] = PROTECTED) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): a directive needs one rule name, a reason, and a rule that may be suppressed."""
    rule = F.trim(F.coalesce("rule", F.lit("")))
    problem = (
        F.when((rule == "") | rule.rlike(r"[ \t]"), "needs one rule name")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "needs a reason")
        .when(rule.isin(*protected), "cannot be suppressed")
    )
    marked = directives.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def suppress(findings: DataFrame, directives: DataFrame, file_kind: str = FILE_KIND) -> DataFrame:
    """Findings that no directive covers: by file, target line and kind, or by file for the file-level kind."""
    at = directives.select("file", F.col("target").alias("line"), F.col("rule").alias("kind")).distinct()
    whole = directives.where(F.col("rule") == file_kind).select("file", F.col("rule").alias("kind")).distinct()
    return findings.join(at, ["file", "line", "kind"], "left_anti").join(whole, ["file", "kind"], "left_anti")


def stale(findings: DataFrame, directives: DataFrame, complete: bool, covers: Column | None = None, file_kind: str = FILE_KIND) -> DataFrame:
    """Directives that no finding used; none unless the scan was complete. covers: a condition on ``rule``."""
    scope = directives.where(F.lit(complete) & (covers if covers is not None else F.lit(True)))
    used = findings.select("file", F.col("line").alias("target"), F.col("kind").alias("rule")).distinct()
    anywhere = findings.where(F.col("kind") == file_kind).select("file", F.col("kind").alias("rule")).distinct()
    by_line = scope.where(F.col("rule") != file_kind).join(used, ["file", "target", "rule"], "left_anti")
    by_file = scope.where(F.col("rule") == file_kind).join(anywhere, ["file", "rule"], "left_anti")
    return by_line.unionByName(by_file)


def not_containing(groups: DataFrame, points: DataFrame, file: str, start: str, end: str, line: str, reach: int = 64) -> DataFrame:
    """Intervals of a file that contain no point: an interval anti-join on buckets of ``reach`` lines.

    An interval is sent to every bucket it touches and a point to its own, so both sides meet by equality; intervals
    longer than ``reach`` only touch more buckets.
    """
    spans = groups.withColumn("_id", F.xxhash64(*groups.columns))
    split = spans.select("_id", F.col(file).alias("_f"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / reach), F.floor(F.col(end) / reach))).alias("_b"))
    at = points.select(F.col(file).alias("_f"), F.floor(F.col(line) / reach).alias("_b"), F.col(line).alias("_l")).distinct()
    hit = split.join(at, ["_f", "_b"]).where("_l >= _s and _l <= _e").select("_id").distinct()
    return spans.join(hit, "_id", "left_anti").drop("_id")


def agree(votes: DataFrame, item: str, verdict: str, vote: str, accepting: Column, finding: Column) -> DataFrame:
    """``(item, verdict)``: a first vote that finds something stands only if the second says the same; else accepting."""
    first = votes.where(F.col(vote) == 1).groupBy(item).agg(F.first(verdict, ignorenulls=False).alias("v1"))
    second = votes.where(F.col(vote) == 2).groupBy(item).agg(F.first(verdict, ignorenulls=False).alias("v2"))
    both = first.join(second, item, "left").withColumn("verdict", F.col("v1"))
    return both.select(item, F.when(finding & ~F.col("v1").eqNullSafe(F.col("v2")), accepting).otherwise(F.col("v1")).alias("verdict"))


def agree_groups(first: DataFrame, second: DataFrame, group: str, members: str, saved: str, least_members: int = 2, least_saved: int = 15) -> DataFrame:
    """Groups found twice, with the members both named in the first one's order and the smaller saving, if enough is left."""
    b = second.select(group, F.col(members).alias("_m"), F.col(saved).alias("_s"))
    both = first.join(b, group).withColumn(members, F.filter(members, lambda x: F.array_contains("_m", x))).withColumn(saved, F.least(saved, "_s")).drop("_m", "_s")
    return both.where((F.size(members) >= least_members) & (F.col(saved) >= least_saved))


def close_pairs(items: DataFrame, within: list[str], item: str, calls: str, lines: str, shared: int = 2, overlap: float = 0.4, most_lines: int = 400) -> DataFrame:
    """``(within..., a, b, n)``, a < b: items of one file that share enough calls.

    At least min(shared, either's number of calls) and overlap times the larger number, and no more than most_lines
    together. Items meet by their rarest calls only: of n calls at least ceil(overlap * n) must be shared, so with all
    calls in one order, the rarest first, two such items agree in one of their first n - ceil(overlap * n) + 1. A call
    that every item makes is met by it only where an item has few others. The calls of those that met are then compared
    whole.
    """
    one = items.select(*within, F.col(item).alias("i"), F.col(lines).alias("l"), F.array_distinct(F.filter(calls, lambda c: c.isNotNull())).alias("c")).where(F.size("c") > 0)
    each = one.select(*within, "i", F.explode("c").alias("call"))
    often = each.groupBy(*within, "call").agg(F.count("*").alias("n")).where("n > 1")  # a call of one item joins nothing
    first = each.join(often, [*within, "call"]).groupBy(*within, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "call"))), lambda x: x["call"]).alias("rare"))
    # The calls of one item only are the rarest: they take up the first places without meeting anyone.
    n = F.size("c")
    places = n - F.ceil(overlap * n - 1e-9).cast("int") + 1 - (n - F.size("rare"))
    probe = one.join(first, [*within, "i"]).where(places > 0).select(*within, "i", F.explode(F.slice("rare", F.lit(1), places)).alias("call"))
    met = probe.withColumnRenamed("i", "a").join(probe.withColumnRenamed("i", "b"), [*within, "call"]).where("a < b").select(*within, "a", "b").distinct()
    side = lambda s: one.select(*within, F.col("i").alias(s), F.col("c").alias(f"c{s}"), F.col("l").alias(f"l{s}"))
    both = met.join(side("a"), [*within, "a"]).join(side("b"), [*within, "b"]).withColumn("n", F.size(F.array_intersect("ca", "cb")))
    na, nb = F.size("ca"), F.size("cb")
    return both.where((F.col("n") >= F.least(F.lit(shared), na, nb)) & (F.col("n") >= overlap * F.greatest(na, nb)) & (F.col("la") + F.col("lb") <= most_lines)).select(*within, "a", "b", F.col("n").cast("bigint").alias("n"))


def report(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(kind, n, place, text)``: the findings of each kind in order, a row each, with the rule's texts where given.

    Places come from running counts over range partitions: a kind may have any number of findings.
    """
    f = findings.select(F.lit(1).alias("one"), "file", "line", "col", "kind", "message")
    text = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(": "), F.col("message"))
    order = [F.col(c) for c in ("file", "line", "col", "message")]
    placed = running_total(f, Scratch(findings.sparkSession, "report"), ["kind"], order, "one", "before")
    sizes = f.groupBy("kind").agg(F.count("*").alias("n"))
    out = placed.join(sizes, "kind").select("kind", "n", (F.col("before") + 1).alias("place"), text.alias("text"))
    return out if rules is None else out.join(rules.select("kind", "finds", "fix"), "kind", "left")


def as_json(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``(place, text)``: the lines, in order, of one JSON document: the findings in order and the rules they name.

    A line a finding, so that a document of any size is written by range partitions and its parts joined. Places come from
    running counts; the rules are a line a rule.
    """
    f = findings.select("file", "line", "col", "kind", "message", F.lit(1).alias("one"), F.lit(1).alias("all"))
    order = [F.col(c) for c in ("file", "line", "col", "message")]
    placed = running_total(f, Scratch(findings.sparkSession, "json"), ["all"], order, "one", "before")
    issue = F.to_json(F.struct(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string")).alias("position"), "kind", "message"))
    named = rules.join(findings.select("kind").distinct(), "kind", "left_semi").select("kind", F.to_json(F.struct("finds", "fix")).alias("r"), F.lit(1).alias("one"), F.lit(1).alias("all"))
    ruled = running_total(named, Scratch(findings.sparkSession, "json"), ["all"], [F.col("kind")], "one", "before")
    comma = F.when(F.col("before") > 0, ",").otherwise("")
    n = findings.agg(F.count("*").alias("n"), F.countDistinct("kind").alias("k"))
    issues = placed.select((F.col("before") + 1).alias("place"), F.concat(comma, issue).alias("text"))
    after = ruled.join(F.broadcast(n)).select((F.col("n") + 2 + F.col("before")).alias("place"), F.concat(comma, F.concat(F.lit('"'), F.col("kind"), F.lit('":')), F.col("r")).alias("text"))
    frame = n.select(F.explode(F.array(*[F.struct(at.cast("bigint").alias("place"), F.lit(t).alias("text")) for at, t in ((F.lit(0), '{"issues":['), (F.col("n") + 1, '],"rules":{'), (F.col("n") + F.col("k") + 2, "}}"))])).alias("x")).select("x.*")
    return frame.unionByName(issues).unionByName(after)
