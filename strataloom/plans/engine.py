"""One run over a source tree: scope, all rules, suppression, staleness, order, report; replay and attestation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.frontends import scan
from strataloom.functions import text as X
from strataloom.operators import chunks, clones, deltas, graph, reviews, sequences
from strataloom.operators import findings as R
from strataloom.operators import models as M
from strataloom.operators import vectors as V
from strataloom.runtime import Scratch, together
from strataloom.sources import files as S
from strataloom.sources import stores as K

#: A comment of this form suppresses one rule on the next line of code: marker, rule, --, reason.
MARKER = "strataloom:ignore"
#: Rules that need an embedder or a reviewer: without one a run cannot tell whether their directives are stale.
EMBEDDED = ("semantic_duplicate",)
REVIEWED = ("comment_excuse", "comment_crutch", "helper_fragment", "test_mock_only", "test_serial_excuse", "test_trivial", "test_wasteful", "test_repeated_steps")
#: Methods that the runtime or a codec calls by their name, so nothing in the source need use them (fixed values).
HOOKS = (
    "String", "GoString", "Error", "Format", "Unwrap", "Is", "As", "MarshalJSON", "UnmarshalJSON", "MarshalText", "UnmarshalText", "MarshalBinary", "UnmarshalBinary",
    "MarshalYAML", "UnmarshalYAML", "MarshalXML", "UnmarshalXML", "ServeHTTP", "Scan", "Value", "Read", "Write", "Close", "Len", "Less", "Swap", "Push", "Pop",
)
METHODS, REPEATS = 40, 3

SCHEMA = "file string, line int, col int, kind string, message string"


@dataclass
class Run:
    """What a run found. findings are those no directive covers; used with ``report`` or written as they are."""

    files: DataFrame
    findings: DataFrame
    invalid: DataFrame
    stale: DataFrame
    replayed: bool = False

    def report(self, rules: DataFrame | None = None) -> DataFrame:
        return R.report(self.findings, rules)


def directives(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file, line, target, rule, reason) of the comments that begin with the marker.

    The target is the next line that holds more than a comment, or the directive's own if none follows; a comment behind
    code covers its own line. Looked up among the lines of one file only.
    """
    lines = files.where("content is not null").select(F.col("path").alias("file"), F.split("content", "\n").alias("all"))
    rows = lines.select("file", "all", F.posexplode("all").alias("i", "text"))
    comment = r"(?://|#)\s*" + marker.replace(":", r"\:").replace(r"\:", ":")
    rows = rows.where(F.col("text").rlike(comment))
    body = F.regexp_extract("text", comment + r"(.*)$", 1)
    trailing = ~F.col("text").rlike(r"^\s*" + comment)
    later = F.filter(F.transform("all", lambda t, i: F.when((i > F.col("i")) & ~t.rlike(r"^\s*($|//|#|\*|/\*)"), i + 1)), lambda x: x.isNotNull())
    target = F.when(trailing, F.col("i") + 1).otherwise(F.coalesce(F.try_element_at(later, F.lit(1)), F.col("i") + 1))
    return rows.select(
        "file", (F.col("i") + 1).alias("line"), target.alias("target"), F.trim(F.substring_index(body, "--", 1)).alias("rule"),
        F.when(F.instr(body, "--") > 0, F.trim(F.expr("substring(regexp_extract(text, '" + comment.replace("\\", "\\\\") + "(.*)$', 1), instr(regexp_extract(text, '" + comment.replace("\\", "\\\\") + "(.*)$', 1), '--') + 2)"))).alias("reason"),
    )


def _findings(df: DataFrame, message, kind: str, line: str = "line") -> DataFrame:
    return df.select("file", F.col(line).cast("int").alias("line"), F.lit(1).alias("col"), F.lit(kind).alias("kind"), message.alias("message"))


def cloned(files: DataFrame) -> DataFrame:
    """behavior_clone: functions of at least 3 statements, and stretches of statements, in Go files other than tests that do
    the same as an earlier one.

    The source is one of the same file where there is one apart, else the first of another file. Functions come first, then
    the heavier, then by place: what lies in the span of a clone already named is not named again.
    """
    go, scratch = files.where("lang = 'go' and not is_test"), Scratch(files.sparkSession, "clones")
    f = scan.functions(go, ["path"], "content", "lang").where("statements >= 3")
    f = f.select("path", "line", "end_line", "name", F.lit(0).alias("kind"), F.col("statements").alias("weight"), F.concat(F.lit("f"), "digest").alias("digest"))
    w = scan.windows(go, ["path"], "content", "lang").select("path", "line", "end_line", "name", F.lit(1).alias("kind"), "weight", F.concat(F.substring("kind", 1, 1), "digest").alias("digest"))
    every = scratch.cut(f.unionByName(w), "candidates")
    tied = clones.clone_sources(clones.repeated_only(every, "digest"), "digest", "path", "line", "end_line", ["path", "line", "end_line", "name", "kind", "weight"])
    tied = scratch.cut(tied, "tied")
    order = [F.col("kind"), (-F.col("weight")).alias("_w"), F.col("line"), F.col("end_line").alias("_e"), F.col("name")]
    kept = clones.uncovered(tied, ["path"], order, "line", "end_line")
    what = F.when(F.col("kind") == 0, F.col("name")).otherwise(F.concat(F.lit("a part of "), "name"))
    source = F.when(F.col("kind") == 0, F.col("source_name")).otherwise(F.concat(F.lit("a part of "), "source_name"))
    text = F.format_string("%s does the same as %s at %s:%d", what, source, "source_path", "source_line")
    return _findings(kept.withColumnRenamed("path", "file"), text, "behavior_clone")


def dead(files: DataFrame) -> DataFrame:
    """dead_code: private functions of Go packages that nothing leads to; one finding for each dead source component.

    Any use of a name counts, of a method any use behind a dot in its package, so calls by value, by interface and through
    helpers are seen. Methods that a declared interface names, and those the runtime or a codec calls (``HOOKS``), are
    roots, as are exported names, main, init, tests, and what is named outside of functions.
    """
    go = files.where("lang = 'go'").withColumn("dir", X.directory(F.col("path")))
    scratch = Scratch(files.sparkSession, "dead")
    f = scratch.cut(scan.functions(go, ["path", "dir", "is_test"], "content", "lang"), "functions")
    own = F.when(F.col("receiver") != "", F.concat(F.ltrim(F.col("receiver"), F.lit("*")), F.lit("."), F.col("name"))).otherwise(F.col("name"))
    v = scratch.cut(f.select(F.concat_ws("::", "dir", own).alias("v"), "dir", "name", (F.col("receiver") != "").alias("method"), "exported", "is_test", F.col("path").alias("file"), "line"), "declared")
    used = scratch.cut(scan.uses(go, ["dir", "is_test"], "content", "lang"), "uses")
    named = v.select("v", "dir", "name", "method").distinct()
    e = used.join(named, ["dir", "name"]).where("member or not method")
    edges = e.where("owner is not null").select(F.concat_ws("::", "dir", "owner").alias("src"), F.col("v").alias("dst"))
    hooks = scan.interface_methods(go, ["dir"], "content", "lang").select(F.col("method").alias("name")).distinct()
    roots = v.where(F.col("exported") | F.col("is_test") | F.col("name").isin("main", "init") | (F.col("method") & F.col("name").isin(*HOOKS))).select("v")
    roots = roots.unionByName(e.where("owner is null").select("v")).unionByName(v.where("method").join(hooks, "name", "left_semi").select("v"))
    edges = scratch.cut(edges.where("src <> dst").distinct(), "edges")
    left = scratch.cut(v.join(graph.reachable(edges, roots.distinct()).select("v"), "v", "left_anti").groupBy("v").agg(F.min(F.struct("file", "line", "name")).alias("rank")), "left")
    inner = edges.join(left.select(F.col("v").alias("src")), "src", "left_semi").join(left.select(F.col("v").alias("dst")), "dst", "left_semi")
    tops = graph.source_components(inner, left).join(left, "v").select("rank.*", "members")
    return _findings(tops, F.concat("name", F.lit(" is never used")), "dead_code")


def god_receivers(files: DataFrame, most: int = METHODS) -> DataFrame:
    """god_receiver: types with more than ``most`` methods, those of parts that only they embed included; named at the
    outermost type."""
    files = files.where("not is_test").withColumn("dir", X.directory(F.col("path")))
    scratch = Scratch(files.sparkSession, "receivers")
    f = scan.functions(files, ["dir"], "content", "lang").where("receiver <> ''")
    own = f.groupBy(F.concat_ws("::", "dir", F.ltrim(F.col("receiver"), F.lit("*"))).alias("v")).agg(F.countDistinct("name").alias("amount"))
    t = scratch.cut(scan.types(files, ["path", "dir"], "content", "lang").withColumn("v", F.concat_ws("::", "dir", "type")), "types")
    own = scratch.cut(t.select("v").distinct().join(own, "v", "full_outer").select("v", F.coalesce("amount", F.lit(0)).cast("bigint").alias("amount")), "own")
    parts = t.where("embeds is not null").select(F.col("v").alias("src"), F.concat_ws("::", "dir", "embeds").alias("dst")).join(own.select(F.col("v").alias("dst")), "dst", "left_semi")
    total = scratch.cut(graph.totals_through(parts, own).where(F.col("total") > most), "totals")
    once = parts.groupBy("dst").agg(F.min("src").alias("src"), F.count("*").alias("n")).where("n = 1")
    covered = once.join(total.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v"))
    at = t.groupBy("v").agg(F.min(F.struct(F.col("path").alias("file"), "line", "type")).alias("at"))
    found = total.join(covered, "v", "left_anti").join(at, "v").select("at.*", "total")
    return _findings(found, F.concat("type", F.lit(" has "), F.col("total").cast("string"), F.lit(" methods")), "god_receiver")


def repeated_fixtures(files: DataFrame) -> DataFrame:
    """repeated_test_fixture: the third time tests of a Go package write the same literal."""
    t = files.where("lang = 'go' and is_test").withColumn("dir", X.directory(F.col("path")))
    w = scan.written_fixtures(t, ["path", "dir"], "content", "lang").withColumnRenamed("path", "file")
    third = sequences.nth_occurrence(w, ["dir", "literal"], ["file", "line"], REPEATS)
    return _findings(third, F.lit("the same fixture is written for the third time"), "repeated_test_fixture")


def unmarked_support(files: DataFrame) -> DataFrame:
    """test_support_filename: files of an internal Go package that only tests import, without test_support in the name.

    Packages whose path speaks of tests are marked by that. An import names the package whose directory is the longest
    that it ends with.
    """
    go = files.where("lang = 'go'").withColumn("dir", X.directory(F.col("path")))
    scratch = Scratch(files.sparkSession, "support")
    i = scratch.cut(scan.imports(go, ["dir", "is_test"], "content", "lang").distinct(), "imports")
    # Every tail of an import path may be a directory of the tree; the longest there is counts.
    tails = i.select("*", F.explode(F.sequence(F.lit(1), F.size(F.split("imported", "/")))).alias("n")).withColumn("to", F.array_join(F.slice(F.split("imported", "/"), -F.col("n"), F.col("n")), "/"))
    there = go.where("not is_test").select(F.col("dir").alias("to")).distinct()
    met = tails.join(there, "to").groupBy("dir", "is_test", "imported").agg(F.max_by("to", "n").alias("to")).where("dir <> to")
    edges = scratch.cut(met.select(F.concat(F.when(F.col("is_test"), "test:").otherwise("code:"), F.col("dir")).alias("src"), F.concat(F.lit("code:"), F.col("to")).alias("dst")), "edges")
    own = go.select(F.concat(F.when(F.col("is_test"), "test:").otherwise("code:"), F.col("dir")).alias("v"), "dir", "is_test").distinct()
    inner = F.array_contains(F.split("dir", "/"), "internal")
    entry = own.where(~F.col("is_test") & ~inner)
    imported = edges.select(F.col("dst").alias("v")).distinct()
    unused = own.where(~F.col("is_test")).join(imported, "v", "left_anti")  # programs, and what nothing imports
    only = graph.only_through(edges, own.where("is_test").select("v"), entry.select("v").unionByName(unused.select("v")).distinct())
    support = own.where(~F.col("is_test") & inner & ~F.exists(F.split("dir", "/"), lambda p: p.contains("test"))).join(only, "v", "left_semi").select("dir")
    name = F.regexp_replace(X.base_name(F.col("path")), r"\.go$", "")
    bare = go.where(~F.col("is_test") & ~F.col("generated") & ~F.concat(F.lit("_"), name, F.lit("_")).contains("_test_support_")).join(support, "dir", "left_semi")
    found = bare.select(F.col("path").alias("file"), (F.size(F.split(F.split("content", r"(?m)^package\b")[0], "\n"))).alias("line"))
    return _findings(found, F.lit("only tests import this file, but its name does not say so"), "test_support_filename")


def duplicates(files: DataFrame, embedder: M.Embedder, dims: int, gates: V.Gates | None = None) -> DataFrame:
    """semantic_duplicate: groups of functions whose vectors are alike; one finding a group, at its first match."""
    scratch = Scratch(files.sparkSession, "duplicates")
    b = scratch.cut(scan.function_texts(files.withColumn("dir", X.directory(F.col("path"))), ["path", "dir", "lang", "is_test"], "content", "lang").withColumn("id", F.concat_ws("::", "path", "name", "line")), "blocks")
    pieces = chunks.exploded(b, ["id"], "content")
    v = M.once_per_content(pieces, "piece", lambda i: M.embed(i, embedder)).withColumn("channel", F.lit("source"))
    units = b.select("id", "path", "dir", "lang", F.lit("tree").alias("repo"), "is_test", F.lit(True).alias("changed"))
    m = scratch.cut(V.similar_blocks(units, V.packed(v, "id", "channel", ["chunk_ix"], "vec", dims), gates or V.Gates(), dims), "matches")
    groups = graph.components(m.select(F.col("left").alias("src"), F.col("right").alias("dst")))
    first = graph.first_of_group(m, "left", "right", groups, [F.col("left"), F.col("right"), F.col("embedding")])
    at = b.select(F.col("id").alias("left"), F.col("path").alias("file"), "line", F.col("name").alias("a"))
    to = b.select(F.col("id").alias("right"), F.col("name").alias("b"), F.concat_ws(":", "path", F.col("line").cast("string")).alias("where"))
    found = first.join(at, "left").join(to, "right")
    more = F.when(F.col("members") > 2, F.concat(F.lit(" and "), X.plural(F.col("members") - 2, "other"))).otherwise("")
    return _findings(found, F.concat("a", F.lit(" is much like "), "b", F.lit(" at "), "where", more), "semantic_duplicate")


def repeated_steps(files: DataFrame, provider: M.Responder, policy: dict, others: DataFrame) -> DataFrame:
    """test_repeated_steps: groups of close tests of a file that a reviewer twice names as repeating each other, with at
    least 15 lines saved, and no other finding on them."""
    t = scan.test_calls(files.where("is_test"), ["path"], "content", "lang").withColumn("lines", F.col("end_line") - F.col("line") + 1)
    scratch = Scratch(files.sparkSession, "steps")
    t = scratch.cut(t.withColumn("id", F.concat_ws("::", "path", "name", F.col("line").cast("string"))), "tests")
    pairs = R.close_pairs(t, ["path"], "id", "calls", "lines")
    groups = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("v").alias("id"), "component")
    units = scratch.cut(sequences.cut_at_caps(groups.join(t, "id"), ["component"], ["line", "id"], "lines", 8, 400), "units")
    unit = units.groupBy("path", "component", "unit").agg(
        F.sort_array(F.collect_list(F.struct("line", "end_line", "name"))).alias("m"), F.min("line").alias("line"), F.max("end_line").alias("end_line")
    ).where(F.size("m") >= 2)  # at most 8 tests a unit
    schema = "members array<string>, saved int"
    kind = M.T._parse_datatype_string(schema)
    prompt = M.prompt_text("Which of these tests repeat each other's steps, and how many lines would be saved?", kind, F.array_join(F.transform("m", lambda x: x["name"]), ", "))
    asked = scratch.cut(unit.withColumn("key", M.request_key(policy, ["path", "m"])).withColumn("prompt", prompt), "asked")
    one = scratch.cut(M.run_tasks(asked.select("key", "prompt"), "key", "prompt", provider, kind)[0].select("key", "answer.*"), "first")
    two = scratch.cut(M.run_tasks(asked.select("key", "prompt"), "key", "prompt", provider, kind)[0].select("key", "answer.*"), "second")
    both = R.agree_groups(one, two, "key", "members", "saved").join(asked.select("key", F.col("path").alias("file"), "line", "end_line"), "key")
    free = R.not_containing(both, others, "file", "line", "end_line", "line")
    return _findings(free, F.concat(X.listing(F.col("members")), F.lit(" repeat each other's steps; "), X.plural(F.col("saved"), "line"), F.lit(" less")), "test_repeated_steps")


def analyse(files: DataFrame, embedder: M.Embedder | None = None, dims: int = 32, reviewer: M.Responder | None = None, policy: dict | None = None, gates: V.Gates | None = None) -> DataFrame:
    """The findings of all rules over classified files, before any directive. Streams that do not need each other run as
    jobs of their own at the same time."""
    spark = files.sparkSession
    scratch = Scratch(spark, "run")
    files = scratch.cut(files, "files")
    renamed = lambda df: df.select(F.col("path").alias("file"), "line", F.lit(1).alias("col"), "kind", "message")
    each = {
        "rules": lambda: renamed(scan.findings(files, ["path"], "content", "lang", "is_test")),
        "clones": lambda: cloned(files),
        "dead": lambda: dead(files),
        "receivers": lambda: god_receivers(files),
        "fixtures": lambda: repeated_fixtures(files),
        "support": lambda: unmarked_support(files),
    }
    if embedder:
        each["duplicates"] = lambda: duplicates(files, embedder, dims, gates)
    if reviewer:
        items = lambda: scan.review_items(files, ["path"], "content", "lang", "is_test")
        each["review"] = lambda: renamed(reviews.judged(items(), reviewer, policy or {}, ["path"])[0])
    done = together(spark, {n: (lambda n=n, f=f: Scratch(spark, n).cut(f(), n)) for n, f in each.items()})
    found = None
    for df in done.values():
        found = df if found is None else found.unionByName(df)
    found, _ = reviews.candidates_and_findings(found)
    if reviewer:
        # A reviewer decides which dropped errors matter; without one the candidates themselves are named.
        found = found.where("kind <> 'swallowed_error'").unionByName(done["review"].where("kind = 'swallowed_error'"))
        found = found.unionByName(repeated_steps(files, reviewer, policy or {}, found.where("kind in ('repeated_test_fixture', 'test_trivial', 'test_wasteful')")))
    return found.distinct()


def run(spark: SparkSession, root: str, patterns: list[str] | None = None, embedder: M.Embedder | None = None, dims: int = 32, reviewer: M.Responder | None = None, policy: dict | None = None, store: str | None = None, gates: V.Gates | None = None) -> Run:
    """All rules over the files of a tree in scope, less what directives cover; see ``outcome``.

    store: a folder of earlier runs: the findings of an unchanged tree under an unchanged policy are read back, not
    computed again.
    """
    patterns = patterns or ["..."]
    files = S.scripts(S.files(spark, root), patterns).where("not generated")
    compute = lambda: analyse(files, embedder, dims, reviewer, policy, gates)
    have = (EMBEDDED if embedder else ()) + (REVIEWED if reviewer else ())
    replayed = False
    if store:
        asked = {"patterns": sorted(patterns), "have": have, "dims": dims, "gates": repr(gates), **(policy or {})}
        found, replayed = replay(spark, store, run_key(files, asked), compute)
    else:
        found = compute()
    return outcome(files, found, patterns == ["..."], have, replayed)


def outcome(files: DataFrame, found: DataFrame, complete: bool, have: tuple[str, ...] = (), replayed: bool = False) -> Run:
    """What is left of findings after the directives of the files. Directives without use are findings if the scope was
    everything, save those for rules that were not evaluated."""
    valid, invalid = R.valid_directives(directives(files))
    bad = invalid.select("file", "line", F.lit(1).alias("col"), F.lit("invalid_ignore").alias("kind"), F.col("problem").alias("message"))
    missing = [k for k in (*EMBEDDED, *REVIEWED) if k not in have]
    stale = R.stale(found, valid, complete, ~F.col("rule").isin(*missing) if missing else None)
    gone = stale.select("file", "line", F.lit(1).alias("col"), F.lit("stale_ignore").alias("kind"), F.concat("rule", F.lit(" does not occur here")).alias("message"))
    return Run(files, R.suppress(found, valid).unionByName(bad).unionByName(gone), invalid, stale, replayed)


def run_key(files: DataFrame, policy: dict) -> str:
    """Everything the findings of a run depend on: the rules' version, the policy, and a digest of all files."""
    digest = deltas.table_digest(files, ["path", "content"]).first()["digest"]
    return M.hashlib.sha256(json.dumps([RULES_VERSION, digest, policy], sort_keys=True).encode()).hexdigest()


#: Goes up with every change of the rules, so that stored findings are not taken for those of new rules.
RULES_VERSION = 2


def replay(spark: SparkSession, store: str, key: str, compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored findings of a key, or those computed and stored now; and whether they were stored."""
    at = f"{store.rstrip('/')}/{key}"
    if K.read_text(spark, f"{at}.done") is not None:
        return spark.read.schema(SCHEMA).parquet(at), True
    compute().write.mode("overwrite").parquet(at)
    K.write_text(spark, f"{at}.done", key)
    return spark.read.schema(SCHEMA).parquet(at), False


def package_keys(files: DataFrame, policy: dict) -> DataFrame:
    """``(dir, key)``: what the per-file findings of a Go package depend on: the policy, its own sources, and what the
    packages it imports export. A change inside an imported package that its exports do not show changes no key here."""
    f = files.withColumn("dir", X.directory(F.col("path")))
    own = deltas.digest(f, ["path", "content"], ["dir"]).select("dir", F.col("digest").alias("sources"))
    api = deltas.digest(scan.exports(f.where("not is_test"), ["dir"], "content", "lang"), ["signature"], ["dir"]).select(F.col("dir").alias("to"), F.col("digest").alias("api"))
    i = scan.imports(f, ["dir"], "content", "lang").distinct()
    tails = i.select("*", F.explode(F.sequence(F.lit(1), F.size(F.split("imported", "/")))).alias("n")).withColumn("to", F.array_join(F.slice(F.split("imported", "/"), -F.col("n"), F.col("n")), "/"))
    met = tails.join(api, "to").groupBy("dir", "imported").agg(F.max_by(F.struct("to", "api"), "n").alias("x")).select("dir", "x.*")
    of = deltas.digest(met, ["to", "api"], ["dir"]).select("dir", F.col("digest").alias("imports"))
    key = F.sha2(F.concat_ws("|", F.lit(json.dumps([RULES_VERSION, policy], sort_keys=True)), "sources", F.coalesce("imports", F.lit("none"))), 256)
    return own.join(of, "dir", "left").select("dir", key.alias("key"))


def package_findings(spark: SparkSession, files: DataFrame, store: str, policy: dict) -> tuple[DataFrame, int]:
    """The per-file findings of all packages, of which only those with a new key are computed; and how many these were."""
    entries = K.Entries(spark, store)
    scratch = Scratch(spark, "packages")
    keys = scratch.cut(package_keys(files, policy), "keys")
    p, fs = entries._fs()
    known = entries.get(keys, "key") if fs.exists(p(entries._at("entries"))) else None
    new = scratch.cut(keys if known is None else keys.join(known.select("key"), "key", "left_anti"), "new")
    n = new.count()
    if n:
        f = files.withColumn("dir", X.directory(F.col("path"))).join(new, "dir")
        found = scan.findings(f, ["key", "path"], "content", "lang", "is_test").select("key", F.col("path").alias("file"), "line", F.lit(1).alias("col"), "kind", "message")
        rows = found.groupBy("key").agg(F.collect_list(F.struct("file", "line", "col", "kind", "message")).alias("rows"))  # of one package
        entries.put(new.select("key").join(rows, "key", "left"), "key")
    got = entries.get(keys, "key")
    return got.select(F.explode("rows").alias("r")).select("r.*"), n


def attest(spark: SparkSession, outcome: Run, path: str, policy: dict) -> bool:
    """Write the stamp of a clean run: policy and a digest of all files. Returns whether it was clean, by the rules of ``run``."""
    clean = outcome.findings.isEmpty()
    digest = deltas.table_digest(outcome.files, ["path", "content"]).first()["digest"]
    return K.write_stamp(spark, path, {"schema": 1, "digest": digest, **policy}, clean)


def verify(spark: SparkSession, outcome_files: DataFrame, path: str, policy: dict) -> str:
    """holds, missing, or what differs: the check that needs no analysis."""
    stamp = K.read_stamp(spark, path)
    if not stamp:
        return "missing"
    for name, value in policy.items():
        if stamp.get(name) != value:
            return f"{name} differs"
    return "holds" if stamp["digest"] == deltas.table_digest(outcome_files, ["path", "content"]).first()["digest"] else "digest differs"
