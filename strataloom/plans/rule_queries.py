"""Queries on the rules: small sources for every rule, with the findings they must have."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.frontends import scan
from strataloom.functions import text
from strataloom.operators import deltas, graph, usage
from strataloom.operators.models import HashEmbedder
from strataloom.operators.reviews import VERDICTS
from strataloom.plans import engine
from strataloom.plans.frontend_cases import ALIKE, EXPECTED, FORMS, SOURCES
from strataloom.plans.registry import registrar
from strataloom.plans.rule_cases import CASES, TREE, TREE_FINDINGS
from strataloom.sources import files as sources
from strataloom.sources.files import scripts as classified

QUERIES, SQL, query = registrar()


def values(rows: list[tuple], columns: str, empty: str = "") -> str:
    """A literal table in SQL."""
    quoted = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


def _group(name: str):
    cases = CASES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.createDataFrame([(c, lang, test, body) for c, lang, test, body, _ in cases], "name string, lang string, is_test boolean, content string")
        return scan.findings(rows, ["name"], "content", "lang", "is_test").select("name", "line", "kind")

    run.__doc__ = f"Findings of the {name} rules in small sources."
    run.__name__ = f"rules_{name}"
    found = [(c, int(f.split()[0]), f.split()[1]) for c, _, _, _, fs in cases for f in fs]
    return query(values(found, "name, line, kind"))(run)


for _name in CASES:
    _group(_name)


class TreeReviewer:
    """Offline stand-in: decides by what the items say, and changes its mind on one of them."""

    def ask(self, prompt: str) -> str:
        if "repeat each other's steps" in prompt:
            return json.dumps({"members": ["TestA", "TestB"], "saved": 15 + len(prompt) % 3})
        key, item = re.search(r"item (\w+) \((\w+)\)", prompt).groups()
        body = prompt.split("\n\n", 1)[1]
        verdict = VERDICTS[item][0]
        if item == "comment" and "Works around" in body:
            verdict = "excuse"
        if item == "serial" and "folder" in body:
            verdict = "serial_excuse"
        if item == "helper" and "a.length + 1" in body:
            verdict = "fragment"
        return json.dumps({"id": key, "verdict": verdict, "advice": "say what it does instead of this"})


class TwoWords:
    """Offline stand-in for an embedder: counts of words, with those of the first line left out."""

    name = "words"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return HashEmbedder(32).embed([t.split("\n", 1)[-1] for t in texts])


@query(values(TREE_FINDINGS, "file, line, kind"))
def rules_over_files(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over a small tree: all rules, an embedder, a reviewer, and directives."""
    files = classified(spark.createDataFrame(TREE, "path string, content string"), ["..."]).where("not generated")
    found = engine.analyse(files, TwoWords(), 32, TreeReviewer(), {"model": "stand-in"})
    return engine.outcome(files, found, True, (*engine.EMBEDDED, *engine.REVIEWED)).findings.select("file", "line", "kind")


# What the front ends read from a text.

FRONTEND: list[str] = []


def frontend(f):
    """Register a query on the small sources with its literal rows."""
    FRONTEND.append(f.__name__)
    columns, rows = EXPECTED.get(f.__name__, ("", []))
    return query(values(rows, columns) if rows else None)(f)


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "src string, lang string, is_test boolean, content string")


@frontend
def frontend_functions(spark: SparkSession, d: str) -> DataFrame:
    f = scan.functions(_sources(spark), ["src"], "content", "lang")
    return f.select("src", "line", "end_line", "name", "receiver", "params", "results", "statements", "gives", "exported")


@frontend
def frontend_calls(spark: SparkSession, d: str) -> DataFrame:
    return scan.calls(_sources(spark), ["src"], "content", "lang")


@frontend
def frontend_uses(spark: SparkSession, d: str) -> DataFrame:
    """Every name a function uses, by itself or behind a dot."""
    return scan.uses(_sources(spark), ["src"], "content", "lang").where("owner is not null")


@frontend
def frontend_types(spark: SparkSession, d: str) -> DataFrame:
    return scan.types(_sources(spark), ["src"], "content", "lang")


@frontend
def frontend_imports(spark: SparkSession, d: str) -> DataFrame:
    return scan.imports(_sources(spark), ["src"], "content", "lang")


@frontend
def frontend_interfaces(spark: SparkSession, d: str) -> DataFrame:
    return scan.interface_methods(_sources(spark), ["src"], "content", "lang")


@frontend
def frontend_exports(spark: SparkSession, d: str) -> DataFrame:
    return scan.exports(_sources(spark), ["src"], "content", "lang")


@frontend
def frontend_tests(spark: SparkSession, d: str) -> DataFrame:
    t = scan.test_calls(_sources(spark), ["src"], "content", "lang")
    return t.select("src", "name", "line", "end_line", F.array_join("calls", " ").alias("calls"))


@frontend
def frontend_fixtures(spark: SparkSession, d: str) -> DataFrame:
    return scan.written_fixtures(_sources(spark), ["src"], "content", "lang")


@frontend
def review_items(spark: SparkSession, d: str) -> DataFrame:
    return scan.review_items(_sources(spark), ["src"], "content", "lang", "is_test").select("src", "item", "line", "name")


@frontend
def effect_union(spark: SparkSession, d: str) -> DataFrame:
    """The effects of a function and of all it leads to, as bits."""
    s = _sources(spark)
    name = lambda c: F.concat_ws("::", "src", c)
    own = scan.functions(s, ["src"], "content", "lang").select(name("name").alias("v"), F.col("effects").cast("bigint").alias("bits"))
    e = scan.calls(s, ["src"], "content", "lang").select(name("caller").alias("src"), name("callee").alias("dst"))
    bits = graph.spread_bits(e.join(own.select(F.col("v").alias("dst")), "dst", "left_semi"), own)
    return bits.select("v", F.col("bits").cast("int").alias("bits"))


@frontend
def behaviour_keys(spark: SparkSession, d: str) -> DataFrame:
    """Functions that do the same, by the first of each class."""
    rows = spark.createDataFrame([(n, "go", "package a\n\n" + t) for n, t in ALIKE], "src string, lang string, content string")
    f = scan.functions(rows, ["src"], "content", "lang")
    return f.select("src", F.min("src").over(Window.partitionBy("digest")).alias("same_as"))


@frontend
def canonical_classes(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the same canonical form, and with the same fingerprint, by the first of each class."""
    rows = spark.createDataFrame([(n, "go", t) for n, t in FORMS], "src string, lang string, content string")
    c = scan.canonical(rows, ["src"], "content", "lang", least=1)
    first = lambda k: F.min("src").over(Window.partitionBy(k))
    return c.select("src", "tokens", first("digest").alias("form_of"), first("fingerprint").alias("fingerprint_of"))


@frontend
def interface_implementations(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces of the tree with the types that have all their methods, and whether there is only one."""
    files = classified(spark.createDataFrame(TREE, "path string, content string"), ["..."])
    wanted = scan.interface_methods(files, ["path"], "content", "lang").select("interface", "method")
    have = scan.functions(files, ["path"], "content", "lang").where("receiver <> ''").select(F.ltrim(F.col("receiver"), F.lit("*")).alias("type"), F.col("name").alias("method"))
    found = usage.division(have, wanted, ["type"], ["interface"], "method")
    return found.join(usage.only_one(found, ["interface"]).withColumn("alone", F.lit(True)), ["interface", "type"], "left").select("interface", "type", F.coalesce("alone", F.lit(False)).alias("alone"))


# Listings of packages and the Git index.

_LISTING = [
    {"ImportPath": "m/app", "Dir": "/m/app", "Imports": ["m/lib", "fmt"]},
    {"ImportPath": "m/app [m/app.test]", "Dir": "/m/app", "ForTest": "m/app", "Imports": ["m/lib", "m/fakes", "testing"]},
    {"ImportPath": "m/app_test [m/app.test]", "Dir": "/m/app", "ForTest": "m/app", "Imports": ["m/app [m/app.test]", "m/more"]},
    {"ImportPath": "m/lib", "Dir": "/m/lib", "DepOnly": True, "Imports": ["m/deep"]},
    {"ImportPath": "m/deep", "Dir": "/m/deep", "DepOnly": True},
    {"ImportPath": "m/fakes", "Dir": "/m/fakes", "DepOnly": True, "Imports": ["m/lib"]},
    {"ImportPath": "m/other", "Dir": "/m/other", "DepOnly": True, "Imports": ["m/lib"]},
    {"ImportPath": "m/more", "Dir": "/m/more", "DepOnly": True},
]


@query(values([("m/app", "test", 0), ("m/app_test", "external", 0), ("m/lib", "", 1), ("m/fakes", "", 1), ("m/more", "", 1), ("m/deep", "", 2)], "path, variant, depth"))
def package_targets(spark: SparkSession, d: str) -> DataFrame:
    """The packages of a listing that a run looks at, each in one variant, and all they import."""
    listing = "\n".join(json.dumps(p) for p in _LISTING)
    p = sources.packages(spark.createDataFrame([(listing,)], "listing string"), "listing")
    chosen = sources.target_variants(p, "path", "variant")
    met = sources.with_dependencies(chosen, chosen.where("not dependency"))
    return chosen.select("path", "variant").join(met, "path")


def index_bytes(entries: list[tuple[str, str, int]], version: int = 2) -> bytes:
    """A Git index, for tests."""
    out, before = b"DIRC" + struct.pack(">II", version, len(entries)), b""
    for path, blob, mode in entries:
        name = path.encode()
        e = b"\0" * 24 + struct.pack(">I", mode) + b"\0" * 12 + bytes.fromhex(blob) + struct.pack(">H", len(name))
        if version == 4:
            same = len(os.path.commonprefix([before, name]))
            drop = len(before) - same
            number = bytes([drop & 0x7F])
            while drop >> 7:
                drop = (drop >> 7) - 1
                number = bytes([0x80 | drop & 0x7F]) + number
            out += e + number + name[same:] + b"\0"
        else:
            e += name
            out += e + b"\0" * (8 - len(e) % 8)
        before = name
    return out + hashlib.sha1(out).digest()


_TRACKED = [("a/x.go", 0o100644), ("a/y.py", 0o100755), ("b/link.ts", 0o120000), ("b/z.ts", 0o100644), ("gone.go", 0o100644), ("vendor/v.go", 0o100644)]


@query(values([(v, p, lang) for v in (2, 4) for p, lang in (("a/x.go", "go"), ("a/y.py", "py"), ("b/z.ts", "ts"))], "version, path, lang"))
def tracked_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The scripts that a Git index tracks and that exist: no links, nothing vendored, nothing untracked."""
    there = spark.createDataFrame([(p, "x") for p, _ in _TRACKED if p != "gone.go"] + [("a/untracked.go", "x")], "path string, content string")
    out = None
    for version in (2, 4):
        raw = index_bytes([(p, hashlib.sha1(p.encode()).hexdigest(), m) for p, m in _TRACKED], version)
        index = sources.index_table(spark.createDataFrame([(raw,)], "content binary"), "content")
        one = sources.tracked_scripts(index, there, ["..."]).select(F.lit(version).alias("version"), "path", "lang")
        out = one if out is None else out.unionByName(one)
    return out


_COMMENTS = [
    ("Loads the files.", "loadFile", True), ("loads files, in order", "loadFile", False), ("load", "loadFile", False), ("the value of this", "value", False),
    ("Loading HTTP requests", "loadHTTPRequest", True), ("retries for a limit of tries and retries", "retryLimit", False), (None, "load", None), ("", "load", False),
]


@query(values([(c, n, r) for c, n, r in _COMMENTS], "comment, name, restates"))
def restating_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments that say no more than the name below them."""
    rows = spark.createDataFrame([(c, n) for c, n, _ in _COMMENTS], "comment string, name string")
    return rows.select("comment", "name", text.restates(F.col("comment"), F.col("name")).alias("restates"))


@query(values([(v,) for v in ("root", "a", "b", "c", "e")], "v"))
def reachable_while_live(spark: SparkSession, d: str) -> DataFrame:
    """Edges that hold only once what they need is live: c by way of b, e once c is live; d needs what never is."""
    edges = [("root", "a", None), ("a", "b", None), ("b", "c", "a"), ("root", "e", "c"), ("a", "d", "x"), ("x", "a", None), ("d", "f", None)]
    return graph.reachable_while_live(spark.createDataFrame(edges, "src string, dst string, needs string"), spark.createDataFrame([("root",)], "v string"))


@query(values([(v, c) for v, c in (("a1", "a1"), ("a2", "a1"), ("b1", "b1"), ("b2", "b1"), ("b3", "b3"), ("c1", "c1"), ("c2", "c1"), ("d", "d"), ("z", "d"))], "v, class"))
def refined_classes(spark: SparkSession, d: str) -> DataFrame:
    """Vertices whose ways down look alike, by the first of their class: b3 has another class of successors than b1 and b2."""
    edges = [("a1", "b1"), ("a2", "b2"), ("b1", "c1"), ("b2", "c2"), ("b3", "c1"), ("b3", "d"), ("c1", "z"), ("c2", "z")]
    e = spark.createDataFrame(edges, "src string, dst string")
    r = graph.refine(e, graph.vertices(e).withColumn("class", F.lit("one")))
    return r.select("v", F.min("v").over(Window.partitionBy("class")).alias("class"))


_BEFORE = [("a.go", "func load(p string) int {\n\tn := read(p)\n\treturn n\n}", "reads a file"), ("b.go", "func store(p string) int {\n\tn := write(p)\n\treturn n\n}", "writes a file"), ("c.go", "x := 1", "gone")]
_AFTER = [("a.go", "func load(p string) int {\n\tcount := read(p)\n\treturn count\n}"), ("b.go", "func store(p string) int {\n\tn := send(p)\n\treturn n\n}"), ("d.go", "func load(p string) int {\n\tn := read(p)\n\treturn n\n}")]


@query(values([("a.go", "reads a file"), ("b.go", None), ("d.go", None)], "path, description"))
def reused_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions kept where a text of the same path differs in local names only."""
    prints = lambda rows, columns: scan.canonical(spark.createDataFrame([(*r[:2], "go", *r[2:]) for r in rows], columns), [c.split(" ")[0] for c in columns.split(", ") if c.split(" ")[0] in ("path", "description")], "content", "lang", least=1)
    now = prints(_AFTER, "path string, content string, lang string").withColumn("description", F.lit(None).cast("string"))
    before = prints(_BEFORE, "path string, content string, lang string, description string")
    return deltas.carried_over(now, before, ["path", "fingerprint"], ["description"]).select("path", "description")
