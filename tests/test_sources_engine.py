import datetime
import hashlib
import json
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from strataloom import cli
from strataloom.frontends import facts, rules, scan
from strataloom.frontends.syntax import parse
from strataloom.operators import reviews
from strataloom.plans import engine
from strataloom.plans.rule_queries import index_bytes
from strataloom.runtime import Scratch, together
from strataloom.sources import files as S
from strataloom.sources import stores as K

GO = """package a

// loads the file
func loadFile(path string, flag bool) (int, bool, error) {
	x := cfg.Path
	use(x)
	if ok {
		return true
	}
	return false
}

func IsReady(a int) int { return 1 }

func work(items []string) {
	for _, it := range items {
		if slices.Contains(all, it) {
			_ = http.Get(it)
		}
		re := regexp.MustCompile("a+")
		re.Match(it)
	}
	if len(items) > 0 {
		for _, x := range items {
			emit(x)
		}
	}
	if a {
		if b {
			run()
		}
	}
}

func same(n int) {
	switch n {
	case 1:
		one()
	case 2:
		one()
	}
	if n == 3 {
		stop()
	} else {
		stop()
	}
	panic(err)
}

func forward(a int, b int) int { return other(a, b) }
"""
PY = """
def test_wait():
    time.sleep(1)
    assert 1 == 1

def _swallow(a):
    try:
        run(a)
    except ValueError:
        pass
    if a is None:
        return 1
    if a is None:
        return 2
    flag = True
    if flag:
        go()
"""
TS = """
// runs all
function helperThing(a: string, b: number): void {
  const t = conf.name;
  send(t);
  try { go(); } catch (e) { }
}
it.only("x", () => { expect(1); });
"""


def kinds(text, lang, test=False):
    u = parse(text, lang)
    found = {k for _, k, _ in rules.all_rules(u, test, text)}
    summaries = facts.summarise(u.funcs, lang)
    return found | {k for f in u.funcs for _, k, _ in facts.decided(f, lang, summaries)}


def test_rules_find():
    assert kinds(GO, "go") >= {
        "temp_alias", "boolean_ceremony", "predicate_signature", "optional_result_triple", "unused_private_param", "loop_membership_scan", "loop_external_call",
        "loop_invariant_work", "range_ceremony", "control_flow_pyramid", "control_flow_merge", "prod_must_panic", "trivial_wrapper", "comment_noise", "swallowed_error",
    }
    assert kinds(PY, "py", True) >= {"test_sleep", "const_value_test", "swallowed_error", "redundant_condition"}
    assert kinds(TS, "ts", True) >= {"generic_naming", "temp_alias", "swallowed_error", "test_focused"}


WHOLE = """package a

type fetchResult struct {
	value int
	ok bool
}

type store interface {
	load(k string) int
}

func (d *disk) load(k string) int { return d.m[k] }

func fetch(k string, deep bool, opt *int) fetchResult { return get(k, deep, opt) }

func newThing(opts ...thingOption) int { return len(opts) }

func (k kind) MarshalJSON() ([]byte, error) { return json.Marshal(k.String()) }
func (k kind) MarshalText() ([]byte, error) { return []byte(k.String()), nil }

func TestAll(t *testing.T) {
	fetch("a", true, nil)
	fetch("b", x, nil)
	newThing(a)
	now = func() int { return 1 }
	err := walk(func(p string) error { return errStop })
	if errors.Is(err, errStop) {
		t.Error(err)
	}
}
"""


def test_rules_on_whole_files():
    assert kinds(WHOLE, "go", True) >= {"bool_mode_param", "api_overkill", "result_wrapper", "abstraction_overkill", "serialization_ceremony", "sentinel_error_break", "test_global_func_stub", "test_not_parallel"}
    assert "split_helper_candidate" in kinds("package a\n\nfunc Run() {\n\tstep(1)\n}\n\nfunc step(n int) {\n\tuse(n)\n}\n", "go")


def test_rules_keep():
    clean = "package a\n\nfunc load(path string) error {\n\tif path == \"\" {\n\t\treturn errEmpty\n\t}\n\tdata, err := read(path)\n\tif err != nil {\n\t\treturn err\n\t}\n\treturn store(data, path)\n}\n"
    assert kinds(clean, "go") == set()
    assert kinds("def run(a):\n    if a == 1:\n        return 1\n    a = f()\n    if a == 1:\n        return 2\n    return g(a)\n", "py") == set()


def test_long_things():
    body = "\n".join(f"\tcall{i}()" for i in range(41))
    go = f"package a\nfunc long(a, b, c, d, e, f, g int) (int, int, int, error) {{\n{body}\n\tuse(a, b, c, d, e, f, g)\n}}\n" + "\n".join(f"const alphaX{i} = {i}" for i in range(4)) + "\n" + "\n".join(f"const {p}Y{i} = 1" for i in range(4) for p in ("beta", "gamma"))
    assert kinds(go, "go") >= {"long_function", "long_param_list", "long_result_list", "const_grouping", "mixed_const_prefixes"}


@pytest.mark.parametrize("text, lang", [("func f( {", "go"), ("def f(:\n", "py"), ("function f() { if (a) {", "ts"), ("func f() { case 1: }", "go")])
def test_unreadable(text, lang):
    with pytest.raises(ValueError):
        parse(text, lang)


def test_facts():
    def go(body):
        u = parse("package a\nfunc f(x int, y bool) {\n" + body + "\n}\n", "go")
        return {(line, k) for f in u.funcs for line, k, _ in facts.decided(f, "go", facts.summarise(u.funcs, "go"))}

    assert go("\tif x == 1 {\n\t\treturn\n\t}\n\tif x == 1 {\n\t\tgo1()\n\t}") == {(6, "redundant_condition")}
    assert go("\tif x == 1 {\n\t\tx = 2\n\t}\n\tif x == 1 {\n\t\tgo1()\n\t}") == {(6, "redundant_condition")}
    assert go("\tif y {\n\t\tx = g()\n\t}\n\tif x == 1 {\n\t\tgo1()\n\t}") == set()
    assert go("\tif !y {\n\t\treturn\n\t}\n\tif y && x == 3 {\n\t\tgo1()\n\t}") == {(6, "redundant_subexpression")}
    assert go("\tfor i := range xs {\n\t\tx = i\n\t}\n\tif x == 1 {\n\t\tgo1()\n\t}") == set()
    states = [{"a": facts.Fact(str(i)), "b": facts.Fact("1")} for i in range(40)]
    assert facts.bounded(states) == [{"a": facts.Fact(None, frozenset(), (0, False), (39, False)), "b": facts.Fact("1")}]
    assert facts.returns(parse("package a\nfunc f() bool {\n\tif x {\n\t\treturn true\n\t}\n\treturn true\n}\n", "go").funcs[0]) == "always true"


def test_canonical_tokens():
    a, b = scan.canonical_tokens("func a(x int) { return x + 1 } // c"), scan.canonical_tokens("func b(y int) {\n return y + 1; }")
    assert a == b and scan.canonical_tokens("x + 2") != scan.canonical_tokens("x + 3")
    assert scan.rename_fingerprint("x := load(); use(x)") == scan.rename_fingerprint("y := load(); use(y)") != scan.rename_fingerprint("y := read(); use(y)")


def test_git_index():
    blob = S.blob_id_of(b"hello\n")
    assert blob == "ce013625030ba8dba906f756967f9e9ca394464a"
    entries = [("a.py", blob, 0o100644), ("dir/longer name.ts", blob, 0o100644), ("dir/longer named.ts", blob, 0o100755), ("x" * 300, blob, 0o100644), ("y", blob, 0o100644)]
    for version in (2, 4):
        assert S.git_index(index_bytes(entries, version)) == entries
    with pytest.raises(ValueError):
        S.git_index(b"nothing")


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "a/x.py": "def f(a):\n    try:\n        g()\n    except E:\n        pass\n", "a/y.go": "package a\n\n// strataloom:ignore prod_must_panic -- agreed\nfunc f() {\n\tpanic(err)\n}\n",
        "a/z.go": "package a\n\nfunc f() {\n\t// strataloom:ignore prod_must_panic -- agreed\n\n\tpanic(err)\n}\n\n// strataloom:ignore dead_code -- gone\n// strataloom:ignore\n",
        "node_modules/m.ts": "x", "_p/q.py": "x", ".h/i.py": "x", "a/gen.py": "# Code generated\nx = 1\n", "a/bad.py": "def (", "b/c/d.ts": "const a = 1;\n", "b/e.d.ts": "x", "b/n.txt": "x",
    }.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_run_over_a_tree(spark, tree):
    r = engine.run(spark, tree)
    assert {x["path"] for x in r.files.collect()} == {"a/x.py", "a/y.go", "a/z.go", "a/bad.py", "b/c/d.ts"}
    got = {(x["file"], x["line"], x["kind"]) for x in r.findings.collect()}
    assert got == {("a/x.py", 2, "swallowed_error"), ("a/y.go", 5, "prod_must_panic"), ("a/bad.py", 1, "parse_error"), ("a/z.go", 10, "invalid_ignore"), ("a/y.go", 4, "dead_code"), ("a/y.go", 3, "stale_ignore"), ("a/z.go", 9, "stale_ignore")}
    assert {(x["file"], x["rule"]) for x in r.stale.collect()} == {("a/y.go", "prod_must_panic"), ("a/z.go", "dead_code")}
    assert [line for line in K.text_report(r.report())][0].startswith("dead_code (1)")
    part = engine.run(spark, tree, ["b/..."])
    assert {x["path"] for x in part.files.collect()} == {"b/c/d.ts"} and part.stale.count() == 0
    stamp = Scratch(spark, "stamp").path("stamp.json")
    assert not engine.attest(spark, r, stamp, {"model": "m"}) and engine.verify(spark, r.files, stamp, {"model": "m"}) == "missing"
    assert engine.attest(spark, part, stamp, {"model": "m"})
    assert [engine.verify(spark, f, stamp, {"model": m}) for f, m in ((part.files, "m"), (part.files, "n"), (r.files, "m"))] == ["holds", "model differs", "digest differs"]


def test_run_finds_clones_and_judges_its_own_rules(spark, tmp_path):
    body = "(a int) int {\n\tx := a\n\tuse(x)\n\treturn x\n}\n"
    for path, text in {
        "a/x.go": "package a\n\nfunc First" + body, "a/y.go": "package a\n\nfunc Second" + body, "b/z.go": "package b\n\n// strataloom:ignore behavior_clone -- agreed\nfunc Third" + body,
        "b/z_test.go": "package b\n\nfunc Fourth" + body,
        "c/w.go": "package c\n\n" + "".join(f"// strataloom:ignore {r} -- agreed\n" for r in (*engine.EMBEDDED, *engine.REVIEWED, "behavior_clone", "dead_code")) + "var a = 1\n",
    }.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    r = engine.run(spark, str(tmp_path))
    assert [(x["file"], x["line"], x["message"]) for x in r.findings.where("kind = 'behavior_clone'").collect()] == [("a/y.go", 3, "Second does the same as First at a/x.go:3")]
    assert {(x["file"], x["rule"]) for x in r.stale.collect()} == {("c/w.go", "behavior_clone"), ("c/w.go", "dead_code")}
    assert not engine.attest(spark, engine.run(spark, str(tmp_path), ["a"]), Scratch(spark, "stamp").path("stamp.json"), {})


def test_command_line(spark, tmp_path, capsys):
    tree, store, stamp = tmp_path / "tree", str(tmp_path / "store"), str(tmp_path / "stamp.json")
    os.makedirs(tree / "a")
    (tree / "a/x.py").write_text("def f(a):\n    try:\n        g(a)\n    except E:\n        pass\n")
    said: list[str] = []
    main = lambda *a: cli.main([*a], spark, said.append)
    assert main() == cli.USAGE and main(str(tree), "--format", "none") == cli.USAGE and main(str(tree), "--verify") == cli.USAGE
    assert main(str(tree), "--format", "lines", "--store", store) == cli.FOUND and said == ["a/x.py:2:1: swallowed_error: the error is dropped"]
    assert engine.run(spark, str(tree), dims=1024, store=store, policy={"model": "", "patterns": []}).replayed
    said.clear()
    assert main(str(tree), "--format", "json") == cli.FOUND
    assert json.loads("".join(said)) == {"issues": [{"position": "a/x.py:2:1", "kind": "swallowed_error", "message": "the error is dropped"}], "rules": {"swallowed_error": {"finds": "swallowed_error", "fix": ""}}}
    assert main(str(tree), "--verify", "--stamp", stamp) == cli.FOUND
    (tree / "a/x.py").write_text("def f(a):\n    return g(a)\n")
    assert main(str(tree), "--stamp", stamp) == cli.CLEAN == main(str(tree), "--verify", "--stamp", stamp)
    (tree / "a/y.py").write_text("x = 1\n")
    assert main(str(tree), "--verify", "--stamp", stamp) == cli.FOUND and said[-1] == "digest differs"
    assert main(str(tmp_path / "nowhere")) == cli.FAILURE
    assert cli.INTERRUPTED == 130 and "Path does not exist" in capsys.readouterr().err


def test_packages_with_the_same_key_are_not_analysed_again(spark):
    store = Scratch(spark, "packages").path("entries")
    lib = "package lib\n\nfunc Open(n int) int { return {} }\n"

    def go(body, main="package app\n\nimport \"m/lib\"\n\nfunc Run() {\n\tpanic(err)\n}\n", signature="n int"):
        rows = [("lib/a.go", lib.replace("{}", body).replace("n int", signature)), ("app/b.go", main), ("other/c.go", "package other\n")]
        files = S.scripts(spark.createDataFrame(rows, "path string, content string"), ["..."])
        found, n = engine.package_findings(spark, files, store, {"v": 1})
        return sorted((r["file"], r["line"], r["kind"]) for r in found.collect()), n

    want = [("app/b.go", 6, "prod_must_panic")]
    assert go("n + 1") == (want, 3) and go("n + 1") == (want, 0)
    assert go("n + 2") == (want, 1)  # the package alone: what it exports is as before
    assert go("n + 2", signature="n int64") == (want, 2)  # and the one that imports it
    assert engine.package_keys(S.scripts(spark.createDataFrame([("a.go", "package a\n")], "path string, content string"), ["..."]), {"v": 2}).count() == 1


def test_jobs_at_the_same_time(spark):
    assert together(spark, {"a": lambda: spark.range(10).count(), "b": lambda: spark.range(20).count()}) == {"a": 10, "b": 20}

    def fails():
        raise ValueError("no")

    slow = lambda: spark.range(8).repartition(8).selectExpr("sum(cast(java_method('java.lang.Thread', 'sleep', 20000L) is null as int))").collect()
    start = time.monotonic()
    with pytest.raises(ValueError):
        together(spark, {"slow": slow, "fails": fails})
    assert time.monotonic() - start < 10


def test_entries_are_pruned_by_use(spark):
    e = K.Entries(spark, Scratch(spark, "entries").path("e"))
    e.put(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k")
    later = datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(days=20)
    used = e.used().where("key = 'a'").first()["used"]
    assert [r["v"] for r in e.get(spark.createDataFrame([("a",)], "k string"), "k").collect()] == [1]
    assert e.used().where("key = 'a'").first()["used"] > used
    assert e.prune(later, F.col("key") == "a") and not e.prune(later)  # once a day
    assert {r["key"] for r in e.used().collect()} == {"a"}
    e.put(spark.createDataFrame([("a", 3)], "k string, v int"), "k")
    assert [r["v"] for r in e.get(spark.createDataFrame([("a",), ("b",)], "k string"), "k").collect()] == [3]


def test_reviews(spark):
    class Fickle:
        def ask(self, prompt):
            key = prompt.split("\nitem ")[1].split(" ")[0]
            return json.dumps({"id": key, "verdict": "restates" if "plain" in prompt else "keep" if "fine" in prompt else "mock_only", "advice": "say why it is so and not what" if "short" not in prompt else "no"})

    items = spark.createDataFrame([("a.go", "comment", 3, "f", "plain"), ("b.go", "comment", 4, "g", "plain"), ("a.go", "comment", 9, "h", "fine"), ("a.go", "comment", 12, "i", "odd"), ("a.go", "comment", 15, "j", "plain short")], "path string, item string, line int, name string, content string")
    told: list[tuple[int, int]] = []
    found, every = reviews.judged(items, Fickle(), {}, ["path"], lambda a, b: told.append((a, b)))
    assert {tuple(r) for r in found.collect()} == {("a.go", 3, "comment_noise", "say why it is so and not what"), ("b.go", 4, "comment_noise", "say why it is so and not what")}
    assert {(r["vote"], r["verdict"]) for r in every.collect()} == {(1, "restates"), (1, "keep"), (2, "restates")} and told[0] == (2, 4)
    c = spark.createDataFrame([("a.go", 5, "repeated_test_fixture"), ("a.go", 1, "split_helper_candidate"), ("a.go", 2, "dead_code")], "file string, line int, kind string")
    kept, asked = reviews.candidates_and_findings(c)
    assert {r["line"] for r in kept.collect()} == {5, 2} and {r["line"] for r in asked.collect()} == {5, 1}
    d = spark.createDataFrame([("a.go", 1, 9, "outer"), ("a.go", 4, 6, "inner")], "f string, a int, b int, name string")
    own = d.withColumnRenamed("f", "file").withColumnRenamed("a", "start").withColumnRenamed("b", "fin")
    assert {(r["line"], r["declaration"]["name"]) for r in reviews.with_declarations(asked, own, "file", "line", "start", "fin").collect()} == {(5, "inner"), (1, "outer")}
    with pytest.raises(Exception, match="no declaration holds"):
        reviews.with_declarations(asked.withColumn("line", F.lit(50)), own, "file", "line", "start", "fin").collect()


def test_first_of_key_in_any_order_of_files(spark, tmp_path):
    import pandas as pd

    from strataloom.plans import stream_queries as Q

    os.makedirs(tmp_path / "events.parquet")
    for i, day in enumerate((200, 190, 180, 195, 185, 199, 188, 192, 0, 100)):  # batches of 4 files in order of time of change
        at = f"{tmp_path}/events.parquet/{i}.parquet"
        pd.DataFrame({"event_id": [i, 99], "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(days=day)}).astype({"ts": "datetime64[us]"}).to_parquet(at)
        os.utime(at, (1_700_000_000 + 60 * i,) * 2)
    got = sorted(r["event_id"] for r in Q.QUERIES["stream_first_of_key"](spark, str(tmp_path)).collect())
    assert got == [*range(10), 99]


def test_stores(spark):
    s = K.Snapshots(spark, Scratch(spark, "snap").path("s"), keep=2)
    df = spark.range(5)
    assert s.latest({}) is None
    for _ in range(3):
        s.write(df, {"p": 1})
    assert s.numbers() == [2, 3] and s.latest({"p": 1}).count() == 5 and s.latest({"p": 2}) is None
    assert K.Snapshots(spark, s.path, schema_version=2).latest({"p": 1}) is None
    exact = K.Snapshots(spark, Scratch(spark, "snap").path("exact"))
    for n, digest in ((1, "a"), (2, "b"), (3, None)):
        exact.write(spark.range(n), {}, digest)
    assert [exact.latest({}, x).count() for x in ("a", "b", "c", None)] == [1, 2, 3, 3]
    path = Scratch(spark, "stamp").path("x.json")
    assert K.read_stamp(spark, path) == {} and not K.write_stamp(spark, path, {"schema": 1}, False)
    assert K.write_stamp(spark, path, {"schema": 1, "a": "é"}, True) and K.read_stamp(spark, path) == {"schema": 1, "a": "é"}
    K.write_text(spark, path, json.dumps({"a": 1}))
    with pytest.raises(ValueError):
        K.read_stamp(spark, path)
    v = spark.createDataFrame([(1, b"SLV1" + struct.pack("<Iff", 2, 1, 2)), (2, b"SLV0" + struct.pack("<If", 1, 1)), (3, b"SLV1" + struct.pack("<If", 2, 1)), (4, b"SLV1" + struct.pack("<If", 1, 0)), (5, None), (6, b"")], "k int, record binary")
    assert [(r["k"], r["vec"]) for r in K.decode_vectors(v, "k").collect()] == [(1, [1.0, 2.0])]


def test_target_variants(spark):
    p = spark.createDataFrame([("a", ""), ("a", "test"), ("b", ""), ("a", "external")], "path string, variant string")
    assert {tuple(r) for r in S.target_variants(p, "path", "variant").collect()} == {("a", "test"), ("b", ""), ("a", "external")}
