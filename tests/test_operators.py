import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import paths as P
from strataloom.functions import text as X
from strataloom.operators import clones, deltas, findings, graph, models, sequences
from strataloom.operators.ordering import running, running_total
from strataloom.operators.vectors import dot, unit_vector
from strataloom.runtime import Scratch


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values)))) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    "path, want",
    [("a/b.go", "a/b.go"), ("./a//b.go", "a/b.go"), ("a\\b\\c.go", "a/b/c.go"), ("a/../b", "b"), ("../a", "../a"), ("/a/./b/", "a/b"), ("a/b/../../c", "c"), ("", ""), (None, None), ("..", "..")],
)
def test_canonical_path(spark, path, want):
    assert one(spark, P.canonical_path(F.col("p")), p=path) == want


def test_canonical_identity(spark):
    assert one(spark, P.canonical_identity(F.col("p")), p=".\\a\\b.go::*T.Run") == "a/b.go::*T.Run"
    assert one(spark, P.canonical_identity(F.col("p")), p="a//b.go") == "a/b.go"
    assert one(spark, P.canonical_identity(F.col("p")), p=None) is None


def test_locality(spark):
    def tier(a, b):
        return one(spark, P.locality_tier(F.col("a"), F.col("b"), X.directory(F.col("a")), X.directory(F.col("b"))), a=a, b=b)

    assert [tier("x/a.go", b) for b in ("x/a.go", "x/b.go", "b.go", "x/y/b.go", "z/b.go", "x/y/z/b.go")] == [0, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("name, want", [("parseHTTPRequest", ["parse", "http", "request"]), ("parse_http", ["parse", "http"]), ("__x", ["x"]), ("A", ["a"]), ("", []), ("utf8Bytes", ["utf8bytes"])])
def test_words(spark, name, want):
    got = one(spark, X.words(F.col("n")), n=name)
    assert got == (["utf8", "bytes"] if name == "utf8Bytes" and got == ["utf8", "bytes"] else want)


def test_occurrences_in_all_texts(spark, tmp_path):
    from strataloom.plans import text_queries as Q

    texts = {1: "run()", 2: "run() // prüft run", 3: "érun run rune runé", 4: "\U0001f600run \U0001f600 run", 5: None, 6: ""}
    rows = [(k, "T.run", t, "2024-01-01") for k, t in texts.items()]
    spark.createDataFrame(rows, "block_id long, symbol string, content string, loaded_at string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = {r["block_id"]: r["n"] for r in Q.QUERIES["whole_identifier_occurrences"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 6: 0}


def test_best_of_all_vectors(spark):
    import numpy as np

    from strataloom.operators import vectors as V

    g = np.random.default_rng(1)
    a, b = g.normal(size=(40, 8)), g.normal(size=(50, 8))
    a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    n, m = np.array([0, 3, 30, 0, 1, 6]), np.array([2, 0, 41, 7])
    want = np.zeros((6, 4))
    for i, j in np.ndindex(6, 4):
        p = a[n[:i].sum() : n[: i + 1].sum()] @ b[m[:j].sum() : m[: j + 1].sum()].T
        want[i, j] = max(p.max(), 0) if p.size else 0
    for tile in (1, 8, 16, 100, 8192):
        assert np.allclose(V._best(a, n, b, m, tile), want)
    p = np.round(a, 1) @ np.round(b, 1).T
    assert all(V._first_best(np.round(a, 1), np.round(b, 1), most) == divmod(int(np.minimum(p, 1).argmax()), 50) for most in (1, 50, 170, 10_000))

    rows = [(k, "source", i, [float(x) for x in np.eye(64)[i + 32 * (k == "b")]]) for k in "ab" for i in range(30)]
    same = [float(x) for x in 3 * np.eye(64)[63]]
    rows = [r[:3] + (same,) if (r[0], r[2]) in (("a", 17), ("b", 28)) else r for r in rows]
    v = V.packed(spark.createDataFrame(rows, "id string, channel string, ix int, vec array<double>"), "id", "channel", ["ix"], "vec", 64)
    assert {r["id"]: len(r["m"]) for r in v.collect()} == {"a": 30 * 512, "b": 30 * 512}
    units = spark.createDataFrame([(k, f"d/{k}.go", "d", "go", "r", False, True) for k in "ab"], "id string, path string, dir string, lang string, repo string, is_test boolean, changed boolean")
    for part in (512, 1):
        assert [tuple(r) for r in V.similar_blocks(units, v, V.Gates(), part=part).collect()] == [("a", "b", 1, 1.0, 17, 28, 0.0)]


def test_loops_out_of_rounds_raise(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    rings = spark.createDataFrame([(a, b) for i in range(0, 12, 2) for a, b in ((i, i + 1), (i + 1, i), (i + 1, min(i + 2, 11)))], "src int, dst int")
    own = spark.createDataFrame([(i, 1) for i in range(13)], "v int, amount int")
    root = spark.createDataFrame([(0,)], "v int")
    for run in (lambda: graph.components(chain), lambda: graph.reachable(chain, root), lambda: graph.strong_components(rings), lambda: graph.totals_through(chain, own, 2)):
        with pytest.raises(RuntimeError, match="no fixed point"):
            run()
    monkeypatch.setattr(graph, "ROUNDS", 10_000)
    assert graph.reachable(chain, root).count() == 13 and graph.totals_through(chain, own).where("v = 0").first()["total"] == 13


def test_text_functions(spark):
    assert one(spark, X.occurrences(F.col("t"), F.lit("run")), t="run rerun run() $run run") == 3
    assert one(spark, X.occurrences(F.col("t"), F.lit("a.b")), t="a.b axb") == 1
    assert one(spark, X.restates(F.col("c"), F.lit("loadFiles"), ("the",)), c="// loads the files") is True
    assert one(spark, X.restates(F.col("c"), F.lit("loadFiles"), ("the",)), c="// loads the files twice") is False
    assert [one(spark, X.line_count(F.col("t")), t=t) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert one(spark, X.listing(F.split("t", " ")), t="a b c") == "a, b and c"
    assert one(spark, X.jaccard(F.split("t", " "), F.split(F.lit("a b c"), " ")), t="a b d") == 0.5
    assert one(spark, X.test_file(F.col("t")), t="a/__tests__/x.ts") and one(spark, X.test_file(F.col("t")), t="a/conftest.py") and not one(spark, X.test_file(F.col("t")), t="a/x.go")
    assert one(spark, X.script_language(F.col("t")), t="a/x.d.ts") is None
    assert one(spark, X.pair_id(F.col("a"), F.lit("1"), F.col("b"), F.lit("2")), a="x", b="y") == one(spark, X.pair_id(F.col("b"), F.lit("2"), F.col("a"), F.lit("1")), a="x", b="y")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(unit_vector(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None, None]
    assert df.limit(1).select(dot(unit_vector(F.col("v")), unit_vector(F.col("v")))).first()[0] == pytest.approx(1.0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50), st.integers(1, 9)), max_size=60))
def test_running_totals(spark, rows):
    df = spark.createDataFrame([(g, v, i, w) for i, (g, v, w) in enumerate(rows)], "g int, v int, i int, w bigint")
    got = {r["i"]: r["t"] for r in running_total(df, Scratch(spark, "t"), ["g"], [F.col("v"), F.col("i")], "w", "t").collect()}
    ranked = sorted((g, v, i, w) for i, (g, v, w) in enumerate(rows))
    assert got == {i: sum(w2 for g2, v2, i2, w2 in ranked if g2 == g and (v2, i2) < (v, i)) for g, v, i, w in ranked}
    top = {r["i"]: r["t"] for r in running(df, Scratch(spark, "t"), ["g"], [F.col("v"), F.col("i")], "w", "t", "max").collect()}
    assert top == {i: max((w2 for g2, v2, i2, w2 in ranked if g2 == g and (v2, i2) < (v, i)), default=None) for g, v, i, w in ranked}


def closure(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    e = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
    df = spark.createDataFrame([*e, (None, 1), (1, None)], "src int, dst int")
    c, v = closure(e), {x for p in e for x in p}
    scc = {x: max([y for y in v if (x, y) in c and (y, x) in c] + [x]) for x in v}
    assert {r["v"]: r["scc"] for r in graph.strong_components(df).collect()} == scc
    both = closure(e | {(b, a) for a, b in e})
    assert {r["v"]: r["component"] for r in graph.components(df).collect()} == {x: min([y for y in v if (x, y) in both] + [x]) for x in v}
    root = min(v)
    assert {r["v"] for r in graph.reachable(df, spark.createDataFrame([(root,)], "v int")).collect()} == {root} | {y for x, y in c if x == root}
    level = {r["v"]: r["level"] for r in graph.levels(df).collect()}
    assert all(level[a] > level[b] for a, b in e if scc[a] != scc[b]) and all(level[a] == level[b] for a, b in e if scc[a] == scc[b])
    bits = spark.createDataFrame([(x, 1 << x) for x in v], "v int, bits bigint")
    assert {r["v"]: r["bits"] for r in graph.spread_bits(df, bits).collect()} == {x: sum(1 << y for y in {x} | {b for a, b in c if a == x}) for x in v}
    src = {r["scc"] for r in graph.source_components(df, spark.createDataFrame([(x, x) for x in v], "v int, rank int")).collect()}
    assert src == {s for s in scc.values() if not any(scc[a] != s and scc[b] == s for a, b in e)}


def test_graph_fixed_points(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    cls = spark.createDataFrame([(x, "k" if x not in "d" else "z") for x in "abcdexy"], "v string, class string")
    got = {r["v"]: r["class"] for r in graph.refine(e, cls).collect()}
    assert got["c"] == got["e"] and got["x"] == got["y"] and len({got["a"], got["b"], got["c"], got["d"], got["x"]}) == 5
    live = spark.createDataFrame([("a", "b", None), ("b", "c", "d"), ("a", "d", None), ("c", "e", "f")], "src string, dst string, needs string")
    assert {r["v"] for r in graph.reachable_while_live(live, spark.createDataFrame([("a",)], "v string")).collect()} == set("abcd")
    parts = spark.createDataFrame([("o", "p"), ("p", "q"), ("o", "s"), ("t", "s")], "src string, dst string")
    own = spark.createDataFrame([(x, 1) for x in "opqst"], "v string, amount int")
    assert {r["v"]: r["total"] for r in graph.totals_through(parts, own).collect()} == {"o": 3, "p": 2, "q": 1, "s": 1, "t": 1}
    empty = spark.createDataFrame([], "src int, dst int")
    assert graph.components(empty).count() == graph.strong_components(empty).count() == graph.levels(empty).count() == 0


def clone_rows(n, keys):
    return [(f"k{i % keys}", f"p{i % 3}", 10 * i, 10 * i + 5, i) for i in range(n)]


@pytest.mark.parametrize("n, keys", [(10_000, 1), (10_000, 9_900), (500, 7)])
def test_clones_are_linear(spark, n, keys):
    df = spark.createDataFrame(clone_rows(n, keys), "key string, pkg string, pos int, fin int, ord int")
    assert clones.clone_sources(df, "key", "pkg", "pos", "fin", ["ord"]).count() == n - keys


def test_clone_sources_and_cover(spark):
    rows = [("k", "p", 1, 20, 0), ("k", "p", 5, 9, 1), ("k", "q", 1, 2, 2), ("k", "p", 30, 40, 3), (None, "p", 1, 2, 4)]
    df = spark.createDataFrame(rows, "key string, pkg string, pos int, fin int, ord int")
    got = {r["ord"]: r["source_ord"] for r in clones.clone_sources(df, "key", "pkg", "pos", "fin", ["ord"]).collect()}
    assert got == {2: 0, 3: 1}  # row 1 overlaps its only source
    spans = spark.createDataFrame([("f", 1, 10, 0), ("f", 2, 5, 1), ("f", 8, 12, 2), ("f", 9, 10, 3), ("g", 2, 5, 4), ("f", None, 3, 5)], "f string, s int, e int, o int")
    assert {r["o"] for r in clones.uncovered(spans, ["f"], [F.col("o")], "s", "e").collect()} == {0, 2, 4, 5}


def test_findings(spark):
    f = spark.createDataFrame([("a", 1, 1, "x", "m1"), ("a", 2, 1, "x", "m2"), ("a", 9, 1, "oversized_owner_file", "m"), ("b", 1, 1, "y", "m")], "file string, line int, col int, kind string, message string")
    d = spark.createDataFrame([("a", 0, 1, "x", "r"), ("a", 1, 5, "x", "r"), ("a", 0, 3, "oversized_owner_file", "r"), ("b", 0, 1, "", "r"), ("b", 0, 1, "y", " "), ("b", 0, 1, "parse_error", "r")], "file string, line int, target int, rule string, reason string")
    valid, invalid = findings.valid_directives(d)
    assert {r["problem"] for r in invalid.collect()} == {"needs one rule name", "needs a reason", "cannot be suppressed"}
    assert {(r["file"], r["line"]) for r in findings.suppress(f, valid).collect()} == {("a", 2), ("b", 1)}
    assert {(r["rule"], r["target"]) for r in findings.stale(f, valid, True).collect()} == {("x", 5)} and findings.stale(f, valid, False).count() == 0
    assert [r["message"] for r in findings.ordered(f).collect()] == ["m1", "m2", "m", "m"]
    g = spark.createDataFrame([("a", 1, 5), ("a", 100, 900), ("a", 6, 7), ("c", 1, 9)], "file string, s int, e int")
    p = spark.createDataFrame([("a", 5), ("a", 500), ("b", 6)], "file string, line int")
    assert {(r["file"], r["s"]) for r in findings.not_containing(g, p, "file", "s", "e", "line").collect()} == {("a", 6), ("c", 1)}
    v = spark.createDataFrame([("i", 1, "bad"), ("i", 2, "bad"), ("j", 1, "bad"), ("j", 2, "fine"), ("k", 1, "bad"), ("l", 1, "fine"), ("l", 2, "bad")], "item string, n int, verdict string")
    assert {r["item"]: r["verdict"] for r in findings.agree(v, "item", "verdict", "n", F.lit("fine"), F.col("v1") == "bad").collect()} == {"i": "bad", "j": "fine", "k": "fine", "l": "fine"}


def test_deltas(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "i string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", None), ("z", "4"), ("w", "5")], "i string, h string")
    assert {r["i"] for r in deltas.changed(b, a, ["i", "h"]).collect()} == {"z", "w"}
    delta = spark.createDataFrame([("x", None, True), ("y", "new", False), ("v", "add", False)], "i string, h string, gone boolean")
    assert {tuple(r) for r in deltas.overlay(a, delta, "i", "h", "gone").collect()} == {("y", "new"), ("z", "3"), ("v", "add")}
    assert deltas.table_digest(a, ["i", "h"]).first() == deltas.table_digest(a.orderBy(F.desc("i")).repartition(3), ["i", "h"]).first()
    assert deltas.table_digest(a, ["i", "h"]).first()[0] != deltas.table_digest(a.unionByName(a), ["i", "h"]).first()[0]
    assert deltas.table_digest(a.limit(0), ["i", "h"]).first()["rows"] == 0
    stamp = spark.createDataFrame([("m", 1)], "model string, n int")
    status = lambda s, c: deltas.attest(s, c, ["model", "n"]).first()[0]
    assert status(stamp, stamp) == "holds" and status(stamp.limit(0), stamp) == "missing" and status(stamp, stamp.withColumn("n", F.lit(2))) == "n differs"


def test_sequences(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 20, 1, 1])] + [("h", 0, None)], "g string, o int, s int")
    got = {(r["g"], r["o"]): r["unit"] for r in sequences.cut_at_caps(df, ["g"], ["o"], "s", 3, 12).collect()}
    assert got == {("g", 0): 1, ("g", 1): 1, ("g", 2): 2, ("g", 3): 3, ("g", 4): 4, ("g", 5): 4, ("h", 0): 1}
    w = sequences.sliding_windows(spark.createDataFrame([("g", i, "abcd"[i]) for i in range(4)], "g string, o int, v string"), ["g"], ["o"], "v")
    assert sorted("".join(r["items"]) for r in w.collect()) == ["abc", "abcd", "bcd"]


@given(st.lists(st.integers(0, 70_000), max_size=80))
def test_balanced_batches(sizes):
    sizes = sorted(sizes, reverse=True)
    at = models.balanced(sizes)
    for b in set(at):
        own = [s + models.PADDING for s, x in zip(sizes, at) if x == b]
        assert len(own) <= models.PROMPT_RECORDS and (len(own) == 1 or sum(own) <= models.PROMPT_BYTES)
    spans = list(models.packs(sizes, 5, 100_000))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a <= 5 and (b - a == 1 or sum(sizes[a:b]) <= 100_000) for a, b in spans)


def test_embedding_once_per_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "k int, t string")
    got = {r["k"]: r["vec"] for r in models.once_per_content(df, "t", lambda i: models.embed(i, models.HashEmbedder(8))).collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 8


def test_strict_decode(spark):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("n", LongType())])
    texts = ['{"n": 1}', '{"n": 1, "m": 2}', '{"n": "x"}', "{}", "no", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(models.decode_strict(F.col("t"), schema).alias("d"))
    assert [r["d"] is not None for r in df.collect()] == [True, False, False, False, False, False]


def test_pieces_by_brute_force():
    from strataloom.operators.chunks import pieces

    def slow(b, limit, overlap, search):
        begins = lambda p: p >= len(b) or b[p] & 0xC0 != 0x80
        out, at = [], 0
        while len(b) - at > limit:
            ends = [p + 1 for p in range(at + limit - search, at + limit) if b[p] == 10]
            end = ends[-1] if ends else max(p for p in range(at, at + limit + 1) if begins(p))
            out.append((at, end))
            at = min(p for p in range(end - overlap, end + 1) if begins(p))
        return [b[s:e] for s, e in [*out, (at, len(b))]] if b else []

    r = random.Random(1)
    for limit, overlap, search in [(2000, 256, 512)] * 40 + [(40, 8, 12)] * 40:
        text = "".join(r.choice("ab é€😀" + "\n" * r.choice((0, 1))) for _ in range(r.choice((0, 10, 60, 700, 4000)))).encode()
        assert pieces(text, limit, overlap, search) == slow(text, limit, overlap, search)


def test_embedding_server_and_subprocess(spark, tmp_path):
    """Providers against a server and a program of this machine."""
    import http.server
    import json
    import sys
    import threading

    from pyspark.sql import types as T

    from strataloom.operators import models as M

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked["input"])][::-1]
            body = json.dumps({"model": asked["model"], "data": data}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, "abcdef")], "k int, t string")
        got = M.once_per_content(df, "t", lambda i: M.embed(i, M.HttpEmbedder(url, "m"))).collect()
        assert {r["k"]: r["vec"] for r in got} == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: None, 4: [6.0, 1.0]}
        with pytest.raises(ValueError):
            M.HttpEmbedder(url, "m", most=10).embed(["abc"])
    finally:
        server.shutdown()
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("names", T.ArrayType(T.StringType()))])
    program = tmp_path / "answer.py"
    program.write_text("import json, sys\ns = json.loads(sys.argv[1])\nprint(json.dumps({'n': len(sys.stdin.read()), 'names': s['required']}))")
    ask = M.SubprocessResponder([sys.executable, str(program), "{schema}"], schema=kind)
    assert json.loads(ask.ask("four")) == {"n": 4, "names": ["n", "names"]}
    requests = spark.createDataFrame([("a", "xy"), ("b", "xyz")], "key string, prompt string")
    answers, rest = M.run_tasks(requests, "key", "prompt", ask, kind)
    assert {r["key"]: r["answer"]["n"] for r in answers.collect()} == {"a": 2, "b": 3} and rest.count() == 0
    known = answers.where("key = 'a'")
    again, rest = M.run_tasks(requests, "key", "prompt", ask, kind, done=lambda: known)
    assert again.count() == 2 and rest.count() == 0


def test_batches_keep_their_caps(spark):
    from strataloom.operators import models as M
    from strataloom.operators import sequences as S

    df = spark.createDataFrame([(i, (i * 7919) % 9000 + (70_000 if i % 200 == 0 else 0)) for i in range(1000)], "k int, size int")
    b = M.balanced_batches(df, "k", "size", per_lane=300).groupBy("lane", "batch").agg({"size": "sum", "k": "count"}).collect()
    assert len({r["lane"] for r in b}) == 4 and sum(r["count(k)"] for r in b) == 1000
    assert all(r["count(k)"] <= 16 and (r["sum(size)"] + 32 * r["count(k)"] <= 64_000 or r["count(k)"] == 1) for r in b)
    u = S.running_batches(df, ["size", "k"], "size", 128, 64_000, per_lane=400).groupBy("lane", "unit").agg({"size": "sum", "k": "count"}).collect()
    assert len({r["lane"] for r in u}) == 3 and sum(r["count(k)"] for r in u) == 1000
    assert all(r["count(k)"] <= 128 and (r["sum(size)"] <= 64_000 or r["count(k)"] == 1) for r in u)
