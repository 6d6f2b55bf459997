import random
import re
from fractions import Fraction

import numpy as np

from strataloom.llm import neardup
from strataloom.llm.neardup import BUDGET, Tries, all_pairs, candidates, near_duplicates, trie_pairs
from strataloom.llm.vectors import CentroidGraph, Centroids, Settings, equal_classes, fit_centroids, fit_index, probe, similar_pairs, split_lists, unit, usable
from strataloom.runtime import Scratch


def brute_pairs(rows, k=5, floor=0.85):
    out = set()
    for g in {r[1] for r in rows}:
        own = {}
        for i, h, v in rows:
            if h == g and i is not None and v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and any(v):
                own[i] = np.float32(v).astype(float)
        ids = sorted(own)
        if not ids:
            continue
        x = np.stack([own[i] / np.linalg.norm(own[i]) for i in ids])
        s = np.round(x @ x.T, 9)
        for a in range(len(ids)):
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
            out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order if s[a, b] >= floor}
    return out


def make_vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, 64))
    rows = []
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.normal(size=64) * 0.35
        rows.append((i, "ab"[i % 2], (v * rng.uniform(0.5, 3)).astype(np.float32).tolist()))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id bigint, ch string, vec array<float>, cid int, v string")
    return {(r["vec_a"], r["vec_b"]) for r in similar_pairs(df, "id", "ch", "vec", **kw).collect()}


def test_recall_against_brute_force(spark):
    rows = make_vectors(3000)
    got, want = run(spark, rows, settings=Settings(per_list=50)), brute_pairs(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_neighbours_are_found_among_many_lists(spark):
    """A list for every second vector: as with millions of them, most lists end between two neighbours."""
    rng, n = np.random.default_rng(9), 2000
    x = unit(rng.normal(size=(n, 64)))
    off = rng.normal(size=(n, 64))
    off = unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    rows = [(i, "a", v.tolist()) for i, v in enumerate(np.concatenate([x, (0.9 * x + np.sqrt(1 - 0.9**2) * off).astype(np.float32)]))]
    got = run(spark, rows, settings=Settings(per_list=2))
    assert len(got & {(i, n + i) for i in range(n)}) >= 0.995 * n and got <= brute_pairs(rows)


def test_best_of_all_centroids():
    rng = np.random.default_rng(4)
    for k in (1, 3, 64, 777, 4096):
        c, q = unit(rng.normal(size=(k, 64))), unit(rng.normal(size=(50, 64)))
        ids, sims = Centroids(c).search(q, 4)
        s = q @ c.T
        assert (ids == np.argsort(-s, axis=1)[:, :4]).all() and np.allclose(sims, -np.sort(-s, axis=1)[:, :4])


def test_long_lists_are_split(spark):
    """Four lists a group only: those over the bound are split, twice where need be, and little is lost."""
    rows = make_vectors(4000)
    for s in (Settings(per_list=50, lists=4, split=400), Settings(per_list=50, lists=4, split=300, sample=100, sample_most=400)):
        got, want = run(spark, rows, settings=s), brute_pairs(rows)
        assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)
    df = spark.createDataFrame(rows, "id bigint, ch string, vec array<float>")
    scratch = Scratch(spark, "test")
    classes = scratch.cut(equal_classes(usable(df, "id", "ch", "vec", 64), 5), "classes")
    s = Settings(per_list=50, lists=4, split=400)
    flat = scratch.cut(probe(classes, fit_index(classes, 64, s), 64, s), "probes")
    split = split_lists(flat, classes, scratch, 64, s)
    longest = lambda p: p.groupBy("list").count().agg({"count": "max"}).first()[0]
    assert longest(flat) > 1000 and longest(split) < longest(flat) / 2
    assert split.where("member").select("cid").distinct().count() == classes.count()  # every vector is in some list


def test_recall_query(spark, data):
    from strataloom.llm.queries import p5_recall

    r = p5_recall(spark, data).first()
    assert r["recall"] >= 0.9 and r["queries"] > 0


def test_copies_ties_and_dirt(spark):
    rows = make_vectors(60)
    same = rows[0][2]
    rows += [(1000 + i, "a", same) for i in range(12)] + [(1000, "a", same)]
    rows += [(2000, "a", None), (2001, "a", [1.0] * 32), (2002, "a", [0.0] * 64), (2003, "a", [float("nan")] * 64), (2004, None, same), (None, "a", same), (2005, "a", [float("inf")] + [1.0] * 63)]
    clean = [r for r in rows if r[0] is not None and r[1] is not None]
    assert run(spark, rows) == brute_pairs(clean)
    assert run(spark, rows, settings=Settings(per_list=10, block=8)) == brute_pairs(clean)  # lists cut into blocks


def test_no_vectors(spark):
    assert run(spark, []) == set() and run(spark, [(1, "a", [1.0] * 64)]) == set()


def test_graph_finds_the_nearest_centroids():
    x = unit(np.random.default_rng(1).normal(size=(4000, 64)))
    c = fit_centroids(x, 300)
    ids, _ = CentroidGraph(c, 24).search(x[:500], 24)
    assert (ids[:, 0] == (x[:500] @ c.T).argmax(axis=1)).mean() > 0.9


def shingles(t):
    k = re.findall(r"[A-Za-z0-9_]+|[^ \t\r\n]", t)
    return {tuple(k[i : i + 5]) for i in range(len(k) - 4)}


def brute_near(rows):
    texts = {k: t for k, t, _ in rows if k is not None and t}
    sets = {k: shingles(t) for k, t in texts.items()}
    out = set()
    for a in texts:
        for b in texts:
            if a < b:
                either = len(sets[a] | sets[b])
                if texts[a] == texts[b] or either and 5 * len(sets[a] & sets[b]) >= 3 * either:
                    out.add((a, b))
    return out


def make_texts(n, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(30, 120))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((i, " ".join(t), 1))
    return rows


def near(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, body string, version int, class string")
    return {tuple(r) for r in all_pairs(*near_duplicates(df, "id", "body", "version"), "id", "a", "b").collect()}


def test_near_duplicates(spark):
    rows = make_texts(400)
    rows += [(1000, "a b", 1), (1001, "a b", 1), (1002, "a  b", 1), (1003, None, 1), (1004, "", 1), (None, rows[0][1], 1), (1005, "x " * 60_000, 1)]
    rows += [(1006, rows[0][1], 1), (1006, "quite another text that stands alone here", 2), (1007, "ünïcödé 漢字 " * 9, 1), (1008, "ünïcödé  漢字 " * 9, 1)]
    latest = [r for r in rows if not (r[0] == 1006 and r[2] == 1)]
    got, want = near(spark, rows), brute_near(latest)
    assert not got - want
    assert len(got) >= 0.995 * len(want) and (1000, 1001) in got and (1000, 1002) not in got and (1007, 1008) in got


def test_hot_keys_are_cut_into_parts(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(200)] = f"v{rng.randrange(999)}"
        rows.append((i, " ".join(t), 1))
    monkeypatch.setattr(neardup, "SAMPLE", 4)
    df = spark.createDataFrame(rows, "id bigint, body string, version int")
    _, links = near_duplicates(df, "id", "body", "version")
    alone = {(r["class_a"], r["class_b"]): r["bits"] for r in trie_pairs(df, "id", "body", "version").collect()}
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} <= set(alone) and all(0 <= b <= BUDGET for b in alone.values())
    whole = {tuple(r) for r in links.select("class_a", "class_b").collect()}
    real = candidates
    monkeypatch.setattr(neardup, "candidates", lambda reps: real(reps, part=40))
    _, links = near_duplicates(df, "id", "body", "version")
    assert {tuple(r) for r in links.select("class_a", "class_b").collect()} == whole and len(whole) > 1000


def test_trie_join_is_exact():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 256, (300, 12), dtype=np.uint8)
    sketch[100:200] = sketch[:100] ^ (rng.random((100, 12)) < 0.3).astype(np.uint8)
    key = rng.integers(0, 3, 300)
    order = np.lexsort((*sketch.T[::-1], key))
    sketch, key = sketch[order], key[order]
    got = {(int(i), int(j)) for a, b in Tries(key, sketch).join(33) for i, j in zip(np.minimum(a, b), np.maximum(a, b))}
    bits = np.unpackbits(sketch, axis=1).astype(int)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if key[i] == key[j] and (bits[i] != bits[j]).sum() <= 33}
    assert got == want


def test_empty(spark):
    assert near(spark, []) == set()
    m, l = near_duplicates(spark.createDataFrame([], "id bigint, body string"), "id", "body", threshold=Fraction(4, 5))
    assert m.count() == l.count() == 0
