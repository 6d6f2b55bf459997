import random

from strataloom.llm.components import group_identities


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {(x, min(g, key=lambda s: s.encode())) for g in groups.values() for x in g}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "v") for a, b in pairs], "l string, r string, v string")
    return {tuple(r) for r in group_identities(df, "l", "r").collect()}


def test_random_graphs(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)]
    assert run(spark, pairs) == brute(pairs)


def test_chain_star_and_dirt(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"s{i}") for i in range(200)]
    pairs += [("é", "z"), ("Z", "é"), ("a", "a"), (None, "b"), ("b", None), (None, None), ("z", "é"), ("", "x")]
    got = run(spark, pairs)
    assert got == brute(pairs) and ("a", "a") not in got and ("", "") in got


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "a"), (None, "x")]) == set()
