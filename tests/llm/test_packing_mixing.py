import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.mixing import mix_sources
from strataloom.llm.packing import BestFit, pack, pack_documents, pack_partition
from strataloom.llm.tokens import VOCABULARY, encoding, token_counts
from strataloom.runtime import Scratch

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_best_fit(sizes):
    at, loads = pack_partition(sizes, 100)
    assert sum(loads) == sum(sizes) and all(0 < x <= 100 for x in loads)
    for b, load in enumerate(loads):
        assert load == sum(s for s, x in zip(sizes, at) if x == b)
    assert sum(x <= 50 for x in loads) <= 1
    assert len(loads) <= math.ceil(sum(sizes) / 100 * 11 / 9) + 1


def test_best_fit_takes_the_fullest_bin():
    b = BestFit(10)
    assert [b.add(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]


def test_token_counts(spark):
    rows = [(1, "Hello world", 1), (2, None, 1), (3, "", 1), (4, "naïve 漢字 😀 <|endoftext|>", 1), (5, "a " * 50_000, 1)]
    got = {r["k"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(rows, "k int, _t string, n_tokens int"), "_t", ["k"]).collect()}
    e = encoding(VOCABULARY).encode_ordinary
    assert got == {k: len(e(t)) if t else 0 for k, t, _ in rows}


CAPS = [(64,), (256,), (1024,), (None,), (0,)]


def test_pack_documents(spark):
    rows = [(i, "word " * (1 + i * 7 % 90), "x") for i in range(400)] + [(900, "word " * 5000, "x"), (901, None, "x"), (902, "", "x"), (903, "word " * 1024, "x"), (None, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bin string")
    caps = spark.createDataFrame(CAPS, "cap int")
    got = [r.asDict() for r in pack_documents(docs, "doc_id", "text", caps, "cap", items=50).collect()]
    e = encoding(VOCABULARY).encode_ordinary
    want = {k: len(e(t)) for k, t, _ in rows if k is not None and t}
    sums, loads = {}, {}
    for r in got:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
        loads.setdefault(r["container_id"], [0, r["load"], r["capacity"]])[0] += r["n_tokens"]
    assert sums == want
    assert all(a == b <= c for a, b, c in loads.values())
    assert {r["doc_id"] for r in got if r["piece_ix"] > 0} == {k for k, n in want.items() if n > 1024}
    assert len(loads) <= math.ceil(sum(want.values()) / 1024) + 1  # nine partitions of 50 items, merged
    assert pack_documents(docs.limit(0), "doc_id", "text", caps, "cap").count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, "doc_id", "text", caps.where("cap is null"), "cap")


def packed(spark, sizes, each):
    items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, size bigint")
    got = pack(items, Scratch(spark, "test"), 100, len(sizes), each).collect()
    assert sorted(r["item"] for r in got) == list(range(len(sizes)))
    loads = {}
    for r in got:
        loads.setdefault(r["bin"], [r["load"], 0])[1] += sizes[r["item"]]
    assert all(a == b <= 100 for a, b in loads.values())
    return len(loads)


def test_every_underfull_bin_is_merged(spark):
    sizes = [1 + (i * 7919 + i * i) % 97 for i in range(6000)]
    assert packed(spark, sizes, 500) <= 1.02 * sum(sizes) / 100 + 1  # 12 partitions, each with bins left over
    # Thousands of underfull bins in every round: most of the larger halves meet a smaller one in a later round only.
    assert packed(spark, [55] * 5500 + [45] * 5500, 3) <= 1.2 * 5500


def test_bins_that_do_not_combine_end_the_rounds(spark):
    assert packed(spark, [51] * 5000, 500) == 5000
    assert packed(spark, [51] * 30, 500) == 30
    assert packed(spark, [100] * 40, 7) == 40


def test_mix(spark):
    rows = [(i, f"text number {i} " * (1 + i % 9), ["Main-Feed", "main_feed ", "MAIN_FEED"][i % 3], 0) for i in range(600)]
    rows += [(1000 + i, "small one " * 3, "small", 0) for i in range(5)] + [(2000 + i, "other text here", "other", 0) for i in range(100)]
    rows += [(3000, None, "main_feed", 0), (3001, "  ", "other", 0), (3002, "no source", None, 0), (3003, "blank", " ", 0), (3004, "not a target", "elsewhere", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate int")
    targets = spark.createDataFrame([("main_feed", 0.5, 3), ("small", 0.3, 4), ("other", 0.2, 20), ("gone", 0.1, 2), ("zero", 0.0, 2), ("other2", None, None)], "source string, target_share double, max_repeats int")
    copies, report = mix_sources(docs, "doc_id", "text", "source", targets)
    rep = {r["source"]: r for r in report.collect()}
    e = encoding(VOCABULARY).encode_ordinary
    total = sum(len(e(t)) for _, t, s, _ in rows if t and t.strip() and s and s.strip())
    assert rep["small"]["short"] and rep["gone"]["short"] and not rep["main_feed"]["short"] and not rep["zero"]["short"]
    assert abs(rep["main_feed"]["target_tokens"] - total / 2) < 1e-6
    assert abs(rep["main_feed"]["mixed_tokens"] / (total / 2) - 1) < 0.01
    c = copies.collect()
    assert all(0 <= r["copies"] <= {"main_feed": 3, "small": 4, "other": 20}[r["source"]] for r in c)
    assert all(r["copies"] == 4 for r in c if r["source"] == "small")
    assert abs(sum(r["rate"] * r["n_tokens"] for r in c if r["source"] == "main_feed") - total / 2) < 1
    by = sorted((r["n_tokens"], r["rate"]) for r in c if r["source"] == "main_feed")
    assert all(len({round(x, 9) for n2, x in by if n2 == n}) == 1 for n, _ in by)  # the rate depends on the size only
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    exact = docs.where("doc_id between 1000 and 1004 or doc_id >= 2000 and doc_id < 2100")  # the target is just what all repeats give
    t = {k: sum(len(e(x)) for i, x, s, _ in rows if s == k and i != 3001) for k in ("small", "other")}
    half = spark.createDataFrame([("small", 4 * t["small"] / (t["small"] + t["other"]), 4), ("other", 0.01, 1)], "source string, target_share double, max_repeats int")
    assert not any(r["short"] for r in mix_sources(exact, "doc_id", "text", "source", half)[1].collect())
    less = half.withColumn("max_repeats", half["max_repeats"] - 1)
    assert {r["source"]: r["short"] for r in mix_sources(exact, "doc_id", "text", "source", less)[1].collect()} == {"small": True, "other": True}
    none = mix_sources(docs.limit(0), "doc_id", "text", "source", targets)
    assert none[0].count() == 0 and none[1].count() == 6
