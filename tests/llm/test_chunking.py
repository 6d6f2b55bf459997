import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.chunking import LINES, PROSE, RangeMaximum, cut_points, split_oversized, strengths


def brute(b, limit=2000, window=512, overlap=256):
    out, s = [], 0
    while len(b) - s > limit:
        end = s + limit
        k = b.rfind(b"\n", s + limit - window, s + limit)
        if k >= 0:
            end = k + 1
        else:
            while b[end] & 0xC0 == 0x80:
                end -= 1
        out.append((s, end))
        s = end - overlap
        while b[s] & 0xC0 == 0x80:
            s += 1
    return [*out, (s, len(b))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "漢", "😀", "\n", "word ", "x" * 300, "\n\n"]), min_size=1, max_size=900))
def test_pieces_match_the_rule(parts):
    b = "".join(parts).encode()
    if len(b) > 2000:
        got = cut_points(strengths(np.frombuffer(b, np.uint8), LINES), 2000, 512, 256)
        assert got == brute(b)
        for s, e in got:
            b[s:e].decode()
        assert all(a[1] - 256 <= c[0] < a[1] for a, c in zip(got, got[1:]))


@given(st.lists(st.integers(0, 3), min_size=8, max_size=200), st.integers(1, 8))
def test_range_maximum(values, width):
    index = RangeMaximum(np.array(values), width)
    for a in range(len(values) - width + 1):
        w = values[a : a + width]
        assert index.best(a, a + width - 1) == a + max(i for i, x in enumerate(w) if x == max(w))


def test_table(spark):
    long = "line of text\n" * 400
    rows = [
        (1, long, 1, "k"), (1, "short now", 2, "k"), (2, "short before", 1, "k"), (2, long, 2, "k"), (2, long, 2, "k"),
        (3, None, 1, None), (4, "", 1, ""), (5, "ü" * 1000, 1, "x"), (6, "ü" * 1001, 1, "x"), (7, "a" * 300_000, 1, "x"), (None, long, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "block_id bigint, content string, at int, body string")
    got = {}
    for r in split_oversized(df, "block_id", "content", "at").orderBy("chunk_ix").collect():
        got.setdefault(r["block_id"], []).append((r["start_byte"], r["end_byte"]))
    assert set(got) == {2, 6, 7, None}
    assert got[2] == brute(long.encode()) and got[6] == brute(("ü" * 1001).encode()) and got[7] == brute(b"a" * 300_000)
    assert split_oversized(df.limit(0), "block_id", "content").count() == 0


def test_prose_prefers_paragraphs():
    b = (b"x" * 1600 + b"\n\n" + b"y" * 100 + b". " + b"z" * 500).ljust(3000, b"w")
    assert cut_points(strengths(np.frombuffer(b, np.uint8), PROSE), 2000, 512, 256)[0] == (0, 1602)


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", limit=500, window=300, overlap=250)
