import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataloom.operators.incremental import CHANGES, IncrementalTable, refresh_changed_files, sums
from strataloom.runtime import Scratch

T0 = dt.datetime(2025, 1, 1)
FILES = "obs_id bigint, run_id bigint, repo string, module_dir string, pkg string, file_path string, sha256 string, arrived_at timestamp_ntz, bucket int"
RUNS = "run_id bigint, repo string, module_dir string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, source_digest string, model string"


def at(h):
    return T0 + dt.timedelta(hours=h)


def table(spark):
    return IncrementalTable(spark, Scratch(spark, "test").path("changes"), least=8)


def runs(spark, rows):
    return spark.createDataFrame([(i, r, m, at(s), at(f) if f is not None else None, st, dg, "x") for i, r, m, s, f, st, dg in rows], RUNS)


def files(spark, rows):
    return spark.createDataFrame([(o, run, "r", "m", None, p, h, at(a), 0) for o, run, p, h, a in rows], FILES)


RUN_ROWS = [
    (10, "r", "m", 0, 1, "ok", "d"), (9, "r", "m", 2, 3, "failed", "d"), (8, "r", "m", 4, 5, "ok", None), (7, "r", "m", 6, 7, "ok", "d"),
    (6, "r", "m", 6.5, 9, "ok", "d"), (7, "r", "m", 6, 7, "ok", "d"), (5, "r", "m", 10, None, "running", None), (4, "r", "other", 20, 21, "ok", "d"), (3, None, "m", 20, 21, "ok", "d"),
]
FILE_ROWS = [
    (1, 10, "a.go", "H1", 0.1), (2, 10, "./b.go", "h2", 0.2), (3, 10, "c.go", None, 0.3), (4, 10, "d.go", "h4", 1.5),
    (5, 9, "z.go", "h9", 2.5), (6, 7, "a.go", "h1", 6.1), (7, 7, "b.go", "h3", 6.2), (8, 7, "b.go", "H2", 6.3), (9, 7, "c.go", "h5", 6.4),
    (10, 7, "d.go", "h4", 6.5), (11, 7, "x\\y.go", "h6", 6.6), (11, 7, "x\\y.go", "h6", 6.6), (12, 6, "a.go", "h7", 6.8), (13, 7, None, "h", 6.1), (14, None, "q.go", "h", 6.1),
]
WANT = {(7, "c.go"), (7, "d.go"), (7, "x/y.go"), (6, "a.go")}


def read(store):
    return {tuple(r) for r in store.read(CHANGES).select("run_id", "file_path").collect()}


def test_changed_files(spark):
    s = table(spark)
    refresh_changed_files(s, files(spark, FILE_ROWS), runs(spark, RUN_ROWS))
    assert read(s) == WANT
    assert refresh_changed_files(s, files(spark, FILE_ROWS[::-1]), runs(spark, RUN_ROWS)) == []


@pytest.mark.parametrize("fail", ["before_data", "before_commit"])
def test_failures_neither_skip_nor_repeat(spark, fail):
    s = table(spark)
    refresh_changed_files(s, files(spark, FILE_ROWS[:7]), runs(spark, RUN_ROWS))
    with pytest.raises(RuntimeError):
        refresh_changed_files(s, files(spark, FILE_ROWS), runs(spark, RUN_ROWS), fail)
    assert refresh_changed_files(s, files(spark, FILE_ROWS), runs(spark, RUN_ROWS)) != []
    assert read(s) == WANT


def test_rows_that_vanish_empty_their_bucket(spark):
    s = table(spark)
    refresh_changed_files(s, files(spark, FILE_ROWS), runs(spark, RUN_ROWS))
    refresh_changed_files(s, files(spark, FILE_ROWS[:5]), runs(spark, RUN_ROWS))
    assert read(s) == set()


def test_empty(spark):
    s = table(spark)
    assert refresh_changed_files(s, files(spark, []), runs(spark, [])) == []
    assert read(s) == set()


def prints(df, columns):
    return [tuple(r) for r in sums(df.withColumn("_all", F.lit(0)), ["_all"], columns, "s").collect()]


def test_fingerprints_see_every_change(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    p = lambda d: prints(d, ["k", "v"])
    assert p(df) == p(df.orderBy(F.desc("k")).repartition(3))
    assert p(df) != p(df.distinct()) and p(df) != p(df.fillna("")) and p(df) != p(df.withColumn("v", F.lit("a")))


def test_fingerprints_see_values_that_change_places(spark):
    """A value that moves to any other nullable column, or changes places with a null there, is a change."""
    names = ["a", "b", "c", "d"]
    rows = [(7, 1, None, None, 2), (8, None, 3, None, None), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int, d int")
    seen = {tuple(prints(df, ["k", *names]))}
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            for k in (7, 8):
                this = F.col("k") == k
                swapped = df.withColumns({x: F.when(this, F.col(y)).otherwise(F.col(x)), y: F.when(this, F.col(x)).otherwise(F.col(y))})
                same = swapped.exceptAll(df).isEmpty()
                assert (tuple(prints(swapped, ["k", *names])) in seen) == same, (x, y, k)


def test_a_time_in_the_other_column_is_a_change(spark):
    """Baselines move when the only time of a run moves from started_at to finished_at."""
    f = files(spark, [(1, 1, "a.go", "h1", 0.1), (2, 2, "a.go", "h2", 2.1), (3, 3, "a.go", "h2", 4.1)])
    rows = [(1, "r", "m", 0, 1, "ok", "d"), (3, "r", "m", 4, 5, "ok", "d")]
    one = lambda s, e: spark.createDataFrame([(2, "r", "m", s and at(s), e and at(e), "ok", "d", "x")], RUNS)
    before, after = runs(spark, rows).unionByName(one(3, None)), runs(spark, rows).unionByName(one(None, 3))
    s, fresh = table(spark), table(spark)
    refresh_changed_files(s, f, before)
    assert read(s) == {(3, "a.go")}
    assert len(refresh_changed_files(s, f, after)) == 1
    refresh_changed_files(fresh, f, after)
    assert read(s) == read(fresh) == set()


def test_buckets_follow_the_modules(spark):
    f = lambda n: spark.createDataFrame([(i, i, "r", f"m{i}", None, "a.go", "h", at(0.5), 0) for i in range(n)], FILES)
    s = table(spark)
    refresh_changed_files(s, f(64), runs(spark, [(i, "r", f"m{i}", 0, 1, "ok", "d") for i in range(64)]))
    assert s.buckets == 8
    r = runs(spark, [(i, "r", f"m{i}", 0, 1, "ok", "d") for i in range(300)] + [(1000, "r", "m7", 2, 3, "ok", "d")])
    more = f(300).unionByName(spark.createDataFrame([(2000, 1000, "r", "m7", None, "b.go", "h", at(2.5), 0)], FILES))
    with pytest.raises(RuntimeError):
        refresh_changed_files(s, more, r, "before_commit")
    assert read(IncrementalTable(spark, s.path)) == set()  # the old layout holds until the commit
    assert 25 < len(refresh_changed_files(s, more, r)) <= s.buckets == 32  # all that hold a module
    again = IncrementalTable(spark, s.path)
    assert again.buckets == 32 and refresh_changed_files(again, more, r) == [] and read(again) == {(1000, "b.go")}
    assert len(refresh_changed_files(again, more.where("obs_id <> 2000"), r)) == 1 and read(again) == set()


def test_nothing_stays_of_a_first_attempt_that_failed(spark):
    """What a refresh wrote before it failed is gone, even where its module has no rows any more."""
    s = table(spark)
    other = [(20, 30, "q.go", "h", 0.1), (21, 31, "q.go", "i", 2.1)]
    f = files(spark, FILE_ROWS).unionByName(spark.createDataFrame([(o, r, "r", "gone", None, p, h, at(a), 0) for o, r, p, h, a in other], FILES))
    r = runs(spark, RUN_ROWS + [(30, "r", "gone", 0, 1, "ok", "d"), (31, "r", "gone", 2, 3, "ok", "d")])
    with pytest.raises(RuntimeError):
        refresh_changed_files(s, f, r, "before_commit")
    assert read(s) == set()
    refresh_changed_files(s, files(spark, FILE_ROWS), runs(spark, RUN_ROWS))
    assert read(s) == WANT
