"""Processing only what is new or changed: partition fingerprints and atomic partition replacement."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.paths import canonical_path
from strataloom.operators.ordering import keep_best, running
from strataloom.runtime import Scratch, delete


def row_hash(columns: list[str], seed: str = "") -> Column:
    """Order-free fingerprints add these up; a decimal sum cannot overflow or depend on the order of rows.

    Spark's hash passes over nulls, so every value stands behind a mark that tells whether it is one: a value that moves
    from one nullable column to another changes the hash.
    """
    marked = [x for c in columns for x in (F.isnull(c), F.col(c))]
    return F.xxhash64(*([F.lit(seed)] if seed else []), *marked).cast("decimal(20,0)")


def sums(df: DataFrame, keys: list[str], columns: list[str], source: str) -> DataFrame:
    """``(keys..., source, n, a, b)``: the number of rows and two sums of their hashes, by key.

    Partial sums are taken before the shuffle, which moves one row a key and task. Two hashes with different seeds are
    added, so that a change escapes only if both sums agree by chance. The sums are additive: those of parts of a table
    (batches, say) add up to those of the whole.
    """
    n, a, b = F.count("*").alias("n"), F.sum(row_hash(columns)).alias("a"), F.sum(row_hash(columns, "second")).alias("b")
    return df.groupBy(*keys).agg(n, a, b).select(*keys, F.lit(source).alias("source"), "n", "a", "b")


def fingerprints(parts: DataFrame, bucket: Column) -> DataFrame:
    """``(bucket, source, n, digest)`` from rows of ``sums``, which are added up by bucket."""
    whole = parts.groupBy(bucket.alias("bucket"), "source").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return whole.select("bucket", "source", "n", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


class IncrementalTable:
    """A result table, partitioned by bucket, that is recomputed only where its inputs changed.

    ``refresh`` compares the fingerprints of the inputs by bucket with those the stored result was made from, has the
    changed buckets recomputed, replaces exactly those by dynamic partition overwrite, and only then writes the new
    fingerprints, as a new version whose name is committed by one rename. A failure before the rename leaves the old
    fingerprints: the next run finds the same buckets changed, recomputes them and overwrites what was half done, so no
    record is skipped and none is repeated. Buckets that lost their last row are emptied.

    The number of buckets follows the number of keys (``plan``): a power of two with about ``per_bucket`` keys each, at
    least ``least``, at most ``most`` directories. It is part of the committed version's name and of the folder of its
    data. Once there are four times as many keys as it was made for, the table is laid out anew in another folder, and
    the commit that names the new version switches over to it; the old folder goes after that.
    """

    def __init__(self, spark: SparkSession, path: str, per_bucket: int = 16, least: int = 16, most: int = 65_536):
        self.spark, self.path, self.per_bucket, self.least, self.most = spark, path.rstrip("/"), per_bucket, least, most
        versions = self._committed()
        self.buckets = versions[-1][1] if versions else least

    @property
    def data(self) -> str:
        return f"{self.path}/data-{self.buckets}"

    def plan(self, keys: int) -> int:
        """Settle the number of buckets for so many keys: the stored one as long as it will do."""
        versions = self._committed()
        want = min(self.most, max(self.least, 1 << max(0, -(-keys // self.per_bucket) - 1).bit_length()))
        self.buckets = versions[-1][1] if versions and want < 4 * versions[-1][1] else want
        return self.buckets

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path
        return p, p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self) -> list[tuple[int, int]]:
        """(number, buckets) of the committed versions."""
        p, fs = self._fs()
        at = p(f"{self.path}/prints")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(tuple(int(x) for x in n[1:].split("-")) for n in names if n[:1] == "v")

    def stored(self) -> DataFrame | None:
        """Fingerprints of the inputs the table was last made from; none for another number of buckets."""
        versions = self._committed()
        return self.spark.read.parquet(f"{self.path}/prints/v{versions[-1][0]}-{self.buckets}") if versions and versions[-1][1] == self.buckets else None

    def changed(self, prints: DataFrame) -> list[int]:
        """Buckets whose fingerprints differ from the stored ones; at most ``buckets`` numbers come to the driver."""
        old = self.stored()
        if old is None:
            return sorted(r[0] for r in prints.select("bucket").distinct().collect())
        new, o = prints.alias("n"), old.alias("o")
        on = (F.col("n.bucket") == F.col("o.bucket")) & (F.col("n.source") == F.col("o.source"))
        same = F.col("n.n").eqNullSafe(F.col("o.n")) & F.col("n.digest").eqNullSafe(F.col("o.digest"))
        return sorted(r[0] for r in new.join(o, on, "full_outer").where(~same).select(F.coalesce("n.bucket", "o.bucket").alias("b")).distinct().collect())

    def refresh(self, prints: DataFrame, compute: Callable[[list[int]], DataFrame], fail: str = "") -> list[int]:
        """Bring the table up to date; returns the buckets recomputed.

        compute(buckets) gives the result rows of these buckets, with a column ``bucket``. fail names a point
        ("before_data", "before_commit") at which to raise, for tests of recovery.
        """
        stage = f"{self.path}/staged-{uuid.uuid4().hex}"
        prints.write.parquet(stage)  # what is committed is what was compared
        try:
            prints = self.spark.read.schema(prints.schema).parquet(stage)
            todo = self.changed(prints)
            if todo:
                if fail == "before_data":
                    raise RuntimeError(fail)
                if self.stored() is None:
                    delete(self.spark, self.data)  # left by an attempt that was never committed
                batch = uuid.uuid4().hex
                rows = compute(todo).withColumn("_batch", F.lit(batch))
                rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.data)
                self._empty(todo, batch, rows.schema)
            if fail == "before_commit":
                raise RuntimeError(fail)
            versions = self._committed()
            p, fs = self._fs()
            fs.mkdirs(p(f"{self.path}/prints"))
            if not fs.rename(p(stage), p(f"{self.path}/prints/v{(versions or [(0, 0)])[-1][0] + 1}-{self.buckets}")):
                raise RuntimeError("the fingerprints could not be committed")
            for v, b in versions[:-1]:
                delete(self.spark, f"{self.path}/prints/v{v}-{b}")
                if b != self.buckets:
                    delete(self.spark, f"{self.path}/data-{b}")
        except BaseException:
            delete(self.spark, stage)
            raise
        return todo

    def _empty(self, todo: list[int], batch: str, schema) -> None:
        """Dynamic overwrite leaves partitions without new rows as they were; remove those that must be empty now."""
        stale = self.spark.read.schema(schema).parquet(self.data).where(F.col("bucket").isin(todo) & (F.col("_batch") != batch))
        for (b,) in stale.select("bucket").distinct().collect():
            delete(self.spark, f"{self.data}/bucket={b}")

    def read(self, schema) -> DataFrame:
        """The result of the last committed version; empty with the given schema before the first."""
        p, fs = self._fs()
        versions = self._committed()
        at = f"{self.path}/data-{versions[-1][1]}" if versions else None
        if not at or not fs.exists(p(at)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at)


#: What the result and the fingerprints of a module depend on.
FILE_COLUMNS = ["obs_id", "run_id", "repo", "module_dir", "file_path", "sha256", "arrived_at"]
RUN_COLUMNS = ["run_id", "repo", "module_dir", "started_at", "finished_at", "status", "source_digest"]
CHANGES = "run_id bigint, file_path string, bucket int"


def successful_runs(runs: DataFrame) -> DataFrame:
    """One row for each run_id that is ok and attested by a source_digest; repeated rows count once."""
    once = keep_best(runs.select(RUN_COLUMNS).where("run_id is not null"), ["run_id"], [F.col("finished_at"), F.col("started_at"), F.xxhash64(*RUN_COLUMNS)])
    return once.where("status = 'ok' and source_digest is not null and finished_at is not null")


def baselines(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(run_id, baseline)``: of each run that started, the run of its module that finished last before or as it began.

    An as-of join by a running maximum over range partitions: finish events sort before start events of the same moment.
    Ties in finished_at go to the greater run_id. A run that ends no later than it starts is not its own baseline; it
    then has none.
    """
    at = F.explode(
        F.array(
            F.struct(F.col("finished_at").alias("t"), F.lit(0).alias("kind"), F.struct("finished_at", "run_id").alias("done")),
            F.struct(F.col("started_at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<finished_at:timestamp_ntz,run_id:bigint>" if dict(runs.dtypes)["finished_at"] == "timestamp_ntz" else "struct<finished_at:timestamp,run_id:bigint>").alias("done")),
        )
    )
    events = runs.where("repo is not null and module_dir is not null").select("repo", "module_dir", "run_id", at.alias("e")).select("repo", "module_dir", "run_id", "e.*").where("t is not null")
    order = [F.col("t"), F.col("kind"), F.col("run_id")]
    last = running(events, scratch, ["repo", "module_dir"], order, "done", "last", "max")
    return last.where("kind = 1 and last is not null and last.run_id <> run_id").select("run_id", F.col("last.run_id").alias("baseline"))


def changed_files(files: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(run_id, file_path)``: the files each successful run sees that are new or changed since its baseline.

    Every sighting is sent once to its own run and once to each run it is the baseline of, and both sides meet in one
    aggregation by (run, path): one join and one shuffle, no self-join of the sightings. The last arrival of a path
    holds (ties: greatest obs_id). Rows without a run, path or digest are not seen. Digests are compared without letter
    case, paths in canonical form.
    """
    good = scratch.cut(successful_runs(runs), "runs")
    base = scratch.cut(baselines(good, scratch), "baselines")
    uses = base.select("run_id", F.col("run_id").alias("target"), F.lit(True).alias("now")).unionByName(
        base.select(F.col("baseline").alias("run_id"), F.col("run_id").alias("target"), F.lit(False).alias("now"))
    )
    uses = uses.join(good.select("run_id", "finished_at"), "run_id")
    digest = F.lower(F.trim("sha256"))
    seen = files.where("run_id is not null and file_path is not null and sha256 is not null and arrived_at is not null").select(
        "run_id", "arrived_at", "obs_id", canonical_path(F.col("file_path")).alias("file_path"), F.coalesce(F.unhex(digest), digest.cast("binary")).alias("digest")
    )
    met = seen.join(uses, "run_id").where("arrived_at <= finished_at")
    last = lambda now: F.max_by("digest", F.when(F.col("now") == now, F.struct("arrived_at", "obs_id")))
    both = met.groupBy("target", "file_path").agg(last(True).alias("a"), last(False).alias("b"))
    return both.where("a is not null and (b is null or a <> b)").select(F.col("target").alias("run_id"), "file_path")


MODULE = ["repo", "module_dir"]


def file_sums(files: DataFrame) -> DataFrame:
    """What the files of each module add to its fingerprint; those of batches of files add up."""
    return sums(files, MODULE, FILE_COLUMNS, "files")


def refresh_changed_files(store: IncrementalTable, files: DataFrame, runs: DataFrame, fail: str = "", of_files: DataFrame | None = None, pick: Callable[[list[int]], DataFrame] | None = None) -> list[int]:
    """Bring the table of changed files up to date; returns the recomputed buckets. A bucket holds whole modules; a file
    belongs to the module its own columns name, which must be that of its run.

    One pass over the inputs gives sums by module, from which the number of buckets and their fingerprints follow.
    of_files: these sums for files, where they are known already; pick(buckets): the files of some buckets, where there
    is a quicker way to them than a filter.
    """
    scratch = Scratch(store.spark, "changes")
    files, runs = files.select(FILE_COLUMNS), runs.select(RUN_COLUMNS)
    parts = scratch.cut((file_sums(files) if of_files is None else of_files).unionByName(sums(runs, MODULE, RUN_COLUMNS, "runs")), "sums")
    store.plan(parts.select(MODULE).distinct().count())
    module = store.bucket(*MODULE)

    def compute(todo: list[int]) -> DataFrame:
        some = (lambda df: df) if len(todo) == store.buckets else (lambda df: df.where(module.isin(todo)))
        r = some(runs)
        found = changed_files(pick(todo).select(FILE_COLUMNS) if pick else some(files), r, scratch)
        where = successful_runs(r).select("run_id", module.alias("bucket"))
        return found.join(where, "run_id").select("run_id", "file_path", "bucket")

    return store.refresh(fingerprints(parts, module), compute, fail)
