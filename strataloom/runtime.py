"""Session plumbing: table access, the shared scratch folder, lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

#: Serialized rows that may be shipped to every executor; joins with anything larger, or of unknown size, shuffle.
BROADCAST_ROWS = 20_000


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "strataloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, if all runs on this
    machine. A cluster must name one: executors elsewhere could not read what others wrote."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.strataloom.scratch", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="strataloom-")
            spark.conf.set("spark.strataloom.scratch", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it wherever they run."""
    if spark.conf.get("spark.strataloom.shipped", None) == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="strataloom-"), "strataloom.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("strataloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(at)
    spark.conf.set("spark.strataloom.shipped", spark.sparkContext.applicationId)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of DataFrames nobody holds are deleted: Spark does so only when the driver collects its garbage. What
    the first round frees may hold more, for the second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


class Scratch:
    """Written tables in the shared folder, which cut lineage like a reliable checkpoint but stay columnar and compressed.

    A lost executor costs a re-read, never a recomputation of earlier rounds. ``drop`` removes tables that later rounds
    have replaced; what a returned DataFrame still reads must be kept.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/strataloom/{label}-{uuid.uuid4().hex}"
        self.steps = 0

    def path(self, name: str) -> str:
        self.steps += 1
        return f"{self.root}/{self.steps:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Write ``df`` and read it back with the schema it had."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        if self.steps == 1:  # what is left of it goes with the session
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        back = self.spark.read.schema(df.schema).parquet(at)
        back._scratch_path = at
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_scratch_path", None):
                delete(self.spark, t._scratch_path)

    def clear(self) -> None:
        delete(self.spark, self.root)


def together(spark: SparkSession, tasks: dict[str, Callable[[], object]], grace: float = 2.0) -> dict[str, object]:
    """The results of functions that start Spark jobs, run at the same time, each in a scheduler pool of its name.

    If one fails, or the caller is interrupted, the jobs of the others are cancelled by their tag, and they get ``grace``
    seconds to end before the failure is passed on.
    """
    context, tag = spark.sparkContext, f"together-{uuid.uuid4().hex}"
    results: dict[str, object] = {}
    failures: list[BaseException] = []

    def work(name: str, task: Callable[[], object]) -> None:
        context.setLocalProperty("spark.scheduler.pool", name)
        context.addJobTag(tag)
        try:
            results[name] = task()
        except BaseException as e:  # noqa: BLE001
            failures.append(e)

    threads = [InheritableThread(target=work, args=(n, t), daemon=True) for n, t in tasks.items()]
    try:
        for t in threads:
            t.start()
        while any(t.is_alive() for t in threads) and not failures:
            for t in threads:
                t.join(0.05)
    except BaseException as e:  # noqa: BLE001
        failures.append(e)
    if failures:
        context.cancelJobsWithTag(tag)
        end = time.monotonic() + grace
        for t in threads:
            t.join(max(0.0, end - time.monotonic()))
        raise failures[0]
    return {n: results[n] for n in tasks}
