"""A run from the command line: ``python -m strataloom.cli [options] ROOT [PATTERN...]``.

Exit codes (fixed values): 0 clean, 1 failure, 2 wrong usage, 3 findings, 130 interrupted.
"""

from __future__ import annotations

import argparse
import signal
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom.operators import findings as R
from strataloom.operators import models as M
from strataloom.plans import engine
from strataloom.runtime import local_session, ship
from strataloom.sources import files as S
from strataloom.sources import stores as K

CLEAN, FAILURE, USAGE, FOUND, INTERRUPTED = 0, 1, 2, 3, 130


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataloom")
    p.add_argument("root", help="the folder of the source tree")
    p.add_argument("patterns", nargs="*", default=[], help="dir, dir/... or ...; all of the tree by default")
    p.add_argument("--format", choices=("text", "json", "lines"), default="text", help="a report by kind, one JSON document, or a line a finding")
    p.add_argument("--store", help="folder of earlier runs: an unchanged tree is not analysed again")
    p.add_argument("--stamp", help="file that attests a clean run")
    p.add_argument("--verify", action="store_true", help="only check that the stamp holds for the tree as it is")
    p.add_argument("--embedder", help="URL of an embedding server, for semantic_duplicate")
    p.add_argument("--model", default="", help="the model that server must run")
    p.add_argument("--dims", type=int, default=1024)
    p.add_argument("--reviewer", nargs="+", help="command that answers prompts, for the rules a reviewer decides")
    return p


def each_finding(findings, emit: Callable[[str, int, int, str, str], None]) -> int:
    """Hand every finding to ``emit`` in order, a partition at a time; returns how many there were."""
    n = 0
    for r in R.ordered(findings).toLocalIterator(prefetchPartitions=True):
        emit(r["file"], r["line"], r["col"], r["kind"], r["message"])
        n += 1
    return n


def main(arguments: list[str], spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    try:
        a = parser().parse_args(arguments)
        if a.verify and not a.stamp:
            raise ValueError("--verify needs --stamp")
    except ValueError as e:
        print(e, file=sys.stderr)
        return USAGE
    except SystemExit as e:
        return USAGE if e.code else CLEAN
    own = spark is None
    try:
        spark = spark or local_session("*", 8, "strataloom")
        ship(spark)
        policy = {"model": a.model, "patterns": sorted(a.patterns)}
        if a.verify:
            files = S.scripts(S.files(spark, a.root), a.patterns or ["..."]).where("not generated")
            status = engine.verify(spark, files, a.stamp, policy)
            out(status)
            return CLEAN if status == "holds" else FOUND
        embedder = M.HttpEmbedder(a.embedder, a.model) if a.embedder else None
        reviewer = M.SubprocessResponder(a.reviewer) if a.reviewer else None
        r = engine.run(spark, a.root, a.patterns or None, embedder, a.dims, reviewer, policy, a.store)
        if a.format == "lines":
            n = each_finding(r.findings, lambda *x: out("%s:%d:%d: %s: %s" % x))
        else:
            n = r.findings.count()
            rules = r.findings.select("kind").distinct().select("kind", F.col("kind").alias("finds"), F.lit("").alias("fix"))
            lines = (x["text"] for x in R.as_json(r.findings, rules).orderBy("place").toLocalIterator()) if a.format == "json" else K.text_report(r.report())
            for line in lines:
                out(line)
        if a.stamp:
            engine.attest(spark, r, a.stamp, policy)
        return FOUND if n else CLEAN
    except KeyboardInterrupt:
        print("stopped", file=sys.stderr)
        return INTERRUPTED
    except Exception as e:  # whatever went wrong, the caller sees one line and the code
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return FAILURE
    finally:
        if own and spark is not None:
            spark.stop()


def _stop(*_: object) -> None:
    raise KeyboardInterrupt


if __name__ == "__main__":
    signal.signal(signal.SIGTERM, _stop)
    signal.signal(signal.SIGINT, _stop)
    sys.exit(main(sys.argv[1:]))
