"""Scans of source trees, Git indexes and JSON streams."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import text as X

#: Directories that are not walked: hidden ones, those beginning with _, and these (fixed values).
SKIPPED = ("node_modules", "vendor", "testdata")


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, content, size, modified)`` of all files under root; path is relative. Text that is not UTF-8 is null.

    A distributed scan (binaryFile): listing and reading are split over tasks, ``glob`` prunes at listing.
    """
    base = root.rstrip("/")
    plain = base.split("://", 1)[-1]
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    at = F.instr("path", F.lit(plain + "/")) + len(plain) + 1
    return f.select(
        F.substr("path", at).alias("path"), F.try_validate_utf8("content").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def walked(path: Column) -> Column:
    """Is the path outside hidden, private, vendored and test-data directories?"""
    return ~F.exists(F.split(X.directory(path), "/"), lambda p: p.startswith(".") | p.startswith("_") | p.isin(*SKIPPED))


def in_scope(path: Column, patterns: list[str]) -> Column:
    """``dir`` means the files of one directory, ``dir/...`` its subtree, ``...`` everything. No patterns, nothing."""
    out = F.lit(False)
    for p in patterns:
        p = p.removeprefix("./")
        if p == "...":
            hit = F.lit(True)
        elif p.endswith("/..."):
            hit = path.startswith(p[:-3]) | (X.directory(path) == p[:-4])
        else:
            hit = X.directory(path) == p.rstrip("/").removeprefix(".")
        out = out | hit
    return out


def scripts(all_files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files of a known language in scope, classified; sorted by path when collected (``path`` is unique)."""
    p = F.col("path")
    rows = all_files.where(walked(p) & in_scope(p, patterns)).withColumn("lang", X.script_language(p)).where("lang is not null")
    return rows.withColumn("is_test", X.test_file(p)).withColumn("generated", F.coalesce(X.generated_file(F.col("content")), F.lit(False))).withColumn("lines", X.line_count(F.col("content")))


def json_stream(texts: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Rows of concatenated JSON documents, decoded one after the other within each text; fails on the first bad one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                at = 0
                while t is not None:
                    while at < len(t) and t[at].isspace():
                        at += 1
                    if at == len(t):
                        break
                    doc, at = decoder.raw_decode(t, at)
                    out.append(json.dumps(doc))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["doc"])

    docs = texts.select(text).mapInArrow(run, "doc string")
    return docs.select(F.from_json("doc", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def target_variants(packages: DataFrame, base: str, variant: str) -> DataFrame:
    """One row a package: its in-package test variant where there is one, else itself; external test packages stay."""
    from strataloom.operators.sequences import newest

    rank = F.when(F.col(variant) == "test", 0).when(F.col(variant) == "", 1).otherwise(2)
    own = packages.where(F.col(variant) != "external")
    return newest(own, [base], [rank], 1).unionByName(packages.where(F.col(variant) == "external"))


#: What a package listing says of a package; further fields are passed over.
PACKAGE = "ImportPath string, Dir string, ForTest string, DepOnly boolean, Imports array<string>, TestImports array<string>, Error struct<Err: string>"


def packages(listing: DataFrame, text: str) -> DataFrame:
    """Packages of a listing, given as texts of concatenated JSON documents; the first package with an error fails the scan.

    (path, dir, variant, dependency, imports): variant is "test" for a package built with its own tests, "external" for
    tests of their own package, else "".
    """
    p = json_stream(listing, text, T._parse_datatype_string(PACKAGE))
    path = F.substring_index("ImportPath", " ", 1)
    variant = F.when(F.coalesce("ForTest", F.lit("")) == "", "").when(path.endswith("_test"), "external").otherwise("test")
    checked = F.when(F.col("Error.Err").isNotNull(), F.raise_error(F.concat(path, F.lit(": "), F.col("Error.Err")))).otherwise(path)
    imports = F.transform(F.coalesce("Imports", F.array().cast("array<string>")), lambda i: F.substring_index(i, " ", 1))
    return p.select(checked.alias("path"), F.col("Dir").alias("dir"), variant.alias("variant"), F.coalesce("DepOnly", F.lit(False)).alias("dependency"), imports.alias("imports"))


def with_dependencies(listed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(path, depth)``: the target packages (depth 0) and all they import, directly or not, as far as they are listed."""
    from strataloom.operators import graph

    edges = listed.select(F.col("path").alias("src"), F.explode("imports").alias("dst")).join(listed.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return graph.reachable(edges, targets.select(F.col("path").alias("v"))).withColumnRenamed("v", "path")


def git_index(raw: bytes) -> list[tuple[str, str, int]]:
    """(path, blob id, mode) of a Git index of version 2, 3 or 4 (public format: header DIRC, version, count; 62 bytes an
    entry, then the path: padded with NULs to a multiple of 8, or from version 4 on as the number of bytes to drop from the
    path before and what follows)."""
    if raw[:4] != b"DIRC":
        raise ValueError("no Git index")
    version, count = struct.unpack(">II", raw[4:12])
    if version not in (2, 3, 4):
        raise ValueError(f"Git index of version {version}")
    at, out, path = 12, [], b""
    for _ in range(count):
        mode = struct.unpack(">I", raw[at + 24 : at + 28])[0]
        blob, flags = raw[at + 40 : at + 60].hex(), struct.unpack(">H", raw[at + 60 : at + 62])[0]
        start = at + 62 + (2 if flags & 0x4000 else 0)
        if version == 4:
            drop = raw[start] & 0x7F
            while raw[start] & 0x80:
                start += 1
                drop = ((drop + 1) << 7) | (raw[start] & 0x7F)
            end = raw.index(b"\0", start + 1)
            path = path[: len(path) - drop] + raw[start + 1 : end]
            at = end + 1
        else:
            end = raw.index(b"\0", start)
            path = raw[start:end]
            at += (end - at + 8) // 8 * 8
        out.append((path.decode("utf-8", "surrogateescape"), blob, mode))
    return out


def index_table(indexes: DataFrame, content: str) -> DataFrame:
    """``(path, blob, mode)`` of Git indexes given as binary contents (``spark.read.format("binaryFile")``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e for raw in b.column(0).to_pylist() if raw is not None for e in git_index(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["path", "blob", "mode"])

    return indexes.select(content).mapInArrow(run, "path string, blob string, mode int")


def tracked_scripts(index: DataFrame, there: DataFrame, patterns: list[str]) -> DataFrame:
    """Script files in scope that the index tracks and that exist (there: with path and content), classified."""
    regular = index.where(F.col("mode").bitwiseAND(0o170000) == 0o100000).select("path").distinct()
    return scripts(there.join(regular, "path", "left_semi"), patterns)


def blob_id(content: Column) -> Column:
    """Git's name of a file's content."""
    body = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(body).cast("string")).cast("binary"), F.unhex(F.lit("00")), body))


def blob_id_of(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()
