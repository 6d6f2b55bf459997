"""Similarity of blocks by their vectors, within reach of each other in the directory tree.

Blocks whose directories are the same, parent and child, or siblings (tier 2 at most) share one of two keys: their own
directory or its parent. Pairs meet under such a key only, so the theta join on tiers becomes an equi-join; each key is
scanned as matrix products, a large one in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.paths import locality_tier
from strataloom.functions.text import directory
from strataloom.runtime import Scratch


@dataclass(frozen=True)
class Gates:
    """Least scores of a pair by tier 0, 1 and 2 (fixed values), for either channel; ``shift`` moves all of them."""

    source: tuple[float, float, float] = (0.970, 0.975, 0.980)
    description: tuple[float, float, float] = (0.950, 0.960, 0.958)
    source_test: float = 0.025
    source_cap: float = 0.999
    description_test: float = 0.015
    shift: float = 0.0

    def source_gate(self, tier: Column, test: Column) -> Column:
        g = F.when(tier == 0, self.source[0]).when(tier == 1, self.source[1]).otherwise(self.source[2]) + self.shift
        return F.when(test, F.least(g + self.source_test, F.lit(self.source_cap))).otherwise(g)

    def description_gate(self, tier: Column, both_tests: Column) -> Column:
        far = F.when(both_tests, self.description[1]).otherwise(self.description[2])
        g = F.when(tier == 0, self.description[0]).when(tier == 1, self.description[1]).otherwise(far) + self.shift
        return F.when(both_tests, g + self.description_test).otherwise(g)


def unit_vector(v: Column) -> Column:
    """The vector scaled to length 1 in double precision; null if it is empty, zero or not finite."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (n > 0)
    return F.when(fine, F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    """Dot product, at most 1; null lengths or dimensions that differ give null."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.least(s, F.lit(1.0)))


def packed(vectors: DataFrame, key: str, channel: str, order: list[str], vec: str, dims: int) -> DataFrame:
    """``(key, channel, m)``: all usable vectors of a key back to back, in order and scaled to length 1, as float64 bytes.

    Empty, zero and non-finite vectors and those of other lengths are left out. Scaling is done for a batch at once.
    """
    v = vectors.where(F.size(vec) == dims).select(key, channel, *order, F.col(vec).alias("_v"))
    listed = v.groupBy(key, channel).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_v"))), lambda e: e["_v"]).alias("_l"))

    def run(batches):
        for b in batches:
            lists = b.column("_l")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            x = lists.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, owner = x[ok], owner[ok]
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            ends = np.cumsum(np.bincount(owner, minlength=len(lists)))
            has = np.flatnonzero(np.diff(ends, prepend=0))
            raw = [x[s:e].tobytes() for s, e in zip(np.append(0, ends)[has], ends[has], strict=True)]
            at = pa.array(has)
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column(channel).take(at), pa.array(raw, pa.binary())], names=[key, channel, "m"])

    return listed.mapInArrow(run, listed.select(key, channel).schema.add("m", T.BinaryType()))


def _spans(counts: np.ndarray, most: int):
    """(first unit, end unit, first vector, end vector) of tiles over units: whole units up to ``most`` vectors together,
    longer ones in slices of their own."""
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        start = int(ends[i] - counts[i])
        j = max(int(np.searchsorted(ends, start + most, "right")), i + 1)
        for s in range(start, max(int(ends[j - 1]), start + 1), most):
            yield i, j, s, min(s + most, int(ends[j - 1]))
        i = j


def _best(rows: np.ndarray, n_rows: np.ndarray, cols: np.ndarray, n_cols: np.ndarray, tile: int = 8192) -> np.ndarray:
    """Greatest product between the vectors of every row unit and every column unit, at least 0; 0 without vectors.

    Products are made in tiles of at most ``tile`` vectors a side, whose maxima are combined.
    """
    out = np.zeros((len(n_rows), len(n_cols)))
    r, c = np.flatnonzero(n_rows), np.flatnonzero(n_cols)
    n_r, n_c = n_rows[r], n_cols[c]
    for i, j, s, e in _spans(n_r, max(tile // 8, 1)):
        for k, l, t, f in _spans(n_c, tile):
            # A tile holds whole units, or a slice of one.
            p = rows[s:e] @ cols[t:f].T
            p = np.maximum.reduceat(p, np.cumsum(n_c[k:l]) - n_c[k:l], axis=1) if l - k > 1 else p.max(axis=1, keepdims=True)
            p = np.maximum.reduceat(p, np.cumsum(n_r[i:j]) - n_r[i:j], axis=0) if j - i > 1 else p.max(axis=0, keepdims=True)
            at = np.ix_(r[i:j], c[k:l])
            out[at] = np.maximum(out[at], np.clip(p, 0.0, 1.0))
    return out


def _first_best(a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> tuple[int, int]:
    """The first pair, by row and then column, whose product (at most 1) is the greatest; made in slices of ``most`` products."""
    best, at = -np.inf, (0, 0)
    step = max(most // len(b), 1)
    for start in range(0, len(a), step):
        p = np.minimum(a[start : start + step] @ b.T, 1.0)
        k = int(p.argmax())
        if p.flat[k] > best:
            best, at = p.flat[k], (start + k // len(b), k % len(b))
    return at


def _scan(dims: int, source_floor: float, description_floor: float):
    """For applyInArrow over one cell of a key: pairs whose score reaches a floor in either channel."""

    def run(t: pa.Table) -> pa.Table:
        col = {n: np.array(t.column(n).to_pylist(), object) for n in ("id", "dir", "is_test", "changed", "source", "description", "key", "role")}

        def side(rows: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
            parts = [np.frombuffer(b, np.float64).reshape(-1, dims) if b else np.empty((0, dims)) for b in col[name][rows]]
            return np.concatenate(parts) if parts else np.empty((0, dims)), np.array([len(p) for p in parts], np.int64)

        role, out = col["role"].astype(np.int64), []
        b = np.flatnonzero(role & 2)
        sb, nb = side(b, "source")
        db, mb = side(b, "description")
        at_b = np.cumsum(nb) - nb
        every = np.flatnonzero(role & 1)
        for start in range(0, len(every), 64):
            a = every[start : start + 64]
            sa, na = side(a, "source")
            da, ma = side(a, "description")
            at_a = np.cumsum(na) - na
            best = _best(sa, na, sb, nb)
            desc = _best(da, ma, db, mb) * (col["is_test"][a][:, None] == col["is_test"][b][None, :])
            keep = (best >= source_floor) | (desc >= description_floor)
            keep &= (col["changed"][a][:, None] | col["changed"][b][None, :]).astype(bool)
            same = col["dir"][a][:, None] == col["dir"][b][None, :]
            keep &= ~(same & (col["dir"][a] != col["key"][a])[:, None])  # one key a pair: the shared directory itself
            keep &= np.where((role[a] == 3)[:, None], col["id"][b][None, :] > col["id"][a][:, None], True)
            for i, j in zip(*np.nonzero(keep), strict=True):
                lc = rc = 0
                if best[i, j] > 0:
                    lc, rc = _first_best(sa[at_a[i] : at_a[i] + na[i]], sb[at_b[j] : at_b[j] + nb[j]])
                x, y = col["id"][a[i]], col["id"][b[j]]
                if x > y:
                    x, y, lc, rc = y, x, rc, lc
                out.append((x, y, best[i, j], lc, rc, desc[i, j]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(("left", "right", "embedding", "left_chunk", "right_chunk", "description"), cols, kinds, strict=True)})

    return run


def similar_blocks(units: DataFrame, vectors: DataFrame, gates: Gates, dims: int = 64, digits: int = 6, part: int = 512, most_part: int = 8192) -> DataFrame:
    """Pairs of blocks within tier 2, of one language and repository, that pass the gate of either channel.

    units: (id, path, dir, lang, repo, is_test, changed), one row a block; pairs with neither side changed are left out.
    vectors: (id, channel, m) of ``packed`` with channels source and description. A score is the greatest over the
    vectors of either side; it starts at 0, and the first pair of pieces that reaches it is named. Scores are rounded
    before they are compared. Result: (left, right, tier, embedding, left_chunk, right_chunk, description).
    """
    scratch = Scratch(units.sparkSession, "blocks")
    kinds = vectors.groupBy("id").pivot("channel", ["source", "description"]).agg(F.first("m"))
    u = scratch.cut(units.join(kinds, "id").where("path is not null and dir is not null and lang is not null and repo is not null"), "units")
    keys = F.array_distinct(F.array(F.col("dir"), F.when(F.col("dir") == "", "").otherwise(directory(F.col("dir")))))
    held = F.coalesce(F.octet_length("source"), F.lit(0)) + F.coalesce(F.octet_length("description"), F.lit(0))
    rows = u.select("id", "dir", "repo", "lang", "is_test", "changed", held.alias("held"), F.explode(keys).alias("key"))
    # A cell holds ``part`` blocks a side; in very large directories more, as every block is sent to as many cells as there
    # are parts. Where blocks have many vectors, parts go by these.
    sizes = rows.groupBy("repo", "lang", "key").agg(F.count("*").alias("n"), (F.sum("held") / (8 * dims)).alias("held")).where("n > 1")
    share = F.least(F.greatest(F.col("n") / 16, F.lit(part)), F.lit(most_part))
    parts = F.greatest(F.ceil(F.col("n") / share), F.ceil(F.col("held") / (32 * share)))
    sizes = sizes.select("repo", "lang", "key", F.least(parts, "n").cast("int").alias("parts"))
    slack = 10.0**-digits  # rounding comes after
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), F.when(own == o, 3).when(own < o, 1).otherwise(2).alias("role"))))
    cells = rows.drop("held").join(sizes, ["repo", "lang", "key"]).select("repo", "lang", "key", "id", "dir", "is_test", "changed", cell.alias("c")).select("*", "c.x", "c.y", "c.role").drop("c")
    rows = cells.join(u.select("id", "source", "description").hint("shuffle_hash"), "id")  # vectors are copied here only
    found = rows.groupBy("repo", "lang", "key", "x", "y").applyInArrow(_scan(dims, min(gates.source) + gates.shift - slack, min(gates.description) + gates.shift - slack), "left string, right string, embedding double, left_chunk int, right_chunk int, description double")
    side = lambda s: u.select(F.col("id").alias(s), F.struct("path", "dir", "is_test").alias(f"_{s}"))
    both = found.join(side("left"), "left").join(side("right"), "right")
    l, r = F.col("_left"), F.col("_right")
    both = both.withColumn("tier", locality_tier(l["path"], r["path"], l["dir"], r["dir"])).withColumn("embedding", F.round("embedding", digits)).withColumn("description", F.round("description", digits))
    passes = (F.col("embedding") >= gates.source_gate(F.col("tier"), l["is_test"] | r["is_test"])) | (F.col("description") >= gates.description_gate(F.col("tier"), l["is_test"] & r["is_test"]))
    return both.where((F.col("tier") <= 2) & passes).select("left", "right", "tier", "embedding", "left_chunk", "right_chunk", "description")


def near_changes(units: DataFrame) -> DataFrame:
    """Units within tier 2 of a changed one: the only ones that need vectors. A semi-join on the two keys of a unit."""
    keys = F.array_distinct(F.array(F.col("dir"), F.when(F.col("dir") == "", "").otherwise(directory(F.col("dir")))))
    around = units.where("changed").select("repo", "lang", F.explode(keys).alias("key")).distinct()
    hit = units.select("id", "repo", "lang", F.explode(keys).alias("key")).join(around, ["repo", "lang", "key"], "left_semi").select("id").distinct()
    return units.join(hit, "id", "left_semi")
