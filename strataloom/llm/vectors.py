"""Most similar vectors: balanced posting lists, centroids in memory, distance-ratio pruning, several indexes in turn.

An index is a set of posting lists, one for each centroid. A vector is put into the list of its nearest centroid and,
near a boundary, into further lists whose centroids are almost as near. A search reads only the lists whose centroid is
within a ratio of the nearest one's distance, or no farther beyond it than neighbours may be. Up to ``exact`` centroids
are all compared; a walk over a graph of them comes in beyond that. Centroids are fitted on a bounded sample; every
vector is indexed and every vector is searched for. Where the bounded number of lists leaves some of them long, these are
split into lists of their own, with centroids fitted where they are, so that the length of lists does not grow with the
number of vectors.

The more lists, the more neighbours a boundary parts. So there are several indexes, on samples of their own, built and
read one after the other, and more of them the more lists there are (``turns``): what the boundaries of one part, those
of another do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.runtime import Scratch, release


@dataclass(frozen=True)
class Settings:
    """All bounds of the index.

    per_list: vectors aimed at for a list; lists: most centroids of a group (bounds what is shipped to executors);
    sample: vectors for each centroid in the fit, and sample_most altogether; replicas and replica_ratio: most lists a
    vector is put into, and how much farther than the nearest centroid they may be; probes and probe_ratio: the same
    for reading, in one index; exact: centroids up to which all are compared; beam and degree: width of the graph walk
    beyond that and links of a centroid; block: members of a list, and queries against it, that one task holds (a longer
    list is cut into blocks, all of which are read); split: rows from which on a list is split into lists of its own, of
    about a quarter of that.
    """

    per_list: int = 400
    lists: int = 8192
    sample: int = 12
    sample_most: int = 60_000
    replicas: int = 4
    replica_ratio: float = 1.15
    probes: int = 4
    probe_ratio: float = 1.25
    exact: int = 16_384
    beam: int = 16
    degree: int = 24
    block: int = 4096
    split: int = 16_384


def turns(lists: int, split: int = 0) -> int:
    """Number of indexes for so many lists; one more if most are split from longer ones, which part more neighbours.

    Of pairs at cosine 0.85 between isotropic vectors, four lists of one index miss 6 % with 222 lists, 17 % with 2,048
    and 25 % with 8,192; so many indexes together miss about 1 in 1,000, of pairs at 0.9 about 1 in 10,000.
    """
    return max(2, math.ceil(math.log2(max(2, lists)) / 2.75)) + (2 * split > lists)


def apart(floor: float) -> float:
    """Distance of two unit vectors at cosine ``floor``."""
    return math.sqrt(max(0.0, 2 - 2 * floor))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means with balancing: in every round, centroids of the emptiest lists move into lists over twice the
    average."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for r in range(rounds):
        nearest = np.empty(len(sample), np.int64)
        for i in range(0, len(sample), 4096):
            nearest[i : i + 4096] = (sample[i : i + 4096] @ c.T).argmax(axis=1)
        sums = np.zeros((k, sample.shape[1]), np.float64)
        np.add.at(sums, nearest, sample)
        count = np.bincount(nearest, minlength=k)
        norm = np.linalg.norm(sums, axis=1)
        ok = (count > 0) & (norm > 1e-12)
        c[ok] = (sums[ok] / norm[ok, None]).astype(np.float32)
        if r < rounds - 1:
            by_size = np.argsort(count, kind="stable")
            full = [j for j in by_size[::-1] if count[j] > 2 * len(sample) / k][: k // 4]
            for poor, rich in zip(by_size, full, strict=False):
                c[poor] = sample[rng.choice(np.flatnonzero(nearest == rich))]
    return c


class Centroids:
    """Centroids, all of which are compared with every query."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``beam`` best centroids for each query, best first."""
        n, k = len(q), len(self.centroids)
        m = min(beam, k)
        s = q @ self.centroids.T
        at = np.broadcast_to(np.arange(k), (n, k))
        wide = k // 64
        if wide > 2 * m:  # the best m lie in the m strides with the best maxima
            whole = s[:, : 64 * wide].reshape(n, 64, wide)
            best = np.argpartition(-whole.max(axis=1), m - 1, axis=1)[:, :m]
            at = (best[:, None, :] + (wide * np.arange(64))[None, :, None]).reshape(n, -1)
            at = np.concatenate([at, np.broadcast_to(np.arange(64 * wide, k), (n, k - 64 * wide))], axis=1)
            s = np.take_along_axis(s, at, 1)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sims = np.take_along_axis(s, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(np.take_along_axis(at, top, 1), order, 1).astype(np.int32), np.take_along_axis(sims, order, 1)


class CentroidGraph(Centroids):
    """Neighbour graph over centroids, walked by best-first search for many queries at once.

    Approximate: with 16 places and 24 links, of 8,192 centroids of isotropic vectors it finds the nearest for 47 % only.
    """

    def __init__(self, centroids: np.ndarray, degree: int, seed: int = 11):
        super().__init__(centroids)
        k = len(centroids)
        rng = np.random.default_rng(seed)
        near, far = max(1, degree * 3 // 4), max(1, degree // 4)
        links = np.empty((k, min(near, max(1, k - 1)) + far), np.int32)
        for i in range(0, k, 2048):
            s = centroids[i : i + 2048] @ centroids.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            n = links.shape[1] - far
            links[i : i + 2048, :n] = np.argpartition(-s, min(n, k - 1) - (n == k), axis=1)[:, :n]
        links[:, -far:] = rng.integers(0, k, (k, far))  # long links keep the graph connected
        self.links = links
        self.entries = rng.choice(k, min(k, 32), replace=False)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``beam`` best centroids found for each query, best first; -1 where there are fewer."""
        n, k = len(q), len(self.centroids)
        beam = min(beam, k)
        s0 = q @ self.centroids[self.entries].T
        m = min(beam, s0.shape[1])
        top = np.argsort(-s0, axis=1)[:, :m]
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -3, np.float32)
        ids[:, :m], sims[:, :m] = self.entries[top], np.take_along_axis(s0, top, 1)
        done = ids < 0
        live = np.arange(n)
        for _ in range(4 * beam):
            open_ = np.where(done[live], np.float32(-4), sims[live])
            best = open_.argmax(axis=1)
            more = open_[np.arange(len(live)), best] > -4
            live, best = live[more], best[more]
            if not len(live):
                break
            done[live, best] = True
            new = self.links[ids[live, best]]
            s = np.einsum("bd,bkd->bk", q[live], self.centroids[new], optimize=False)
            new_sorted = np.sort(new, axis=1)
            known = (new[:, :, None] == ids[live][:, None, :]).any(axis=2)
            if (new_sorted[:, 1:] == new_sorted[:, :-1]).any():
                order = np.argsort(new, axis=1, kind="stable")
                twice = np.zeros_like(known)
                np.put_along_axis(twice, order[:, 1:], new_sorted[:, 1:] == new_sorted[:, :-1], 1)
                known |= twice
            s[known] = -3
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], np.where(known, -1, new)], axis=1)
            all_d = np.concatenate([done[live], known], axis=1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_s, all_i, all_d))
            done[live] |= ids[live] < 0
        return ids, sims


def _floats(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def usable(df: DataFrame, key: str, group: str, vec: str, dims: int) -> DataFrame:
    """``(id, g, v)`` with v the bytes of ``dims`` float32: vectors of the right length, finite, not all zero."""
    rows = df.where(F.col(key).isNotNull() & F.col(group).isNotNull() & (F.size(vec) == dims)).select(
        F.col(key).cast("bigint").alias("id"), F.col(group).cast("string").alias("g"), F.col(vec).cast("array<float>").alias("x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dims) + np.float32(0)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            take = pa.array(np.flatnonzero(ok))
            raw = pa.array([r.tobytes() for r in x[ok]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("g").take(take), raw], names=["id", "g", "v"])

    once = rows.mapInArrow(run, "id bigint, g string, v binary").groupBy("id").agg(F.max(F.struct("g", "v")).alias("r"))
    return once.select("id", "r.g", "r.v")


def equal_classes(rows: DataFrame, k: int) -> DataFrame:
    """``(cid, g, v, ids)``: one row a distinct vector of a group, with its k + 2 smallest ids (or all it has).

    Equal vectors are equally similar to anything, and the smaller ids come first, so only these can be among the k most
    similar of another vector. However many copies a vector has, no task gathers more than k + 2 of each.
    """
    w = W.partitionBy("g", "v").orderBy("id")
    first = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 2)
    return first.groupBy("g", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "g", "v", "ids")


def fit_index(classes: DataFrame, dims: int, s: Settings, turn: int = 0) -> dict[str, tuple[int, Centroids]]:
    """group -> (number of its first list, centroids). The sample is at most ``sample_most`` vectors over all groups, and
    another one for every turn."""
    sizes = {r["g"]: r["count"] for r in classes.groupBy("g").count().limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 groups of vectors")
    total, first, out = sum(sizes.values()), 0, {}
    lists = {g: max(1, min(s.lists, -(-n // s.per_list), s.sample_most * n // total // 4 or 1)) for g, n in sizes.items()}
    want = {g: min(sizes[g], lists[g] * s.sample, s.sample_most * sizes[g] // total + 1) for g in sizes}
    million = 1_000_000
    chance = F.coalesce(*[F.when(F.col("g") == g, F.lit(int(million * min(1.0, 1.1 * want[g] / sizes[g])) + 1)) for g in sizes]) if sizes else F.lit(0)
    got: dict[str, list] = {g: [] for g in sizes}
    for r in classes.where(F.pmod(F.xxhash64(F.lit(f"fit{turn}"), "cid"), F.lit(million)) < chance).select("g", "v").limit(2 * s.sample_most).toLocalIterator():
        got[r["g"]].append(bytes(r["v"]))
    for g in sorted(got):
        x = unit(np.frombuffer(b"".join(sorted(got[g])), np.float32).reshape(-1, dims)) if got[g] else np.eye(1, dims, dtype=np.float32)
        k = min(lists[g], len(x))
        c = fit_centroids(x, k, seed=7 + turn)
        out[g] = (first, CentroidGraph(c, s.degree) if k > s.exact else Centroids(c))
        first += k
    return out


def probe(classes: DataFrame, index: dict[str, tuple[int, Centroids]], dims: int, s: Settings, floor: float = 0.85) -> DataFrame:
    """``(list, cid, member, d)``: the lists each vector reads, whether it is also put into them, and how far off they are."""
    slack = apart(floor)
    shared = classes.sparkSession.sparkContext.broadcast(index)  # at most ``lists`` centroids a group, see Settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            groups = np.array(b.column("g").to_pylist(), object)
            for g in set(groups.tolist()):
                rows = np.flatnonzero(groups == g)
                first, graph = ix[g]
                for i in range(0, len(rows), 1024):
                    part = b.take(pa.array(rows[i : i + 1024]))
                    ids, sims = graph.search(unit(_floats(part.column("v"), dims)), max(s.beam, s.probes) if isinstance(graph, CentroidGraph) else s.probes)
                    d = np.sqrt(np.maximum(0, 2 - 2 * sims))
                    read = (d <= np.maximum(d[:, :1] * s.probe_ratio + 1e-6, d[:, :1] + slack)) & (ids >= 0)
                    read[:, s.probes :] = False
                    put = (d <= np.maximum(d[:, :1] * s.replica_ratio + 1e-6, d[:, :1] + slack)) & read
                    put[:, s.replicas :] = False
                    r, c = np.nonzero(read)
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first + ids[r, c].astype(np.int64)), part.column("cid").take(at), pa.array(put[r, c]), pa.array(d[r, c].astype(np.float32))], names=["list", "cid", "member", "d"]
                    )

    return classes.select("cid", "g", "v").mapInArrow(run, "list bigint, cid bigint, member boolean, d float")


def _fit_list(dims: int, s: Settings):
    """For applyInArrow over the sample of one long list: its own centroids."""

    def run(t: pa.Table) -> pa.Table:
        cid = t.column("cid").to_numpy()
        x = unit(_floats(t.column("v"), dims))[np.argsort(cid, kind="stable")]
        k = max(1, min(int(t.column("k")[0].as_py()), len(x)))
        c = fit_centroids(x, k)
        return pa.table({"list": pa.array([t.column("list")[0].as_py()] * k, pa.int64()), "sub": pa.array(range(k), pa.int32()), "centre": pa.array([r.tobytes() for r in c], pa.binary())})

    return run


def _assign_list(dims: int, s: Settings, round_: int, slack: float):
    """For a cogroup of some rows of a long list with its centroids: (list, cid, d) of the lists it is split into."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if len(rows) and len(centres):
            sub, c = centres.column("sub").to_numpy(), _floats(centres.column("centre"), dims)
            cid = rows.column("cid").to_numpy()
            owner = abs(int(rows.column("list")[0].as_py())) + 1
            x = unit(_floats(rows.column("v"), dims))
            m = min(s.probes, len(c))
            for i in range(0, len(x), 1024):
                sims = x[i : i + 1024] @ c.T
                near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                d = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1))).astype(np.float32)
                least = d.min(axis=1, keepdims=True)
                r, k = np.nonzero(d <= np.maximum(least * s.probe_ratio + 1e-6, least + slack))
                # Lists of later rounds are numbered below zero: by the list they come from, their place in it, the round.
                out[0].append(-((owner * s.lists + sub[near[r, k]].astype(np.int64)) * 4 + round_))
                out[1].append(cid[i + r])
                out[2].append(d[r, k])
        kinds = (pa.int64(), pa.int64(), pa.float32())
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for n, v, t in zip(("list", "cid", "d"), out, kinds, strict=True)})

    return run


def split_lists(probes: DataFrame, classes: DataFrame, scratch: Scratch, dims: int, s: Settings, floor: float = 0.85) -> DataFrame:
    """The probes, with every list of more than ``split`` rows replaced by lists of about ``split / 4`` members: shorter
    ones would part more neighbours.

    Centroids of a long list are fitted in one task on a bounded sample of its members; its rows are assigned to them in
    parts of bounded size, wherever they are. A vector then keeps the nearest of all its lists, old and new, under the
    same ratios and numbers as in a flat index. What is still long after two rounds (equal distances everywhere, say) is
    read in blocks.
    """
    parts, slack = s.split // 2, apart(floor)
    for round_ in (1, 2):
        sizes = probes.groupBy("list").agg(F.count("*").alias("n"), F.count_if("member").alias("m")).where(F.col("n") > s.split)
        k = F.least(F.lit(max(2, min(s.lists, s.sample_most // s.sample))), F.ceil(F.col("m") / max(s.per_list, s.split // 4))).cast("int")
        long = scratch.cut(sizes.select("list", "n", F.greatest(k, F.lit(2)).alias("k"), "m"), "long")
        if long.isEmpty():
            return probes
        inside = scratch.cut(probes.join(long, "list").join(classes.select("cid", "v"), "cid"), "inside")
        chance = F.least(F.lit(1.0), F.col("k") * s.sample * 1.1 / F.greatest("m", F.lit(1)))
        sample = inside.where(F.col("member") & (F.pmod(F.xxhash64(F.lit("split"), "cid"), F.lit(1_000_000)) < chance * 1_000_000 + 1))
        centres = scratch.cut(sample.select("list", "cid", "v", "k").groupBy("list").applyInArrow(_fit_list(dims, s), "list bigint, sub int, centre binary"), "centres")
        salts = F.ceil(F.col("n") / parts).cast("int")
        salted = inside.select("list", F.pmod(F.xxhash64(F.lit("salt"), "cid"), salts).cast("int").alias("salt"), "cid", "v")
        spread = centres.join(long.select("list", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "list").select("list", "salt", "sub", "centre")
        new = salted.groupBy("list", "salt").cogroup(spread.groupBy("list", "salt")).applyInArrow(_assign_list(dims, s, round_, slack), "list bigint, cid bigint, d float")
        kept = probes.join(long.select("list"), "list", "left_anti").select("list", "cid", "d")
        w = W.partitionBy("cid").orderBy("d", "list")
        ranked = kept.unionByName(new).withColumn("_r", F.row_number().over(w)).withColumn("_d", F.min("d").over(W.partitionBy("cid"))).where(F.col("_r") <= s.probes)
        put = (F.col("d") <= F.greatest(F.col("_d") * s.replica_ratio + 1e-6, F.col("_d") + slack)) & (F.col("_r") <= s.replicas)
        near = ranked.where(F.col("d") <= F.greatest(F.col("_d") * s.probe_ratio + 1e-6, F.col("_d") + slack))
        probes = scratch.cut(near.select("list", "cid", put.alias("member"), "d"), "probes")
    return probes


def blocks_of(probes: DataFrame, block: int) -> DataFrame:
    """``(list, mb, qb, role, cid)``: lists as blocks of members and of queries; role 1 asks, 2 is a member, 3 both.

    A list within ``block`` rows is one block. A longer one is cut by a hash into n parts of either kind and every part
    of the queries meets every part of the members: nothing of a hot list is left out, and no task holds all of it.
    """
    sizes = probes.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    sized = probes.join(sizes, "list")
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    one = sized.where("parts = 1").select("list", F.lit(0).alias("mb"), F.lit(0).alias("qb"), F.when(F.col("member"), 3).otherwise(1).alias("role"), "cid")
    many = sized.where("parts > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asks = many.select("list", every.alias("mb"), own.alias("qb"), F.lit(1).alias("role"), "cid")
    members = many.where("member").select("list", own.alias("mb"), every.alias("qb"), F.lit(2).alias("role"), "cid")
    return one.unionByName(asks).unionByName(members)


def _pairs_once(x: np.ndarray, floor: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (a, b), a < b, of rows with cosine of about ``floor`` at least; None if there are more than ``most``."""
    xt, a, b, n = x.T.copy(), [], [], 0
    for i in range(0, len(x), 512):
        r, c = np.divmod(np.flatnonzero(x[i : i + 512] @ xt[:, i:] >= floor - 1e-5), len(x) - i)
        later = c > r
        a.append(i + r[later])
        b.append(i + c[later])
        n += len(a[-1])
        if n > most:
            return None
    return np.concatenate(a), np.concatenate(b)


def scan_block(dims: int, k: int, floor: float):
    """For applyInArrow over one block: the k most similar members of every query (or more), with cosine of at least floor."""

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        cid = t.column("cid").to_numpy()
        raw = _floats(t.column("v"), dims)
        x = unit(raw)
        m, q = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        both = _pairs_once(x, floor, k * len(x) // 2) if len(x) and (role == 3).all() else None
        a, b = ([z] for z in both) if both else ([], [])
        if len(m) and not both:
            m = m[np.argsort(cid[m], kind="stable")]
            xm = x[m].T.copy()
            for i in range(0, len(q), 512):
                qi = q[i : i + 512]
                s = x[qi] @ xm
                hit = s >= floor - 1e-5
                many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k + 1)
                if len(many):  # everything as good as the k-th beside itself in single precision stays for the exact look
                    bar = np.partition(s[many], len(m) - k - 1, axis=1)[:, len(m) - k - 1]
                    hit[many] &= s[many] >= (bar - 1e-5)[:, None]
                r, c = np.divmod(np.flatnonzero(hit), len(m))
                other = cid[qi[r]] != cid[m[c]]
                a.append(qi[r[other]])
                b.append(m[c[other]])
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (a, b))
        p, o = raw[a].astype(np.float64), raw[b].astype(np.float64)
        sim = (p * o).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (o * o).sum(axis=1)) if len(a) else np.empty(0)
        if both:
            a, b, sim = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim])
        ok = sim >= floor
        return pa.table({"q": pa.array(cid[a[ok]], pa.int64()), "c": pa.array(cid[b[ok]], pa.int64()), "sim": pa.array(np.minimum(sim[ok], 1.0), pa.float64())})

    return run


def search_index(classes: DataFrame, near: DataFrame | None, into: Scratch, turn: int, dims: int, k: int, floor: float, s: Settings) -> tuple[DataFrame, int]:
    """What ``near`` holds and one more index finds, the k best for each, written to ``into``; and, of the first index, how
    many its lists ask for."""
    scratch = Scratch(classes.sparkSession, "index")
    flat = scratch.cut(probe(classes, fit_index(classes, dims, s, turn), dims, s, floor), "probes")
    probes = split_lists(flat, classes, scratch, dims, s, floor)
    numbers = probes.select("list").distinct().agg(F.count("*"), F.count_if(F.col("list") < 0))
    wanted = turns(*numbers.first()) if near is None else 0
    cells = blocks_of(probes, s.block).join(classes.select("cid", "v").hint("shuffle_hash"), "cid")  # vectors are copied here only
    found = cells.groupBy("list", "mb", "qb").applyInArrow(scan_block(dims, k, floor), "q bigint, c bigint, sim double")
    every = found if near is None else found.unionByName(near)
    best = every.groupBy("q", "c").agg(F.max("sim").alias("sim"))  # the same pair from several lists
    w = W.partitionBy("q").orderBy(F.col("sim").desc(), "c")
    out = into.cut(best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "c", "sim"), "near")
    scratch.clear()
    return out, wanted


def nearest_classes(classes: DataFrame, scratch: Scratch, dims: int, k: int, floor: float, s: Settings) -> DataFrame:
    """``(q, c, sim)``: for every distinct vector the k most similar other ones found, with cosine of at least floor.

    One index after the other, so that disk holds the copies of vectors of one of them only.
    """
    spark, near, turn, wanted = classes.sparkSession, None, 0, 1
    while turn < wanted:
        release(spark)
        last = near
        near, asked = search_index(classes, last, scratch, turn, dims, k, floor, s)
        scratch.drop(last)
        wanted, turn = max(wanted, asked), turn + 1
    return near


def similar_pairs(df: DataFrame, key: str, group: str, vec: str, k: int = 5, floor: float = 0.85, dims: int = 64, settings: Settings | None = None) -> DataFrame:
    """``(vec_a, vec_b, cosine)``, vec_a < vec_b: pairs of one group with cosine of at least ``floor`` where one is among
    the ``k`` most similar of the other; equal cosine goes to the smaller id.

    Vectors that are null, of another length, not finite or all zero take no part, nor do null keys or groups; repeated
    keys count once; other columns are ignored. Equal vectors under different keys are one class in the index and come
    back as all the pairs asked for, at most k for each of them. Approximate across classes: see ``turns``. There may
    be at most 1,000 groups (each has an index); more are an error.
    """
    scratch = Scratch(df.sparkSession, "vectors")
    s = settings or Settings()
    rows = scratch.cut(usable(df, key, group, vec, dims), "rows")
    classes = scratch.cut(equal_classes(rows, k), "classes")
    near = nearest_classes(classes, scratch, dims, k, floor, s)
    ids = classes.select("cid", "ids")
    other = near.join(ids.withColumnRenamed("cid", "c"), "c").select("q", "sim", F.explode("ids").alias("b"))
    own = ids.where(F.size("ids") > 1).select(F.col("cid").alias("q"), F.lit(1.0).alias("sim"), F.explode("ids").alias("b"))
    seen = other.unionByName(own)
    asks = ids.select(F.col("cid").alias("q"), F.explode("ids").alias("a"))
    w = W.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    top = asks.join(seen, "q").where("a <> b").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "sim")
    # Copies beyond the ids of their class: their k most similar are the k smallest ids of the class itself.
    crowded = classes.where(F.size("ids") == k + 2).select(F.col("g").alias("g1"), F.col("v").alias("v1"), "ids")
    rest = rows.join(crowded, (F.col("g") == F.col("g1")) & (F.col("v") == F.col("v1"))).where(F.col("id") > F.element_at("ids", -1))
    rest = rest.select(F.col("id").alias("a"), F.explode(F.slice("ids", 1, k)).alias("b"), F.lit(1.0).alias("sim"))
    return top.unionByName(rest).groupBy(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).agg(F.max("sim").alias("cosine"))


def brute_force(rows: DataFrame, queries: DataFrame, dims: int, k: int, floor: float, block: int = 65_536) -> DataFrame:
    """``(q, c, sim)``: the exact k most similar rows of each query's group, with cosine of at least floor.

    rows and queries: (id, g, v) of ``usable``. The queries go through in blocks of ``block`` (16 MB at 64 dimensions,
    whatever their number), each of which meets all rows where they are; a task returns its own k best a query.
    """
    spark, out = rows.sparkSession, None
    n = queries.count()
    parts = max(1, -(-n // (block // 2)))  # half filled on average, so that no part of the hash exceeds a block
    for p in range(parts):
        some = queries.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(parts)) == p).orderBy("id").limit(block + 1).collect()
        if len(some) > block:
            raise RuntimeError("a block of queries is too large")
        if not some:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in some]), np.array([r["g"] for r in some], object), np.stack([np.frombuffer(r["v"], np.float32) for r in some])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, groups, raw = shared.value
            x = unit(raw)
            for b in batches:
                mine, own, v = b.column("id").to_numpy(), np.array(b.column("g").to_pylist(), object), _floats(b.column("v"), dims)
                y = unit(v) if len(v) else v
                for g in set(own.tolist()) & set(groups.tolist()):
                    m, q = np.flatnonzero(own == g), np.flatnonzero(groups == g)
                    for i in range(0, len(q), 512):
                        qi = q[i : i + 512]
                        r, c = np.nonzero(x[qi] @ y[m].T >= floor - 1e-5)
                        a, o = raw[qi[r]].astype(np.float64), v[m[c]].astype(np.float64)
                        sim = (a * o).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (o * o).sum(axis=1))
                        ok = (sim >= floor) & (ids[qi[r]] != mine[m[c]])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[qi[r]][ok]), pa.array(mine[m[c]][ok]), pa.array(np.minimum(sim[ok], 1.0))], names=["q", "c", "sim"])

        found = rows.mapInArrow(run, "q bigint, c bigint, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "q bigint, c bigint, sim double")
    w = W.partitionBy("q").orderBy(F.col("sim").desc(), "c")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "c", "sim")


def recall(df: DataFrame, pairs: DataFrame, key: str, group: str, vec: str, every: int = 20, k: int = 5, floor: float = 0.85, dims: int = 64) -> DataFrame:
    """One row (queries, neighbours, found, recall): what ``similar_pairs`` finds of the exact neighbours of the queries,
    the rows whose id is divisible by ``every``, among all rows."""
    scratch = Scratch(df.sparkSession, "recall")
    rows = scratch.cut(usable(df, key, group, vec, dims), "rows")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    true = brute_force(rows, queries, dims, k, floor).select(F.least("q", "c").alias("vec_a"), F.greatest("q", "c").alias("vec_b")).distinct()
    hit = true.join(pairs.select("vec_a", "vec_b", F.lit(True).alias("hit")), ["vec_a", "vec_b"], "left")
    n = hit.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    return queries.agg(F.count("*").alias("queries")).join(F.broadcast(n)).withColumn("recall", F.when(F.col("neighbours") > 0, F.col("found") / F.col("neighbours")).otherwise(1.0))
