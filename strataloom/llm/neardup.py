"""Near-duplicate texts by binary trie self-joins over minhash sketches.

Every distinct text becomes ``TABLES`` bit strings: a key of ``ROWS`` whole minhash values, then a sketch with one bit of
each of ``BITS`` minhash values. Each table is a binary trie over its strings. The self-join walks pairs of nodes from
the root down, adds up the bits in which they differ and drops a pair of subtrees once the sum exceeds the error budget:
none in the key, ``BUDGET`` in the sketch. Two texts of similarity s agree in a key with probability s**ROWS and differ
in a sketch bit with (1 - s) / 2, so at s = 0.6 a pair is missed by all tables in about 1 of 500 cases, at 0.7 in 1 of
50,000. What the tries give is checked exactly on the whole texts.

One trie over the sketches alone would do for few errors only: its upper levels are full, so with n texts the walk visits
about n**2 times the share of random strings of log2(n) bits that are within the budget, which at 33 errors is nearly all
pairs. The keys are what makes the upper levels sparse; hence several tries, as a pair must agree in the key of one.

The key bits are walked by Spark: equal keys meet in one partition. The rest of each trie is walked by numpy, a byte (8
levels) at a time, for many tries at once, on the strings in sorted order, in which a node is a range. A pair of nodes is
dropped at the first byte at which the sum exceeds the budget.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.runtime import BROADCAST_ROWS, Scratch

WIDTH, TABLES, ROWS, BITS, BUDGET = 5, 26, 3, 96, 33
#: Texts under one key that a task holds; keys with more are cut into parts, all pairs of which are joined. Hot keys are
#: looked for in one of ``SAMPLE`` texts, which only decides where they are joined, never whether.
PART, SAMPLE = 20_000, 64
#: Node pairs expanded at once.
SLICE = 1 << 20

#: A longest run of ASCII letters, digits and underscores, or any other single character but space, tab, CR and LF.
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^ \t\r\n]")

_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(0, 1 << 63, (TABLES, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int16)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Distinct 5-token sequences of texts as 64-bit hashes; token hashes are kept between calls, up to a bound."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets): the sorted distinct hashes of text i are hashes[offsets[i]:offsets[i + 1]]."""
        if len(self.known) > self.most:
            self.known.clear()
        known, find, flat, sizes = self.known, TOKEN.findall, [], []
        for t in texts:
            found = find(t)
            sizes.append(len(found))
            flat += found
        for t in set(flat).difference(known):
            known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        tokens = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        sizes = np.array(sizes, np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        n = max(0, len(tokens) - WIDTH + 1)
        h = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            h = h * np.uint64(0x100000001B3) + tokens[j : j + n] * ORDER[j]
        inside = text[:n] == text[WIDTH - 1 :] if n else np.zeros(0, bool)
        h, text = _finish(h[inside]), text[:n][inside]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        return h, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys uint64[n, TABLES], sketches uint8[n, BITS / 8]) of non-empty sets given back to back."""
    n = len(offsets) - 1
    mins = np.empty((BITS, n), np.uint64)
    for i, m in enumerate(MULTIPLIERS):
        np.minimum.reduceat(hashes * m, offsets[:-1], out=mins[i])
    bits = _finish(mins) >> np.uint64(40) & np.uint64(1)
    sketches = np.packbits(bits.astype(np.uint8).T, axis=1)
    picked = mins[: TABLES * ROWS].reshape(TABLES, ROWS, n)
    keys = _finish((picked * MIX[:, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64)[:, None])
    return keys.T, sketches


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, version, body) -> (id, version, class, keys, sketch); without text, null; without sequences, class only."""
    shingle = Shingler()
    for whole in batches:
        texts_all = whole.column("body").to_pylist()
        start = 0
        while start < len(texts_all):  # a few megabytes of text at a time
            stop, size = start, 0
            while stop < len(texts_all) and (size < 4_000_000 or stop == start):
                size += len(texts_all[stop] or "")
                stop += 1
            texts = texts_all[start:stop]
            b = whole.slice(start, stop - start)
            start = stop
            h, at = shingle([t or "" for t in texts])
            has = np.flatnonzero(at[1:] > at[:-1])
            keys: list = [None] * len(texts)
            sketch: list = [None] * len(texts)
            cls: list = [None] * len(texts)
            if len(has):
                k, s = signatures(h, np.append(at[has], at[-1]))
                for j, i in enumerate(has.tolist()):
                    keys[i], sketch[i] = k[j].tobytes(), s[j].tobytes()
                    cls[i] = xxhash.xxh3_128_digest(h[at[i] : at[i + 1]].tobytes())
            for i, t in enumerate(texts):
                if t and cls[i] is None:
                    cls[i] = b"=" + xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("version"), pa.array(cls, pa.binary()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())],
                names=["id", "version", "class", "keys", "sketch"],
            )


def _pairs_within(lo: np.ndarray, size: np.ndarray, lo2: np.ndarray, size2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, i, j): the product of ranges lo..lo+size and lo2..lo2+size2, for each entry."""
    n = size * size2
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    width = size2[which]
    return which, lo[which] + k // width, lo2[which] + k % width


class Tries:
    """Tries over strings (key, sketch), sorted. ``join`` yields all pairs of rows under one key within the budget."""

    def __init__(self, key: np.ndarray, sketch: np.ndarray):
        self.sketch, self.depth = sketch, sketch.shape[1]
        change = np.ones(len(key), bool)
        change[1:] = key[1:] != key[:-1]
        #: starts[l]: first rows of the nodes at level l; node_of[l]: node of each row.
        self.starts, self.node_of = [np.flatnonzero(change)], [np.cumsum(change) - 1]
        for level in range(self.depth):
            change = change.copy()
            change[1:] |= sketch[1:, level] != sketch[:-1, level]
            self.starts.append(np.flatnonzero(change))
            self.node_of.append(np.cumsum(change) - 1)
        self.ends = [np.append(s[1:], len(key)) for s in self.starts]

    def join(self, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        roots = np.flatnonzero(self.ends[0] - self.starts[0] > 1)
        stack = [(0, roots, roots, np.zeros(len(roots), np.int16))]
        while stack:
            level, a, b, spent = stack.pop()
            if not len(a):
                continue
            if level == self.depth:  # equal strings on either side: all rows of both nodes
                sa, sb = self.starts[level], self.starts[level]
                w, i, j = _pairs_within(sa[a], self.ends[level][a] - sa[a], sb[b], self.ends[level][b] - sb[b])
                keep = (a[w] != b[w]) | (i < j)
                yield i[keep], j[keep]
                continue
            nxt = self.node_of[level + 1]
            first_a, first_b = nxt[self.starts[level][a]], nxt[self.starts[level][b]]
            na = nxt[self.ends[level][a] - 1] - first_a + 1
            nb = nxt[self.ends[level][b] - 1] - first_b + 1
            work = np.cumsum(na * nb)
            if work[-1] > SLICE and len(a) > 1:
                cut = max(1, int(np.searchsorted(work, work[-1] // 2)))
                stack.append((level, a[cut:], b[cut:], spent[cut:]))
                stack.append((level, a[:cut], b[:cut], spent[:cut]))
                continue
            w, ca, cb = _pairs_within(first_a, na, first_b, nb)
            once = (a[w] != b[w]) | (ca <= cb)
            w, ca, cb = w[once], ca[once], cb[once]
            s = self.starts[level + 1]
            spend = spent[w] + POPCOUNT[self.sketch[s[ca], level] ^ self.sketch[s[cb], level]]
            keep = spend <= budget
            ca, cb, spend = ca[keep], cb[keep], spend[keep]
            e = self.ends[level + 1]
            single = (e[ca] - s[ca] == 1) & (e[cb] - s[cb] == 1)
            pair = single & (ca != cb)
            i, j = s[ca[pair]], s[cb[pair]]
            rest = spend[pair] + POPCOUNT[self.sketch[i, level + 1 :] ^ self.sketch[j, level + 1 :]].sum(axis=1, dtype=np.int16)
            yield i[rest <= budget], j[rest <= budget]
            stack.append((level + 1, ca[~single], cb[~single], spend[~single]))


def _walk(parts: bool, bits: bool):
    """For mapInArrow over rows sorted by (key, part, sketch): candidate pairs (a, b), a < b, each once a call; with
    ``bits`` also the number of sketch bits in which they differ."""
    names = ["a", "b", "bits"] if bits else ["a", "b"]

    def flush(key: np.ndarray, sketch: np.ndarray, ids: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = []
        for i, j in Tries(key, sketch).join(BUDGET):
            if parts:  # a part pair (x, y), x < y: only pairs across; (x, x): all
                cross = (side[i] != side[j]) | (side[i] == 2)
                i, j = i[cross], j[cross]
            if len(i):
                apart = [POPCOUNT[sketch[i] ^ sketch[j]].sum(axis=1, dtype=np.int64)] if bits else []
                seen.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), *apart]))
            if sum(x.shape[1] for x in seen) > SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(seen, axis=1)], names=names)
                seen = []
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(seen, axis=1), axis=1)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            now = [b.column("key").to_numpy(), sketch, b.column("id").to_numpy(), b.column("side").to_numpy()]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if last:
                yield from flush(*[x[:last] for x in now])
            held = [x[last:] for x in now]
        if held is not None:
            yield from flush(*held)

    return run


def candidates(reps: DataFrame, part: int = PART, bits: bool = False) -> DataFrame:
    """``(a, b)``, a < b: pairs of (id, keys, sketch) rows that some trie gives, each once; with ``bits``, how many bits of
    their sketches differ."""
    result = "a bigint, b bigint, bits bigint" if bits else "a bigint, b bigint"
    rows = reps.where("keys is not null").select("id", "sketch", F.col("keys"))
    at = F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1)))
    strings = rows.select("id", "sketch", at.alias("t"), "keys").select(
        F.conv(F.hex(F.substring("keys", F.col("t") * 8 + 1, F.lit(8))), 16, -10).cast("bigint").alias("key"), "sketch", "id"
    )
    few = strings.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(SAMPLE)) == 0).groupBy("key").count()
    hot = few.where(F.col("count") > max(1, part // SAMPLE)).select("key", F.ceil(F.col("count") * SAMPLE / part).cast("int").alias("parts"))
    n_hot = hot.count()
    plain = strings.withColumn("side", F.lit(0))
    out = []
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        plain = plain.join(hot, "key", "left_anti")
        own = F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        split = strings.join(hot, "key").select("key", "sketch", "id", "parts", own.alias("own"), each.alias("other"))
        lo, hi = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        split = split.select(F.xxhash64("key", lo, hi).alias("key"), "sketch", "id", side.alias("side"))
        out.append(split.repartition("key").sortWithinPartitions("key", "sketch").mapInArrow(_walk(True, bits), result))
    out.append(plain.repartition("key").sortWithinPartitions("key", "sketch").mapInArrow(_walk(False, bits), result))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both.where("a <> b").distinct()


def _verify(threshold: Fraction):
    """For mapInArrow over (a, b, ta, tb): the pairs whose sequences in both are at least threshold of those in either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, kept = Shingler(), OrderedDict()
        p, q = threshold.numerator, threshold.denominator
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ia, ib = part.column("a").to_pylist(), part.column("b").to_pylist()
                need = {}
                for ids, col in ((ia, "ta"), (ib, "tb")):
                    texts = part.column(col)
                    for r, i in enumerate(ids):
                        if i not in kept and i not in need:
                            need[i] = texts[r].as_py() or ""
                if need:
                    h, at = shingle(list(need.values()))
                    for r, i in enumerate(need):
                        kept[i] = h[at[r] : at[r + 1]]
                ok, share = [], []
                for r, (x, y) in enumerate(zip(ia, ib, strict=True)):
                    s, t = kept[x], kept[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    either = len(s) + len(t) - both
                    if either and both * q >= either * p:
                        ok.append(r)
                        share.append(both / either)
                while len(kept) > 2000:
                    kept.popitem(last=False)
                take = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("a").take(take), part.column("b").take(take), pa.array(share, pa.float64())], names=["a", "b", "similarity"])

    return run


def _classes(df: DataFrame, scratch: Scratch, key: str, text: str, version: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, last row of each key, members, one signed row a class with sequences) of ``near_duplicates``."""
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"),
        F.struct((F.col(version) if version else F.lit(0)).cast("string").alias("v"), F.xxhash64(text).alias("h")).alias("version"),
        F.col(text).alias("body"),
    )
    kinds = T.StructType([rows.schema["id"], rows.schema["version"]])
    for name in ("class", "keys", "sketch"):
        kinds = kinds.add(name, T.BinaryType())
    signed = scratch.cut(rows.mapInArrow(_sign, kinds), "signed")
    last = signed.groupBy("id").agg(F.max(F.struct("version", "class")).alias("r")).select("id", "r.version", "r.class").where("class is not null")
    last = scratch.cut(last, "last")
    reps = last.groupBy("class").agg(F.min(F.struct("id", "version")).alias("r")).select("class", "r.id", "r.version")
    members = scratch.cut(last.select("id", "class").join(reps.select("class", F.col("id").alias("class_id")), "class").select("id", "class_id"), "members")
    chosen = signed.where("keys is not null").select("id", "version", "keys", "sketch").join(reps.select("id", "version"), ["id", "version"], "left_semi")
    return rows, last, members, chosen.dropDuplicates(["id"])


def trie_pairs(df: DataFrame, key: str, text: str, version: str | None = None) -> DataFrame:
    """``(class_a, class_b, bits)``: what the tries alone give: classes within the error budget and the bits in which their
    sketches differ. The same rules for rows as in ``near_duplicates``, no exact look."""
    scratch = Scratch(df.sparkSession, "tries")
    chosen = _classes(df, scratch, key, text, version)[3]
    return candidates(chosen, bits=True).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.col("bits").cast("int").alias("bits"))


def near_duplicates(df: DataFrame, key: str, text: str, version: str | None = None, threshold: Fraction = Fraction(3, 5)) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: ``(key, class_id)``, one row a key with text; texts with the same set of 5-token sequences (or, without
    any, the same text) are one class, named by its smallest key. links: ``(class_a, class_b, similarity)``, class_a <
    class_b: classes whose sets share at least ``threshold``. Null and empty texts and null keys take no part; of
    repeated keys the greatest ``version`` counts. Texts without 5 tokens are only ever equal to others, not near.
    Other columns are ignored. key must be an integer.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    rows, last, members, chosen = _classes(df, scratch, key, text, version)
    pairs = scratch.cut(candidates(chosen), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = last.join(ends, "id", "left_semi").select("id", "version")
    texts = rows.where("body is not null").join(wanted, ["id", "version"], "left_semi").dropDuplicates(["id"]).select("id", "body")
    texts = scratch.cut(texts, "texts")
    links = _check(pairs, texts, threshold).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")
    return members.withColumnRenamed("id", key), scratch.cut(links, "links")


def _check(pairs: DataFrame, texts: DataFrame, threshold: Fraction) -> DataFrame:
    """The exact look: every candidate pair meets both whole texts."""
    ta = texts.select(F.col("id").alias("a"), F.col("body").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("body").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double")


def all_pairs(members: DataFrame, links: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(a, b)``, a < b: the links between classes and the equality within them, spelled out for their members."""
    m = members.select(F.col("class_id").alias("c"), F.col(key).alias("k"))
    left, right = m.select(F.col("c").alias("class_a"), F.col("k").alias("x")), m.select(F.col("c").alias("class_b"), F.col("k").alias("y"))
    across = links.join(left, "class_a").join(right, "class_b").select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))
    shared = m.groupBy("c").count().where("count > 1").select("c")
    some = m.join(shared, "c")
    within = some.select("c", F.col("k").alias("x")).join(some.select("c", F.col("k").alias("y")), "c").where("x < y").select(F.col("x").alias(a), F.col("y").alias(b))
    return across.unionByName(within)
