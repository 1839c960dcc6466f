"""Most similar vectors for every vector: a hash-prefix forest.

Each tree gives every vector a string of ``BITS`` bits, the signs of random projections, and is
kept as a sorted array of those strings. The vectors next to each other in the array are those
that share the longest prefixes, whatever their length; so descending to the longest-prefix
match is finding one's own place, and ascending for more candidates is widening the stretch of
the array around it, by the same number of steps in all trees at once.

The arrays are distributed: on a bounded sample (``SAMPLE`` vectors of a kind) each tree's prefix
space is split into blocks of about ``BLOCK`` vectors, a dense prefix further down than a thin
one; every vector is in one block of every tree. A block holds, per vector, its 64-bit id, its
string and a sketch of ``SKETCH`` sign bits (44 bytes), never the vector. Candidates whose sketches differ
in more bits than four standard deviations above the expectation at the wanted cosine are left
out; the exact cosine decides on the others.

The k nearest of a set of vectors, however far they are, come from the same forest (:func:`nearest`):
the leaves of a tree are prefixes of different lengths, and a query descends to its own leaf, the
longest prefix it shares, in each tree. From the k-th cosine found there follows how likely a
neighbour of that cosine lies in each other leaf (the query's distance from each plane on the way
tells how easily a bit differs), and the query ascends in all trees at once to ever less likely
leaves until such a neighbour would be met with probability ``SURE``. Exact cosines decide.

Where more than ``DENSE`` of a vector's candidates in some tree may have the wanted cosine, its ten
nearest need not be in the stretch. Such vectors ascend in the same way, until a neighbour as near as
the last is met with probability ``SURE_DENSE``.

Vectors of a wrong length, with null, NaN or infinite numbers, and all-zero ones take no part.
Several rows of one key stand for one vector (the smallest, of those that differ). More than
``k + 1`` copies of one vector: the ones with the smallest keys are each other's nearest, as ties
go to the smaller key, and the rest cannot be in a mutual pair. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

BITS, SKETCH = 32, 256
TREES, REACH = 16, 64
#: Near candidates in one tree beyond which a vector lies in a dense place.
DENSE = 32
BLOCK, SAMPLE = 16_384, 20_000
#: Pairs up to this number (24 bytes each) are broadcast to the vectors; more are joined by sorting.
PAIRS_BROADCAST = 150_000
SEED = 7
#: The search of the k nearest: trees, vectors a leaf, and how surely a neighbour must be met.
TOP_TREES, LEAF, SURE, SURE_DENSE = 8, 256, 0.9, 0.9999


def _units(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Usable vectors at unit length, each key once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b["vec"]
            sizes = np.asarray(vec.value_lengths().fill_null(0))
            full = np.flatnonzero(sizes == dim)
            if not len(full):
                continue
            flat = vec.take(pa.array(full)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1)
                x = x / top[:, None]
                norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(top) & (top > 0) & np.isfinite(norm)
            full, x = full[good], (x[good] / norm[good][:, None]).astype(np.float32)
            kinds, keys = b["kind"].to_pylist(), b["key"].to_pylist()
            first: dict[tuple, bytes] = {}
            for i, row in zip(full.tolist(), x):
                k, raw = (kinds[i], keys[i]), row.tobytes()
                if k not in first or raw < first[k]:
                    first[k] = raw
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in first], pa.string()), pa.array([k for _, k in first], pa.string()), pa.array(list(first.values()), pa.binary())],
                ["kind", "key", "vec"],
            )

    return run


def unit_vectors(parts: dict[str, DataFrame], dim: int) -> DataFrame:
    """``parts[kind] = DataFrame(key, vec)`` to (kind, key, id, vec), once a key."""
    rows = reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("kind"), F.col("key").cast("string").alias("key"), F.col("vec").cast("array<float>").alias("vec")).where("key is not null and vec is not null") for k, p in parts.items()])
    return (
        rows.mapInArrow(_units(dim), "kind string, key string, vec binary")
        .groupBy("kind", "key").agg(F.min("vec").alias("vec"))
        .select("kind", "key", F.xxhash64("kind", "key").alias("id"), "vec")
    )


def _projections(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * BITS)).astype(np.float32)


def _strings(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, trees) strings as whole numbers, and (n, SKETCH / 8) sketch bytes."""
    packed = np.packbits(x @ planes > 0, axis=1)
    return packed.reshape(len(x), -1, BITS // 8).view(">u4")[:, :, 0].astype(np.uint32), packed[:, : SKETCH // 8]


def split_prefixes(sorted_strings: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """First strings and lengths of the leaves: prefixes, split until at most ``most`` sampled strings are in each."""
    leaves, todo = [], [(0, 0, 0, len(sorted_strings))]
    while todo:
        prefix, length, lo, hi = todo.pop()
        if hi - lo > most and length < BITS - 1:
            middle = prefix | (1 << (BITS - 1 - length))
            cutoff = lo + int(np.searchsorted(sorted_strings[lo:hi], np.uint32(middle)))
            todo += [(middle, length + 1, cutoff, hi), (prefix, length + 1, lo, cutoff)]
        else:
            leaves.append((prefix, length))
    leaves.sort()
    return np.array([x for x, _ in leaves], dtype=np.uint32), np.array([x for _, x in leaves], dtype=np.int64)


@dataclass
class Tree:
    """The leaves of a tree, and how many vectors each holds by the sample."""

    starts: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray

    def leaf(self, strings: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, strings, side="right") - 1

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, BITS) of ones where a bit of the prefix is set, and where it is not."""
        at = np.arange(BITS)
        inside = at[None, :] < self.lengths[:, None]
        ones = (self.starts[:, None] >> (BITS - 1 - at)[None, :]) & 1 == 1
        return (ones & inside).astype(np.float32), (~ones & inside).astype(np.float32)


def fit(vectors: DataFrame, dim: int, trees: int, block: int = BLOCK) -> dict[str, list[Tree]]:
    """The leaves of each tree of each kind, from a bounded sample."""
    counts = {r["kind"]: r["n"] for r in vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    planes, out = _projections(dim, trees), {}
    for kind, n in counts.items():
        # The id is a hash of the key, so its low bits draw evenly.
        share = max(1, n // SAMPLE)
        rows = vectors.where((F.col("kind") == kind) & (F.pmod("id", F.lit(share)) == 0)).select("vec").limit(2 * SAMPLE).collect()
        x = np.frombuffer(b"".join(r["vec"] for r in rows), dtype=np.float32).reshape(-1, dim)
        strings, _ = _strings(x, planes)
        most = max(1.0, block * len(x) / n)
        out[kind] = []
        for t in range(trees):
            tree = Tree(*split_prefixes(np.sort(strings[:, t]), most), np.empty(0))
            tree.sizes = np.bincount(tree.leaf(strings[:, t]), minlength=len(tree.starts)) * (n / max(1, len(x)))
            out[kind].append(tree)
    return out


def _plant(dim: int, trees: int, blocks: dict[str, list[Tree]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries (id, string, sketch) of each block, packed, one row a block and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _projections(dim, trees)
        for b in batches:
            kinds = np.array(b["kind"].to_pylist(), dtype=object)
            ids = b["id"].to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(b["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
            strings, sketch = _strings(x, planes)
            names, data, number = [], [], []
            for kind in sorted(set(kinds.tolist())):
                own = np.flatnonzero(kinds == kind)
                entries = np.empty(len(own), dtype=_ENTRY)
                entries["id"], entries["sketch"] = ids[own], sketch[own]
                for t in range(trees):
                    s = strings[own, t]
                    entries["string"] = s
                    tree = blocks[kind][t]
                    # A block that no longer prefix can split holds near vectors only; its parts are as
                    # dense as the whole, so its vectors are told as such in each of them.
                    leaf = tree.leaf(s)
                    block = _cell(t, leaf, (ids[own] >> 7) % np.maximum(1, np.ceil(tree.sizes / (4 * BLOCK))).astype(np.int64)[leaf])
                    order = np.argsort(block, kind="stable")
                    bounds = np.flatnonzero(np.diff(block[order])) + 1
                    for piece in np.split(order, bounds):
                        names.append(kind)
                        number.append(int(block[piece[0]]))
                        data.append(entries[piece].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(number, pa.int64()), pa.array(data, pa.binary())], ["kind", "block", "entries"])

    return run


_ENTRY = np.dtype([("id", "<i8"), ("string", "<u4"), ("sketch", "u1", (SKETCH // 8,))])


def bits_allowed(cosine: float) -> int:
    """Differing sketch bits up to which a pair may have that cosine (four standard deviations)."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return int(SKETCH * p + 4 * np.sqrt(SKETCH * p * (1 - p)) + 1)


def _meet(reach: int, allowed: int, dense: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Candidate pairs of a block, at most ``reach`` places apart in the sorted array.

    A vector in a dense place comes out as a pair with itself, two such ones not as a pair."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table["entries"].to_pylist()), dtype=_ENTRY)
        e = e[np.lexsort((e["id"], e["string"]))]
        ids, sk = e["id"], np.ascontiguousarray(e["sketch"]).view("<u8")
        found, near_ones = [], np.zeros(len(e), np.int64)
        for d in range(1, min(reach, len(e) - 1) + 1):
            apart = np.bitwise_count(sk[:-d, 0] ^ sk[d:, 0]).astype(np.uint16)
            near = np.flatnonzero(apart <= allowed)
            apart = apart[near]
            for w in range(1, sk.shape[1]):
                apart = apart + np.bitwise_count(sk[near, w] ^ sk[near + d, w])
                ok = apart <= allowed
                near, apart = near[ok], apart[ok]
            if len(near):
                found.append(np.stack([near, near + d], axis=1))
                near_ones[near] += 1
                near_ones[near + d] += 1
        at = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        crowded = near_ones > dense
        pairs = ids[np.concatenate([at[~crowded[at].all(axis=1)], np.repeat(np.flatnonzero(crowded)[:, None], 2, axis=1)])]
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table({"kind": pa.array([key[0].as_py()] * len(pairs), pa.string()), "a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def candidates(vectors: DataFrame, dim: int, cosine: float, trees: int = TREES, reach: int = REACH) -> DataFrame:
    """(kind, a, b): pairs of ids that meet in some tree and may have that cosine; a = b in dense places."""
    blocks = fit(vectors, dim, trees)
    return (
        vectors.select("kind", "id", "vec").mapInArrow(_plant(dim, trees, blocks), "kind string, block bigint, entries binary")
        .groupBy("kind", "block").applyInArrow(_meet(reach, bits_allowed(cosine), DENSE), "kind string, a bigint, b bigint")
        .distinct()
    )


def _cosines(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), dtype=np.float32).reshape(-1, dim).astype(np.float64) for c in ("vec_a", "vec_b"))
            yield pa.RecordBatch.from_arrays([b["kind"], b["key_a"], b["key_b"], pa.array((x * y).sum(axis=1))], ["kind", "key_a", "key_b", "cosine"])

    return run


def similar_pairs(vectors: DataFrame, dim: int, cosine: float, k: int, trees: int = TREES, reach: int = REACH) -> DataFrame:
    """(kind, key_a, key_b, cosine) of pairs with at least that cosine, key_a < key_b.

    In dense places only those among the k most similar of one of the two are sure to come out.
    ``vectors`` is read several times and should be kept (:func:`paperloom.session.cut`)."""
    pairs = cut(candidates(vectors, dim, cosine, trees, reach))
    dense = pairs.where("a = b").select("kind", F.col("a").alias("id"))
    pairs = pairs.where("a <> b")
    crowded = [r["kind"] for r in dense.select("kind").distinct().collect()]
    if crowded:
        # k - 1 nearer ones and k + 1 copies of one vector may tie for the last places.
        near = _search(vectors.join(dense, ["kind", "id"], "left_semi"), vectors.where(F.col("kind").isin(crowded)), dim, 2 * k, SURE_DENSE)[0]
        met = near.where(F.col("cosine") >= cosine - 1e-6).select("kind", F.least("of_id", "other_id").alias("a"), F.greatest("of_id", "other_id").alias("b"))
        pairs = cut(pairs.unionByName(met).distinct())
    few = pairs.count() <= PAIRS_BROADCAST
    side = lambda s: vectors.select("kind", F.col("id").alias(s), F.col("key").alias(f"key_{s}"), F.col("vec").alias(f"vec_{s}"))
    if few:
        # Only the vectors of some pair go on; the few pairs travel, not the vectors.
        ends = pairs.select("kind", F.col("a").alias("id")).union(pairs.select("kind", F.col("b").alias("id"))).distinct()
        vectors = vectors.join(F.broadcast(ends), ["kind", "id"], "left_semi")
    joined = pairs.join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"]).where("key_a <> key_b")
    exact = joined.select("kind", "key_a", "key_b", "vec_a", "vec_b").mapInArrow(_cosines(dim), "kind string, key_a string, key_b string, cosine double")
    return exact.where(F.col("cosine") >= cosine).select(
        "kind", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "cosine"
    )


def _without_surplus(vectors: DataFrame, k: int) -> DataFrame:
    """Leave out the copies of a vector beyond the k + 1 of smallest key."""
    cells = vectors.groupBy("kind", "vec_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    if cells.limit(1).count() == 0:
        return vectors.drop("vec_hash")
    salt = F.pmod("id", F.lit(64))
    copies = vectors.select("kind", "vec_hash", "key", "id").join(cells, ["kind", "vec_hash"], "left_semi")
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    kept = (
        copies.withColumn("salt", salt).withColumn("r", order("kind", "vec_hash", "salt")).where(F.col("r") <= k + 1)
        .withColumn("r", order("kind", "vec_hash")).where(F.col("r") <= k + 1).select("kind", "id")
    )
    surplus = copies.select("kind", "id").join(kept, ["kind", "id"], "left_anti")
    return vectors.drop("vec_hash").join(surplus, ["kind", "id"], "left_anti")


def mutual_neighbours(parts: dict[str, DataFrame], dim: int = 64, k: int = 10, cosine: float = 0.9, trees: int = TREES, reach: int = REACH) -> DataFrame:
    """(kind, key_a, key_b): each among the k most similar of the other, with at least that cosine."""
    vectors = _without_surplus(cut(unit_vectors(parts, dim)).withColumn("vec_hash", F.xxhash64("vec")), k)
    return mutual(similar_pairs(vectors, dim, cosine, k, trees, reach), k)


def mutual(pairs: DataFrame, k: int) -> DataFrame:
    both = pairs.select("kind", F.col("key_a").alias("of"), F.col("key_b").alias("other"), "cosine").unionByName(
        pairs.select("kind", F.col("key_b").alias("of"), F.col("key_a").alias("other"), "cosine")
    )
    # A key has at most 2 * reach * trees candidates, and those in dense places that count it among theirs.
    rank = F.row_number().over(Window.partitionBy("kind", "of").orderBy(F.desc("cosine"), "other"))
    return (
        both.withColumn("r", rank).where(F.col("r") <= k)
        .groupBy("kind", F.least("of", "other").alias("key_a"), F.greatest("of", "other").alias("key_b"))
        .agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("kind", "key_a", "key_b")
    )


def literature_vectors(chunks: DataFrame, entities: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """The three kinds of vectors of the literature tables."""
    return {
        "chunk": chunks.select(F.col("chunk_id").alias("key"), F.col("embedding").alias("vec")),
        "concept": entities.where(F.lower(F.trim("entity_type")) == "concept").select(F.col("entity_id").alias("key"), F.col("embedding").alias("vec")),
        "paper": papers.select(F.col("paper_id").alias("key"), F.col("abstract_embedding").alias("vec")),
    }


#: Vectors of a cell of the block search: queries and collection.
QUERY_BLOCK, SIDE_BLOCK = 8_192, 32_768


def _nearest(dim: int, k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The k nearest of each query inside one cell, by blocks of matrix products."""

    def run(key: tuple, asked: pa.Table, side: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asked.num_rows and side.num_rows:
            load = lambda t: np.frombuffer(b"".join(t["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
            q, x = load(asked), load(side)
            qi, xi = asked["id"].to_numpy(), side["id"].to_numpy()
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                s[qi[a : a + 256, None] == xi[None, :]] = -2
                n = min(k + 6, s.shape[1])  # a few more, as single precision may swap near ones
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                exact = np.einsum("qd,qnd->qn", q[a : a + 256].astype(np.float64), x[at].astype(np.float64))
                exact[np.take_along_axis(s, at, axis=1) == -2] = -2
                out.append((np.repeat(qi[a : a + 256], n), xi[at].ravel(), exact.ravel()))
        of, other, cosine = (np.concatenate(c) for c in zip(*out))
        keep = cosine > -2
        kind = key[0].as_py() if key else ""
        return pa.table({"kind": pa.array([kind] * int(keep.sum()), pa.string()), "of_id": of[keep], "other_id": other[keep], "cosine": cosine[keep]})

    return run


def nearest_of(asked: DataFrame, vectors: DataFrame, most: int, dim: int, k: int) -> DataFrame:
    """(kind, of_id, other_id, cosine): at least the k most similar of each of ``asked`` (about ``most`` a kind), exact.

    They are held against all vectors of their kind in cells of bounded size; each cell gives its own."""
    counts = vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
    sides = max([1, *(-(-r["n"] // SIDE_BLOCK) for r in counts)])
    blocks = max(1, -(-most // QUERY_BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Other names, as both sides may come from one table.
    asked = asked.select(F.col("kind").alias("kind"), F.col("id").alias("id"), F.col("vec").alias("vec"), deal(blocks, 1).alias("qb"), numbers(sides).alias("sb"))
    side = vectors.select("kind", "id", "vec", deal(sides, 2).alias("sb"), numbers(blocks).alias("qb"))
    cell = ["kind", "qb", "sb"]
    return asked.groupBy(*cell).cogroup(side.groupBy(*cell)).applyInArrow(_nearest(dim, k), "kind string, of_id bigint, other_id bigint, cosine double")


def _every(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.where(F.pmod("id", F.lit(n)) == 0)


def exact_nearest(vectors: DataFrame, dim: int, k: int = 10, every: int = 20) -> DataFrame:
    """(kind, of, other, rank, cosine): the k most similar others of every ``every``-th vector.

    Held against all of their kind, in cells of bounded size; what :func:`nearest` is measured by."""
    most = max([0, *(r["n"] for r in vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect())])
    found = nearest_of(_every(vectors, every), vectors, -(-most // every), dim, k)
    return _named(found, vectors, k)


def _named(found: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k first of each query with their keys; ties of the cosine go to the smaller key."""
    name = lambda s: vectors.select("kind", F.col("id").alias(f"{s}_id"), F.col("key").alias(s))
    rank = F.row_number().over(Window.partitionBy("kind", "of").orderBy(F.desc("cosine"), "other"))
    named = found.join(name("of"), ["kind", "of_id"]).join(name("other"), ["kind", "other_id"])
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("kind", "of", "other", "rank", "cosine")


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (error below 1e-6)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x < 0, tail, 1 - tail)


def likely_leaves(projected: np.ndarray, tree: Tree, cosine: np.ndarray) -> np.ndarray:
    """(n, leaves): how likely a vector of that cosine to the query lies in each leaf.

    ``projected`` (n, BITS) are the query's products with the planes of the tree. That of a vector
    at cosine c is normal around c times it, so it falls on the other side with a known probability."""
    c = np.clip(cosine, 0.0, 0.9999)[:, None]
    other = np.clip(_normal(-c * np.abs(projected) / np.sqrt(1 - c * c)), 1e-9, 0.5)
    set_ = np.log(np.where(projected > 0, 1 - other, other)).astype(np.float32)
    clear = np.log(np.where(projected > 0, other, 1 - other)).astype(np.float32)
    ones, zeros = tree.bits()
    return np.exp(set_ @ ones.T + clear @ zeros.T)


def leaves_until_sure(chances: list[np.ndarray], own: list[np.ndarray], sure: float) -> list[np.ndarray]:
    """For each tree (n, leaves): which leaves each query visits.

    One limit of likelihood holds in all trees; it is lowered until a neighbour is in some visited leaf with
    probability ``sure``. A query's own leaves are always visited."""
    n = len(chances[0])
    low, high = np.full(n, -23.0), np.zeros(n)
    for _ in range(12):
        limit = (low + high) / 2
        missed = np.ones(n)
        for p, o in zip(chances, own):
            seen = p >= np.exp(limit)[:, None]
            seen[np.arange(n), o] = True
            missed *= 1 - np.minimum(1.0, np.where(seen, p, 0).sum(axis=1))
        enough = missed <= 1 - sure
        low, high = np.where(enough, limit, low), np.where(enough, high, limit)
    out = []
    for p, o in zip(chances, own):
        seen = p >= np.exp(low)[:, None]
        seen[np.arange(n), o] = True
        out.append(seen)
    return out


def _salts(tree: Tree) -> np.ndarray:
    return np.maximum(1, np.ceil(tree.sizes / SIDE_BLOCK)).astype(np.int64)


def _cell(tree: int, leaf: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (np.int64(tree) << 52) | (leaf.astype(np.int64) << 28) | salt


def _grow(dim: int, forest: dict[str, list[Tree]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The vectors of each leaf of each tree, packed, one row a cell and batch; a crowded leaf has several cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _projections(dim, TOP_TREES)
        entry = np.dtype([("id", "<i8"), ("vec", "<f4", (dim,))])
        for b in batches:
            kinds = np.array(b["kind"].to_pylist(), dtype=object)
            e = np.empty(b.num_rows, dtype=entry)
            e["id"] = b["id"].to_numpy(zero_copy_only=False)
            e["vec"] = np.frombuffer(b"".join(b["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
            strings, _ = _strings(e["vec"], planes)
            names, number, data = [], [], []
            for kind in sorted(set(kinds.tolist())):
                own = np.flatnonzero(kinds == kind)
                for t, tree in enumerate(forest[kind]):
                    leaf = tree.leaf(strings[own, t])
                    cell = _cell(t, leaf, (e["id"][own] >> 7) % _salts(tree)[leaf])
                    order = np.argsort(cell, kind="stable")
                    for piece in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                        names.append(kind)
                        number.append(int(cell[piece[0]]))
                        data.append(e[own[piece]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(number, pa.int64()), pa.array(data, pa.binary())], ["kind", "cell", "entries"])

    return run


def _ask(dim: int, forest: dict[str, list[Tree]], sure: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells each query visits: its own leaves (``sure`` is None), else the others until it is sure.

    ``looked`` is the number of vectors the query meets there, on its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _projections(dim, TOP_TREES)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                kinds = np.array(b["kind"].to_pylist(), dtype=object)
                x = np.frombuffer(b"".join(b["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
                floor = b["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
                rows, cells, looked = [], [], []
                for kind in sorted(set(kinds.tolist())):
                    own = np.flatnonzero(kinds == kind)
                    projected = (x[own] @ planes).reshape(len(own), -1, BITS)
                    strings, _ = _strings(x[own], planes)
                    trees = forest[kind]
                    home = [t.leaf(strings[:, i]) for i, t in enumerate(trees)]
                    if sure is None:
                        visits = [np.zeros((len(own), len(t.starts)), bool) for t in trees]
                        for v, h in zip(visits, home):
                            v[np.arange(len(own)), h] = True
                    else:
                        visits = leaves_until_sure([likely_leaves(projected[:, i], t, floor[own]) for i, t in enumerate(trees)], home, sure)
                        for v, h in zip(visits, home):
                            v[np.arange(len(own)), h] = False
                    for i, (tree, v) in enumerate(zip(trees, visits)):
                        q, leaf = np.nonzero(v)
                        salts = _salts(tree)[leaf]
                        salt = np.arange(int(salts.sum())) - np.repeat(np.cumsum(salts) - salts, salts)
                        rows.append(np.repeat(own[q], salts))
                        cells.append(_cell(i, np.repeat(leaf, salts), salt))
                        looked.append(np.repeat(tree.sizes[leaf] / salts, salts))
                if not rows:
                    continue
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [b["kind"].take(take), pa.array(np.concatenate(cells)), b["id"].take(take), b["vec"].take(take), b["floor"].take(take), pa.array(np.concatenate(looked))],
                    ["kind", "cell", "id", "vec", "floor", "looked"],
                )

    return run


def _meet_leaf(dim: int, k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The k nearest of each query inside one cell that are nearer than its floor."""

    def run(key: tuple, asked: pa.Table, side: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asked.num_rows and side.num_rows:
            e = np.frombuffer(b"".join(side["entries"].to_pylist()), dtype=np.dtype([("id", "<i8"), ("vec", "<f4", (dim,))]))
            x, xi = np.ascontiguousarray(e["vec"]), e["id"]
            q = np.frombuffer(b"".join(asked["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
            qi, floor = asked["id"].to_numpy(), asked["floor"].to_numpy()
            for a in range(0, len(q), 512):
                s = q[a : a + 512] @ x.T
                s[qi[a : a + 512, None] == xi[None, :]] = -2
                n = min(k + 6, s.shape[1])  # a few more, as single precision may swap near ones
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                r, c = np.nonzero(np.take_along_axis(s, at, axis=1) >= np.maximum(floor[a : a + 512, None], -1) - 1e-5)
                other = at[r, c]
                out.append((qi[a + r], xi[other], np.einsum("nd,nd->n", q[a + r].astype(np.float64), x[other].astype(np.float64))))
        of, other, cosine = (np.concatenate(c) for c in zip(*out))
        return pa.table({"kind": pa.array([key[0].as_py() if key else ""] * len(of), pa.string()), "of_id": of, "other_id": other, "cosine": cosine})

    return run


def _search(asked: DataFrame, side: DataFrame, dim: int, k: int, sure: float) -> tuple[DataFrame, DataFrame]:
    """(found, looked): (kind, of_id, other_id, cosine), and (kind, of_id, met) of each query."""
    # Trees of few leaves hold much the same in each, so a small kind needs few.
    forest = {kind: trees[: max(1, len(trees[0].starts))] for kind, trees in fit(side, dim, TOP_TREES, LEAF).items()}
    asked = asked.select(F.col("kind").alias("kind"), F.col("id").alias("id"), F.col("vec").alias("vec"))  # other names, as both may come from one table
    grown = lambda: side.select("kind", "id", "vec").mapInArrow(_grow(dim, forest), "kind string, cell bigint, entries binary").groupBy("kind", "cell")
    ask = lambda df, s: df.mapInArrow(_ask(dim, forest, s), "kind string, cell bigint, id bigint, vec binary, floor double, looked double")
    schema = "kind string, of_id bigint, other_id bigint, cosine double"
    first = ask(asked.withColumn("floor", F.lit(-2.0)), None)
    home = cut(first.groupBy("kind", "cell").cogroup(grown()).applyInArrow(_meet_leaf(dim, k), schema).distinct())
    rank = F.row_number().over(Window.partitionBy("kind", "of_id").orderBy(F.desc("cosine"), "other_id"))
    kth = home.withColumn("r", rank).where(F.col("r") == k).select("kind", F.col("of_id").alias("id"), F.col("cosine").alias("floor"))
    # A query with fewer than k vectors in its own leaves is sure of nothing yet.
    second = cut(ask(asked.join(kth, ["kind", "id"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))), sure))
    away = second.groupBy("kind", "cell").cogroup(grown()).applyInArrow(_meet_leaf(dim, k), schema)
    looked = first.select("kind", "id", "looked").unionByName(second.select("kind", "id", "looked")).groupBy("kind", F.col("id").alias("of_id")).agg(F.sum("looked").alias("met"))
    return home.unionByName(away).distinct(), looked


def nearest(vectors: DataFrame, dim: int, k: int = 10, every: int = 20, sure: float = SURE) -> DataFrame:
    """(kind, of, other, rank, cosine): the k most similar others of every ``every``-th vector, by the forest.

    The stated query set (ids divisible by ``every``) against all vectors; of many copies of one
    vector those of the smallest keys come out. ``vectors`` is (kind, key, id, vec) and is read
    several times."""
    side = _without_surplus(vectors.withColumn("vec_hash", F.xxhash64("vec")), k)
    return _named(_search(_every(vectors, every), side, dim, k, sure)[0], vectors, k)


def recall(vectors: DataFrame, dim: int, k: int = 10, every: int = 20, sure: float = SURE) -> DataFrame:
    """(kind, queries, recall, looked): the share of the exact k nearest that the forest finds, and
    how many of all vectors a query meets (those met in several trees count several times).

    A vector as near as the k-th, to five digits, is right."""
    found, looked = _search(_every(vectors, every), vectors, dim, k, sure)
    got, want = cut(_named(found, vectors, k)), cut(exact_nearest(vectors, dim, k, every))
    kth = want.groupBy("kind", "of").agg(F.min("cosine").alias("kth"), F.count(F.lit(1)).alias("wanted"))
    right = got.join(kth, ["kind", "of"], "right").groupBy("kind", "of").agg(F.count_if(F.col("cosine") >= F.col("kth") - 1e-5).alias("right"), F.max("wanted").alias("wanted"))
    size = vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    share = looked.join(size, "kind").groupBy("kind").agg(F.avg(F.col("met") / F.col("n")).alias("looked"))
    return right.groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.least("right", "wanted")) / F.sum("wanted")).alias("recall")).join(share, "kind")
