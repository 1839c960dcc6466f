"""Weighted character n-gram vectors of words, and the join of words by their cosine.

Grams are trigrams and unordered pairs of letters at most two places apart (so a swap of neighbours
changes little), the ends of a word marked. They are told apart by ``BUCKETS`` hash buckets, so a
table of their weights has a fixed size and may travel to every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16


@lru_cache(1 << 17)
def grams_of(word: str) -> tuple[int, ...]:
    """The buckets of a word's trigrams and unordered near pairs of letters, its ends marked."""
    p = f"^{word}$"
    out = {p[i : i + 3] for i in range(len(p) - 2)}
    out |= {"u" + "".join(sorted(p[i] + p[i + k])) for k in (1, 2) for i in range(len(p) - k)}
    return tuple(sorted({zlib.crc32(g.encode()) % BUCKETS for g in out}))


def vector(word: str, weights: np.ndarray) -> dict[int, float]:
    """The word's unit vector."""
    v = {g: float(weights[g]) for g in grams_of(word)}
    norm = sum(x * x for x in v.values()) ** 0.5
    return {g: x / norm for g, x in v.items()} if norm else {}


def cosine(x: dict[int, float], y: dict[int, float]) -> float:
    if len(x) > len(y):
        x, y = y, x
    return min(1.0, sum(v * y[g] for g, v in x.items() if g in y))


#: Steps in which a weight in a unit vector and the norm behind it travel, rounded up.
STEPS = 255


def _order(v: dict[int, float], weights: np.ndarray) -> tuple[int, ...]:
    """The grams of a vector, the rarest first; the same order for every word."""
    return tuple(sorted(v, key=lambda g: (-weights[g], g)))


def _gram_rows(weights: np.ndarray | None, floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All grams of the words; with weights only the prefix that a pair at the floor must share.

    ``u`` is a gram's weight in the unit vector, ``rest`` the norm of what comes after it, both in ``STEPS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, gram, u, rest = [], [], [], []
            for i, word in enumerate(b["word"].to_pylist()):
                if weights is None:
                    gs = grams_of(word)
                    at += [i] * len(gs)
                    gram += gs
                    continue
                left, v = 1.0, vector(word, weights)
                for g in _order(v, weights):
                    if left < floor * floor:
                        break
                    left -= v[g] * v[g]
                    at.append(i)
                    gram.append(g)
                    u.append(ceil(STEPS * v[g]))
                    rest.append(ceil(STEPS * max(0.0, left) ** 0.5))
            take = [b[c].take(pa.array(at, pa.int64())) for c in (["word"] if weights is None else ["key", "word"])]
            if weights is None:
                yield pa.RecordBatch.from_arrays([*take, pa.array(gram, pa.int32())], ["word", "gram"])
            else:
                yield pa.RecordBatch.from_arrays([*take, pa.array(gram, pa.int32()), pa.array(u, pa.int32()), pa.array(rest, pa.int32())], ["key", "word", "gram", "u", "rest"])

    return run


def gram_weights(words: DataFrame) -> np.ndarray:
    """Inverse document frequencies over distinct ``words(word)``, by bucket (a table of fixed size)."""
    n = max(1, words.count())
    df = words.select("word").mapInArrow(_gram_rows(None, 0.0), "word string, gram int").groupBy("gram").agg(F.count(F.lit(1)).alias("df")).toPandas()
    weights = np.full(BUCKETS, np.log1p(n), dtype=np.float32)
    weights[df["gram"].to_numpy(np.int64)] = np.log1p(n / df["df"].to_numpy())
    return weights


_made: dict[int, Callable[[str], tuple[dict[int, float], tuple[int, ...]]]] = {}


def _vectors(weights: np.ndarray) -> Callable[[str], tuple[dict[int, float], tuple[int, ...]]]:
    """Word to vector and its grams in order, remembered by this worker process from task to task."""
    sign = zlib.crc32(weights.tobytes())
    if sign not in _made:
        _made.clear()
        _made[sign] = lru_cache(1 << 16)(lambda w: (v := vector(w, weights), _order(v, weights)))
    return _made[sign]


def cosine_join(words: DataFrame, weights: np.ndarray, floor: float, others: DataFrame | None = None) -> DataFrame:
    """(key, a, b, cosine): the pairs of distinct ``words(key, word)`` and ``others(key, word)`` under
    one key at the floor or above; without ``others`` the pairs a < b of the words.

    Two words at the floor share a gram of both prefixes; at the first they share, the product of
    its weights and of the norms behind it bounds the cosine, so a pair below that is left out. A
    pair is taken at that gram and passed over at all others, so no table of candidates is ever
    shuffled or made distinct. The exact cosine decides, and no number of partners is a limit."""
    prefix = lambda w: w.select("key", "word").mapInArrow(_gram_rows(weights, floor), "key string, word string, gram int, u int, rest int")
    mine = prefix(words)
    x, y = mine.alias("x"), (mine if others is None else prefix(others)).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.gram") == F.col("y.gram"))
    near = F.col("x.u") * F.col("y.u") + F.col("x.rest") * F.col("y.rest") >= (floor - 1e-4) * STEPS * STEPS
    met = x.join(y, same & (near if others is not None else near & (F.col("x.word") < F.col("y.word")))).select("x.key", F.col("x.word").alias("a"), F.col("y.word").alias("b"), "x.gram")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _vectors(weights)
        for b in batches:
            at, cosines = [], []
            for i, (a, other, gram) in enumerate(zip(b["a"].to_pylist(), b["b"].to_pylist(), b["gram"].to_pylist())):
                (v, order), (w, _) = of(a), of(other)
                if next(g for g in order if g in w) == gram and (c := cosine(v, w)) >= floor:
                    at.append(i)
                    cosines.append(c)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[x].take(take) for x in ("key", "a", "b")), pa.array(cosines, pa.float64())], ["key", "a", "b", "cosine"])

    return met.mapInArrow(exact, "key string, a string, b string, cosine double")
