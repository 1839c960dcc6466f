"""Vector expressions and the hashing embedder."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of different lengths are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays."""
    by = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
    return F.element_at(F.transform(F.array(norm(a)), by), 1)  # the norm is taken once, not for each number


def resized(a: Column, n: int) -> Column:
    """Cut or padded with zeros to n numbers."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), n)), 1, n)


def bucket_means(a: Column, n: int) -> Column:
    """Downsized to n numbers: the means of n stretches of nearly equal length."""
    size = F.size(a)
    return F.when(size <= n, resized(a, n)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.aggregate(
                F.slice(a, F.floor(i * size / n).cast("int") + 1, F.greatest(F.floor((i + 1) * size / n).cast("int") - F.floor(i * size / n).cast("int"), F.lit(1))),
                F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("c")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["c"] + 1).alias("c")), lambda acc: acc["s"] / acc["c"],
            ),
        )
    )


_TOKENS = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+-]*")


def hash_vector(text: str | None, dim: int = 256) -> list[float]:
    """Each token adds its weight with a hashed sign to a hashed place; then unit length."""
    out = [0.0] * dim
    for token in _TOKENS.findall((text or "").lower()):
        h = hashlib.blake2b(token.encode(), digest_size=16).digest()
        out[int.from_bytes(h[:4], "big") % dim] += (1.0 if h[4] % 2 == 0 else -1.0) * (1.0 + min(len(token), 12) / 12.0)
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out] if size else out


def hashing_embedder(dim: int = 256):
    """A text to vector function over Arrow batches (BLAKE2b is no built-in)."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return embed
