"""Vector functions over array columns, and hash embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sha, tokens, u32


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """a at length 1; zeros stay."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def quantise(a: Column, bits: int = 8) -> Column:
    """struct(scale, q): symmetric codes; halves round up."""
    top = (1 << (min(8, max(4, bits)) - 1)) - 1
    scale = F.when(max_abs(a) > 0, max_abs(a) / top).otherwise(F.lit(1.0))
    code = lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(x.cast("double") / scale + 0.5).cast("int")))
    return F.struct(scale.alias("scale"), F.transform(a, code).alias("q"))


def dequantise(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: (x * scale).cast("float"))


def to_base64(q: Column) -> Column:
    """Signed codes as base64 of their bytes."""
    return F.base64(F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), "")))


def from_base64(text: Column) -> Column:
    digits = F.hex(F.unbase64(text))
    at = F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    byte = lambda i: F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.transform(at, lambda i: F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i)))


#: Tokens whose hashes a task remembers.
REMEMBERED = 200_000


def _hashing(text: Column, dim: int, kind: str, finish) -> Column:
    """finish of a text's signed token counts; null for a null text. A batch at a time: a token is hashed once in a task, and nothing is shuffled."""

    @F.pandas_udf(kind)
    def hashing(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        split = re.compile("[a-z0-9_]+").findall
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                words = split(t.lower())
                for w in set(words).difference(known):
                    known[w] = int(hashlib.sha256(w.encode()).hexdigest()[:8], 16)
                u = np.fromiter((known[w] for w in words), np.int64, len(words))
                out.append(finish(np.bincount(u % dim, np.where(u & 1, -1, 1), dim)))
            if len(known) > REMEMBERED:
                known.clear()
            yield pd.Series(out)

    return hashing(text)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def counts(text: Column, dim: int) -> Column:
    """array<int> of signed token counts, dim long."""
    return _hashing(text, dim, "array<int>", lambda v: v.astype(np.int32))


def hashed(text: Column, dim: int) -> Column:
    """array<double>: the hash embedding, of unit length; zeros for a text without tokens."""
    return _hashing(text, dim, "array<double>", lambda v: _unit(v))


def hashed_sum(text: Column, dim: int) -> Column:
    """The sum of the hash embedding's components."""
    return _hashing(text, dim, "double", lambda v: float(_unit(v).sum()))


def buckets(rows: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key, bucket, value: the signed token counts that aren't 0."""
    return rows.select(key, F.posexplode(counts(F.col(text), dim)).alias("bucket", "value")).filter("value <> 0").select(key, "bucket", F.col("value").cast("long").alias("value"))


def vectors(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """key, vector: the unit vector of the summed values (key, bucket, value). Sums are made before lists, which have dim entries at most."""
    sums = rows.groupBy(key, "bucket").agg(F.sum("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("double"))
    return sums.select(key, spread.alias("vector")).withColumn("vector", unit(F.col("vector")))


def embed_query(text: str, dim: int) -> list[int]:
    """The signed token counts of one query, by the driver."""
    out = [0] * dim
    for t in re.split("[^a-z0-9_]+", text.lower()):
        if t:
            u = int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)
            out[u % dim] += 1 if u % 2 == 0 else -1
    return out


def codes(values: list[int], top: int = 127) -> list[int]:
    most = max(map(abs, values), default=0)
    return [(2 * v * top + most) // (2 * most) if most else 0 for v in values]


def fuse(vectors: list[tuple[Column, float]]) -> Column:
    """The unit vector of a weighted sum; shorter vectors are padded with zeros."""
    width = F.greatest(*(F.size(v) for v, _ in vectors))
    pad = lambda v: F.concat(F.transform(v, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), width - F.size(v)))
    scaled = lambda v, w: F.transform(v, lambda x: x * w)
    total = None
    for v, w in vectors:
        part = scaled(pad(v), w)
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    return unit(total)
