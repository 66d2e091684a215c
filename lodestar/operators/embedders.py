"""Embeddings of code: by a model or by hashing, of symbols, of relations, of syntax, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Weights of a symbol's parts, and of relations and the names in them.
NAME, SIGNATURE, KIND, CONTAINER, EXTENDS, IMPLEMENTS = 1.0, 0.5, 0.3, 0.4, 0.6, 0.4
RELATIONS = {"calls": (1.0, 0.2), "types": (0.8, 0.15), "imports": (0.6, 0.0)}
FUSION = (0.5, 0.3, 0.2)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the states (tokens x width) whose mask is 1; zeros without any."""
    kept = states[mask.astype(bool)]
    return kept.mean(0) if len(kept) else np.zeros(states.shape[1])


def semantic(text: Column, dim: int = 768, path: str | None = None, vocabulary: dict[str, int] | None = None, longest: int = 512) -> Column:
    """array<double>, dim long, of unit length: an ONNX model's states, mean-pooled; without a model, or where it fails, the hash embedding."""
    hashed = V.hashed(text, dim)
    if path is None:
        return hashed

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        session, wanted = None, []
        try:
            import onnxruntime

            session = onnxruntime.InferenceSession(path)
            wanted = [i.name for i in session.get_inputs()]
        except Exception:  # noqa: BLE001 - any failure of a model means the fallback
            session = None
        for batch in batches:
            out = []
            for row in batch:
                one = np.array([row], np.int64)
                given = {"input_ids": one, "attention_mask": np.ones_like(one), "token_type_ids": np.zeros_like(one)}
                try:
                    v = mean_pool(np.asarray(session.run(None, {n: given.get(n, one) for n in wanted})[0])[0], given["attention_mask"][0])[:dim]
                    v = np.pad(v, (0, dim - len(v)))
                    size = np.sqrt((v * v).sum())
                    out.append(v / size if size else v)
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.Series(out)

    return F.coalesce(run(T.model_ids(text, vocabulary or {}, longest)), hashed)


def _hashed(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """key, bucket, value of weighted texts (key, t, w)."""
    h = rows.select(key, "w", T.sha(F.col("t")).alias("h"))
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, F.col("w")).otherwise(-F.col("w"))
    return h.select(key, (T.u32(F.col("h")) % dim).cast("int").alias("bucket"), sign.alias("value"))


def _weighted(words: Column, weight: float) -> Column:
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(weight).alias("w")))


def _cut(text: Column) -> Column:
    return T.subword(T.tokens(F.coalesce(text, F.lit(""))), 6, 3)


def symbolic(symbols: DataFrame, key: str, dim: int = 128) -> DataFrame:
    """key, bucket, value of symbols (key, name, signature, kind, container, extends, implements; the last three may be missing)."""
    has = set(symbols.columns)
    parts = [_weighted(_cut(F.col("name")), NAME), _weighted(_cut(F.col("signature")), SIGNATURE), _weighted(F.array("kind"), KIND)]
    parts += [_weighted(_cut(F.col("container")), CONTAINER)] if "container" in has else []
    parts += [_weighted(F.col(c), w) for c, w in (("extends", EXTENDS), ("implements", IMPLEMENTS)) if c in has]
    # rows go by their key before they become many, so that a key's texts are summed where they are made
    rows = symbols.repartition(F.col(key)).select(key, F.explode(F.concat(*parts)).alias("x")).select(key, "x.t", "x.w")
    return _hashed(rows, key, dim).groupBy(key, "bucket").agg(F.sum("value").alias("value"))


def relational(relations: DataFrame, key: str, dim: int = 128) -> DataFrame:
    """key, bucket, value of relations (key, type, a, b), types as in RELATIONS: the pair itself, and the words of both names."""
    pair = F.when(F.col("type") == "calls", RELATIONS["calls"][0]).when(F.col("type") == "types", RELATIONS["types"][0]).when(F.col("type") == "imports", RELATIONS["imports"][0])
    word = F.when(F.col("type") == "calls", RELATIONS["calls"][1]).when(F.col("type") == "types", RELATIONS["types"][1])
    # rows go by their key before they become many, so that a key's texts are summed where they are made
    made = lambda t, w, signed: F.struct(t.alias("t"), w.alias("w"), F.lit(signed).alias("signed"))
    words = F.transform(F.concat(_cut(F.col("a")), _cut(F.col("b"))), lambda t: made(t, word, True))
    texts = F.concat(F.array(made(F.concat("a", F.lit("=>"), "b"), pair, False)), words)
    rows = relations.repartition(F.col(key)).select(key, F.explode(texts).alias("x")).select(key, "x.*").filter("w is not null")
    h = rows.select(key, "w", "signed", T.sha(F.col("t")).alias("h"))
    sign = F.when(F.col("signed") & (F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 != 0), -F.col("w")).otherwise(F.col("w"))
    return h.select(key, (T.u32(F.col("h")) % dim).cast("int").alias("bucket"), sign.alias("value")).groupBy(key, "bucket").agg(F.sum("value").alias("value"))


def embed_symbols(symbols: DataFrame, key: str, dim: int = 128) -> DataFrame:
    """key, vector of unit length."""
    return V.vectors(symbolic(symbols, key, dim), key, dim)


def embed_relations(relations: DataFrame, key: str, dim: int = 128) -> DataFrame:
    return V.vectors(relational(relations, key, dim), key, dim)


def hybrid(texts: DataFrame, structural: DataFrame, symbols: DataFrame, key: str, dim: int = 256, path: str | None = None, weight: tuple[float, float, float] = FUSION) -> DataFrame:
    """key, vector: the fused semantic (of key, text), structural (key, vector) and symbolic (of the key's symbols) embeddings; a missing one is zero."""
    a = texts.select(key, semantic(F.col("text"), dim, path).alias("_a"))
    b = structural.select(key, F.col("vector").alias("_b"))
    c = embed_symbols(symbols, key).withColumnRenamed("vector", "_c")
    none = F.array(F.lit(0.0))
    parts = [(F.coalesce(F.col(n), none), w) for n, w in zip(("_a", "_b", "_c"), weight)]
    return a.join(b, key, "left").join(c, key, "left").select(key, V.fuse(parts).alias("vector"))
