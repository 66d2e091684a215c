"""Symbol and file search, and semantic top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def mode_of(query: str, mode: str | None = None) -> str:
    return mode or ("wildcard" if re.search(r"[*?]", query) else "substring")


def valid_regex(pattern: str) -> bool:
    """Whether the engine that runs a pattern, Java's, takes it."""
    compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    try:
        compiled.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def matches(column: Column, query: str, mode: str | None = None, ignore_case: bool = False) -> Column:
    """The filter of a search mode: substring, prefix, wildcard, regex or fuzzy. An invalid regex matches nothing."""
    mode, flag = mode_of(query, mode), "(?i)" if ignore_case else ""
    if mode == "wildcard":
        return column.rlike(flag + T.wildcard_regex(query))
    if mode == "regex":
        return column.rlike(flag + query) if valid_regex(query) else F.lit(False)
    if mode == "fuzzy":
        return T.fuzzy_score(column, query) >= 0
    hay, needle = (F.lower(column), query.lower()) if ignore_case else (column, query)
    return hay.startswith(needle) if mode == "prefix" else hay.contains(needle)


def coarse(column: Column, query: str, mode: str | None = None, ignore_case: bool = False) -> Column:
    """The candidate predicate: a LIKE on the query or its longest token."""
    mode = mode_of(query, mode)
    pattern = {"prefix": f"{query}%", "substring": f"%{query}%"}.get(mode, f"%{T.coarse_token(query)}%")
    return column.ilike(pattern) if ignore_case else column.like(pattern)


def search_symbols(rows: DataFrame, query: str, mode: str | None = None, ignore_case: bool = False, limit: int = 50, tie: list[str] | None = None, column: str = "symbol", narrowed: bool = False) -> DataFrame:
    """narrowed: only candidates of the coarse predicate on the query as it came, as a store with LIKE alone would give them."""
    rows = rows.filter(coarse(F.col(column), query, mode, ignore_case)) if narrowed else rows
    query = T.strip_keywords(query)
    found = rows.filter(matches(F.col(column), query, mode, ignore_case))
    order = [F.col(c) for c in tie or rows.columns]
    if mode_of(query, mode) == "fuzzy":
        found = found.withColumn("score", T.fuzzy_score(F.col(column), query))
        order = [F.col("score").desc(), *order]
    return found.orderBy(*order).limit(limit)


def file_predicate(pattern: str, mode: str | None = None, ignore_case: bool = False) -> Column | None:
    """A LIKE that holds for every file a pattern matches, for scans to evaluate; None for regex and fuzzy."""
    mode, file = mode_of(pattern, mode), F.col("file")
    if mode not in ("substring", "prefix", "wildcard"):
        return None
    like = T.like_pattern(pattern) if mode == "wildcard" else T.like_escaped(pattern) + "%"
    like = f"%{like}" if mode == "substring" else like
    # a plain prefix reaches the Parquet scan as a filter
    return file.ilike(like) if ignore_case else file.startswith(pattern) if mode == "prefix" else file.like(like)


def search_files(rows: DataFrame, pattern: str, mode: str | None = None, ignore_case: bool = False, limit: int = 50) -> DataFrame:
    """As for symbols, over column file; fuzzy doesn't normalise."""
    if (where := file_predicate(pattern, mode, ignore_case)) is not None:
        return rows.filter(where).orderBy(*rows.columns).limit(limit)
    if mode_of(pattern, mode) != "fuzzy":
        return rows.filter(matches(F.col("file"), pattern, mode, ignore_case)).orderBy(*rows.columns).limit(limit)
    hay, needle = (F.lower("file"), pattern.lower()) if ignore_case else (F.col("file"), pattern)
    return rows.withColumn("score", T.fuzzy_score(hay, needle, normalise=False)).filter("score >= 0").orderBy(F.col("score").desc(), *rows.columns).limit(limit)


def cap_per(rows: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    at = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= cap).drop("_n")


def select_languages(available: list[str], selector: str) -> list[str]:
    available = available or ["java", "ts"]
    if selector == "all":
        return available
    if selector == "auto":
        return next(([x] for x in T.PREFERRED if x in available), [])
    return [selector] if selector in available else []


def of_language(rows: DataFrame, lang: str) -> DataFrame:
    """Rows whose file is of a language, by its suffix; all for all and auto."""
    return rows if lang in ("all", "auto") else rows.filter(T.infer_lang(F.col("file")) == lang)


def coded(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """key, codes: 8-bit codes of the texts' hash embeddings, in whole numbers. Texts without tokens have none."""
    c = rows.select(key, V.counts(F.col(text), dim).alias("c")).withColumn("most", F.array_max(F.transform("c", F.abs))).filter("most > 0")
    code = lambda v: F.floor((v * 254 + F.col("most")) / (F.col("most") * 2)).cast("int")
    return c.select(key, F.transform("c", code).alias("codes"))


def nearest(rows: DataFrame, key: str, query: str, k: int = 10, dim: int = 256) -> DataFrame:
    """key, score: the k rows (key, codes) with the highest cosine to the query's codes. A scan that keeps k rows a task; nothing is shuffled."""
    q = V.codes(V.embed_query(query, dim))
    q_norm = sum(c * c for c in q) ** 0.5
    used = [(i, c) for i, c in enumerate(q) if c]
    dot = F.lit(0).cast("long")
    for i, c in used:
        dot = dot + F.col("codes")[i] * F.lit(c)
    sq = F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x * x)
    score = F.when(F.lit(not used) | (F.col("sq") == 0), F.lit(0.0)).otherwise(F.col("dot") / (F.sqrt(F.col("sq").cast("double")) * (q_norm or 1.0)))
    sums = rows.select(key, dot.alias("dot"), sq.alias("sq"))
    return sums.select(key, F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def semantic_top_k(rows: DataFrame, key: str, text: str, query: str, k: int = 10, dim: int = 256) -> DataFrame:
    """key, score: cosine of quantised hash embeddings, made on the way."""
    return nearest(coded(rows, key, text, dim), key, query, k, dim)


def semantic_search(chunks: DataFrame, query: str, k: int = 10, langs: list[str] | None = None, dim: int = 256) -> DataFrame:
    """lang, content_hash, score over an index's stored chunks (content_hash, lang, qvec_b64)."""
    rows = chunks.filter(F.col("lang").isin(langs)) if langs is not None else chunks
    rows = rows.select(F.struct("lang", "content_hash").alias("key"), V.from_base64(F.col("qvec_b64")).alias("codes"))
    return nearest(rows, "key", query, k, dim).select("key.lang", "key.content_hash", "score")


def attach(hits: DataFrame, refs: DataFrame, on: list[str], order: list[str], value: str, cap: int = 5) -> DataFrame:
    """hits with refs, an array of at most cap values per hit; empty where there are none."""
    near = Window.partitionBy(*on).orderBy(*order)
    few = refs.join(hits.select(*on).distinct(), on, "left_semi").withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= cap)
    lists = few.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("refs"))
    return hits.join(lists, on, "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


BLOCK = 1024


def top_k_pairs(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Cosine top-k of each query (id, v) against all items (id, v) of another id, for any number of queries.

    Rows with a null id or vector take no part. Both sides go in blocks of about BLOCK rows;
    each pair of blocks is a product of matrices that keeps k items a query. Work is queries x items.
    """
    width = max(items.agg(F.max(F.size("v"))).first()[0] or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v")
        n = max(1, -(-rows.count() // BLOCK))
        part = F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)

        def pack(b: pd.DataFrame) -> pd.DataFrame:
            v = np.zeros((len(b), width))
            for i, x in enumerate(b["v"]):
                v[i, : len(x)] = x
            size = np.sqrt((v * v).sum(1))
            unit = v / np.where(size == 0, 1, size)[:, None]
            return pd.DataFrame({name: [b[name].iloc[0]], f"{name}_ids": [b["id"].to_numpy(np.int64).tobytes()], f"{name}_v": [unit.tobytes()]})

        return rows.select(part, "id", "v").groupBy(name).applyInPandas(pack, f"{name} long, {name}_ids binary, {name}_v binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, own = (np.frombuffer(r[f"{n}_ids"], np.int64) for n in "iq")
                x, q = (np.frombuffer(r[f"{n}_v"], np.float64).reshape(-1, width) for n in "iq")
                found = []
                for me, scores in zip(own, np.floor(np.abs(s := q @ x.T) * 1e6 + 0.5) * np.sign(s)):
                    best = np.lexsort((ids, -scores))
                    found += [(int(me), int(ids[j]), float(scores[j]) / 1e6) for j in best[ids[best] != me][:k]]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "item_id", "score"])

    # one row a block: a pair of blocks is a task's unit of work, and neither side is held whole
    pairs = blocks(queries, "q").crossJoin(blocks(items, "i")).repartition(F.col("q"), F.col("i"))
    scored = pairs.mapInArrow(search, "query_id long, item_id long, score double").withColumn("score", F.round(F.col("score") + 0.0, 6))
    at = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)
