"""Adaptive retrieval: classify, expand, weigh, fuse and rerank, as columns over queries and candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..lineage import cut

#: Words that hint at a kind of query.
STRUCTURAL = ["callers", "callees", "call chain", "inherit", "extends", "implements", "graph", "references", "refs", "ast"]
HISTORICAL = ["history", "commit", "diff", "changed", "evolution", "timeline", "version", "previous"]
SYMBOL = ["function", "class", "method", "symbol", "identifier"]
#: Words that are no symbols, and file names in a query.
STOP = ["the", "and", "for", "with", "from", "into", "over", "when", "where", "what", "show"]
FILE = r"(?i)(\S+\.(?:ts|tsx|js|jsx|java|py|go|rs|c|h|md|mdx|yaml|yml))"
#: Expansions of a token.
ABBREVIATIONS = {
    "cfg": "configuration", "auth": "authentication", "repo": "repository", "svc": "service", "impl": "implementation", "dep": "dependency", "deps": "dependencies",
    "doc": "documentation", "docs": "documentation", "api": "interface", "ui": "user interface", "ux": "user experience",
}
SYNONYMS = {
    "bug": ["issue", "error", "fault"], "fix": ["resolve", "repair", "patch"], "config": ["configuration", "settings"], "search": ["lookup", "find", "query"],
    "history": ["timeline", "evolution", "past"], "commit": ["revision", "changeset"], "graph": ["relations", "edges", "call graph"], "symbol": ["identifier", "name"],
}
DOMAIN = {"lancedb": ["vector database", "lance db"], "cozo": ["graph database", "cozodb"], "ast": ["syntax tree", "abstract syntax tree"]}
#: Weights of vector, graph and symbol results.
WEIGHTS = {"semantic": (0.6, 0.3, 0.1), "structural": (0.3, 0.6, 0.1), "historical": (0.4, 0.3, 0.3), "hybrid": (0.5, 0.4, 0.1)}
SOURCES = ("vector", "graph", "symbol")


def hints(query: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a + F.lower(query).contains(w).cast("int"), words, F.lit(0))


def bound(x: Column, f) -> Column:
    """f of x, where x is worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def classify(query: Column) -> Column:
    """struct(primary, confidence)."""
    q = F.trim(query)
    named = ((hints(q, SYMBOL) > 0) | q.rlike(FILE)).cast("int")
    found = F.struct((hints(q, STRUCTURAL) + named).cast("double").alias("structural"), hints(q, HISTORICAL).cast("double").alias("historical"))

    def ranked(f: Column) -> Column:
        hybrid = F.when((f["structural"] > 0) & (f["historical"] > 0), F.greatest(f["structural"], f["historical"]) + 1).otherwise(0.0)
        scores = (("semantic", F.lit(0.5)), ("structural", f["structural"]), ("historical", f["historical"]), ("hybrid", hybrid))
        return F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores))))

    def judged(best: Column) -> Column:
        top, second = -best[0]["s"], -best[1]["s"]
        return F.struct(best[0]["n"].alias("primary"), F.when(top <= 0, 0.25).otherwise(F.least(F.lit(0.95), 0.4 + top * 0.2 - second * 0.1)).alias("confidence"))

    return bound(bound(found, ranked), judged)


#: Fixed value: what a symbol in a query looks like, between boundaries of ASCII words.
NAME = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_$.]*)(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def entities(query: Column) -> Column:
    """array<struct(type, value, confidence)>: a file name, symbols, or else the query itself."""
    q = F.trim(query)
    one = lambda kind, v, c: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(c).alias("confidence"))
    file = F.regexp_extract(q, FILE, 1)
    names = F.array_distinct(F.filter(F.regexp_extract_all(q, F.lit(NAME), F.lit(1)), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOP)))
    none = F.array().cast("array<struct<type:string,value:string,confidence:double>>")
    word = F.when((F.size(names) == 0) & (q != ""), F.array(one("keyword", q, 0.3))).otherwise(none)
    return F.concat(F.when(file != "", F.array(one("file", file, 0.8))).otherwise(none), F.transform(names, lambda n: one("symbol", n, 0.5)), word)


def _expansions() -> dict[str, list[str]]:
    keys = sorted({*ABBREVIATIONS, *SYNONYMS, *DOMAIN})
    return {k: [*([ABBREVIATIONS[k]] if k in ABBREVIATIONS else []), *SYNONYMS.get(k, []), *DOMAIN.get(k, [])] for k in keys}


def expand(query: Column, primary: Column | None = None, limit: int = 12) -> Column:
    """Up to limit distinct expansions, the query first."""
    table = F.create_map(*[x for k, v in _expansions().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    base = F.trim(query)
    more = F.flatten(F.transform(T.tokens(base), lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none))))
    out = F.concat(F.array(base), more)
    if primary is not None:
        tail = lambda *w: F.array(*(F.concat(base, F.lit(f" {x}")) for x in w))
        out = F.concat(out, F.when(primary == "historical", tail("history", "commit")).when(primary == "structural", tail("graph", "references")).otherwise(none))
    return F.when(base == "", none).otherwise(F.slice(F.array_distinct(out), 1, limit))


def weights(primary: Column, accepted: Column | None = None, bias: dict[str, float] | None = None) -> Column:
    """struct(vector, graph, symbol) that sums to 1; a total of zero or less gives the semantic weights."""
    table = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    base = F.array(*map(F.lit, WEIGHTS["semantic"]))
    more = lambda s: F.lit((bias or {}).get(s, 0.0)) + (F.when(accepted == s, 0.05).otherwise(0.0) if accepted is not None else F.lit(0.0))
    raw = F.zip_with(F.coalesce(F.try_element_at(table, primary), base), F.array(*map(more, SOURCES)), lambda a, b: a + b)

    def shared(r: Column) -> Column:
        total = r[0] + r[1] + r[2]
        return F.struct(*(F.when(total > 0, r[i] / total).otherwise(F.lit(WEIGHTS["semantic"][i])).alias(s) for i, s in enumerate(SOURCES)))

    return bound(raw, shared)


def last_of_each(candidates: DataFrame, order: str, queries: list[str] | None = None) -> DataFrame:
    """Of the candidates of a source that repeat an id the last one by a column."""
    by = [*(queries or []), "source", "id"]
    rest = [c for c in candidates.columns if c not in by]
    return candidates.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_c")).select(*by, "_c.*").select(*candidates.columns)


def fuse(candidates: DataFrame, weight: dict[str, float] | Column, limit: int = 50, queries: list[str] | None = None) -> DataFrame:
    """candidates (source, id, score, text) with fused and rank: score by its source's best (at least 1e-4) times the source's weight.

    weight: for each source, or a column struct(vector, graph, symbol). queries: columns that tell queries apart; each has limit rows."""
    queries = queries or []
    # a row a source is joined: a window would put all candidates of a source in one task
    by = [*queries, "source"]
    best = candidates.groupBy(*by).agg(F.max("score").alias("_best")).select(*(F.col(c).alias(f"_{c}") for c in by), "_best")
    most = F.greatest(F.col("_best"), F.lit(0.0001))
    one = (lambda s: weight[s]) if isinstance(weight, Column) else (lambda s: F.lit(weight[s]))
    w = reduce(lambda a, s: F.when(F.col("source") == s, one(s)).otherwise(a), SOURCES, F.lit(0.0))
    met = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))
    scored = candidates.join(best, met).withColumn("fused", F.round(F.col("score") / most * w, 9)).select(*candidates.columns, "fused")
    order = [F.col("fused").desc(), F.col("score").desc(), F.col("source"), F.col("id")]
    if not queries:
        # the first rows are found without their texts, and only theirs go to the one task that orders them
        keys = ["source", "id", "score"]
        few = scored.select(*keys, "fused").orderBy(*order).limit(limit).select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
        scored = scored.join(F.broadcast(few), reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), keys, F.lit(True)), "left_semi")
        return scored.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*queries).orderBy(*order))).filter(F.col("rank") <= limit)


def overlap(query_tokens: Column, text: Column) -> Column:
    """Share of the query's tokens, with repeats, that the text has."""

    def share(both: Column) -> Column:
        found = F.size(F.filter(both["q"], lambda t: F.array_contains(both["have"], t)))
        return F.when(F.size(both["q"]) == 0, 0.0).otherwise(found / F.size(both["q"]))

    return bound(F.struct(query_tokens.alias("q"), F.array_distinct(T.tokens(text)).alias("have")), share)


def rerank(query: str | Column, fused: DataFrame, limit: int = 50, queries: list[str] | None = None) -> DataFrame:
    """The fused rows by final: + 0.2 overlap with the query, + 0.05 for each partner of another source whose texts overlap above 0.2.

    Rows are fuse()'s, so no more than its limit meet for a query."""
    queries = queries or []
    query = F.lit(query) if isinstance(query, str) else query
    rows = fused.withColumn("toks", F.array_distinct(T.tokens(F.col("text"))))
    own = lambda n: rows.select(*(F.col(c).alias(f"{c}_{n}") for c in queries), F.col("rank").alias(f"rank_{n}"), F.col("source").alias(f"source_{n}"), F.col("toks").alias(f"toks_{n}"))
    met = reduce(lambda x, c: x & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), queries, F.lit(True))
    near = own("a").join(own("b"), met & (F.col("rank_a") < F.col("rank_b")) & (F.col("source_a") != F.col("source_b")))
    near = near.filter((F.size("toks_a") > 0) & (F.size(F.array_intersect("toks_a", "toks_b")) / F.size("toks_a") > 0.2))
    names = [F.col(f"{c}_a").alias(c) for c in queries]
    boost = near.select(*names, F.explode(F.array("rank_a", "rank_b")).alias("rank")).groupBy(*queries, "rank").agg(F.count(F.lit(1)).alias("partners"))
    score = F.col("fused") + 0.2 * overlap(T.tokens(query), F.col("text")) + 0.05 * F.coalesce("partners", F.lit(0))
    out = rows.join(boost, [*queries, "rank"], "left").select(*queries, "source", "id", F.col("rank").alias("fused_rank"), F.round(score, 9).alias("final"))
    order = Window.partitionBy(*queries).orderBy(F.col("final").desc(), "fused_rank")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def plan(queries: DataFrame, query: str, accepted: Column | None = None, bias: dict[str, float] | None = None) -> DataFrame:
    """queries with primary, confidence, entities, expanded and weights of column query."""
    q = F.col(query)
    out = queries.withColumn("_c", classify(q)).withColumn("entities", entities(q))
    out = out.withColumn("expanded", expand(q, F.col("_c.primary"))).withColumn("weights", weights(F.col("_c.primary"), accepted, bias))
    return out.select(*queries.columns, "_c.primary", "_c.confidence", "entities", "expanded", "weights")


def adaptive(queries: DataFrame, query: str, candidates: DataFrame, key: list[str], limit: int = 50) -> DataFrame:
    """The whole retrieval for each query: its plan, its candidates (key, source, id, score, text) fused by its weights, and reranked.

    key: columns that queries and candidates have in common."""
    planned = cut(plan(queries, query).select(*key, F.col(query).alias("_query"), "weights"))
    fused = fuse(candidates.join(planned, key), F.col("weights"), limit, key)
    return rerank(F.col("_query"), fused, limit, key)


def sigmoid(x: Column) -> Column:
    return F.when(x > 20, 1.0).when(x < -20, 0.0).otherwise(1 / (1 + F.exp(-x)))


def scaled(candidates: DataFrame) -> DataFrame:
    """candidates (source, score) with scaled: the score between its source's least (0) and best (1)."""
    ends = candidates.groupBy(F.col("source").alias("_source")).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    rows = candidates.join(ends, F.col("source").eqNullSafe(F.col("_source")))
    x = F.when(F.col("high") - F.col("low") <= 0, 0.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return rows.select(*candidates.columns, x.alias("scaled"))


# -- with a model's scores


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; low for null and what isn't finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), x))).otherwise(F.lit(low))


def normal_score(x: Column) -> Column:
    """x if it is from 0 to 1, else its sigmoid; 0 for what isn't finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(~finite, 0.0).when((x >= 0) & (x <= 1), x).otherwise(sigmoid(x))


def fuse_scores(original: Column, model: Column, weight: tuple[float, float]) -> Column:
    return weight[0] * normal_score(original) + weight[1] * clamp(model)


def hash_score(query: Column, content: Column, dim: int = 64) -> Column:
    """Without a model: the sigmoid of the summed hash embedding of query and content."""
    return sigmoid(V.hashed_sum(F.concat_ws(" ", query, content), dim))


def model_score(query: Column, content: Column, path: str, vocabulary: dict[str, int] | None = None, longest: int = 256) -> Column:
    """The sigmoid of an ONNX model's first output for query and content; a task loads the model once."""
    ids = T.model_ids(F.concat_ws(" ", query, content), vocabulary or {}, longest)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        wanted = [i.name for i in session.get_inputs()]
        for batch in batches:
            out = []
            for row in batch:
                one = np.array([row], np.int64)
                given = {"input_ids": one, "attention_mask": np.ones_like(one), "token_type_ids": np.zeros_like(one)}
                out.append(float(np.ravel(session.run(None, {n: given.get(n, one) for n in wanted})[0])[0]))
            yield pd.Series(out)

    return sigmoid(run(ids))


def rerank_by_model(candidates: DataFrame, query: Column, top: int = 50, weight: tuple[float, float] = (0.3, 0.7), queries: list[str] | None = None, order: list[str] | None = None, score=hash_score) -> DataFrame:
    """The first top candidates (id, content, score) of each query, by final: weight of the score, scaled between the least and
    the best of these, and of the model's; with original, model, final and rank. A pair of texts is scored once."""
    queries = queries or []
    first = Window.partitionBy(*queries).orderBy(*(order or ["id"]))
    if queries:
        rows = candidates.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max(1, top)).drop("_n")
    else:
        rows = candidates.orderBy(*(order or ["id"])).limit(max(1, top))
    rows = rows.withColumn("_q", F.trim(query)).filter("_q <> ''")
    pairs = rows.select("_q", "content").distinct().withColumn("model", clamp(score(F.col("_q"), F.col("content"))))
    rows = rows.join(pairs, ["_q", "content"])
    every = Window.partitionBy(*queries)  # top rows
    low, high = F.min("score").over(every), F.max("score").over(every)
    rows = rows.withColumn("_scaled", F.when(high - low <= 0, 0.0).otherwise((F.col("score") - low) / (high - low)))
    rows = rows.withColumn("final", weight[0] * F.col("_scaled") + weight[1] * F.col("model"))
    rows = rows.withColumn("rank", F.row_number().over(every.orderBy(F.col("final").desc(), F.col("model").desc(), "id")))
    return rows.select(*queries, "id", "content", F.col("score").alias("original"), "model", "final", "rank")
