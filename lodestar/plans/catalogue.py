"""The queries of the engine, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..lineage import cut, kept
from ..operators import graph as G
from ..operators import parsing as P
from ..operators import retrieval as R
from ..operators import search as S
from ..sources import repository as REPO
from ..streaming import changes as CH
from . import roles
from .roles import table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query by its function's name; oracle: SQL that may use the roles' CTEs."""

    def add(f):
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = (f"WITH RECURSIVE {roles.DUCK}" + (", " + oracle.strip()[5:] if oracle.strip().startswith("WITH ") else oracle)).strip()
        return f

    return add


def _registered() -> None:
    """The queries of the other modules, too."""
    from . import code_queries, model_queries  # noqa: F401


def queries() -> dict:
    _registered()
    return dict(_queries)


def oracle_sql() -> dict:
    _registered()
    return dict(_oracles)


QUERY = "the of and thing le der"
NAME = "SELECT name FROM sym ORDER BY ref_id LIMIT 1"


def _codes_sql(text: str) -> str:
    return "[" + ", ".join(map(str, V.codes(V.embed_query(text, 256)))) + "]"


# -- embeddings and vectors


@query("SELECT doc_id, bucket, value FROM bucketed")
def hash_embed_buckets(spark, d):
    return V.buckets(table(spark, d, "documents"), "doc_id", "text", 256)


@query("SELECT doc_id, round(sqrt(sum(value * value)::DOUBLE), 6) AS norm FROM bucketed GROUP BY doc_id")
def hash_embed_norms(spark, d):
    return V.buckets(table(spark, d, "documents"), "doc_id", "text", 256).groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value")).cast("double")), 6).alias("norm"))


_TOP = f"""WITH m AS (SELECT *, max(abs(value)) OVER (PARTITION BY doc_id) AS most FROM bucketed),
c AS (SELECT doc_id, floor((value * 254 + most)::DOUBLE / (most * 2))::BIGINT AS code, {_codes_sql(QUERY)}[bucket + 1] AS w FROM m WHERE most > 0),
s AS (SELECT doc_id, sum(code * w)::BIGINT AS dot, sum(code * code)::BIGINT AS sq FROM c GROUP BY doc_id),
top AS (SELECT doc_id, round(CASE WHEN sq = 0 THEN 0 ELSE dot / (sqrt(sq::DOUBLE) * {sum(c * c for c in V.codes(V.embed_query(QUERY, 256))) ** 0.5!r}::DOUBLE) END, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 10)
"""


@query(_TOP + "SELECT * FROM top")
def semantic_topk(spark, d):
    return S.semantic_top_k(table(spark, d, "documents"), "doc_id", "text", QUERY)


@query(_TOP + "SELECT * FROM top")
def semantic_stored(spark, d):
    """The same over codes that went through an index's columns."""
    stored = S.coded(table(spark, d, "documents"), "doc_id", "text").select("doc_id", V.to_base64(F.col("codes")).alias("qvec_b64"))
    return S.nearest(stored.select("doc_id", V.from_base64(F.col("qvec_b64")).alias("codes")), "doc_id", QUERY)


@query(_TOP + "SELECT top.doc_id, score, CASE WHEN l.doc_id IS NULL THEN '' ELSE quality || '/' || toxic END AS refs FROM top LEFT JOIN labels l ON l.doc_id = top.doc_id")
def semantic_topk_with_refs(spark, d):
    refs = table(spark, d, "labels").select("doc_id", F.concat_ws("/", "quality", "toxic").alias("ref"))
    out = S.attach(S.semantic_top_k(table(spark, d, "documents"), "doc_id", "text", QUERY), refs, ["doc_id"], ["ref"], "ref")
    return out.withColumn("refs", F.array_join("refs", ","))


_SQ8 = """WITH q AS (SELECT vec_id, embedding, (SELECT max(abs(x::DOUBLE)) FROM (SELECT unnest(embedding) AS x)) AS m FROM embeddings),
z AS (SELECT vec_id, embedding, CASE WHEN m > 0 THEN m / 127 ELSE 1 END AS scale FROM q),
k AS (SELECT vec_id, embedding, scale, [greatest(-127, least(127, floor(x::DOUBLE / scale + 0.5)::INTEGER)) FOR x IN embedding] AS codes FROM z)
"""


@query(_SQ8 + "SELECT vec_id, round(scale, 9) AS scale, array_to_string(codes, ',') AS codes FROM k")
def sq8_quantize(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", V.quantise(F.col("embedding")).alias("s"))
    return q.select("vec_id", F.round("s.scale", 9).alias("scale"), F.array_join(F.transform("s.q", lambda x: x.cast("string")), ",").alias("codes"))


@query(_SQ8 + "SELECT vec_id, round(list_max([abs(embedding[i]::DOUBLE - codes[i] * scale) FOR i IN range(1, len(codes) + 1)]), 6) AS worst FROM k")
def sq8_roundtrip_error(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", "embedding", V.quantise(F.col("embedding")).alias("s"))
    back = F.transform("s.q", lambda x: x * F.col("s.scale"))
    return q.select("vec_id", F.round(F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b))), 6).alias("worst"))


@query(_SQ8 + "SELECT vec_id, round(list_sum([(c * scale)::FLOAT::DOUBLE FOR c IN codes]), 6) AS total FROM k")
def sq8_dequantise(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", V.quantise(F.col("embedding")).alias("s"))
    return q.select("vec_id", F.round(F.aggregate(V.dequantise(F.col("s.q"), F.col("s.scale")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(_SQ8 + "SELECT vec_id, array_to_string(codes, ',') AS codes FROM k")
def sq8_base64_roundtrip(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", V.to_base64(V.quantise(F.col("embedding"))["q"]).alias("b"))
    return q.select("vec_id", F.array_join(F.transform(V.from_base64(F.col("b")), lambda x: x.cast("string")), ",").alias("codes"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 5""")
def batch_knn(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.top_k_pairs(items.filter("id % 50 = 0"), items, 5)


@query("""WITH n AS (SELECT vec_id, [0.5 * embedding[i]::DOUBLE + 0.3 * embedding[65 - i]::DOUBLE + 0.2 * (CASE WHEN i <= 32 THEN embedding[i]::DOUBLE ELSE 0.0 END) FOR i IN range(1, 65)] AS v FROM embeddings),
m AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS l FROM n) SELECT vec_id, round(v[1] / l, 6) AS first, round(v[33] / l, 6) AS middle, round(v[64] / l, 6) AS last FROM m""")
def fuse_embeddings(spark, d):
    e = F.col("embedding")
    v = V.fuse([(e, 0.5), (F.reverse(e), 0.3), (F.slice(e, 1, 32), 0.2)])
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", *(F.round(F.col("v")[i], 6).alias(n) for i, n in ((0, "first"), (32, "middle"), (63, "last"))))


# -- content identity


_CHUNK = "SELECT doc_id, lang, 'file:' || source || chr(10) || 'kind:' || lang || chr(10) || 'name:' || doc_id || chr(10) || 'signature:' || n_chars AS text FROM documents"


def _chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", T.chunk_text(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("text"))
    return c.withColumn("content_hash", T.sha(F.col("text")))


@query(f"WITH c AS ({_CHUNK}) SELECT doc_id, sha256(c.text) AS content_hash, sha256(source || ':' || d.doc_id || ':' || d.lang || ':1:2:' || sha256(c.text)) AS ref_id FROM c JOIN documents d USING (doc_id)")
def content_ids(spark, d):
    c = _chunks(spark, d)
    return c.select("doc_id", "content_hash", T.ref_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.lit(1), F.lit(2), F.col("content_hash")).alias("ref_id"))


@query("SELECT lang, sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def content_hash_dedup(spark, d):
    return table(spark, d, "documents").groupBy("lang", T.sha(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query("SELECT DISTINCT lang, sha256(text) AS content_hash FROM documents a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.lang = a.lang AND sha256(b.text) = sha256(a.text))")
def incremental_missing_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", "lang", T.sha(F.col("text")).alias("content_hash"))
    return CH.missing_chunks(c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0")).select("lang", "content_hash")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


# -- symbol and file search


def _sym(spark, d):
    return roles.symbols(spark, d).select("ref_id", F.col("name").alias("symbol"), "lang", "kind")


@query("SELECT ref_id, name AS symbol, lang, kind FROM sym WHERE contains(name, 'red') ORDER BY symbol, ref_id LIMIT 50")
def sym_substring(spark, d):
    return S.search_symbols(_sym(spark, d), "class red", tie=["symbol", "ref_id"])


@query("SELECT ref_id, name AS symbol, lang, kind FROM sym WHERE starts_with(name, 'b') ORDER BY symbol, ref_id LIMIT 50")
def sym_prefix(spark, d):
    return S.search_symbols(_sym(spark, d), "b", "prefix", tie=["symbol", "ref_id"])


@query("SELECT ref_id, name AS symbol, lang, kind FROM sym WHERE regexp_matches(name, '^.*e.*/Brand#1.$') ORDER BY symbol, ref_id LIMIT 50")
def sym_wildcard(spark, d):
    return S.search_symbols(_sym(spark, d), "*e*/Brand#1?", tie=["symbol", "ref_id"])


@query("SELECT ref_id, name AS symbol, lang, kind FROM sym WHERE regexp_matches(name, '(?i)brand#[12]3$') ORDER BY symbol, ref_id LIMIT 50")
def sym_regex(spark, d):
    return S.search_symbols(_sym(spark, d), "brand#[12]3$", "regex", ignore_case=True, tie=["symbol", "ref_id"])


@query("SELECT ref_id, name AS symbol FROM sym WHERE name ILIKE '%BRAND%'")
def sym_ilike(spark, d):
    rows = _sym(spark, d)
    return rows.filter(S.coarse(F.col("symbol"), "BRAND", ignore_case=True)).select("ref_id", "symbol")


def _greedy(hay: str, needle: str) -> str:
    """SQL columns p1, p2 ... of a greedy match from the left, 0 where it fails, in nested queries; then the score."""
    sql = hay
    for i, c in enumerate(needle, 1):
        rest = "hay" if i == 1 else f"substr(hay, p{i - 1} + 1)"
        at = f"strpos({rest}, '{c}')"
        sql = f"SELECT *, CASE WHEN {'TRUE' if i == 1 else f'p{i - 1} > 0'} AND {at} > 0 THEN {at}{'' if i == 1 else f' + p{i - 1}'} ELSE 0 END AS p{i} FROM ({sql})"
    score = " + ".join(["1", *(f"CASE WHEN p{i} = p{i - 1} + 1 THEN 2 ELSE 1 END" for i in range(2, len(needle) + 1))])
    return f"SELECT *, ({score})::INTEGER AS score FROM ({sql}) WHERE p{len(needle)} > 0"


@query("SELECT ref_id, symbol, lang, kind, score FROM (" + _greedy("SELECT ref_id, name AS symbol, lang, kind, regexp_replace(lower(name), '[^a-z0-9_$.]', '', 'g') AS hay FROM sym", "brd3") + ") ORDER BY score DESC, symbol, ref_id LIMIT 50")
def sym_fuzzy(spark, d):
    return S.search_symbols(_sym(spark, d), "BRd3", "fuzzy", tie=["symbol", "ref_id"])


@query("SELECT ref_id, name AS symbol, lang, kind FROM sym WHERE contains(name, 'class red') AND contains(name, 'red') ORDER BY symbol, ref_id LIMIT 50")
def sym_narrowed(spark, d):
    """The query as it came narrows first, so its keyword finds nothing."""
    return S.search_symbols(_sym(spark, d), "class red", tie=["symbol", "ref_id"], narrowed=True)


@query(r"SELECT ref_id, name AS symbol, lang, kind FROM sym WHERE regexp_matches(name, '^(?:\p{L}|\s)+/') ORDER BY symbol, ref_id LIMIT 50")
def sym_regex_unicode(spark, d):
    return S.search_symbols(_sym(spark, d), r"^(?:\p{L}|\s)+/", "regex", tie=["symbol", "ref_id"])


@query("SELECT ref_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ref_id) AS n FROM sym) WHERE n <= 20")
def sym_per_lang_cap(spark, d):
    return S.cap_per(_sym(spark, d), "lang", ["ref_id"], 20).select("ref_id", "lang")


@query("SELECT page_id, file FROM urls WHERE contains(lower(file), 'p1') ORDER BY page_id, file LIMIT 50")
def file_substring(spark, d):
    return S.search_files(roles.urls(spark, d), "P1", ignore_case=True)


@query(r"SELECT page_id, file FROM urls WHERE file LIKE '%/p_\_%.py' ESCAPE '\' OR regexp_matches(file, '^.*/p.*5\.py$') ORDER BY page_id, file LIMIT 50")
def file_wildcard(spark, d):
    return S.search_files(roles.urls(spark, d), "*/p*5.py")


@query(r"SELECT page_id, file FROM urls WHERE regexp_matches(file, 'p[0-9]+\.(md|ts)$') ORDER BY page_id, file LIMIT 50")
def file_regex(spark, d):
    return S.search_files(roles.urls(spark, d), r"p[0-9]+\.(md|ts)$", "regex")


@query("SELECT page_id, file, score FROM (" + _greedy("SELECT page_id, file, file AS hay FROM urls", "p9go") + ") ORDER BY score DESC, page_id, file LIMIT 50")
def file_fuzzy(spark, d):
    return S.search_files(roles.urls(spark, d), "p9go", "fuzzy")


@query("SELECT page_id, file FROM urls WHERE starts_with(file, 'ththre') ORDER BY page_id, file LIMIT 50")
def file_prefix(spark, d):
    return S.search_files(roles.urls(spark, d), "ththre", "prefix")


@query("""SELECT page_id, CASE WHEN file LIKE '%.md' THEN 'markdown' WHEN file LIKE '%.yml' THEN 'yaml' WHEN file LIKE '%.java' THEN 'java' WHEN file LIKE '%.h' THEN 'c' WHEN file LIKE '%.go' THEN 'go'
WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.rs' THEN 'rust' ELSE 'ts' END AS lang FROM urls""")
def lang_from_path(spark, d):
    return roles.urls(spark, d).select("page_id", T.infer_lang(F.col("file")).alias("lang"))


@query(r"""SELECT page_id, CASE WHEN file LIKE '%7.h' THEN false WHEN regexp_matches(file, '/p[^/]*\.py$') THEN true WHEN file LIKE '%.py' OR file LIKE '%.md' THEN false ELSE true END AS wanted FROM urls""")
def ignore_precedence(spark, d):
    return roles.urls(spark, d).select("page_id", REPO.wanted(F.col("file"), ["**/*7.h"], ["**/p*.py"], REPO.read_patterns("# no\n\n**/*.py\n**/*.md\n!x")).alias("wanted"))


_FOLDERS = "['node_modules', '.git', '.repo', 'dist', 'target', 'build', '.gradle', '.lodestar', 'src', 'distance', 'lib'][page_id % 11 + 1]"


def _in_folders(spark, d):
    """Files in folders of which some are never scanned."""
    folder = F.element_at(F.array(*map(F.lit, ("node_modules", ".git", ".repo", "dist", "target", "build", ".gradle", ".lodestar", "src", "distance", "lib"))), (F.col("page_id") % 11 + 1).cast("int"))
    return roles.urls(spark, d).select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "a/").otherwise(""), folder, F.lit("/"), "file").alias("file"))


@query(f"WITH fo AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' ELSE '' END || {_FOLDERS} || '/' || file AS file FROM urls) SELECT page_id, page_id % 11 < 8 OR regexp_matches(file, '/(node_modules|dist|build|target)/') AS excluded FROM fo")
def base_excludes(spark, d):
    return _in_folders(spark, d).select("page_id", REPO.excluded(F.col("file")).alias("excluded"))


@query(f"""WITH fo AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' ELSE '' END || {_FOLDERS} || '/' || file AS file FROM urls)
SELECT page_id, file FROM fo WHERE page_id % 11 >= 8 AND NOT regexp_matches(file, '/(node_modules|dist|build|target)/') AND NOT file LIKE '%3.ts' AND (NOT (file LIKE 'src/%' OR file LIKE '%.py') OR file LIKE 'src/%' AND NOT file LIKE '%.txt')""")
def include_union(spark, d):
    return REPO.selected(_in_folders(spark, d), ["**/*3.ts"], REPO.read_patterns("src/\n*.py\n**/*.py"), REPO.read_patterns("/src/**\n# no", negated=True)).select("page_id", "file")


@query("SELECT page_id, file FROM urls WHERE file LIKE '%.py'")
def files_of_language(spark, d):
    return S.of_language(roles.urls(spark, d), "python")


# -- graph

_FROM = "SELECT DISTINCT e.*, s.kind AS from_kind, s.name AS from_name FROM e JOIN sym s ON s.ref_id = e.{0} AND s.lang = e.{1} UNION SELECT e.*, 'file', f.file FROM e JOIN files f ON f.file_id = e.{0} AND f.lang = e.{1}"


def _some_name(g: G.Graph) -> str:
    return (g.symbol.select("ref_id", "name").orderBy("ref_id").first() or ["", ""])[1]


@query("SELECT ref_id, file, lang, name, kind, signature, start_line, end_line FROM sym WHERE starts_with(lower(name), 'br') OR starts_with(lower(name), 's')")
def graph_find(spark, d):
    g = roles.graph(spark, d)
    return G.find(g, "BR").union(G.find(g, "s"))


@query("SELECT ref_id, name FROM sym JOIN contains_ ON child_id = ref_id WHERE parent_id = sha256('file:Brand#13')")
def graph_children(spark, d):
    import hashlib

    return G.children(roles.graph(spark, d), hashlib.sha256(b"file:Brand#13").hexdigest()).select("ref_id", "name")


@query(f"WITH e AS (SELECT * FROM refs WHERE lower(name) = lower(({NAME}))) SELECT from_id, name, from_kind, from_name, file, line FROM (" + _FROM.format("from_id", "from_lang") + ")")
def graph_refs(spark, d):
    g = roles.graph(spark, d)
    return G.references(g, _some_name(g)).select("from_id", "name", "from_kind", "from_name", "file", "line")


@query(f"WITH e AS (SELECT * FROM calls WHERE lower(callee_name) = lower(({NAME}))) SELECT caller_id, callee_name, from_kind, from_name, file, line FROM (" + _FROM.format("caller_id", "caller_lang") + ")")
def graph_callers(spark, d):
    g = roles.graph(spark, d)
    return G.callers(g, _some_name(g)).select("caller_id", "callee_name", "from_kind", "from_name", "file", "line")


@query(f"SELECT DISTINCT a.ref_id AS caller_id, b.ref_id AS callee_id, b.name AS callee_name, a.lang FROM sym a JOIN calls c ON c.caller_id = a.ref_id AND c.caller_lang = a.lang JOIN sym b ON b.name = c.callee_name AND b.lang = a.lang WHERE lower(a.name) = lower(({NAME}))")
def graph_callees(spark, d):
    g = roles.graph(spark, d)
    return G.callees(g, _some_name(g)).select("caller_id", "callee_id", "callee_name", "lang")


@query(f"""WITH r AS (SELECT DISTINCT src, dst, 1 AS depth FROM edges WHERE lang = 'l1' AND src IN (SELECT ref_id FROM sym WHERE lang = 'l1' AND lower(name) = lower((SELECT name FROM sym WHERE lang = 'l1' ORDER BY ref_id LIMIT 1)))
UNION SELECT e.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst AND e.lang = 'l1' WHERE r.depth < 3)
SELECT r.src AS caller_id, r.dst AS callee_id, depth, a.name AS caller_name, b.name AS callee_name, 'l1' AS lang FROM r JOIN sym a ON a.ref_id = r.src JOIN sym b ON b.ref_id = r.dst""")
def chain_downstream(spark, d):
    g = roles.graph(spark, d)
    name = (g.symbol.filter("lang = 'l1'").orderBy("ref_id").first() or {"name": ""})["name"]
    return G.chain(g, name, "l1")


@query(f"""WITH r AS (SELECT DISTINCT src, dst, 1 AS depth FROM edges WHERE lang = 'l2' AND dst IN (SELECT ref_id FROM sym WHERE lang = 'l2' AND lower(name) = lower((SELECT name FROM sym WHERE lang = 'l2' ORDER BY ref_id LIMIT 1)))
UNION SELECT e.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.dst = r.src AND e.lang = 'l2' WHERE r.depth < 3)
SELECT r.src AS caller_id, r.dst AS callee_id, depth, a.name AS caller_name, b.name AS callee_name, 'l2' AS lang FROM r JOIN sym a ON a.ref_id = r.src JOIN sym b ON b.ref_id = r.dst WHERE length(a.name) >= 3 AND length(b.name) >= 3""")
def chain_upstream(spark, d):
    g = roles.graph(spark, d)
    name = (g.symbol.filter("lang = 'l2'").orderBy("ref_id").first() or {"name": ""})["name"]
    return G.chain(g, name, "l2", upstream=True, min_name=3)


@query("SELECT s.lang, count(*) AS calls, count(DISTINCT c.callee_name) AS names FROM calls c JOIN sym s ON s.ref_id = c.caller_id WHERE c.line >= 2 GROUP BY s.lang")
def graph_sql(spark, d):
    sql = "SELECT s.lang, count(*) AS calls, count(DISTINCT c.callee_name) AS names FROM ast_call_name c JOIN ast_symbol s ON s.ref_id = c.caller_id WHERE c.line >= :line GROUP BY s.lang"
    return roles.graph(spark, d).sql(spark, sql, line=2)


_RANK_EDGES = """n AS (SELECT ref_id FROM sym),
byname AS (SELECT caller_id AS src, callee_name AS name FROM calls UNION SELECT from_id, name FROM refs),
e AS (SELECT DISTINCT src, s.ref_id AS dst FROM byname b JOIN sym s ON s.name = b.name WHERE src <> s.ref_id AND src IN (SELECT ref_id FROM n) AND s.ref_id IN (SELECT ref_id FROM n)),
"""
_RANKS = _RANK_EDGES + "od AS (SELECT src, count(*) AS deg FROM e GROUP BY src), k AS (SELECT count(*) AS c FROM n), p0 AS (SELECT ref_id, 1.0::DOUBLE / c AS rank FROM n, k)" + "".join(
    f""", l{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM p{i - 1} WHERE ref_id NOT IN (SELECT src FROM od)),
g{i} AS (SELECT dst, sum(rank / deg) AS got FROM e JOIN od USING (src) JOIN p{i - 1} ON ref_id = e.src GROUP BY dst),
p{i} AS (SELECT n.ref_id, 0.15 / c + 0.85 * (coalesce(got, 0) + loose / c) AS rank FROM n LEFT JOIN g{i} ON dst = n.ref_id, k, l{i})"""
    for i in range(1, 6)
)


@query("WITH " + _RANK_EDGES + "x AS (SELECT dst AS ref_id, count(*) AS in_degree FROM e GROUP BY dst) SELECT * FROM x")
def resolved_degree(spark, d):
    with kept(G.links(roles.graph(spark, d))) as linked:
        return cut(G.in_degrees(linked))


def _ranks(spark, d):
    g = roles.graph(spark, d)
    with kept(G.links(g)) as linked:
        return g, cut(G.page_rank(linked))


@query("WITH " + _RANKS + " SELECT ref_id, round(rank, 9) AS rank FROM p5")
def pagerank_symbols(spark, d):
    return _ranks(spark, d)[1].withColumn("rank", F.round("rank", 9))


@query("WITH " + _RANKS + " SELECT file, round(sum(rank), 9) AS rank, count(*) AS symbols FROM p5 JOIN sym USING (ref_id) GROUP BY file ORDER BY rank DESC, file LIMIT 20")
def repo_map_files(spark, d):
    g, ranks = _ranks(spark, d)
    return G.file_ranks(g.symbol, ranks)


@query("WITH " + _RANKS + " SELECT file, ref_id, name, rank, pos FROM (SELECT file, ref_id, name, round(rank, 9) AS rank, row_number() OVER (PARTITION BY file ORDER BY round(rank, 9) DESC, ref_id)::INTEGER AS pos FROM p5 JOIN sym USING (ref_id)) WHERE pos <= 5")
def repo_map_top_symbols(spark, d):
    g, ranks = _ranks(spark, d)
    return G.top_symbols(g.symbol, ranks).select("file", "ref_id", "name", "rank", "pos")


@query("""WITH b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT ref_id AS id FROM sym ORDER BY ref_id LIMIT 1), one AS (SELECT DISTINCT dst AS id FROM b JOIN s ON b.src = s.id WHERE dst NOT IN (SELECT id FROM s)),
two AS (SELECT DISTINCT dst AS id FROM b JOIN one ON b.src = one.id WHERE dst NOT IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM one)) SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two""")
def related_chunks_bfs(spark, d):
    g = roles.graph(spark, d)
    return G.related_symbols(g, g.symbol.select(F.col("ref_id").alias("id")).orderBy("id").limit(1))


@query("SELECT ref_id, file FROM sym WHERE file <> 'Brand#13'")
def delete_cascade(spark, d):
    return G.delete_file(roles.graph(spark, d), "Brand#13").symbol.select("ref_id", "file")


@query("SELECT parent_id, child_id FROM contains_ WHERE parent_id <> sha256('file:Brand#13') AND child_id NOT IN (SELECT ref_id FROM sym WHERE file = 'Brand#13')")
def delete_cascade_contains(spark, d):
    return G.delete_file(roles.graph(spark, d), "Brand#13").contains


@query("SELECT ref_id, name, CASE WHEN start_line % 2 = 0 THEN 'new' ELSE kind END AS kind FROM sym")
def upsert_put(spark, d):
    s = roles.symbols(spark, d).select("ref_id", "name", "kind", "start_line")
    return G.put(s.drop("start_line"), s.filter("start_line % 2 = 0").select("ref_id", "name", F.lit("new").alias("kind")), ["ref_id"])


@query("SELECT lang, count(*) AS n FROM sym GROUP BY ROLLUP (lang)")
def counts_by_lang(spark, d):
    return roles.symbols(spark, d).rollup("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE source IN ('src1', 'src3')")
def apply_changes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("file"))
    changes = spark.sql("SELECT * FROM VALUES ('M', 'src1', NULL), ('D', 'src2', NULL), ('R', 'src3', 'src2') AS t(status, path, old_path)")
    return CH.apply(rows, changes, rows.withColumn("doc_id", F.col("doc_id") + 1000000)).withColumnRenamed("file", "source")


# -- texts


@query("SELECT conv_id, turn, CASE WHEN turn BETWEEN 0 AND 2 THEN 'head' WHEN turn BETWEEN 1 AND 5 THEN 'body' WHEN turn = 6 THEN 'whole body' END AS owner FROM conversations")
def scope_assignment(spark, d):
    refs = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ref"), F.col("turn").alias("line"))
    spans = refs.select("file").distinct().select("file", F.explode(F.array(*(F.struct(F.lit(n).alias("ref_id"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(i).alias("pos")) for i, (n, a, b) in enumerate((("whole body", 1, 6), ("body", 1, 5), ("head", 0, 2)))))).alias("s")).select("file", "s.*")
    return P.assign_scopes(refs, spans).select(F.col("file").alias("conv_id"), F.col("line").alias("turn"), "owner")


def _marked(spark, d, kind):
    """Files of the documents' lines, where every fifth one begins as a header or a key."""
    n = F.col("line") - 1
    mark = F.concat(F.repeat(F.lit("#"), (n % 3 + 1).cast("int")), F.lit(" "), "text") if kind == "md" else F.concat(F.lit("key"), n.cast("string"), F.lit(": "), "text")
    return P.lines(roles.texts(spark, d)).withColumn("text", F.when(n % 5 == 1, mark).otherwise(F.col("text")))


_LINES = "WITH ln AS (SELECT file, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM texts)"
_MARKED = _LINES + ", mk AS (SELECT file, line, CASE WHEN (line - 1) % 5 = 1 THEN {0} || text ELSE text END AS text FROM ln), lastline AS (SELECT file, max(line) AS last FROM ln GROUP BY file)"


@query(_MARKED.format("repeat('#', ((line - 1) % 3 + 1)::INTEGER) || ' '") + r""", h AS (SELECT file, line, length(regexp_extract(text, '^(#{1,6})\s+(.+?)\s*#*\s*$', 1)) AS level, regexp_extract(text, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS name FROM mk WHERE regexp_matches(text, '^(#{1,6})\s+(.+?)\s*#*\s*$'))
SELECT file, name, level::INTEGER AS level, line::INTEGER AS start_line, coalesce((SELECT min(g.line) - 1 FROM h g WHERE g.file = h.file AND g.line > h.line AND g.level <= h.level), last)::INTEGER AS end_line,
(SELECT max(g.line) FROM h g WHERE g.file = h.file AND g.line < h.line AND g.level < h.level)::INTEGER AS parent_line FROM h JOIN lastline USING (file)""")
def markdown_sections(spark, d):
    return P.markdown_sections(_marked(spark, d, "md"))


_PARSED_MD = _MARKED.format("repeat('#', ((line - 1) % 3 + 1)::INTEGER) || ' '") + r""", h AS (SELECT file, line, length(regexp_extract(text, '^(#{1,6})\s+(.+?)\s*#*\s*$', 1)) AS level, regexp_extract(text, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS name FROM mk WHERE regexp_matches(text, '^(#{1,6})\s+(.+?)\s*#*\s*$')),
u AS (SELECT h.*, (SELECT max(g.line) FROM h g WHERE g.file = h.file AND g.line < h.line AND g.level < h.level) AS up FROM h),
pa AS (SELECT u.file, u.line, u.name, coalesce(c.name || ' > ', '') || coalesce(b.name || ' > ', '') || u.name AS signature FROM u LEFT JOIN u b ON b.file = u.file AND b.line = u.up LEFT JOIN u c ON c.file = u.file AND c.line = b.up)
"""


@query(_PARSED_MD + "SELECT regexp_replace(file, 'txt$', 'md') AS file, name, 'section' AS kind, signature, line::INTEGER AS start_line FROM pa UNION ALL SELECT regexp_replace(file, 'txt$', 'md'), regexp_replace(regexp_replace(file, '^.*/', ''), 'txt$', 'md'), 'document', regexp_replace(regexp_replace(file, '^.*/', ''), 'txt$', 'md'), 1 FROM lastline WHERE file NOT IN (SELECT file FROM pa)")
def parse_markdown(spark, d):
    files = _marked(spark, d, "md").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return P.parse_sources(files.withColumn("file", F.regexp_replace("file", "txt$", "md"))).select("file", "name", "kind", "signature", "start_line")


@query(_MARKED.format("'key' || (line - 1) || ': '") + r""", h AS (SELECT file, line, regexp_extract(text, '^\s*([A-Za-z0-9_.-]+)\s*:', 1) AS name FROM mk WHERE trim(text, ' ') <> '' AND NOT starts_with(trim(text, ' '), '#') AND NOT starts_with(trim(text, ' '), '-') AND regexp_matches(text, '^\s*([A-Za-z0-9_.-]+)\s*:'))
SELECT file, name, line::INTEGER AS start_line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, last)::INTEGER AS end_line FROM h JOIN lastline USING (file)""")
def yaml_keys(spark, d):
    return P.yaml_keys(_marked(spark, d, "yaml"))


@query("""WITH c AS (SELECT file, len(string_split(content, chr(10))) AS n FROM texts), s AS (SELECT file, n, unnest(range(0, n, 100)) AS a FROM c) SELECT file, (a + 1)::INTEGER AS start_line, least(a + 100, n)::INTEGER AS end_line FROM s""")
def line_chunks(spark, d):
    return P.line_chunks(roles.texts(spark, d))


@query(_LINES + """, f AS (SELECT file, line, text, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM ln WHERE line % 11 > 2)
SELECT file, min(line)::INTEGER AS start_line, max(line)::INTEGER AS end_line, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')))::BIGINT AS tokens FROM f GROUP BY file, island
HAVING sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))) >= 50""")
def fragments_islands(spark, d):
    rows = P.lines(roles.texts(spark, d))
    return P.fragments(rows, rows.filter("line % 11 <= 2"))


# -- retrieval

_ASK = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'callers of fix ' WHEN 1 THEN 'commit history of auth ' WHEN 2 THEN 'graph timeline repo ' ELSE '' END || text AS q FROM benchmark"


def _asked(spark, d):
    begin = F.when(F.col("item_id") % 4 == 0, "callers of fix ").when(F.col("item_id") % 4 == 1, "commit history of auth ").when(F.col("item_id") % 4 == 2, "graph timeline repo ").otherwise("")
    return table(spark, d, "benchmark").select("item_id", F.concat(begin, "text").alias("q"))


def _hint_sql(words):
    return " + ".join(f"contains(lower(q), '{w}')::INTEGER" for w in words)


_CLASS = f"""WITH a AS ({_ASK}), s AS (SELECT *, ({_hint_sql(R.STRUCTURAL)} + (({_hint_sql(R.SYMBOL)}) > 0)::INTEGER)::DOUBLE AS st, ({_hint_sql(R.HISTORICAL)})::DOUBLE AS hi FROM a),
v AS (SELECT item_id, q, unnest([0.5, st, hi, CASE WHEN st > 0 AND hi > 0 THEN greatest(st, hi) + 1 ELSE 0 END]::DOUBLE[]) AS sc, unnest(['semantic', 'structural', 'historical', 'hybrid']) AS kind, unnest([0, 1, 2, 3]) AS i FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, i) AS n FROM v),
c AS (SELECT item_id, any_value(q) AS q, max(kind) FILTER (n = 1) AS kind, round(least(0.95, 0.4 + max(sc) FILTER (n = 1) * 0.2 - max(sc) FILTER (n = 2) * 0.1), 6) AS confidence FROM o GROUP BY item_id)
"""


@query(_CLASS + 'SELECT item_id, kind AS "primary", confidence FROM c')
def classify_queries(spark, d):
    return _asked(spark, d).select("item_id", R.classify(F.col("q")).alias("c")).select("item_id", "c.primary", F.round("c.confidence", 6).alias("confidence"))


@query(_CLASS + """, w AS (SELECT 'semantic' AS kind, 0.65 AS a, 0.3 AS b, 0.1 AS s UNION ALL VALUES ('structural', 0.35, 0.6, 0.1), ('historical', 0.45, 0.3, 0.3), ('hybrid', 0.55, 0.4, 0.1))
SELECT item_id, round(a::DOUBLE / (a + b + s), 6) AS vector, round(b::DOUBLE / (a + b + s), 6) AS graph, round(s::DOUBLE / (a + b + s), 6) AS symbol FROM c JOIN w USING (kind)""")
def adaptive_weights(spark, d):
    w = R.weights(R.classify(F.col("q"))["primary"], accepted=F.lit("vector"))
    return _asked(spark, d).select("item_id", w.alias("w")).select("item_id", *(F.round(f"w.{s}", 6).alias(s) for s in R.SOURCES))


_PAIRS = ", ".join(f"('{k}', {i}, '{x}')" for k, xs in R._expansions().items() for i, x in enumerate(xs))


@query(_CLASS + f""", dict AS (SELECT * FROM (VALUES {_PAIRS}) AS t(tok, i, word)),
tk AS (SELECT item_id, q, unnest(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9_]+'), lambda t: t <> '')) AS tok, unnest(range(1, len(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9_]+'), lambda t: t <> '')) + 1)) AS pos FROM c),
al AS (SELECT item_id, 0 AS p1, 0 AS p2, trim(q) AS word FROM c UNION ALL SELECT item_id, pos, 0, tok FROM tk UNION ALL SELECT item_id, pos, 1 + dict.i, dict.word FROM tk JOIN dict USING (tok)
UNION ALL SELECT item_id, 1000000, 0, trim(q) || CASE kind WHEN 'historical' THEN ' history' ELSE ' graph' END FROM c WHERE kind IN ('historical', 'structural') UNION ALL SELECT item_id, 1000000, 1, trim(q) || CASE kind WHEN 'historical' THEN ' commit' ELSE ' references' END FROM c WHERE kind IN ('historical', 'structural')),
f AS (SELECT item_id, word, min(p1 * 100 + p2) AS p FROM al GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS n FROM f) SELECT item_id, string_agg(word, '|' ORDER BY n) AS expanded FROM r WHERE n <= 12 GROUP BY item_id""")
def expand_queries(spark, d):
    return _asked(spark, d).select("item_id", F.array_join(R.expand(F.col("q"), R.classify(F.col("q"))["primary"]), "|").alias("expanded"))


_CANDS = """cand AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' ELSE 'symbol' END AS source, doc_id AS id, n_chars::DOUBLE AS score, text FROM documents),
fu AS (SELECT *, round(score / greatest(max(score) OVER (PARTITION BY source), 0.0001) * CASE source WHEN 'vector' THEN 0.5 WHEN 'graph' THEN 0.4 ELSE 0.1 END, 9) AS fused FROM cand),
rk AS (SELECT *, row_number() OVER (ORDER BY fused DESC, score DESC, source, id)::INTEGER AS rank FROM fu QUALIFY rank <= 50)
"""


def _candidates(spark, d):
    source = F.when(F.col("doc_id") % 3 == 0, "vector").when(F.col("doc_id") % 3 == 1, "graph").otherwise("symbol")
    return table(spark, d, "documents").select(source.alias("source"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "text")


def _fused(spark, d):
    return R.fuse(_candidates(spark, d), dict(zip(R.SOURCES, R.WEIGHTS["hybrid"])))


@query("WITH " + _CANDS + "SELECT source, id, fused, rank FROM rk")
def fuse_results(spark, d):
    return _fused(spark, d).select("source", "id", "fused", "rank")


@query("WITH " + _CANDS + f""", tt AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS ts FROM rk),
nr AS (SELECT a.rank AS a, b.rank AS b FROM tt a JOIN tt b ON a.rank < b.rank AND a.source <> b.source AND len(a.ts) > 0 AND len(list_intersect(a.ts, b.ts)) / len(a.ts) > 0.2), bo AS (SELECT rank, count(*) AS n FROM (SELECT a AS rank FROM nr UNION ALL SELECT b FROM nr) GROUP BY rank)
SELECT *, row_number() OVER (ORDER BY final DESC, fused_rank)::INTEGER AS rank FROM (SELECT source, id, tt.rank AS fused_rank, round(fused + 0.2 * len(list_filter({QUERY.split()!r}, lambda t: list_contains(ts, t))) / {len(QUERY.split())} + 0.05 * coalesce(n, 0), 9) AS final FROM tt LEFT JOIN bo ON bo.rank = tt.rank)""")
def rerank_pairwise(spark, d):
    return R.rerank(QUERY, _fused(spark, d))


@query("WITH " + _CANDS + ", x AS (SELECT id, source, score, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi FROM cand) SELECT id, source, round(CASE WHEN hi - lo <= 0 THEN 0 ELSE (score - lo) / (hi - lo) END, 9) AS scaled FROM x")
def rerank_min_max(spark, d):
    return R.scaled(_candidates(spark, d)).select("id", "source", F.round("scaled", 9).alias("scaled"))


XML = """<manifest><remote name="a" fetch="ssh://host/x/"/><remote name="b" fetch="git@host:team/"/><default remote="a" revision="main"/><project name="p1" path="dir/p1"/><project name="p2" remote="b" revision="dev"/><project path="no-name"/></manifest>"""


@query("SELECT 'p1' AS name, 'dir/p1' AS path, 'main' AS revision, 'ssh://host/x/' AS fetch, 'ssh://host/x/p1' AS url UNION ALL VALUES ('p2', 'p2', 'dev', 'git@host:team/', 'git@host:team/p2')")
def manifest_projects(spark, d):
    return REPO.manifest_projects(spark.createDataFrame([(XML,)], "xml string"))


@query("SELECT page_id, file FROM urls WHERE regexp_matches(file, '^(.*/)?p[^/]*\\.md$') ORDER BY file LIMIT 500")
def list_files(spark, d):
    u = roles.urls(spark, d)
    return u.join(REPO.list_files(u, "**/p*.md"), "file").select("page_id", "file")


@query(_LINES + "SELECT line::INTEGER AS line, lpad(line::VARCHAR, 6, ' ') || '→' || text AS shown FROM ln WHERE file = 'doc/0.txt' AND line BETWEEN 2 AND 9")
def read_file(spark, d):
    return REPO.read_lines(roles.texts(spark, d), "doc/0.txt", 2, 9)
