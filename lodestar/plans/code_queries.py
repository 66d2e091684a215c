"""Queries over scripts made of the parts: syntax, control and data flow, calls, imports, symbols and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut, kept
from ..operators import chunking as K
from ..operators import parsing as P
from ..operators import property_graph as X
from . import roles
from .catalogue import query

_OWN = "'src/p' || p_partkey || '.ts' AS file"


@query("""SELECT file, type, n FROM (SELECT 'src/p' || p_partkey || '.ts' AS file FROM part) CROSS JOIN (VALUES ('NEXT_STATEMENT', 10::BIGINT), ('TRUE_BRANCH', 7), ('FALSE_BRANCH', 3), ('FALLTHROUGH', 1)) AS t(type, n)
UNION ALL SELECT 'lib/base/index.ts', 'NEXT_STATEMENT', 1""")
def cfg_edges(spark, d):
    return X.edge_counts(roles.scripts(spark, d), "control")


@query("SELECT file, role, count(*) AS n FROM (SELECT 'src/p' || p_partkey || '.ts' AS file, unnest(['entry', 'exit']) AS role FROM part UNION ALL SELECT 'lib/base/index.ts', unnest(['entry', 'exit'])) GROUP BY ALL")
def cfg_ends(spark, d):
    return X.cfg_ends(roles.scripts(spark, d)).groupBy("file", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_OWN}, 'total' AS name, 5 AS def_line, '5' AS use_lines FROM part UNION ALL SELECT {_OWN}, 'total', 8, '8' FROM part UNION ALL SELECT {_OWN}, x, 4, '' FROM part, (VALUES ('a'), ('b')) AS t(x) UNION ALL SELECT {_OWN}, 'c', 25, '' FROM part UNION ALL SELECT 'lib/base/index.ts', 'x', 1, ''")
def dfg_use_lines(spark, d):
    return X.use_lines(roles.scripts(spark, d)).select("file", "name", "def_line", F.array_join(F.transform("use_lines", lambda x: x.cast("string")), ",").alias("use_lines"))


@query(f"SELECT file, type, n FROM (SELECT {_OWN} FROM part) CROSS JOIN (VALUES ('COMPUTED_FROM', 3::BIGINT), ('DEFINED_BY', 5)) AS t(type, n) UNION ALL SELECT 'lib/base/index.ts', 'DEFINED_BY', 1")
def dfg_edges(spark, d):
    return X.edge_counts(roles.scripts(spark, d), "data")


@query(f"""SELECT {_OWN}, 'f' || p_partkey AS caller, 'helper' AS callee, 15 AS line FROM part UNION ALL SELECT {_OWN}, 'f' || p_partkey, 'run', 19 FROM part UNION ALL SELECT {_OWN}, 'go', 'go', 26 FROM part
UNION ALL SELECT {_OWN}, 'f' || p_partkey, 'f' || (p_partkey + 1), 21 FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)""")
def resolved_calls(spark, d):
    scripts = roles.scripts(spark, d)
    names = X.definitions(scripts).select("id", "name")
    calls = X.call_graph(scripts)
    return calls.join(names.select(F.col("id").alias("caller"), F.col("name").alias("from")), "caller").join(names.select(F.col("id").alias("callee"), F.col("name").alias("to")), "callee").select("file", F.col("from").alias("caller"), F.col("to").alias("callee"), "line")


@query("SELECT 'CALLS' AS type, (SELECT 3 * count(*) + count(*) FILTER (p_partkey + 1 IN (SELECT p_partkey FROM part)) FROM part)::BIGINT AS n UNION ALL SELECT 'DEFINES', (3 * (SELECT count(*) FROM part) + 2)::BIGINT")
def call_layer(spark, d):
    return X.call_layer(roles.scripts(spark, d)).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_OWN}, './p' || (p_partkey + 1) AS module, 'f' || (p_partkey + 1) AS imported, 'f' || (p_partkey + 1) AS local, 'src/p' || (p_partkey + 1) AS target FROM part UNION ALL SELECT {_OWN}, '../lib/base', i, l, 'lib/base' FROM part, (VALUES ('default', 'base'), ('helper', 'h')) AS t(i, l)")
def imports(spark, d):
    return X.imports(roles.scripts(spark, d))


@query(f"SELECT {_OWN}, './p' || (p_partkey + 1) AS module, 'f' || (p_partkey + 1) AS symbols FROM part UNION ALL SELECT {_OWN}, '../lib/base', 'default,helper' FROM part")
def import_symbols(spark, d):
    return X.import_symbols(roles.scripts(spark, d)).withColumn("symbols", F.array_join("symbols", ","))


@query("SELECT 'src/p' || p_partkey AS target, 'src/p' || p_partkey || '.ts' AS file FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part) UNION ALL SELECT 'lib/base', 'lib/base/index.ts'")
def module_files(spark, d):
    scripts = roles.scripts(spark, d)
    return X.module_files(X.imports(scripts), scripts)


@query("SELECT 'IMPORTS' AS type, 2 * count(*) AS n FROM part")
def import_layer(spark, d):
    return X.import_layer(roles.scripts(spark, d)).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_OWN}, true AS tree FROM part UNION ALL SELECT 'lib/base/index.ts', true")
def ast_edges(spark, d):
    """Of each file: every node but the root has one parent, and every leaf but the last one a next one."""
    scripts = roles.scripts(spark, d)
    e = X.edge_counts(scripts, "syntax").groupBy("file").agg(*(F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(n) for t, n in (("CHILD", "child"), ("NEXT_TOKEN", "next"))))
    leaves = X.node_counts(scripts)
    return e.join(leaves, "file").select("file", ((F.col("child") == F.col("nodes") - 1) & (F.col("next") == F.col("leaves") - 1)).alias("tree"))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['function', 'class', 'method']) AS kind FROM part UNION ALL SELECT unnest(['function', 'function'])) GROUP BY kind")
def merged_layers(spark, d):
    """The last layer's node stands for those of one id: definitions twice are the second ones."""
    layer = X.call_layer(roles.scripts(spark, d))
    again = X.Layer(layer.nodes.withColumn("label", F.concat(F.lit("again "), "label")), layer.edges)
    return X.merged([layer, again]).nodes.filter("label like 'again %' and kind <> 'module'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# -- symbols and the index's tables


@query(f"""SELECT {_OWN}, 'f' || p_partkey AS name, 'function' AS kind, 4 AS start_line, 22 AS end_line FROM part UNION ALL SELECT {_OWN}, 'C' || p_partkey, 'class', 24, 28 FROM part UNION ALL SELECT {_OWN}, 'go', 'method', 25, 27 FROM part
UNION ALL VALUES ('lib/base/index.ts', 'helper', 'function', 1, 3), ('lib/base/index.ts', 'run', 'function', 4, 4)""")
def parse_sources(spark, d):
    return P.parse_sources(roles.scripts(spark, d)).filter("row = 'symbol'").select("file", "name", "kind", "start_line", "end_line")


def _tables(spark, d):
    return P.index_rows(P.parse_sources(roles.scripts(spark, d)))


def _indexed(spark, d, make):
    """make of an index's tables, whose files are parsed once."""
    with kept(P.parse_sources(roles.scripts(spark, d))) as parsed:
        return cut(make(P.index_rows(parsed)))


@query(f"""WITH c AS (SELECT p_partkey, {_OWN}, unnest([('h', 15), ('run', 19), ('f' || (p_partkey + 1), 21), ('go', 26)]) AS x FROM part) SELECT file, x[1] AS callee_name, CASE WHEN x[2] = 26 THEN 'go' ELSE 'f' || p_partkey END AS caller, x[2]::INTEGER AS line FROM c UNION ALL SELECT {_OWN}, 'C' || p_partkey, 'go', 26 FROM part""")
def parsed_call_graph(spark, d):
    return _indexed(spark, d, lambda t: t["ast_call_name"].join(t["ast_symbol"].select(F.col("ref_id").alias("caller_id"), F.col("name").alias("caller")), "caller_id").select("file", "callee_name", "caller", "line"))


@query("SELECT 'C' || p_partkey AS class, 'extends' AS how, 'C' || (p_partkey + 1) AS name FROM part UNION ALL SELECT 'C' || p_partkey, 'implements', 'I' || p_size FROM part")
def parsed_heritage(spark, d):
    def made(t):
        both = t["ast_extends_name"].select("sub_id", F.lit("extends").alias("how"), F.col("super_name").alias("name")).union(t["ast_implements_name"].select("sub_id", F.lit("implements"), "iface_name"))
        return both.join(t["ast_symbol"].select(F.col("ref_id").alias("sub_id"), F.col("name").alias("class")), "sub_id").select("class", "how", "name")

    return _indexed(spark, d, made)


@query(f"""SELECT {_OWN}, 'C' || p_partkey AS parent, 'go' AS child FROM part UNION ALL SELECT {_OWN}, 'file', x || p_partkey FROM part, (VALUES ('f'), ('C')) AS t(x) UNION ALL VALUES ('lib/base/index.ts', 'file', 'helper'), ('lib/base/index.ts', 'file', 'run')""")
def parsed_contains(spark, d):
    def made(t):
        names = t["ast_symbol"].select("ref_id", "name", "file")
        child = t["ast_contains"].join(names.select(F.col("ref_id").alias("child_id"), F.col("name").alias("child"), "file"), "child_id")
        return child.join(names.select(F.col("ref_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("file", F.coalesce("parent", F.lit("file")).alias("parent"), "child")

    return _indexed(spark, d, made)


@query("""WITH s AS (SELECT 'src/p' || p_partkey || '.ts' AS file, unnest([('f' || p_partkey, 'function', 'function f' || p_partkey || '(a, b)'), ('C' || p_partkey, 'class', 'class C' || p_partkey), ('go', 'method', 'go(c)')]) AS x FROM part
UNION ALL SELECT 'lib/base/index.ts', unnest([('helper', 'function', 'function helper(x)'), ('run', 'function', 'function run()')])),
c AS (SELECT DISTINCT 'file:' || file || chr(10) || 'kind:' || x[2] || chr(10) || 'name:' || x[1] || chr(10) || 'signature:' || x[3] AS text FROM s),
tk AS (SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS t FROM c), bk AS (SELECT text, (u % 256)::INTEGER AS b, sum(CASE WHEN u % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT text, ('0x' || substr(sha256(t), 1, 8))::BIGINT AS u FROM tk) GROUP BY ALL),
m AS (SELECT text, max(abs(v))::DOUBLE AS m, sqrt(sum(v * v)::DOUBLE) AS l FROM bk GROUP BY text) SELECT 'ts' AS lang, sha256(text) AS content_hash, 256 AS dim, round(m / l / 127, 9) AS scale FROM m""")
def index_chunks(spark, d):
    return _tables(spark, d)["chunks"].select("lang", "content_hash", "dim", F.round("scale", 9).alias("scale"))


@query("""SELECT name, n FROM (SELECT count(*) AS p FROM part), (VALUES ('ast_file', 1, 1), ('ast_symbol', 3, 2), ('ast_contains', 3, 2), ('ast_extends_name', 1, 0), ('ast_implements_name', 1, 0), ('refs', 3, 2), ('chunks', 3, 2), ('ast_call_name', 5, 0)) AS t(name, per, more), LATERAL (SELECT (p * per + more)::BIGINT AS n)""")
def index_tables(spark, d):
    def made(t):
        out = None
        for name, df in t.items():
            if name != "ast_ref_name":
                one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
                out = one if out is None else out.union(one)
        return out

    return _indexed(spark, d, made)


# -- chunks


@query(f"SELECT {_OWN}, 'class_declaration' AS node_type, 24 AS start_line, 28 AS end_line, 18 AS token_count FROM part UNION ALL SELECT {_OWN}, 'fragment', 1, 23, 61 FROM part")
def ast_chunks(spark, d):
    return K.chunks(roles.scripts(spark, d)).select("file", "node_type", "start_line", "end_line", "token_count")


@query("SELECT coalesce(sum(len(w)), 0)::BIGINT AS total_tokens, count(*) AS total_chunks FROM chunks")
def chunk_totals(spark, d):
    return K.totals(roles.code_chunks(spark, d))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, id) AS pos FROM chunks) SELECT a.id AS child, arg_min(b.id, b.pos) AS parent FROM c a JOIN c b ON b.file = a.file AND b.pos < a.pos AND len(b.path) < len(a.path) AND a.path[1:len(b.path)] = b.path GROUP BY a.id")
def chunk_parents(spark, d):
    return K.parents(roles.code_chunks(spark, d))


_DEFS = r"""de AS (SELECT id, unnest(list_distinct(list_concat(regexp_extract_all(content, 'function\s+(\w+)', 1), regexp_extract_all(content, 'class\s+(\w+)', 1), regexp_extract_all(content, '(\w+)\s*\([^)]*\)\s*\{', 1)))) AS name FROM chunks)"""


@query(f"WITH {_DEFS}, rf AS (SELECT DISTINCT id, unnest(w) AS name FROM chunks) SELECT DISTINCT rf.id AS caller, de.id AS callee FROM rf JOIN de USING (name) WHERE rf.id <> de.id")
def chunk_calls(spark, d):
    return K.calls(roles.code_chunks(spark, d))


@query("SELECT file, string_agg(id, ',' ORDER BY doc_id, id) AS ids FROM chunks GROUP BY file")
def chunks_by_file(spark, d):
    return K.ids_by(roles.code_chunks(spark, d), "file").withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {_DEFS} SELECT id, 'defines' AS how FROM de WHERE name = 'The' UNION ALL SELECT id, 'refers' FROM chunks WHERE list_contains(w, 'The')")
def chunks_of_symbol(spark, d):
    c = roles.code_chunks(spark, d)
    return K.defining(c, "The").select("id", F.lit("defines").alias("how")).union(K.referencing(c, "The").select("id", F.lit("refers")))


_AROUND = f"""WITH {_DEFS}, rf AS (SELECT DISTINCT id, unnest(w) AS name FROM chunks), ca AS (SELECT DISTINCT rf.id AS src, de.id AS dst FROM rf JOIN de USING (name) WHERE rf.id <> de.id),
cp AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, id) AS pos FROM chunks), pa AS (SELECT arg_min(b.id, b.pos) AS src, a.id AS dst FROM cp a JOIN cp b ON b.file = a.file AND b.pos < a.pos AND len(b.path) < len(a.path) AND a.path[1:len(b.path)] = b.path GROUP BY a.id),
ed AS (SELECT src, dst FROM ca UNION SELECT dst, src FROM ca UNION SELECT src, dst FROM pa UNION SELECT dst, src FROM pa), one AS (SELECT DISTINCT dst AS id FROM ed WHERE src = 'c3' AND dst <> 'c3'), two AS (SELECT DISTINCT dst AS id FROM ed WHERE src IN (SELECT id FROM one) AND dst <> 'c3' AND dst NOT IN (SELECT id FROM one))"""


@query(_AROUND + " SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two")
def related_chunks(spark, d):
    return K.related(roles.code_chunks(spark, d), spark.createDataFrame([("c3",)], "id string"))


@query()
def forced_split(spark, d):
    return P.forced_split(roles.texts(spark, d))

