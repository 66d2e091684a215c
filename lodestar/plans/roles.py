"""The driver's tables in the roles of an index: the same views for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes or parses a script of each.
ROWS = 10_000


def dealt(spark: SparkSession, rows: DataFrame) -> int:
    """Into how many partitions rows go: one a core, or more of about ROWS each."""
    return max(spark.sparkContext.defaultParallelism, min(10_000, -(-rows.count() // ROWS)))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        T.sha(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).alias("ref_id"), F.col("p_brand").alias("file"), F.concat(F.lit("l"), (F.col("p_size") % 4).cast("string")).alias("lang"),
        F.concat("p_name", F.lit("/"), "p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("p_name").alias("signature"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"),
    )


def graph(spark: SparkSession, d: str) -> Graph:
    """The code graph; every line calls the part of its order's next line, and refers to it."""
    s = symbols(spark, d)
    part = table(spark, d, "part")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    e = table(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").alias("line"), nxt.alias("nxt")).filter(F.col("nxt").isNotNull())
    lang = F.concat(F.lit("l"), (F.col("p_size") % 4).cast("string"))
    a = part.select(F.col("p_partkey").alias("l_partkey"), lang.alias("caller_lang"), F.col("p_brand").alias("file")).distinct()
    b = part.select(F.col("p_partkey").alias("nxt"), F.concat("p_name", F.lit("/"), "p_brand").alias("callee_name"))
    # all else of a call follows from its part, so rows are told apart before they get long; and by the part, by which they meet it
    told = e.join(b, "nxt").select("l_partkey", "callee_name", "line").repartition("l_partkey").distinct()
    call = told.join(a, "l_partkey").select(
        T.sha(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("caller_id"), "caller_lang", "callee_name", "file", "line", F.lit(1).alias("col")
    )
    ref = call.select(F.col("caller_id").alias("from_id"), F.col("caller_lang").alias("from_lang"), F.col("callee_name").alias("name"), F.lit("call").alias("ref_kind"), "file", "line", "col")
    file = s.select(T.file_id(F.col("file")).alias("file_id"), "file", "lang").distinct()
    contains = s.select(T.file_id(F.col("file")).alias("parent_id"), F.col("ref_id").alias("child_id"))
    g = Graph(s, file, contains, ref, call)
    g.same = True
    return g


#: A script for each part: {k} its key, {n} the next one, {s} its size.
SCRIPT = """import { f{n} } from './p{n}';
import base, { helper as h } from '../lib/base';

export function f{k}(a, b) {
  let total = a;
  for (const x of b) {
    if (x > {s}) {
      total += x;
    } else {
      break;
    }
  }
  switch (a) {
    case 1:
      h(total);
    case 2:
      break;
    default:
      base.run(a);
  }
  return f{n}(total) || a;
}

class C{k} extends C{n} implements I{s} {
  go(c) {
    return new C{k}(c).go(this.x ? c : {s});
  }
}
"""
BASE = "export function helper(x) {\n  return x;\n}\nexport default function run() {}\n"


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """file, content: a script of every part, and the one that they import."""
    content = F.lit(SCRIPT)
    for mark, value in (("{k}", F.col("p_partkey")), ("{n}", F.col("p_partkey") + 1), ("{s}", F.col("p_size"))):
        content = F.replace(content, F.lit(mark), value.cast("string"))
    # a file of keys is small where its scripts are many, so they are dealt out before they are made
    part = table(spark, d, "part").select("p_partkey", "p_size")
    own = part.repartition(dealt(spark, part), "p_partkey").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file"), content.alias("content"))
    return own.union(spark.createDataFrame([("lib/base/index.ts", BASE)], own.schema))


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as chunking makes them, of documents: paths nest by number, texts define their first word and refer to their words."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    path = F.slice(F.array(*map(F.lit, ("program", "class_declaration", "method_definition", "fragment"))), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.lit("function "), F.coalesce(F.try_element_at("w", F.lit(1)), F.lit("none")), F.lit("() {}\n"), F.regexp_replace("text", "[^A-Za-z ]", " "))
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), content.alias("content"), path.alias("ast_path"), F.col("source").alias("file"), F.col("doc_id").cast("int").alias("start_line"), F.col("doc_id").cast("int").alias("end_line"), F.array_distinct("w").alias("symbol_refs"), F.size("w").alias("token_count"), F.element_at(path, -1).alias("node_type"))


def urls(spark: SparkSession, d: str) -> DataFrame:
    """page_id, file: a path made of the page's address and number, with suffixes of several languages."""
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".py", ".ts", ".java", ".yml", ".go", ".rs", ".h"))), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("/p"), F.col("page_id").cast("string"), suffix).alias("file"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """file, content of documents, in lines of about a sentence."""
    return table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("content"))


DUCK = r"""
sym AS (SELECT sha256('part:' || p_partkey) AS ref_id, p_brand AS file, 'l' || (p_size % 4) AS lang, p_name || '/' || p_brand AS name, p_type AS kind, p_name AS signature, p_size AS start_line, p_size + 10 AS end_line, p_partkey FROM part),
nx AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem),
calls AS (SELECT DISTINCT a.ref_id AS caller_id, a.lang AS caller_lang, b.name AS callee_name, a.file, l_linenumber AS line, 1 AS col FROM nx JOIN sym a ON a.p_partkey = l_partkey JOIN sym b ON b.p_partkey = nxt),
refs AS (SELECT caller_id AS from_id, caller_lang AS from_lang, callee_name AS name, 'call' AS ref_kind, file, line, col FROM calls),
files AS (SELECT DISTINCT sha256('file:' || file) AS file_id, file, lang FROM sym),
contains_ AS (SELECT sha256('file:' || file) AS parent_id, ref_id AS child_id FROM sym),
edges AS (SELECT DISTINCT c.caller_id AS src, s.ref_id AS dst, c.caller_lang AS lang FROM calls c JOIN sym s ON s.name = c.callee_name AND s.lang = c.caller_lang),
urls AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '/p' || page_id || ['.md', '.py', '.ts', '.java', '.yml', '.go', '.rs', '.h'][page_id % 8 + 1] AS file FROM pages),
texts AS (SELECT 'doc/' || doc_id || '.txt' AS file, replace(text, '. ', '.' || chr(10)) AS content FROM documents),
chunks AS (SELECT 'c' || doc_id AS id, doc_id, source AS file, regexp_extract_all(text, '[A-Za-z]+') AS w, ['program', 'class_declaration', 'method_definition', 'fragment'][1:doc_id % 4 + 1] AS path,
  'function ' || coalesce(regexp_extract_all(text, '[A-Za-z]+')[1], 'none') || '() {}' || chr(10) || regexp_replace(text, '[^A-Za-z ]', ' ', 'g') AS content FROM documents),
toks AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS t FROM documents),
bucketed AS (SELECT doc_id, (u % 256)::INTEGER AS bucket, sum(CASE WHEN u % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM (SELECT doc_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT AS u FROM toks) GROUP BY ALL)
"""
