"""Queries of retrieval and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval, stretches
from tessera.plans.tables import table

QUERY = ("the", "thing", "onand", "ones", "rely")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document: number, distinct number, and the longest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", retrieval.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.coalesce(F.array_max(F.transform("t", F.length)), F.lit(0)).alias("longest"))


def doc_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem frequencies over all documents, with document frequencies."""
    tf = retrieval.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that match the query, with score and confidence."""
    return retrieval.search(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, top_k=None)


def rag_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of the query."""
    return retrieval.search(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, top_k=5)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return retrieval.places(spark, table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "customer"))


def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by token hits over label and type."""
    nodes, _ = _graph(spark, sf_dir)
    score = retrieval.hit_score(F.concat_ws(" ", "label", "type"), ("asia", "nation", "12", "#000000001"))
    return nodes.select("id", "type", score.alias("score")).where("score > 0")


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and their neighbours, one hop, scores added."""
    nodes, edges = _graph(spark, sf_dir)
    hits = nodes.select("id", retrieval.hit_score(F.col("label"), ("asia", "nation_1", "000001")).alias("score")).where("score > 0")
    return retrieval.expand(hits, edges).select("id", F.round("score", 8).alias("score"))


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and summed weight per node, endpoints labelled, nodes without an edge included."""
    nodes, edges = _graph(spark, sf_dir)
    degree = retrieval.adjacency(edges).groupBy("source").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    out = nodes.join(degree, nodes["id"] == degree["source"], "left")
    return out.select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("weight", F.lit(0.0)), 4).alias("weight"))


def edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the labels of both ends, the raw id where there is none."""
    nodes, edges = _graph(spark, sf_dir)
    known = nodes.where("type <> 'customer'").select("id", "label")
    a, b = known.select(F.col("id").alias("a_id"), F.col("label").alias("a_label")), known.select(F.col("id").alias("b_id"), F.col("label").alias("b_label"))
    out = edges.join(F.broadcast(a), F.col("source") == F.col("a_id"), "left").join(F.broadcast(b), F.col("target") == F.col("b_id"), "left")
    return out.select("source", "target", F.coalesce("a_label", "source").alias("from_label"), F.coalesce("b_label", "target").alias("to_label"))


def pack_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as two packs keyed by nation and place: the first definition of an id stays."""
    customers = table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_nationkey", F.col("c_custkey") % 50).alias("id"), F.lit(0).alias("pack"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("label"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat_ws("-", "s_nationkey", F.col("s_suppkey") % 50).alias("id"), F.lit(1).alias("pack"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("label"))
    return retrieval.first_per_id(customers.unionByName(suppliers), "id", ["pack", "pos"])


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends aren't both among the nodes with a label that has no 7, and the number kept per relation."""
    nodes, edges = _graph(spark, sf_dir)
    kept, dangling = retrieval.referential(edges, nodes.where(~F.col("label").contains("7")))
    return kept.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("kept")).unionByName(dangling.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("dangling")))


def hybrid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over documents merged with a second source on the document: matched rows are boosted."""
    docs = table(spark, sf_dir, "documents")
    rag = retrieval.search(docs, "doc_id", "text", QUERY, top_k=None)
    graph = table(spark, sf_dir, "labels").select("doc_id", (F.lit(0.3) + 0.1 * F.col("quality")).alias("confidence"))
    out = retrieval.merge_sources(graph, rag, "doc_id")
    return out.select("doc_id", "source", F.round("confidence", 6).alias("confidence"))


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normalised contents per language, longest first, while they fit a budget of characters."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.md5(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))).alias("same"), F.length("text").alias("size"))
    once = retrieval.first_per_id(docs, "same", ["doc_id"])
    laid = stretches.placed(once, ["lang"], ["size", "doc_id"], "size").withColumn("used", F.col("__used"))
    return laid.where("used <= 20000").select("lang", "doc_id", "used")


def similar_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the number of stems and the share that stand for several tokens."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("token")).distinct()
    stems = words.groupBy("lang", retrieval.stem(F.col("token")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    return stems.groupBy("lang").agg(F.count(F.lit(1)).alias("stems"), F.count_if(F.col("n") > 1).alias("shared"))


QUERIES = {f.__name__: f for f in (doc_tokens, doc_tf, rag_search, rag_top, graph_query, graph_neighbours, graph_degrees, edge_labels, pack_merge, dangling_edges, hybrid_query, prompt_lines, similar_stems)}

_STEM = "CASE WHEN token LIKE '%es' AND length(token) >= 5 THEN left(token, length(token) - 2) WHEN token LIKE '%s' AND length(token) >= 4 THEN left(token, length(token) - 1) WHEN token LIKE '%ing' AND length(token) >= 6 THEN left(token, length(token) - 3) ELSE token END"


def _tokens(text: str) -> str:
    return f"list_concat(regexp_extract_all(lower({text}), '[a-z0-9]+'), regexp_extract_all(lower({text}), '[\\x{{4e00}}-\\x{{9fff}}]+'))"


_RAG = f"""
    q AS (SELECT {_STEM} AS term, count(*) AS times FROM (VALUES {', '.join(f"('{t}')" for t in QUERY)}) v(token) GROUP BY 1),
    tf AS (SELECT doc_id, {_STEM} AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL),
    f AS (SELECT tf.*, times FROM tf JOIN q USING (term)), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    s AS (SELECT doc_id, sum(ln(1 + (SELECT count(*) FROM documents) / df) * (1 + ln(1 + tf)) * times) AS raw, sum(times) AS hits FROM f JOIN df USING (term) GROUP BY doc_id),
    rag AS (SELECT doc_id, round(raw * (0.6 + 0.4 * hits / {len(QUERY)}), 4) AS score FROM s)"""
_GRAPH = """
    nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer),
    edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in' AS relation, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'of', round(c_acctbal / 10000, 6) FROM customer),
    adj AS (SELECT source, target, greatest(0.0, least(1.0, weight)) AS weight FROM edges UNION ALL SELECT target, source, greatest(0.0, least(1.0, weight)) FROM edges)"""


def _hit(text: str, query: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({text}), '{t}') THEN 1.0::DOUBLE ELSE 0.0 END" for t in query) + ")"


ORACLES = {
    "doc_tokens": f"WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents) SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, coalesce(list_max(list_transform(t, lambda x: length(x))), 0) AS longest FROM t",
    "doc_tf": f"WITH tf AS (SELECT doc_id, {_STEM} AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf) AS total, max(tf) AS most FROM tf GROUP BY term",
    "rag_search": f"WITH {_RAG} SELECT doc_id, score, round(least(0.95, 0.25 + 0.12 * score), 4) AS confidence FROM rag",
    "rag_top": f"WITH {_RAG} SELECT doc_id, score, round(least(0.95, 0.25 + 0.12 * score), 4) AS confidence FROM rag ORDER BY score DESC, doc_id LIMIT 5",
    "graph_query": f"WITH {_GRAPH} SELECT id, type, {_hit('label || chr(32) || type', ('asia', 'nation', '12', '#000000001'))} AS score FROM nodes WHERE score > 0",
    "graph_neighbours": f"""
        WITH {_GRAPH}, hits AS (SELECT id, {_hit('label', ('asia', 'nation_1', '000001'))} AS score FROM nodes WHERE score > 0),
        r AS (SELECT id, score FROM hits UNION ALL SELECT target, score * 0.5 * weight FROM hits JOIN adj ON id = source)
        SELECT id, round(sum(score), 8) AS score FROM r GROUP BY id""",
    "graph_degrees": f"WITH {_GRAPH}, d AS (SELECT source, count(*) AS degree, sum(weight) AS weight FROM adj GROUP BY source) SELECT id, label, coalesce(degree, 0) AS degree, round(coalesce(weight, 0), 4) AS weight FROM nodes LEFT JOIN d ON id = source",
    "edge_labels": f"""
        WITH {_GRAPH}, known AS (SELECT * FROM nodes WHERE type <> 'customer')
        SELECT source, target, coalesce(a.label, source) AS from_label, coalesce(b.label, target) AS to_label FROM edges LEFT JOIN known a ON a.id = source LEFT JOIN known b ON b.id = target""",
    "pack_merge": """
        WITH u AS (SELECT concat_ws('-', c_nationkey, c_custkey % 50) AS id, 0 AS pack, c_custkey AS pos, c_name AS label FROM customer UNION ALL SELECT concat_ws('-', s_nationkey, s_suppkey % 50), 1, s_suppkey, s_name FROM supplier)
        SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY pack, pos) = 1""",
    "dangling_edges": f"""
        WITH {_GRAPH}, ok AS (SELECT id FROM nodes WHERE NOT contains(label, '7')), k AS (SELECT relation, source IN (SELECT id FROM ok) AND target IN (SELECT id FROM ok) AS kept FROM edges)
        SELECT relation, count(*) AS n, CASE WHEN kept THEN 'kept' ELSE 'dangling' END AS kind FROM k GROUP BY relation, kept""",
    "hybrid_query": f"""
        WITH {_RAG}, r AS (SELECT doc_id, round(least(0.95, 0.25 + 0.12 * score), 4) AS r FROM rag), g AS (SELECT doc_id, 0.3 + 0.1 * quality AS g FROM labels)
        SELECT doc_id, CASE WHEN g IS NOT NULL AND r IS NOT NULL THEN 'both' WHEN g IS NOT NULL THEN 'graph' ELSE 'rag' END AS source,
               round(CASE WHEN g IS NOT NULL AND r IS NOT NULL THEN least(0.95, g::DOUBLE + r / 2) ELSE coalesce(g::DOUBLE, r) END, 6) AS confidence FROM g FULL JOIN r USING (doc_id)""",
    "prompt_lines": r"""
        WITH d AS (SELECT lang, doc_id, md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS same, length(text) AS size FROM documents),
        o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY same ORDER BY doc_id) = 1),
        u AS (SELECT *, sum(size) OVER (PARTITION BY lang ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM o)
        SELECT lang, doc_id, used FROM u WHERE used <= 20000""",
    "similar_stems": f"""
        WITH w AS (SELECT DISTINCT lang, unnest({_tokens('text')}) AS token FROM documents), s AS (SELECT lang, {_STEM} AS stem, count(*) AS n FROM w GROUP BY ALL)
        SELECT lang, count(*) AS stems, count_if(n > 1) AS shared FROM s GROUP BY lang""",
}
