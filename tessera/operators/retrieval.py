"""Retrieval: tokens and stems, TF-IDF search, graph expansion and the merge of both."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.toning import bound
from tessera.sources.shared import shared_path


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, then runs of CJK characters."""
    low = F.lower(text)
    return F.concat(F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), F.lit(1)), F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1)))


def stem(token: Column) -> Column:
    """Without the first of es, s, ing that leaves three letters or more."""
    size = F.length(token)

    def cut(n: int) -> Column:
        return F.substring(token, F.lit(1), size - n)

    return F.when(token.endswith("es") & (size >= 5), cut(2)).when(token.endswith("s") & (size >= 4), cut(1)).when(token.endswith("ing") & (size >= 6), cut(3)).otherwise(token)


def term_frequencies(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) by stems."""
    words = documents.select(key, F.explode(tokens(F.col(text))).alias("token"))
    return words.groupBy(key, stem(F.col("token")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def search(documents: DataFrame, key: str, text: str, query: Sequence[str], top_k: int | None = 5) -> DataFrame:
    """(key, score, confidence) by inverse document frequency times log frequency over the query's terms, scaled by coverage.

    Only the query's terms are counted, in one pass over the texts that tokenises each once: other stems are left out where they
    arise, and each document has at most one row per query term, made in place. These few rows are written to the shared folder
    and serve the frequencies and the scores. Keys are unique.
    """
    times = Counter(_stem_of(t.lower()) for t in query)
    total = max(1, documents.count())
    stems = F.filter(F.transform(tokens(F.col(text)), stem), lambda t: t.isin(list(times)))
    counts = bound(stems, lambda found: F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.size(F.filter(found, lambda s: s == t)).alias("tf"))))
    rows = documents.select(key, F.explode(counts).alias("t")).select(key, "t.*")
    path = shared_path(documents.sparkSession, "search")
    rows.write.parquet(path)
    found = documents.sparkSession.read.schema(rows.schema).parquet(path)
    # One row per query term at most.
    frequency = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    known = F.create_map(*[F.lit(x) for t in times for x in (t, math.log(1 + total / max(frequency.get(t, 0), 1)))])
    asked = F.create_map(*[F.lit(x) for t, n in times.items() for x in (t, n)])
    gain = F.try_element_at(known, F.col("term")) * (1 + F.ln(1 + F.col("tf"))) * F.try_element_at(asked, F.col("term"))
    scored = found.groupBy(key).agg(F.sum(gain).alias("raw"), F.sum(F.try_element_at(asked, F.col("term"))).alias("hits"))
    score = F.round(F.col("raw") * (0.6 + 0.4 * F.col("hits") / F.lit(max(1, len(query)))), 4)
    out = scored.select(key, score.alias("score"), F.round(F.least(F.lit(0.95), 0.25 + 0.12 * score), 4).alias("confidence"))
    return out if top_k is None else out.orderBy(F.desc("score"), key).limit(top_k)


def _stem_of(token: str) -> str:
    """stem() of one token, for the query."""
    for ending, least in (("es", 5), ("s", 4), ("ing", 6)):
        if token.endswith(ending) and len(token) >= least:
            return token[: len(token) - len(ending)]
    return token


def hit_score(text: Column, query: Sequence[str]) -> Column:
    """One per query token that the text contains, 0.2 for a single CJK character."""
    low = F.lower(text)
    out = F.lit(0.0)
    for token in query:
        one = 0.2 if len(token) == 1 and "一" <= token <= "鿿" else 1.0
        out = out + F.when(low.contains(token.lower()), one).otherwise(0.0)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of (source, target, weight), weights cut to 0..1."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight"))
    return edges.select("source", "target", weight.alias("weight")).unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), weight.alias("weight")))


def expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score) of the hits and their neighbours: a neighbour gains half of score times weight from each hit, all at once."""
    reached = hits.join(adjacency(edges), F.col("id") == F.col("source")).select(F.col("target").alias("id"), (F.col("score") * 0.5 * F.col("weight")).alias("score"))
    return hits.select("id", "score").unionAll(reached).groupBy("id").agg(F.sum("score").alias("score"))


def referential(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dangling): edges of which both ends exist, and the others."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")
    return kept, edges.join(kept.select("source", "target"), ["source", "target"], "left_anti")


def first_per_id(nodes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Union of packs: the first definition of an id stays."""
    return nodes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def merge_sources(graph: DataFrame, rag: DataFrame, on: str) -> DataFrame:
    """(on, source, confidence): rows of both sources are joined on content; matches are `both` with graph plus half of rag, to 0.95."""
    joined = graph.select(on, F.col("confidence").alias("g")).join(rag.select(on, F.col("confidence").alias("r")), on, "full")
    source = F.when(F.col("g").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("g").isNotNull(), "graph").otherwise("rag")
    both = F.round(F.least(F.lit(0.95), F.col("g") + F.col("r") / 2), 6)
    return joined.select(on, source.alias("source"), F.when(source == "both", both).otherwise(F.coalesce("g", "r")).alias("confidence"))


def places(spark: SparkSession, nation: DataFrame, region: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph of nations, regions and customers: (nodes id, type, label), (edges source, target, relation, weight)."""
    nodes = (
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("label"))
        .unionAll(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("nation"), F.col("n_name")))
        .unionAll(customer.select(F.concat(F.lit("c"), "c_custkey"), F.lit("customer"), F.col("c_name")))
    )
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in").alias("relation"), F.lit(1.0).alias("weight"))
    edges = edges.unionAll(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit("of"), F.round(F.col("c_acctbal") / 10000, 6)))
    return nodes, edges
