"""Queries of trails, loaded rule packs, masks and spread samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rules, trails
from tessera.plans import decide
from tessera.plans.measure import pixel_rows
from tessera.plans.tables import ORDER_METRICS, order_metrics, table
from tessera.sources import rule_files

MASKS = (("face", 0.9, 1, 3, 1, 3), ("sky", 0.55, 0, 1, 0, 7), ("edge", 0.8, 7, 7, 0, 2), ("none", 1.0, 9, 9, 9, 9))


def rules_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack written as JSON records, loaded, checked and applied over per-order metrics."""
    records = json.loads(json.dumps([rule_files.to_record(r) for r in rules.PACK]))
    pack = rule_files.load_rules(spark, records, set(ORDER_METRICS))
    found = rules.apply(order_metrics(spark, sf_dir), "o_orderkey", ORDER_METRICS, pack)
    return found.select("o_orderkey", "param", "rule_id", F.round("new_value", 6).alias("new_value"))


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines as its trace, flattened to fixed columns; one of them no event has."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_tax")).alias("trace"))
    return trails.trace_rows(lines, "l_orderkey", "trace", ["l_linenumber", "l_returnflag", "note"])


def timeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events, distinct iterations, first and last event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.get_json_object("props", "$.k").alias("k"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("k").alias("iterations"), F.min_by("event_type", "at").alias("opened"), F.max_by("event_type", "at").alias("state"))


def decide_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as decisions: iteration by whole values over 50, by small metadata, else by place in the user's trace."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    found = trails.iterations(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.when(F.col("value") > 50, F.floor("value")), F.when(F.col("k") < 40, F.col("k")))
    return found.select("event_id", F.col("iteration").cast("long").alias("iteration"))


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose price gains enough on the line before."""
    before = F.lag("l_extendedprice").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", before.alias("before"))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", trails.promotes(F.col("l_extendedprice"), F.col("before"), 500.0, 0.1).alias("promoted"))


def sticky_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, where the event type changes and for how many events it has stood."""
    return trails.sticky(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "reset", "age")


def masked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four masks over every image: area, reliability, mean and clipped share."""
    return trails.regions(pixel_rows(spark, sf_dir), MASKS, "vec_id", "v").withColumn("mean_luminance", F.round("mean_luminance", 1))


def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents per source by length, ends included, and all under 40 characters."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return trails.spread_sample(rows, ["source"], ["n_chars", "doc_id"], 5, F.col("n_chars") < 40)


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with an order, not only the first."""
    rows = table(spark, sf_dir, "orders")
    found = trails.all_reasons((F.col("o_totalprice") < 50_000, "cheap"), (F.col("o_orderstatus") != "F", "open"), (F.col("o_orderpriority").like("5-%"), "low"))
    return rows.select("o_orderkey", F.array_join(found, ",").alias("reasons"), F.size(found).alias("n"))


def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint per part of its name, its sorted marks and its size."""
    return table(spark, sf_dir, "part").select("p_partkey", trails.request_fingerprint(F.col("p_name"), F.array("p_type", "p_brand"), F.col("p_size").cast("string")).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (rules_loaded, trace_rows, timeline_report, decide_iterations, promotions, sticky_states, masked_regions, spread_sample, order_violations, request_fingerprints)}

ORACLES = {
    "rules_loaded": decide.ORACLES["rules_apply"],
    "trace_rows": "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(NULL AS VARCHAR) AS note FROM lineitem",
    "timeline_report": "SELECT user_id, count(*) AS events, count(DISTINCT json_extract_string(props, '$.k')) AS iterations, arg_min(event_type, (ts, event_id)) AS opened, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id",
    "decide_iterations": """
        WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CAST(CASE WHEN value > 50 THEN floor(value) WHEN k < 40 THEN k ELSE place END AS BIGINT) AS iteration FROM e WHERE event_type = 'purchase'""",
    "promotions": """
        WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(l_extendedprice - b >= greatest(500.0, 0.1 * abs(b)), false) AS promoted FROM l""",
    "sticky_states": """
        WITH e AS (SELECT user_id, event_id, ts, row_number() OVER w AS n, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, reset, n - max(CASE WHEN reset THEN n END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age FROM e""",
    "masked_regions": f"""
        WITH m AS (SELECT * FROM (VALUES {', '.join(str(m) for m in MASKS)}) v(mask_id, confidence, y0, y1, x0, x1)),
            p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) * 300 + 127.5 AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
            a AS (SELECT vec_id, mask_id, CAST(confidence AS DOUBLE) AS confidence, count(*) AS total, count(*) FILTER (inside) AS n, avg(v) FILTER (inside) AS mean, count(*) FILTER (inside AND v >= 250) AS clipped
                  FROM (SELECT *, y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 AS inside FROM p, m) GROUP BY ALL)
        SELECT vec_id, mask_id, confidence, round(n / total, 6) AS area_ratio, n > 0 AND confidence >= 0.6 AND n / total >= 0.005 AS reliable, round(round(mean, 2), 1) AS mean_luminance, round(coalesce(clipped / nullif(n, 0), 0.0), 6) AS highlight_clip_ratio FROM a""",
    "spread_sample": """
        WITH d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
        SELECT source, doc_id, n_chars FROM d WHERE n <= 5 OR i IN (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1) OR n_chars < 40""",
    "order_violations": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus <> 'F' THEN 'open' END, CASE WHEN o_orderpriority LIKE '5-%' THEN 'low' END) AS reasons, CAST(o_totalprice < 50000 AS INT) + CAST(o_orderstatus <> 'F' AS INT) + CAST(o_orderpriority LIKE '5-%' AS INT) AS n FROM orders",
    "request_fingerprints": "SELECT p_partkey, sha256(coalesce(p_name, '') || '|' || array_to_string(list_sort([p_type, p_brand]), ',') || '|' || coalesce(CAST(p_size AS VARCHAR), '')) AS fingerprint FROM part",
}
