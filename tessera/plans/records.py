"""Queries of prompts within a budget, snapshot changes, boxes, positions, labels, strides, lookup weights and name sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import records, stretches
from tessera.plans.tables import table


def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the surest document texts as prompt lines within the budget; confidence by length."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text", (F.col("n_chars") % 97 / 97).alias("conf"))
    found = records.prompt(docs, "source", "lang", "text", "conf", "doc_id")
    return found.select("source", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("digest"))


def advice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation one line from its last turn, cut."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct(F.col("role").alias("source"), F.col("turn").cast("string").alias("ref"), F.col("text").alias("content")), F.struct("turn", "role", "text")).alias("top"))
    return last.select("conv_id", records.advice(F.array("top")).alias("line"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes from line to line of an order, as a summary of at most four names."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    names = ("l_discount", "l_linestatus", "l_quantity", "l_returnflag", "l_tax", "l_suppkey")
    cells = [x for n in names for x in (F.lit(n), (F.format_string("%.2f", F.col(n).cast("double")) if n in ("l_discount", "l_quantity", "l_tax") else F.col(n).cast("string")))]
    rows = table(spark, sf_dir, "lineitem").withColumn("now", F.create_map(*cells))
    rows = rows.withColumn("was", F.lag("now").over(w)).where(F.col("was").isNotNull())
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", records.change_summary(F.col("was"), F.col("now")).alias("summary"))


def main_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main box of every embedding, its first eight components as a face and a subject; a third has no face."""
    e = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))

    def box(k: int):
        return F.array(*[F.element_at("e", k + i) + (0.15 if i > 2 else 0.0) for i in range(1, 5)])

    faces = F.when(F.col("vec_id") % 3 > 0, F.array(box(0), box(8))).otherwise(F.array().cast("array<array<double>>"))
    found = records.main_box(faces, F.array(box(4)))
    return rows.select("vec_id", *[F.round(F.element_at(found, i), 6).alias(n) for i, n in enumerate("ltrb", 1)])


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at places: angles by price and key, some missing, some heights below the sea."""
    o = table(spark, sf_dir, "orders")
    at = records.position(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 7000), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey") / 9), F.col("o_totalprice") / 100, F.when(F.col("o_orderstatus") == "F", " 1"))
    return o.select("o_orderkey", at.alias("at")).select("o_orderkey", *[F.col(f"at.{c}").alias(c) for c in ("lat", "lon", "altitude")])


def photo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's label and reasons by its measures, counted per return flag."""
    label, reasons = records.photo_label(F.col("l_extendedprice") / 300, F.col("l_discount") * 4, F.col("l_quantity") / 3, F.col("l_tax"), F.col("l_linenumber") / 25.0)
    found = table(spark, sf_dir, "lineitem").select("l_returnflag", label.alias("label"), F.array_join(reasons, ",").alias("reasons"))
    return found.groupBy("l_returnflag", "label", "reasons").agg(F.count(F.lit(1)).alias("lines"))


def strided_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type at most 200 events, evenly strided in the order of their ids."""
    ranked = stretches.placed(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])
    return ranked.where(records.strided(F.col("__place"), F.col("__size"), 200)).select("event_type", "event_id")


PRICE_KNOTS = (1000.0, 50_000.0, 120_000.0, 250_000.0)


def lookup_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of four price knots summed per order status: a lookup as a sparse linear form."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.explode(records.knot_weights(F.col("o_totalprice"), PRICE_KNOTS)).alias("w"))
    return rows.groupBy("o_orderstatus", F.col("w.knot").alias("knot")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("w.weight"), 3).alias("weight"))


MARKERS = (("//", "link"), ("@", "address"), ("the ", "english"), (" der ", "german"))


def marked_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first marker in their text."""
    return table(spark, sf_dir, "documents").select("doc_id", records.marked_kind(F.col("text"), MARKERS, "other").alias("kind"))


def same_status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's flags stay the same set when open lines count as N; sets of at most three values."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.lit("N")).otherwise(F.col("l_returnflag"))).alias("b"))
    return sets.select("l_orderkey", records.same_members(F.col("a"), F.col("b")).alias("same"))


QUERIES = {f.__name__: f for f in (prompt_budget, advice_lines, snapshot_changes, main_boxes, positions, photo_labels, strided_populations, lookup_weights, marked_kinds, same_status_sets)}

_NAMES = (("l_discount", "printf('%.2f', l_discount)"), ("l_linestatus", "l_linestatus"), ("l_quantity", "printf('%.2f', CAST(l_quantity AS DOUBLE))"), ("l_returnflag", "l_returnflag"), ("l_suppkey", "CAST(l_suppkey AS VARCHAR)"), ("l_tax", "printf('%.2f', l_tax)"))
_SQUEEZED = "trim(regexp_replace(coalesce({c}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


def _box(k: int) -> str:
    return f"[abs(CAST(embedding[{k + 1}] AS DOUBLE)), abs(CAST(embedding[{k + 2}] AS DOUBLE)), abs(CAST(embedding[{k + 3}] AS DOUBLE)) + 0.15, abs(CAST(embedding[{k + 4}] AS DOUBLE)) + 0.15]"


ORACLES = {
    "prompt_budget": f"""
        WITH RECURSIVE d AS (SELECT source, doc_id, {_SQUEEZED.format(c="lang")} AS label, {_SQUEEZED.format(c="text")} AS content, coalesce(n_chars % 97 / 97, 0.0) AS conf FROM documents),
        o AS (SELECT * FROM d WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY source, lower(content) ORDER BY conf DESC, doc_id) = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY conf DESC, doc_id) AS n FROM o QUALIFY n <= 5),
        l AS (SELECT source, n, '[' || CASE WHEN label <> '' THEN label ELSE '知识' END || '] ' || content || printf(' (conf=%.2f)', conf) AS line FROM t),
        f AS (SELECT source, 0::BIGINT AS n, '' AS p FROM (SELECT DISTINCT source FROM l) UNION ALL
              SELECT f.source, l.n, CASE WHEN 1200 - length(p) - (p <> '')::INT <= 0 THEN p ELSE p || CASE WHEN p = '' THEN '' ELSE chr(10) END
                     || CASE WHEN length(line) <= 1200 - length(p) - (p <> '')::INT THEN line ELSE rtrim(line[1:1199 - length(p) - (p <> '')::INT], ' ') || '…' END END
              FROM f JOIN l ON l.source IS NOT DISTINCT FROM f.source AND l.n = f.n + 1)
        SELECT source, length(arg_max(p, n)) AS chars, sha256(arg_max(p, n)) AS digest FROM f GROUP BY source""",
    "advice_lines": "SELECT conv_id, '综合建议（来源 ' || coalesce(role, '') || ' / ' || coalesce(CAST(turn AS VARCHAR), '') || '）：' || coalesce(text[1:120], '') AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1",
    "snapshot_changes": f"""
        WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"{e} AS c{i}" for i, (_, e) in enumerate(_NAMES))} FROM lineitem),
        p AS (SELECT *, {", ".join(f"lag(c{i}) OVER w AS p{i}" for i in range(len(_NAMES)))}, lag(1) OVER w AS has FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
        d AS (SELECT *, list_filter([{", ".join(f"CASE WHEN c{i} IS DISTINCT FROM p{i} THEN '{n}: ' || coalesce(p{i}, 'None') || ' → ' || coalesce(c{i}, 'None') END" for i, (n, _) in enumerate(_NAMES))}], lambda x: x IS NOT NULL) AS d FROM p WHERE has = 1)
        SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(d[1:4], ', ') || CASE WHEN len(d) > 4 THEN ' (+' || (len(d) - 4) || ' more)' ELSE '' END AS summary FROM d""",
    "main_boxes": f"""
        WITH b AS (SELECT vec_id, 0 AS k, {_box(0)} AS b FROM embeddings WHERE vec_id % 3 > 0 UNION ALL SELECT vec_id, 1, {_box(8)} FROM embeddings WHERE vec_id % 3 > 0 UNION ALL SELECT vec_id, 2, {_box(4)} FROM embeddings WHERE vec_id % 3 = 0),
        a AS (SELECT *, (b[3] - b[1]) * (b[4] - b[2]) AS area FROM b), t AS (SELECT * FROM a WHERE area >= 0.01 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, k) = 1)
        SELECT e.vec_id, round(b[1], 6) AS l, round(b[2], 6) AS t, round(b[3], 6) AS r, round(b[4], 6) AS b FROM embeddings e LEFT JOIN t USING (vec_id)""",
    "positions": """
        WITH o AS (SELECT o_orderkey, o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AS known, o_totalprice / 7000 AS lat, o_custkey / 9 AS lon, CASE WHEN o_orderstatus = 'F' THEN -abs(o_totalprice / 100) ELSE o_totalprice / 100 END AS h FROM orders)
        SELECT o_orderkey, CASE WHEN known THEN round(lat, 6) END AS lat, CASE WHEN known THEN round(lon, 6) END AS lon, CASE WHEN known THEN round(h, 6) END AS altitude FROM o""",
    "photo_labels": """
        WITH l AS (SELECT l_returnflag, l_extendedprice / 300 AS score, concat_ws(',', CASE WHEN l_discount * 4 > 0.35 THEN 'motion_blur' END, CASE WHEN l_quantity / 3 < 3 THEN 'low_sharpness' END, CASE WHEN l_tax > 0.08 THEN 'highlight_clip' END, CASE WHEN l_linenumber / 25.0 > 0.20 THEN 'shadow_clip' END) AS reasons FROM lineitem)
        SELECT l_returnflag, CASE WHEN reasons <> '' THEN 'skip_bad' WHEN score >= 3 THEN 'good' ELSE 'mediocre' END AS label, reasons, count(*) AS lines FROM l GROUP BY ALL""",
    "strided_populations": """
        WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, event_id FROM e WHERE n <= 200 OR (p - 1) % CAST(ceil(n / 200) AS BIGINT) = 0""",
    "lookup_weights": """
        WITH o AS (SELECT o_orderstatus, CAST(o_totalprice AS DOUBLE) AS x FROM orders),
        k(knot, place, low, high) AS (VALUES (0, 1000.0::DOUBLE, NULL::DOUBLE, 50000.0::DOUBLE), (1, 50000.0, 1000.0, 120000.0), (2, 120000.0, 50000.0, 250000.0), (3, 250000.0, 120000.0, NULL)),
        w AS (SELECT o_orderstatus, knot, CASE WHEN x <= place THEN CASE WHEN low IS NULL THEN 1 ELSE greatest(0.0, (x - low) / (place - low)) END ELSE CASE WHEN high IS NULL THEN 1 ELSE greatest(0.0, (high - x) / (high - place)) END END AS weight FROM o, k)
        SELECT o_orderstatus, knot, count(*) AS orders, round(sum(weight), 3) AS weight FROM w WHERE weight > 0 GROUP BY ALL""",
    "marked_kinds": f"SELECT doc_id, CASE {' '.join(f'WHEN contains(lower(coalesce(text, {chr(39) * 2})), {chr(39)}{m}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for m, k in MARKERS)} ELSE 'other' END AS kind FROM documents",
    "same_status_sets": """
        WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END))) AS b FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, a = b AS same FROM s""",
}
