"""Queries of the string, parsing, date and array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import sequences, stretches
from tessera.plans.tables import table

# Degree words and intent rules of the feedback queries (in order; the first match counts).
DEGREES = (("very", 1.5), ("ver", 1.2), ("little", 0.5), ("lot", 2.0), ("the", 1.1))
INTENTS = ((r"tion", "exposure_up"), (r"(^|\s)th", "warmer"), (r"ing", "contrast_down"), (r"and|und|est|que", "saturation_up"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per document: number and longest."""
    s = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def intents_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of a conversation turn with its first matching rule and degree."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(text.sentences(F.col("text"))).alias("n", "segment"))
    return rows.select("conv_id", "turn", "role", "n", F.coalesce(text.first_rule(F.col("segment"), INTENTS), F.lit("unknown")).alias("intent"), F.round(text.degree(F.col("segment"), DEGREES), 5).alias("degree"))


def intents_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as an ordered fold of edits on one parameter: long turns set, others add, clamped to 0..100."""
    value = F.length("text").cast("double")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.when(value > 250, "set").otherwise("delta").alias("op"), (value % 40 - 15).alias("value")).alias("edit"))
    folded = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    return folded.select("conv_id", F.size("edits").alias("edits"), F.round(text.fold_edits(F.col("edits"), F.lit(50.0), 0.0, 100.0), 6).alias("value"))


def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in a compact notation, made from line columns, parsed back to their parts."""
    key = F.concat(F.lit("if_l_tax_"), F.when(F.col("l_linenumber") % 2 == 0, "gt").otherwise("le"), F.lit("_"), F.col("l_suppkey").cast("string"))
    act = F.concat(F.lower("l_returnflag"), F.lit(".strength"), F.when(F.col("l_linenumber") > 3, F.concat(F.lit("_"), F.col("l_linenumber").cast("string"))).otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.parse_condition(key).alias("c"), text.parse_action(act).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "c.metric", "c.op", F.col("c.value").alias("threshold"), "a.param", "a.value")


def exif_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in their written forms, made from event columns, normalised: aperture, shutter, flash, position, offset."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 50
    rows = e.select("event_id", F.concat(F.lit("f/"), (n + 10).cast("string")).alias("fnumber"), F.concat((n + 1).cast("string"), F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("focal"), (F.col("event_id") % 64).cast("string").alias("flash"), F.array((n + 0.0), (F.col("event_id") % 60 + 0.0), F.lit(30.0)).alias("gps"), F.when(F.col("event_id") % 3 == 0, "S").otherwise("N").alias("ref"), F.when(F.col("event_id") % 2 == 0, "+08:00").otherwise("-03:30").alias("tz"))
    offset = dates.parse_offset(F.col("tz"))
    return rows.select("event_id", F.round(text.ratio(F.col("fnumber")), 6).alias("aperture"), F.round(text.ratio(F.col("focal")), 6).alias("focal"), text.flash(F.col("flash")).alias("flash"), F.round(text.signed(text.degrees(F.col("gps")), F.col("ref")), 6).alias("latitude"), offset.alias("offset"), dates.format_offset(offset).alias("offset_text"))


def shutter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shutter times as fractions where they are near one."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.lit(1.0) / (F.col("event_id") % 400 + 2)).alias("s"))
    return rows.select("event_id", text.shutter(F.col("s")).alias("shutter"))


def daylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunrise, sunset and light class of every event at the default place."""
    ts = F.col("ts")
    times = dates.daylight(F.dayofyear(ts), F.lit(dates.DEFAULT_OFFSET), F.lit(dates.DEFAULT_LATITUDE), F.lit(dates.DEFAULT_LONGITUDE))
    hour = F.hour(ts) + F.minute(ts) / 60
    return table(spark, sf_dir, "events").select("event_id", F.round(times["sunrise"], 5).alias("sunrise"), F.round(times["sunset"], 5).alias("sunset"), dates.classify(hour, times).alias("light"))


def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in four formats, read back."""
    written = F.concat(F.element_at(F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit("unknown")), (F.col("event_id") % 4 + 1).cast("int")), F.when(F.col("event_id") % 4 == 0, "Z").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_seconds(dates.parse_time(written)), F.lit(-1)).alias("seconds"))


def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and aspect ratios from page urls and titles."""
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", text.slug(F.col("url")).alias("slug"), F.round(text.aspect(F.concat((F.col("page_id") % 9).cast("string"), F.lit(":"), (F.col("page_id") % 4).cast("string"))), 6).alias("aspect"), text.looks_like_path(F.regexp_replace("url", "^https?:/", "")).alias("path"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number inside each event's JSON, its sum per user, and a fingerprint by blocks of the ordered keys and values."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    prints = stretches.digests(rows, ["user_id"], ["event_id"], F.concat_ws("=", F.col("event_id").cast("string"), F.col("k").cast("string")))
    return rows.groupBy("user_id").agg(F.sum("k").alias("total")).join(prints.select(F.col("user_id").alias("of"), F.col("digest").alias("fingerprint")), F.col("user_id").eqNullSafe(F.col("of"))).drop("of")


def param_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint per part of its columns."""
    return table(spark, sf_dir, "part").select("p_partkey", text.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("fingerprint"))


def subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose event types contain signup, click, purchase in this order."""
    return sequences.contains_chain(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], ["signup", "click", "purchase", "signup"])


QUERIES = {f.__name__: f for f in (sentence_split, intents_parse, intents_apply, style_rules, exif_normalise, shutter_text, daylight, time_parse, url_slugs, json_props, param_fingerprint, subsequence)}

_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[，,;；。.!！\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '')"

ORACLES = {
    "sentence_split": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s",
    "intents_parse": f"""
        WITH s AS (SELECT conv_id, turn, role, {_SENTENCES} AS s FROM conversations), e AS (SELECT conv_id, turn, role, unnest(range(0, len(s))) AS n, unnest(s) AS segment FROM s)
        SELECT conv_id, turn, role, n, CASE {' '.join(f"WHEN regexp_matches(segment, '{p}') THEN '{i}'" for p, i in INTENTS)} ELSE 'unknown' END AS intent,
               round(least(3.0, {' * '.join(f"CASE WHEN contains(segment, '{w}') THEN {f}::DOUBLE ELSE 1.0 END" for w, f in DEGREES)}), 5) AS degree FROM e""",
    "intents_apply": """
        WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, CASE WHEN length(text) > 250 THEN 'set' ELSE 'delta' END, length(text) % 40 - 15) AS n, length(text) > 250 AS sets, CAST(length(text) % 40 - 15 AS DOUBLE) AS v FROM conversations),
        f AS (SELECT conv_id, 0::BIGINT AS n, 50.0::DOUBLE AS value FROM (SELECT DISTINCT conv_id FROM e) UNION ALL
              SELECT f.conv_id, e.n, greatest(0.0, least(100.0, CASE WHEN sets THEN v ELSE value + v END)) FROM f JOIN e ON e.conv_id = f.conv_id AND e.n = f.n + 1)
        SELECT conv_id, max(n) AS edits, round(arg_max(value, n), 6) AS value FROM f GROUP BY conv_id""",
    "style_rules": """
        SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax' AS metric, CASE WHEN l_linenumber % 2 = 0 THEN 'gt' ELSE 'le' END AS op, CAST(l_suppkey AS DOUBLE) AS threshold,
               lower(l_returnflag) || '.strength' AS param, CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS DOUBLE) ELSE 1.0 END AS value FROM lineitem""",
    "exif_normalise": """
        SELECT event_id, round(CAST(event_id % 50 + 10 AS DOUBLE), 6) AS aperture, round(CASE WHEN event_id % 7 = 0 THEN event_id % 50 + 1 ELSE (event_id % 50 + 1) / (event_id % 7) END, 6) AS focal,
               CASE WHEN event_id % 64 >= 32 THEN 'off' WHEN event_id % 2 = 1 THEN 'on' ELSE 'off' END AS flash,
               round((CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * (event_id % 50 + (event_id % 60) / 60 + 30.0 / 3600), 6) AS latitude,
               CASE WHEN event_id % 2 = 0 THEN 8.0::DOUBLE ELSE -3.5 END AS offset, CASE WHEN event_id % 2 = 0 THEN '+08:00' ELSE '-03:30' END AS offset_text FROM events""",
    "shutter_text": "SELECT event_id, '1/' || (event_id % 400 + 2) AS shutter FROM events",
    "daylight": """
        WITH d AS (SELECT event_id, hour(ts) + minute(ts) / 60 AS h, 23.44 * sin(radians(360.0 / 365.0 * (dayofyear(ts) - 81))) AS decl, 12 - 116.4 / 15 + 8.0 AS noon FROM events),
        a AS (SELECT *, degrees(acos((sin(radians(-0.833)) - sin(radians(39.9)) * sin(radians(decl))) / (cos(radians(39.9)) * cos(radians(decl))))) / 15 AS sun,
                     degrees(acos((sin(radians(-6.0)) - sin(radians(39.9)) * sin(radians(decl))) / (cos(radians(39.9)) * cos(radians(decl))))) / 15 AS civil FROM d)
        SELECT event_id, round(noon - sun, 5) AS sunrise, round(noon + sun, 5) AS sunset,
               CASE WHEN h < noon - civil OR h > noon + civil THEN 'night' WHEN h < noon - sun + 1 OR h > noon + sun - 1 THEN 'golden_hour' ELSE 'day' END AS light FROM a""",
    "time_parse": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN -1 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events",
    "url_slugs": r"""
        SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
               CASE WHEN page_id % 4 = 0 OR page_id % 9 = 0 THEN NULL ELSE round((page_id % 9) / (page_id % 4), 6) END AS aspect, true AS path FROM pages""",
    "json_props": """
        WITH p AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
        b AS (SELECT user_id, (place - 1) // 1000 AS block, sum(CAST(k AS BIGINT)) AS total, md5(string_agg(event_id || '=' || k, ',' ORDER BY place)) AS d FROM p GROUP BY ALL)
        SELECT user_id, sum(total)::BIGINT AS total, md5(string_agg(d, ',' ORDER BY block)) AS fingerprint FROM b GROUP BY user_id""",
    "param_fingerprint": "SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || p_size) AS fingerprint FROM part",
    "subsequence": """
        WITH s AS (SELECT user_id, (ts, event_id) AS k, event_type AS t FROM events), a AS (SELECT user_id, min(k) AS k FROM s WHERE t = 'signup' GROUP BY 1), b AS (SELECT s.user_id, min(s.k) AS k FROM s JOIN a USING (user_id) WHERE t = 'click' AND s.k > a.k GROUP BY 1),
        c AS (SELECT s.user_id, min(s.k) AS k FROM s JOIN b USING (user_id) WHERE t = 'purchase' AND s.k > b.k GROUP BY 1), d AS (SELECT DISTINCT s.user_id FROM s JOIN c USING (user_id) WHERE t = 'signup' AND s.k > c.k)
        SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM d) AS found FROM events""",
}
