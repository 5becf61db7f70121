"""Queries of edits in free text and of merged graph fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import documents as json_texts
from tessera.operators import edit_texts, fragments, routing
from tessera.plans.tables import table


def reply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits found in replies: conversation turns with an array in a fence, after an echoed prompt, in an object, broken, or not at all."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    one = F.concat(F.lit('[{"param": "exposure", "value": '), F.col("turn").cast("string"), F.lit('}, 7, {"reason": "a ] in [ text"}]'))
    prompt = F.concat(F.lit('Answer like [{"param": "example"}]: '), F.substring("text", 1, 20))
    reply = F.when(kind == 0, F.concat("text", F.lit("\n```json\n"), one, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("echo: "), prompt, F.lit(" done "), one))
    reply = reply.when(kind == 2, F.concat(F.lit('{"note": [1, 2], "edits": '), one, F.lit("}"))).when(kind == 3, F.concat(F.lit('[{"param": "lost", "value": 1] '), one)).otherwise(F.lit("nothing [1, 2] here"))
    asked = turns.select("conv_id", "turn", reply.alias("reply"), prompt.alias("prompt"))
    found = edit_texts.extracted(asked, "reply", "prompt")
    return found.select("conv_id", "turn", F.coalesce(F.size("edits"), F.lit(0)).alias("n"), F.get_json_object(F.try_element_at("edits", F.lit(1)), "$.param").alias("param"), F.get_json_object(F.try_element_at("edits", F.lit(1)), "$.value").alias("value"))


def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers as one graph with the customers' nations as made-up ends: nodes by type with their degrees."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("label"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("type"), "s_nationkey")
    of_supplier = supplier.select(F.col("id").alias("from"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to"))
    of_customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("from"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("to"))
    nodes, edges = fragments.merged([(nation, of_customer), (supplier.drop("s_nationkey"), of_supplier)])
    degree = edges.groupBy(F.col("to").alias("id")).count()
    both = nodes.join(degree, "id", "left")
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("count", F.lit(0))).alias("degree"), F.count("label").alias("labelled"))


SCHEMAS = {
    "tone": {"brightness": routing.Field("float", -2, 2)}, "hsl": {"enabled": routing.Field("bool"), "domain": routing.Field("str", choices=("hsv", "oklch"))},
    "whitebalance": {"mode": routing.Field("float_or_str"), "temp": routing.Field("float", 1500, 50_000)},
}


def _patch() -> Column:
    """A nested patch per order: brightness by price, a domain by status, a file's name and a stranger now and then, and a temperature."""
    key = F.col("o_orderkey")
    domain = F.when(F.col("o_orderstatus") == "O", "hsv").otherwise(F.col("o_orderstatus"))
    tone = F.create_map(F.lit("brightness"), F.round(F.col("o_totalprice") / 100_000, 2).cast("string"))
    tone = F.when(key % 11 == 0, F.map_concat(tone, F.create_map(F.lit("note_path"), F.lit('"x"')))).otherwise(tone)
    patch = F.create_map(F.lit("tone"), tone, F.lit("hsl"), F.create_map(F.lit("domain"), F.concat(F.lit('"'), domain, F.lit('"'))), F.lit("whitebalance"), F.create_map(F.lit("temp"), (key % 4000).cast("string")))
    return F.when(key % 7 == 0, F.map_concat(patch, F.create_map(F.lit("ghost"), F.create_map(F.lit("x"), F.lit("1"))))).otherwise(patch)


def param_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of every order's patch against the schemas, and the flags that the patch implies."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _patch().alias("patch"))
    found = rows.select("o_orderkey", routing.violations(F.col("patch"), SCHEMAS).alias("v"), routing.implied(F.col("patch"), SCHEMAS).alias("p"))
    joined = F.array_join(F.transform("v", lambda v: F.concat_ws(":", v["stage"], v["key"], v["reason"])), ",")
    return found.select("o_orderkey", F.size("v").alias("n"), joined.alias("violations"), F.element_at("p", "hsl")["enabled"].alias("hsl_enabled"), F.element_at("p", "whitebalance")["mode"].alias("mode"))


ROUTES = routing.Routes(slots={"dehaze.strength": ("dehaze", "strength")}, switched=[("dehaze", "strength")], region_limits={"exposure": 2.0})


def param_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat decisions of every embedding put into nested parameters, and the exposure read back as one number."""
    e = F.transform("embedding", lambda v: F.round(v.cast("double"), 6))
    decided = F.create_map(F.lit("EV"), e[0], F.lit("dehaze.strength"), e[1], F.lit("region.face.exposure"), e[2] * 40, F.lit("plain"), e[3])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", routing.routed(F.create_map(F.lit("tone"), F.create_map(F.lit("a"), F.lit("1"))), decided, ROUTES).alias("r"))
    exposure = routing.flattened(F.col("r.params"))["exposure_ev"]
    return rows.select("vec_id", F.round(exposure, 6).alias("exposure"), F.round(F.col("r.params")["dehaze"]["strength"].cast("double"), 6).alias("dehaze"), F.col("r.params")["dehaze"]["enabled"].alias("enabled"), F.round(F.col("r.regions")["face"]["exposure"], 6).alias("face"), F.round(F.col("r.other")["plain"], 6).alias("plain"), F.col("r.params")["tone"]["a"].alias("tone"))


def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as canonical JSON, whatever the order of its fields, and its digest."""
    whole = F.to_json(F.struct("o_orderstatus", F.col("o_orderkey").alias("o_orderkey"), F.struct(F.col("o_orderpriority").alias("z"), F.col("o_custkey").alias("a")).alias("inner")))
    return table(spark, sf_dir, "orders").select("o_orderkey", json_texts.canonical(whole).alias("text")).select("o_orderkey", "text", json_texts.digest(F.col("text")).alias("digest"))


QUERIES = {f.__name__: f for f in (reply_edits, fragment_merge, param_fence, param_routes, canonical_digests)}

ORACLES = {
    "reply_edits": """
        SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 THEN 0 ELSE 2 END AS n, CASE WHEN (conv_id + turn) % 5 <> 4 THEN 'exposure' END AS param, CASE WHEN (conv_id + turn) % 5 <> 4 THEN CAST(turn AS VARCHAR) END AS value
        FROM conversations""",
    "fragment_merge": """
        WITH e AS (SELECT 's' || s_suppkey AS f, 'n' || s_nationkey AS t FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
        n AS (SELECT 'n' || n_nationkey AS id, 'nation' AS type, n_name AS label FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 's' || s_suppkey, 'supplier', NULL FROM supplier),
        everyone AS (SELECT * FROM n UNION ALL SELECT id, 'external', NULL FROM (SELECT f AS id FROM e UNION SELECT t FROM e) WHERE id NOT IN (SELECT id FROM n))
        SELECT type, count(*) AS n, sum(coalesce(d, 0))::BIGINT AS degree, count(label) AS labelled FROM everyone LEFT JOIN (SELECT t AS id, count(*) AS d FROM e GROUP BY t) USING (id) GROUP BY type""",
    "param_fence": """
        WITH o AS (SELECT o_orderkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE) / 100000, 2) AS b FROM orders),
        v AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'ghost::unknown_stage' END, CASE WHEN o_orderstatus <> 'O' THEN 'hsl:domain:choice' END, CASE WHEN b > 2 THEN 'tone:brightness:range' END,
                     CASE WHEN o_orderkey % 11 = 0 THEN 'tone:note_path:path' END, CASE WHEN o_orderkey % 4000 < 1500 THEN 'whitebalance:temp:range' END], lambda x: x IS NOT NULL) AS v FROM o)
        SELECT o_orderkey, CAST(len(v) AS INTEGER) AS n, array_to_string(v, ',') AS violations, 'true' AS hsl_enabled, '"manual"' AS mode FROM v""",
    "param_routes": """
        SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS exposure, round(CAST(embedding[2] AS DOUBLE), 6) AS dehaze, 'true' AS enabled,
               round(greatest(-2.0, least(2.0, round(CAST(embedding[3] AS DOUBLE), 6) * 40)), 6) AS face, round(CAST(embedding[4] AS DOUBLE), 6) AS plain, '1' AS tone FROM embeddings""",
    "canonical_digests": """
        WITH t AS (SELECT o_orderkey, '{"inner":{"a":' || o_custkey || ',"z":"' || o_orderpriority || '"},"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS text FROM orders)
        SELECT o_orderkey, text, sha256(text) AS digest FROM t""",
}
