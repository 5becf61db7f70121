"""Queries of job tables, routing, bounded loops and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import corpus, fits, rules, sequences, stretches
from tessera.plans.measure import pixel_rows
from tessera.plans.tables import table


def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of results stamped with a generation (the day) only those of a key's newest stay."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.to_date("ts").alias("generation"))
    newest = F.max("generation").over(Window.partitionBy("user_id", "event_type"))
    return events.withColumn("newest", newest).where("generation = newest").select("user_id", "event_id", "event_type")


def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's request joins the flight of the one before it if that came at most an hour earlier: one flight per island."""
    found = sequences.global_bursts(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "ts", "event_id", 3600.0, keys=["user_id"])
    return found.groupBy("user_id", "island").agg(F.min("event_id").alias("leader"), (F.count(F.lit(1)) - 1).alias("joined"))


def budget_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier nation: slowest and mean price against budgets."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice").join(supplier, "l_suppkey")
    found = rows.groupBy("n_nationkey").agg(F.max("l_extendedprice").alias("most"), F.avg("l_extendedprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    return found.select("n_nationkey", "n", (F.col("most") <= 100_000).alias("peak_ok"), (F.round("mean", 4) <= 38_000).alias("mean_ok"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: accepted ids, the number rejected, and rejections per reason, from the event log."""
    reason = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "range")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", reason.alias("reason"))
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if(F.col("reason") == "error").alias("errors"), F.count_if(F.col("reason") == "range").alias("ranges"),
        F.max(F.when(F.col("reason").isNull(), F.col("event_id"))).alias("last_accepted"),
    )


def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names grouped by the first keyword they contain; those with none are left out."""
    group = corpus.first_reason((F.lower("p_type").contains("steel"), "metal"), (F.lower("p_type").contains("brass"), "metal"), (F.lower("p_type").contains("small"), "small"), (F.lower("p_type").contains("o"), "other"))
    rows = table(spark, sf_dir, "part").select("p_partkey", group.alias("grp")).where("grp is not null")
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


def pack_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations in another pack (region) than the one declared by their segment: undeclared dependencies, counted."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    owner = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") % 5).cast("int").alias("pack"), F.col("n_regionkey").alias("owner"))
    declared = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3)], "pack int, owner int")
    return owner.where("pack <> owner").join(F.broadcast(declared), ["pack", "owner"], "left_anti").groupBy("pack", "owner").agg(F.count(F.lit(1)).alias("n"))


def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: errors, whether there was any, and the state of the day."""
    found = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.bool_or(F.col("event_type") == "error").alias("any"))
    return found.select("day", "n", "errors", "any", F.when(F.col("errors") == 0, "ok").when(F.col("errors") / F.col("n") < 0.2, "degraded").otherwise("down").alias("state"))


def bounded_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded correction per order: at most four rounds of half the distance to the target, damped, stopped within the tolerance."""
    target, tolerance = 150_000.0, 5_000.0

    def step(state, n):
        far = F.abs(state["value"] - target) > tolerance
        moved = state["value"] + F.greatest(F.lit(-60_000.0), F.least(F.lit(60_000.0), (F.lit(target) - state["value"]) * 0.5))
        return F.struct(F.when(far, moved).otherwise(state["value"]).alias("value"), (state["rounds"] + far.cast("int")).alias("rounds"))

    start = F.struct(F.col("o_totalprice").alias("value"), F.lit(0).alias("rounds"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step).alias("s")).select("o_orderkey", F.round("s.value", 4).alias("value"), "s.rounds")


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events during which a user's breaker is open: within six hours of the third or later of consecutive errors or large values."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    runs = sequences.run_lengths(events, ["user_id"], ["ts", "event_id"], (F.col("event_type") == "error") | (F.col("value") > 40), 3)
    tripped = F.max(F.when(F.col("converged"), F.col("at"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("user_id", "event_id", F.coalesce((F.col("at") - tripped) <= 6 * 3600 * 1_000_000, F.lit(False)).alias("open"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed decision per line: quality gate, then targets, then rules."""
    gate = rules.qc_rollback(F.col("l_discount"), F.col("l_linenumber") - 1, F.lit(False))
    met = rules.target_met(F.col("l_quantity"), F.lit(25.0), "eq", 3.0)
    decision = F.when(gate != "pass", gate).when(met, "stop").otherwise("apply_rules")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row and column of every image whose value is within a window."""
    return pixel_rows(spark, sf_dir).where("y % 3 = 0 and x % 3 = 0 and v between 60 and 200").select("vec_id", (F.col("y") * 8 + F.col("x")).alias("place"), F.round("v", 4).alias("v"))


def exposure_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure values from aperture, time and sensitivity made of line columns."""
    aperture, seconds, iso = 1.4 + F.col("l_discount") * 100, 1 / (F.col("l_quantity") * 10), 100.0 * F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.round(F.avg(F.log2(aperture * aperture / seconds) - F.log2(iso / 100)), 5).alias("ev"))


def customer_value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment the customers nearest the extremes and the median of account balance."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    middle = stretches.quantiles(rows, ["c_mktsegment"], "c_acctbal", (0.5,)).select("c_mktsegment", F.col("q")[0].alias("m"))
    near = F.min_by("c_custkey", F.struct(F.abs(F.col("c_acctbal") - F.col("m")), "c_custkey"))
    return rows.join(fits.written(middle, "segment-medians"), "c_mktsegment").groupBy("c_mktsegment").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("lowest"), F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("highest"), near.alias("middle"))


QUERIES = {f.__name__: f for f in (stale_results, single_flight, budget_gates, review_reasons, label_groups, pack_dependencies, health_rollup, bounded_loop, breaker, decisions, strided_sample, exposure_value, customer_value_ranks)}

_LOOP = "CASE WHEN abs({v} - 150000) > 5000 THEN {v} + greatest(-60000.0, least(60000.0, (150000 - {v}) * 0.5)) ELSE {v} END"

ORACLES = {
    "stale_results": "SELECT user_id, event_id, event_type FROM events QUALIFY CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type)",
    "single_flight": """
        WITH s AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 3600 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s) SELECT user_id, island, min(event_id) AS leader, count(*) - 1 AS joined FROM i GROUP BY ALL""",
    "budget_gates": "SELECT n_nationkey, count(*) AS n, max(l_extendedprice) <= 100000 AS peak_ok, round(avg(l_extendedprice), 4) <= 38000 AS mean_ok FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    "review_reasons": """
        WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 THEN 'range' END AS reason FROM events)
        SELECT user_id, count_if(reason IS NULL) AS accepted, count_if(reason IS NOT NULL) AS rejected, count_if(reason = 'error') AS errors, count_if(reason = 'range') AS ranges, max(event_id) FILTER (reason IS NULL) AS last_accepted FROM r GROUP BY user_id""",
    "label_groups": """
        WITH g AS (SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'small') THEN 'small' WHEN contains(lower(p_type), 'o') THEN 'other' END AS grp FROM part)
        SELECT grp, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM g WHERE grp IS NOT NULL GROUP BY grp""",
    "pack_dependencies": """
        SELECT CAST(c_custkey % 5 AS INT) AS pack, n_regionkey AS owner, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_custkey % 5 <> n_regionkey AND (c_custkey % 5, n_regionkey) NOT IN ((0, 1), (1, 2), (2, 0), (3, 3)) GROUP BY ALL""",
    "health_rollup": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count_if(event_type = 'error') AS errors, bool_or(event_type = 'error') AS any,
               CASE WHEN count_if(event_type = 'error') = 0 THEN 'ok' WHEN count_if(event_type = 'error') / count(*) < 0.2 THEN 'degraded' ELSE 'down' END AS state FROM events GROUP BY 1""",
    "bounded_loop": f"""
        WITH a AS (SELECT o_orderkey, o_totalprice AS v0 FROM orders), b AS (SELECT *, {_LOOP.format(v='v0')} AS v1 FROM a), c AS (SELECT *, {_LOOP.format(v='v1')} AS v2 FROM b), d AS (SELECT *, {_LOOP.format(v='v2')} AS v3 FROM c), e AS (SELECT *, {_LOOP.format(v='v3')} AS v4 FROM d)
        SELECT o_orderkey, round(v4, 4) AS value, (abs(v0 - 150000) > 5000)::INT + (abs(v1 - 150000) > 5000)::INT + (abs(v2 - 150000) > 5000)::INT + (abs(v3 - 150000) > 5000)::INT AS rounds FROM e""",
    "breaker": """
        WITH s AS (SELECT *, event_type = 'error' OR value > 40 AS bad, sum(CASE WHEN event_type = 'error' OR value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
        r AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM s),
        t AS (SELECT user_id, event_id, epoch_us(ts) AS at_us, max(CASE WHEN streak >= 3 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trip FROM r)
        SELECT user_id, event_id, coalesce(at_us - trip <= 21600000000, false) AS open FROM t""",
    "decisions": """
        SELECT l_returnflag, CASE WHEN l_discount > 0.03 THEN CASE WHEN l_linenumber >= 2 THEN 'manual_review' ELSE 'rollback' END WHEN abs(l_quantity - 25) <= 3 THEN 'stop' ELSE 'apply_rules' END AS decision, count(*) AS n FROM lineitem GROUP BY ALL""",
    "strided_sample": "WITH px AS (SELECT vec_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, CAST(embedding[pos] AS DOUBLE) * 300 + 127.5 AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)) SELECT vec_id, y * 8 + x AS place, round(v, 4) AS v FROM px WHERE y % 3 = 0 AND x % 3 = 0 AND v BETWEEN 60 AND 200",
    "exposure_value": "SELECT l_linestatus, l_linenumber, round(avg(log2((1.4 + l_discount * 100) * (1.4 + l_discount * 100) * (l_quantity * 10)) - log2(l_linenumber)), 5) AS ev FROM lineitem GROUP BY ALL",
    "customer_value_ranks": """
        WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1)
        SELECT c_mktsegment, arg_min(c_custkey, (c_acctbal, c_custkey)) AS lowest, arg_max(c_custkey, (c_acctbal, c_custkey)) AS highest, arg_min(c_custkey, (abs(c_acctbal - m), c_custkey)) AS middle FROM customer JOIN m USING (c_mktsegment) GROUP BY 1""",
}
