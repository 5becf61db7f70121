"""Queries of parameter patches and staged plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import patches
from tessera.plans import measure
from tessera.plans.stages import Plan
from tessera.plans.tables import table

_NAMES = ("exposure.ev", "tone.brightness", "saturation.amount", "white_balance.tint", "no.such", "exposure.metering_mode")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(n) for n in _NAMES])
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(names, (F.col("l_partkey") % 6 + 1).cast("int")).alias("param"), F.when(F.col("l_suppkey") % 10 == 0, "power").when(F.col("l_linenumber") % 2 == 0, "delta").otherwise("set").alias("op"),
        F.when(F.col("l_partkey") % 6 != 5, F.col("l_quantity") / 8 - 3).alias("value"), F.when(F.col("l_partkey") % 6 == 5, F.when(F.col("l_suppkey") % 2 == 0, "auto").otherwise("never")).alias("word"), F.create_map(F.lit("exposure.ev"), F.lit(1.0)).alias("now"),
    )


def patch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches accepted and rejected by reason."""
    accepted, rejected = patches.review(_patches(spark, sf_dir), "now", locked=("white_balance",))
    return rejected.groupBy("param", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(accepted.groupBy("param").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("accepted")))


def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric patches of each order folded in order of line, part and supplier."""
    rows = _patches(spark, sf_dir).where("op <> 'power' and param in ('exposure.ev', 'tone.brightness', 'saturation.amount')")
    return patches.apply(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "param", F.round("value", 6).alias("value"))


PLAN = Plan({"exposure": {"ev": 0.5}, "white_balance": {"gains": [1.1, 1.0, 0.9]}, "tone": {"brightness": -0.25}, "saturation": {"amount": 0.2}, "quantise": {"bits": 8}})


def staged_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels through exposure, white balance, tone, saturation and quantisation: means per image."""
    done = Plan.from_config(PLAN.to_config()).run(measure.rgb_pixels(spark, sf_dir))
    return done.groupBy("vec_id").agg(*[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in "rgb"], F.max("r").alias("top"))


QUERIES = {f.__name__: f for f in (patch_review, patch_apply, staged_render)}

_P = f"""
    p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{', '.join(f"'{n}'" for n in _NAMES)}][l_partkey % 6 + 1] AS param,
          CASE WHEN l_suppkey % 10 = 0 THEN 'power' WHEN l_linenumber % 2 = 0 THEN 'delta' ELSE 'set' END AS op, CASE WHEN l_partkey % 6 <> 5 THEN l_quantity / 8 - 3 END AS value,
          CASE WHEN l_partkey % 6 = 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'auto' ELSE 'never' END END AS word FROM lineitem)"""
_RANGES = "(VALUES ('exposure.ev', -5.0::DOUBLE, 5.0::DOUBLE), ('tone.brightness', -2.0, 2.0), ('saturation.amount', -1.0, 1.0), ('white_balance.tint', -150.0, 150.0)) r(name, low, high)"

ORACLES = {
    "patch_review": f"""
        WITH {_P}, t AS (SELECT *, CASE WHEN op = 'delta' THEN CASE WHEN param = 'exposure.ev' THEN 1.0 ELSE 0.0 END + value ELSE value END AS target FROM p),
        v AS (SELECT param, CASE WHEN param = 'no.such' THEN 'reference' WHEN op = 'power' THEN 'op' WHEN param = 'exposure.metering_mode' AND word <> 'auto' THEN 'word'
                     WHEN param <> 'exposure.metering_mode' AND NOT target BETWEEN low AND high THEN 'range' WHEN param LIKE 'white_balance.%' THEN 'locked' ELSE 'accepted' END AS reason FROM t LEFT JOIN {_RANGES} ON name = param)
        SELECT param, reason, count(*) AS n FROM v GROUP BY ALL""",
    "patch_apply": f"""
        WITH RECURSIVE {_P}, e AS (SELECT l_orderkey, param, op, value, low, high, row_number() OVER (PARTITION BY l_orderkey, param ORDER BY l_linenumber, l_partkey, l_suppkey, op, value) AS n FROM p JOIN {_RANGES} ON name = param WHERE op <> 'power' AND param <> 'white_balance.tint'),
        f AS (SELECT DISTINCT l_orderkey, param, 0::BIGINT AS n, 0.0::DOUBLE AS v FROM e UNION ALL SELECT f.l_orderkey, f.param, e.n, greatest(low, least(high, CASE WHEN op = 'set' THEN value ELSE v + value END)) FROM f JOIN e ON e.l_orderkey = f.l_orderkey AND e.param = f.param AND e.n = f.n + 1)
        SELECT l_orderkey, param, round(arg_max(v, n), 6) AS value FROM f GROUP BY ALL""",
    "staged_render": f"""
        WITH {measure.RGB_SQL}, e AS (SELECT vec_id, {', '.join(f"CASE WHEN {c} * pow(2, 0.5) <= 0.9 THEN {c} * pow(2, 0.5) ELSE 0.9 + (1 - 0.9) * tanh(({c} * pow(2, 0.5) - 0.9) / (1 - 0.9)) END AS {c}" for c in 'rgb')} FROM rgb),
        w AS (SELECT vec_id, {', '.join(f"CASE WHEN greatest(r, g, b) >= 1 AND least(r, g, b) / greatest(r, g, b) >= 0.75 THEN 1.0 ELSE {c} * {k} END AS {c}" for c, k in zip('rgb', (1.1, 1.0, 0.9), strict=True))} FROM e),
        t AS (SELECT vec_id, {', '.join(measure.encode_sql(f'greatest(0.0, least(1.0, {c} * pow(2, -0.25)))') + f' AS {c}' for c in 'rgb')} FROM w),
        s AS (SELECT vec_id, r, g, b, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y FROM t),
        q AS (SELECT vec_id, {', '.join(f"floor(greatest(0.0, least(1.0, y + ({c} - y) * 1.2)) * 255 + 0.5) AS {c}" for c in 'rgb')} FROM s)
        SELECT vec_id, round(avg(r), 3) AS mean_r, round(avg(g), 3) AS mean_g, round(avg(b), 3) AS mean_b, CAST(max(r) AS INT) AS top FROM q GROUP BY vec_id""",
}
