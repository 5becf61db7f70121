"""Queries of corpus analytics: percentiles, A/B, ranks, samples, comparisons, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import corpus, fits, stretches
from tessera.plans.tables import table

CURVE = ((0.0, 0.0), (10.0, 4.0), (20.0, 6.0), (35.0, 5.0), (50.0, 9.0))
WINDOWS = ((1.0, 10.0, 0.5), (5.0, 25.0, -0.25), (20.0, 50.0, 1.0))


def pct_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of four line metrics per return flag."""
    found = corpus.percentile_table(table(spark, sf_dir, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag",))
    return found.select("l_returnflag", "metric", "n", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "low", "high")])


def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by quantity band and pass by band rule, pivoted by return flag."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    band = F.when(q < 10, "indoor").when(q < 30, "normal").otherwise("night")
    passed = F.when(band == "indoor", d <= 0.05).when(band == "night", (d <= 0.08) & (F.col("l_tax") <= 0.06)).otherwise(F.when(F.col("l_tax") >= 0.02, d / F.col("l_tax") <= 1.5).otherwise(True))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", band.alias("band"), passed.alias("passed"))
    return rows.groupBy("band").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg(F.col("passed").cast("double")), 6)).select("band", F.col("A").alias("share_a"), F.col("N").alias("share_n"), F.col("R").alias("share_r"))


def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A/B per return flag and in all: median and p95 of both tracks, rows that improved, worst regression."""
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", a.alias("a"), b.alias("b"))
    sums = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") < F.col("a")).alias("improved"), F.max(F.col("b") - F.col("a")).alias("worst"))
    whole = sums.agg(F.sum("n").alias("n"), F.sum("improved").alias("improved"), F.max("worst").alias("worst"))
    counts = sums.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    # Each track's values are counted once per flag; the whole's counts are sums of those.
    tracks = rows.select("l_returnflag", F.explode(F.array(F.struct(F.lit("a").alias("track"), F.col("a").alias("v")), F.struct(F.lit("b").alias("track"), F.col("b").alias("v")))).alias("t")).select("l_returnflag", "t.*")
    values = fits.written(stretches.value_counts(tracks, ["l_returnflag", "track"], "v"), "ab-values")
    joint = values.groupBy("track", "__v").agg(F.sum("__n").alias("__n"))
    every = values.withColumn("whole", F.lit(False)).unionByName(joint.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    found = stretches.quantiles_of_counts(every, ["whole", "l_returnflag", "track"], (0.5, 0.95))
    pairs = found.groupBy("whole", "l_returnflag").agg(*[F.max(F.when(F.col("track") == t, F.col("q"))).alias(f"p{t}") for t in ("a", "b")])
    counts = fits.joined(counts, pairs, ["whole", "l_returnflag"])
    return counts.select("l_returnflag", "n", F.round(F.col("pa")[0], 3).alias("a50"), F.round(F.col("pa")[1], 3).alias("a95"), F.round(F.col("pb")[0], 3).alias("b50"), F.round(F.col("pb")[1], 3).alias("b95"), "improved", F.round("worst", 3).alias("worst"), (F.col("pb")[0] <= F.col("pa")[0]).alias("gate"))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of part size and price."""
    return corpus.spearman(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("s"), "p_retailprice"), "s", "p_retailprice").select("n", F.round("rho", 6).alias("rho"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank of every order by price in thousands."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("k"))
    return corpus.average_ranks(rows, "k", "rank").select("o_orderkey", "rank")


def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven evenly spaced documents per source and language."""
    return corpus.linspace_sample(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["n_chars", "doc_id"], 7)


def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per status two evenly spaced orders of the cheaper half and three of the other, per customer segment's nation group."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 10).alias("grp"), "o_totalprice")
    cut = corpus.halves(rows, ["o_orderstatus", "grp"], ["o_totalprice", "o_orderkey"])
    low = corpus.linspace_sample(cut.where("half = 'spike'"), ["o_orderstatus", "grp"], ["o_totalprice", "o_orderkey"], 2)
    return low.unionByName(corpus.linspace_sample(cut.where("half = 'flat'"), ["o_orderstatus", "grp"], ["o_totalprice", "o_orderkey"], 3)).select("o_orderkey", "grp", "half")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four documents of each source in turn."""
    return corpus.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 4)


def nearest_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the part whose price is nearest the brand's median."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    middle = stretches.quantiles(rows, ["p_brand"], "p_retailprice", (0.5,)).select("p_brand", F.col("q")[0].alias("m"))
    return rows.join(fits.written(middle, "brand-medians"), "p_brand").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_retailprice") - F.col("m")), "p_partkey")).alias("p_partkey"))


def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's prices never rise from line to line."""
    after = F.lead("l_extendedprice").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.coalesce(F.col("l_extendedprice") >= after, F.lit(True)).alias("ok"))
    return rows.groupBy("l_orderkey").agg(F.bool_and("ok").alias("falling"))


def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected lengths of all documents against what their labels say: verdicts by tolerance, documents without a label missing."""
    expected = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("expected"))
    actual = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 1500.0 + 500).alias("actual"))
    return corpus.compare(expected, actual, ["doc_id"], 300.0, 0.5)


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments against a changed copy of the table."""
    fresh = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    existing = fresh.where("c_custkey % 11 <> 0").select(F.when(F.col("c_custkey") % 13 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"), F.when(F.col("c_custkey") % 7 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return corpus.diff(fresh, existing, "c_custkey", "c_mktsegment")


def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' mean price in late lines against early ones: which rose over a fifth."""
    lines = table(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    new, old = (lines.where(c).groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("price")) for c in (late, ~late))
    found = corpus.regressions(new, old, "l_suppkey", "price")
    return found.withColumn("ratio", F.round("ratio", 5))


def interp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve and a sum of interval windows over quantities."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(corpus.interpolate(F.col("l_quantity"), CURVE), 6).alias("curve"), F.round(corpus.window_sums(rows, "l_quantity", WINDOWS), 6).alias("windows"))


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events with the value of their last purchase up to then."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    return corpus.as_of(events, bought, ["user_id"], "ts", "paid", "event_id").select("user_id", "event_id", "last_paid")


def kernel_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed price over quantity at six centres per return flag."""
    found = corpus.kernel_mean(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", (5, 15, 25, 35, 45, 50), 4.0)
    return found.withColumn("mean", F.round("mean", 2))


def lsq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted least squares of price on quantity by sums, per line status, with the residual's spread."""
    w, x, y = 1 - F.col("l_discount"), F.col("l_quantity"), F.col("l_extendedprice")
    s = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / (F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    return s.withColumn("slope", slope).select("l_linestatus", F.round("slope", 3).alias("slope"), F.round((F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"), 2).alias("intercept"))


def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failed check per line, counted, and the lines that pass."""
    reason = corpus.first_reason((F.col("l_quantity") > 45, "range"), (F.col("l_discount") >= 0.09, "discount"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 4), "locked"))
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of orders with the best of three sources of a score, refined before manual before full scan."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.max("l_discount"), 4).alias("most"))
    sources = (
        lines.where("lines >= 6").select("l_orderkey", F.lit(0).alias("rank"), F.lit("refined").alias("source"), "most")
        .unionByName(lines.where("lines % 2 = 0").select("l_orderkey", F.lit(1).alias("rank"), F.lit("manual").alias("source"), "most"))
        .unionByName(lines.where("most >= 0.05").select("l_orderkey", F.lit(2).alias("rank"), F.lit("full_scan").alias("source"), "most"))
    )
    best = sources.groupBy("l_orderkey").agg(F.min_by(F.struct("source", "most"), "rank").alias("b")).select("l_orderkey", "b.*")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(best, F.col("o_orderkey") == F.col("l_orderkey"), "full").select(F.coalesce("o_orderkey", "l_orderkey").alias("id"), F.coalesce("o_orderstatus", F.lit("none")).alias("status"), F.coalesce("source", F.lit("base")).alias("source"), "most")


def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each user's day-to-day parameter maps that changed, appeared or vanished, counted."""
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    maps = daily.groupBy("user_id", "day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("params"))
    before = F.coalesce(F.lag("params").over(Window.partitionBy("user_id").orderBy("day")), F.create_map().cast("map<string,bigint>"))
    pairs = maps.withColumn("before", before).select("user_id", "day", F.map_zip_with("before", "params", lambda k, a, b: ~a.eqNullSafe(b)).alias("changed"))
    names = F.array_sort(F.map_keys(F.map_filter("changed", lambda k, v: v)))
    return pairs.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join(names, ",").alias("changed"))


QUERIES = {f.__name__: f for f in (pct_table, band_table, ab_report, spearman, average_ranks, linspace_sample, stratified_quota, round_robin, nearest_median, monotone_check, golden_compare, manifest_diff, bench_compare, interp_lookup, as_of_join, kernel_smooth, lsq_fit, validate_lines, precedence_merge, key_changes)}


def _linspace(source: str, keys: str, order: str, n: int, out: str) -> str:
    return f"""SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS at_, count(*) OVER (PARTITION BY {keys}) AS size_ FROM {source})
               WHERE size_ <= {n} OR at_ IN (SELECT floor(i * (size_ - 1) / {n - 1} + 0.5) FROM (SELECT unnest(range(0, {n})) AS i))"""


ORACLES = {
    "pct_table": "WITH u AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM lineitem" for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ") SELECT l_returnflag, metric, count(*) AS n, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(min(v), 4) AS low, round(max(v), 4) AS high FROM u GROUP BY ALL",
    "band_table": """
        WITH b AS (SELECT l_returnflag, l_discount AS d, l_tax AS t, CASE WHEN l_quantity < 10 THEN 'indoor' WHEN l_quantity < 30 THEN 'normal' ELSE 'night' END AS band FROM lineitem),
        p AS (SELECT l_returnflag, band, CASE band WHEN 'indoor' THEN d <= 0.05 WHEN 'night' THEN d <= 0.08 AND t <= 0.06 ELSE CASE WHEN t >= 0.02 THEN d / t <= 1.5 ELSE true END END AS ok FROM b)
        SELECT band, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (l_returnflag = 'A'), 6) AS share_a, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (l_returnflag = 'N'), 6) AS share_n,
               round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (l_returnflag = 'R'), 6) AS share_r FROM p GROUP BY band""",
    "ab_report": """
        WITH r AS (SELECT l_returnflag, l_extendedprice AS a, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS b FROM lineitem)
        SELECT l_returnflag, count(*) AS n, round(quantile_cont(a, 0.5), 3) AS a50, round(quantile_cont(a, 0.95), 3) AS a95, round(quantile_cont(b, 0.5), 3) AS b50, round(quantile_cont(b, 0.95), 3) AS b95,
               count_if(b < a) AS improved, round(max(b - a), 3) AS worst, quantile_cont(b, 0.5) <= quantile_cont(a, 0.5) AS gate FROM r GROUP BY GROUPING SETS ((l_returnflag), ())""",
    "spearman": """
        WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part)
        SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""",
    "average_ranks": "WITH r AS (SELECT o_orderkey, floor(o_totalprice / 1000) AS k FROM orders) SELECT o_orderkey, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2 AS rank FROM r",
    "linspace_sample": _linspace("documents", "source, lang", "n_chars, doc_id", 7, "source, lang, doc_id, n_chars"),
    "stratified_quota": f"""
        WITH r AS (SELECT o_orderkey, o_orderstatus, o_custkey % 10 AS grp, o_totalprice FROM orders),
        h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus, grp ORDER BY o_totalprice, o_orderkey) <= count(*) OVER (PARTITION BY o_orderstatus, grp) // 2 THEN 'spike' ELSE 'flat' END AS half FROM r)
        {_linspace("(SELECT * FROM h WHERE half = 'spike')", "o_orderstatus, grp", "o_totalprice, o_orderkey", 2, "o_orderkey, grp, half")}
        UNION ALL {_linspace("(SELECT * FROM h WHERE half = 'flat')", "o_orderstatus, grp", "o_totalprice, o_orderkey", 3, "o_orderkey, grp, half")}""",
    "round_robin": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents QUALIFY turn <= 4",
    "nearest_median": "WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, p_partkey FROM part JOIN m USING (p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - m), p_partkey) = 1",
    "monotone_check": "WITH r AS (SELECT l_orderkey, l_extendedprice >= lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS ok FROM lineitem) SELECT l_orderkey, bool_and(coalesce(ok, true)) AS falling FROM r GROUP BY l_orderkey",
    "golden_compare": """
        WITH e AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS expected FROM documents), a AS (SELECT doc_id, quality * 1500.0::DOUBLE + 500 AS actual FROM labels)
        SELECT doc_id, expected, actual, abs(actual - expected) AS delta, CASE WHEN actual IS NULL THEN 'missing' WHEN abs(actual - expected) <= 300 + CASE WHEN abs(expected) > 1.5 THEN 0.5 * abs(expected) ELSE 0 END THEN 'matched' ELSE 'failed' END AS verdict FROM e LEFT JOIN a USING (doc_id)""",
    "manifest_diff": """
        WITH e AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 11 <> 0),
        f AS (SELECT c_custkey, c_mktsegment AS s FROM customer)
        SELECT coalesce(f.c_custkey, e.c_custkey) AS c_custkey, CASE WHEN e.c_custkey IS NULL THEN 'added' WHEN f.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM f FULL JOIN e ON f.c_custkey = e.c_custkey WHERE e.c_custkey IS NULL OR f.c_custkey IS NULL OR e.s <> f.s""",
    "bench_compare": """
        WITH n AS (SELECT l_suppkey, round(avg(l_extendedprice), 4) AS new FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1), o AS (SELECT l_suppkey, round(avg(l_extendedprice), 4) AS old FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1)
        SELECT l_suppkey, old, new, round(new / old, 5) AS ratio, new > 1.2 * old AS slower FROM n JOIN o USING (l_suppkey)""",
    "interp_lookup": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 0 THEN 0.0 "
    + " ".join(f"WHEN l_quantity <= {x1} THEN {y0} + (l_quantity - {x0}) * ({y1 - y0} / {x1 - x0})" for (x0, y0), (x1, y1) in zip(CURVE[:-1], CURVE[1:], strict=True))
    + " ELSE 9.0 END, 6) AS curve, round("
    + " + ".join(f"CASE WHEN l_quantity BETWEEN {lo} AND {hi} THEN {a} ELSE 0.0 END" for lo, hi, a in WINDOWS)
    + ", 6) AS windows FROM lineitem",
    "as_of_join": "SELECT e.user_id, e.event_id, b.value AS last_paid FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts",
    "kernel_smooth": """
        WITH c AS (SELECT unnest([5.0, 15.0, 25.0, 35.0, 45.0, 50.0])::DOUBLE AS centre)
        SELECT l_returnflag, centre, round(sum(exp(-pow((l_quantity - centre) / 4.0, 2) / 2) * l_extendedprice) / sum(exp(-pow((l_quantity - centre) / 4.0, 2) / 2)), 2) AS mean FROM lineitem, c GROUP BY ALL""",
    "lsq_fit": """
        WITH s AS (SELECT l_linestatus, sum(1 - l_discount) AS w, sum((1 - l_discount) * l_quantity) AS wx, sum((1 - l_discount) * l_extendedprice) AS wy, sum((1 - l_discount) * l_quantity * l_quantity) AS wxx, sum((1 - l_discount) * l_quantity * l_extendedprice) AS wxy FROM lineitem GROUP BY 1),
        f AS (SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS slope FROM s) SELECT l_linestatus, round(slope, 3) AS slope, round((wy - slope * wx) / w, 2) AS intercept FROM f""",
    "validate_lines": """
        SELECT CASE WHEN l_quantity > 45 THEN 'range' WHEN l_discount >= 0.09 THEN 'discount' WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber > 4 THEN 'locked' ELSE 'accepted' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""",
    "precedence_merge": """
        WITH l AS (SELECT l_orderkey, count(*) AS lines, round(max(l_discount), 4) AS most FROM lineitem GROUP BY 1),
        b AS (SELECT l_orderkey, most, CASE WHEN lines >= 6 THEN 'refined' WHEN lines % 2 = 0 THEN 'manual' ELSE 'full_scan' END AS source FROM l WHERE lines >= 6 OR lines % 2 = 0 OR most >= 0.05),
        o AS (SELECT o_orderkey, o_orderstatus FROM orders)
        SELECT coalesce(o_orderkey, l_orderkey) AS id, coalesce(o_orderstatus, 'none') AS status, coalesce(source, 'base') AS source, most FROM o FULL JOIN b ON o_orderkey = l_orderkey""",
    "key_changes": """
        WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), days AS (SELECT DISTINCT user_id, day FROM d),
        p AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prior FROM days),
        k AS (SELECT p.user_id, p.day, t.event_type, a.n AS now, b.n AS was FROM p CROSS JOIN (SELECT DISTINCT event_type FROM events) t
              LEFT JOIN d a ON a.user_id = p.user_id AND a.day = p.day AND a.event_type = t.event_type LEFT JOIN d b ON b.user_id = p.user_id AND b.day = p.prior AND b.event_type = t.event_type)
        SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (now IS DISTINCT FROM was), '') AS changed FROM k GROUP BY user_id, day""",
}
