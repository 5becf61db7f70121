"""Unit tests of operators on small literal frames."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import color, dates, formula, text
from tessera.operators import batch, corpus, kernels, patches, retrieval, reviewing, rules, sequences, states, stretches, trails
from tessera.plans.stages import Plan, available
from tessera.sources import files, rule_files, sinks
from tessera.streaming import streams


def test_formula(spark):
    row = spark.range(1).select(F.lit(118.0).alias("target"), F.lit(95.0).alias("current"), F.lit(None).cast("double").alias("gone"))
    given = {c: F.col(c) for c in row.columns}
    value = row.select(formula.compile_formula("2.2*log2(target/current)", given).alias("a"), formula.compile_formula("1/(target-target)", given).alias("b"), formula.compile_formula("gone+1", given).alias("c"), formula.compile_formula("1 if target > current else min(2, 3)", given).alias("d")).first()
    assert value.a == pytest.approx(0.68806, abs=1e-4) and value.b is None and value.c is None and value.d == 1.0
    for bad in ("__import__('os')", "target.x", "other + 1", "[1]", "target if"):
        with pytest.raises((ValueError, SyntaxError)):
            formula.compile_formula(bad, given)
    assert formula.unknown_names("a + log2(b)", {"a"}) == ["b"]


def test_exposure_rule_is_clamped(spark):
    row = spark.createDataFrame([("p", 95.0, 0.03)], "id string, face_luminance double, preview_highlight_clip_estimate double")
    found = {r.param: r for r in rules.apply(row, "id", ["face_luminance", "preview_highlight_clip_estimate"]).collect()}
    assert found["exposure_ev"].new_value == -0.15 and found["exposure_ev"].rule_id == "highlight_protect_rule_002"
    assert found["tone.highlights"].new_value == -0.08
    hits = rules.evaluate(row, "id", ["face_luminance", "preview_highlight_clip_estimate"])
    assert {r.rule_id for r in hits.collect()} == {"exposure_rule_001", "highlight_protect_rule_002", "highlight_recover_rule_033"}
    assert rules.apply(row, "id", ["face_luminance", "preview_highlight_clip_estimate"], locked=["exposure_ev"]).count() == 1


def test_conditions(spark):
    row = spark.createDataFrame([(5.0, "x", None)], "m double, s string, gone double")
    given = {c: F.col(c) for c in row.columns}
    checks = {
        "between": (rules.Condition("m", "between", (5, 6)), True), "in": (rules.Condition("s", "in", ("x", "y")), True), "missing": (rules.Condition("nope", "gt", 1), False), "null": (rules.Condition("gone", "ne", 1), False), "ne": (rules.Condition("m", "ne", 5), False),
    }
    found = row.select(*[rules.predicate(c, given).alias(n) for n, (c, _) in checks.items()]).first().asDict()
    assert found == {n: e for n, (_, e) in checks.items()}
    gate = spark.createDataFrame([(0.02, 0, False), (0.04, 0, False), (0.04, 1, False), (0.04, 0, True), (None, 0, False)], "r double, n int, locked boolean")
    assert [r[0] for r in gate.select(rules.qc_rollback(F.col("r"), F.col("n"), F.col("locked"))).collect()] == ["pass", "rollback", "manual_review", "manual_review", "pass"]


def test_bursts(spark):
    rows = [(1, "a", "2026-08-01 23:59:59", 50.0), (2, "a", "2026-08-02 00:00:00", 50.05), (3, "a", "2026-08-02 00:00:01", 51.0), (4, "a", None, 50.0), (5, "b", "2026-08-02 00:00:00", None), (6, "b", "2026-08-02 00:00:00", 35.0)]
    frame = spark.createDataFrame(rows, "id long, cam string, t string, f double").withColumn("t", F.to_timestamp("t"))
    found = {r.id: r.island for r in sequences.bursts(frame, ["cam"], "t", "id", 1.0, {"f": 0.1}).collect()}
    assert found == {1: 1, 2: 1, 3: 2, 4: None, 5: 1, 6: 1}
    whole = {r.id: r.island for r in sequences.global_bursts(frame, "t", "id", 1.0).collect()}
    assert len(set(whole.values())) == 1 and 4 not in whole
    assert sequences.global_bursts(frame.where("false"), "t", "id", 1.0).count() == 0
    keyed = {r.id: r.island for r in sequences.global_bursts(frame, "t", "id", 0.5, keys=["cam"]).collect()}
    assert keyed == {1: 1, 2: 2, 3: 3, 5: 1, 6: 1}
    many = spark.range(25).select(F.col("id"), F.lit(1).alias("g"))
    assert sorted(r["count"] for r in sequences.split_oversized(many, ["g"], ["id"], 10).groupBy("chunk").count().collect()) == [5, 10, 10]


def test_selection_and_ranks(spark):
    frame = spark.createDataFrame([("g", i, s) for i, s in enumerate([4.0, 4.0, 3.0, 2.0])], "g string, i int, s double")
    plain = {r.i: r.confidence for r in batch.select_top(frame, ["g"], "s", "i").collect()}
    shared = {r.i: r.confidence for r in batch.select_top(frame, ["g"], "s", "i", ties_share=True).collect()}
    assert plain == {0: 0.96, 1: 0.94, 2: 0.82} and shared == {0: 0.96, 1: 0.96, 2: 0.82}
    ranks = sorted(r.rank for r in corpus.average_ranks(frame, "s", "rank").collect())
    assert ranks == [1.0, 2.0, 3.5, 3.5]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert corpus.spearman(flat, "x", "y").first().rho == 0.0
    picked = corpus.linspace_sample(spark.range(11).withColumn("k", F.lit(1)), ["k"], ["id"], 3)
    assert sorted(r.id for r in picked.collect()) == [0, 5, 10]


def test_delta_e_pairs(spark):
    pairs = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615), (50.0, 2.8361, -74.02, 50.0, 0.0, -82.7485, 3.4412), (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669)]
    frame = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, e double")
    for r in color.delta_e_2000(frame, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d").collect():
        assert r.d == pytest.approx(r.e, abs=1e-4)


def test_color_round_trips(spark):
    frame = spark.createDataFrame([(0.2, 0.5, 0.9), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)], "r double, g double, b double")
    hsv = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    staged = frame.select("r", "g", "b", *[c.alias(n) for c, n in zip(hsv, "hsv", strict=True)])
    for row in staged.select("r", "g", "b", *[c.alias(n) for c, n in zip(color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v")), ("r2", "g2", "b2"), strict=True)]).collect():
        assert (row.r2, row.g2, row.b2) == pytest.approx((row.r, row.g, row.b), abs=1e-9)


def test_text_and_dates(spark):
    frame = spark.createDataFrame([("f/2.8", "1/0", "16:9", "if_noise_ratio_ge_0.62", "tone.x_0.5", "2026:08:01 10:00:00", "-03:30")], "a string, b string, c string, d string, e string, t string, o string")
    row = frame.select(text.ratio(F.col("a")).alias("a"), text.ratio(F.col("b")).alias("b"), text.aspect(F.col("c")).alias("c"), text.parse_condition(F.col("d")).alias("d"), text.parse_action(F.col("e")).alias("e"), dates.parse_time(F.col("t")).cast("string").alias("t"), dates.parse_offset(F.col("o")).alias("o"), dates.format_offset(F.lit(-3.5)).alias("f"), text.shutter(F.lit(0.001)).alias("s")).first()
    assert row.a == 2.8 and row.b == 1.0 and row.c == pytest.approx(16 / 9) and row.d.asDict() == {"metric": "noise_ratio", "op": "ge", "value": 0.62}
    assert row.e.asDict() == {"param": "tone.x", "value": 0.5} and row.t == "2026-08-01 10:00:00" and row.o == -3.5 and row.f == "-03:30" and row.s == "1/1000"


def test_states():
    assert len(states.ALLOWED) == 19 and not any(a in states.TERMINAL for a, _ in states.ALLOWED)


def test_patches(spark):
    rows = [("exposure.ev", "set", 2.0, None), ("exposure.ev", "delta", 4.5, None), ("nope", "set", 1.0, None), ("tone.shadows", "mul", 0.1, None), ("exposure.metering_mode", "set", None, "auto"), ("exposure.metering_mode", "set", None, "odd"), ("white_balance.tint", "set", 5.0, None), (None, "set", 1.0, None), ("tone.shadows", "set", float("nan"), None)]
    frame = spark.createDataFrame(rows, "param string, op string, value double, word string").withColumn("now", F.create_map(F.lit("exposure.ev"), F.lit(1.0)))
    accepted, rejected = patches.review(frame, "now", locked=["white_balance"])
    assert accepted.count() == 2
    assert sorted(r.reason for r in rejected.collect()) == ["locked", "op", "range", "range", "reference", "shape", "word"]
    merged = spark.range(1).select(patches.merge_deep(F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))), F.create_map(F.lit("a"), F.create_map(F.lit("y"), F.lit(3)), F.lit("b"), F.create_map(F.lit("z"), F.lit(4)))).alias("m")).first().m
    assert merged == {"a": {"x": 1, "y": 3}, "b": {"z": 4}}


def test_plan(spark):
    assert available() == ["exposure", "white_balance", "tone", "saturation", "quantise"]
    plan = Plan.from_config(Plan({"quantise": {"bits": 8}}).to_config())
    rows = spark.createDataFrame([(0.0, 0.5, 1.0)], "r double, g double, b double")
    assert [s.name for s in plan.stages()] == ["white_balance", "tone", "quantise"]
    assert tuple(plan.run(rows).first()) == (0, 188, 255)
    with pytest.raises(ValueError):
        Plan.from_config('{"start": "linear_cam", "stages": {"nope": {}}}')
    with pytest.raises(ValueError):
        Plan({}, start="gamma_rgb").run(rows)


def test_sources(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "sub").mkdir(parents=True)
    for name in ("b.NEF", "a.dng", ".hidden.dng", "c.txt", "sub/a.nef"):
        (raw / name).write_bytes(b"x" * 3)
    assert sorted(r.name for r in files.scan_directory(spark, str(raw)).collect()) == ["a.dng", "b.NEF"]
    deep = files.first_per_stem(files.scan_directory(spark, str(raw), recursive=True))
    assert sorted(r.stem for r in deep.collect()) == ["a", "b"]
    packs = tmp_path / "packs"
    packs.mkdir()
    (packs / "a.json").write_text(json.dumps({"nodes": [{"id": "n1", "label": "first"}, {"id": "n2", "label": "x"}], "edges": [{"id": "e1", "from": "n1", "to": "n2", "weight": 0.5}, {"id": "e2", "from": "n1", "to": "gone"}]}))
    (packs / "b.json").write_text(json.dumps({"nodes": [{"id": "n1", "label": "second"}], "edges": []}))
    nodes, edges = files.knowledge_packs(spark, str(packs))
    assert {r.id: r.label for r in nodes.collect()} == {"n1": "first", "n2": "x"} and [r.id for r in edges.collect()] == ["e1"]
    cards = tmp_path / "cards"
    cards.mkdir()
    (cards / "warm.json").write_text('{"stages": {"tone": {"x": 0.5}}}')
    (cards / "bad.json").write_text("{nope")
    (cards / "none.json").write_text('{"metadata": {}}')
    assert [r.style_id for r in files.style_cards(spark, str(cards)).collect()] == ["warm"]
    cube = tmp_path / "x.cube"
    cube.write_text("TITLE \"t\"\n# c\nLUT_3D_SIZE 2\n0 0 0\n1.0 0.5 0.25\n")
    assert [tuple(r) for r in files.cube_table(spark, str(cube)).orderBy("i").collect()] == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.5, 0.25)]
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\nnope\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(lines), "a long").collect()) == [1, 2]
    reports = tmp_path / "r.json"
    reports.write_text('{"photos": [{"id": "p", "v": 1.5}]}')
    assert files.json_reports(spark, str(reports), "photos", "struct<id: string, v: double>").first().v == 1.5


def test_sinks(spark, tmp_path):
    current = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n long")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, n long")
    assert {r.k: r.v for r in sinks.upsert(current, changes, ["k"], "n").collect()} == {1: "a", 2: "d", 3: "e"}
    nested = spark.createDataFrame([(1, [1, 2], None)], "k long, l array<int>, s string")
    sinks.write_csv(nested, str(tmp_path / "out"))
    assert tuple(spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out")).first()) == ("1", "[1,2]", None)
    assert "<td>[1,2]</td>" in sinks.html_report(nested, "a <b>") and "a &lt;b&gt;" in sinks.html_report(nested, "a <b>")
    path = str(tmp_path / "log")
    sinks.append(current, path)
    sinks.append(changes, path)
    log = spark.read.parquet(path)
    sinks.replace(log.where("n = 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_state_stream(spark, tmp_path):
    rows = [(1, 1, "SCREENED", ""), (1, 2, "FINAL_QC", ""), (1, 3, "MANUAL_REVIEW", " "), (1, 4, "MANUAL_REVIEW", "odd"), (1, 5, "COLOR_CORRECTING", ""), (1, 6, "STYLE_APPLIED", ""), (1, 7, "FINAL_QC", ""), (1, 8, "COLOR_CORRECTING", ""), (1, 9, "STYLE_APPLIED", ""), (1, 10, "FINAL_QC", ""), (1, 11, "EXPOSURE_ALIGNING", ""), (1, 12, "ACCEPTED", "")]
    schema = "key long, seq long, target string, reason string"
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = {r.seq: r.verdict for r in streams.to_table(streams.transitions(stream), "append").collect()}
    assert found == {1: "ok", 2: "illegal", 3: "reason", 4: "ok", 5: "ok", 6: "ok", 7: "ok", 8: "ok", 9: "ok", 10: "ok", 11: "rollback_limit", 12: "ok"}


def test_rule_priorities_and_operators(spark):
    """Levels in any case, numbers as text, the default level, and operators by their other names."""
    rule = rules.Rule("a", None, (), "p", value=1.0)
    with_level = rules.Rule("b", None, (), "p", value=1.0, level="Style_Card")
    assert [rules.priority(r) for r in (rule, with_level)] == [3000.0, 6000.0]
    assert [rules.priority(rules.Rule("c", given, (), "p", value=1.0)) for given in ("HIGH", "6000", "nonsense", 12)] == [9000.0, 6000.0, 0.0, 12.0]
    row = spark.createDataFrame([(5.0,)], "m double")
    held = {op: row.select(rules.predicate(rules.Condition("m", op, 5.0), {"m": F.col("m")})).head()[0] for op in ("<", "lte", "<=", ">", "gte", ">=", "==", "=", "!=", "neq")}
    assert [op for op, x in held.items() if x] == ["lte", "<=", "gte", ">=", "==", "="]
    with pytest.raises(ValueError):
        rules.predicate(rules.Condition("m", "about", 5.0), {"m": F.col("m")})


def test_kernels(spark):
    """Known values: equal whites change nothing, ends of the tone curve, corners of a cube table, bounds of crops."""
    one = spark.range(1)

    def values(*columns):
        return list(one.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).head())

    white = kernels.xy_to_xyz(F.lit(0.3127), F.lit(0.3290))
    assert values(*kernels.bradford([F.lit(0.2), F.lit(0.5), F.lit(0.7)], white, white)) == pytest.approx([0.2, 0.5, 0.7], abs=1e-5)
    warm = kernels.xy_to_xyz(F.lit(0.4476), F.lit(0.4074))
    assert values(*kernels.bradford(warm, warm, white)) == pytest.approx(values(*white), abs=1e-4)
    curve = [kernels.filmic(F.lit(x), F.lit(0.4), F.lit(0.5), F.lit(0.7)) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]
    found = values(*curve)
    assert found[0] == 0.0 and found[-1] == 1.0 and found == sorted(found)
    cube = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda n: (F.floor(n / 9) * 4 + F.floor(n / 3) % 3 * 2 + n % 3).cast("double"))
    assert values(kernels.tetrahedral(cube, 3, [F.lit(1.0), F.lit(0.5), F.lit(0.25)]), kernels.tetrahedral(cube, 3, [F.lit(2.0), F.lit(-1.0), F.lit(0.0)])) == [8 + 2 + 0.5, 8.0]
    assert values(*kernels.free_crop(F.lit(100), F.lit(50), [F.lit(90.0), F.lit(-5.0), F.lit(40.0), F.lit(10.0)])) == [90, 0, 10, 10]
    assert values(*kernels.ratio_crop(F.lit(100), F.lit(50), F.lit(1.0), [F.lit(0.0), F.lit(0.5)])) == [0, 0, 50, 50]
    assert values(kernels.light_source_kelvin(F.lit(21)), kernels.light_source_kelvin(F.lit(99)), kernels.reciprocal_blend(F.lit(9000.0), F.lit(2850.0), F.lit(6500.0))) == [6500.0, 0.0, 1.0]


def test_review_queue(spark):
    """Only pending items are decided; a new enqueue overwrites; actions before any are errors."""
    log = [(1, 1, "accept"), (1, 2, "enqueue"), (1, 3, "reject"), (1, 4, "accept"), (1, 5, "enqueue"), (1, 6, "edit")]
    found = reviewing.review_queue(spark.createDataFrame(log, "k int, n int, action string"), "k", ["n"], "action").orderBy("n").collect()
    assert [(r.status, r.outcome) for r in found] == [(None, "error"), ("pending", "ok"), ("rejected", "ok"), ("rejected", "error"), ("pending", "overwritten"), ("edited", "ok")]


def test_search_counts_stems(spark):
    """Term and document frequencies of the query's stems, as counted by hand."""
    rows = [(1, "cats cat dog"), (2, "dogs"), (3, "bird"), (4, None)]
    found = {r.k: r.score for r in retrieval.search(spark.createDataFrame(rows, "k int, t string"), "k", "t", ["cat", "dog"], top_k=None).collect()}
    first = math.log(1 + 4 / 1) * (1 + math.log(3)) + math.log(1 + 4 / 2) * (1 + math.log(2))
    assert found == {1: pytest.approx(first, abs=1e-4), 2: pytest.approx(math.log(3) * (1 + math.log(2)) * 0.8, abs=1e-4)}


@pytest.fixture
def many_stretches(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stretches(spark, many_stretches):
    """A hot key, a null key and a small one, cut into several stretches, against plain windows and percentiles."""
    key = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, "small")
    rows = spark.range(500).select(key.alias("k"), "id", F.pmod(F.hash("id"), 90).alias("size"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), 40).cast("double")).alias("v"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert stretches.cut(rows, ["k"], ["size", "id"]).select("__stretch").distinct().count() > 2
    w = Window.partitionBy("k").orderBy("size", "id")
    plain = rows.select("id", F.row_number().over(w).alias("p"), F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("u"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    found = stretches.placed(rows, ["k"], ["size", "id"], "size").select("id", "__place", "__used", "__size")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    exact = rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    assert {r.k: r.q for r in stretches.quantiles(rows, ["k"], "v", at).collect()} == {r.k: r.q for r in exact.collect()}
    kept = batch.within_bytes(rows, ["k"], [F.desc("id")], "size", 200)
    assert set(kept.columns) == {*rows.columns, "used"} and kept.where("used > 200").count() == 0
    rights = rows.where("id % 5 = 0").select("k", F.col("id").alias("t"), F.col("size").alias("paid"))
    lefts = rows.select("k", "id", F.col("id").alias("t"))
    seen = {r.id: r.last_paid for r in corpus.as_of(lefts, rights, ["k"], "t", "paid", "id").collect()}
    last: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        if r.id % 5 == 0:
            last[r.k] = r["size"]
        assert seen[r.id] == last.get(r.k)
    times = rows.select("k", "id", F.timestamp_seconds(F.col("id") * 2 + F.floor(F.col("id") / 37) * 50).alias("t"))
    split = sequences.global_bursts(times, "t", "id", 20.0, keys=["k"]).collect()
    whole = sequences.bursts(times, ["k"], "t", "id", 20.0).collect()
    assert {(r.id, r.island) for r in split} == {(r.id, r.island) for r in whole}
    assert max(r.island for r in whole) > 5
    ranks = {r.id: r.rank for r in corpus.average_ranks(rows.where("v is not null"), "v", "rank").collect()}
    values = [r.v for r in rows.collect() if r.v is not None]
    assert all(ranks[r.id] == sum(v < r.v for v in values) + (values.count(r.v) + 1) / 2 for r in rows.collect() if r.v is not None)


def test_streams_resume(spark, tmp_path, monkeypatch):
    """A batch that fails is given again; a later call with the folder adds to what is there, without repeats."""
    source = str(tmp_path / "in")

    def put(*rows):
        spark.createDataFrame(rows, "k long, seq long, v string").coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema("k long, seq long, v string").option("maxFilesPerTrigger", 1).parquet(source)

    folder, log = str(tmp_path / "table"), str(tmp_path / "log")
    put((1, 1, "a"), (2, 2, "b"))
    assert sorted(map(tuple, streams.upsert_table(stream(), ["k"], "seq", folder).collect())) == [(1, 1, "a"), (2, 2, "b")]
    assert streams.to_table(stream(), "append", log).count() == 2
    put((2, 3, "c"), (2, 4, "d"), (3, 5, "e"))
    merge = sinks.upsert

    def fails(*args):
        raise OSError("lost")

    monkeypatch.setattr(sinks, "upsert", fails)
    with pytest.raises(Exception, match="lost"):
        streams.upsert_table(stream(), ["k"], "seq", folder)
    monkeypatch.setattr(sinks, "upsert", merge)
    for _ in range(2):
        assert sorted(map(tuple, streams.upsert_table(stream(), ["k"], "seq", folder).collect())) == [(1, 1, "a"), (2, 4, "d"), (3, 5, "e")]
        assert streams.to_table(stream(), "append", log).count() == 5


def test_report_size(spark):
    with pytest.raises(ValueError, match="at most 3 rows"):
        sinks.html_report(spark.range(4), "t", most=3)


def test_rule_files(spark, tmp_path):
    pack = rule_files.load_rules(spark, [rule_files.to_record(r) for r in rules.PACK] + ["no record"])
    assert pack == rules.PACK
    path = tmp_path / "pack.json"
    path.write_text(json.dumps({"rule_id": "r", "condition": {"metric": "m", "op": "<", "value": 1}, "action": {"param": "p", "formula": "mm + 1", "conflict_policy": "high_priority_wins"}}))
    (rule,) = rule_files.load_rules(spark, str(path))
    assert (rule.rule_id, rule.priority, rule.conditions[0].op, rule.enabled) == ("r", None, "<", True)
    with pytest.raises(ValueError, match="mm"):
        rule_files.load_rules(spark, str(path), {"m"})
    for broken in ({"action": {"param": "p", "conflict_policy": "last"}}, {"action": {}}, {"condition": {"metric": "m", "op": "~", "value": 1}, "action": {"param": "p"}}, 7):
        with pytest.raises(ValueError):
            rule_files.load_rules(spark, broken)


def test_trails(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, None), (5, None)], "id long, f string").withColumn("k", F.lit(1))
    assert [(r.reset, r.age) for r in trails.sticky(rows, ["k"], ["id"], "f").orderBy("id").collect()] == [(True, 0), (True, 0), (False, 1), (True, 0), (False, 1)]
    assert trails.spread_sample(rows.limit(1), ["k"], ["id"], 3).count() == 1
    picked = trails.spread_sample(rows, ["k"], ["id"], 3, F.col("id") == 4)
    assert [r.id for r in picked.orderBy("id").collect()] == [1, 3, 4, 5]
    one = spark.range(1).select(trails.promotes(F.lit(1.0), F.lit(None).cast("double"), 0.1, 0.1), trails.promotes(F.lit(-8.9), F.lit(-10.0), 0.5, 0.1), trails.promotes(F.lit(-9.1), F.lit(-10.0), 0.5, 0.1)).first()
    assert tuple(one) == (False, True, False)


def test_runs_and_sticky_states_across_stretches_equal_plain_windows(spark):
    from tessera.operators import sequences, trails

    rows = [(None if i % 13 == 0 else i % 2 * (i % 3), i, None if i % 11 == 0 else "ab"[i // 7 % 2], i % 5) for i in range(400)]
    frame = spark.createDataFrame(rows, "k int, i int, s string, v int").repartition(7)
    runs = {r.i: (r.streak, r.converged) for r in sequences.run_lengths(frame, ["k"], ["i"], F.col("v") < 3, 2).collect()}
    states = {r.i: (r.reset, r.age) for r in trails.sticky(frame, ["k"], ["i"], "s").collect()}
    last = {}
    for k, i, s, v in rows:
        streak, before, age = last.get(k, (0, "none", 0))
        streak, reset = streak + 1 if v < 3 else 0, before != s
        age = 0 if reset else age + 1
        last[k] = (streak, s, age)
        assert runs[i] == (streak, streak >= 2)
        assert states[i] == (reset, age)
    assert len(runs) == len(states) == 400


def test_chains_and_digests_without_lists_per_key(spark):
    import hashlib

    from tessera.operators import sequences, stretches

    events = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b"), (2, 2, "a"), (3, 1, None), (None, 1, "a"), (None, 2, "b")], "k int, t int, e string")
    found = {r.k: r.found for r in sequences.contains_chain(events, "k", "e", ["t"], ["a", "b", "a"]).collect()}
    assert found == {1: True, 2: False, 3: False, None: False}
    assert all(r.found for r in sequences.contains_chain(events, "k", "e", ["t"], []).collect())
    rows = spark.createDataFrame([(None if i % 3 == 0 else 1, i, str(i) if i % 4 else None) for i in range(50)], "k int, i int, t string").repartition(5)
    digests = {r.k: (r.n, r.digest) for r in stretches.digests(rows, ["k"], ["i"], F.col("t"), 7).collect()}
    for key, ids in ((None, [i for i in range(50) if i % 3 == 0]), (1, [i for i in range(50) if i % 3])):
        texts = [str(i) if i % 4 else "" for i in ids]
        parts = [hashlib.md5(",".join(texts[n : n + 7]).encode()).hexdigest() for n in range(0, len(texts), 7)]
        assert digests[key] == (len(ids), hashlib.md5(",".join(parts).encode()).hexdigest())
    assert stretches.digests(rows.limit(0), ["k"], ["i"], F.col("t")).count() == 0


def test_prompts_boxes_and_changes(spark):
    from tessera.operators import records

    rows = [("q", 1, "L", "Same  text", 0.5), ("q", 2, "", "same TEXT", 0.9), ("q", 3, "M", "x" * 2000, 0.4), ("q", 4, "N", "late", 0.1), ("e", 5, "L", " ", 1.0), ("n", 6, None, "only", None)]
    found = {r.k: r.prompt for r in records.prompt(spark.createDataFrame(rows, "k string, i int, l string, c string, f double"), "k", "l", "c", "f", "i").collect()}
    assert set(found) == {"q", "n"} and found["n"] == "[知识] only (conf=0.00)"
    assert found["q"].startswith("[知识] same TEXT (conf=0.90)\n[M] xxx") and found["q"].endswith("x…") and len(found["q"]) == 1200
    one = spark.range(1)
    none, big, small = F.lit(None).cast("array<array<double>>"), F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.5, 0.5)])), F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.05, 0.05)]))
    boxes = one.select(records.main_box(none, big).alias("a"), records.main_box(small, big).alias("b"), records.main_box(none, none).alias("c")).first()
    assert boxes.a == [0.0, 0.0, 0.5, 0.5] and boxes.b is None and boxes.c is None
    maps = [F.from_json(F.lit(t), "map<string,string>") for t in ('{"a":"1","b":"2","c":"3","d":"4","e":"5"}', '{"a":"1"}')]
    summary = one.select(records.change_summary(maps[1], maps[0]).alias("s"), records.change_summary(F.lit(None).cast("map<string,string>"), maps[1]).alias("n"), records.change_summary(maps[0], F.lit(None).cast("map<string,string>")).alias("m")).first()
    assert summary.s == "b: None → 2, c: None → 3, d: None → 4, e: None → 5" and summary.n == "a: None → 1" and summary.m.endswith(" (+1 more)")
    weights = one.select(records.knot_weights(F.lit(1.5), [1.0, 2.0, 4.0]).alias("a"), records.knot_weights(F.lit(2.0), [1.0, 2.0, 4.0]).alias("b"), records.knot_weights(F.lit(9.0), [1.0, 2.0]).alias("c"), records.knot_weights(F.lit(None).cast("double"), [1.0, 2.0]).alias("d")).first()
    assert [tuple(w) for w in weights.a] == [(0, 0.5), (1, 0.5)] and [tuple(w) for w in weights.b] == [(1, 1.0)] and [tuple(w) for w in weights.c] == [(1, 1.0)] and weights.d is None
