"""JSON texts and document sources."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents as texts
from tessera.sources import documents


def test_canonical_texts(spark):
    rows = [(1, '{"b": [1, {"d": 1, "c": null}], "a": "x"}', '{"a":"x","b":[1,{"c":null,"d":1}]}'), (2, None, None), (3, "{broken", "{broken"), (4, "", None), (5, "[2, 1]", "[1, 2]"), (6, '"é"', '"\\u00e9"')]
    frame = spark.createDataFrame(rows, "id int, a string, b string")
    a, b = F.col("a"), F.col("b")
    found = {r.id: r for r in frame.select("id", texts.canonical(a).alias("text"), texts.digest(a).alias("digest"), texts.same(a, b).alias("same"), F.to_json(texts.parsed(a, "[]")).alias("parsed")).collect()}
    assert found[1].text == rows[0][2] and found[1].digest == hashlib.sha256(rows[0][2].encode()).hexdigest()
    assert [found[k].same for k in range(1, 7)] == [True, True, False, False, False, True]
    assert [found[k].parsed for k in (2, 3, 4, 5)] == ["[]", "[]", "[]", "[2,1]"] and found[3].digest is None


def test_document_files(spark, tmp_path):
    one = {"id": "x", "title": "T", "content": "C", "tags": ["a", "b"]}
    for name, content in {"a.json": [one, {"content": "no id"}, 7], "b.json": {"documents": [{"title": "d"}]}, "c.json": {"docs": [], "id": "never"}, "d.json": {"id": 5, "content": "alone"}}.items():
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    found = sorted((r.file, r.place, r.id, r.title, r.content, r.tags) for r in documents.document_files(spark, f"{tmp_path}/*.json").collect())
    assert found == [("a.json", 0, "x", "T", "C", ["a", "b"]), ("a.json", 1, "rag_doc_2", "", "no id", []), ("b.json", 0, "rag_doc_1", "d", "", []), ("d.json", 0, "5", "", "alone", [])]
    (tmp_path / "e.json").write_text("{nothing")
    with pytest.raises(Exception, match="not JSON: e.json"):
        documents.document_files(spark, f"{tmp_path}/*.json").collect()
    digests = {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in documents.file_digests(spark, str(tmp_path)).collect()}
    assert digests["e.json"] == (8, hashlib.sha256(b"{nothing").hexdigest()) and len(digests) == 5


def test_a_failing_item_is_an_error_row(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, None)], "id int, x double")
    found = documents.attempted(frame, lambda row: {"inverse": 1 / row["x"], "id": row["id"]})
    found.write.json(str(tmp_path / "out"))
    rows = {r.id: r for r in spark.read.schema(found.schema).json(str(tmp_path / "out")).collect()}
    assert json.loads(rows[1].result) == {"id": 1, "inverse": 0.5} and rows[1].error is None
    assert rows[2].result is None and rows[2].error.startswith("ZeroDivisionError") and rows[3].error.startswith("TypeError")


def test_rule_packs_are_checked(spark):
    from tessera.sources import rule_files

    good = {"rule_id": "a", "condition": {"metric": "m", "op": "lt", "value": 1}, "action": {"param": "p", "value": 2}}
    assert rule_files.problems([good], {"m"}) == []
    cases = [
        (good | {"condition": {"metric": "mm", "op": "lt", "value": 1}}, "unknown metric 'mm'"), (good | {"condition": {"all": [good["condition"], {"metric": "x", "op": "gt", "value": 0}]}}, "unknown metric 'x'"),
        (good | {"action": {"param": "p"}}, "neither a formula nor a number"), (good | {"action": {"param": "p", "value": "2"}}, "neither a formula"), (good | {"action": {"param": "p", "value": True}}, "neither a formula"),
        (good | {"condition": {"metric": "m", "op": "lt"}}, "without metric or value"), (good | {"action": {"param": "p", "formula": "m * unknown"}}, "unknown names"),
    ]
    for record, message in cases:
        with pytest.raises(ValueError, match=message):
            rule_files.load_rules(spark, [record], {"m"})
    assert len(rule_files.load_rules(spark, [good | {"condition": None}, good | {"action": {"param": "p", "formula": "m + 1"}}], {"m"})) == 2


def test_equal_knots_share(spark):
    from tessera.operators import records

    frame = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.5,), (9.0,), (None,)], "x double")
    found = [None if r.w is None else [(w.knot, w.weight) for w in r.w] for r in frame.select(records.knot_weights(F.col("x"), [1, 2, 2, 3]).alias("w")).collect()]
    assert found == [[(0, 1.0)], [(0, 1.0)], [(0, 0.5), (1, 0.25), (2, 0.25)], [(1, 0.5), (2, 0.5)], [(1, 0.25), (2, 0.25), (3, 0.5)], [(3, 1.0)], None]
    with pytest.raises(ValueError, match="ascend"):
        records.knot_weights(F.col("x"), [2, 1])
