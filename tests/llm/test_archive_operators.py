"""WARC archives, whitening and lexical search against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical, queries, warc, whitening
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def _when():
    return F.timestamp_seconds(F.pmod("page_id", F.lit(10**9)))


@tables
@pytest.mark.parametrize("name", ["op11_warc", "op13_lexical"])
def test_query_matches_sql(spark, name):
    found = oracle.rows(queries.QUERIES[name](spark, SF_DIR).toPandas())
    assert found == oracle.rows(oracle.connect(SF_DIR).execute(queries.ORACLES[name]).df())


def _pages():
    big = "<p>x</p>" * 300
    rows = [(1, "http://a.b/x", big), (5, "http://B.a.b:80/y?q#f", big), (3, "http://a.b/x", big), (5, "http://a.b/x", big)]
    rows += [(7, None, None), (8, "no scheme", ""), (None, "http://a.b/\r\nWARC/1.1", big), (9, "http://ü.de/é", "é\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    rows += [(None, "http://n.n/", "n" * 2000), (None, "http://n.n/", "n" * 2000), (10, "http://s.t/", "small"), (11, "http://s.t/", "small")]
    return rows + [(20 + i, "http://hot.net/", f"<b>{i % 7}</b>" + "z" * 1200) for i in range(60)] + [(99, "http://long.net/", "line\r\n" * 400_000)]


def test_archives_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 30_000)
    rows = _pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("clash")).withColumn("part", F.lit(1))
    folder = "file://" + tempfile.mkdtemp(prefix="spark-warc-") + "/archives"
    index = warc.archive(frame, _when(), folder)
    found = index.collect()
    expected = []
    for key, _, html in rows:
        payload = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "").encode() == payload and k is not None]
        revisits = len(payload) >= 1000 and ids and (key is None or key < max(ids))
        expected.append((key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisits else "response", max(ids) if revisits else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(expected, key=str)
    assert {r.intact for r in found} == {True, None}
    assert len({r.archive for r in found}) > 3
    found.sort(key=lambda r: (r.part, r.place))
    order = [(r.url_key, r.captured, r.archive, r.offset) for r in found]
    assert order == sorted(order)
    assert {r.url_key for r in found} >= {"b,a)/x", "b,a,b)/y?q", ")/", "net,hot)/", "de,ü)/é"}
    # An entry's offset and length find its record.
    entry = next(r for r in found if r.page_id == 9)
    with open(folder.removeprefix("file://") + "/" + entry.archive, "rb") as file:
        file.seek(entry.offset)
        (_, _, fields, block), = warc.parse(file.read(entry.length))
    assert fields["warc-target-uri"] == "http://ü.de/é" and block.partition(b"\r\n\r\n")[2] == rows[7][2].encode()
    assert warc.archive(frame.where("false"), _when()).count() == 0


def _dealt(spark):
    """Bytes that all stages so far have written to shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_payloads_without_copies_are_not_dealt(spark):
    """Distinct payloads stay in their tasks, also where no join is small; those with copies, and very long ones, are found and dealt."""
    pick = random.Random(11)
    rows = [(i, "http://a.b/", f"{pick.getrandbits(16000):x}") for i in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    frame.write.parquet(path := tempfile.mkdtemp(prefix="spark-warc-") + "/pages")
    before = _dealt(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = warc.archive(spark.read.parquet(path), _when()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 400 and all(r.record_type == "response" for r in found)
    assert _dealt(spark) - before < sum(len(html) for _, _, html in rows) / 4
    again = rows + [(1000 + i, "http://c.d/", html) for i, _, html in rows[:50]] + [(5000, "http://l.m/", "x" * 100_000)]
    found = {r.page_id: r for r in warc.archive(spark.createDataFrame(again, frame.schema).repartition(3), _when()).collect()}
    assert {k: r.refers_to for k, r in found.items() if r.record_type == "revisit"} == {i: 1000 + i for i in range(50)}
    assert len(found) == 451 and all(r.intact in (True, None) for r in found.values())


def test_broken_archives_are_refused():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError, match="doesn't end"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 16])
def test_loser_tree(count):
    pick = random.Random(count)
    runs = [sorted(pick.choices(range(40), k=pick.randrange(0, 30))) for _ in range(count)]
    keys = [k for run in runs for k in run]
    ends = np.cumsum([len(r) for r in runs]).tolist()
    places = list(warc.LoserTree(keys, list(zip([0, *ends], ends, strict=False))).merged())
    assert sorted(places) == list(range(len(keys)))
    assert [(keys[p], p) for p in places] == sorted((k, i) for i, k in enumerate(keys))


def _whitened(vectors, components=16):
    """Plain: (n, deviations, whitened up to sign, shares) of integer vectors."""
    fit = np.unique(vectors, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    apart = fit - sums / n
    spread, axes = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-spread)[:components]
    return n, ((n * vectors - sums) ** 2).sum(axis=1), (vectors - sums / n) @ axes[:, order] / np.sqrt(spread[order]), spread[order] / spread.sum()


def _against_plain(found, ids, vectors):
    n, deviation, white, shares = _whitened(vectors)
    by_key = {}
    for r in found:
        by_key.setdefault((r.vec_id, r.component), []).append(r)
    assert {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9
    assert len(found) == len(ids) * len(shares)
    for component in range(len(shares)):
        signs = set()
        for i, key in enumerate(ids):
            row = by_key[(key, component + 1)][0]
            assert row.deviation == deviation[i]
            assert math.isclose(row.explained, shares[component], rel_tol=1e-9)
            assert math.isclose(abs(row.whitened), abs(white[i, component]), rel_tol=1e-6, abs_tol=1e-8)
            if abs(white[i, component]) > 1e-3:
                signs.add(row.whitened * white[i, component] > 0)
        assert len(signs) == 1


@tables
def test_whitening_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect() if r.embedding is not None and np.isfinite(r.embedding).all()]
    vectors = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000
    _against_plain(queries.QUERIES["op12_whitening"](spark, SF_DIR).collect(), [r.vec_id for r in rows], vectors)


def test_whitening_cases(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    generator = np.random.default_rng(7)
    vectors = (generator.normal(size=(150, 20)) * np.linspace(1, 30, 20) + 5000).astype(np.float32)
    vectors[40:90] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(500, None), (501, []), (502, [float("nan")] * 20), (503, [None] + [1.0] * 19), (504, [float("inf")] * 20), (505, [1.0, 2.0])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("index", F.lit("x")).withColumn("x", F.lit(1)).repartition(5)
    exact = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    _against_plain(whitening.whiten(frame).collect(), list(range(150)), exact)
    assert whitening.whiten(frame.where("false")).count() == 0
    # Without variance: a constant dimension, equal vectors, one vector; entries out of range and null ids stay.
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 3.0])], "vec_id int, embedding array<double>")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(flat).collect()}
    assert len(found) == 6 and found[(1, 2)].whitened is None and found[(1, 2)].explained == 0.0
    assert abs(found[(1, 1)].whitened) == pytest.approx(1) and found[(1, 1)].explained == 1.0 and found[(1, 1)].deviation == 64 * 64
    same = whitening.whiten(flat.where("vec_id = 1")).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in same] == [(None, 0.0, 0, 0.0)] * 2
    far = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id int, embedding array<double>")).collect()
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in far)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(documents, items, k):
    """Plain: every document scored for every item."""
    lists = [(doc, _terms(text)) for doc, text in documents]
    lists = [x for x in lists if x[1]]
    count, total = len(lists), sum(len(t) for _, t in lists)
    holding = {}
    for _, terms in lists:
        for term in set(terms):
            holding[term] = holding.get(term, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, own in lists:
            m = 100 - 50 + (50 * len(own) * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * holding[t] + 1))) * ((10**9 * own.count(t)) // (1000 * own.count(t) + 20 * m)) for t in terms if t in holding)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, i + 1, doc, -score) for i, (score, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_lexical_against_all_scores(spark, monkeypatch):
    pick = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "straße", "x_y", "a-b", "I"]
    common = ["the", "of"]
    documents = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 30)) + pick.choices(common, k=3))) for i in range(400)]
    documents += [(1000 + i, documents[7][1]) for i in range(150)] + [(None, documents[7][1]), (None, "w1 W1 w2"), (7, documents[7][1])]
    documents += [(2000, None), (2001, ""), (2002, "?!"), (2003, "w5 " * 30_000), (2004, "w3\x00w4 w5 \U0001f600")]
    items = [(i, " ".join(pick.choices(words, k=12))) for i in range(9)] + [(0, "w59 w58"), (0, "w59 w58"), (50, None), (51, "nowhere"), (None, "the w1"), (52, documents[7][1])]
    expected = {k: _ranked(documents, items, k) for k in (5, 50)}
    frame = spark.createDataFrame(documents, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("item", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    for block, chars, k in ((4096, 4_000_000, 50), (32, 400, 5)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "PASS_CHARS", chars)
        found = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(frame, asked, k).collect()), key=str)
        assert found == expected[k]
    assert lexical.rank(frame.where("false"), asked).count() == 0
    assert lexical.rank(frame, asked.where("false")).count() == 0


def test_tree_leaves_branches_out():
    vectors = [(np.array([0, 1 + i % 5, 10 + i]), np.array([1, 1, 1]), 100, [(False, i)]) for i in range(200)] + [(np.array([0, 3, 9]), np.array([5, 5, 5]), 50, [(False, 999)])]
    holders = [np.array([0]) if t < 10 else np.empty(0, np.int64) for t in range(250)]
    items = lexical.Items(holders, np.full(250, 1000, np.int64), 1)
    seen = []
    scores = items.scores
    items.scores = lambda of, terms, tf, m: seen.append(len(m)) or scores(of, terms, tf, m)
    best = lexical.Best(np.array([int(scores(np.zeros(3, np.int64), np.array([0, 3, 9]), np.array([5, 5, 5]), np.array([50]))[0, 0])]), 1)
    lexical.Tree(vectors).search(items, best)
    best.shrink(0)
    assert [x[1][1] for x in best.found[0]] == [999]
    assert sum(seen) < 60
