"""URL rules, nearest neighbours, and the pipeline."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import cross_polytope, queries, url_rules
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    best = None
    for rule, verdict in rules:
        own, _, tail = rule.partition("/")
        tail = "/" + tail if "/" in rule else ""
        if (host == own or host.endswith("." + own)) and path.startswith(tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_url_rules(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "STRETCH_ROWS", 8)
    rules = [*queries.URL_RULES, ("a.example.net/", "allow"), ("example.net/en/deep/", "block"), ("com", "block")]
    urls = ["http://EXAMPLE.net/en/x?y#z", "https://a.b.org/fr/", "ftp://net", "http://net/", "http://x.net?/en/", "nothing", "", None, "http://", "http://a.example.net/q", "http://www.a.example.net/en/deep/1", "http://example.com/de/1", "http://com", "http://sub.example.com/de", "http://notnet/", "http://hot.net/1"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])] + [(100 + i, "http://hot.net/1") for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    found = url_rules.judge(frame, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(found) == len(rows)
    expected = sorted(((k, *_verdict(u, rules)) for k, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found), key=str) == expected
    assert url_rules.judge(frame.where("false"), spark.createDataFrame(rules, "rule string, verdict string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_url_query_matches_sql(spark):
    found = oracle.rows(queries.QUERIES["op7_urls"](spark, SF_DIR).toPandas())
    assert found == oracle.rows(oracle.connect(SF_DIR).execute(queries.ORACLES["op7_urls"]).df())


def test_cross_polytope(spark, monkeypatch):
    generator = np.random.default_rng(4)
    turned = cross_polytope.rotate(np.eye(64), 1)
    assert np.allclose(turned @ turned.T, np.eye(64))
    vectors = generator.normal(size=(600, 24))
    vectors[300:360] = vectors[5]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1100, [0.0] * 24), (1200, [float("nan")] + [1.0] * 23), (1300, [1.0, 2.0]), (None, [1.0] * 24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("score", F.lit("x"))
    for block in (4096, 16):
        monkeypatch.setattr(cross_polytope, "BLOCK", block)
        found = cross_polytope.search(frame, frame.where("vec_id % 100 = 0"), k=10).collect()
        answers: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
            answers.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(answers) == {0, 100, 200, 300, 400, 500}
        hit = 0
        for q, got in answers.items():
            distances = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
            distances[q] = np.inf
            best = np.lexsort((np.arange(600), distances))[:10]
            hit += len(set(best.tolist()) & {v for v, _ in got})
            assert all(abs(s - distances[v]) < 1e-12 for v, s in got) and [s for _, s in got] == sorted(s for _, s in got)
        assert hit / 60 >= 0.9
        assert [v for v, _ in answers[300]] == [5, *range(301, 310)]
    assert cross_polytope.search(frame.where("false"), frame.where("false")).count() == 0


def _exact(rows, query, k):
    """The k nearest ids of a query (vec_id, vector), each id once with its nearest vector."""
    found = {}
    for i, v in rows:
        if i != query[0] and len(v) == len(query[1]):
            d = float(np.sqrt(((np.array(v) - query[1]) ** 2).sum()))
            found[i] = min(d, found.get(i, np.inf))
    return [i for i, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))[:k]]


def _answers(found):
    answers: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(answers.setdefault(r.query_id, [])) + 1
        answers[r.query_id].append(r.vec_id)
    return answers


@pytest.mark.parametrize("block", [4096, 16])
def test_cross_polytope_answers_in_full(spark, monkeypatch, block):
    """Small tables, and a query opposite the only cluster, get min(k, candidates) answers."""
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    generator = np.random.default_rng(8)
    centre = np.zeros(64)
    centre[:8] = 5.0
    small = [(i, v.tolist()) for i, v in enumerate(generator.normal(size=(11, 64)))] + [(50, [1.0, 2.0]), (51, [2.0, 2.0])]
    cluster = [(i, (centre + 0.01 * v).tolist()) for i, v in enumerate(generator.normal(size=(300, 64)))] + [(1000, (-centre).tolist())]
    for rows, ask in ((small, [0, 7, 50]), (cluster, [1000])):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        answers = _answers(cross_polytope.search(frame, frame.where(F.col("vec_id").isin(ask)), k=10).collect())
        assert answers == {i: _exact(rows, (i, v), 10) for i, v in rows if i in ask}


def test_cross_polytope_repeated_ids(spark):
    """Repeated rows, and an id with many vectors, push no other id out."""
    generator = np.random.default_rng(9)
    vector = generator.normal(size=16)
    same = [(1, vector.tolist())] * 40 + [(i, vector.tolist()) for i in range(2, 20)]
    many = [(1, (vector + 1e-6 * v).tolist()) for v in generator.normal(size=(40, 16))] + [(i, (vector + 1e-3 * v).tolist()) for i, v in enumerate(generator.normal(size=(18, 16)), 2)]
    for rows in (same, many):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        asked = spark.createDataFrame([(100, vector.tolist())], frame.schema)
        assert _answers(cross_polytope.search(frame, asked, k=10).collect()) == {100: _exact(rows, (100, vector), 10)}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_secrets_query_against_plain_python(spark):
    """The base patterns written anew, counted and hashed as the query says."""
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.QUERIES["op2_secrets"](spark, SF_DIR).collect()}
    assert set(found) == set(documents)
    names = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    for doc_id, text in documents.items():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        spans, at = [], 0
        while at < len(text):
            name = next((n for n in names if lower.startswith(n, at)), None)
            end = at + len(name or "")
            if name:
                end += text[end : end + 1] in ("'", '"')
                while text[end : end + 1] == " ":
                    end += 1
                if text[end : end + 1] in (":", "="):
                    end += 1
                    while text[end : end + 1] == " ":
                        end += 1
                    end += text[end : end + 1] in ("'", '"')
                    start = end
                    while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "+/_.=-"):
                        end += 1
                    if end > start:
                        if end - start >= 8:
                            spans.append((at, 0, end))
                        at = end
                        continue
            at += 1
        for kind, head, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
            at = 0
            while (at := text.find(head, at) if head else next((i for i in range(at, len(text)) if text[i] in allowed), -1)) >= 0:
                end = at + len(head)
                while end < len(text) and text[end] in allowed:
                    end += 1
                if end - at >= least:
                    spans.append((at, kind, end))
                at = max(end, at + 1)
        kinds = ["assign", "access", "hex"]
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
        row = found[doc_id]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def _without_repeats(rows):
    """Plain: (doc_id, text, words removed) where sentences of runs seen before, in order of doc_id, are left out."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = [(m.start(), m.group(), text[m.end() : m.end() + 1]) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]
        sentences, own = [], []
        for at, word, _ in words:
            own.append((at, word))
            stop = at + len(word)
            rest = text[stop:]
            blank = rest[: len(rest) - len(rest.lstrip(" \t\n\x0b\x0c\r"))]
            if word[-1] in ".!?;:," or len(word.encode()) >= 10 or "\n" in blank or not rest:
                sentences.append(own)
                own = []
        if own:
            sentences.append(own)
        hidden, runs = set(), set()
        for first in range(len(sentences)):
            for last in range(first + 2, len(sentences) + 1):
                if sum(map(len, sentences[first:last])) >= 16:
                    runs.add((first, last))
                    break
        for last in range(2, len(sentences) + 1):
            for first in range(last - 2, -1, -1):
                if sum(map(len, sentences[first:last])) >= 16:
                    runs.add((first, last))
                    break
        for first, last in sorted(runs):
            key = str([[w for _, w in s] for s in sentences[first:last]])
            if key in seen:
                hidden |= set(range(first, last))
            seen.add(key)
        kept, at = [], 0
        for k, sentence in enumerate(sentences):
            stop = sentences[k + 1][0][0] if k + 1 < len(sentences) else len(text)
            if k not in hidden:
                kept.append(text[sentence[0][0] if k else 0 : stop])
            elif k == 0:
                kept.append(text[: sentence[0][0]])
        out.append((doc_id, "".join(kept) if hidden else text, sum(len(sentences[k]) for k in hidden)))
    return out


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_span_query_against_plain_runs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((r.doc_id, r.text, r.removed_words) for r in queries.QUERIES["op3_spans"](spark, SF_DIR).collect())
    expected = _without_repeats(rows)
    assert found == expected and sum(n > 0 for _, _, n in expected) > 5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_registered_queries_cover_their_tables(spark):
    """One row per row of the table for each query that promises it, and the contract's columns first."""
    sizes = {name: spark.read.parquet(f"{SF_DIR}/{name}.parquet").count() for name in ("documents", "pages")}
    columns = {"op1_html": "page_id", "op3_spans": "doc_id", "op5_fuzzy": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6_language": "doc_id held_out lang_pred score", "op8_simhash": "doc_id fingerprint component_id", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256"}
    for name, first in columns.items():
        found = queries.QUERIES[name](spark, SF_DIR)
        assert found.columns[: len(first.split())] == first.split()
        assert found.count() == sizes["pages" if name == "op1_html" else "documents"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_against_plain_python(spark):
    """Each stage's effect, by a plain version of its decision on the stage's own input."""
    import corpus_pipeline
    import public_tokenizers

    from tessera.llm import packing, secret_scan, simhash
    from tessera.llm.common import materialize

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect() if name != "packing" else docs.collect()
        docs = materialize(stage(spark, docs, SF_DIR), name)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    before, after = seen["near_dedup"]
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in before}
    kept = {r.doc_id for r in after}
    assert all(any(k <= i and (prints[k] ^ p).bit_count() <= 2 for k in kept) or i not in kept for i, p in prints.items())
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in kept for b in kept if a < b)
    before, after = seen["span_dedup"]
    expected = {k: t for k, t, _ in _without_repeats([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == {k: t for k, t in expected.items() if t.strip(" ")}
    before, after = seen["secret_scan"]
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert not any(secret_scan.find(r.text, ranks) for r in after)
    before, after = seen["packing"]
    encoder = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = sorted(n for r in before for _, n in packing.cut(len(encoder.whole(r.text)) // 4 + 1, 1024))
    assert sorted(r.length for r in after) == lengths
    assert len({r.sequence_id for r in after}) <= -(-sum(lengths) // 1024) * 1.03 + 1
