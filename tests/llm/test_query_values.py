"""Values of the registered queries against code of their own, straight from the contracts."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessera.llm import cross_polytope, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def _ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_query(spark, texts):
    rows = queries.QUERIES["op4_packing"](spark, SF_DIR).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_document) == set(texts)
    tokens = 0
    for doc_id, pieces in by_document.items():
        ids = [*_ids(tokenizer, texts[doc_id]), 2]
        tokens += len(ids)
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist() and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 1024 for r in pieces[1:]) and len(pieces) == -(-len(ids) // 1024)
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces]).tolist()
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(by_sequence) <= -(-tokens // 1024) * 1.02 + 1


def test_fuzzy_query(spark, texts):
    found = {r.doc_id: r for r in queries.QUERIES["op5_fuzzy"](spark, SF_DIR).collect()}
    order = sorted(texts, reverse=True)
    prints = {}
    for doc_id, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after, row = texts[doc_id], texts[following], found[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0.0 <= row.near_edited <= 1.0 and 0.0 <= row.near_next <= 1.0
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        if edited == text:
            assert row.near_edited == 1.0 and row.edited_fingerprint == row.fingerprint
        if text == after:
            assert row.near_next == 1.0
    long = [r for d, r in found.items() if len(texts[d]) > 400]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3


def test_simhash_query(spark, texts):
    prints = {}
    for doc_id, text in texts.items():
        words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash"](spark, SF_DIR).collect()}
    assert found == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_bpe_query(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in queries.QUERIES["op10_bpe"](spark, SF_DIR).collect():
        ids = _ids(tokenizer, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no larger tables")
def test_recall_of_the_index(spark):
    """Recall at 10 over 400 queries against all 2000 vectors, with the query's own parameters."""
    rows = spark.read.parquet(f"{LARGER}/embeddings.parquet").select("vec_id", "embedding")
    table = rows.collect()
    vectors, ids = np.array([r.embedding for r in table], float), np.array([r.vec_id for r in table])
    found = {}
    for r in cross_polytope.search(rows, rows.where("vec_id % 5 = 0"), k=10).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for place in np.flatnonzero(ids % 5 == 0):
        apart = np.sqrt(((vectors - vectors[place]) ** 2).sum(axis=1))
        order = np.lexsort((ids, apart))
        best = [int(ids[k]) for k in order if k != place][:10]
        own = sorted(found[int(ids[place])])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(score - apart[np.flatnonzero(ids == vec_id)[0]]) < 1e-12 for _, vec_id, score in own)
        hits += len(set(best) & {v for _, v, _ in own})
        total += 10
    assert total == 4000 and hits / total >= 0.9, hits / total
