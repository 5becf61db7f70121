"""The registered queries of the training-data operators: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cross_polytope, fuzzy_hash, html_text, language, lexical, packing, secret_scan, simhash, span_dedup, url_rules, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of documents, with a digest of the base patterns' spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeated spans cover."""
    return span_dedup.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_words")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprints of documents, of their edited texts, and both likenesses."""
    return fuzzy_hash.neighbours(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the labelled rows that aren't held out."""
    documents = _table(spark, sf_dir, "documents")
    found = language.predict(documents.select("doc_id", "text"), language.fit(documents))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# The rules that the query judges by.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of pages by URL rules."""
    return url_rules.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every embedding whose id is divisible by 100."""
    rows = _table(spark, sf_dir, "embeddings")
    return cross_polytope.search(rows, rows.where("vec_id % 100 = 0"), k=10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded text of documents, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of pages, written to WARC archives and read back; a page's id gives the second of its capture."""
    pages = _table(spark, sf_dir, "pages")
    captured = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod("page_id", F.lit(1_000_000_000)))
    return warc.archive(pages, captured).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened on their first 16 components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_secrets": op2_secrets,
    "op3_spans": op3_spans,
    "op4_packing": op4_packing,
    "op5_fuzzy": op5_fuzzy,
    "op6_language": op6_language,
    "op7_urls": op7_urls,
    "op8_simhash": op8_simhash,
    "op9_polytope": op9_polytope,
    "op10_bpe": op10_bpe,
    "op11_warc": op11_warc,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {
    "op7_urls": """
        WITH parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), rules(rule, host, path, verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), fits AS (
            SELECT s.*, r.rule, r.verdict,
                   row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS place
            FROM split s LEFT JOIN rules r
              ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
    """,
    "op11_warc": """
        WITH sized AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), judged AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN kept > coalesce(page_id, kept - 1) THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN kept > coalesce(page_id, kept - 1) THEN kept END AS refers_to
        FROM judged
    """,
    "op13_lexical": r"""
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS line,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), whole AS (
            SELECT count(*)::HUGEINT AS n_docs, sum(len(terms))::HUGEINT AS n_terms FROM words WHERE len(terms) > 0
        ), wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), counted AS (
            SELECT doc_id, line, n, term, count(*)::BIGINT AS tf
            FROM (SELECT doc_id, line, len(terms) AS n, unnest(terms) AS term FROM words)
            WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM counted, whole GROUP BY term, n_docs
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM counted JOIN weights USING (term) JOIN wanted USING (term), whole GROUP BY item_id, doc_id, line
        ), placed AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
    """,
}
