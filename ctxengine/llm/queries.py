"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embed_dedup, exact_dedup, filter_audit, html_text, langid, license_scan, minhash, mixing, packing, quality, token_archive, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: a fifth, by the CRC of the id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.prototypes(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return langid.identify(docs, learned).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("keep", F.col("quality") >= 0.5)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), least=0)
    return warc.summary(spark, archive)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_archive.write_archive(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_archive.read_archive(spark, path, with_ids=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_license_scan": op3_license_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc_archive": op8_warc_archive,
    "op9_source_mixing": op9_source_mixing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_archive": op12_token_archive,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH base AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM base WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)""",
    "op8_warc_archive": """
        WITH base AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS payload FROM pages
        ), typed AS (
          SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM base
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               translate(array_to_string([lpad(to_base(('0x' || substr(hex, i, 5))::BIGINT, 32), 4, '0') for i in range(1, 41, 5)], ''),
                         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM typed""",
    "op11_source_divergence": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
        ), found AS (
          SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), kept AS (
          SELECT lang, term, count(*) AS lang_n FROM found GROUP BY ALL HAVING count(DISTINCT rid) >= 30
        ), langs AS (
          SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL
        ), occurring AS (
          SELECT DISTINCT lang, source FROM docs
        ), counts AS (
          SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL
        ), full_counts AS (
          SELECT lang, o.source, term, lang_n, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, o.source) AS total
          FROM occurring o JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)
        ), p AS (
          SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS q
          FROM full_counts JOIN langs USING (lang)
        ), distances AS (
          SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), results AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM results QUALIFY part = 'pair' OR rank <= 50""",
    "op13_filter_audit": r"""
        WITH docs AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), flags AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
                 CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END ||
                 CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
          FROM docs LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
        ), counts AS (
          SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
        ), orders AS (
          SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
          WHERE length(translate('ABCDE', a.f || b.f || c.f || d.f || e.f, '')) = 0
        ), steps AS (
          SELECT filter_order, step::INTEGER AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) r(step)
        ), told AS (
          SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS fails_it, length(translate(earlier, fails, '')) = length(earlier) AS arrives, length(fails) = 1 AS once FROM steps, counts
        ), per_step AS (
          SELECT part, filter_order, step, f,
                 coalesce(sum(n) FILTER (arrives AND NOT fails_it), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (arrives AND fails_it), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (fails_it AND NOT arrives), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_it AND once), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (arrives AND fails_it), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (arrives AND fails_it), 0)::BIGINT AS toxic_lost
          FROM told GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM per_step""",
}
