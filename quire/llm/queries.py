"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, html_text, jaccard_join, language_id, line_dedup, quality, sentence_pieces, sharding, suffix_dedup, token_alignment, token_shards, url_filter, vector_codes
from quire.llm.store import fresh_path, public_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.encode_digests(_table(spark, sf_dir, "documents"), model)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    shards = token_shards.write_shards(_table(spark, sf_dir, "documents"), model, fresh_path(spark, "token-shards"))
    each = token_shards.sequences(shards)
    return each.select("doc_id", "piece", "shard", "slot", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), length=100)
    return out.select(public_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), "common", "answered")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.link_components(_table(spark, sf_dir, "documents"), k=3, p=9, q=10)
    return out.select(public_id("id").alias("doc_id"), "n_shingles", public_id("component_id").alias("component_id"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.verdicts(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    base = [F.col("_q_" + x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return out.select("doc_id", *base, F.round("_q_probability", 6).alias("probability"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"), shards=40)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, trained = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(trained.sha256()).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_alignment.read_vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    out = token_alignment.score(_table(spark, sf_dir, "documents"), files)
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()))
    out = language_id.identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), language_id.held_out("id").alias("held_out"), F.col("lang").alias("lang_pred"), F.round("score", 6).alias("score"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_shards": op2_token_shards,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_text": op4_html_text,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_language_id": op13_language_id,
}


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round as two tables: the nearest entry of each part, and the entries that follow from it."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS (
            SELECT r, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d
            FROM (SELECT c.r, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d
                  FROM cells c JOIN book{k} b USING (part, pos) GROUP BY c.r, c.part, b.entry) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
        book{k + 1} AS (
            SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
                SELECT c.part, n.entry, c.pos, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
                FROM cells c JOIN near{k} n USING (r, part) GROUP BY c.part, n.entry, c.pos) m USING (part, entry, pos))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS (
            SELECT r, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) AS x
            FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
        book0 AS (SELECT part, r AS entry, pos, x FROM cells WHERE r < {entries}),{",".join(steps)},
        coded AS (
            SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
        SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
        FROM kept k JOIN coded c USING (r)"""


ORACLE_SQL_BY_QUERY = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents),
        keyed AS (
            SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS key FROM lines),
        judged AS (
            SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op11_vector_codes": _vector_codes_sql(),
}
