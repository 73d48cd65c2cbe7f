"""V-series: passage retrieval.  Benchmark texts are the questions; vectors are those of equal number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import passage_index as P
from quire.operators import retrieval as R
from quire.plans.base import query
from quire.sources.corpus import PAGE_TEXT_SQL, page_text, table


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as passages: passage_id is doc_id * 1000 + page_index."""
    return page_text(table(spark, sf_dir, "documents")).select((F.col("doc_id") * 1000 + F.col("page_index")).alias("passage_id"), "doc_id", "page_index", F.lit(0).alias("chunk_no"), "text")


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages; those of documents without a vector have null."""
    return _passages(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id", "left")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("q_id"), "text", "vec")


PASSAGES_SQL = f"{PAGE_TEXT_SQL}, passages AS (SELECT doc_id * 1000 + page_index AS passage_id, doc_id, page_index, text FROM page_text)"
_list = lambda words: "['" + "', '".join(w.replace("'", "''") for w in words) + "']"
_SINGLE = "regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
LEXICAL_SQL = f"""
    opened AS (SELECT item_id AS q_id, list_filter(list_distinct(regexp_extract_all(lower(text), '{R.WORD}')), lambda w: NOT list_contains({_list(R.STOP_WORDS)}, w)) AS words,
                      regexp_replace(trim(regexp_replace(trim(lower(text), {_BLANK}), '^(?:{"|".join(R.LEAD_INS).replace("'", "''")})', ''), {_BLANK}), '[.?!]+$', '') AS rest FROM benchmark),
    asked AS (SELECT q_id, words, CASE WHEN length(rest) >= 3 THEN {_SINGLE.format("rest")} ELSE '' END AS subject FROM opened),
    low AS (SELECT passage_id, {_SINGLE.format("lower(text)")} AS t FROM passages),
    pairs AS (SELECT q_id, passage_id, subject, CASE WHEN len(words) = 0 THEN 0 ELSE len(list_filter(words, lambda w: contains(t, w))) / len(words) END AS share,
                     subject <> '' AND contains(t, subject) AS phrase, ltrim(substr(t, instr(t, subject) + length(subject)), ' ') AS behind FROM low, asked),
    lexical AS (SELECT q_id, passage_id, round(CASE WHEN subject = '' THEN share ELSE 0.25 * share + CASE WHEN phrase THEN 0.35 ELSE 0 END
                       + CASE WHEN phrase AND len(list_filter({_list(R.CONNECTORS)}, lambda c: starts_with(behind, c))) > 0 THEN 0.4 ELSE 0 END END, 9) AS lexical FROM pairs)"""
VECTOR_SQL = """
    vectors AS (SELECT q.item_id AS q_id, passage_id, coalesce(round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(qe.embedding AS DOUBLE[])), 9), -1) AS similarity
                FROM passages LEFT JOIN embeddings e ON e.vec_id = doc_id, benchmark q JOIN embeddings qe ON qe.vec_id = q.item_id)"""


@query()
def v1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(page_text(table(spark, sf_dir, "documents")))


@query(f"WITH {PASSAGES_SQL}, {LEXICAL_SQL} SELECT q_id, passage_id, round(lexical, 6) AS lexical FROM lexical WHERE lexical > 0")
def v2_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    return R.lexical_scores(asked, _passages(spark, sf_dir)).withColumn("lexical", F.round("lexical", 6))


@query(f"WITH {PASSAGES_SQL}, {VECTOR_SQL} SELECT q_id, passage_id, round(similarity, 6) AS similarity FROM vectors")
def v3_vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_scores(_questions(spark, sf_dir), _with_vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {PASSAGES_SQL}, {LEXICAL_SQL}, placed AS (SELECT q_id, passage_id, lexical, row_number() OVER (PARTITION BY q_id ORDER BY lexical DESC, passage_id) AS rank FROM lexical WHERE lexical > 0)
    SELECT q_id, passage_id, round(lexical, 6) AS lexical, rank FROM placed WHERE rank <= {R.LEXICAL_POOL}""")
def v2_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten passages of each question by words, from the index."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    return P.lexical_topk(asked, _passages(spark, sf_dir), R.LEXICAL_POOL).withColumn("lexical", F.round("lexical", 6))


@query(f"""WITH {PASSAGES_SQL}, {VECTOR_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, passage_id) AS rank FROM vectors)
    SELECT q_id, passage_id, round(similarity, 6) AS similarity, rank FROM placed WHERE rank <= {R.VECTOR_POOL}""")
def v3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.vector_topk(_questions(spark, sf_dir), _with_vectors(spark, sf_dir), R.VECTOR_POOL).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {PASSAGES_SQL}, {LEXICAL_SQL}, {VECTOR_SQL},
    scored AS (SELECT v.q_id, v.passage_id, similarity, coalesce(lexical, 0) AS lexical FROM vectors v LEFT JOIN lexical l ON l.q_id = v.q_id AND l.passage_id = v.passage_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, passage_id) AS a, row_number() OVER (PARTITION BY q_id ORDER BY lexical DESC, passage_id) AS b FROM scored),
    best AS (SELECT q_id, passage_id, round(0.7 * similarity + 0.3 * lexical, 4) AS score FROM placed WHERE a <= 24 OR (b <= 10 AND lexical > 0))
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, passage_id) AS rank FROM best""")
def v4_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan scores the few questions of a block; more of them go by the index."""
    asked, passages = _questions(spark, sf_dir), _with_vectors(spark, sf_dir)
    return (P if asked.count() > R.QUESTIONS else R).hybrid(asked, passages)


@query()
def v5_budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = v4_hybrid_topk(spark, sf_dir).join(_passages(spark, sf_dir).select("passage_id", "text"), "passage_id")
    return R.packed(ranked, budget=6000)


@query(f"""WITH {PASSAGES_SQL}, sized AS (SELECT doc_id, CAST(page_index AS INT) AS page_index, text, CAST(sum(length(text)) OVER (PARTITION BY doc_id) AS BIGINT) AS chars FROM passages)
    SELECT * FROM sized WHERE chars / 4 <= 1000""")
def v6_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.whole_documents(_passages(spark, sf_dir), most=1000)


@query(f"""
    WITH users AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user'),
    asked AS (SELECT *, coalesce(len(words) <= 2 OR len(list_intersect(words, {_list(R.PRONOUNS)})) > 0 OR (len(words) <= 6 AND len(list_intersect(words, {_list(R.CONTINUATIONS)})) > 0), false) AS is_follow_up FROM users)
    SELECT conv_id, turn, is_follow_up, CASE WHEN is_follow_up AND before IS NOT NULL THEN before || ' ' || text ELSE text END AS retrieval_query FROM asked""")
def v7_follow_up_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folded_questions(table(spark, sf_dir, "conversations"))


@query(f"""WITH {PASSAGES_SQL}
    SELECT p.doc_id AS q_id, CAST(p.page_index AS INT) AS page_index, passage_id, p.page_index = n_chars % 3 AS cited FROM passages p JOIN documents USING (doc_id)""")
def v8_cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document cites one page by its tag."""
    docs = table(spark, sf_dir, "documents")
    answers = docs.select(F.col("doc_id").alias("q_id"), F.format_string("It says so [Page %d].", F.col("n_chars") % 3 + 1).alias("answer"))
    return R.cited_pages(answers, _passages(spark, sf_dir).select(F.col("doc_id").alias("q_id"), "page_index", "passage_id"))
