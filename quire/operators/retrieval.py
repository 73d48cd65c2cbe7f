"""Passage retrieval: chunks, lexical and vector scores, hybrid top-k, packing and citations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_CHUNK, CHUNK, STRIDE, OVERLAP = 20, 1500, 1300, 200
VECTOR_POOL, LEXICAL_POOL, VECTOR_WEIGHT = 24, 10, 0.7
WHOLE_DOCUMENT_TOKENS = 20_000
#: Questions that are scored in one pass over the passages.
QUESTIONS = 256
#: Fixed values of the lexical score: words that don't count, openings that are no subject, and what follows a defined subject.
STOP_WORDS = [
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were",
    "what", "how", "does", "do", "did", "this", "that", "these", "those", "with", "by", "as",
    "at", "from", "be", "it", "its", "which", "when", "where", "who", "whom", "why", "can",
    "could", "should", "would", "will", "shall", "about", "into", "than", "then",
]
LEAD_INS = [
    "what is the", "what is a", "what is an", "what's the", "what's a", "what's an",
    "tell me about the", "tell me about", "what are the", "define the", "explain the",
    "describe the", "what is", "what's", "what are", "define", "explain", "describe",
]
CONNECTORS = [
    "field indicates", "indicates", "is defined as", "is a unique", "is a", "refers to", "means",
    "specifies", "denotes", "represents", "is used to", "field is",
]
WORD = r"[\p{L}\p{N}]{3,}"
SPACE = " \t\n\r"


def chunks(pages: DataFrame) -> DataFrame:
    """V1: doc_id, page_index, chunk_no, text.

    A page of at most ``CHUNK`` characters is one chunk.  Longer ones pack paragraphs; a new
    chunk starts with the end of the one before.  A longer paragraph is cut at a stride, and
    what is left of it starts the next chunk.
    """
    body = F.btrim("text", F.lit(" \t\n\r"))
    state = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, paragraph: Column) -> Column:
        n = F.char_length(paragraph)
        cuts = F.ceil(F.greatest(n - CHUNK, F.lit(0)) / STRIDE).cast("int")  # whole slices before the rest
        before = F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        slices = F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: F.substring(paragraph, i * STRIDE + 1, F.lit(CHUNK)))
        long = F.struct(F.substring(paragraph, cuts * STRIDE + 1, n).alias("cur"), F.concat(before, slices).alias("out"))
        joined = F.concat(acc["cur"], F.lit("\n\n"), paragraph)
        fits = F.struct(F.when(acc["cur"] == "", paragraph).otherwise(joined).alias("cur"), acc["out"].alias("out"))
        full = F.struct(F.concat(F.substring(acc["cur"], F.greatest(F.char_length(acc["cur"]) - OVERLAP, F.lit(0)) + 1, F.lit(OVERLAP)), F.lit("\n\n"), paragraph).alias("cur"), F.concat(acc["out"], F.array(acc["cur"])).alias("out"))
        return F.when(n > CHUNK, long).when((acc["cur"] == "") | (F.char_length(joined) <= CHUNK), fits).otherwise(full)

    packed = F.aggregate(F.filter(F.split(body, r"\n[ \t]*\n"), lambda p: p != ""), state, add, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    some = pages.where(F.char_length(body) >= LEAST_CHUNK)
    return some.select("doc_id", "page_index", F.posexplode(F.when(F.char_length(body) <= CHUNK, F.array(body)).otherwise(packed)).alias("chunk_no", "text"))


def question_words(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def subject(text: Column) -> Column:
    """What a question is about, without its opening and end marks; empty if that is shorter than 3 characters."""
    rest = F.btrim(F.regexp_replace(F.btrim(F.lower(text), F.lit(SPACE)), f"^(?:{'|'.join(LEAD_INS)})", ""), F.lit(SPACE))
    found = F.regexp_replace(rest, r"[.?!]+$", "")
    return F.when(F.char_length(found) >= 3, single_spaced(found)).otherwise("")


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r\f]+", " ")


class _Scorer:
    """Scores of a block of questions for passages, in a task."""

    def __init__(self, asked: list):
        self.ids = np.array([q["q_id"] for q in asked])
        self.subjects = [q["subject"] for q in asked]
        n_words = np.array([len(q["words"]) for q in asked])
        patterns = sorted({w for q in asked for w in q["words"]} | {x for x in self.subjects if x})
        place = {x: k for k, x in enumerate(patterns)}
        self.subject_at = np.array([place.get(x, -1) for x in self.subjects])
        self.asks = np.zeros((len(patterns), len(asked)), np.float32)
        for k, q in enumerate(asked):
            for w in q["words"]:
                self.asks[place[w], k] = 1
        self.part = np.where(n_words > 0, 1 / np.maximum(n_words, 1), 0.0)
        self.automaton = ahocorasick.Automaton()
        for x, k in place.items():
            self.automaton.add_word(x, k)
        if patterns:
            self.automaton.make_automaton()
        vectors = [q["vec"] for q in asked]
        self.vectors = [None if v is None else np.array(v, np.float64) for v in vectors]

    def lexical(self, texts: list[str | None]) -> np.ndarray:
        hits = np.zeros((len(texts), len(self.asks)), np.float32)
        for k, text in enumerate(texts):
            if text and len(self.asks):
                hits[k, list({x for _, x in self.automaton.iter(text)})] = 1
        share = np.rint(hits @ self.asks) * self.part
        phrase = np.where(self.subject_at >= 0, hits[:, self.subject_at] > 0, False) if len(self.asks) else np.zeros(share.shape, bool)
        defined = np.zeros(share.shape, bool)
        for k, q in zip(*np.nonzero(phrase), strict=True):
            after = texts[k].index(self.subjects[q]) + len(self.subjects[q])
            defined[k, q] = texts[k][after:].lstrip(" ").startswith(tuple(CONNECTORS))
        return np.round(np.where(self.subject_at >= 0, 0.25 * share + 0.35 * phrase + 0.4 * defined, share), 9)

    def similarity(self, vectors: pa.Array) -> np.ndarray:
        """Cosines; -1 for vectors of another length or without one."""
        out = np.full((len(vectors), len(self.ids)), -1.0)
        sizes = np.diff(vectors.offsets.to_numpy()) * vectors.is_valid().to_numpy(zero_copy_only=False)
        for size in {len(v) for v in self.vectors if v is not None and len(v)}:
            rows = np.flatnonzero(sizes == size)
            columns = [k for k, v in enumerate(self.vectors) if v is not None and len(v) == size]
            if len(rows):
                x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
                y = np.stack([self.vectors[k] for k in columns])
                norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
                out[np.ix_(rows, columns)] = np.where(norms > 0, x @ y.T / np.where(norms > 0, norms, 1), -1.0)
        return np.round(out, 9)


def scores(questions: DataFrame, passages: DataFrame, vector_pool: int | None = None, lexical_pool: int | None = None) -> DataFrame:
    """q_id, passage_id, similarity, lexical of every question and passage; with pools, of those that are among the best in their task.

    ``questions`` (q_id, text, vec) are asked ``QUESTIONS`` at a time, each time of all ``passages``
    (passage_id, text, vec).  Ties go to the smaller passage_id.
    """
    asked = questions.select("q_id", question_words(F.col("text")).alias("words"), subject(F.col("text")).alias("subject"), "vec").toLocalIterator()
    texts = passages.select("passage_id", single_spaced(F.lower("text")).alias("text"), "vec")
    schema, out = "q_id long, passage_id long, similarity double, lexical double", None
    while block := list(islice(asked, QUESTIONS)):
        own = [q.asDict() for q in block]

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            scorer, best = _Scorer(own), None
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    found = np.array(part.column(0)), scorer.similarity(part.column(2)), scorer.lexical(part.column(1).to_pylist())
                    if vector_pool is None:
                        yield _all_pairs(scorer.ids, *found)
                    else:
                        best = _best(found if best is None else tuple(np.concatenate(x) for x in zip(best, found, strict=True)), vector_pool, lexical_pool)
            if best is not None:
                yield _all_pairs(scorer.ids, *best)

        got = texts.mapInArrow(run, schema)
        out = got if out is None else out.unionAll(got)
    return passages.sparkSession.createDataFrame([], schema) if out is None else out


def _all_pairs(ids: np.ndarray, passages: np.ndarray, similarity: np.ndarray, lexical: np.ndarray) -> pa.RecordBatch:
    columns = [np.tile(ids, len(passages)), np.repeat(passages, len(ids)), similarity.ravel(), lexical.ravel()]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q_id", "passage_id", "similarity", "lexical"])


def _best(found: tuple[np.ndarray, np.ndarray, np.ndarray], vector_pool: int, lexical_pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages that are among the best of any question by vector or by words."""
    ids = found[0]
    keep = np.zeros(len(ids), bool)
    for scored, pool in ((found[1], vector_pool), (found[2], lexical_pool)):
        for k in range(scored.shape[1]):
            column = scored[:, k]
            near = np.flatnonzero(column >= np.partition(column, len(column) - pool)[len(column) - pool]) if len(column) > pool else np.arange(len(column))
            keep[near[np.lexsort((ids[near], -column[near]))[:pool]]] = True
    return tuple(x[keep] for x in found)


def lexical_scores(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """V2: score of each passage that has anything of a question."""
    blank = F.lit(None).cast("array<float>").alias("vec")
    return scores(questions.select("q_id", "text", blank), passages.select("passage_id", "text", blank)).where("lexical > 0").select("q_id", "passage_id", "lexical")


def vector_scores(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """V3: cosine of every passage's vector with each question's."""
    blank = F.lit("").alias("text")
    return scores(questions.select("q_id", blank, "vec"), passages.select("passage_id", blank, "vec")).select("q_id", "passage_id", "similarity")


def hybrid(questions: DataFrame, passages: DataFrame, vector_pool: int = VECTOR_POOL, lexical_pool: int = LEXICAL_POOL) -> DataFrame:
    """V4: the best by vector and the best by words, in one order; ties by passage.

    Tasks keep their own best, so the windows see a bounded number of rows from each.
    """
    found = scores(questions, passages, vector_pool, lexical_pool)
    by = lambda c: F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(c), "passage_id"))
    by_vector = found.withColumn("place", by("similarity")).where(F.col("place") <= vector_pool).drop("place")
    by_words = found.where("lexical > 0").withColumn("place", by("lexical")).where(F.col("place") <= lexical_pool).drop("place")
    scored = by_vector.unionAll(by_words).distinct().withColumn("score", F.round(VECTOR_WEIGHT * F.col("similarity") + (1 - VECTOR_WEIGHT) * F.col("lexical"), 4))
    return scored.withColumn("rank", by("score")).select("q_id", "passage_id", "score", "rank")


def packed(ranked: DataFrame, budget: int) -> DataFrame:
    """V5: in rank order the passages that fit the budget of tokens; ``ranked`` has q_id, rank, text."""
    cost = F.expr("char_length(text) div 3") + 1 + 4
    rows = F.sort_array(F.collect_list(F.struct("rank", "passage_id", cost.cast("int").alias("cost"))))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<bigint>").alias("taken"))

    def take(acc: Column, row: Column) -> Column:
        fits = (acc["left"] > 50) & (row["cost"] <= acc["left"])
        return F.when(fits, F.struct((acc["left"] - row["cost"]).alias("left"), F.concat(acc["taken"], F.array(row["passage_id"].cast("bigint"))).alias("taken"))).otherwise(acc)

    done = F.aggregate("rows", start, take)
    return ranked.groupBy("q_id").agg(rows.alias("rows")).select("q_id", done.alias("d")).select("q_id", "d.taken", "d.left")


def whole_documents(passages: DataFrame, most: int = WHOLE_DOCUMENT_TOKENS) -> DataFrame:
    """V6: page texts of documents that pass whole (characters / 4 within the limit)."""
    per_page = passages.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    size = F.sum(F.char_length("text")).over(Window.partitionBy("doc_id"))
    return per_page.withColumn("chars", size).where(F.col("chars") / 4 <= most)


#: Words of follow-up questions.
PRONOUNS = ["it", "its", "this", "these", "those", "they", "them", "their", "he", "she", "him", "her"]
CONTINUATIONS = ["more", "elaborate", "again", "else"]


def folded_questions(turns: DataFrame) -> DataFrame:
    """V7: user turns with the question to retrieve by: follow-ups carry the question before them."""
    users = turns.where("role = 'user'")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    has = lambda some: F.arrays_overlap("words", F.array(*map(F.lit, some)))
    follows = (F.size("words") <= 2) | has(PRONOUNS) | ((F.size("words") <= 6) & has(CONTINUATIONS))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = users.withColumn("words", words).withColumns({"before": before, "is_follow_up": F.coalesce(follows, F.lit(False))})
    return asked.select("conv_id", "turn", "is_follow_up", F.when(F.col("is_follow_up") & F.col("before").isNotNull(), F.concat_ws(" ", "before", "text")).otherwise(F.col("text")).alias("retrieval_query"))


def cited_pages(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """V8: passages and whether their question's answer cites their page as ``[Page N]``."""
    cited = answers.select("q_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\[Page ([0-9]+)\]"), F.lit(1))).alias("page")).select("q_id", (F.col("page").cast("int") - 1).alias("page_index"), F.lit(True).alias("hit")).distinct()
    return passages.join(cited, ["q_id", "page_index"], "left").withColumn("cited", F.coalesce("hit", F.lit(False))).drop("hit")
