"""Best passages of many questions by an inverted index of the words of passages, with exact early stopping."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import retrieval as R
from quire.sources.shared import saved

RUN = r"[\p{L}\p{N}]+"
#: Words of questions that one pass over the distinct terms looks for, and the most rows of a table that goes to every task.
WANTED, BROADCAST_ROWS = 50_000, 1_000_000


def postings(passages: DataFrame) -> DataFrame:
    """term, passage_id: the distinct runs of letters and digits of each passage (passage_id, text), lower-cased.

    Written in ranges of (term, passage_id), so a term that most passages have spreads over tasks
    and a file holds few terms.  Null and empty texts have none.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0)))
    each = passages.select("passage_id", F.explode(runs).alias("term"))
    return saved(each.repartitionByRange("term", "passage_id").sortWithinPartitions("term", "passage_id"), "postings")


def holders(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term, n: the terms (term, n) that contain each word of ``wanted`` (word), found by an automaton over the terms."""
    asked, out, schema = wanted.select("word").distinct().toLocalIterator(), None, "word string, term string, n long"
    while block := [r["word"] for r in islice(asked, WANTED)]:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for word in block:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                found = [(w, t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in {x for _, x in automaton.iter(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["word", "term", "n"])

        got = terms.select("term", "n").mapInArrow(run, schema)
        out = got if out is None else out.unionAll(got)
    return terms.sparkSession.createDataFrame([], schema) if out is None else out


def lexical_score(share: Column, subject: Column, text: Column) -> Column:
    """V2's score by the share of words found and the single-spaced lower-case text (null: without the phrase); see ``retrieval.scores``."""
    phrase = F.coalesce((subject != "") & F.contains(text, subject), F.lit(False))
    behind = F.ltrim(F.substring(text, F.instr(text, subject) + F.char_length(subject), F.char_length(text)))
    defined = phrase & F.exists(F.array(*map(F.lit, R.CONNECTORS)), lambda c: F.startswith(behind, c))
    parts = 0.25 * share + F.when(phrase, 0.35).otherwise(0.0) + F.when(defined, 0.4).otherwise(0.0)
    return F.round(F.when(subject == "", share).otherwise(parts), 9)


def word_hits(held: DataFrame, index: DataFrame) -> DataFrame:
    """passage_id, hits: the looked-for words (see ``holders``) that each passage contains, as sorted hashes."""
    terms = held.groupBy("term").agg(F.collect_set(F.xxhash64("word")).alias("w"))
    few = terms.count() <= BROADCAST_ROWS
    each = index.join(F.broadcast(terms) if few else terms, "term")
    return saved(each.groupBy("passage_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("w")))).alias("hits")), "word-hits")


def scored_pairs(pairs: DataFrame, questions: DataFrame, passages: DataFrame, hits: DataFrame) -> DataFrame:
    """q_id, passage_id, lexical of ``pairs``; questions are as ``asked`` makes them, ``hits`` as ``word_hits``.

    Texts are read only where all runs of a question's subject are in the passage.
    """
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    runs = F.array_distinct(F.regexp_extract_all("subject", F.lit(RUN), F.lit(0)))
    own = questions.select("q_id", "subject", hashes(F.col("words")).alias("words"), hashes(runs).alias("runs"))
    both = pairs.join(own, "q_id").join(hits, "passage_id", "left")
    size = F.size("words")
    share = F.coalesce(F.when(size > 0, F.size(F.array_intersect("words", "hits")) / size), F.lit(0.0))
    whole = F.coalesce((F.col("subject") != "") & (F.size(F.array_except("runs", "hits")) == 0), F.lit(False)) | ((F.col("subject") != "") & (F.size("runs") == 0))
    judged = saved(both.select("q_id", "passage_id", "subject", share.alias("share"), whole.alias("whole")), "shares")
    texts = passages.select("passage_id", R.single_spaced(F.lower("text")).alias("text"))
    plain = judged.where("NOT whole").withColumn("text", F.lit(None).cast("string"))
    scored = plain.unionByName(judged.where("whole").join(texts, "passage_id"))
    return scored.select("q_id", "passage_id", lexical_score(F.col("share"), F.col("subject"), F.col("text")).alias("lexical"))


def asked(questions: DataFrame) -> DataFrame:
    """q_id, words, subject of questions (q_id, text); a null text asks nothing."""
    text = F.coalesce("text", F.lit(""))
    return questions.select("q_id", R.question_words(text).alias("words"), R.subject(text).alias("subject"))


def lexical_topk(questions: DataFrame, passages: DataFrame, k: int, index: DataFrame | None = None) -> DataFrame:
    """V2: q_id, passage_id, lexical, rank: the ``k`` passages of best score above 0 of each question; ties by passage_id.

    A passage's score comes from its share of the question's words and from the question's subject
    as a phrase.  Candidates are, first, the passages with the subject's rarest run and those with
    the question's rarest word.  The k-th best of them bounds the result from below, and a passage
    with none of the r rarest words or the phrase scores at most the share of the others; so words
    are read, from the rarest on, only until that share is below the bound.  No passage of the
    result can lack all of them.  ``questions`` has q_id (unique), text; ``passages`` passage_id
    (unique), text; ``index`` is the ``postings`` of the passages, made if not given.
    """
    own = saved(asked(questions), "asked")
    index = postings(passages) if index is None else index
    terms = index.groupBy("term").agg(F.count("*").alias("n"))
    runs = own.select("q_id", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(RUN), F.lit(0)))).alias("word"))
    words = own.select("q_id", F.explode("words").alias("word"))
    held = saved(holders(words.select("word").unionAll(runs.select("word")), terms), "holders")
    sizes = held.groupBy("word").agg(F.sum("n").alias("n"))
    ranked = lambda each: each.join(sizes, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy("n", "word")))
    order = saved(ranked(words), "word-order")
    first = order.where("n > 0").groupBy("q_id").agg(F.min("r").alias("r"))
    # the phrase is in a passage only with all its runs, the rarest among them
    phrase = ranked(runs).where("r = 1 AND n > 0").select("q_id", "word")
    start = phrase.unionByName(order.join(first, ["q_id", "r"]).select("q_id", "word"))
    hits = word_hits(held, index)
    seen = saved(scored_pairs(candidates(start, held, index), own, passages, hits), "scored")
    # a subject of marks alone has no run to look for: all passages are candidates
    bare = own.where((F.col("subject") != "") & ~F.col("subject").rlike(RUN)).select("q_id")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("lexical"), "passage_id"))
    best = seen.where("lexical > 0").withColumn("place", place).where(F.col("place") == k).select("q_id", F.col("lexical").alias("least"))
    size = F.size("words")
    rest = lambda r: F.round(F.when(F.col("subject") == "", 1.0).otherwise(0.25) * (size - r) / size, 9)
    enough = F.filter(F.sequence(F.lit(0), size), lambda r: rest(r) < F.col("least"))
    reach = own.where(size > 0).join(best, "q_id", "left").select("q_id", F.coalesce(F.try_element_at(enough, F.lit(1)), size).alias("reach"))
    more = order.join(reach, "q_id").where("n > 0 AND r <= reach").join(first.withColumnRenamed("r", "had"), "q_id").where("r > had").select("q_id", "word")
    fresh = candidates(more, held, index).join(seen.select("q_id", "passage_id"), ["q_id", "passage_id"], "left_anti").join(bare, "q_id", "left_anti")
    found = seen.join(bare, "q_id", "left_anti").unionByName(scored_pairs(fresh, own, passages, hits))
    if bare.limit(1).count():
        whole = R.lexical_scores(questions.join(bare, "q_id", "left_semi"), passages)
        found = found.unionByName(whole)
    return found.where("lexical > 0").withColumn("rank", place).where(F.col("rank") <= k)


def candidates(wanted: DataFrame, held: DataFrame, index: DataFrame) -> DataFrame:
    """q_id, passage_id: the passages with any of a question's words (q_id, word)."""
    terms = saved(wanted.join(held.select("word", "term"), "word").select("q_id", "term").distinct(), "wanted-terms")
    few = terms.count() <= BROADCAST_ROWS
    return index.join(F.broadcast(terms) if few else terms, "term").select("q_id", "passage_id").distinct()


def cosine(x: Column, y: Column) -> Column:
    """V3's similarity of two vectors; -1 if one is null, has no length or another than the other."""
    added = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)
    squares = lambda v: added(F.transform(v, lambda e: e.cast("double") * e.cast("double")))
    product = added(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))
    norms = F.sqrt(squares(x)) * F.sqrt(squares(y))
    return F.coalesce(F.round(F.when((F.size(x) == F.size(y)) & (norms > 0), product / norms), 9), F.lit(-1.0))


def vector_topk(questions: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """V3: q_id, passage_id, similarity, rank: the ``k`` nearest passages of each question by cosine; ties by passage_id.

    Every task keeps its own best, so no pairs beyond these leave it.
    """
    blank = F.lit("").alias("text")
    found = R.scores(questions.select("q_id", blank, "vec"), passages.select("passage_id", blank, "vec"), k, 1)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "passage_id"))
    return found.select("q_id", "passage_id", "similarity").withColumn("rank", place).where(F.col("rank") <= k)


def hybrid(questions: DataFrame, passages: DataFrame, vector_pool: int = R.VECTOR_POOL, lexical_pool: int = R.LEXICAL_POOL) -> DataFrame:
    """V4 for many questions: what ``retrieval.hybrid`` gives, with the word pool from the index instead of all pairs."""
    index, own = postings(passages), saved(asked(questions), "asked")
    near = vector_topk(questions, passages, vector_pool).select("q_id", "passage_id")
    worded = lexical_topk(questions, passages, lexical_pool, index).select("q_id", "passage_id")
    pairs = saved(near.unionAll(worded).distinct(), "pool")
    vectors = pairs.join(questions.select("q_id", F.col("vec").alias("_asked")), "q_id").join(passages.select("passage_id", F.col("vec").alias("_own")), "passage_id")
    similar = vectors.select("q_id", "passage_id", cosine(F.col("_asked"), F.col("_own")).alias("similarity"))
    looked = own.select(F.explode("words").alias("word")).unionAll(own.select(F.explode(F.regexp_extract_all("subject", F.lit(RUN), F.lit(0))).alias("word")))
    held = saved(holders(looked, index.groupBy("term").agg(F.count("*").alias("n"))), "holders")
    both = similar.join(scored_pairs(pairs, own, passages, word_hits(held, index)), ["q_id", "passage_id"])
    scored = both.withColumn("score", F.round(R.VECTOR_WEIGHT * F.col("similarity") + (1 - R.VECTOR_WEIGHT) * F.col("lexical"), 4))
    return scored.select("q_id", "passage_id", "score", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "passage_id")).alias("rank"))
