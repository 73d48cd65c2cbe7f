"""A-series: review threads over comments made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import review as A
from quire.plans.base import query
from quire.sources.corpus import table


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 events make a document; a comment replies to the event before it unless its number is a multiple of 7."""
    state = F.when(F.col("event_type") == "signup", "Accepted").when(F.col("event_type") == "error", "Rejected").otherwise("")
    return table(spark, sf_dir, "events").select(F.expr("event_id div 70").alias("doc_id"), F.col("event_id").alias("obj"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") - 1).alias("parent_obj"), F.col("user_id").alias("author"), F.col("ts").alias("created"), state.alias("state"), F.lit("Review").alias("state_model"), F.col("event_type").alias("subtype"), F.col("props").alias("text"))


COMMENTS_SQL = """
    comments AS (SELECT event_id // 70 AS doc_id, event_id AS obj, CASE WHEN event_id % 7 <> 0 THEN event_id - 1 END AS parent_obj, user_id AS author, ts AS created,
                        CASE event_type WHEN 'signup' THEN 'Accepted' WHEN 'error' THEN 'Rejected' ELSE '' END AS state, event_type AS subtype, props AS text FROM events)"""
ROOTED_SQL = f"{COMMENTS_SQL}, rooted AS (SELECT *, obj - obj % 7 AS root FROM comments)"
THREADS_SQL = f"""{ROOTED_SQL},
    threads AS (SELECT doc_id, root, CAST(count(*) FILTER (WHERE obj <> root AND state = '') AS INT) AS replies,
                       coalesce(string_agg(CAST(obj AS VARCHAR), ',' ORDER BY created, obj) FILTER (WHERE obj <> root AND state = ''), '') AS reply_order,
                       coalesce(arg_max(state, (created, obj)) FILTER (WHERE state <> ''), 'None') AS status FROM rooted GROUP BY doc_id, root)"""


@query(f"WITH {ROOTED_SQL} SELECT doc_id, obj, root FROM rooted")
def a1_thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.thread_roots(comments(spark, sf_dir)).select("doc_id", "obj", "root")


@query(f"WITH {THREADS_SQL} SELECT * FROM threads")
def a2_thread_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.threads(A.thread_roots(comments(spark, sf_dir)))


@query(f"""WITH {THREADS_SQL}, tops AS (SELECT t.doc_id, t.root, t.status, c.author % 10 AS author, c.subtype FROM threads t JOIN comments c ON c.obj = t.root)
    SELECT CASE WHEN grouping(subtype) = 0 THEN 'type' WHEN grouping(author) = 0 THEN 'author' ELSE 'status' END AS facet, coalesce(subtype, CAST(author AS VARCHAR), status) AS value, count(*) AS n
    FROM tops GROUP BY GROUPING SETS ((subtype), (author), (status))""")
def a3_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted = A.thread_roots(comments(spark, sf_dir))
    tops = A.threads(rooted).join(rooted.where("obj = root").select("doc_id", "root", (F.col("author") % 10).alias("author"), "subtype"), ["doc_id", "root"])
    return A.facets(tops)


@query(f"""WITH {THREADS_SQL} SELECT t.doc_id, t.root, t.status, c.author, c.subtype FROM threads t JOIN comments c ON c.obj = t.root WHERE t.status IN ('Accepted', 'Rejected') AND c.subtype IN ('view', 'click')""")
def a3_filtered_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooted = A.thread_roots(comments(spark, sf_dir))
    tops = A.threads(rooted).join(rooted.where("obj = root").select("doc_id", "root", "author", "subtype", "created"), ["doc_id", "root"])
    return A.filter_threads(tops, statuses=["Accepted", "Rejected"], kinds=["view", "click"]).select("doc_id", "root", "status", "author", "subtype")


_NEAR = "[" + ", ".join(f"{{'d': (r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}), 'k': {k}, 'name': '{n}'}}" for k, (n, r, g, b) in enumerate(A.PALETTE)) + "]"


@query(f"""WITH {ROOTED_SQL},
    marks AS (SELECT obj, doc_id, (list_sort({_NEAR})[1]).name AS colour FROM (SELECT obj, doc_id, obj * 7 % 256 AS r, obj * 13 % 256 AS g, obj * 29 % 256 AS b FROM comments WHERE obj % 3 = 0)),
    lines AS (SELECT doc_id, root AS obj, string_agg(author || ': ' || text, ' | ' ORDER BY created, obj) AS replies FROM rooted WHERE obj <> root AND state = '' GROUP BY doc_id, root)
    SELECT m.doc_id, m.obj, colour, coalesce(replies, '') AS replies FROM marks m LEFT JOIN lines l ON l.doc_id = m.doc_id AND l.obj = m.obj
    UNION ALL SELECT doc_id, obj, NULL, replies FROM lines l WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = l.doc_id AND m.obj = l.obj)""")
def a4_review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = comments(spark, sf_dir)
    colours = said.where("obj % 3 = 0").select("doc_id", "obj", *((F.col("obj") * k % 256).alias(c) for c, k in (("r", 7), ("g", 13), ("b", 29))))
    return A.review_report(A.nearest_colour(colours).select("doc_id", "obj", "colour"), A.thread_roots(said))
