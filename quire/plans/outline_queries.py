"""O-series: headings and outlines.  Styled lines come from web pages, outlines from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import outline as O
from quire.plans.base import query
from quire.plans.page_queries import LABELS_SQL, files, label_ranges
from quire.operators.page_sets import page_labels
from quire.sources.corpus import LINES_SQL, document_lines, positioned_lines, styled_lines, table


def web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled lines of web pages: headings, then bold texts, paragraphs and footers, 14 points apart."""
    rank = F.when(F.col("tag") == "h1", 0).when(F.col("tag") == "b", 1).when(F.col("tag") == "p", 2).otherwise(3)
    seq = (rank * 1000 + F.col("n")).cast("long")
    return styled_lines(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), seq.alias("seq"), F.lit(0).alias("page_index"), (seq * 14).cast("double").alias("top"), "text", "size", "bold")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 events make a document of seven pages; an event is a heading of level 1 + user mod 6."""
    return table(spark, sf_dir, "events").select(F.expr("event_id div 70").alias("doc_id"), F.col("event_id").alias("seq"), F.expr("(event_id % 70) div 10").cast("int").alias("page_index"), (F.col("event_id") % 10 * 60 + 50).cast("double").alias("y"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 9).cast("string")).alias("title"), (F.col("user_id") % 6 + 1).cast("int").alias("level"))


HEADINGS_SQL = """
    headings AS (SELECT event_id // 70 AS doc_id, event_id AS seq, CAST((event_id % 70) // 10 AS INT) AS page_index, CAST(event_id % 10 * 60 + 50 AS DOUBLE) AS y, event_type || ' ' || event_id % 9 AS title, CAST(user_id % 6 + 1 AS INT) AS level FROM events),
    nested AS (SELECT *, (SELECT max(p.seq) FROM headings p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level) AS parent FROM headings h)"""


@query()
def o1_heading_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.heading_rows(web_lines(spark, sf_dir))


@query("""
    WITH h AS (SELECT event_id // 70 AS doc_id, event_id AS seq, 0 AS page_index, 0.0::DOUBLE AS top, (10 + user_id % 4)::DOUBLE AS size, event_type = 'view' AS bold, event_type || ' x' AS title, user_id % 4 > 1 AS strong FROM events),
    f AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, strong, size, bold) AS first FROM h)
    SELECT doc_id, seq, page_index, top, title, CAST(least(dense_rank() OVER (PARTITION BY doc_id ORDER BY strong DESC, size DESC, bold DESC, first), 6) AS INT) AS level FROM f""")
def o2_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.expr("event_id div 70").alias("doc_id"), F.col("event_id").alias("seq"), F.lit(0).alias("page_index"), F.lit(0.0).alias("top"), (10 + F.col("user_id") % 4).cast("double").alias("size"), (F.col("event_type") == "view").alias("bold"), F.concat("event_type", F.lit(" x")).alias("title"), (F.col("user_id") % 4 > 1).alias("strong"))
    return O.heading_levels(rows)


@query(f"""WITH {HEADINGS_SQL}, places AS (SELECT l_orderkey % 140 AS doc_id, l_orderkey * 10 + l_linenumber AS place_no, CAST(l_partkey % 7 AS INT) AS page_index, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y FROM lineitem)
    SELECT doc_id, place_no, (SELECT max(seq) FROM headings h WHERE h.doc_id = p.doc_id AND (h.page_index < p.page_index OR (h.page_index = p.page_index AND h.y <= p.y + 6))) AS section FROM places p""")
def o3_section_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 140).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place_no"), (F.col("l_partkey") % 7).cast("int").alias("page_index"), (F.col("l_suppkey") * 7 % 700).cast("double").alias("y"))
    return O.sections_of(places, headings(spark, sf_dir).withColumnRenamed("seq", "node_no"))


@query(f"WITH {HEADINGS_SQL} SELECT doc_id, seq, level, parent FROM nested")
def o4_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nested(headings(spark, sf_dir)).select("doc_id", "seq", "level", "parent")


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nested(headings(spark, sf_dir)).select("doc_id", F.col("seq").alias("node_no"), F.col("parent").alias("parent_no"), "title", "page_index", "y")


PATHS_SQL = f"""RECURSIVE {HEADINGS_SQL.strip()},
    paths AS (SELECT doc_id, seq AS node_no, title, [title] AS path, [seq] AS path_nos FROM nested WHERE parent IS NULL
              UNION ALL SELECT n.doc_id, n.seq, n.title, list_append(p.path, n.title), list_append(p.path_nos, n.seq) FROM nested n JOIN paths p ON n.parent = p.node_no)"""


@query(f"WITH {PATHS_SQL} SELECT doc_id, node_no, title, CAST(len(path) AS INT) AS depth, array_to_string(path, ' > ') AS path FROM paths")
def o5_outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outline_paths(outline_nodes(spark, sf_dir)).select("doc_id", "node_no", "title", "depth", F.array_join("path", " > ").alias("path"))


@query("""
    WITH RECURSIVE nodes AS (
        SELECT o_custkey AS doc_id, o_orderkey AS node_no, o_orderpriority || ' ' || o_orderkey AS title, CASE
                   WHEN o_orderkey % 31 = 0 THEN -1
                   WHEN o_custkey % 50 = 7 THEN coalesce(lag(o_orderkey) OVER w, max(o_orderkey) OVER (PARTITION BY o_custkey))
                   ELSE lag(o_orderkey) OVER w END AS parent_no
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    paths AS (
        SELECT *, [title] AS path FROM nodes n WHERE parent_no IS NULL OR parent_no = -1
        UNION ALL SELECT n.*, list_append(p.path, n.title) FROM nodes n JOIN paths p ON n.doc_id = p.doc_id AND n.parent_no = p.node_no)
    SELECT doc_id, node_no, CAST(coalesce(len(p.path), 1) AS INT) AS depth, array_to_string(coalesce(p.path, [n.title]), ' > ') AS path FROM nodes n LEFT JOIN paths p USING (doc_id, node_no)""")
def o5_deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer stands below the one before it; some have a parent that is missing, and some customers' orders run in a circle."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before, last = F.lag("o_orderkey").over(order), F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    parent = F.when(F.col("o_orderkey") % 31 == 0, -1).when(F.col("o_custkey") % 50 == 7, F.coalesce(before, last)).otherwise(before)
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node_no"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), parent.alias("parent_no"))
    return O.outline_paths(nodes).select("doc_id", "node_no", "depth", F.array_join("path", " > ").alias("path"))


@query(f"""WITH {PATHS_SQL}, hits AS (SELECT event_id AS node_no, 1 + event_id % 3 AS n FROM events WHERE event_type = 'click'),
    rolled AS (SELECT above AS node_no, sum(n) AS n FROM (SELECT unnest(path_nos) AS above, n FROM paths JOIN hits USING (node_no)) GROUP BY 1)
    SELECT doc_id, node_no, CAST(len(path) AS INT) AS depth, CAST(coalesce(n, 0) AS BIGINT) AS n FROM paths LEFT JOIN rolled USING (node_no)""")
def o5_subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.expr("event_id div 70").alias("doc_id"), F.col("event_id").alias("node_no"), (1 + F.col("event_id") % 3).alias("n"))
    return O.subtree_counts(O.outline_paths(outline_nodes(spark, sf_dir)), hits)


@query(f"""WITH {PATHS_SQL}, keep AS (SELECT DISTINCT unnest(path_nos) AS node_no FROM paths WHERE contains(lower(title), 'purchase 4'))
    SELECT doc_id, node_no, title FROM paths JOIN keep USING (node_no)""")
def q10_outline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.search import filter_outline

    return filter_outline(O.outline_paths(outline_nodes(spark, sf_dir)), "Purchase 4").select("doc_id", "node_no", "title")


@query(f"""WITH {LABELS_SQL},
    toc AS (SELECT doc_id, 'Chapter ' || doc_id || ' ....... ' || CASE doc_id % 4 WHEN 0 THEN 'ii' WHEN 1 THEN '3' WHEN 2 THEN '1' ELSE 'ix' END AS text, doc_id % 6 AS k FROM documents),
    entries AS (SELECT doc_id, 0 AS page_index, 0 AS line_no, 'Chapter ' || doc_id AS title, regexp_extract(text, '([0-9ivx]+)$', 1) AS label FROM toc WHERE k <> 0)
    SELECT e.* FROM entries e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id AND l.label = e.label)""")
def o6_broken_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lines made of the documents; every sixth has no leader dots."""
    key = F.col("doc_id")
    label = F.when(key % 4 == 0, "ii").when(key % 4 == 1, "3").when(key % 4 == 2, "1").otherwise("ix")
    text = F.concat(F.lit("Chapter "), key.cast("string"), F.when(key % 6 == 0, " see ").otherwise(" ....... "), label)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("line_no"), text.alias("text"))
    return O.broken_entries(O.contents_entries(lines), page_labels(label_ranges(spark, sf_dir), files(spark, sf_dir))).select("doc_id", "page_index", "line_no", "title", "label")


@query("""
    WITH g AS (SELECT c_nationkey AS name, list(c_custkey ORDER BY c_acctbal, c_custkey) AS paths FROM customer GROUP BY 1)
    SELECT CAST(name AS BIGINT) AS name, CAST(pos AS INT) AS pos, path, o_orderkey AS anchor FROM (SELECT name, unnest(paths) AS path, unnest(range(0, len(paths))) AS pos FROM g) JOIN orders ON o_custkey = path WHERE o_orderstatus = 'O'""")
def o7_group_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are groups of customers; open orders are their saved places."""
    groups = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("c_acctbal", "c_custkey"))), lambda x: x["c_custkey"]).alias("paths"))
    places = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("anchor"))
    return O.group_anchors(groups, places).select("name", "pos", "path", "anchor")


@query(f"""WITH {LINES_SQL},
    entries AS (SELECT doc_id, page_index, line_no + doc_id % 2 * 5 AS node_no, y0 + doc_id % 2 * 45 AS y, text AS title FROM lines WHERE line_no % 10 = 3),
    met AS (SELECT e.doc_id, e.page_index, e.node_no, l.line_no, abs(l.y0 - e.y) AS off, l.y0 FROM entries e JOIN lines l ON l.doc_id = e.doc_id AND l.page_index = e.page_index AND l.y0 BETWEEN e.y - 20 AND e.y + 40
            AND length(regexp_replace(l.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3 AND length(regexp_replace(e.title, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3
            AND (starts_with(lower(regexp_replace(l.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lower(regexp_replace(e.title, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) OR starts_with(lower(regexp_replace(e.title, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lower(regexp_replace(l.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')))))
    SELECT e.doc_id, CAST(e.page_index * 1000 + e.node_no AS BIGINT) AS node_no, arg_min(m.line_no, (off, m.y0)) AS heading_row, count(m.line_no) = 0 AS is_stale
    FROM entries e LEFT JOIN met m ON m.doc_id = e.doc_id AND m.page_index = e.page_index AND m.node_no = e.node_no GROUP BY e.doc_id, e.page_index, e.node_no""")
def o8_outline_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth line is an outline entry; those of odd documents point 45 points too low."""
    lines = positioned_lines(table(spark, sf_dir, "documents"))
    odd = F.col("doc_id") % 2
    entries = lines.where("line_no % 10 = 3").select("doc_id", (F.col("page_index") * 1000 + F.col("line_no") + odd * 5).cast("long").alias("node_no"), "page_index", (F.col("y0") + odd * 45).alias("y"), F.col("text").alias("title"))
    return O.outline_agreement(entries, lines)
