"""D-series: page sets and inventories over documents, events and tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import page_sets as D
from quire.plans.base import query
from quire.sources.corpus import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", name.alias("name"), F.expr("1 + n_chars div 1500").alias("page_count"), (F.col("doc_id") % 11 == 0).alias("failed"), "source", "lang")


FILES_SQL = "files AS (SELECT doc_id, source || '-' || doc_id AS name, 1 + n_chars // 1500 AS page_count, doc_id % 11 = 0 AS failed, source, lang FROM documents)"
NUMBERED_SQL = f"""{FILES_SQL},
    based AS (SELECT doc_id, page_count, sum(page_count) OVER (ORDER BY CAST(substr(source, 4) AS INT), doc_id ROWS UNBOUNDED PRECEDING) - page_count AS base FROM files WHERE NOT failed),
    pages AS (SELECT doc_id, page_count, base, unnest(range(0, page_count)) AS k FROM based)"""


@query(f"""WITH {NUMBERED_SQL}
    SELECT doc_id, CAST(k AS INT) AS page_index, (SELECT name FROM files f WHERE f.doc_id = pages.doc_id) || ' (2024-02-03) p. ' || k + 5 || '/' || page_count || ' B' || lpad(CAST(CAST(base + k + 1 AS BIGINT) AS VARCHAR), 6, '0') AS mark FROM pages""")
def d2_mark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = D.sequential_numbers(files(spark, sf_dir), prefix="B", template="<<file>> (<<date>>) p. <<page>>/<<pages>> <<bates>>", date="2024-02-03", first_page=5)
    return marked.select("doc_id", "page_index", "mark")


@query(f"""WITH {FILES_SQL},
    r AS (SELECT doc_id, name, page_count, unnest([0, 1, 2]) AS part, unnest([1, 2, 4]) AS a, unnest([2, 2, 9]) AS b FROM files),
    c AS (SELECT *, least(a, page_count) AS s, least(b, page_count) AS e FROM r WHERE part <> 1 OR a <= page_count)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS split_no, CAST(s - 1 AS INT) AS first, CAST(e - 1 AS INT) AS last, CASE WHEN s = e THEN name || '_Page_' || s ELSE name || '_Pages_' || s || '-' || e END AS name FROM c""")
def d3_custom_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.custom_splits(files(spark, sf_dir).withColumn("spec", F.lit("1-2, 2, x, 4 - 9, 5-3")))


@query(f"WITH {NUMBERED_SQL} SELECT doc_id, CAST(k AS INT) AS page_index, CAST(base + k + 1 AS BIGINT) AS number, 'Q' || lpad(CAST(CAST(base + k + 1 AS BIGINT) AS VARCHAR), 6, '0') || ' of ' || page_count AS mark FROM pages")
def d1_sequential_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sequential_numbers(files(spark, sf_dir), prefix="Q")


@query(f"""WITH {FILES_SQL},
    asked AS (SELECT doc_id, page_count, doc_id % 4 AS k FROM files),
    parts AS (SELECT doc_id, page_count, unnest(CASE k WHEN 0 THEN [[1, page_count]] WHEN 1 THEN [[2, 1], [1, 1]] WHEN 2 THEN [[page_count, page_count], [9, 9]] ELSE [[1, 1], [1, page_count]] END) AS r,
                     unnest(range(0, CASE k WHEN 0 THEN 1 ELSE 2 END)) AS part FROM asked),
    pages AS (SELECT doc_id, part, unnest(CASE WHEN r[1] > page_count OR r[2] > page_count THEN [0] WHEN r[1] <= r[2] THEN range(r[1], r[2] + 1) ELSE range(r[1], r[2] - 1, -1) END) AS page,
                     unnest(range(0, CASE WHEN r[1] > page_count OR r[2] > page_count THEN 1 ELSE abs(r[2] - r[1]) + 1 END)) AS k FROM parts)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, k) AS INT) AS at, CAST(page - 1 AS INT) AS page_index FROM pages""")
def d3_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.when(F.col("doc_id") % 4 == 0, "1-").when(F.col("doc_id") % 4 == 1, "2-1, 1").when(F.col("doc_id") % 4 == 2, F.concat(F.col("page_count").cast("string"), F.lit(", 9"))).otherwise("1,-" + "0")
    spec = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("1, -"), F.col("page_count").cast("string"))).otherwise(spec)
    return D.page_ranges(files(spark, sf_dir).withColumn("spec", spec))


@query(f"""WITH {FILES_SQL}, each AS (SELECT *, unnest(range(0, (page_count - 1) // 3 + 1)) AS k FROM files)
    SELECT doc_id, CAST(k AS INT) AS split_no, k * 3 AS first, least(k * 3 + 3, page_count) - 1 AS last, name || '_' || (k + 1) AS name FROM each""")
def d3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.splits(files(spark, sf_dir), 3)


def label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman front matter of two pages, then numbers from 1 with a prefix; every fifth document has no ranges."""
    docs = files(spark, sf_dir).where("doc_id % 5 != 0")
    ranges = F.array(F.struct(F.lit(0).alias("first"), F.lit("r").alias("style"), F.lit("").alias("prefix"), F.lit(1).alias("start")), F.struct(F.lit(2).alias("first"), F.lit("D").alias("style"), F.lit("A-").alias("prefix"), F.lit(1).alias("start")))
    return docs.select("doc_id", F.explode(ranges).alias("r")).select("doc_id", "r.*")


LABELS_SQL = f"""{FILES_SQL}, numbered AS (SELECT doc_id, page_count, CAST(unnest(range(0, page_count)) AS INT) AS page_index FROM files),
    labels AS (SELECT doc_id, page_count, page_index, CASE WHEN doc_id % 5 = 0 THEN CAST(page_index + 1 AS VARCHAR) WHEN page_index < 2 THEN ['i', 'ii'][page_index + 1] ELSE 'A-' || (page_index - 1) END AS label FROM numbered)"""


@query(f"WITH {LABELS_SQL} SELECT doc_id, page_index, label FROM labels")
def d4_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_labels(label_ranges(spark, sf_dir), files(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, ev AS (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY 1), li AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1),
    rows AS (SELECT f.doc_id, lang, coalesce(ev.n, 0) AS n_events, coalesce(li.n, 0) AS n_marks FROM files f LEFT JOIN ev USING (doc_id) LEFT JOIN li USING (doc_id))
    SELECT lang, n_events > 0 AS has_events, CAST(grouping(lang) * 2 + grouping(n_events > 0) AS INT) AS level, count(*) AS docs, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_marks) AS BIGINT) AS n_marks FROM rows GROUP BY CUBE (lang, n_events > 0)""")
def d5_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"))
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    rows = D.inventory(files(spark, sf_dir).select("doc_id", "lang"), events=events, marks=marks).withColumn("has_events", F.col("n_events") > 0)
    return D.inventory_cube(rows, ["lang", "has_events"], ["n_events", "n_marks"])


@query("""
    WITH fields AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS page_index, o_orderkey AS field_no, CASE o_orderkey % 4 WHEN 0 THEN 'radio' WHEN 1 THEN 'checkbox' ELSE 'text' END AS kind,
                           'form.' || o_orderstatus || o_orderkey % 2 AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'Field ' || o_orderkey % 7 ELSE '' END AS description, CASE o_orderkey % 3 WHEN 0 THEN 'Off' ELSE o_orderstatus END AS value FROM orders),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, name ORDER BY field_no) AS n FROM fields)
    SELECT doc_id, page_index, field_no, coalesce(nullif(description, ''), string_split(name, '.')[-1]) AS shown, kind,
           CASE WHEN kind = 'checkbox' THEN CASE WHEN lower(value) IN ('', 'off', 'no', 'false') THEN 'off' ELSE 'on' END ELSE value END AS value FROM numbered WHERE kind = 'text' OR n = 1""")
def d6_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    fields = o.select(F.col("o_custkey").alias("doc_id"), (key % 3).alias("page_index"), key.alias("field_no"), F.when(key % 4 == 0, "radio").when(key % 4 == 1, "checkbox").otherwise("text").alias("kind"), F.concat(F.lit("form."), "o_orderstatus", (key % 2).cast("string")).alias("name"), F.when(key % 5 == 0, F.concat(F.lit("Field "), (key % 7).cast("string"))).otherwise("").alias("description"), F.when(key % 3 == 0, "Off").otherwise(F.col("o_orderstatus")).alias("value"))
    return D.form_fields(fields)


@query("""
    WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, unnest(range(0, len(string_split(coalesce(text, ''), ' ')))) AS pos FROM documents),
    words AS (SELECT doc_id, CAST(pos // 320 AS INT) AS page_index, pos, word, 72 + pos % 8 * 50 AS x0, 100 + pos % 320 // 8 * 14 AS y0 FROM w),
    links AS (SELECT doc_id, CAST(unnest(range(0, (len(string_split(coalesce(text, ''), ' ')) - 1) // 320 + 1)) AS INT) AS page_index FROM documents),
    boxes AS (SELECT *, 70 + doc_id % 3 * 50 AS x0, 98 + (doc_id + page_index) % 4 * 14 AS y0, 70 + doc_id % 3 * 50 + 110 AS x1, 98 + (doc_id + page_index) % 4 * 14 + 15 AS y1, CASE WHEN doc_id % 2 = 0 THEN 'mailto:a' || doc_id || '@example.org' ELSE 'section.' || doc_id END AS target FROM links)
    SELECT l.doc_id, l.page_index, 0 AS link_no, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS text, CASE WHEN l.doc_id % 2 = 0 THEN 'external' ELSE 'internal' END AS kind, replace(target, 'mailto:', '') AS target
    FROM boxes l LEFT JOIN words w ON w.doc_id = l.doc_id AND w.page_index = l.page_index AND w.x0 + 24 BETWEEN l.x0 AND l.x1 AND w.y0 + 5.5 BETWEEN l.y0 AND l.y1 GROUP BY l.doc_id, l.page_index, target""")
def d7_link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each text, 8 to a row and 40 rows to a page, and a link on every page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    each = docs.select("doc_id", F.posexplode("w").alias("pos", "word"))
    x, y = 72 + F.col("pos") % 8 * 50, 100 + F.floor(F.col("pos") % 320 / 8) * 14
    words = each.select("doc_id", F.expr("cast(pos div 320 as int)").alias("page_index"), "pos", "word", x.alias("wx0"), (x + 48).alias("wx1"), y.alias("wy0"), (y + 11).alias("wy1"))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast((size(w) - 1) div 320 as int)"))).alias("page_index"))
    lx, ly = 70 + F.col("doc_id") % 3 * 50, 98 + (F.col("doc_id") + F.col("page_index")) % 4 * 14
    target = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("mailto:a"), F.col("doc_id").cast("string"), F.lit("@example.org"))).otherwise(F.concat(F.lit("section."), F.col("doc_id").cast("string")))
    links = pages.select("doc_id", "page_index", F.lit(0).alias("link_no"), lx.alias("x0"), ly.alias("y0"), (lx + 110).alias("x1"), (ly + 15).alias("y1"), target.alias("target"))
    return D.link_rows(links, words)


@query("""
    WITH att AS (SELECT event_id, user_id AS doc_id, CASE event_id % 4 WHEN 0 THEN 'dir/' || event_type || '.txt' WHEN 1 THEN '..' || event_type || ':x' WHEN 2 THEN 'a/' ELSE event_type END AS name FROM events),
    safe AS (SELECT *, regexp_replace(replace(string_split(name, '/')[-1], ':', '-'), '^[.]+', '') AS s FROM att)
    SELECT event_id, doc_id, CASE WHEN trim(s) = '' THEN 'attachment' ELSE s END AS safe, count(*) OVER (PARTITION BY doc_id, CASE WHEN trim(s) = '' THEN 'attachment' ELSE s END) AS same FROM safe""")
def d8_attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id") % 4
    name = F.when(n == 0, F.concat(F.lit("dir/"), kind, F.lit(".txt"))).when(n == 1, F.concat(F.lit(".."), kind, F.lit(":x"))).when(n == 2, "a/").otherwise(kind)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), name.alias("name"))
    return D.attachment_names(rows).select("event_id", "doc_id", "safe", "same")


@query("""
    SELECT user_id AS doc_id, count(*) AS signatures, count(*) FILTER (WHERE event_type <> 'error') AS intact, count(*) FILTER (WHERE event_type = 'error' OR value > 400) AS problems,
           bool_and(event_type <> 'error' AND value <= 100 AND event_id % 2 = 0) AS all_valid FROM events GROUP BY user_id""")
def d9_signature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    verdicts = e.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "error", "broken").otherwise("intact").alias("integrity"), F.when(F.col("value") > 400, "forbidden").when(F.col("value") > 100, "allowed").otherwise("none").alias("changes"), F.when(F.col("event_id") % 2 == 0, "trusted").otherwise("unknown").alias("identity"))
    return D.signature_status(verdicts)


@query("""
    SELECT key, ts, row_number() OVER (ORDER BY ts DESC, key) AS rank FROM (SELECT user_id AS key, max(ts) AS ts FROM events WHERE user_id IN (SELECT doc_id FROM documents) GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 25)""")
def d10_recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    return D.recent_documents(opens, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), 25)


@query(f"""WITH {LABELS_SQL},
    asked AS (SELECT doc_id, page_count, CASE doc_id % 3 WHEN 0 THEN 'II' WHEN 1 THEN '#' || doc_id % 7 ELSE 'a-1' END AS q, doc_id % 2 AS current FROM files),
    hits AS (SELECT a.doc_id, q, current, a.page_count, min((CAST(label <> q AS INT), ((page_index - current - 1) % a.page_count + a.page_count) % a.page_count, page_index)) AS b
             FROM asked a LEFT JOIN labels l ON l.doc_id = a.doc_id AND lower(l.label) = lower(q) AND NOT starts_with(q, '#') GROUP BY ALL)
    SELECT doc_id, q, current, coalesce(CASE WHEN b[3] IS NOT NULL THEN b[3] END, CASE WHEN regexp_matches(q, '^#?[0-9]+$') THEN greatest(0, least(CAST(replace(q, '#', '') AS INT), page_count) - 1) END) AS page_index FROM hits""")
def d11_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir)
    q = F.when(F.col("doc_id") % 3 == 0, "II").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("#"), (F.col("doc_id") % 7).cast("string"))).otherwise("a-1")
    lookups = docs.select("doc_id", q.alias("q"), (F.col("doc_id") % 2).alias("current"))
    out = D.label_lookup(lookups, D.page_labels(label_ranges(spark, sf_dir), docs), docs)
    return out.withColumn("page_index", F.col("page_index").cast("long"))
