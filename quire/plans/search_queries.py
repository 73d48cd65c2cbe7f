"""Q- and R-series: corpus search and sensitive data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.matches import matches_sql, search_pattern
from quire.operators import search, sensitive
from quire.plans.base import query
from quire.sources.corpus import PAGE_TEXT_SQL, page_text, table

PHRASE = "of the"
SNIPPET_SQL = "'...' || replace(substr(text, greatest(start - 35, 0) + 1, least(start + len + 35, length(text)) - greatest(start - 35, 0)), chr(10), ' ') || '...'"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "documents"))


def _hits_sql(pattern: str, name: str = "hits") -> str:
    return f"{PAGE_TEXT_SQL}, {matches_sql('page_text', 'doc_id, page_index', 'text', pattern, name)}"


@query(f"""WITH {_hits_sql(search_pattern(PHRASE))}
    SELECT doc_id, CAST(page_index AS INT) AS page_index, start, len, matched, {SNIPPET_SQL} AS snippet FROM hits
    WHERE NOT regexp_matches(CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END, '[\\p{{L}}\\p{{N}}_]')
      AND NOT regexp_matches(substr(text, start + len + 1, 1), '[\\p{{L}}\\p{{N}}_]')""")
def q1_smart_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_pages(spark, sf_dir), PHRASE, whole_word=True)


@query(f"""WITH {_hits_sql(search_pattern("and the", "literal", True))}
    SELECT doc_id, CAST(page_index AS INT) AS page_index, start, len, matched, {SNIPPET_SQL} AS snippet FROM hits""")
def q2_literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_pages(spark, sf_dir), "and the", "literal", match_case=True)


@query(f"""WITH {_hits_sql(search_pattern("[0-9]{2,}[.][0-9]+", "regex"))}
    SELECT doc_id, CAST(page_index AS INT) AS page_index, start, len, matched, {SNIPPET_SQL} AS snippet FROM hits""")
def q3_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_pages(spark, sf_dir), "[0-9]{2,}[.][0-9]+", "regex")


@query(f"""WITH {PAGE_TEXT_SQL},
    soft AS (SELECT doc_id, page_index, text AS raw, replace(regexp_replace(text, '(?m)^[ \\t]*[0-9]{{1,4}}[ \\t]*$\\n?', '', 'g'), chr(173) || chr(10), '') AS s FROM page_text),
    forms AS (SELECT doc_id, page_index, raw,
        replace(replace(regexp_replace(s, '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g'), '-' || chr(10), '-'), chr(10), ' ') AS joined,
        replace(replace(s, '-' || chr(10), '-'), chr(10), ' ') AS hyphened FROM soft)
    SELECT doc_id, CAST(page_index AS INT) AS page_index, regexp_matches(raw, '{search_pattern("the. of")}') AS in_raw,
           regexp_matches(joined, '{search_pattern("the. of")}') AS in_joined, regexp_matches(hyphened, '{search_pattern("the. of")}') AS in_hyphened
    FROM forms WHERE in_raw OR in_joined OR in_hyphened""")
def q4_wrap_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching_pages(_pages(spark, sf_dir), "the. of")


IGNORED = "the |[0-9]+"


@query(f"""WITH {_hits_sql(search_pattern("of and"), "direct")},
    cuts AS (SELECT doc_id, page_index, regexp_extract_all(text, '{IGNORED}') AS gone, string_split_regex(text, '{IGNORED}') AS pieces,
                    regexp_replace(text, '{IGNORED}', '', 'g') AS clean FROM page_text WHERE regexp_matches(text, '{IGNORED}')),
    {matches_sql("cuts", "doc_id, page_index, gone, pieces", "clean", search_pattern("of and"), "cleaned")},
    placed AS (SELECT *, list_transform(range(1, len(gone) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda x: length(x)))) AS clean_at FROM cleaned),
    mapped AS (SELECT doc_id, page_index, matched, start,
        start + coalesce(list_sum(list_transform(range(1, len(gone) + 1), lambda i: CASE WHEN clean_at[i] <= start THEN length(gone[i]) ELSE 0 END)), 0) AS first,
        start + len - 1 + coalesce(list_sum(list_transform(range(1, len(gone) + 1), lambda i: CASE WHEN clean_at[i] <= start + len - 1 THEN length(gone[i]) ELSE 0 END)), 0) AS last FROM placed)
    SELECT doc_id, CAST(page_index AS INT) AS page_index, start, len, matched, true AS direct FROM direct
    UNION ALL SELECT doc_id, CAST(page_index AS INT), CAST(first AS INT), CAST(last - first + 1 AS INT), matched, false FROM mapped m
    WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.doc_id = m.doc_id AND d.page_index = m.page_index AND d.start = m.first)""")
def q5_ignored_interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = search.usable_patterns(spark, ["the ", "[0-9]+", "(unclosed", "x*"])
    return search.search_ignoring(_pages(spark, sf_dir), "of and", ignored)


@query(f"""WITH {_hits_sql(search_pattern("from the", "literal"))}, {matches_sql('page_text', 'doc_id, page_index', 'text', search_pattern("was the", "literal"), 'ocr')}
    SELECT doc_id, CAST(page_index AS INT) AS page_index, start, len, matched FROM hits
    UNION ALL SELECT doc_id, CAST(page_index AS INT), start, len, matched FROM ocr o
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = o.doc_id AND h.page_index = o.page_index)""")
def q7_recognised_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own matches of one phrase; another phrase's matches stand in for the recognised lines."""
    pages = _pages(spark, sf_dir)
    own, recognised = (search.search(pages, q, "literal").drop("snippet") for q in ("from the", "was the"))
    return search.with_recognised(own, recognised)


@query(f"""WITH {_hits_sql(search_pattern(PHRASE))}
    SELECT doc_id, CAST(page_index AS INT) AS page_index, CAST(page_index // 2 AS INT) AS section, count(*) AS hits,
           CAST(sum(count(*)) OVER (PARTITION BY doc_id, page_index // 2) AS BIGINT) AS section_hits, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS doc_hits
    FROM hits GROUP BY doc_id, page_index""")
def q8_result_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(_pages(spark, sf_dir), PHRASE)
    return search.section_groups(hits.withColumn("section", F.expr("page_index div 2").cast("int")))


@query(f"""WITH {_hits_sql(search_pattern(PHRASE))}
    SELECT * FROM (SELECT doc_id, CAST(page_index AS INT) AS page_index, start, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, start) AS n,
                          count(*) OVER (PARTITION BY doc_id) AS total FROM hits) WHERE n <= 100""")
def q8_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(_pages(spark, sf_dir), PHRASE).select("doc_id", "page_index", "start")
    return search.first_hits(hits)


@query(f"""WITH {_hits_sql(search_pattern(PHRASE))},
    placed AS (SELECT doc_id, CAST(page_index AS INT) AS page_index, start, doc_id % 3 AS focus FROM hits),
    firsts AS (SELECT doc_id, coalesce(min((page_index, start)) FILTER (WHERE page_index >= focus), max((page_index, start))) AS f FROM placed GROUP BY doc_id)
    SELECT doc_id, page_index, start, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN abs(page_index - focus) <= 1 THEN 0 WHEN page_index > focus THEN 1 ELSE 2 END, page_index, start) AS rank,
           (page_index, start) = f AS is_first FROM placed JOIN firsts USING (doc_id)""")
def q9_near_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(_pages(spark, sf_dir), PHRASE)
    focus = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("focus_page"))
    return search.near_first(hits, focus, reach=1)


@query(f"""SELECT event_id, event_type, user_id FROM events WHERE contains(lower(event_type), 'pur') OR contains(lower(CAST(user_id AS VARCHAR)), 'pur')""")
def q11_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_list(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), " PUR ", ["event_type", "user_id"])


@query(f"""WITH {PAGE_TEXT_SQL}
    SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') AS scans,
           avg(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 1.0 ELSE 0.0 END) AS scan_share FROM page_text GROUP BY doc_id""")
def q12_scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scanned_pages(_pages(spark, sf_dir))


def _findings_sql() -> str:
    parts = [matches_sql("page_text", "doc_id, page_index", "text", "(?i)" + p, f"f_{n}", sensitive.NOT_AFTER.get(n, "")) for n, p in sensitive.PRESETS.items()]
    union = " UNION ALL ".join(f"SELECT doc_id, CAST(page_index AS INT) AS page_index, '{n}' AS preset, start, len, matched FROM f_{n}" for n in sensitive.PRESETS)
    return f"{PAGE_TEXT_SQL}, {', '.join(parts)}, findings AS ({union})"


FINDINGS_SQL = _findings_sql()


@query(f"WITH {FINDINGS_SQL} SELECT * FROM findings")
def r1_preset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitive.scan(_pages(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT preset, lang, source, count(*) AS findings, count(DISTINCT doc_id) AS docs FROM findings JOIN documents USING (doc_id) GROUP BY ALL")
def r2_findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitive.rollup(sensitive.scan(_pages(spark, sf_dir)), table(spark, sf_dir, "documents"))


@query(f"""WITH {FINDINGS_SQL}
    SELECT * FROM (SELECT preset, doc_id, count(*) AS findings, row_number() OVER (PARTITION BY preset ORDER BY count(*) DESC, doc_id) AS rank FROM findings GROUP BY preset, doc_id) WHERE rank <= 5""")
def r2_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitive.top_documents(sensitive.scan(_pages(spark, sf_dir)))


@query(f"""WITH {PAGE_TEXT_SQL} SELECT doc_id, CAST(page_index AS INT) AS page_index, regexp_replace(text, '{sensitive.PRESETS["email"]}', '', 'g') AS text, regexp_matches(text, '{sensitive.PRESETS["email"]}') AS redacted FROM page_text""")
def r3_apply_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail findings are the selected ones, and are removed."""
    pages = _pages(spark, sf_dir)
    return sensitive.redact(pages, sensitive.scan(pages, {"email": sensitive.PRESETS["email"]}), remove=True)


@query(f"""WITH {FINDINGS_SQL} SELECT doc_id, page_index, preset, start, len, matched FROM findings f WHERE preset <> 'email'""")
def r3_remaining_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sensitive.scan(_pages(spark, sf_dir))
    return sensitive.remaining(found, found.where("preset = 'email'"))


@query(f"""WITH {FINDINGS_SQL},
    whole AS (SELECT f.doc_id, regexp_extract(substr(text, 1, start), '\\S*$') || matched || regexp_extract(substr(text, start + len + 1), '^\\S*') AS words FROM findings f JOIN page_text p ON p.doc_id = f.doc_id AND p.page_index = f.page_index),
    gone AS (SELECT DISTINCT doc_id, regexp_replace(unnest(string_split_regex(lower(words), '\\s+')), '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS w FROM whole),
    titles AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS title FROM documents),
    tokens AS (SELECT doc_id, unnest(string_split(title, ' ')) AS t, unnest(range(0, len(string_split(title, ' ')))) AS k FROM titles),
    judged AS (SELECT tokens.*, g.w IS NOT NULL AS hit FROM tokens LEFT JOIN (SELECT * FROM gone WHERE w <> '') g ON g.doc_id = tokens.doc_id AND g.w = regexp_replace(lower(t), '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))
    SELECT doc_id, string_agg(CASE WHEN hit THEN regexp_extract(t, '^[[:punct:]]*') || '[Redacted]' || regexp_extract(t, '[[:punct:]]*$') ELSE t END, ' ' ORDER BY k) AS title
    FROM judged GROUP BY doc_id""")
def r4_title_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines are the titles."""
    docs, pages = table(spark, sf_dir, "documents"), _pages(spark, sf_dir)
    titles = docs.select("doc_id", F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0).alias("title"))
    return sensitive.redact_titles(sensitive.whole_words(sensitive.scan(pages), pages), titles)


@query(f"""WITH {FINDINGS_SQL}
    SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM findings) THEN lang END AS lang, CASE WHEN doc_id NOT IN (SELECT doc_id FROM findings) THEN source END AS source, n_chars FROM documents""")
def r5_document_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sensitive.scrub(docs, sensitive.scan(_pages(spark, sf_dir)), ["lang", "source"])


@query("""
    WITH RECURSIVE marks AS (
        SELECT o_custkey AS doc_id, CAST(o_orderkey % 2 AS INT) AS page_index, o_orderkey AS obj, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) END AS parent_obj,
               CASE o_orderkey % 7 WHEN 0 THEN 'popup' WHEN 1 THEN 'link' WHEN 2 THEN 'widget' ELSE 'note' END AS kind,
               o_orderkey * 37 % 500 AS x0, o_orderkey * 37 % 500 + 15 + o_orderkey % 90 AS x1, o_orderkey * 53 % 700 - 8 - o_orderkey % 60 AS y0, o_orderkey * 53 % 700 AS y1 FROM orders),
    regions AS (SELECT o_custkey AS doc_id, o_orderkey % 2 AS page_index, o_orderkey * 71 % 480 AS x0, o_orderkey * 71 % 480 + 120 AS x1, o_orderkey * 29 % 690 AS y0, o_orderkey * 29 % 690 + 50 AS y1 FROM orders WHERE o_orderstatus = 'P'),
    gone AS (
        SELECT m.doc_id, m.page_index, m.obj, m.kind FROM marks m JOIN regions r ON m.doc_id = r.doc_id AND m.page_index = r.page_index AND m.x0 < r.x1 AND r.x0 < m.x1 AND m.y0 < r.y1 AND r.y0 < m.y1 WHERE m.kind NOT IN ('popup', 'link')
        UNION SELECT m.doc_id, m.page_index, m.obj, m.kind FROM marks m JOIN gone g ON m.doc_id = g.doc_id AND m.page_index = g.page_index AND m.parent_obj = g.obj WHERE m.kind <> 'widget' AND g.kind <> 'widget')
    SELECT doc_id, page_index, obj, kind FROM marks ANTI JOIN gone USING (doc_id, page_index, obj)""")
def r5_region_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark for each order, some replies to the one before; the regions are few, as redactions are: those of orders of one status."""
    k, order = F.col("o_orderkey"), Window.partitionBy("o_custkey", F.col("o_orderkey") % 2).orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    place = [F.col("o_custkey").alias("doc_id"), (k % 2).cast("int").alias("page_index")]
    kind = F.when(k % 7 == 0, "popup").when(k % 7 == 1, "link").when(k % 7 == 2, "widget").otherwise("note")
    x, y = k * 37 % 500, k * 53 % 700
    marks = orders.select(*place, k.alias("obj"), F.when(k % 3 == 0, F.lag(k).over(order)).alias("parent_obj"), kind.alias("kind"), x.alias("x0"), y.alias("y0"), (x + 15 + k % 90).alias("x1"), (y - 8 - k % 60).alias("y1"))
    x, y = k * 71 % 480, k * 29 % 690
    regions = orders.where("o_orderstatus = 'P'").select(*place, x.alias("x0"), y.alias("y0"), (x + 120).alias("x1"), (y + 50).alias("y1"))
    return sensitive.scrub_regions(marks, regions).select("doc_id", "page_index", "obj", "kind")


@query(f"""WITH {FINDINGS_SQL} SELECT doc_id, CAST(page_index AS INT) AS page_index, length(text) AS n FROM page_text p
    WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = p.doc_id AND f.page_index = p.page_index)""")
def r6_derived_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    hit = sensitive.scan(pages).select("doc_id", "page_index").distinct()
    return sensitive.invalidate(pages.select("doc_id", "page_index", F.char_length("text").cast("long").alias("n")), hit)


@query("SELECT unnest(['" + "', '".join(sensitive.PRESETS) + "']) AS preset, CAST(0 AS BIGINT) AS found")
def r6_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return sensitive.leak_audit(sensitive.redact(pages, sensitive.scan(pages)))
