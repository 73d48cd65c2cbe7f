"""S-series: sources, sinks and the index store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.base import query
from quire.sources import corpus, sinks
from quire.sources.corpus import LINES_SQL, PAGE_TEXT_SQL, STYLED_SQL, table


@query(f"WITH {PAGE_TEXT_SQL} SELECT doc_id, CAST(page_index AS INT) AS page_index, text FROM page_text")
def s1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_text(table(spark, sf_dir, "documents"))


@query(f"WITH {LINES_SQL} SELECT * FROM lines")
def s2_positioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.positioned_lines(table(spark, sf_dir, "documents"))


@query(f"WITH {STYLED_SQL} SELECT page_id, tag, CAST(n AS INT) AS n, text, CAST(size AS DOUBLE) AS size, bold FROM styled")
def s3_styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.styled_lines(table(spark, sf_dir, "pages"))


@query(f"""WITH {PAGE_TEXT_SQL}
    SELECT doc_id, string_agg('--- Page ' || (page_index + 1) || ' ---' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_index) AS text
    FROM page_text GROUP BY doc_id""")
def s4_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.page_text(table(spark, sf_dir, "documents"))
    return sinks.document_export(pages.withColumnRenamed("text", "body"), separators=True)


@query("""
    SELECT k, string_agg('"' || l_orderkey || '","' || (l_linenumber - 1) || '","' || l_returnflag || '","' || printf('%.2f', l_extendedprice) || '"',
                         chr(10) ORDER BY l_orderkey, l_linenumber, l_returnflag, printf('%.2f', l_extendedprice)) AS csv
    FROM (SELECT *, 1 + l_orderkey % 50 AS k FROM lineitem) GROUP BY k""")
def s5_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("1 + l_orderkey % 50").alias("k"),
        F.col("l_orderkey").alias("Document"),
        (F.col("l_linenumber") - 1).alias("Page"),
        F.col("l_returnflag").alias("Type"),
        F.format_string("%.2f", F.col("l_extendedprice").cast("double")).alias("Value"),
    )
    return sinks.csv_rows(rows, "k", ["Document", "Page", "Type", "Value"])


@query("""
    WITH entries AS (SELECT user_id AS path, event_id, ts AS used, octet_length(encode(props)) * 1000 AS bytes,
                            event_type <> 'error' AS version_ok, value < 450 AS source_there, abs(value - round(value)) <= 0.4 AS fresh FROM events),
    valid AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY used DESC, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM entries WHERE version_ok AND source_there AND fresh)
    SELECT event_id, bytes, running, running <= 20000000 AS kept FROM valid""")
def s6_index_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("used"), (F.octet_length("props") * 1000).cast("long").alias("bytes"), (F.col("event_type") != "error").alias("version_ok"), (F.col("value") < 450).alias("source_there"), (F.abs(F.col("value") - F.round("value")) <= 0.4).alias("fresh"))
    valid = entries.where("version_ok AND source_there AND fresh")
    return sinks.evict_to(valid, 20_000_000).select("event_id", "bytes", "running", "kept")
