"""Tables that the operators read, derived from the raw tables by column arithmetic.

Pages hold ``LINES_PER_PAGE`` lines of a document's text; lines sit on a 612 x 792 page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 40
LEFT, TOP, PITCH, HEIGHT, WIDTH = 72, 100, 14, 11, 400
PAGE_WIDTH, PAGE_HEIGHT = 612, 792


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, line (number in the document), page_index, line_no (on the page), text."""
    each = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    return each.select("doc_id", "line", F.expr(f"line div {lines_per_page}").cast("int").alias("page_index"), (F.col("line") % lines_per_page).alias("line_no"), "text")


def line_lists(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, lines: the ``document_lines`` of a document (page_index, line_no, text) in order, as one row: no shuffle."""
    line = lambda t, k: F.struct(F.floor(k / lines_per_page).cast("int").alias("page_index"), (k % lines_per_page).alias("line_no"), t.alias("text"))
    return docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line).alias("lines"))


def page_text(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, page_index, text.  Pages are slices of the line array: no shuffle."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    pages = F.sequence(F.lit(0), F.expr(f"(size(_lines) - 1) div {lines_per_page}").cast("int"))
    cut = docs.select("doc_id", lines.alias("_lines")).select("doc_id", "_lines", F.explode(pages).alias("page_index"))
    return cut.select("doc_id", "page_index", F.array_join(F.slice("_lines", F.col("page_index") * lines_per_page + 1, lines_per_page), "\n").alias("text"))


def positioned_lines(docs: DataFrame) -> DataFrame:
    """The lines with their boxes; y grows downward."""
    y = F.lit(TOP) + F.col("line_no") * PITCH
    return document_lines(docs).select("doc_id", "page_index", F.lit(0).alias("block_no"), "line_no", "text", F.lit(float(LEFT)).alias("x0"), y.cast("double").alias("y0"), F.lit(float(LEFT + WIDTH)).alias("x1"), (y + HEIGHT).cast("double").alias("y1"))


#: tag, size, bold: fixed values of the tag styles.
STYLES = [("h1", 18.0, True), ("p", 10.0, False), ("b", 10.0, True), ("nav", 9.0, False), ("footer", 9.0, False)]


def _styled(tag: str, size: float, bold: bool):
    return lambda text, n: F.struct(F.lit(tag).alias("tag"), n.alias("n"), text.alias("text"), F.lit(size).alias("size"), F.lit(bold).alias("bold"))


def _tagged(tag: str) -> str:
    """Texts right behind a start of the tag, with attributes or not."""
    return rf"<{tag}(?:\s[^>]*)?>([^<]+)"


def styled_lines(pages: DataFrame) -> DataFrame:
    """S3: page_id, tag, n (of the tag on the page), text, size, bold of the tagged texts of web pages."""
    found = []
    for tag, size, bold in STYLES:
        texts = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_tagged(tag)), F.lit(1))
        found.append(F.transform(texts, _styled(tag, size, bold)))
    return pages.select("page_id", F.explode(F.concat(*found)).alias("x")).select("page_id", "x.*")


PAGE_TEXT_SQL = f"""
    page_text AS (
        SELECT doc_id, p AS page_index, array_to_string(lines[p * {LINES_PER_PAGE} + 1 : (p + 1) * {LINES_PER_PAGE}], chr(10)) AS text
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             LATERAL (SELECT unnest(range(0, (len(lines) - 1) // {LINES_PER_PAGE} + 1)) AS p))"""

LINES_SQL = f"""
    lines AS (
        SELECT doc_id, CAST(line // {LINES_PER_PAGE} AS INT) AS page_index, 0 AS block_no, CAST(line % {LINES_PER_PAGE} AS INT) AS line_no, text,
               {LEFT}.0::DOUBLE AS x0, ({TOP} + line % {LINES_PER_PAGE} * {PITCH})::DOUBLE AS y0, {LEFT + WIDTH}.0::DOUBLE AS x1,
               ({TOP} + line % {LINES_PER_PAGE} * {PITCH} + {HEIGHT})::DOUBLE AS y1
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
                     unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents))"""

STYLED_SQL = "styled AS (" + " UNION ALL ".join(
    f"SELECT page_id, '{tag}' AS tag, unnest(range(0, len(regexp_extract_all(html, '<{tag}(?:\\s[^>]*)?>([^<]+)', 1)))) AS n, unnest(regexp_extract_all(html, '<{tag}(?:\\s[^>]*)?>([^<]+)', 1)) AS text, {size} AS size, {str(bold).lower()} AS bold FROM pages"
    for tag, size, bold in STYLES
) + ")"
