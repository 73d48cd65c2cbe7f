"""Corpus search: patterns, wrap-aware and interruption-aware matching, grouping and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.matches import matches, search_pattern

SNIPPET_REACH, LINE_REACH, PAGE_REACH, FIRST_HITS = 35, 30, 50, 100
WORD_CHAR = r"[\p{L}\p{N}_]"


def snippet(text: Column, start: Column, length: Column, reach: int = SNIPPET_REACH) -> Column:
    """Q6: the match with its surroundings on one line, between dots."""
    begin = F.greatest(start - reach, F.lit(0))
    end = F.least(start + length + reach, F.char_length(text))
    return F.concat(F.lit("..."), F.replace(F.substring(text, begin + 1, end - begin), F.lit("\n"), F.lit(" ")), F.lit("..."))


def line_snippet(text: Column, start: Column, length: Column, reach: int = LINE_REACH) -> Column:
    """Q6: the match with its surroundings on a recognised line, dots only where it is cut."""
    begin = F.greatest(start - reach, F.lit(0))
    end = F.least(start + length + reach, F.char_length(text))
    dots = lambda cut: F.when(cut, "...").otherwise("")
    return F.concat(dots(begin > 0), F.substring(text, begin + 1, end - begin), dots(end < F.char_length(text)))


def is_whole_word(text: Column, start: Column, length: Column) -> Column:
    """No word character touches the match on either side."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    after = F.substring(text, start + length + 1, F.lit(1))
    return ~before.rlike(WORD_CHAR) & ~after.rlike(WORD_CHAR)


def search(pages: DataFrame, query: str, mode: str = "smart", match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Q1-Q3, Q6: doc_id, page_index, start, len, matched, snippet.  Pages without a match are dropped at the scan."""
    pattern = search_pattern(query, mode, match_case)
    hit = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page_index", "text", F.explode(matches(F.col("text"), pattern)).alias("m"))
    if whole_word:
        hit = hit.where(is_whole_word(F.col("text"), F.col("m.start"), F.col("m.len")))
    return hit.select("doc_id", "page_index", "m.start", "m.len", "m.matched", snippet(F.col("text"), F.col("m.start"), F.col("m.len")).alias("snippet"))


def unwrapped(pages: DataFrame) -> DataFrame:
    """Q4: raw text, and two forms with line ends undone: hyphens of broken words dropped, and kept.

    Lines that hold only a number of one to four digits go first.
    """
    bare = F.regexp_replace("text", r"(?m)^[ \t]*[0-9]{1,4}[ \t]*$\n?", "")
    soft = F.regexp_replace(bare, "­\n", "")
    dropped = F.regexp_replace(F.regexp_replace(soft, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"-\n", "-")
    kept = F.regexp_replace(soft, r"-\n", "-")
    return pages.select("doc_id", "page_index", F.col("text").alias("raw"), F.replace(dropped, F.lit("\n"), F.lit(" ")).alias("joined"), F.replace(kept, F.lit("\n"), F.lit(" ")).alias("hyphened"))


def matching_pages(pages: DataFrame, query: str) -> DataFrame:
    """Q4: pages where any form of the text has the query, and which forms do."""
    pattern = search_pattern(query)
    out = unwrapped(pages)
    for form in ("raw", "joined", "hyphened"):
        out = out.withColumn(f"in_{form}", F.col(form).rlike(pattern))
    return out.where("in_raw OR in_joined OR in_hyphened").select("doc_id", "page_index", "in_raw", "in_joined", "in_hyphened")


def usable_patterns(spark, patterns: list[str]) -> list[str]:
    """Q5: the patterns that compile and don't match the empty string."""
    from pyspark.errors import PySparkException

    good = []
    for p in patterns:
        try:
            if not spark.range(1).select(F.lit("").rlike(p).alias("e")).first()["e"]:
                good.append(p)
        except PySparkException:
            continue
    return good


def search_ignoring(pages: DataFrame, query: str, ignored: list[str]) -> DataFrame:
    """Q5: matches of the text, and those found once the ignored patterns are cut out.

    Offsets of the latter are mapped back by the lengths of what was cut before them; one that
    starts where a direct match starts is left out.
    """
    pattern = search_pattern(query)
    cut = "|".join(f"(?:{p})" for p in ignored)
    direct = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page_index", F.explode(matches(F.col("text"), pattern)).alias("m")).select("doc_id", "page_index", "m.*", F.lit(True).alias("direct"))
    if not ignored:
        return direct
    clean = F.regexp_replace("text", cut, "")
    rest = pages.where(F.col("text").rlike(cut)).withColumn("clean", clean).where(F.col("clean").rlike(pattern))
    rest = rest.select("doc_id", "page_index", matches(F.col("text"), cut).alias("gone"), F.explode(matches(F.col("clean"), pattern)).alias("m"))

    def original(place: Column) -> Column:
        """Place in the text of a place in the cut text: every cut that lies before it moves it on."""
        return F.aggregate("gone", place, lambda at, g: F.when(g["start"] <= at, at + g["len"]).otherwise(at))

    mapped = rest.withColumn("start", original(F.col("m.start"))).withColumn("last", original(F.col("m.start") + F.col("m.len") - 1))
    extra = mapped.select("doc_id", "page_index", "start", (F.col("last") - F.col("start") + 1).alias("len"), F.col("m.matched").alias("matched"), F.lit(False).alias("direct"))
    return direct.unionByName(extra.join(direct, ["doc_id", "page_index", "start"], "left_anti"))


def with_recognised(matched: DataFrame, recognised: DataFrame) -> DataFrame:
    """Q7: matches of recognised lines, on pages only whose own text has none."""
    return matched.unionByName(recognised.join(matched.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti"))


def section_groups(hits: DataFrame) -> DataFrame:
    """Q8: hits per document, section and page, with totals of section and document."""
    per_page = hits.groupBy("doc_id", "section", "page_index").agg(F.count("*").alias("hits"))
    return per_page.withColumns({
        "section_hits": F.sum("hits").over(Window.partitionBy("doc_id", "section")),
        "doc_hits": F.sum("hits").over(Window.partitionBy("doc_id")),
    })


def first_hits(hits: DataFrame, limit: int = FIRST_HITS) -> DataFrame:
    """Q8: each document's total and its first ``limit`` hits."""
    order = Window.partitionBy("doc_id").orderBy("page_index", "start")
    return hits.withColumn("n", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("n") <= limit)


def near_first(hits: DataFrame, focus: DataFrame, reach: int = PAGE_REACH) -> DataFrame:
    """Q9: hits ranked from the focus page: those within reach, then forward, then backward; is_first marks the initial one."""
    placed = hits.join(focus, "doc_id")
    ring = F.when(F.abs(F.col("page_index") - F.col("focus_page")) <= reach, 0).when(F.col("page_index") > F.col("focus_page"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(ring, "page_index", "start"))
    doc = Window.partitionBy("doc_id")
    place = F.struct("page_index", "start")
    ahead = F.min(F.when(F.col("page_index") >= F.col("focus_page"), place)).over(doc)
    initial = F.coalesce(ahead, F.max(place).over(doc))
    return placed.select("doc_id", "page_index", "start", rank.alias("rank"), (place == initial).alias("is_first"))


def filter_outline(outline: DataFrame, query: str) -> DataFrame:
    """Q10: nodes whose title has the query, with their ancestors; ``outline`` has path_nos (root to node)."""
    kept = outline.where(F.lower("title").contains(query.lower())).select("doc_id", F.explode("path_nos").alias("node_no")).distinct()
    return outline.join(kept, ["doc_id", "node_no"], "left_semi")


def filter_list(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Q11: rows where any of the columns contains the trimmed needle, whatever its case."""
    needle = needle.strip().lower()
    return rows.where(reduce(Column.__or__, [F.lower(F.col(c).cast("string")).contains(needle) for c in columns])) if needle else rows


def scanned_pages(pages: DataFrame) -> DataFrame:
    """Q12: pages, pages without text and their share for each document."""
    empty = F.coalesce(F.btrim("text", F.lit(" \t\n\r")), F.lit("")) == ""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(empty).alias("scans"), F.avg(empty.cast("double")).alias("scan_share"))
