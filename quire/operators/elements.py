"""Pages as streams of elements: headings, paragraphs and tables in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import layout as L

PAGE = L.PAGE
#: Shares of the page's usual size from which a text is a heading of the first and second level.
H1, H2 = 1.35, 1.18
#: A line of a table of contents: leaders or wide blanks before its page number.
CONTENTS_LINE = r"(?:\.\s*){3,}\s*[0-9ivxlc]+\s*$"


def merged_fragments(lines: DataFrame, gutter: DataFrame | None = None) -> DataFrame:
    """L4: lines whose parts on one row (less than 3 points apart, gaps of -3 to 25 points, no gutter between) are one line.

    ``lines`` has doc_id, page_index, line_no, text, x0, y0, x1, y1, size, bold; line_no of a merged
    line is that of its leftmost part.
    """
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")
    ahead = Window.unboundedPreceding
    lower = F.coalesce((F.col("y0") - F.lag("y0").over(down) >= 3).cast("int"), F.lit(0))
    rows = lines.where(F.btrim("text", F.lit(" \t")) != "").withColumn("lower", lower).withColumn("row", F.sum("lower").over(down.rowsBetween(ahead, 0)))
    if gutter is None:
        rows = rows.withColumn("gutters", F.array().cast("array<double>"))
    else:
        rows = rows.join(gutter.groupBy(*PAGE).agg(F.collect_set(F.col("gutter").cast("double")).alias("gutters")), PAGE, "left")
    across = Window.partitionBy(*PAGE, "row").orderBy("x0", "line_no")
    right = F.lag("x1").over(across)
    placed = rows.withColumn("right", right).withColumn("gap", F.col("x0") - F.col("right"))
    parted = F.coalesce(F.exists("gutters", lambda g: g.between(F.col("right"), F.col("x0"))), F.lit(False))
    fresh = F.coalesce((F.col("gap") < -3) | (F.col("gap") > 25) | parted, F.lit(True))
    numbered = placed.withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(across.rowsBetween(ahead, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "line_no", F.btrim("text", F.lit(" \t")).alias("t")))), lambda x: x["t"]), " ")
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return numbered.groupBy(*PAGE, "row", "part").agg(F.min_by("line_no", F.struct("x0", "line_no")).alias("line_no"), text.alias("text"), *edges, F.max("size").alias("size"), F.every("bold").alias("bold")).drop("row", "part")


def elements(lines: DataFrame, gutter: DataFrame, cells: DataFrame) -> DataFrame:
    """L4: doc_id, page_index, seq, kind (heading, list, paragraph or table), level, text, x0, y0, x1, y1.

    ``lines`` as for ``merged_fragments``; ``cells`` (doc_id, page_index, table_no, row, col, text,
    x0, y0, x1, y1) are the tables of the pages: lines with their centre in one are not text.  Rows
    of a table are joined by line ends, their cells that aren't empty by tabs.  Texts in columns are
    read column by column.  The usual size is the median over the page's characters.
    """
    boxes = cells.groupBy(*PAGE, "table_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    around = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    middle_x, middle_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    within = F.exists("boxes", lambda b: middle_x.between(b["x0"], b["x1"]) & middle_y.between(b["y0"], b["y1"]))
    free = lines.join(around, PAGE, "left").where(~F.coalesce(within, F.lit(False))).drop("boxes")
    usual = free.where("text != ''").groupBy(*PAGE).agg(F.percentile("size", 0.5, F.char_length("text")).alias("base"))
    ordered = L.reading_order(merged_fragments(free, gutter), gutter)
    numbered = L.numbered_paragraphs(ordered, [*PAGE, "col"])
    texts = F.transform(F.sort_array(F.collect_list(F.struct("y0", "line_no", F.btrim("text", F.lit(" \t")).alias("t")))), lambda x: x["t"])
    starts = F.max_by("marker", F.struct(-F.col("y0"), -F.col("line_no")))
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    grouped = numbered.groupBy(*PAGE, "col", "par_no").agg(starts.alias("marker"), texts.alias("t"), F.avg("size").alias("size"), F.every("bold").alias("bold"), F.count("*").alias("n"), F.min("reading_order").alias("at"), *edges).join(usual, PAGE)
    contents = F.exists("t", lambda t: t.rlike(CONTENTS_LINE))
    level = F.when(contents, None).when(F.col("size") >= H1 * F.col("base"), 1).when((F.col("size") >= H2 * F.col("base")) | (F.col("bold") & (F.col("n") <= 2)), 2)
    kind = F.when(level.isNotNull(), "heading").when(F.col("marker"), "list").otherwise("paragraph")
    text = grouped.select(*PAGE, F.col("at").cast("double").alias("at"), kind.alias("kind"), level.alias("level"), L.join_lines(F.col("t")).alias("text"), "x0", "y0", "x1", "y1")
    row = cells.where(F.btrim("text") != "").groupBy(*PAGE, "table_no", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.btrim("text").alias("t")))), lambda x: x["t"]), "\t").alias("t"))
    tables = row.groupBy(*PAGE, "table_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "t"))), lambda x: x["t"]), "\n").alias("text")).join(boxes, [*PAGE, "table_no"])
    # a table comes behind the last line that begins above it
    above = ordered.select(*PAGE, F.col("y0").alias("line_y"), "reading_order")
    after = tables.select(*PAGE, "table_no", "y0").join(above, PAGE).where("line_y <= y0").groupBy(*PAGE, "table_no").agg(F.max_by("reading_order", F.struct("line_y", "reading_order")).alias("at"))
    placed = tables.join(after, [*PAGE, "table_no"], "left").select(*PAGE, (F.coalesce("at", F.lit(0)) + 0.5).alias("at"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), "text", "x0", "y0", "x1", "y1")
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("at", "y0", "x0"))
    return text.unionByName(placed).withColumn("seq", seq).drop("at")


def layout_export(found: DataFrame, separators: bool = True) -> DataFrame:
    """doc_id, text: elements of each page with blank lines between, pages likewise; without their running lines if ``elements`` saw none.

    Separators head pages of documents with several; pages without elements are left out.
    """
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    pages = found.where(F.btrim("text") != "").groupBy(*PAGE).agg(body.alias("body"))
    listed = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_index", "body"))).alias("p"))
    head = lambda x: F.when(F.lit(separators) & (F.size("p") > 1), F.concat(F.lit("--- Page "), (x["page_index"] + 1).cast("string"), F.lit(" ---\n\n"))).otherwise("")
    return listed.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(head(x), x["body"])), "\n\n").alias("text"))
