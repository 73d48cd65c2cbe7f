"""Headings, outlines and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import saved

MOST_LINES, MOST_CHARS, LEVELS = 3, 160, 6
SECTION_REACH = 6.0
CAPTION = r"(?i)^(?:figure|fig\.|table|equation)\s*[0-9]"
CONTENTS_LINE = r"(?:\.\s?){4,}\s*[0-9ivxlcIVXLC]+\s*$|\t[0-9]+\s*$"
NUMBERED = r"^([0-9]+(?:\.[0-9]+)*)\.?\s"


def body_style(lines: DataFrame) -> DataFrame:
    """doc_id, body_size, body_bold: the style with most characters."""
    per_style = lines.groupBy("doc_id", "size", "bold").agg(F.sum(F.char_length("text")).alias("chars"))
    best = F.max_by(F.struct("size", "bold"), F.struct("chars", "size", "bold"))
    return per_style.groupBy("doc_id").agg(best.alias("b"), F.sum("chars").alias("doc_chars")).select("doc_id", F.col("b.size").alias("body_size"), F.col("b.bold").alias("body_bold"), "doc_chars")


def heading_rows(lines: DataFrame) -> DataFrame:
    """O1: accepted heading rows (doc_id, seq, page_index, top, size, bold, title).

    ``lines`` has doc_id, seq, page_index, top, text, size, bold.  Rows next to each other with
    one style are one candidate.
    """
    body = body_style(lines)
    order = Window.partitionBy("doc_id").orderBy("seq")
    fresh = (F.coalesce(F.lag("size").over(order) != F.col("size"), F.lit(True)) | (F.lag("bold").over(order) != F.col("bold")) | (F.lag("page_index").over(order) != F.col("page_index"))).cast("int")
    runs = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.btrim("text", F.lit(" \t\n\r")).alias("t")))), lambda x: x["t"]), " ")
    rows = runs.groupBy("doc_id", "run", "size", "bold", "page_index").agg(F.min("seq").alias("seq"), F.min("top").alias("top"), F.count("*").alias("rows"), title.alias("title"))
    styled = rows.join(body, "doc_id").where("size != body_size OR bold != body_bold")
    letters = F.char_length(F.regexp_replace("title", r"[^\p{L}]", ""))
    sentence = F.col("title").rlike(r"[a-z]{3,}[.!?]$") & (F.size(F.split("title", " ")) > 8)
    plain = (F.col("rows") <= MOST_LINES) & (F.char_length("title") <= MOST_CHARS) & (letters >= 2) & ~F.col("title").rlike(CONTENTS_LINE) & ~F.col("title").rlike(CAPTION) & ~sentence
    larger = F.col("size") > 1.12 * F.col("body_size")
    candidate = plain & (larger | F.col("bold") & (F.col("size") >= 0.92 * F.col("body_size")))
    marked = styled.withColumn("candidate", candidate)
    style = Window.partitionBy("doc_id", "size", "bold")
    judged = marked.withColumns({
        "style_chars": F.sum(F.char_length("title")).over(style),
        "style_average": F.avg(F.char_length("title")).over(style),
        "style_rows": F.count("*").over(style),
        "style_headings": F.count_if(F.col("candidate")).over(style),
        "pages": F.max("page_index").over(Window.partitionBy("doc_id")) + 1,
    })
    accepted = (F.col("style_chars") <= F.col("doc_chars") / 2) & (F.col("style_average") <= 90) & (F.col("style_rows") <= F.greatest(F.lit(8), 6 * F.col("pages"))) & (F.col("style_headings") >= 0.6 * F.col("style_rows"))
    return judged.where(F.col("candidate") & accepted).select("doc_id", "seq", "page_index", "top", "size", "bold", "title", (F.col("size") > 1.12 * F.col("body_size")).alias("strong"))


def heading_levels(rows: DataFrame) -> DataFrame:
    """O2: level of each heading: strong styles first, then by size, bold and first place; at most ``LEVELS``."""
    first = F.min("seq").over(Window.partitionBy("doc_id", "strong", "size", "bold"))
    depth = F.size(F.split(F.regexp_extract("title", NUMBERED, 1), r"\."))
    numbered = F.col("title").rlike(NUMBERED)
    style = Window.partitionBy("doc_id", "strong", "size", "bold")
    with_style = rows.withColumns({"first": first, "depth": F.when(numbered, depth).otherwise(0)})
    split = (F.count_if(F.col("depth") > 0).over(style) * 2 > F.count("*").over(style)) & (F.max("depth").over(style) > F.min(F.when(F.col("depth") > 0, F.col("depth"))).over(style))
    ranked = with_style.withColumn("by_depth", F.when(split, F.col("depth")).otherwise(0))
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("strong"), F.desc("size"), F.desc("bold"), "first", "by_depth"))
    return ranked.withColumn("level", F.least(level, F.lit(LEVELS))).select("doc_id", "seq", "page_index", "top", "title", "level")


def nested(headings: DataFrame) -> DataFrame:
    """Parent (seq of the nearest earlier heading of a lower level; null at the top)."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(before).alias(f"l{k}") for k in range(1, LEVELS)]
    seen = headings.select("*", *last)
    parent = F.greatest(*(F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, LEVELS)), F.lit(None).cast(headings.schema["seq"].dataType))
    return seen.withColumn("parent", parent).drop(*(f"l{k}" for k in range(1, LEVELS)))


def sections_of(places: DataFrame, outline: DataFrame) -> DataFrame:
    """O3: places with the section they lie in: the last entry that starts at or above them (as-of join).

    ``places`` has doc_id, place_no, page_index, y; ``outline`` doc_id, node_no, page_index, y
    (null: the page's top).  Places just above an entry's start belong to it.
    """
    of_places = places.select("doc_id", "page_index", (F.col("y") + SECTION_REACH).alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("node_no"), "place_no")
    of_nodes = outline.select("doc_id", "page_index", F.coalesce("y", F.lit(float("-inf"))).alias("y"), F.lit(0).alias("kind"), F.col("node_no").cast("long").alias("node_no"), F.lit(None).cast("long").alias("place_no"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "y", "kind", "node_no")
    held = of_places.unionByName(of_nodes).withColumn("section", F.last("node_no", ignorenulls=True).over(order))
    return held.where("kind = 1").select("doc_id", "place_no", "section")


def outline_paths(outline: DataFrame) -> DataFrame:
    """Nodes with depth and path (titles from the root) and path_nos; ``outline`` has node_no, parent_no, title.

    Any depth: every round joins each open path with the path that ends at the node above it, so
    paths double and log2(depth) rounds are enough.  A parent that is no node makes a root.  A path
    longer than its document has nodes runs in a cycle; such nodes, and those below them, stand
    alone.
    """
    sizes = outline.groupBy("doc_id").agg(F.count("*").alias("n"))
    state = outline.join(sizes, "doc_id").select("doc_id", "node_no", "title", F.col("parent_no").alias("above"), F.array("title").alias("path"), F.array("node_no").alias("path_nos"), F.lit(False).alias("cyclic"), "n")
    state = saved(state, "outline-paths")
    while state.where("above IS NOT NULL").limit(1).count():
        upper = state.select("doc_id", F.col("node_no").alias("above"), F.col("above").alias("next"), F.col("path").alias("up"), F.col("path_nos").alias("up_nos"), F.col("cyclic").alias("up_cyclic"))
        met = state.join(upper, ["doc_id", "above"], "left")
        cyclic = F.col("cyclic") | F.coalesce("up_cyclic", F.lit(False)) | (F.size("path") + F.coalesce(F.size("up"), F.lit(0)) > F.col("n"))
        found = F.col("up").isNotNull()
        longer = lambda up, own: F.when(found & ~cyclic, F.concat(up, own)).otherwise(F.col(own)).alias(own)
        state = saved(met.select("doc_id", "node_no", "title", F.when(found & ~cyclic, F.col("next")).alias("above"), longer("up", "path"), longer("up_nos", "path_nos"), cyclic.alias("cyclic"), "n"), "outline-paths")
    alone = F.col("cyclic")
    path, path_nos = F.when(alone, F.array("title")).otherwise(F.col("path")), F.when(alone, F.array("node_no")).otherwise(F.col("path_nos"))
    return state.select("doc_id", "node_no", "title", F.size(path).alias("depth"), path.alias("path"), path_nos.alias("path_nos"))


def subtree_counts(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each node with those of all below it; ``hits`` has doc_id, node_no, n."""
    spread = paths.join(hits, ["doc_id", "node_no"]).select("doc_id", F.explode("path_nos").alias("node_no"), "n")
    rolled = spread.groupBy("doc_id", "node_no").agg(F.sum("n").alias("n"))
    return paths.select("doc_id", "node_no", "depth").join(rolled, ["doc_id", "node_no"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def contents_entries(lines: DataFrame) -> DataFrame:
    """Title and page label of contents lines (leader dots or a tab before a number)."""
    pattern = r"^(.*?\S)\s*(?:(?:\.\s?){4,}|\t)\s*([0-9]+|[ivxlcIVXLC]+)\s*$"
    return lines.where(F.col("text").rlike(pattern)).select("doc_id", "page_index", "line_no", F.regexp_extract("text", pattern, 1).alias("title"), F.regexp_extract("text", pattern, 2).alias("label"))


def broken_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Contents entries whose label no page has."""
    return entries.join(labels.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")


def group_anchors(groups: DataFrame, anchors: DataFrame) -> DataFrame:
    """Saved places of the documents of each group, in group order; ``groups`` has name, paths."""
    return groups.select("name", F.posexplode("paths").alias("pos", "path")).join(anchors, "path")


def outline_agreement(outline: DataFrame, lines: DataFrame, bucket: float = 64.0) -> DataFrame:
    """Outline entries with the row they stand at and whether they are stale.

    A row agrees if its letters and digits and the title's begin with each other and it lies
    20 points above to 40 below the entry; the nearest counts.  The join is on buckets of y.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    entries = outline.select("doc_id", "node_no", "page_index", "y", plain("title").alias("t")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("y") - 20) / bucket), F.floor((F.col("y") + 40) / bucket))))
    rows = lines.select("doc_id", "page_index", "line_no", "y0", plain("text").alias("r")).withColumn("bucket", F.floor(F.col("y0") / bucket))
    near = entries.join(rows, ["doc_id", "page_index", "bucket"]).where("y0 >= y - 20 AND y0 <= y + 40 AND char_length(r) >= 3 AND char_length(t) >= 3 AND (startswith(r, t) OR startswith(t, r))")
    best = near.groupBy("doc_id", "node_no").agg(F.min_by("line_no", F.struct(F.abs(F.col("y0") - F.col("y")), "y0")).alias("heading_row"))
    return outline.select("doc_id", "node_no").join(best, ["doc_id", "node_no"], "left").withColumn("is_stale", F.col("heading_row").isNull())
