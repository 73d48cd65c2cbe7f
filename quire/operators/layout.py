"""Layout recovery over positioned lines: margin numbers, columns, running lines, paragraphs, tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_BAND, CLUSTER_GAP, LEAST_PAGES, LEAST_SHARE = 0.15, 1.8, 3, 0.4
PAGE = ["doc_id", "page_index"]


def margin_numbers(lines: DataFrame) -> DataFrame:
    """L1: lines with is_line_number.

    The body's left edge is the leftmost x that three lines with letters share within 2 points;
    plain numbers left of it are line numbers if most of them rise at a steady pitch.
    """
    page = Window.partitionBy(*PAGE)
    lettered = F.col("text").rlike(r"\p{L}")
    by_x = lines.where(lettered).withColumn("third", F.lead("x0", 2).over(page.orderBy("x0", "line_no")))
    left = by_x.where("third - x0 <= 2").groupBy(*PAGE).agg(F.min("x0").alias("body_left"))
    number = F.regexp_extract("text", r"^\s*([0-9]{1,4})\s*$", 1)
    candidates = lines.join(left, PAGE).where((number != "") & (F.col("x0") < F.col("body_left"))).withColumn("n", number.cast("int"))
    order = page.orderBy("y0", "line_no")
    steps = candidates.withColumns({"rise": (F.col("n") > F.lag("n").over(order)).cast("int"), "pitch": F.col("y0") - F.lag("y0").over(order)})
    judged = steps.groupBy(*PAGE).agg(F.avg("rise").alias("rising"), F.percentile("pitch", 0.5).alias("mid"), F.max("pitch").alias("most"), F.min("pitch").alias("least"))
    good = judged.where("rising >= 0.75 AND least >= 0.8 * mid AND most <= 1.2 * mid").select(*PAGE)
    hit = candidates.join(good, PAGE, "left_semi").select(*PAGE, "line_no", F.lit(True).alias("is_line_number"))
    return lines.join(hit, [*PAGE, "line_no"], "left").withColumn("is_line_number", F.coalesce("is_line_number", F.lit(False)))


def gutters(lines: DataFrame, page_width: float, step: int = 2) -> DataFrame:
    """L2: x of the column gutter of each page that has one.

    Every ``step`` points of the page's middle are tested; runs of passing places give one
    gutter where fewest lines cross, in the middle of equals.
    """
    low, high = int(page_width * 0.15), int(page_width * 0.85)
    last = (high - low) // step
    # a line is left of the tested places from ``k`` on, or right of those up to ``k``
    after = F.greatest(F.ceil((F.col("x1") - low) / step), F.lit(0)).cast("int")
    until = F.least(F.floor((F.col("x0") - low) / step), F.lit(last)).cast("int")
    edges = lines.select(*PAGE, F.explode(F.array(F.struct(after.alias("k"), F.lit(0).alias("side")), F.struct(until.alias("k"), F.lit(1).alias("side")))).alias("e"), "y0", "y1")
    edges = edges.select(*PAGE, "e.k", "e.side", "y0", "y1")
    side = lambda n, f, c: f(F.when(F.col("side") == n, F.col(c)))
    counted = edges.groupBy(*PAGE, "k").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"), side(0, F.min, "y0").alias("ly0"), side(0, F.max, "y1").alias("ly1"), side(1, F.min, "y0").alias("ry0"), side(1, F.max, "y1").alias("ry1"))
    pages = lines.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 10")
    places = pages.select(*PAGE, "n", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("k"))
    up = Window.partitionBy(*PAGE).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*PAGE).orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    # edges beyond the tested places count at all of them or none
    met = counted.join(pages, PAGE, "left_semi").join(places, [*PAGE, "k"], "full")
    per_x = met.select(*PAGE, "k", "n", F.coalesce(F.sum("l").over(up), F.lit(0)).alias("l"), F.coalesce(F.sum("r").over(down), F.lit(0)).alias("r"), F.min("ly0").over(up).alias("ly0"), F.max("ly1").over(up).alias("ly1"), F.min("ry0").over(down).alias("ry0"), F.max("ry1").over(down).alias("ry1"))
    per_x = per_x.where("n IS NOT NULL").withColumns({"x": F.col("k") * step + low, "crossing": F.col("n") - F.col("l") - F.col("r")})
    overlap = F.least("ly1", "ry1") - F.greatest("ly0", "ry0")
    shorter = F.least(F.col("ly1") - F.col("ly0"), F.col("ry1") - F.col("ry0"))
    passing = per_x.where((F.col("l") >= 5) & (F.col("r") >= 5) & (F.col("crossing") <= F.greatest(F.lit(2.0), F.col("n") / 8)) & (overlap >= shorter / 2))
    order = Window.partitionBy(*PAGE).orderBy("x")
    runs = passing.withColumn("fresh", (F.coalesce(F.col("x") - F.lag("x").over(order), F.lit(99)) > step).cast("int")).withColumn("run", F.sum("fresh").over(order))
    fewest = runs.withColumn("least", F.min("crossing").over(Window.partitionBy(*PAGE, "run"))).where("crossing = least")
    return fewest.groupBy(*PAGE, "run").agg(F.percentile("x", 0.5).alias("gutter")).drop("run")


def reading_order(lines: DataFrame, gutter: DataFrame) -> DataFrame:
    """L2: lines with reading_order: lines across the gutter split bands; columns left to right, then rows."""
    first = gutter.groupBy(*PAGE).agg(F.min("gutter").alias("gutter"))
    sided = lines.join(first, PAGE, "left")
    across = F.col("gutter").isNull() | ((F.col("x0") < F.col("gutter")) & (F.col("x1") > F.col("gutter")))
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    banded = sided.withColumn("across", across.cast("int")).withColumn("crossed", F.sum("across").over(down))
    band = F.col("crossed") * 2 - F.col("across")  # a crossing line is a band of its own
    column = F.when(F.col("across") == 1, 0).when(F.col("x1") <= F.col("gutter"), 0).otherwise(1)
    placed = banded.withColumns({"band": band, "col": column, "row": F.floor(F.col("y0") / 3)})
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "col", "row", "x0", "line_no"))
    return placed.withColumn("reading_order", order).drop("across", "crossed", "band", "row", "gutter")


def running_lines(lines: DataFrame, page_height: float) -> DataFrame:
    """L3: lines with is_running: header and footer lines that recur over a document's pages.

    Candidates lie in a cluster at the top or bottom edge.  Their key is the text with numbers
    masked and the height in steps of 4 points; it runs if it is on at least three pages and
    on 40 % of the odd or of the even pages.
    """
    height = F.col("y1") - F.col("y0")
    down, up = Window.partitionBy(*PAGE).orderBy("y0", "line_no"), Window.partitionBy(*PAGE).orderBy(F.desc("y0"), F.desc("line_no"))
    before = Window.unboundedPreceding
    far_top = F.coalesce(F.col("y0") - F.lag("y1").over(down), F.lit(0.0)) > CLUSTER_GAP * height
    far_bottom = F.coalesce(F.lag("y0").over(up) - F.col("y1"), F.lit(0.0)) > CLUSTER_GAP * height
    gaps = lines.withColumns({"gap_top": far_top.cast("int"), "gap_bottom": far_bottom.cast("int")})
    edged = gaps.withColumns({"cut_top": F.sum("gap_top").over(down.rowsBetween(before, 0)), "cut_bottom": F.sum("gap_bottom").over(up.rowsBetween(before, 0))})
    at_top = (F.col("cut_top") == 0) & (F.col("y1") <= page_height * EDGE_BAND)
    at_bottom = (F.col("cut_bottom") == 0) & (F.col("y0") >= page_height * (1 - EDGE_BAND))
    key = F.concat_ws("|", F.lower(F.regexp_replace(F.btrim("text", F.lit(" \t")), "[0-9]+", "#")), F.floor(F.col("y0") / 4).cast("string"))
    keyed = edged.withColumn("key", F.when(at_top | at_bottom, key))
    pages = lines.groupBy("doc_id").agg(F.max("page_index").alias("last"))
    odd, even = F.expr("(last + 1) div 2"), F.expr("(last + 2) div 2")
    on = lambda parity: F.count_distinct(F.when(F.col("page_index") % 2 == parity, F.col("page_index")))
    per_key = keyed.where("key IS NOT NULL AND key NOT LIKE '|%'").groupBy("doc_id", "key").agg(on(1).alias("odd_pages"), on(0).alias("even_pages")).join(pages, "doc_id")
    share = (F.col("odd_pages") >= F.greatest(F.ceil(odd * LEAST_SHARE), F.lit(1))) | (F.col("even_pages") >= F.greatest(F.ceil(even * LEAST_SHARE), F.lit(1)))
    running = per_key.where((F.col("odd_pages") + F.col("even_pages") >= LEAST_PAGES) & share).select("doc_id", "key", F.lit(True).alias("is_running"))
    return keyed.join(running, ["doc_id", "key"], "left").withColumn("is_running", F.coalesce("is_running", F.lit(False))).drop("key", "gap_top", "gap_bottom", "cut_top", "cut_bottom")


def join_lines(texts: Column) -> Column:
    """Lines as one text: a hyphen between letters at a line's end goes, other ends become a space."""
    return F.aggregate(F.slice(texts, 2, F.size(texts)), texts[0], lambda acc, t: F.when(acc.rlike(r"\p{L}-$") & t.rlike(r"^\p{Ll}"), F.concat(F.substring(acc, F.lit(1), F.char_length(acc) - 1), t)).otherwise(F.concat(acc, F.lit(" "), t)))


def paragraphs(lines: DataFrame) -> DataFrame:
    """L4: doc_id, page_index, par_no, kind, text, first_line, lines.

    A paragraph ends where the pitch leaves 0.7 to 1.45 times the page's usual one, the size
    changes, a list marker starts, or a sentence ends on a short line before a capital.
    """
    texts = F.transform(F.sort_array(F.collect_list(F.struct("y0", "line_no", F.btrim("text", F.lit(" \t")).alias("t")))), lambda x: x["t"])
    kind = F.when(F.max_by("marker", F.struct(-F.col("y0"), -F.col("line_no"))), "list").otherwise("paragraph")
    return numbered_paragraphs(lines, PAGE).groupBy(*PAGE, "par_no").agg(kind.alias("kind"), texts.alias("t"), F.min("line_no").alias("first_line"), F.count("*").alias("lines")).select(*PAGE, "par_no", "kind", join_lines(F.col("t")).alias("text"), "first_line", "lines")


def numbered_paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """L4: the lines that aren't blank with size, marker (starts a list item) and par_no, counted in each of ``keys``."""
    page = Window.partitionBy(*keys)
    order = page.orderBy("y0", "line_no")
    size = F.col("size") if "size" in lines.columns else F.lit(10.0)
    stepped = lines.where(F.btrim("text", F.lit(" \t")) != "").withColumn("size", size)
    stepped = stepped.withColumns({"pitch": F.col("y0") - F.lag("y0").over(order), "before": F.lag("text").over(order), "size_before": F.lag("size").over(order), "right_before": F.lag("x1").over(order)})
    halves = F.round(F.col("pitch") * 2) / 2
    usual = stepped.where("pitch BETWEEN 6 AND 35").groupBy(*keys).agg(F.mode(halves, True).alias("usual"))
    wide = F.max(F.col("x1")).over(page)
    joined = stepped.withColumn("page_right", wide).join(usual, keys, "left")
    marker = F.col("text").rlike(r"^\s*(?:[-•*]|\(?[0-9a-z]{1,3}[.)])\s+\S")
    short_end = F.col("before").rlike(r"[.!?:]\s*$") & (F.col("right_before") <= F.col("page_right") * 0.85) & F.col("text").rlike(r"^\s*\p{Lu}")
    fresh = F.col("pitch").isNull() | (F.col("pitch") < 0.7 * F.col("usual")) | (F.col("pitch") > 1.45 * F.col("usual")) | (F.abs(F.col("size") - F.col("size_before")) > 1) | marker | short_end
    return joined.withColumns({"marker": marker, "fresh": F.coalesce(fresh, F.lit(False)).cast("int")}).withColumn("par_no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def borderless_tables(pieces: DataFrame, gutter: DataFrame | None = None) -> DataFrame:
    """Cells of tables without rules: doc_id, page_index, table_no, row_no, col_no, text.

    ``pieces`` (doc_id, page_index, row, col, x0, x1, y0, y1, text) are the parts of each row
    between wide gaps.  At least three rows next to each other with the same number (two or
    more) of short cells, close together and with every column aligned left, right or in the
    middle, are a table.  With the page's ``gutter`` (see ``gutters``), long cells whose columns all
    part at a gutter are columns of text, no table.
    """
    rows = pieces.groupBy(*PAGE, "row").agg(F.count("*").alias("cols"), F.avg(F.char_length("text")).alias("chars"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    order = Window.partitionBy(*PAGE).orderBy("y0", "row")
    gap = F.col("y0") - F.lag("y1").over(order)
    good = (F.col("cols") >= 2) & (F.col("chars") < 50)
    fresh = F.coalesce((F.col("cols") != F.lag("cols").over(order)) | ~F.lag(good).over(order) | (gap < -3) | (gap > 18), F.lit(True)) | ~good
    runs = rows.withColumns({"good": good, "fresh": fresh.cast("int")}).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("good")
    long = runs.withColumn("height", F.count("*").over(Window.partitionBy(*PAGE, "run"))).where("height >= 3").select(*PAGE, "row", "run", "cols")
    cells = pieces.join(long, [*PAGE, "row"])
    spread = lambda c: F.max(c) - F.min(c)
    aligned = cells.groupBy(*PAGE, "run", "col").agg(F.least(spread("x0"), spread("x1"), spread((F.col("x0") + F.col("x1")) / 2)).alias("off"))
    tables = aligned.groupBy(*PAGE, "run").agg(F.max("off").alias("off")).where("off <= 10").select(*PAGE, "run")
    if gutter is not None:
        tables = tables.join(_text_columns(cells, gutter), [*PAGE, "run"], "left_anti")
    kept = cells.join(tables, [*PAGE, "run"], "left_semi")
    return kept.select(*PAGE, F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("run")).alias("table_no"), F.dense_rank().over(Window.partitionBy(*PAGE, "run").orderBy("y0", "row")).alias("row_no"), F.col("col").alias("col_no"), "text")


def _text_columns(cells: DataFrame, gutter: DataFrame) -> DataFrame:
    """Pages and runs of rows with cells of 15 characters or more on average and a gutter in every break between columns."""
    sides = cells.groupBy(*PAGE, "run", "col").agg(F.max("x1").alias("right"), F.min("x0").alias("left"), F.sum(F.char_length("text")).alias("chars"), F.count("*").alias("n"))
    breaks = sides.withColumn("next_left", F.lead("left").over(Window.partitionBy(*PAGE, "run").orderBy("col")))
    found = gutter.groupBy(*PAGE).agg(F.collect_set("gutter").alias("gutters"))
    parted = F.col("next_left").isNull() | F.exists("gutters", lambda g: g.between(F.col("right"), F.col("next_left")))
    return breaks.join(found, PAGE).groupBy(*PAGE, "run").agg(F.every(parted).alias("parted"), (F.sum("chars") / F.sum("n")).alias("mean")).where("parted AND mean >= 15").select(*PAGE, "run")


def row_pieces(chars: DataFrame) -> DataFrame:
    """Pieces of rows for ``borderless_tables`` from characters (doc_id, page_index, line_no, char_no, ch, x0, x1, y0, y1, size).

    A line is cut at gaps of 18 points and of twice the size; blanks only part words.  Pieces less
    than 3 points below the one before are in its row.
    """
    order = Window.partitionBy(*PAGE, "line_no").orderBy("char_no")
    shown = chars.where(F.btrim("ch", F.lit(" \t")) != "")
    gap = F.col("x0") - F.lag("x1").over(order)
    parted = shown.withColumns({"gap": gap, "blank": (gap > 0.22 * F.col("size")) | (F.col("char_no") - F.lag("char_no").over(order) > 1)})
    fresh = F.coalesce(F.col("gap") >= F.greatest(F.lit(18.0), 2 * F.col("size")), F.lit(True))
    lettered = parted.withColumns({"fresh": fresh.cast("int"), "piece": F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "ch": F.when(~fresh & F.coalesce("blank", F.lit(False)), F.concat(F.lit(" "), "ch")).otherwise(F.col("ch"))})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("char_no", "ch"))), lambda x: x["ch"]), "")
    pieces = lettered.groupBy(*PAGE, "line_no", "piece").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    down = Window.partitionBy(*PAGE).orderBy("y0", "line_no", "piece")
    lower = F.coalesce((F.col("y0") - F.lag("y0").over(down) >= 3).cast("int"), F.lit(0))
    rows = pieces.withColumn("lower", lower).withColumn("row", F.sum("lower").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*PAGE, "row", (F.row_number().over(Window.partitionBy(*PAGE, "row").orderBy("x0", "line_no")) - 1).alias("col"), "x0", "x1", "y0", "y1", "text")


def stitched_tables(tables: DataFrame) -> DataFrame:
    """Tables with the chain they belong to; one that goes on from the page before is in its chain.

    ``tables`` has doc_id, page_index, table_no, cols, width, header, heading, is_first, is_last
    (of the page).
    """
    order = Window.partitionBy("doc_id").orderBy("page_index", "table_no")
    same = (F.lag("cols").over(order) == F.col("cols")) & (F.abs(F.lag("width").over(order) - F.col("width")) < 15)
    follows = F.col("is_first") & F.lag("is_last").over(order) & (F.lag("page_index").over(order) == F.col("page_index") - 1)
    said = F.coalesce("heading", F.lit("")).rlike(r"(?i)(?<!dis)\bcontinued\b")
    repeated = F.lag("header").over(order) == F.col("header")
    goes_on = F.coalesce(follows & same & (said | repeated), F.lit(False))
    marked = tables.withColumns({"goes_on": goes_on, "drop_header": goes_on & F.coalesce(repeated, F.lit(False))})
    return marked.withColumn("chain", F.sum((~F.col("goes_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


LINE = [*PAGE, "line_no"]


def style_runs(chars: DataFrame) -> DataFrame:
    """``line_style_runs`` of characters that come a row each (doc_id, page_index, line_no, char_no, ch, x0, x1, size, bold)."""
    each = F.sort_array(F.collect_list(F.struct("char_no", "ch", "x0", "x1", "size", "bold")))
    return line_style_runs(chars.groupBy(*LINE).agg(each.alias("chars")))


def line_style_runs(lines: DataFrame) -> DataFrame:
    """Maximal runs of one style on a line, with spaces where the gap is wide: run_no, text, size, bold by line.

    ``lines`` has doc_id, page_index, line_no and chars, an array of the line's characters (ch, x0,
    x1, size, bold) in order, so nothing is shuffled or sorted.
    """

    def runs(batches):
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch["chars"]), 0).to_numpy(zero_copy_only=False)
            chars = batch["chars"].flatten()
            if not len(chars):
                continue
            line = np.repeat(np.arange(len(n)), n)
            x0, x1, size = (chars.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "size"))
            bold = chars.field("bold").cast("uint8").to_numpy(zero_copy_only=False).astype(float)  # null: nan
            goes_on = np.zeros(len(line), bool)
            goes_on[1:] = (line[1:] == line[:-1]) & (np.abs(size[1:] - size[:-1]) <= 0.2) & (bold[1:] == bold[:-1])
            wide = np.zeros(len(line), bool)
            wide[1:] = (line[1:] == line[:-1]) & (x0[1:] - x1[:-1] > 0.22 * size[1:])
            ch = pc.fill_null(chars.field("ch"), "")
            shown = pc.if_else(pa.array(wide), pc.binary_join_element_wise(" ", ch, ""), ch)
            first = np.flatnonzero(~goes_on)
            text = pc.binary_join(pa.LargeListArray.from_arrays(np.append(first, len(line)), shown), "")
            number = np.arange(len(first)) - np.searchsorted(line[first], line[first]) + 1
            weight = np.fmin.reduceat(bold, first)
            keys = [batch[c].take(pa.array(line[first])) for c in LINE]
            columns = [*keys, pa.array(number), text, pa.array(np.fmin.reduceat(size, first), from_pandas=True), pa.array(weight > 0, mask=np.isnan(weight))]
            yield pa.RecordBatch.from_arrays(columns, [*LINE, "run_no", "text", "size", "bold"])

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in LINE)
    return lines.select(*LINE, "chars").mapInArrow(runs, f"{kinds}, run_no long, text string, size double, bold boolean")


def line_strokes(lines: DataFrame, strokes: DataFrame, bucket: float = 16.0) -> DataFrame:
    """Lines (``LINE``, baseline, tallest character, any more columns) with the strokes near their baseline or middle, an array."""
    thin = strokes.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("sy") - 16) / bucket), F.floor((F.col("sy") + 16) / bucket))))
    near = lines.select(*LINE, "baseline", "tallest", F.floor(F.col("baseline") / bucket).alias("bucket")).join(thin.select(*PAGE, "bucket", "sx0", "sx1", "sy", "thickness"), [*PAGE, "bucket"])
    near = near.where(F.abs(F.col("sy") - F.col("baseline")) <= F.greatest(F.lit(1.0), 0.45 * F.col("tallest"))).select(*LINE, "baseline", "sx0", "sx1", "sy", "thickness")
    per_line = near.groupBy(*LINE, "baseline").agg(F.collect_set(F.struct("sx0", "sx1", "sy", "thickness")).alias("strokes"))
    return lines.join(per_line, [*LINE, "baseline"], "left")


def stroke_flags(chars: DataFrame) -> DataFrame:
    """Characters of ``line_strokes`` with underline and strike instead of the strokes."""
    size, base = F.col("size"), F.col("baseline")
    meets = lambda s: (s["thickness"] <= F.greatest(F.lit(2.5), 0.15 * size)) & (F.col("x0") >= s["sx0"] - 1) & (F.col("x1") <= s["sx1"] + 1)
    under = F.exists("strokes", lambda s: meets(s) & s["sy"].between(base - 1, base + 0.3 * size))
    through = F.exists("strokes", lambda s: meets(s) & s["sy"].between(base - 0.45 * size, base - 0.15 * size))
    return chars.withColumns({"underline": F.coalesce(under, F.lit(False)), "strike": F.coalesce(through, F.lit(False))}).drop("strokes")


def stroked_chars(chars: DataFrame, strokes: DataFrame, bucket: float = 16.0) -> DataFrame:
    """Characters with underline and strike flags from thin strokes near their baseline or middle.

    Strokes first meet the baselines of lines, then the characters of these lines.
    """
    lines = chars.groupBy(*LINE, "baseline").agg(F.max("size").alias("tallest"))
    return stroke_flags(chars.join(line_strokes(lines, strokes, bucket).drop("tallest"), [*LINE, "baseline"], "left"))


#: Ruled tables: strokes are this thin and long, touch within TOUCH, edges closer than EDGE are one; drawings have more columns or cells.
THIN, LONG, BOX, TOUCH, SQUARE, EDGE = 3.5, 12.0, 15.0, 3.5, 32.0, 2.5
MOST_COLUMNS, MOST_CELLS = 40, 4000


def strokes_of(shapes: DataFrame) -> DataFrame:
    """Strokes (doc_id, page_index, stroke, level, x0, y0, x1, y1) of shapes: thin ones themselves, the four sides of stroked boxes.

    ``shapes`` has doc_id, page_index, shape_no, x0, y0, x1, y1, stroked.
    """
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    side = lambda level, a, b, c, d: F.struct(F.lit(level).alias("level"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    mid_x, mid_y = (x0 + x1) / 2, (y0 + y1) / 2
    flat = F.when((height <= THIN) & (width >= LONG), F.array(side(True, x0, mid_y, x1, mid_y)))
    sides = flat.when((width <= THIN) & (height >= LONG), F.array(side(False, mid_x, y0, mid_x, y1)))
    sides = sides.when(F.col("stroked") & (width >= BOX) & (height >= BOX), F.array(side(True, x0, y0, x1, y0), side(True, x0, y1, x1, y1), side(False, x0, y0, x0, y1), side(False, x1, y0, x1, y1)))
    each = shapes.where((width > 0) & (height > 0)).select(*PAGE, "shape_no", F.posexplode(sides).alias("k", "s"))
    return each.select(*PAGE, F.xxhash64(*PAGE, "shape_no", "k").alias("stroke"), "s.*")


def stroke_groups(stroke: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[int | None]:
    """For every stroke of a page the smallest number of those it is linked with; none if it touches no other."""
    squares: dict[tuple[int, int], list[int]] = {}
    low, high = (np.floor(np.stack(c) / SQUARE).astype(np.int64).T.tolist() for c in ((x0, y0), (x1, y1)))
    for k, ((left, top), (right, bottom)) in enumerate(zip(low, high, strict=True)):
        for bx in range(left, right + 1):
            for by in range(top, bottom + 1):
                squares.setdefault((bx, by), []).append(k)
    up, met = list(range(len(stroke))), [False] * len(stroke)

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    low, high = (np.floor(np.stack(c) / SQUARE).astype(np.int64).T.tolist() for c in ((x0 - TOUCH, y0 - TOUCH), (x1 + TOUCH, y1 + TOUCH)))
    x0, y0, x1, y1 = (c.tolist() for c in (x0, y0, x1, y1))
    for k, ((left, top), (right, bottom)) in enumerate(zip(low, high, strict=True)):
        for bx in range(left, right + 1):
            for by in range(top, bottom + 1):
                for m in squares.get((bx, by), ()):
                    if m != k and x0[k] - TOUCH <= x1[m] and x1[k] + TOUCH >= x0[m] and y0[k] - TOUCH <= y1[m] and y1[k] + TOUCH >= y0[m]:
                        met[k] = met[m] = True
                        up[root(k)] = root(m)
    least: dict[int, int] = {}
    for k, number in enumerate(stroke.tolist()):
        least[root(k)] = min(number, least.get(root(k), number))
    return [least[root(k)] if met[k] else None for k in range(len(stroke))]


def page_groups(pages: Iterable[tuple[np.ndarray, ...]]) -> list[list[int | None]]:
    """``stroke_groups`` of many pages; those with equal strokes are grouped once."""
    known: dict[tuple[bytes, ...], list[int | None]] = {}
    out = []
    for stroke, *corners in pages:
        order = np.lexsort(corners)
        key = tuple(c[order].tobytes() for c in corners)
        if key not in known:
            known[key] = stroke_groups(np.arange(len(stroke)), *(c[order] for c in corners))
        numbers, least = stroke[order].tolist(), {}
        for group, number in zip(known[key], numbers, strict=True):
            least[group] = min(number, least.get(group, number))
        own: list[int | None] = [None] * len(numbers)
        for k, group in zip(order.tolist(), known[key], strict=True):
            own[k] = None if group is None else least[group]
        out.append(own)
    return out


def touching(strokes: DataFrame) -> DataFrame:
    """Strokes that touch others, with grid, the smallest number of those they are linked with on their page.

    A page is one row, and only numbers and boxes go to Python, many pages in a batch.
    """

    @F.pandas_udf("array<long>")
    def grids(stroke: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series(page_groups(zip(stroke, x0, y0, x1, y1, strict=True)), dtype=object)

    pages = strokes.groupBy(*PAGE).agg(F.collect_list(F.struct("stroke", "level", "x0", "y0", "x1", "y1")).alias("page"))
    each = pages.withColumn("grid", grids(*(F.col(f"page.{c}") for c in ("stroke", "x0", "y0", "x1", "y1")))).select(*PAGE, F.explode(F.arrays_zip("page", "grid")).alias("s"))
    return each.select(*PAGE, "s.page.*", "s.grid").where("grid IS NOT NULL")


def ruled_tables(shapes: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page_index, table_no, row, col, text of tables drawn with lines.

    Strokes that touch meet in squares of their page (``touching``); groups of them with two levels and two
    uprights at least make a grid.  Lines of text lie in the cell of their centre; a grid needs
    two of them, and rows without text are left out.
    """
    grouped = touching(strokes_of(shapes))

    grid = [*PAGE, "grid"]
    at = F.when(F.col("level"), F.col("y0")).otherwise(F.col("x0"))
    placed = grouped.withColumn("at", at)
    order = Window.partitionBy(*grid, "level").orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) > EDGE, F.lit(True)).cast("int")
    edges = placed.withColumn("fresh", fresh).withColumn("edge", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).groupBy(*grid, "level", "edge").agg(F.avg("at").alias("at"), F.count("*").alias("n"))
    sides = edges.groupBy(*grid).agg(F.sort_array(F.collect_list(F.when(F.col("level"), F.col("at")))).alias("ys"), F.sort_array(F.collect_list(F.when(~F.col("level"), F.col("at")))).alias("xs"), F.sum(F.when(F.col("level"), F.col("n"))).alias("levels"), F.sum(F.when(~F.col("level"), F.col("n"))).alias("uprights"))
    rows, cols = F.size("ys") - 1, F.size("xs") - 1
    grids = sides.where((F.col("levels") >= 2) & (F.col("uprights") >= 2) & (rows >= 1) & (cols >= 1) & (cols <= MOST_COLUMNS) & (rows * cols <= MOST_CELLS))
    centre_x, centre_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    cell = lambda edges, c: F.size(F.filter(edges, lambda e: e <= c)) - 1
    inside = lines.join(grids, PAGE).withColumns({"row": cell(F.col("ys"), centre_y), "col": cell(F.col("xs"), centre_x)}).where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    counted = inside.withColumn("texts", F.count("*").over(Window.partitionBy(*grid))).where("texts >= 2")
    cells = counted.groupBy(*grid, "row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ").alias("text"), F.min(F.struct("ys", "xs")).alias("top"))
    first = Window.partitionBy(*grid)
    named = cells.withColumn("corner", F.min(F.struct(F.col("top.ys")[0], F.col("top.xs")[0])).over(first))
    return named.select(*PAGE, F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("corner", "grid")).alias("table_no"), F.dense_rank().over(Window.partitionBy(*grid).orderBy("row")).alias("row"), F.col("col").cast("int").alias("col"), "text")


def upright_lines(lines: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Recognised lines turned about the page's centre by the slant of its middle line: x0, y0, x1, y1, angle.

    ``lines`` has the corners ulx, uly, urx, ury, llx, lly, lrx, lry.  Lines of four characters
    or more say how the page is turned, if there are any; below 0.0005 it is straight.
    """
    slant = F.atan2(F.col("ury") - F.col("uly"), F.col("urx") - F.col("ulx"))
    long = F.char_length("text") >= 4
    angles = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.when(long, slant))).alias("long"), F.sort_array(F.collect_list(slant)).alias("every"))
    some = F.when(F.size("long") > 0, F.col("long")).otherwise(F.col("every"))
    middle = F.element_at(some, (F.floor(F.size(some) / 2) + 1).cast("int"))
    turned = lines.join(angles.select(*PAGE, F.when(F.abs(middle) > 0.0005, middle).otherwise(0.0).alias("angle")), PAGE)
    cx, cy, cos, sin = page_width / 2, page_height / 2, F.cos("angle"), F.sin("angle")
    xs = [cos * (F.col(c + "x") - cx) + sin * (F.col(c + "y") - cy) + cx for c in ("ul", "ur", "ll", "lr")]
    ys = [cos * (F.col(c + "y") - cy) - sin * (F.col(c + "x") - cx) + cy for c in ("ul", "ur", "ll", "lr")]
    return turned.select(*PAGE, "line_no", "text", F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), "angle")


def block_numbers(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[int]:
    """Blocks of a page's lines, which come from the top down."""
    last: list[tuple[float, float, float]] = []  # x0, x1, y1 of the last line of each block
    number = []
    for left, top, right, low in zip(x0.tolist(), y0.tolist(), x1.tolist(), y1.tolist(), strict=True):
        for k in range(len(last) - 1, -1, -1):
            a, b, bottom = last[k]
            narrow, wide = sorted((right - left, b - a))
            if abs(top - bottom) <= low - top and min(right, b) - max(left, a) >= 0.5 * narrow and narrow >= 0.6 * wide:
                last[k] = (left, right, low)
                break
        else:
            k = len(last)
            last.append((left, right, low))
        number.append(k)
    return number


def line_blocks(lines: DataFrame) -> DataFrame:
    """Upright lines with block_no: a line goes on a block whose last line is close, half under it and about as wide.

    A page is one row, and only its boxes go to Python, many pages in a batch.
    """

    @F.pandas_udf("array<long>")
    def numbered(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([block_numbers(*page) for page in zip(x0, y0, x1, y1, strict=True)], dtype=object)

    order = ["y0", "x0", "line_no"]
    rest = [c for c in lines.columns if c not in PAGE + order]
    pages = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("page"))
    boxes = numbered(*(F.col(f"page.{c}").cast("array<double>") for c in ("x0", "y0", "x1", "y1")))
    each = pages.withColumn("number", boxes).select(*PAGE, F.explode(F.arrays_zip("page", "number")).alias("l"))
    return each.select(*(F.col(c if c in PAGE else f"l.page.{c}") for c in lines.columns), F.col("l.number").alias("block_no"))
