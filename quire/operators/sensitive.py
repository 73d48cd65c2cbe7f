"""Sensitive data: preset scans, roll-ups, redaction and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.matches import matches, search_pattern
from quire.operators.review import MOST_JUMPS
from quire.sources.shared import saved

#: The formats that are found, in any case; matches needn't be whole words.
PRESETS = {
    "ssn": r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b",
    "card": r"\b\d(?:[- ]?\d){12,18}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:\+\d{1,3}[-.\s]?)?(?:\(?\d{1,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}\b",
    "date": r"\b(?:\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}|\d{4}[-/\.]\d{1,2}[-/\.]\d{1,2}|\d{1,2}[-\s](?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)[-\s]\d{2,4})\b",
}
#: Characters that a preset's match can't follow.
NOT_AFTER = {"phone": r"\w+"}
MASK = "█"


def presets_with(phrases: list[str] = (), patterns: list[str] = ()) -> dict[str, str]:
    """The presets, and custom phrases (by smart search) and patterns."""
    out = dict(PRESETS)
    out |= {f"phrase:{p}": search_pattern(p, match_case=True) for p in phrases}
    out |= {f"regex:{p}": p for p in patterns}
    return out


def _named(name: str):
    return lambda m: F.struct(F.lit(name).alias("preset"), m["start"].alias("start"), m["len"].alias("len"), m["matched"].alias("matched"))


def scan(pages: DataFrame, presets: dict[str, str] | None = None) -> DataFrame:
    """doc_id, page_index, preset, start, len, matched.  One scan serves all presets."""
    each = []
    for name, pattern in (presets or PRESETS).items():
        if name in NOT_AFTER:
            pattern = f"(?<![{NOT_AFTER[name]}]){pattern}"
        each.append(F.transform(matches(F.col("text"), "(?i)" + pattern), _named(name)))
    return pages.select("doc_id", "page_index", F.explode(F.concat(*each)).alias("f")).select("doc_id", "page_index", "f.*")


def rollup(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """R2: findings and affected documents for each preset, language and source."""
    return findings.join(docs.select("doc_id", "lang", "source"), "doc_id").groupBy("preset", "lang", "source").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("docs"))


def top_documents(findings: DataFrame, limit: int = 5) -> DataFrame:
    """R2: the documents with most findings of each preset."""
    counted = findings.groupBy("preset", "doc_id").agg(F.count("*").alias("findings"))
    rank = F.row_number().over(Window.partitionBy("preset").orderBy(F.desc("findings"), "doc_id"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit)


def spans(findings: DataFrame) -> DataFrame:
    """Findings of a page merged where they overlap or touch: doc_id, page_index, start, stop."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("start", "len")
    stop = F.col("start") + F.col("len")
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = findings.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "page_index", "island").agg(F.min("start").alias("start"), F.max(stop).alias("stop")).drop("island")


def redact(pages: DataFrame, findings: DataFrame, remove: bool = False) -> DataFrame:
    """Pages with the findings masked (or removed); redacted says whether a page had any."""
    per_page = spans(findings).groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    joined = pages.join(per_page, ["doc_id", "page_index"], "left")
    text = F.col("text")
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    mask = (lambda n: F.lit("")) if remove else (lambda n: F.repeat(F.lit(MASK), n))

    def step(acc, cut):
        between = F.substring(text, acc["at"] + 1, cut["start"] - acc["at"])
        return F.struct(cut["stop"].alias("at"), F.concat(acc["out"], between, mask(cut["stop"] - cut["start"])).alias("out"))

    done = F.aggregate("cuts", empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return joined.select("doc_id", "page_index", F.when(F.col("cuts").isNull(), text).otherwise(done).alias("text"), F.col("cuts").isNotNull().alias("redacted"))


def remaining(findings: DataFrame, applied: DataFrame) -> DataFrame:
    """Findings still in the queue once the selected ones were applied."""
    return findings.join(applied.select("doc_id", "page_index", "preset", "start"), ["doc_id", "page_index", "preset", "start"], "left_anti")


def redact_titles(findings: DataFrame, titles: DataFrame, placeholder: str = "[Redacted]") -> DataFrame:
    """Titles with every word of a redacted span of the same document replaced.

    Words are what stands between white space, without punctuation at its ends; a span that
    covers a part of a word takes the whole one, which findings give as ``words`` (see ``whole_words``).
    """
    edge = r"^[\p{Punct}]+|[\p{Punct}]+$"
    words = findings.select("doc_id", F.explode(F.split(F.lower("words"), r"\s+")).alias("w")).select("doc_id", F.regexp_replace("w", edge, "").alias("w")).where("w != ''")
    per_doc = words.groupBy("doc_id").agg(F.collect_set("w").alias("gone"))
    front, back = (lambda t: F.regexp_extract(t, r"^[\p{Punct}]*", 0)), (lambda t: F.regexp_extract(t, r"[\p{Punct}]*$", 0))
    tokens = F.transform(F.split("title", " "), lambda t: F.when(F.array_contains("gone", F.regexp_replace(F.lower(t), edge, "")), F.concat(front(t), F.lit(placeholder), back(t))).otherwise(t))
    return titles.join(per_doc, "doc_id", "left").withColumn("title", F.when(F.col("gone").isNull(), F.col("title")).otherwise(F.array_join(tokens, " "))).drop("gone")


def whole_words(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with words: the text of the words that they touch."""
    joined = findings.join(pages.select("doc_id", "page_index", "text"), ["doc_id", "page_index"])
    before = F.regexp_extract(F.expr("substring(text, 1, start)"), r"\S*$", 0)
    after = F.regexp_extract(F.expr("substring(text, start + len + 1)"), r"^\S*", 0)
    return joined.withColumn("words", F.concat(before, "matched", after)).drop("text")


def scrub(rows: DataFrame, redacted_docs: DataFrame, blank: list[str]) -> DataFrame:
    """Named columns nulled in the rows of documents that were redacted."""
    hit = rows.join(redacted_docs.select("doc_id", F.lit(True).alias("_hit")).distinct(), "doc_id", "left")
    return hit.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in blank}).drop("_hit")


#: Points a tile is wide and high.
TILE = 128
#: Kinds of marks that a region leaves alone, and kinds without replies.
UNTOUCHED, FIELDS = ("popup", "link", "redact"), ("widget",)


def _tiles(boxes: DataFrame) -> DataFrame:
    """Boxes, with their corners in order, once for each tile that they reach into."""
    x0, x1, y0, y1 = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    placed = boxes.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 < x1 AND y0 < y1")
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / TILE), F.floor(F.col(high) / TILE)))
    return placed.withColumn("tile_x", span("x0", "x1")).withColumn("tile_y", span("y0", "y1"))


def touched(boxes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of boxes (doc_id, page_index, x0, y0, x1, y1) that share some area with a region of their page.

    Boxes and regions meet in tiles; the tile of the shared area's first corner owns the pair, so
    each pair comes once.  Corners may come in any order; boxes without area touch nothing.
    """
    areas = _tiles(regions.select("doc_id", "page_index", "x0", "y0", "x1", "y1")).select("doc_id", "page_index", "tile_x", "tile_y", *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    met = _tiles(boxes).join(areas, ["doc_id", "page_index", "tile_x", "tile_y"]).where("x0 < rx1 AND rx0 < x1 AND y0 < ry1 AND ry0 < y1")
    owned = (F.col("tile_x") == F.floor(F.greatest("x0", "rx0") / TILE)) & (F.col("tile_y") == F.floor(F.greatest("y0", "ry0") / TILE))
    return met.where(owned).select(*keys).distinct()


def with_replies(marks: DataFrame, hit: DataFrame) -> DataFrame:
    """doc_id, page_index, obj of the marks in ``hit`` and of all replies to them on their page, at any depth.

    Marks look at the mark they answer; each round every mark takes over the verdict and the
    pointer of the one it looks at, which doubles its reach.  Replies in a circle share a verdict;
    fields answer nothing and take nothing along.
    """
    keys = ["doc_id", "page_index", "obj"]
    field = F.coalesce(F.col("kind").isin(*FIELDS), F.lit(False))
    looks = marks.select(*keys, F.when(~field, F.col("parent_obj")).alias("up"), field.alias("field"))
    state = saved(looks.join(hit.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left").select(*keys, "up", "field", F.coalesce("hit", F.lit(False)).alias("hit")), "replies")
    for _ in range(MOST_JUMPS):
        above = state.select("doc_id", "page_index", F.col("obj").alias("up"), F.col("up").alias("next"), (F.col("hit") & ~F.col("field")).alias("above_hit"))
        state = saved(state.join(above, ["doc_id", "page_index", "up"], "left").select(*keys, F.col("next").alias("up"), "field", (F.col("hit") | F.coalesce("above_hit", F.lit(False))).alias("hit")), "replies")
        if not state.where("up IS NOT NULL AND NOT hit").limit(1).count():
            break
    return state.where("hit").select(*keys)


def scrub_regions(marks: DataFrame, regions: DataFrame) -> DataFrame:
    """The comments and fields that stay when regions are redacted.

    ``marks`` has doc_id, page_index, obj, parent_obj, kind and a box.  Those that touch a region
    go, comments with all their replies on the page; popups, links and redaction marks are neither
    judged nor spared: they go only as replies.
    """
    keys = ["doc_id", "page_index", "obj"]
    hit = touched(marks.where(~F.coalesce("kind", F.lit("")).isin(*UNTOUCHED)), regions, keys)
    return marks.join(with_replies(marks, hit), keys, "left_anti")


def invalidate(derived: DataFrame, redacted_pages: DataFrame) -> DataFrame:
    """Derived rows (chunks, recognised text) of pages that weren't redacted."""
    return derived.join(redacted_pages, ["doc_id", "page_index"], "left_anti")


def leak_audit(pages: DataFrame, presets: dict[str, str] | None = None) -> DataFrame:
    """What a new scan of redacted pages still finds, by preset; every count should be 0."""
    names = pages.sparkSession.createDataFrame([(n,) for n in (presets or PRESETS)], "preset string")
    return names.join(scan(pages, presets), "preset", "left").groupBy("preset").agg(F.count("doc_id").alias("found"))
