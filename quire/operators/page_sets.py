"""Page sets and inventories: numbering, ranges, labels, listings and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import saved

SIGNS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


#: What tokens of a mark's template stand for.
TOKENS = {"<<page>>": "page", "<<pages>>": "pages", "<<bates>>": "bates", "<<date>>": "date", "<<file>>": "file"}


def expanded(template: str, values: dict[str, Column]) -> Column:
    """The template with its tokens replaced by the values of these names."""
    out = F.lit(template)
    for token, name in TOKENS.items():
        out = F.replace(out, F.lit(token), values[name].cast("string"))
    return out


def sequential_numbers(docs: DataFrame, start: int = 1, digits: int = 6, prefix: str = "", parity: int | None = None, template: str = "<<bates>> of <<pages>>", date: str = "", first_page: int = 1) -> DataFrame:
    """doc_id, page_index, number, mark of the chosen pages, numbered through all files.

    ``docs`` has doc_id, name, page_count, failed.  Failed files take no numbers.  The prefix
    sums are two-level: files are range-partitioned by name, the partitions' sums (as many as there
    are shuffle partitions) are added up, then each partition's own.
    """
    chosen = docs.where("NOT failed").withColumn("key", natural_key(F.col("name")))
    first = 0 if parity is None else parity
    n = F.col("page_count") if parity is None else F.expr(f"(page_count - {parity} + 1) div 2")
    counted = chosen.withColumn("n", n)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.select("doc_id", "name", "page_count", "key", "n").repartitionByRange(parts, "key", "doc_id")
    placed = saved(ranged.withColumn("part", F.spark_partition_id()), "numbered-files")
    sums = placed.groupBy("part").agg(F.sum("n").alias("total"))
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    based = placed.join(before, "part").withColumn("base", F.col("before") + inner)
    step = 1 if parity is None else 2
    pages = based.where("n > 0").select("doc_id", "name", "page_count", "base", F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("at", "k"))
    number = (F.col("base") + F.col("k") + start).cast("long")
    values = {"page": F.col("k") + first_page, "pages": F.col("page_count"), "bates": F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0")), "date": F.lit(date), "file": F.col("name")}
    mark = expanded(template, values)
    return pages.select("doc_id", (F.col("k") * step + first).alias("page_index"), number.alias("number"), mark.alias("mark"))


def page_ranges(requests: DataFrame) -> DataFrame:
    """D3: doc_id, at, page_index for lists such as ``1-3, 5, 8-``; -1 stands for a part that isn't valid.

    ``requests`` has doc_id, page_count, spec.  Ranges may be reversed or open; repeats stay.
    """
    parts = requests.select("doc_id", "page_count", F.posexplode(F.split("spec", ",")).alias("part", "raw"))
    one = parts.withColumn("raw", F.btrim("raw", F.lit(" ")))
    low, high = F.regexp_extract("raw", r"^([0-9]*)", 1), F.regexp_extract("raw", r"-\s*([0-9]*)$", 1)
    a = F.when(low == "", 1).otherwise(low.cast("int"))
    b = F.when(~F.contains("raw", F.lit("-")), a).when(high == "", F.col("page_count").cast("int")).otherwise(high.cast("int"))
    valid = F.col("raw").rlike(r"^([0-9]+(\s*-\s*[0-9]*)?|-\s*[0-9]+)$") & (a >= 1) & (b >= 1) & (a <= F.col("page_count")) & (b <= F.col("page_count"))
    pages = one.select("doc_id", "part", F.posexplode(F.when(valid, F.sequence(a, b)).otherwise(F.array(F.lit(0)))).alias("k", "page"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "k"))
    return pages.select("doc_id", at.alias("at"), (F.col("page") - 1).alias("page_index"))


def custom_splits(requests: DataFrame) -> DataFrame:
    """D3: doc_id, split_no, first, last, name for lists such as ``1-3, 7``: parts beyond the file are cut to it, others left out.

    ``requests`` has doc_id, name, page_count, spec.
    """
    parts = requests.where("page_count > 0").select("doc_id", "name", "page_count", F.posexplode(F.split("spec", ",")).alias("part", "raw"))
    low, high = F.regexp_extract("raw", r"^\s*([0-9]+)\s*(?:-\s*[0-9]+\s*)?$", 1).try_cast("int"), F.regexp_extract("raw", r"^\s*[0-9]+\s*-\s*([0-9]+)\s*$", 1).try_cast("int")
    ranged = parts.withColumns({"a": low, "b": high}).where("a > 0 AND (b >= a OR b IS NULL AND a <= page_count)")
    first, last = F.least("a", F.col("page_count").cast("int")), F.least(F.coalesce("b", "a"), F.col("page_count").cast("int"))
    cut = ranged.select("doc_id", "name", "part", (first - 1).alias("first"), (last - 1).alias("last"))
    one = F.concat("name", F.lit("_Page_"), (F.col("first") + 1).cast("string"))
    several = F.concat("name", F.lit("_Pages_"), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return cut.select("doc_id", number.alias("split_no"), "first", "last", F.when(F.col("first") == F.col("last"), one).otherwise(several).alias("name"))


def splits(docs: DataFrame, every: int) -> DataFrame:
    """D3: doc_id, split_no, first, last, name of pieces of ``every`` pages."""
    each = docs.where("page_count > 0").select("doc_id", "name", "page_count", F.explode(F.sequence(F.lit(0), F.expr(f"(page_count - 1) div {every}").cast("int"))).alias("split_no"))
    first = F.col("split_no") * every
    last = F.least(first + every, F.col("page_count")) - 1
    return each.select("doc_id", "split_no", first.cast("long").alias("first"), last.cast("long").alias("last"), F.concat("name", F.lit("_"), (F.col("split_no") + 1).cast("string")).alias("name"))


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999."""
    out = F.struct(n.cast("int").alias("left"), F.lit("").alias("text"))
    signs = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in SIGNS))
    return F.aggregate(signs, out, lambda acc, x: F.struct((acc["left"] % x["v"]).cast("int").alias("left"), F.concat(acc["text"], F.repeat(x["s"], F.floor(acc["left"] / x["v"]).cast("int"))).alias("text")), lambda acc: acc["text"])


def page_labels(ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, page_index, label by the last range that starts at or before the page (an as-of join)."""
    pages = docs.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("page_count") - 1).cast("int"))).alias("page_index"))
    both = pages.select("doc_id", "page_index", F.lit(None).cast("struct<first:int,style:string,prefix:string,start:int>").alias("r")).unionByName(ranges.select("doc_id", F.col("first").alias("page_index"), F.struct("first", "style", "prefix", "start").alias("r")))
    held = F.last("r", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page_index", F.col("r").isNull()))
    placed = both.withColumn("held", held).where("r IS NULL")
    n = F.col("page_index") - F.col("held.first") + F.col("held.start")
    text = F.when(F.col("held.style") == "R", roman(n)).when(F.col("held.style") == "r", F.lower(roman(n))).when(F.col("held.style") == "D", n.cast("string")).otherwise("")
    return placed.select("doc_id", "page_index", F.when(F.col("held").isNull(), (F.col("page_index") + 1).cast("string")).otherwise(F.concat("held.prefix", text)).alias("label"))


def label_lookup(lookups: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Lookups (doc_id, q, current) with page_index: exact label, then any case, after the current page and around; else a position."""
    found = lookups.withColumn("low", F.lower("q")).join(labels.withColumn("low", F.lower("label")), ["doc_id", "low"], "left").join(docs.select("doc_id", "page_count"), "doc_id")
    ahead = F.pmod(F.col("page_index") - F.col("current") - 1, F.col("page_count"))
    hit = F.when(F.col("page_index").isNotNull() & ~F.startswith(F.col("q"), F.lit("#")), F.struct((F.col("label") != F.col("q")).cast("int").alias("loose"), ahead.alias("ahead"), "page_index"))
    best = found.groupBy("doc_id", "q", "current", "page_count").agg(F.min(hit).alias("b"))
    place = F.regexp_extract("q", r"^#?([0-9]+)$", 1)
    position = F.when(place != "", F.greatest(F.lit(0), F.least(place.cast("int"), F.col("page_count").cast("int")) - 1))
    return best.select("doc_id", "q", "current", F.coalesce("b.page_index", position).alias("page_index"))


def inventory(docs: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row a document with the number of rows that each table has of it."""
    for name, rows in tables.items():
        docs = docs.join(rows.groupBy("doc_id").agg(F.count("*").alias("n_" + name)), "doc_id", "left").withColumn("n_" + name, F.coalesce("n_" + name, F.lit(0).cast("long")))
    return docs


def inventory_cube(rows: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Documents and counts by every combination of the columns."""
    return rows.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in counts))


def form_fields(fields: DataFrame) -> DataFrame:
    """Fields listed once for page and name where radio or checkbox; shown name and value made plain."""
    grouped = F.col("kind").isin("radio", "checkbox")
    n = F.row_number().over(Window.partitionBy("doc_id", "page_index", "name").orderBy("field_no"))
    listed = fields.withColumn("n", n).where(~grouped | (F.col("n") == 1))
    shown = F.coalesce(F.nullif("description", F.lit("")), F.element_at(F.split("name", r"\."), -1))
    value = F.when(F.col("kind") == "checkbox", F.when(F.lower("value").isin("", "off", "no", "false"), "off").otherwise("on")).otherwise(F.col("value"))
    return listed.select("doc_id", "page_index", "field_no", shown.alias("shown"), "kind", value.alias("value"))


def link_rows(links: DataFrame, words: DataFrame, bucket: float = 32.0) -> DataFrame:
    """Links with the words whose centre lies in their box, kind and plain target.

    Boxes and centres meet in buckets of y, so the join is an equi-join.
    """
    boxes = links.select("doc_id", "page_index", "link_no", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.floor(F.col("y0") / bucket), F.floor(F.col("y1") / bucket))).alias("bucket"))
    centres = words.select("doc_id", "page_index", "pos", "word", ((F.col("wx0") + F.col("wx1")) / 2).alias("cx"), ((F.col("wy0") + F.col("wy1")) / 2).alias("cy")).withColumn("bucket", F.floor(F.col("cy") / bucket))
    inside = boxes.join(centres, ["doc_id", "page_index", "bucket"]).where("cx >= x0 AND cx <= x1 AND cy >= y0 AND cy <= y1")
    texts = inside.groupBy("doc_id", "page_index", "link_no").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    kind = F.when(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "external").otherwise("internal")
    return links.join(texts, ["doc_id", "page_index", "link_no"], "left").select("doc_id", "page_index", "link_no", F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"), F.regexp_replace("target", "(?i)^mailto:", "").alias("target"))


def attachment_names(attachments: DataFrame, fallback: str = "attachment") -> DataFrame:
    """Safe file names, and how many attachments of the document share each."""
    last = F.element_at(F.split("name", r"[/\\]"), -1)
    safe = F.regexp_replace(F.regexp_replace(last, ":", "-"), r"^\.+", "")
    named = attachments.withColumn("safe", F.when(F.btrim(safe, F.lit(" ")) == "", fallback).otherwise(safe))
    return named.withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "safe")))


def signature_status(signatures: DataFrame) -> DataFrame:
    """Signatures of each document by verdict, and whether all are fully valid."""
    valid = (F.col("integrity") == "intact") & (F.col("changes") == "none") & (F.col("identity") == "trusted")
    problem = (F.col("integrity") == "broken") | (F.col("changes") == "forbidden")
    return signatures.groupBy("doc_id").agg(F.count("*").alias("signatures"), F.count_if(F.col("integrity") == "intact").alias("intact"), F.count_if(problem).alias("problems"), F.bool_and(valid).alias("all_valid"))


def recent_documents(opens: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """Existing documents by their last opening, newest first."""
    last = opens.groupBy("key").agg(F.max("ts").alias("ts")).join(docs.select("key").distinct(), "key", "left_semi")
    top = last.orderBy(F.desc("ts"), "key").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ts"), "key")))  # at most ``limit`` rows
