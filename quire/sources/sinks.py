"""Sinks: text export, report files and the pruned index store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_export(pages: DataFrame, separators: bool = False) -> DataFrame:
    """One text for each document, pages in order with blank lines between; ``pages`` has body."""
    head = F.concat(F.lit("--- Page "), (F.col("page_index") + 1).cast("string"), F.lit(" ---\n\n")) if separators else F.lit("")
    per_doc = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_index", F.concat(head, "body").alias("t")))).alias("p"))
    return per_doc.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def write_exports(pages: DataFrame, path: str) -> None:
    """The exports as text files."""
    document_export(pages).select("text").write.mode("overwrite").text(path)


def csv_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Quoted rows of each report joined by line ends, in the order of the columns."""
    line = F.concat(F.lit('"'), F.concat_ws('","', *(F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')) for c in columns)), F.lit('"'))
    order = F.struct(*columns[:2], line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]), "\n").alias("csv"))


def write_csv(rows: DataFrame, path: str) -> None:
    """The report as CSV with a header and every field quoted."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def evict_to(entries: DataFrame, cap: int, buckets: int = 256) -> DataFrame:
    """Running sum of bytes from the latest use backward; entries beyond the cap are evicted.

    Two-level prefix sum: per-bucket sums over equal time ranges (``buckets`` rows), then sums
    within the buckets, so that no task sees all entries.
    """
    ends = entries.agg(F.min("used").alias("lo"), F.max("used").alias("hi")).first()
    lo, hi = (x.timestamp() if x else 0.0 for x in (ends["lo"], ends["hi"]))
    share = (F.lit(hi) - F.unix_micros("used") / 1e6) / F.lit(max(hi - lo, 1e-6)) * buckets
    placed = entries.withColumn("bucket", F.least(F.greatest(share.cast("int"), F.lit(0)), F.lit(buckets - 1)))
    sums = placed.groupBy("bucket").agg(F.sum("bytes").alias("total"))
    before = sums.select("bucket", (F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    inner = Window.partitionBy("bucket").orderBy(F.desc("used"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(before), "bucket").withColumn("running", F.sum("bytes").over(inner) + F.col("before"))
    return out.withColumn("kept", F.col("running") <= cap)
