"""Review threads: roots, states, facets and the joined report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Jumps double, so chains of up to 2 ** MOST_JUMPS replies resolve.
MOST_JUMPS = 20


def thread_roots(comments: DataFrame) -> DataFrame:
    """A1: comments with root.  Missing parents make a root; a chain that runs into a cycle stands alone.

    Pointer jumping: each round joins the table with itself and doubles the reach.
    """
    from quire.sources.shared import saved

    keys = comments.select("doc_id", "obj", "parent_obj")
    known = keys.select("doc_id", F.col("obj").alias("parent_obj"), F.lit(True).alias("known"))
    up = keys.join(known, ["doc_id", "parent_obj"], "left")
    up = saved(up.select("doc_id", "obj", F.when(F.col("known"), F.col("parent_obj")).otherwise(F.col("obj")).alias("up")), "thread-parents")
    for _ in range(MOST_JUMPS):
        above = up.select("doc_id", F.col("obj").alias("up"), F.col("up").alias("top"))
        step = saved(up.join(above, ["doc_id", "up"]).select("doc_id", "obj", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "thread-parents")
        up = step.select("doc_id", "obj", "up")
        if not step.where("moved").limit(1).count():
            break
    own = comments.select("doc_id", F.col("obj").alias("up"), F.col("parent_obj").alias("top_parent"))
    end = up.join(own, ["doc_id", "up"], "left")
    exists = keys.select("doc_id", F.col("obj").alias("top_parent"), F.lit(True).alias("in_cycle"))
    resolved = end.join(exists, ["doc_id", "top_parent"], "left").select("doc_id", "obj", F.when(F.col("in_cycle"), F.col("obj")).otherwise(F.col("up")).alias("root"))
    return comments.join(resolved, ["doc_id", "obj"])


def threads(rooted: DataFrame) -> DataFrame:
    """A2: doc_id, root, replies (by date, missing first) and status (last state of the Review model)."""
    member = F.col("obj") != F.col("root")
    reply = F.when(member & (F.coalesce("state", F.lit("")) == ""), F.struct("created", "obj", "author"))
    state = (F.coalesce("state", F.lit("")) != "") & (F.col("state_model") == "Review")
    last = F.max_by(F.when(state, F.col("state")), F.when(state, F.struct("created", "obj")))
    known = F.array(*map(F.lit, ["Accepted", "Rejected", "Cancelled", "Completed", "None"]))
    grouped = rooted.groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(reply)).alias("r"), last.alias("s"))
    return grouped.select("doc_id", "root", F.size("r").alias("replies"), F.array_join(F.transform("r", lambda x: x["obj"].cast("string")), ",").alias("reply_order"), F.when(F.array_contains(known, F.coalesce("s", F.lit(""))), F.col("s")).otherwise("None").alias("status"))


def filter_threads(rows: DataFrame, statuses: list[str] | None = None, authors: list | None = None, kinds: list[str] | None = None, since=None) -> DataFrame:
    """A3: rows that pass every filter that is given."""
    for column, some in (("status", statuses), ("author", authors), ("subtype", kinds)):
        if some is not None:
            rows = rows.where(F.col(column).isin(some))
    return rows if since is None else rows.where(F.col("created") >= F.lit(since))


def facets(rows: DataFrame) -> DataFrame:
    """A3: how many rows each type, author and status has, in one pass of grouping sets."""
    view = rows.groupingSets([[F.col("subtype")], [F.col("author")], [F.col("status")]], F.col("subtype"), F.col("author"), F.col("status"))
    counted = view.agg(F.grouping("subtype").alias("gs"), F.grouping("author").alias("ga"), F.count("*").alias("n"))
    facet = F.when(F.col("gs") == 0, "type").when(F.col("ga") == 0, "author").otherwise("status")
    return counted.select(facet.alias("facet"), F.coalesce(F.col("subtype").cast("string"), F.col("author").cast("string"), F.col("status").cast("string")).alias("value"), "n")


#: name and red, green, blue: fixed values of the palette.
PALETTE = [("yellow", 255, 235, 59), ("red", 244, 67, 54), ("orange", 255, 152, 0), ("green", 76, 175, 80), ("blue", 33, 150, 243), ("purple", 156, 39, 176), ("pink", 233, 30, 99), ("teal", 0, 150, 136), ("gray", 158, 158, 158), ("black", 0, 0, 0)]


def nearest_colour(marks: DataFrame) -> DataFrame:
    """A5: marks (r, g, b) with the palette's nearest colour; of equals the first."""
    near = F.array(*(F.struct(((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, r, g, b) in enumerate(PALETTE)))
    return marks.withColumn("colour", F.array_min(near)["name"])


def review_report(marks: DataFrame, rooted: DataFrame) -> DataFrame:
    """A4: marks with the replies of their threads, and threads without a mark."""
    member = F.col("obj") != F.col("root")
    said = rooted.where(member & (F.coalesce("state", F.lit("")) == "")).groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("created", "obj", F.concat_ws(": ", F.col("author").cast("string"), "text").alias("t")))).alias("r"))
    lines = said.select("doc_id", F.col("root").alias("obj"), F.array_join(F.transform("r", lambda x: x["t"]), " | ").alias("replies"))
    with_mark = marks.join(lines, ["doc_id", "obj"], "left").select("doc_id", "obj", "colour", F.coalesce("replies", F.lit("")).alias("replies"))
    without = lines.join(marks, ["doc_id", "obj"], "left_anti").select("doc_id", "obj", F.lit(None).cast("string").alias("colour"), "replies")
    return with_mark.unionByName(without)
