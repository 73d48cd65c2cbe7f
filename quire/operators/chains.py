"""Longest rising chains of anchors, in blocks: no task holds all anchors of a pair of documents."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import saved

#: Places of a block, and the most stretches that one task chains at once.
BLOCK, MOST = 65_536, 1_000_000
PAIR = ["a", "b"]
SEGMENT = [*PAIR, "segment"]
FRONT = "a long, b long, segment long, is_front boolean, lo_i long, lo long, hi long, weight long, total long"


def extended(lo: list[int], hi: list[int], weight: list[int], ends: list[int], best: list[int]) -> list[int]:
    """Weight of the heaviest chain that ends with each stretch (``lo`` to ``hi``, in order of place); the front is brought up to date.

    The front, ``ends`` and ``best``, are ends and weights of the chains that no other beats, both
    rising.  No stretch has another's values among its own.
    """
    totals = []
    for a, b, w in zip(lo, hi, weight, strict=True):
        p = q = bisect.bisect_left(ends, a)
        total = (best[p - 1] if p else 0) + w
        while q < len(ends) and best[q] <= total:
            q += 1
        ends[p:q], best[p:q] = [b], [total]
        totals.append(total)
    return totals


def traced(lo: list[int], hi: list[int], weight: list[int], totals: list[int], need: int, under: int) -> tuple[list[int], int, int]:
    """Places of the chain of weight ``need`` that ends below ``under``, followed from its end; what these stretches leave of both."""
    out = []
    for k in range(len(lo) - 1, -1, -1):
        if need and totals[k] == need and hi[k] < under:
            out.append(k)
            need, under = need - weight[k], lo[k]
    return out, need, under


def _columns(rows: pd.DataFrame, *names: str) -> list[list[int]]:
    return [rows[n].tolist() for n in names]


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo_i")
    lo, hi, weight = _columns(rows, "lo", "hi", "weight")
    ends, best = [], []
    totals = extended(lo, hi, weight, ends, best)
    return rows.iloc[traced(lo, hi, weight, totals, best[-1], ends[-1] + 1)[0]][[*PAIR, "lo_i"]]


def _forward(key: tuple, front: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    rows, front = rows.sort_values("lo_i"), front.sort_values("hi")
    lo, hi, weight, at = _columns(rows, "lo", "hi", "weight", "lo_i")
    ends, best = _columns(front, "hi", "total")
    totals = extended(lo, hi, weight, ends, best)
    new = {"is_front": [False] * len(lo) + [True] * len(ends), "lo_i": at + [0] * len(ends), "lo": lo + [0] * len(ends), "hi": hi + ends, "weight": weight + [0] * len(ends), "total": totals + best}
    return pd.DataFrame({"a": key[0], "b": key[1], "segment": key[2], **new})


def _backward(key: tuple, goal: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo_i")
    lo, hi, weight, totals, at = _columns(rows, "lo", "hi", "weight", "total", "lo_i")
    kept, need, under = traced(lo, hi, weight, totals, int(goal["total"].iloc[0]), int(goal["hi"].iloc[0]))
    new = {"is_front": [False] * len(kept) + [True], "lo_i": [at[k] for k in kept] + [0], "lo": 0, "hi": under, "weight": 0, "total": need}
    return pd.DataFrame({"a": key[0], "b": key[1], "segment": key[2], **new})


def stretches(anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The anchors (a, b, i, j) with block and run of the stretch they are in: neighbours by i that are also neighbours by j.

    A longest chain takes a stretch whole or not at all.  Stretches end with their block of ``block`` places.
    """
    sliced = anchors.withColumns({"block": F.expr(f"i div {block}"), "block_j": F.expr(f"j div {block}")})
    by_j = Window.partitionBy(*PAIR, "block_j").orderBy("j")
    by_i = Window.partitionBy(*PAIR, "block").orderBy("i")
    linked = sliced.withColumn("below", F.lag("i").over(by_j))
    fresh = F.coalesce(F.lag("i").over(by_i) != F.col("below"), F.lit(True)).cast("int")
    return linked.withColumn("fresh", fresh).select(*PAIR, "block", "i", "j", F.sum("fresh").over(by_i.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


def segments(runs: DataFrame) -> DataFrame:
    """Stretches (a, b, block, run, lo_i, lo, hi, weight) with their segment: it starts where all stretches before lie below all from there on.

    Prefix maxima and suffix minima of blocks, a row a block, then within the blocks.
    """
    over = Window.partitionBy(*PAIR).orderBy("block")
    inner = Window.partitionBy(*PAIR, "block").orderBy("lo_i")
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    blocks = runs.groupBy(*PAIR, "block").agg(F.max("hi").alias("top"), F.min("lo").alias("low"))
    around = blocks.select(*PAIR, "block", F.max("top").over(over.rowsBetween(*before)).alias("top"), F.min("low").over(over.rowsBetween(*after)).alias("low"))
    below = F.coalesce(F.greatest("top", F.max("hi").over(inner.rowsBetween(*before))), F.lit(-1))
    above = F.least("low", F.min("lo").over(inner.rowsBetween(0, Window.unboundedFollowing)))
    cut = runs.join(around, [*PAIR, "block"]).withColumn("cut", F.when(below < above, F.col("lo_i"))).drop("top", "low")
    cut = saved(cut, "cut-stretches")
    lasts = cut.groupBy(*PAIR, "block").agg(F.max("cut").alias("last"))
    carried = lasts.select(*PAIR, "block", F.max("last").over(over.rowsBetween(*before)).alias("carried"))
    here = F.max("cut").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(carried, [*PAIR, "block"]).withColumn("segment", F.greatest(here, "carried")).drop("cut", "carried")


def chain(anchors: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """C4: the anchors (a, b, i, j; i and j each once in a pair, from 0) of a longest rising chain of each pair.

    Anchors are put together to stretches, and these cut into segments whose chains can't
    influence each other; nearly all segments of revisions are one stretch.  The others are chained
    by themselves, a task each; one of more than ``most`` stretches goes through rounds, a block of
    places each, with the front of its best chains as state, and then back.  Of several longest
    chains it is the one that takes the latest anchors from its end on.  No anchors give no rows.
    """
    placed = saved(stretches(anchors.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("i").cast("long"), F.col("j").cast("long")), block), "stretched-anchors")
    runs = placed.groupBy(*PAIR, "block", "run").agg(F.min("i").alias("lo_i"), F.min("j").alias("lo"), F.max("j").alias("hi"), F.count("*").alias("weight"))
    each = saved(segments(saved(runs, "stretches")), "segments")
    sizes = each.groupBy(*SEGMENT).agg(F.count("*").alias("n"))
    sized = each.join(sizes, SEGMENT)
    kept = sized.where("n = 1").select(*PAIR, "lo_i")
    rows = [*SEGMENT, "lo_i", "lo", "hi", "weight"]
    mixed = sized.where(f"n BETWEEN 2 AND {most}").select(*rows).groupBy(*SEGMENT)
    kept = kept.unionByName(mixed.applyInPandas(_chained, "a long, b long, lo_i long"))
    large = sized.where(f"n > {most}").select(*rows, F.expr(f"lo_i div {most} - segment div {most}").alias("round"))
    if sizes.where(f"n > {most}").limit(1).count():
        kept = kept.unionByName(_by_rounds(saved(large.repartitionByRange("round", *SEGMENT), "large-segments")))
    named = each.join(kept, [*PAIR, "lo_i"], "left_semi")
    return placed.join(named, [*PAIR, "block", "run"], "left_semi").select(*PAIR, "i", "j")


def _by_rounds(large: DataFrame) -> DataFrame:
    """a, b, lo_i of the chained stretches of segments that are too large for one task."""
    last = large.agg(F.max("round")).first()[0]
    front = large.sparkSession.createDataFrame([], FRONT)
    passed = []
    for k in range(last + 1):
        rows = large.where(F.col("round") == k)
        passed.append(saved(front.groupBy(*SEGMENT).cogroup(rows.groupBy(*SEGMENT)).applyInPandas(_forward, FRONT), "chain-forward"))
        front = passed[-1].where("is_front")
    goal = front.groupBy(*SEGMENT).agg(F.max("total").alias("total"), (F.max("hi") + 1).alias("hi"))
    kept = None
    for step in reversed(passed):
        back = saved(goal.groupBy(*SEGMENT).cogroup(step.where("NOT is_front").groupBy(*SEGMENT)).applyInPandas(_backward, FRONT), "chain-back")
        goal = back.where("is_front")
        own = back.where("NOT is_front").select(*PAIR, "lo_i")
        kept = own if kept is None else kept.unionByName(own)
    return kept
