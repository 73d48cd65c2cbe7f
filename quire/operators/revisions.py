"""Revision comparison with a row for each pair of documents: the words of both are texts or arrays, matches are runs.

The rules are those of ``compare``; there a row is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.compare import MOVED_RUN, NEAR, REPORT_WORDS, SLIDE, STRAY_RUN, gap_matches, longest_rising

PAIR = ["a", "b"]
RANGES = ["o_lo", "o_hi", "r_lo", "r_hi"]
RUNS = "n_a long, n_b long, runs array<struct<i: int, j: int, n: int>>"


def compared(keyed: DataFrame) -> DataFrame:
    """doc_id and, of the words with a key, text (their keys, a line each), words, pos, starts (whether a line starts there)."""
    each = F.filter(F.transform(F.arrays_zip("words", "places", "keys"), lambda w, k: F.struct(w["keys"].alias("key"), w["words"].alias("word"), k.alias("pos"), w["places"].alias("place"))), lambda w: w["key"] != "")
    listed = keyed.select("doc_id", each.alias("ws"))
    starts = F.transform("ws", lambda w, k: F.coalesce(F.get("ws", k - 1)["place"] != w["place"], F.lit(True)))
    return listed.select("doc_id", F.array_join(F.transform("ws", lambda w: w["key"]), "\n").alias("text"), F.transform("ws", lambda w: w["word"]).alias("words"), F.transform("ws", lambda w: w["pos"]).alias("pos"), starts.alias("starts"))


def pair_rows(pairs: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the named columns of both documents, as <column>_a and <column>_b.

    Pairs are few bytes each but can be millions, so neither side goes through the driver as a broadcast.
    """
    side = lambda c: docs.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _unique_runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of three words that are once in each row of word numbers, by place in the first."""
    if min(len(x), len(y)) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.concatenate([x, y]).astype(np.int64)
    _, two = np.unique((both[:-1] << 31) + both[1:], return_inverse=True)
    three = (two[:-1].astype(np.int64) << 31) + both[2:]
    (u, at_u, n_u), (v, at_v, n_v) = (np.unique(k, return_index=True, return_counts=True) for k in (three[: len(x) - 2], three[len(x) :]))
    _, p, q = np.intersect1d(u[n_u == 1], v[n_v == 1], assume_unique=True, return_indices=True)
    i, j = at_u[n_u == 1][p], at_v[n_v == 1][q]
    order = np.argsort(i)
    return i[order], j[order]


def word_matches(x: np.ndarray, y: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the matched words of two rows of word numbers, rising; ``known`` keeps the gaps aligned so far."""
    i, j = _unique_runs(x, y)
    if len(j) and (np.diff(j) < 0).any():
        chain = longest_rising(j.tolist())
        i, j = i[chain], j[chain]
    return filled(x, y, i, j, known)


def filled(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """The anchors i, j (rising) with the matched words of the gaps between them."""
    from_i, to_i, from_j, to_j = np.append(0, i + 1), np.append(i, len(x)), np.append(0, j + 1), np.append(j, len(y))
    some = (to_i > from_i) & (to_j > from_j)
    found, x_bytes, y_bytes = [(i, j)], x.tobytes(), y.tobytes()
    w, v = x.itemsize, y.itemsize
    for a, b, c, d in zip(*(k[some].tolist() for k in (from_i, to_i, from_j, to_j)), strict=True):
        gap = x_bytes[w * a : w * b], y_bytes[v * c : v * d]
        if gap not in known:
            p, q = x[a:b].tolist(), y[c:d].tolist()
            known[gap] = np.array(gap_matches(p, q), np.int64).reshape(-1, 2).T if not set(p).isdisjoint(q) else None
        if known[gap] is not None:
            found.append((known[gap][0] + a, known[gap][1] + c))
    if len(found) == 1:
        return i, j
    i, j = (np.concatenate(k) for k in zip(*found, strict=True))
    order = np.argsort(i)
    return i[order], j[order]


def runs_of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows of i, j, n of the runs of neighbours on both sides."""
    first = np.nonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))[0] if len(i) else np.empty(0, np.int64)
    return np.stack([i[first], j[first], np.diff(np.append(first, len(i)))], axis=1)


def _word_numbers(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers of text_a and text_b of each row; equal words of the batch have equal numbers."""
    texts = pa.concat_arrays([rows.column("text_a"), rows.column("text_b")])
    split = pc.split_pattern(texts, "\n")
    codes, ends = split.flatten().dictionary_encode().indices.to_numpy(), split.offsets.to_numpy()
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    row = lambda k: codes[ends[k] : ends[k] if empty[k] else ends[k + 1]]
    for k in range(rows.num_rows):
        yield row(k), row(rows.num_rows + k)


def _lists(rows: list[np.ndarray], names: list[str], kind: pa.DataType) -> pa.Array:
    """An array of structs for each table of ``rows``."""
    flat = np.concatenate([np.empty((0, len(names)), np.int64), *rows])
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, k]).cast(kind) for k in range(len(names))], names))


def spread(rows: DataFrame) -> DataFrame:
    """Pairs take long though their words are few bytes, so a number of tasks is named."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAIR)


def anchors(rows: DataFrame, chained: bool = False) -> DataFrame:
    """A, b, i, j of ``rows`` (a, b, text_a, text_b) where a run of three words occurs once on each side.

    C4: if ``chained``, only those of a longest rising chain; of several it is the one that takes the latest anchors from its end on.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for x, y in _word_numbers(batch):
                i, j = _unique_runs(x, y)
                if chained and len(j) and (np.diff(j) < 0).any():
                    kept = longest_rising(j.tolist())
                    i, j = i[kept], j[kept]
                each.append(np.stack([i, j], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), _lists(each, ["i", "j"], pa.int32())], [*PAIR, "at"])

    kinds = dict(rows.dtypes)
    placed = spread(rows.select(*PAIR, "text_a", "text_b")).mapInArrow(found, f"a {kinds['a']}, b {kinds['b']}, at array<struct<i: int, j: int>>")
    return placed.select(*PAIR, F.inline("at"))


def matches(rows: DataFrame) -> DataFrame:
    """``rows`` (a, b, text_a, text_b and more) with n_a, n_b (words) and runs of matched words, in order."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, n_a, n_b, runs = {}, [], [], []
            for x, y in _word_numbers(batch):
                runs.append(runs_of(*word_matches(x, y, known)))
                n_a.append(len(x)), n_b.append(len(y))
            new = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), _lists(runs, ["i", "j", "n"], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_a", "n_b", "runs"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return spread(rows).mapInArrow(matched, f"{fields}, {RUNS}")


def matched_words(found: DataFrame) -> DataFrame:
    """A, b, i, j of all matched words."""
    each = found.select(*PAIR, F.inline("runs")).select(*PAIR, "i", "j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return each.select(*PAIR, (F.col("i") + F.col("k")).alias("i"), (F.col("j") + F.col("k")).alias("j"))


def similarity(found: DataFrame) -> DataFrame:
    """Matched words as a share of the longer side; 1 if both are empty."""
    longer, matched = F.greatest("n_a", "n_b"), F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["n"])
    return found.select(*PAIR, matched.alias("matched"), F.when(longer == 0, 1.0).otherwise(matched / longer).alias("similarity"))


def gaps(found: DataFrame) -> DataFrame:
    """``found`` with gaps: the ranges (half-open) between runs, one more than runs; some may be empty on both sides."""
    ends = found.withColumn("_ends", F.concat("runs", F.array(F.struct(F.col("n_a").cast("int").alias("i"), F.col("n_b").cast("int").alias("j"), F.lit(0).alias("n")))))

    def gap(p: Column, k: Column) -> Column:
        before = F.get("_ends", k - 1)
        lo = lambda c: F.coalesce(before[c] + before["n"], F.lit(0)).cast("long")
        return F.struct(lo("i").alias("o_lo"), p["i"].cast("long").alias("o_hi"), lo("j").alias("r_lo"), p["j"].cast("long").alias("r_hi"))

    return ends.withColumn("gaps", F.transform("_ends", gap)).drop("_ends")


def changes(found: DataFrame, near: int = NEAR) -> DataFrame:
    """A, b, change_no, o_lo, o_hi, r_lo, r_hi (half-open); changes ``near`` matched words apart are one."""
    each = gaps(found).select(*PAIR, F.inline("gaps")).where("o_hi > o_lo OR r_hi > r_lo")
    by = Window.partitionBy(*PAIR).orderBy("o_lo", "r_lo")
    apart = F.coalesce(F.col("o_lo") - F.lag("o_hi").over(by), F.lit(near + 1)) > near
    numbered = each.withColumn("apart", apart.cast("int")).withColumn("change_no", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*PAIR, "change_no").agg(F.min("o_lo").alias("o_lo"), F.max("o_hi").alias("o_hi"), F.min("r_lo").alias("r_lo"), F.max("r_hi").alias("r_hi"))


def _shift(g: Column, room_before: Column, room_after: Column) -> Column:
    """By how many words a change on one side is to slide to start at a line's start (``compare.slid_to_lines``)."""
    side = lambda name: F.when(g["o_lo"] == g["o_hi"], F.col(f"{name}_b")).otherwise(F.col(f"{name}_a"))
    lo, hi = F.when(g["o_lo"] == g["o_hi"], g["r_lo"]).otherwise(g["o_lo"]).cast("int"), F.when(g["o_lo"] == g["o_hi"], g["r_hi"]).otherwise(g["o_hi"]).cast("int")
    begins = lambda s: F.coalesce(F.get(side("starts"), lo + s), F.lit(False))
    same = lambda s: F.coalesce(F.get(side("keys"), lo + s) == F.get(side("keys"), hi + s), F.lit(False))
    steps = lambda n: F.filter(F.sequence(F.lit(0), F.lit(SLIDE)), lambda s: (s >= 1) & (s <= n))

    def walk(n: Column, step, allowed) -> Column:
        """Steps to the first line start, 0 if the words don't allow to go so far; -1 stands for going on."""
        go_on = lambda s: F.when(~allowed(s), 0).when(begins(step(s)), s).otherwise(-1)
        return F.greatest(F.aggregate(steps(n), F.lit(-1), lambda at, s: F.when(at == -1, go_on(s)).otherwise(at)), F.lit(0))

    size = hi - lo
    back = walk(F.least(size, room_before), lambda s: -s, lambda s: same(-s))
    ahead = walk(F.least(size, room_after), lambda s: s, lambda s: same(s - 1))
    moved = F.when(begins(F.lit(0)), 0).when(back > 0, -back).otherwise(ahead)
    one = (g["o_lo"] == g["o_hi"]) != (g["r_lo"] == g["r_hi"])
    return F.when(one, moved).otherwise(0).cast("int")


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"keys_{c}": F.split(f"text_{c}", "\n") for c in PAIR})


def slid_matches(found: DataFrame) -> DataFrame:
    """Runs with every gap on one side only moved to start at a line's start; the run it slides into goes on at its other end.

    ``found`` has text and starts of both sides.  Two gaps that would slide over the same words of the run between them stay.
    """
    n = lambda k: F.coalesce(F.get("runs", k)["n"], F.lit(0))
    judged = with_keys(gaps(found)).withColumn("_want", F.transform("gaps", lambda g, k: _shift(g, n(k - 1), n(k)))).drop("keys_a", "keys_b", "gaps")
    want = lambda k: F.coalesce(F.get("_want", k), F.lit(0))
    clash = lambda k: (want(k) > 0) & (want(k + 1) < 0) & (want(k) - want(k + 1) > n(k))  # noqa: E731  # of the run between gaps k and k + 1
    shifts = judged.withColumn("_shift", F.transform("_want", lambda s, k: F.when(clash(k) | clash(k - 1), 0).otherwise(s)))
    slid = lambda r, k: F.struct((r["i"] + F.get("_shift", k)).alias("i"), (r["j"] + F.get("_shift", k)).alias("j"), (r["n"] - F.get("_shift", k) + F.get("_shift", k + 1)).alias("n"))
    return shifts.withColumn("runs", F.filter(F.transform("runs", slid), lambda r: r["n"] > 0)).drop("_want", "_shift")


def _covered(size: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each place up to ``size`` is in one of the ranges."""
    ends = np.zeros(size + 1, np.int64)
    np.add.at(ends, lo, 1)
    np.add.at(ends, lo + n, -1)
    return np.cumsum(ends)[:size] > 0


def _moved(x: np.ndarray, y: np.ndarray, runs: np.ndarray, moved_run: int, stray_run: int) -> np.ndarray:
    """Rows of i, j, n of the runs that moved (``compare.moves``)."""
    long = runs[runs[:, 2] >= stray_run]
    at_x, at_y = np.nonzero(~_covered(len(x), long[:, 0], long[:, 2]))[0], np.nonzero(~_covered(len(y), long[:, 1], long[:, 2]))[0]
    if min(len(at_x), len(at_y)) < moved_run:
        return runs[:0]
    i, j = word_matches(x[at_x], y[at_y], {})
    again = runs_of(at_x[i], at_y[j])
    again = again[again[:, 2] >= moved_run]
    stray = {(i + k, j + k) for i, j, n in runs[runs[:, 2] < stray_run].tolist() for k in range(n)}
    return again[[any((i + k, j + k) not in stray for k in range(n)) for i, j, n in again.tolist()]] if len(again) else again


def with_moves(found: DataFrame, moved_run: int = MOVED_RUN, stray_run: int = STRAY_RUN) -> DataFrame:
    """``found`` (with text of both sides) with moves: runs of words that are unchanged but in another place, in the order of the revision."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends = batch.column("runs"), batch.column("runs").offsets.to_numpy()
            flat = own.values
            table = np.stack([flat.field(c).to_numpy() for c in ("i", "j", "n")], axis=1).astype(np.int64)
            new = [_moved(x, y, table[ends[k] : ends[k + 1]], moved_run, stray_run) for k, (x, y) in enumerate(_word_numbers(batch))]
            new = [m[np.lexsort((m[:, 0], m[:, 1]))] for m in new]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(new, ["i", "j", "n"], pa.int32())], [*batch.schema.names, "moves"])

    fields = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return found.mapInArrow(moved, f"{fields}, moves array<struct<i: int, j: int, n: int>>")


def move_ranges(found: DataFrame) -> DataFrame:
    """A, b, move_no, o_lo, o_hi, r_lo, r_hi (half-open) of the moves, in the order of the revision."""
    each = found.select(*PAIR, F.posexplode("moves").alias("k", "m"))
    hi = lambda c: F.col(f"m.{c}") + F.col("m.n")
    return each.select(*PAIR, (F.col("k") + 1).alias("move_no"), F.col("m.i").alias("o_lo"), hi("i").alias("o_hi"), F.col("m.j").alias("r_lo"), hi("j").alias("r_hi"))


def kept_changes(n_a: int, n_b: int, runs: np.ndarray, moves: np.ndarray, near: int = NEAR) -> list[tuple[int, ...]]:
    """The ranges of the changes of what didn't move, in places of all words."""
    stay = [~_covered(size, moves[:, c], moves[:, 2]) for c, size in ((0, n_a), (1, n_b))]
    k = np.arange(runs[:, 2].sum()) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    i, j = (np.repeat(runs[:, c], runs[:, 2]) + k for c in (0, 1))
    kept = stay[0][i] & stay[1][j]
    new, old = [np.cumsum(s) - 1 for s in stay], [np.nonzero(s)[0] for s in stay]
    i, j = np.append(new[0][i[kept]], len(old[0])), np.append(new[1][j[kept]], len(old[1]))
    lo_i, lo_j = np.append(0, i[:-1] + 1), np.append(0, j[:-1] + 1)
    some = (i > lo_i) | (j > lo_j)
    found = []
    for o_lo, o_hi, r_lo, r_hi in np.stack([lo_i, i, lo_j, j], axis=1)[some].tolist():
        if found and o_lo - found[-1][1] <= near:
            found[-1][1], found[-1][3] = o_hi, r_hi
        else:
            found.append([o_lo, o_hi, r_lo, r_hi])

    def place(side: int, lo: int, hi: int) -> tuple[int, int]:
        """A range begins at its first word, an empty one after the word before it."""
        end = int(old[side][hi - 1]) + 1 if hi else 0
        return end if lo == hi else int(old[side][lo]), end

    return [(*place(0, o_lo, o_hi), *place(1, r_lo, r_hi)) for o_lo, o_hi, r_lo, r_hi in found]


def changes_but_moves(found: DataFrame, near: int = NEAR) -> DataFrame:
    """The changes of what didn't move, in places of all words; ``found`` has moves."""

    def ranges(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for a, b, n_a, n_b, runs, moves in batch[[*PAIR, "n_a", "n_b", "runs", "moves"]].itertuples(index=False):
                runs, moves = (np.array([(r["i"], r["j"], r["n"]) for r in t], np.int64).reshape(-1, 3) for t in (runs, moves))
                out += [(a, b, no, *c) for no, c in enumerate(kept_changes(n_a, n_b, runs, moves, near), 1)]
            yield pd.DataFrame(out, columns=[*PAIR, "change_no", *RANGES])

    return found.select(*PAIR, "n_a", "n_b", "runs", "moves").mapInPandas(ranges, "a long, b long, change_no long, o_lo long, o_hi long, r_lo long, r_hi long")


def listed(found: DataFrame) -> DataFrame:
    """The changes of a pair as one row: a, b, cs."""
    return found.groupBy(*PAIR).agg(F.collect_list(F.struct("change_no", *RANGES)).alias("cs"))


def slid_changes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Changes on one side only, moved by ``SLIDE`` words at most to start at a line's start."""
    rows = with_keys(pair_rows(listed(found), docs, "text", "starts"))
    each = F.transform("cs", lambda c: F.struct(c.alias("c"), _shift(c, F.lit(SLIDE), F.lit(SLIDE)).cast("long").alias("shift")))
    return rows.select(*PAIR, F.inline(each)).select(*PAIR, "c.change_no", *((F.col(f"c.{x}") + F.col("shift")).alias(x) for x in RANGES), "shift")


def change_report(found: DataFrame, docs: DataFrame, most: int = REPORT_WORDS) -> DataFrame:
    """Removed and added words (at most ``most`` of each) of every change."""
    said = lambda c, doc, lo, hi: F.array_join(F.slice(f"words_{doc}", (c[lo] + 1).cast("int"), F.least(c[hi] - c[lo], F.lit(most)).cast("int")), " ")
    kind = lambda c: F.when(c["o_hi"] == c["o_lo"], "added").when(c["r_hi"] == c["r_lo"], "removed").otherwise("changed")
    each = lambda c: F.struct(c["change_no"].alias("change_no"), kind(c).alias("kind"), said(c, "a", "o_lo", "o_hi").alias("removed"), said(c, "b", "r_lo", "r_hi").alias("added"))
    return pair_rows(listed(found), docs, "words").select(*PAIR, F.inline(F.transform("cs", each)))


def change_boxes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """A, b, change_no, side, page_index, line_no, kind, x0, y0, x1, y1 (``compare.change_boxes``).

    ``docs`` has boxes: page_index, line_no, x0, y0, x1, y1 of each compared word.
    """
    rows = pair_rows(listed(found), docs, "boxes")
    key = [*PAIR, "change_no", "side"]

    def of_side(side: int, doc: str, lo: str, hi: str) -> DataFrame:
        boxes = F.col(f"boxes_{doc}")

        def words(c: Column) -> Column:
            start = F.when(c[lo] < c[hi], c[lo]).otherwise(F.greatest(c[lo] - 30, F.lit(0))).cast("int")
            end = F.greatest(c[hi], start + 1).cast("int")
            return F.struct(c["change_no"].alias("change_no"), (c[lo] == c[hi]).alias("empty"), (c[lo] > 0).alias("inside"), F.slice(boxes, start + 1, end - start).alias("ws"))

        return rows.select(*PAIR, F.lit(side).alias("side"), F.inline(F.transform("cs", words)))

    spans = of_side(0, "a", "o_lo", "o_hi").unionByName(of_side(1, "b", "r_lo", "r_hi"))
    union = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    text = spans.where("NOT empty").select(*key, F.inline("ws")).groupBy(*key, "page_index", "line_no").agg(*union).withColumn("kind", F.lit("text"))
    near = F.filter("ws", lambda w: w["page_index"] == F.element_at("ws", -1)["page_index"])
    lowest = F.array_max(F.transform(near, lambda w: F.struct(w["y1"], w["x1"], w["x0"], w["y0"], w["page_index"], w["line_no"])))
    left = F.when(F.col("inside"), F.col("w.x1") + 1).otherwise(F.col("w.x0") - 3)
    gap = spans.where("empty AND size(ws) > 0").select(*key, "inside", lowest.alias("w"))
    gap = gap.select(*key, "w.page_index", "w.line_no", left.alias("x0"), "w.y0", (left + 2).alias("x1"), "w.y1", F.lit("gap").alias("kind"))
    return text.select(*gap.columns).unionByName(gap).select(*key, "page_index", "line_no", "kind", "x0", "y0", "x1", "y1")
