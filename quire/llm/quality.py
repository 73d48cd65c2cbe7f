"""Quality rules: base counts, and a calibrated n-gram logistic regression.

The model reads hashed grams: words, word pairs (a repeated word is a pair of its own), and 3
and 4 bytes.  A text's features are the shares of its grams of each kind.  It is fitted on
``SAMPLE`` labelled rows at most, those of smallest id hash; a fifth of them, by hash, is held
out and calibrates the scores to probabilities (Platt's sigmoid).  All texts are then scored
whole, in Arrow batches, against fixed thresholds.  Without labels of both classes the model
keeps every text.

Defined results: a null or blank text has no words and fails the base rules; labels without
quality or document are left out; of a document's several labels the mean counts, from one
half upward as good; of several texts of one document the one of smallest hash trains;
repeated rows are judged alike; an empty table gives an empty result;
columns beside doc_id and text pass through ``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm import text_hash

SAMPLE = 2000
KINDS, BITS = 4, 14
DIM = 1 << BITS
SCALE, STEPS, RATE, PENALTY = 30.0, 100, 0.05, 1e-5
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY = 10, 20, 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Model(NamedTuple):
    weights: np.ndarray  # KINDS x DIM
    bias: float
    slope: float  # of the calibration
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


def _index(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(part: text_hash.Slice, found: text_hash.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, document) of the grams of each kind."""
    out = [(_index(found.hash), found.doc)]
    pair = text_hash.mix(found.hash[:-1] + np.uint64(2)) + found.hash[1:]
    pair[found.hash[1:] == found.hash[:-1]] = 7
    same = found.doc[1:] == found.doc[:-1]
    out.append((_index(pair[same]), found.doc[1:][same]))
    n, lengths = len(part.data), np.diff(part.offsets)
    owner = np.repeat(np.arange(part.docs), lengths)
    data = part.data.astype(np.uint64)
    for k in (3, 4):
        if n < k:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = (h << np.uint64(8)) | data[j : n - k + 1 + j]
        inner = owner[: n - k + 1] == owner[k - 1 :]
        out.append((_index(h[inner]), owner[: n - k + 1][inner]))
    return out


def scores(model: Model, part: text_hash.Slice, found: text_hash.Words) -> np.ndarray:
    total = np.full(part.docs, model.bias)
    for kind, (index, doc) in enumerate(grams(part, found)):
        count = np.bincount(doc, minlength=part.docs)
        total += SCALE * np.bincount(doc, weights=model.weights[kind][index], minlength=part.docs) / np.maximum(count, 1)
    return total


def calibrate(held: np.ndarray, good: np.ndarray, ridge: float = 0.05, steps: int = 400) -> tuple[float, float]:
    """Slope and shift of the sigmoid that turns scores into probabilities (targets held off 0 and 1)."""
    n1, n0 = int(good.sum()), int((~good).sum())
    spread = float(held.std()) if len(held) else 0.0
    if not n1 or not n0 or not spread:
        return 1.0, 0.0
    x, target = held / spread, np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(steps):  # gradient steps at a rate below the curvature's bound
        d = 1 / (1 + np.exp(-np.clip(slope * x + shift, -40, 40))) - target
        slope, shift = slope - (d * x).mean() - ridge * slope / len(x), shift - d.mean()
    return (slope / spread, shift) if slope > 0 else (1.0, 0.0)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cells in order, shares) of each text: SCALE times the part of its grams of a kind that fall into a cell."""
    width, out = KINDS * DIM, []
    for part in text_hash.slices(texts):
        cells, shares = [], []
        for kind, (index, doc) in enumerate(grams(part, text_hash.words(part, folded=False))):
            count = np.bincount(doc, minlength=part.docs)
            cell, times = np.unique(doc * width + kind * DIM + index, return_counts=True)
            cells.append(cell), shares.append((SCALE * times / np.maximum(count, 1)[cell // width]).astype(np.float32))
        cells, shares = np.concatenate(cells), np.concatenate(shares)
        order = np.argsort(cells, kind="stable")
        cells, shares = cells[order], shares[order]
        cuts = np.searchsorted(cells, np.arange(part.docs + 1) * width)
        out += [((cells[x:y] % width).astype(np.int32), shares[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def fit(found: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> Model:
    """A calibrated model of labelled texts, given by their features; the last fifth calibrates."""
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c, _ in found])
    columns, values = np.concatenate([c for c, _ in found]), np.concatenate([v for _, v in found])
    n, cut = len(found), len(found) - len(found) // 5
    used = int(np.searchsorted(rows, cut))
    r, c, v, y = rows[:used], columns[:used], values[:used], good[:cut].astype(float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both classes count alike
    w, b = np.zeros(KINDS * DIM), 0.0
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(r, weights=w[c] * v, minlength=cut) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(c, weights=err[r] * v, minlength=len(w)) + PENALTY * w, err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = np.bincount(rows, weights=w[columns] * values, minlength=n) + b
    held, truth = z[cut:], good[cut:].astype(float)
    slope, shift = calibrate(z[cut:], good[cut:])
    return Model(w.reshape(KINDS, DIM), float(b), float(slope), float(shift))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents, in the order of their id hashes.

    Tasks make the features, so the driver sees no texts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")  # at most ``limit`` rows
    one = rows.groupBy("doc_id", "good").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column(3))
            cells, shares = (pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float32())))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), cells, shares], ["h", "doc_id", "good", "cells", "shares"])

    keyed = one.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "good", "text")
    got = keyed.mapInArrow(run, "h long, doc_id long, good boolean, cells array<int>, shares array<float>").toArrow()
    order = np.lexsort((got.column("doc_id").to_numpy(), got.column("h").to_numpy()))
    cells, shares = got.column("cells").combine_chunks(), got.column("shares").combine_chunks()
    return [(cells[k].values.to_numpy(), shares[k].values.to_numpy()) for k in order.tolist()], np.array(got.column("good").to_pylist(), bool)[order]


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    found, good = labelled_sample(docs, labels, limit)
    if not 0 < good.sum() < len(good):
        return Model(np.zeros((KINDS, DIM)), 20.0, 1.0, 0.0)
    return fit(found, good)


def base_counts(part: text_hash.Slice, found: text_hash.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the documents of a slice."""
    m, data, offsets = part.docs, part.data, part.offsets

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    blank = text_hash.IS_BLANK[data]
    out = {"n_words": np.bincount(found.doc, minlength=m), "word_chars": per_doc(~blank & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[data])}
    # lines: they start where a document does or after a line end
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    owner = np.sort(np.concatenate([np.arange(m), np.searchsorted(offsets, breaks, "right") - 1]))
    ends = np.append(starts[1:], offsets[-1])
    ends = ends - (np.append(owner[1:], m) == owner)  # all but a document's last line have a line end
    solid = np.concatenate([[0], np.cumsum(~blank)])
    worded = solid[ends] > solid[starts]
    h = text_hash.span_hash(text_hash.running(data, folded=False), starts, ends)[worded]
    d = owner[worded]
    order = np.lexsort((h, d))
    again = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    out["n_dup_lines"] = np.bincount(d[order][1:][again], minlength=m)
    n = len(found.hash)
    repeated = np.zeros(m, np.int64)
    if n >= 5:
        w = found.hash[: n - 4]
        for j in range(1, 5):
            w = text_hash.mix(w) + found.hash[j : n - 4 + j]
        at = np.flatnonzero(found.doc[: n - 4] == found.doc[4:])
        order = at[np.lexsort((w[at], found.doc[at]))]
        same = (w[order][1:] == w[order][:-1]) & (found.doc[order][1:] == found.doc[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(n + 1, np.int64)
        edge[order[twice]] += 1  # window starts are distinct
        edge[order[twice] + 5] -= 1
        repeated = np.bincount(found.doc[np.cumsum(edge[:-1]) > 0], minlength=m)
    out["n_repeat_words"] = repeated
    return out


def judge(docs: DataFrame, model: Model, prefix: str = "_q_") -> DataFrame:
    """``docs`` with the base counts, base_failed, probability and kept as more columns, whose names begin with ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # KINDS * DIM weights
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    columns = [*names, "base_failed", "probability", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in text_hash.slices(batch.column(at)):
                found = text_hash.words(part, folded=False)
                counts = base_counts(part, found)
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])
                p = shared.value.probability(scores(shared.value, part, found))
                new = [*(pa.array(counts[x].astype(np.int64)) for x in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= LEAST_PROBABILITY))]
                rows = batch.slice(part.first, part.docs)
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*batch.schema.names, *(prefix + x for x in columns)])

    schema = StructType(list(docs.schema.fields))
    for x in names:
        schema = schema.add(prefix + x, "long")
    schema = schema.add(prefix + "base_failed", "boolean").add(prefix + "probability", "double").add(prefix + "kept", "boolean")
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the model keep."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return judge(docs, train(docs, labels), prefix).where(F.col(prefix + "kept")).select(*docs.columns)
