"""Cross-tokenizer alignment: the tokens of two vocabularies in groups between shared byte ends.

A text gets byte-level BPE tokens (A) and SentencePiece tokens (B).  Where a token of each ends
at the same byte, both sequences can be cut.  The cuts are found by divide and conquer: an
interval of tokens whose ends are shared is probed at the A end nearest its middle, then at
those beside it, each looked up among the B ends by bisection; at the first shared one both
halves go on.  An interval without a shared end inside is a leaf group.  The intervals of many
documents are probed together.

Tokens of one group are linked, each of A with each of B.  Every document's distinct pairs of
ids are kept in a scratch table; from it, how many documents hold a pair is counted, and the
documents then meet the counts: pairs that many documents hold (``HOT_PAIRS`` at most) go to
every task, the others are few in any document and are joined by shuffle.  No pair that is
joined so is a hot key, since every pair that many documents hold is among the others.

Defined results: a null or empty text, and one whose A or B tokens don't join to its bytes
(with the space in front), has no tokens and only zeros; strings of special tokens are plain
text; repeated rows are documents of their own; texts of any length are aligned whole; an
empty table gives an empty result; columns beside the id and the text are left alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import saved

SPACE = "▁"
#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Text bytes that are aligned together; a longer document is alone.
SLICE_BYTES = 1 << 19
#: Pairs that are sent to every task.
HOT_PAIRS = 1_000_000
#: Pairs that a task holds before it sends their counts on.
HELD_PAIRS = 2_000_000
#: Groups of more links are counted by their distinct ids.
WIDE_GROUP = 64
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies(NamedTuple):
    """The contents of both vocabulary files."""

    a: str  # tokenizers JSON
    b: bytes  # SentencePiece model


def read_vocabularies(a_path: str, b_path: str) -> Vocabularies:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Vocabularies(a.read(), b.read())


class Encoders:
    """Encoders of a worker, with the bytes of every token."""

    def __init__(self, files: Vocabularies):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        own, letters = json.loads(files.a), byte_alphabet()
        cutter = own["pre_tokenizer"] or {}
        if own["model"]["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or own["normalizer"]:
            raise ValueError("A has to be a byte-level BPE vocabulary without a normalizer")
        known, merges = own["model"]["vocab"], [x if isinstance(x, str) else " ".join(x) for x in own["model"]["merges"]]
        if any(known[x.replace(" ", "")] != len(letters) + k for k, x in enumerate(merges)):
            raise ValueError("the ids of A have to follow its merges")
        self.a_bytes = [b""] * len(known)
        for token, i in known.items():
            self.a_bytes[i] = bytes([letters[c] for c in token])
        self.a = Encoding("a", pat_str=PIECES, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes)}, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=files.b)
        self.b_bytes = [b""] * self.b.get_piece_size()
        for i in range(len(self.b_bytes)):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of " " + text in A and of text in B; none for a text whose tokens don't join to its bytes."""
        none = np.zeros(0, np.uint32)
        out = []
        for text, pieces in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw = (" " + text).encode()
            if not text or b"".join(map(self.b_bytes.__getitem__, pieces)) != raw:
                out.append((none, none))
                continue
            ids = self.a.encode_to_numpy(raw.decode(), disallowed_special=())
            out.append((ids, np.array(pieces, np.uint32)) if self.a_lengths[ids].sum() == len(raw) else (none, none))
        return out


_encoders: dict[int, Encoders] = {}


def encoders(files: Vocabularies) -> Encoders:
    key = hash(files)
    if key not in _encoders:
        _encoders[key] = Encoders(files)
    return _encoders[key]


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (of A, of B) that end at a shared byte, in order.

    ``a_ends`` and ``b_ends`` rise over all documents of a slice; intervals begin between the
    ``a_cuts`` and ``b_cuts``, how many tokens there are up to each document's start and end.
    """
    low, high, b_low, b_high = a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]
    some = high > low
    found_a, found_b = [high[some] - 1], [b_high[some] - 1]
    low, high, b_low, b_high = (x[some] for x in (low, high, b_low, b_high))
    tried = np.zeros(len(low), np.int64)
    while True:
        middle = (low + high) // 2 - 1
        at = middle + np.where(tried & 1, (tried + 1) // 2, -(tried // 2))  # the middle, then by turns after and before it
        inner = (high - low > 1) & (b_high - b_low > 1) & (tried < 2 * (high - low))
        low, high, b_low, b_high, tried, at = (x[inner] for x in (low, high, b_low, b_high, tried, at))
        if not len(low):
            break
        inside = (at >= low) & (at < high - 1)
        end = a_ends[np.where(inside, at, low)]
        b_at = np.searchsorted(b_ends, end)
        hit = inside & (b_ends[b_at] == end)
        found_a.append(at[hit])
        found_b.append(b_at[hit])
        miss, cut, b_cut = ~hit, at[hit] + 1, b_at[hit] + 1
        low, high = np.concatenate([low[miss], low[hit], cut]), np.concatenate([high[miss], cut, high[hit]])
        b_low, b_high = np.concatenate([b_low[miss], b_low[hit], b_cut]), np.concatenate([b_high[miss], b_cut, b_high[hit]])
        tried = np.concatenate([tried[miss] + 1, np.zeros(2 * len(cut), np.int64)])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a)
    return a[order], b[order]


class Aligned(NamedTuple):
    """Documents of a slice."""

    a: np.ndarray  # ids of all documents, one after another
    b: np.ndarray
    a_cuts: np.ndarray  # tokens up to each document
    b_cuts: np.ndarray
    a_starts: np.ndarray  # first token of each group, and the end
    b_starts: np.ndarray
    doc: np.ndarray  # of each group

    @property
    def docs(self) -> int:
        return len(self.a_cuts) - 1

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_starts), np.diff(self.b_starts)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id, B id, how often) of the distinct linked pairs of each document, sorted."""
        na, nb = self.sizes()
        many = na * nb
        g = np.flatnonzero(many <= WIDE_GROUP)
        of = np.repeat(g, many[g])
        k = np.arange(len(of)) - np.repeat(np.cumsum(many[g]) - many[g], many[g])
        docs, a, b, times = [self.doc[of]], [self.a[self.a_starts[of] + k // nb[of]]], [self.b[self.b_starts[of] + k % nb[of]]], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(many > WIDE_GROUP):
            x, nx = np.unique(self.a[self.a_starts[g] : self.a_starts[g + 1]], return_counts=True)
            y, ny = np.unique(self.b[self.b_starts[g] : self.b_starts[g + 1]], return_counts=True)
            docs.append(np.full(len(x) * len(y), self.doc[g])), a.append(np.repeat(x, len(y))), b.append(np.tile(y, len(x))), times.append(np.outer(nx, ny).ravel())
        docs, a, b, times = (np.concatenate(x) for x in (docs, a, b, times))
        if not len(docs):
            return docs, a, b, times
        pair = a.astype(np.int64) << 32 | b
        order = np.lexsort((pair, docs))
        docs, pair, times = docs[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pair[1:] != pair[:-1])]))
        return docs[first], pair[first] >> 32, pair[first] & 0xFFFFFFFF, np.add.reduceat(times, first)

    def texts(self) -> list[bytes]:
        """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
        na, nb = self.sizes()
        group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        at_a, at_b = np.arange(len(self.a)) + self.b_starts[group_a], np.arange(len(self.b)) + self.a_starts[group_b + 1]
        ids = np.zeros(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        after = np.full(len(ids), ord(","), np.uint8)
        after[at_a[self.a_starts[1:] - 1]] = ord("|")
        after[at_b[self.b_starts[1:] - 1]] = ord(";")
        tens = 10 ** np.arange(len(str(ids.max(initial=0))) - 1, -1, -1)
        letters = np.concatenate([(ids[:, None] // tens % 10 + 48).astype(np.uint8), after[:, None]], axis=1)
        shown = np.concatenate([ids[:, None] >= tens, np.ones((len(ids), 1), bool)], axis=1)
        shown[:, -2] = True  # 0 has a digit
        raw, ends = letters[shown].tobytes(), np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
        cuts = ends[self.a_cuts + self.b_cuts].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def aligned(coder: Encoders, texts: list[str]) -> Aligned:
    """The alignment of documents."""
    sides = list(zip(*coder.encode(texts), strict=True))
    a, b = (np.concatenate(x).astype(np.int64) for x in sides)
    a_cuts, b_cuts = (np.cumsum([0, *map(len, x)]) for x in sides)
    last_a, last_b = shared_ends(np.cumsum(coder.a_lengths[a]), np.cumsum(coder.b_lengths[b]), a_cuts, b_cuts)
    a_starts, b_starts = np.concatenate([[0], last_a + 1]), np.concatenate([[0], last_b + 1])
    return Aligned(a, b, a_cuts, b_cuts, a_starts, b_starts, np.searchsorted(a_cuts, last_a, "right") - 1)


def _slices(batches: Iterator[pa.RecordBatch], coder: Encoders) -> Iterator[tuple[pa.Array, Aligned]]:
    """(ids, alignment) of the rows (id, text) in slices."""
    for batch in batches:
        at, size, texts = 0, 0, []
        for k in range(batch.num_rows):
            texts.append(batch.column(1)[k].as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_BYTES or k + 1 == batch.num_rows:
                yield batch.column(0).slice(at, len(texts)), aligned(coder, texts)
                at, size, texts = k + 1, 0, []


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _cuts(doc: np.ndarray, docs: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])


def align(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a_ids, b_ids, and of each group how many A and B tokens there are up to its end (a_upto, b_upto)."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, got in _slices(batches, encoders(shared.value)):
            groups = _cuts(got.doc, got.docs)
            upto = [_lists(starts[1:] - cuts[got.doc], groups) for starts, cuts in ((got.a_starts, got.a_cuts), (got.b_starts, got.b_cuts))]
            yield pa.RecordBatch.from_arrays([ids, _lists(got.a, got.a_cuts), _lists(got.b, got.b_cuts), *upto], ["id", "a_ids", "b_ids", "a_upto", "b_upto"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, a_upto array<int>, b_upto array<int>")


def linked_pairs(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups (decimal ids, as bytes), and the distinct linked pairs as lists a, b, times, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # vocabulary files
    names = ["id", *_NUMBERS, "groups", "a", "b", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, got in _slices(batches, encoders(shared.value)):
            na, nb = got.sizes()
            first = _cuts(got.doc, got.docs)
            n_links = np.diff(np.concatenate([[0], np.cumsum(na * nb)])[first])
            doc, a, b, times = got.links()
            cuts = _cuts(doc, got.docs)
            numbers = [np.diff(got.a_cuts), np.diff(got.b_cuts), np.diff(first), n_links]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(got.texts(), pa.binary()), _lists(a, cuts), _lists(b, cuts), _lists(times, cuts)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbers = ", ".join(f"{x} long" for x in _NUMBERS)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {numbers}, groups binary, a array<int>, b array<int>, times array<int>")


def _keys(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of list columns ``at`` and ``at + 1`` as numbers, and the row of each."""
    a, b = (batch.column(at + k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
    return a << 32 | b, np.repeat(np.arange(batch.num_rows), batch.column(at).value_lengths().to_numpy())


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (how many rows of ``pairs(a, b)`` hold the pair) and best (no pair of this A id is held by more), as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, loose, n_loose = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, place = np.unique(np.concatenate([held, *loose]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(len(place) - len(counts), np.int64)])
            return new, np.bincount(place, weights=weights, minlength=len(new)).astype(np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held >> 32), pa.array(held & 0xFFFFFFFF), pa.array(counts)], ["a", "b", "n"])

        for batch in batches:
            key, _ = _keys(batch, 0)
            loose.append(key)
            n_loose += len(key)
            if n_loose >= HELD_PAIRS:
                held, counts = merged()
                loose, n_loose = [], 0
                if len(held) >= HELD_PAIRS:
                    yield sent()
                    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, counts = merged()
        yield sent()

    parts = pairs.select("a", "b").mapInArrow(run, "a long, b long, n long")
    counts = saved(parts.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of the vocabulary
    return saved(counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def least_hot(counts: DataFrame, limit: int) -> int:
    """A number of documents that ``limit`` pairs at most reach: a power of two."""
    by_size = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("p")).agg(F.count("*").alias("m"))
    total, least = 0, None
    for r in sorted(by_size.collect(), key=lambda r: -r["p"]):  # some sixty rows
        total += r["m"]
        if total > limit:
            break
        least = r["p"]
    return 1 << 62 if least is None else 0 if total <= limit else 1 << least


def score(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 ('' without tokens) of every row."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    linked = saved(linked_pairs(docs, files, id_col, text_col).select("id", *_NUMBERS, digest, "a", "b", "times"), "linked-pairs")
    counts = pair_counts(linked)
    least = least_hot(counts, hot_pairs)
    hot = counts.where(F.col("n") >= least).toArrow()  # ``hot_pairs`` rows at most
    key = hot.column("a").to_numpy() << 32 | hot.column("b").to_numpy()
    order = np.argsort(key)
    known = docs.sparkSession.sparkContext.broadcast((key[order], hot.column("n").to_numpy()[order], hot.column("best").to_numpy()[order]))
    carried, new = ["id", *_NUMBERS, "groups_sha256"], ["n_best", "count_sum", "cold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_key, hot_n, hot_best = known.value
        for batch in batches:
            pair, row = _keys(batch, len(carried))
            times = batch.column(len(carried) + 2).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(hot_key, pair), max(0, len(hot_key) - 1))
            here = hot_key[at] == pair if len(hot_key) else np.zeros(len(pair), bool)
            ends = np.concatenate([[0], np.cumsum(batch.column(len(carried)).value_lengths().to_numpy())])

            def per_row(values: np.ndarray, ends=ends) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[ends]))

            held = np.where(here, times, 0)
            n, best = (hot_n[at], hot_best[at]) if len(hot_key) else (held, held)
            cold = ~here
            cuts = pa.array(_cuts(row[cold], batch.num_rows).astype(np.int32))
            fields = [pa.array(pair[cold] >> 32), pa.array(pair[cold] & 0xFFFFFFFF), pa.array(times[cold])]
            others = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(fields, ["a", "b", "times"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carried))), per_row(held * best), per_row(held * n), others], [*carried, *new])

    kinds = ", ".join(f"{x} {linked.schema[x].dataType.simpleString()}" for x in carried)
    scored = linked.select(*carried, "a", "b", "times").mapInArrow(run, f"{kinds}, n_best long, count_sum long, cold array<struct<a:long,b:long,times:long>>")
    if least > 0:  # some pairs didn't go to the tasks
        out = saved(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = counts.where(F.col("n") < least)
        met = out.select("row", F.inline("cold")).join(rare, ["a", "b"])
        more = met.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        scored = out.join(more, "row", "left")
        scored = scored.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return scored.select("id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
