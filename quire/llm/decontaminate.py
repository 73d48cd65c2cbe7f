"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark items.  One pass over the texts leaves, for each
document, the places of its terms; all that follows works on this table:

* frequencies of the terms over all blocks of ``BLOCK`` words, and from them idf weights
  (terms in more than ``COMMON`` of the blocks count nothing, save the ``RARE_WORDS`` rarest
  of each item);
* a distributed randomised SVD of the TF-IDF blocks of the corpus and of the items, which
  together weigh as much as the corpus: random projection, one power step, orthonormal basis,
  rotation to the singular vectors, ``SPARE`` more than there are items;
* passages are pairs of neighbouring blocks, so every span of ``BLOCK`` words lies in one.
  Passages whose latent cosine with an item reaches ``LEAST_COSINE``, and whose latent vector
  carries ``LEAST_SHARE`` of the item's, are candidates; for an item longer than a passage both
  bounds fall with the part of it that a passage can hold;
* a candidate leaks the item if the longest common subsequence of the item's words and the
  words around the passage covers ``LEAKED`` of the item, or ``PARAPHRASED`` of it with the
  item's answer (its last sentence) found in order.  Overlapping candidates are first judged
  together, by counts of words and then by the subsequence of all their words, which no single
  one can surpass; they are judged one by one only if these suffice.

Items are searched in blocks of ``ITEMS`` against all documents; the texts are scanned once for
``SEARCHES`` such blocks.  Defined results: items or
documents without words (null, empty, blank) never match; rows without doc_id keep a null one;
repeated rows are judged alike; an empty table gives an empty result; columns beside doc_id
and text pass through ``drop_leaks``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import text_hash
from quire.llm.store import few, node_id, public_id, saved, unused

#: Words of a block, items that are searched at once, and such searches for one scan of the texts.
BLOCK, ITEMS, SEARCHES = 32, 256, 64
SPARE, EXTRA, SEED = 64, 16, 11
COMMON, RARE_WORDS, LEAST_COSINE, LEAST_SHARE = 0.001, 8, 0.3, 0.25
LEAKED, PARAPHRASED, ANSWERED = 0.7, 0.5, 0.9
_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Items(NamedTuple):
    ids: list[int]
    words: list[np.ndarray]  # term numbers, in order
    answers: list[np.ndarray]
    hashes: np.ndarray  # of the terms, sorted; a term's number is its place


def read_items(rows: list[tuple[int, str]]) -> Items:
    """The items that have words; terms are numbered by their hashes."""
    rows = [(i, t) for i, t in rows if t and _BLANK.search(t)]
    hashed, answers = [], []
    for part in text_hash.slices(pa.array([t for _, t in rows], pa.string())):
        found = text_hash.words(part)
        hashed += [found.hash[found.doc == d] for d in range(part.docs)]
    for _, text in rows:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if _BLANK.search(s)]
        answers.append(len(_BLANK.findall(sentences[-1])))
    terms = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    words = [np.searchsorted(terms, h) for h in hashed]
    return Items([i for i, _ in rows], words, [w[-n:] for w, n in zip(words, answers, strict=True)], terms)


def term_places(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """id, n_words, places and terms (arrays of u32) of every document that has a term, else with empty arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # words of at most ITEMS * SEARCHES items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sieve = np.zeros(1 << 20, bool)
        sieve[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part in text_hash.slices(batch.column(1)):
                found = text_hash.words(part)
                n = np.bincount(found.doc, minlength=part.docs)
                first = np.concatenate([[0], np.cumsum(n)])
                maybe = np.flatnonzero(sieve[(found.hash >> np.uint64(44)).astype(np.int64)])
                number = np.minimum(np.searchsorted(known, found.hash[maybe]), len(known) - 1)
                hit = known[number] == found.hash[maybe]
                maybe, number = maybe[hit], number[hit]
                doc = found.doc[maybe]
                place = (maybe - first[doc]).astype("<u4")
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.docs))])
                number = number.astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.docs), pa.array(n, pa.int64()), pa.array([place[cut[x] : cut[x + 1]].tobytes() for x in range(part.docs)], pa.binary()), pa.array([number[cut[x] : cut[x + 1]].tobytes() for x in range(part.docs)], pa.binary())], ["id", "n_words", "places", "terms"])

    return docs.select(node_id().alias("id"), "text").mapInArrow(run, "id long, n_words long, places binary, terms binary")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, block and term of every place of a batch of ``term_places``, in order."""
    places, terms = ([np.frombuffer(x.as_py(), "<u4") for x in batch.column(name)] for name in ("places", "terms"))
    doc = np.repeat(np.arange(len(places)), [len(x) for x in places])
    if not len(doc):
        return doc, doc, doc
    return doc, np.concatenate(places).astype(np.int64) // BLOCK, np.concatenate(terms).astype(np.int64)


def _cells(doc: np.ndarray, block: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row (of the distinct blocks), term and count of the nonzero cells."""
    _, row = np.unique(doc * (1 << 32) + block, return_inverse=True)
    cell, count = np.unique(row * n_terms + term, return_counts=True)
    return cell // n_terms, cell % n_terms, count


def idf_weights(places: DataFrame, items: Items) -> tuple[np.ndarray, float]:
    """Weights of the terms by their frequency over all blocks of the corpus, and the number of blocks."""
    n_terms = len(items.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            total[n_terms] += int((-(-batch.column(1).to_numpy() // BLOCK)).sum())
            doc, block, term = _entries(batch)
            if len(doc):
                _, t, _ = _cells(doc, block, term, n_terms)
                total[:n_terms] += np.bincount(t, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    df = np.zeros(n_terms + 1)
    for row in places.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term
        df[row["term"]] = row["n"]
    blocks = max(df[n_terms], 1.0)
    weights = np.log((1 + blocks) / (1 + df[:n_terms]))
    common = df[:n_terms] > max(COMMON * blocks, 5)
    for words in items.words:
        own = np.unique(words)
        common[own[np.argsort(df[own], kind="stable")[:RARE_WORDS]]] = False
    weights[common] = 0.0
    return weights, blocks


def _item_rows(items: Items, weights: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(items.ids), len(weights)))
    for x, w in enumerate(items.words):
        np.add.at(rows[x], w, 1.0)
    return _unit(rows * weights)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _products(places: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum over all blocks a of outer(a, a @ basis): one distributed pass of the SVD."""
    shared = places.sparkSession.sparkContext.broadcast((weights, basis.astype(np.float32)))  # terms x rank numbers
    n_terms, width = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        total = np.zeros((n_terms, width))
        for batch in batches:
            doc, block, term = _entries(batch)
            keep = w[term] > 0
            if not keep.any():
                continue
            row, t, count = _cells(doc[keep], block[keep], term[keep], n_terms)
            value = count * w[t]
            norm = np.sqrt(np.bincount(row, weights=value * value))
            value = (value / norm[row]).astype(np.float32)
            for lo in range(0, row[-1] + 1, 2000):  # blocks in groups, as dense products stay small
                a, z = np.searchsorted(row, (lo, lo + 2000))
                y = np.add.reduceat(value[a:z, None] * b[t[a:z]], np.flatnonzero(np.diff(row[a:z], prepend=-1)))
                by = np.argsort(t[a:z], kind="stable")
                ts = t[a:z][by]
                starts = np.flatnonzero(np.diff(ts, prepend=-1))
                total[ts[starts]] += np.add.reduceat(value[a:z][by, None] * y[row[a:z][by] - row[a]], starts)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in total[at]], pa.binary())], ["term", "sums"])

    out = np.zeros((n_terms, width))
    parts = places.mapInArrow(run, "term long, sums binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[term] = sums[term] + np.frombuffer(x) if term in sums else np.frombuffer(x)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["term", "sums"])

    for row in parts.repartition("term").mapInArrow(add, "term long, sums binary").toLocalIterator():  # one row a term
        out[row["term"]] = np.frombuffer(bytes(row["sums"]))
    return out


def latent_basis(places: DataFrame, items: Items, weights: np.ndarray, blocks: float) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF blocks of corpus and items."""
    own, n = _item_rows(items, weights) * np.sqrt(blocks / len(items.ids)), len(weights)
    rank = min(len(items.ids) + SPARE, n)
    width = min(rank + EXTRA, n)
    basis = np.random.default_rng(SEED).standard_normal((n, width))
    for _ in range(2):  # the projection and a power step
        basis, _ = np.linalg.qr(_products(places, weights, basis) + own.T @ (own @ basis))
    core = basis.T @ (_products(places, weights, basis) + own.T @ (own @ basis))
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def _masks(a: np.ndarray) -> dict[int, int]:
    """The places of each term as bits."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    return at


def common_length(a: np.ndarray, b: np.ndarray, at: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``at`` are the masks of a."""
    at = _masks(a) if at is None else at
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = row & at.get(x, 0)
        if m:
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def least_bounds(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Least latent cosine and least share of each item: lower if a passage can't hold all its words."""
    held = np.minimum(1.0, 2 * BLOCK / np.array([len(w) for w in items.words]))
    return LEAST_COSINE * np.sqrt(held), LEAST_SHARE * held


class _Judge:
    """The leak rule for one item."""

    def __init__(self, words: np.ndarray, answer: np.ndarray, n_terms: int):
        self.words, self.answer = words, answer
        self.masks, self.answer_masks = _masks(words), _masks(answer)
        own, self.counts = np.unique(words, return_counts=True)
        self.number = np.full(n_terms, len(own), np.int32)
        self.number[own] = np.arange(len(own))
        self.answer_counts = np.bincount(self.number[answer], minlength=len(own))

    def leaked(self, common: int, answer: int) -> bool:
        share = common / len(self.words)
        return share >= LEAKED or share >= PARAPHRASED and len(self.answer) >= 3 and answer >= ANSWERED * len(self.answer)

    def __call__(self, near: np.ndarray) -> tuple[int, int] | None:
        """Common words with the item and with its answer, if they make a leak."""
        number = self.number[near]
        found = np.bincount(number, minlength=len(self.counts) + 1)[:-1]
        most = int(np.minimum(found, self.counts).sum())  # a common subsequence has no more words
        if not self.leaked(most, int(np.minimum(found, self.answer_counts).sum())):
            return None
        near = near[number < len(self.counts)]
        common, answer = common_length(self.words, near, self.masks), common_length(self.answer, near, self.answer_masks)
        return (common, answer) if self.leaked(common, answer) else None


def _of_items(places: DataFrame, terms: np.ndarray, items: Items) -> DataFrame:
    """``term_places`` of many items' terms as those of these items' terms."""
    if len(terms) == len(items.hashes):
        return places
    number = np.full(len(terms), -1, np.int64)
    number[np.searchsorted(terms, items.hashes)] = np.arange(len(items.hashes))
    shared = places.sparkSession.sparkContext.broadcast(number)  # words of at most ITEMS * SEARCHES items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for at, which in zip(batch.column(2), batch.column(3), strict=True):
                new = shared.value[np.frombuffer(which.as_py(), "<u4")]
                own = new >= 0
                kept.append((np.frombuffer(at.as_py(), "<u4")[own].tobytes(), new[own].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([k[j] for k in kept], pa.binary()) for j in range(2))], batch.schema.names)

    return saved(places.mapInArrow(run, places.schema), "item-places")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common (share of the item's words), answered: one row for each leaked item of a document."""
    spark = docs.sparkSession
    rows = ((r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator())
    schema = "id long, item_id long, cosine double, common double, answered boolean"
    out = spark.createDataFrame([], schema)
    while some := list(islice(rows, ITEMS * SEARCHES)):
        blocks = [items for at in range(0, len(some), ITEMS) if (items := read_items(some[at : at + ITEMS])).ids]
        if blocks:
            terms = np.unique(np.concatenate([items.hashes for items in blocks]))
            places = saved(term_places(docs, terms), "term-places")
            for items in blocks:
                out = out.unionAll(_search(_of_items(places, terms, items), items, schema))
    best = out.groupBy("id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.bool_or("answered").alias("answered"))
    return best.select("id", public_id("id").alias("doc_id"), "item_id", "cosine", "common", "answered")


def _search(places: DataFrame, items: Items, schema: str) -> DataFrame:
    n_terms = len(items.hashes)
    weights, blocks = idf_weights(places, items)
    basis = latent_basis(places, items, weights, blocks)
    latent = (_item_rows(items, weights) @ basis).astype(np.float32)
    raw = np.zeros((len(items.ids), n_terms))
    for x, w in enumerate(items.words):
        np.add.at(raw[x], w, 1.0)
    shared = places.sparkSession.sparkContext.broadcast((items, weights, basis.astype(np.float32), _unit(latent), np.linalg.norm((raw * weights) @ basis, axis=1), *least_bounds(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, b, queries, sizes, least_cosine, least_share = shared.value
        judges = [_Judge(words, answer, n_terms) for words, answer in zip(own.words, own.answers, strict=True)]
        lengths = np.array([len(words) for words in own.words])
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                doc, block, term = _entries(batch)
                keep = w[term] > 0
                if not keep.any():
                    continue
                d, k, t = doc[keep], block[keep], term[keep]
                code = d * (1 << 32) + k
                blocks, starts = np.unique(code, return_index=True)
                sums = np.add.reduceat(w[t, None].astype(np.float32) * b[t], starts)
                after = np.searchsorted(blocks, blocks + 1)
                paired = (after < len(blocks)) & (blocks[np.minimum(after, len(blocks) - 1)] == blocks + 1)
                passage = sums.copy()
                passage[paired] += sums[after[paired]]
                norm = np.linalg.norm(passage, axis=1)
                dots = passage @ queries.T
                x, q = np.nonzero((dots >= least_cosine * norm[:, None]) & (dots >= least_share * sizes))
                owner, first = blocks[x] >> 32, (blocks[x] & 0xFFFFFFFF) * BLOCK
                place = (doc << 32) + np.concatenate([np.frombuffer(v.as_py(), "<u4") for v in batch.column(2)])
                lo_place = (owner << 32) + np.maximum(0, first - lengths[q])
                a, z = np.searchsorted(place, lo_place), np.searchsorted(place, (owner << 32) + first + 2 * BLOCK + lengths[q])
                enough = np.flatnonzero(z - a >= PARAPHRASED * lengths[q])  # fewer words can't hold a leak
                enough = enough[np.lexsort((x[enough], q[enough], owner[enough]))]
                x, q, owner, a, z = x[enough], q[enough], owner[enough], a[enough], z[enough]
                apart = np.ones(len(x), bool)
                apart[1:] = (owner[1:] != owner[:-1]) | (q[1:] != q[:-1]) | (a[1:] >= z[:-1])
                runs = [*np.flatnonzero(apart).tolist(), len(x)]
                found = []
                ids = batch.column(0).to_pylist()
                for from_, to in zip(runs[:-1], runs[1:], strict=True):
                    q1 = int(q[from_])
                    judge = judges[q1]
                    if to - from_ > 1 and judge(term[a[from_] : z[to - 1]]) is None:
                        continue
                    for k in range(from_, to):
                        got = judge(term[a[k] : z[k]])
                        if got is not None:
                            answered = got[1] >= ANSWERED * len(judge.answer)
                            found.append((ids[owner[k]], own.ids[q1], float(dots[x[k], q1] / max(norm[x[k]], 1e-12)), got[0] / len(judge.words), answered))
                if found:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], ["id", "item_id", "cosine", "common", "answered"])

    return places.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    own = unused("node", docs)
    bad = saved(leaks(docs, benchmark).select(F.col("id").alias(own)).distinct(), "leaking-documents")
    return docs.withColumn(own, node_id()).join(few(bad), own, "left_anti").select(*docs.columns)
