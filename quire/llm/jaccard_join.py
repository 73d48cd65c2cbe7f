"""Exact n-gram Jaccard join and its link components: a size-aware heavy-light join.

Sets are the distinct k-word shingles of a text.  Equal sets are one class with one
representative; classes meet through keys.

* Small sets (light) enumerate fixed-size subsets: sets that link share a subset that is
  either one less a few members, so equal subset keys are the meeting places.
* Large sets (heavy) go into inverted lists of their rarest members; sets that link share one
  of these under any common order of the members.  The order comes from counts of all
  shingles in a fixed number of hashed buckets, rare ones first.
* The boundary is the largest size for which enumerating subsets costs less than scanning
  lists of the expected length.

A place of two sets is a pair.  Other places can hold thousands, so their pairs are made in
rounds.  In the first rounds each set outside its places' main components meets one set of
these, the one it shares most places with, and the links found are joined into components.
In the last round all sets outside a place's main component meet all others of that place that
are still in another component: pairs within a component can add nothing.  Bounds that never lose a link thin the
pairs: on sizes, on 256-bit parities of the sets, then on parities of a bit a member (sets
differ in at least as many members as their parities do in bits).  The rest are decided on the
whole texts.

Defined results: texts without words (null, empty, blank) have the empty set and link with
nothing; fewer than k words are one shingle; equal texts link whatever their length; rows
without doc_id take part as nodes after all others (``store.node_id``); rows that repeat a
doc_id are one document, which links through any of their texts; an empty table gives an empty
result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import text_hash
from quire.llm.components import components
from quire.llm.store import few, node_id, saved, unused

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
#: Larger sets never enumerate, whatever lists cost.
MOST_ENUMERATED = 30
#: Sets that meet one other set in one group.
SPREAD = 64
#: Rounds in which a set meets one other.
LIGHT_ROUNDS = 3
_FEATURES = "id long, n long, set_a long, set_b long, s0 long, s1 long, s2 long, s3 long, wide binary, keys array<long>"


def _counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all documents fall into each bucket; BUCKETS numbers in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in text_hash.slices(batch.column(0)):
                _, h = text_hash.shingles(text_hash.words(part), k, part.docs)
                total += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def _deletions(n: int, p: int, q: int) -> int:
    """Most members of a set of n that may be missing from a set it links with: a <= (n - a)(q - p) / p."""
    return n * (q - p) // q


def boundary(counts: np.ndarray, p: int, q: int) -> int:
    """Largest set size whose subsets cost less than lists of the expected length."""
    total = counts.sum()
    pairs = max(0.0, (counts.astype(float) ** 2).sum() - float(total) ** 2 / BUCKETS)
    length = max(1.0, pairs / max(1, total))
    best = 0
    for n in range(1, MOST_ENUMERATED + 1):
        subsets = sum(comb(n, a) for a in range(_deletions(n, p, q) + 1))
        if subsets > (n - -(-p * n // q) + 1) * length and subsets > n + 1:
            break
        best = n
    return best


def _subset_keys(h: np.ndarray, p: int, q: int) -> np.ndarray:
    """A key for the set and for every subset that a linked set may share with it."""
    with np.errstate(over="ignore"):
        whole, n = h.sum(dtype=np.uint64), len(h)
        keys = [text_hash.mix(np.array([whole + np.uint64(n)], np.uint64))]
        for a in range(1, _deletions(n, p, q) + 1):
            gone = np.array(list(combinations(range(n), a)))
            keys.append(text_hash.mix(whole - h[gone].sum(axis=1, dtype=np.uint64) + np.uint64(n - a)))
    return np.concatenate(keys)


def _features(docs: DataFrame, k: int, p: int, q: int, counts: np.ndarray, bound: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            for part in text_hash.slices(batch.column(1)):
                m = part.docs
                d, h = text_hash.shingles(text_hash.words(part), k, m)
                n = np.bincount(d, minlength=m)
                first = np.concatenate([[0], np.cumsum(n)])
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(text_hash.mix(h), out=sums[0, 1:])
                np.cumsum(text_hash.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
                sets = sums[:, first[1:]] - sums[:, first[:-1]]
                bits = (np.bincount(d * 256 + ((h >> np.uint64(20)) & np.uint64(255)).astype(np.int64), minlength=256 * m) & 1).astype(np.uint8)
                parity = np.packbits(bits.reshape(m, 256), axis=1).reshape(m, 4, 8).view(np.int64).reshape(m, 4)
                size = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
                at = np.concatenate([[0], np.cumsum(size)])
                wide = np.packbits((np.bincount(at[d] + ((h >> np.uint64(8)).astype(np.int64) & (size[d] - 1)), minlength=at[-1]) & 1).astype(np.uint8))
                order = np.lexsort((h, rank[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], d))
                within = np.arange(len(h)) - first[d]
                listed = np.where((n > bound) | (q * n >= p * (bound + 1)), n - -(-p * n // q) + 1, 0)
                take = within < listed[d]
                keys, owner = [h[order][take]], [d[take]]
                for x in np.flatnonzero((n > 0) & (n <= bound)):
                    keys.append(_subset_keys(h[first[x] : first[x + 1]], p, q))
                    owner.append(np.full(len(keys[-1]), x))
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                by = np.argsort(owner, kind="stable")
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))]).astype(np.int32), pa.array(keys[by].view(np.int64)))
                ids = batch.column(0).slice(part.first, m)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), *(pa.array(s.view(np.int64)) for s in sets), *(pa.array(parity[:, j].copy()) for j in range(4)), pa.array([wide[at[x] // 8 : at[x + 1] // 8].tobytes() for x in range(m)], pa.binary()), lists], ["id", "n", "set_a", "set_b", "s0", "s1", "s2", "s3", "wide", "keys"])

    return docs.select(node_id().alias("id"), "text").mapInArrow(run, _FEATURES)


def _may_link(p: int, q: int) -> Column:
    """Bounds on sizes and parities that every linked pair x, y meets."""
    parity = sum((F.bit_count(F.col(f"x.s{j}").bitwiseXOR(F.col(f"y.s{j}"))) for j in range(4)), F.lit(0))
    nx, ny = F.col("x.n"), F.col("y.n")
    return (nx * q >= ny * p) & (ny * q >= nx * p) & (parity * (p + q) <= (nx + ny) * (q - p))


def _spread(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` in groups (b, salt) of about ``SPREAD`` at most, so that no one task gets all that meet one set."""
    busy = saved(pairs.groupBy("b").agg(F.count("*").alias("m")).where(F.col("m") > SPREAD).select("b", F.ceil(F.col("m") / SPREAD).alias("salts")), "busy")
    return pairs.join(few(busy), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))


def _near(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """Those of ``pairs(a, b, salt)`` whose wide parities don't differ by more than links allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (nx, ny, x, y) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3, 7)), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(x) != len(y):  # the wider one folds onto half its bits
                    if len(x) > len(y):
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                    else:
                        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                if int(np.bitwise_count(x ^ y).sum()) * (p + q) <= (nx + ny) * (q - p):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(j).take(rows) for j in range(3)], ["a", "b", "salt"])

    x, y = (sketches.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("wide").alias("w" + c)) for c in ("a", "b"))
    hubs = pairs.select("b", "salt").distinct().join(y, "b")
    both = pairs.join(x, "a").join(hubs, ["b", "salt"])
    return both.select("a", "b", "salt", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long, salt int").distinct()


def _links(pairs: DataFrame, docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Those of ``pairs(a, b, salt)`` whose sets have q * intersection >= p * union.

    Only texts that are in a pair move: each once for every group it is in, to the text of the group's ``b``.
    """

    def close(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return q * both >= p * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in batches:
            b, salt, role = (batch.column(j).to_numpy() for j in range(3))
            good = []
            for part in text_hash.slices(batch.column(4)):
                d, h = text_hash.shingles(text_hash.words(part), k, part.docs)
                cut = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=part.docs))])
                for x in range(part.docs):
                    row, own = part.first + x, h[cut[x] : cut[x + 1]]
                    if (b[row], salt[row]) != group:
                        group, hubs = (b[row], salt[row]), []
                    if role[row] == 0:
                        hubs.append(own)
                    elif any(close(own, hub) for hub in hubs):
                        good.append(row)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(keep), batch.column(0).take(keep)], ["a", "b"])

    hubs = pairs.select(F.col("b").alias("id"), "b", "salt", F.lit(0).alias("role")).distinct()
    ways = saved(hubs.unionAll(pairs.select(F.col("a").alias("id"), "b", "salt", F.lit(1).alias("role"))), "meetings")
    texts = docs.select(node_id().alias("id"), "text").join(few(ways), "id").select("b", "salt", "role", "id", "text")
    return texts.repartition("b", "salt").sortWithinPartitions("b", "salt", "role").mapInArrow(run, "a long, b long")


_SKETCH = ["n", "s0", "s1", "s2", "s3"]


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    x = sketches.select(F.col("id").alias("a"), F.struct(*_SKETCH).alias("x"))
    y = sketches.select(F.col("id").alias("b"), F.struct(*_SKETCH).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def _main_parts(placed: DataFrame) -> DataFrame:
    """key, main and low: the component with most sets of every place that has several, and its smallest set there."""
    per_part = placed.groupBy("key", "part").agg(F.count("*").alias("m"), F.min("id").alias("low"))
    main = per_part.groupBy("key").agg(F.max_by(F.struct("part", "low"), F.struct("m", -F.col("part"))).alias("main"), F.count("*").alias("parts"))
    return main.where("parts > 1").select("key", F.col("main.part").alias("main"), F.col("main.low").alias("low"))


def link_components(docs: DataFrame, k: int = 3, p: int = 9, q: int = 10) -> DataFrame:
    """id, n_shingles, component_id of every row; two sets link at Jaccard similarity p / q."""
    docs = docs.select("doc_id", "text")
    counts = _counts(docs, k)
    bound = boundary(counts, p, q)
    rows = saved(_features(docs, k, p, q, counts, bound), "features")
    sketches = rows.select("id", *_SKETCH, "wide")
    classes = saved(rows.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes")
    copied = classes.where("rep != last").select("set_a", "set_b", "n", "rep")
    copies = saved(rows.join(copied, ["set_a", "set_b", "n"]).where("id != rep").select("id", "set_a", "rep"), "copies")
    sets = rows.where("n > 0").join(few(copies.select("id", "set_a")), ["id", "set_a"], "left_anti")  # one row a class

    keyed = sets.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    places = saved(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m")).where("low != high"), "places")
    duos = places.where("m = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    met = saved(keyed.join(few(places.where("m > 2").select("key")), "key").select("key", "id"), "met")

    doubled = rows.groupBy("id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x != y").select("id")
    links = copies.join(doubled, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    parts, settled = None, False
    for step in range(LIGHT_ROUNDS + 1):
        if settled and step < LIGHT_ROUNDS:
            continue
        placed = met.withColumn("part", F.col("id"))
        if parts is not None:
            placed = met.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
            placed = saved(placed, "placed")
        strays = placed.join(few(saved(_main_parts(placed), "main-parts")), "key").where("part != main")
        if step < LIGHT_ROUNDS:
            shared = strays.select(F.col("id").alias("a"), F.col("low").alias("b")).groupBy("a", "b").agg(F.count("*").alias("places"))
            likely = _sketched(shared, sketches).where(_may_link(p, q)).select("a", "b", "places")
            pairs = likely.groupBy("a").agg(F.max_by("b", F.struct("places", "b")).alias("b"))
            if step == 0:
                pairs = pairs.unionByName(_sketched(duos, sketches).where(_may_link(p, q)).select("a", "b")).distinct()
        else:
            strays = saved(strays.select("key", F.col("id").alias("a"), F.col("part").alias("part_a"), "main"), "strays")
            others = placed.join(strays.select("key").distinct(), "key").select("key", F.col("id").alias("b"), F.col("part").alias("part_b"))
            x = strays.join(sketches.select(F.col("id").alias("a"), F.struct(*_SKETCH).alias("x")), "a")
            y = others.join(sketches.select(F.col("id").alias("b"), F.struct(*_SKETCH).alias("y")), "b")
            cross = (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main")) | (F.col("a") < F.col("b")))
            pairs = x.join(y, "key").where(cross & _may_link(p, q)).select("a", "b").distinct()
        near = saved(_near(saved(_spread(saved(pairs, "pairs")), "groups"), sketches, p, q), "near-pairs")
        new = saved(_links(near, docs, k, p, q), "links")
        settled = not new.limit(1).count()
        if settled and step:
            continue
        links = links.unionAll(new)
        parts = components(links)

    of_set = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    return rows.select("id", "n", "set_a", "set_b").join(of_set, ["set_a", "set_b", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """``docs`` with the smallest id of every component only; rows that repeat a document stay or go with it."""
    parts = link_components(docs, k, p, q)
    gone = saved(parts.where("component_id != id").select("id").distinct(), "gone")
    own = unused("node", docs)
    return docs.withColumn(own, node_id()).join(few(gone.withColumnRenamed("id", own)), own, "left_anti").select(*docs.columns)
