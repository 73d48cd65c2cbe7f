"""Vector code compression: product codes whose nearest entries are found in a GNAT.

Components become integers floor(1024 * x); a vector is cut into equal consecutive parts, and
each part position has a codebook, begun with the vectors of smallest ids and refined in
rounds of assigning and averaging, all in integers.

The entries of a codebook stand in a geometric near-neighbour access tree: a node has split
points, every other entry is in the subtree of its nearest split point, and for each pair of
split point and subtree the node keeps the least and greatest distance between them.  A query
knows its distance to the split points, and the best distance so far; a subtree whose range
lies outside is left out whole.  Only strictly farther subtrees are: ranges and radius are
rounded outward, and the entries that remain are compared by integer squared distance, then by
index.  Queries of a batch walk the tree together.

Each round is one scan: tasks give sums per entry, Spark adds them, and the driver holds
nothing but codebooks.

Defined results: rows whose vector is null or holds null, NaN or infinity are left out, as are
vectors of another length than that of the smallest id, or of a norm of 2^20 or more, whose
squares no longer fit.  Ids that repeat are rows of their own, ordered by components; rows
without id come after all others.  Fewer rows than entries make a smaller codebook; parts with
no rows keep their entry; a length that the number of parts does not divide is an error; an
empty table gives an empty result; other columns pass ``encode`` by, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import BROADCAST_ROWS, few, saved

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Split points of a node; entries of a leaf.
DEGREE, LEAF = 16, 24
#: Vectors that walk the trees together.
BLOCK = 8192
#: Squared norms below this keep every squared distance within 64 bits.
MOST_NORM = float(1 << 40)
_EXACT = float(1 << 50)
#: Copies of a table of label sums that is too large to broadcast.
SALTS = 32


class Node(NamedTuple):
    entries: np.ndarray  # indexes of the split points, or of a leaf's entries
    low: np.ndarray  # least distance of split point i to subtree j, rounded down
    high: np.ndarray  # greatest one, rounded up
    children: list[Node | None]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, exact."""
    xx, yy = (np.einsum("ij,ij->i", a, a) for a in (x, y))
    if len(xx) and len(yy) and max(float(xx.max()), float(yy.max())) * 4 < _EXACT:  # floats hold all terms
        return (xx[:, None] + yy - 2 * (x.astype(float) @ y.T.astype(float)).astype(np.int64)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[:, j]) ** 2
    return out


def _down(distance: np.ndarray) -> np.ndarray:
    """Square roots that are no greater than the true ones."""
    return np.nextafter(np.sqrt(distance.astype(float)) * (1 - 1e-12), -np.inf)


def _up(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(distance.astype(float)) * (1 + 1e-12), np.inf)


def gnat(points: np.ndarray, own: np.ndarray | None = None) -> Node:
    """The tree of the rows of ``points`` named in ``own``."""
    own = np.arange(len(points)) if own is None else own
    leaf = Node(own, np.zeros((0, 0)), np.zeros((0, 0)), [])
    if len(own) <= LEAF:
        return leaf
    chosen, far = [0], squared(points[own], points[own[:1]])[:, 0]
    while len(chosen) < DEGREE and far.max() > 0:  # each split point is the entry farthest from those before it
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(points[own], points[own[chosen[-1:]]])[:, 0])
    if len(chosen) == 1:  # equal entries: the smallest index wins wherever it is looked for
        return leaf
    splits, rest = own[chosen], np.setdiff1d(own, own[chosen])
    d = squared(points[rest], points[splits])
    nearest = d.argmin(axis=1)
    low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
    children = []
    for j in range(len(splits)):
        inside = nearest == j
        if inside.any():
            low[:, j], high[:, j] = _down(d[inside].min(axis=0)), _up(d[inside].max(axis=0))
        children.append(gnat(points, rest[inside]) if inside.any() else None)
    return Node(splits, low, high, children)


def nearest(points: np.ndarray, tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each query's nearest row of ``points``; of equals, the smallest index."""
    best, index = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(points))

    def see(node: Node, rows: np.ndarray) -> np.ndarray:
        d = squared(queries[rows], points[node.entries])
        order = np.argsort(node.entries)
        at = d[:, order].argmin(axis=1)  # the first of equals has the smallest index
        found, entry = d[np.arange(len(rows)), order[at]], node.entries[order[at]]
        better = (found < best[rows]) | (found == best[rows]) & (entry < index[rows])
        best[rows[better]], index[rows[better]] = found[better], entry[better]
        return d

    def walk(node: Node, rows: np.ndarray) -> None:
        d = see(node, rows)
        if not node.children:
            return
        least, most = _down(d), _up(d)
        first = d.argmin(axis=1)
        for near in (True, False):  # each query enters its nearest split point's subtree first, for a small radius
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                some = np.flatnonzero((first == j) == near)
                if not near:
                    radius = _up(best[rows[some]])[:, None]
                    apart = (least[some] - radius > node.high[:, j]) | (most[some] + radius < node.low[:, j])
                    some = some[~apart.any(axis=1)]
                if len(some):
                    walk(child, rows[some])

    if len(queries) and len(points):
        walk(tree, np.arange(len(queries)))
    return index, best


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list column without nulls whose lists have ``width`` numbers."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), width)


def usable(vector: str) -> Column:
    """True for a vector of finite numbers whose squares fit; NaN and infinity exceed every bound."""
    norm = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(norm < MOST_NORM, F.lit(False))


def _assigned(vectors: np.ndarray, books: list[np.ndarray], trees: list[Node]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """part, its integers, index and squared distance of the nearest entries."""
    size = vectors.shape[1] // len(books)
    for part, (book, tree) in enumerate(zip(books, trees, strict=True)):
        own = np.ascontiguousarray(vectors[:, part * size : (part + 1) * size])
        yield part, own, *nearest(book, tree, own)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            yield rows, integers(rows.column(rows.num_columns - 1), width)


class Codebooks(NamedTuple):
    width: int
    books: list[np.ndarray]  # one for each part: entries x components

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows(id, label, vector)``, which hold usable vectors only."""
    order = [F.col("id").asc_nulls_last(), "vector"]
    smallest = rows.orderBy(*order).limit(1).select("vector").collect()
    width = len(smallest[0]["vector"]) if smallest else 0
    if width % parts:
        raise ValueError(f"{parts} equal parts can't be cut from {width} components")
    same = rows.where(F.size("vector") == width)
    first = [r["vector"] for r in same.orderBy(*order).limit(entries).select("vector").collect()]  # a codebook's entries
    start = np.floor(np.array(first, float).reshape(len(first), width) * SCALE).astype(np.int64)
    size = width // parts
    books = [start[:, k * size : (k + 1) * size].copy() for k in range(parts)]
    spark, same = rows.sparkSession, same.select("vector")
    sums = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)]
    for _ in range(rounds if size and len(start) else 0):
        shared = spark.sparkContext.broadcast(books)  # ``entries`` rows of integers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            trees = [gnat(book) for book in now]
            total, count = np.zeros((parts, len(now[0]), size), np.int64), np.zeros((parts, len(now[0])), np.int64)
            for _, vectors in _blocks(batches, width):
                for part, own, index, _ in _assigned(vectors, now, trees):
                    order = np.argsort(index, kind="stable")
                    cells, begins = np.unique(index[order], return_index=True)
                    total[part, cells] += np.add.reduceat(own[order], begins, axis=0)
                    count[part] += np.bincount(index, minlength=len(now[0]))
            part, entry = np.nonzero(count)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), size).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists], ["part", "entry", "n", "total"])

        partial = same.mapInArrow(run, "part long, entry long, n long, total array<long>")
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows
            books[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(size)]
    return Codebooks(width, books)


def codes(rows: DataFrame, trained: Codebooks) -> DataFrame:
    """id, label, code (two hex digits a part) and error of every row of ``rows(id, label, vector)``."""
    shared, width = rows.sparkSession.sparkContext.broadcast(trained.books), trained.width  # ``entries`` rows of integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        trees = [gnat(book) for book in books]
        for part_rows, vectors in _blocks(batches, width):
            picked, error = np.zeros((len(vectors), len(books)), np.uint8), np.zeros(len(vectors), np.int64)
            for part, _, index, distance in _assigned(vectors, books, trees):
                picked[:, part] = index
                error += distance
            code = [x.hex() for x in map(bytes, picked)]
            yield pa.RecordBatch.from_arrays([part_rows.column(0), part_rows.column(1), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    out = rows.where(F.size("vector") == width).select("id", "label", "vector")
    return out.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over rows of equal label (nulls together).

    Sums are made before rows meet them, so no label's rows come together.
    """
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-sums")
    if sums.count() <= BROADCAST_ROWS:
        return coded.join(few(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(copies, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_copy")), "left")
    return met.drop("_label", "_salt", "_copy")


def encode(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error) of every usable row, and the codebooks; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code byte names 1 to 256 entries")
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable("vector"))
    trained = train(rows, parts, entries, rounds)
    return with_label_error(saved(codes(rows, trained), "codes")), trained


def decode(coded: DataFrame, trained: Codebooks) -> DataFrame:
    """``coded`` with vector, the numbers that its code stands for."""
    books = trained.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate([book[x] for book, x in zip(books, bytes.fromhex(code), strict=True)]) / SCALE for code in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "code", "vector"])

    return coded.select("id", "code").mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, code string, vector array<double>")
