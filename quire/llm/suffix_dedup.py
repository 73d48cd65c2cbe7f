"""Exact substring dedup over a sparse suffix array built by sampled range partitions.

A string of ``length`` bytes that occurs twice is chosen by content: among its ``GRAM``-byte
grams the one of smallest hash (leftmost of equals) is its anchor, at the same offset in both
places.  So only suffixes that start at anchors are sorted, by their first ``GRAM`` bytes, as
words of eight bytes in byte order, then by context.  Spark samples splitters and
range-partitions them by this key; a bucket is sorted by multikey quicksort, a word at a time.

An anchor stands for the windows (strings) it was chosen by, which are consecutive; their
union is its context.  Equal contexts are neighbours after the sort: all but the first lose
the whole context.  Where one gram has several contexts, their first occurrences are compared
by how far they agree to the left and to the right of the gram.  Groups of more than
``PAIRED`` contexts are taken apart instead: into stretches of ``STRETCH`` windows, which are
settled where all that share the stretch's core are equal, and else into the windows
themselves.  Groups that reach a bucket's edge are put together across the boundary first.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; rows
without doc_id come after all others, in an order fixed by their texts; rows that repeat a
doc_id and text don't lose bytes to each other; different texts of one doc_id are the document's
parts, in the order of their hashes (2 GB in all at most), and no match crosses from one into
another; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import text_hash
from quire.llm.store import few, node_id, saved, whole_text

GRAM = 24
#: Suffixes in a bucket, about.
BUCKET_ROWS = 1_000_000
#: Contexts of one gram that are compared pair by pair within a task.
PAIRED = 512
#: Windows that are compared together at first where there are more contexts.
STRETCH = 8
_GRAM = ["w0", "w1", "w2"]
_KEY = [*_GRAM, "context", "id", "place"]
_ANCHORS = ", ".join(f"{name} long" for name in _KEY)
#: Runs of fewer rows are sorted at once.
RUN = 2048
_letters = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on: a polynomial modulo 2^64, which is safe for spans as short as these."""
    base = 0x9E3779B97F4A7C15
    spans = {1: _letters[data]}
    for n in (1, 2, 4, 8):
        h = spans[n]
        spans[2 * n] = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:]
    return text_hash.mix(spans[16][: len(data) - GRAM + 1] * np.uint64(pow(base, 8, 1 << 64)) + spans[8][16:])


def anchors(part: text_hash.Slice, length: int) -> tuple[np.ndarray, ...]:
    """document, the gram's three words, context and place of each anchor.

    A place packs the start of the context in its document, the anchor's offset in it and its
    size (16 bits each for the last two), so that places sort by their starts.
    """
    data, offsets = part.data, part.offsets
    n, wide = len(data), length - GRAM + 1
    lengths = np.diff(offsets)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length or not (lengths >= length).any():
        return none
    sums = text_hash.running(data, folded=False)
    at = np.arange(n - GRAM + 1)
    key = (gram_hashes(data) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least, span = key, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    # least[p] is the anchor of the window at p; windows that leave their document don't count
    docs = np.flatnonzero(lengths >= length)
    sizes = lengths[docs] - length + 1
    owner = np.repeat(docs, sizes)
    p = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[owner]
    anchor = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    low, high, a, doc = p[first], p[last] + length, anchor[first], owner[first]
    words = []
    for j in range(0, GRAM, 8):
        word = np.zeros(len(a), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | data[a + j + k].astype(np.uint64)
        words.append((word ^ np.uint64(1 << 63)).view(np.int64))  # signed numbers in byte order
    context = text_hash.mix(text_hash.span_hash(sums, low, high) + (a - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (high - low).astype(np.uint64))
    place = (low - offsets[doc]) << 32 | (a - low) << 16 | (high - low)
    return doc, *words, context.view(np.int64), place


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the columns, by multikey quicksort: rows are parted at a pivot of one column, equals go on with the next."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(columns):
            continue
        rows = order[low:high]
        if high - low <= RUN:
            order[low:high] = rows[np.lexsort([c[rows] for c in columns[depth:][::-1]])]
            continue
        keys = columns[depth][rows]
        pivot = np.sort(keys[:: len(keys) // 64])[32]
        less, more = keys < pivot, keys > pivot
        parts = rows[less], rows[~(less | more)], rows[more]
        order[low:high] = np.concatenate(parts)
        first, last = low + len(parts[0]), high - len(parts[2])
        todo += [(low, first, depth), (first, last, depth + 1), (last, high, depth)]
    return order


#: What a bucket says of a row: its context is gone; it is the first of one of several contexts of its gram (of too many to pair); it is the first here of a context whose gram reaches the edge.
GONE, SEVERAL, MANY, EDGE = 0, 1, 2, 3


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if not got:
        return
    columns = [np.concatenate([b.column(j).to_numpy() for b in got]) for j in range(len(_KEY))]
    del got
    order = multikey_order(columns)
    columns = [c[order] for c in columns]
    *gram, context, ids, place = columns
    n = len(place)
    new_gram, new_context = np.ones(n, bool), np.ones(n, bool)
    new_gram[1:] = np.any([w[1:] != w[:-1] for w in gram], axis=0)
    new_context[1:] = new_gram[1:] | (context[1:] != context[:-1])
    first = np.flatnonzero(new_context)[np.cumsum(new_context) - 1]  # each row's first of the context
    group = np.cumsum(new_gram) - 1
    contexts = np.bincount(group, weights=new_context)[group]
    edge = (group == 0) | (group == group[-1])
    later = (ids != ids[first]) | (place != place[first])
    kind = np.full(n, -1)
    kind[later] = GONE
    kind[new_context & (contexts > 1)] = SEVERAL
    kind[new_context & (contexts > PAIRED)] = MANY
    kind[new_context & edge] = EDGE
    keep = np.flatnonzero(kind >= 0)  # a repeated row of a first one says nothing
    for lo in range(0, len(keep), 100_000):
        at = keep[lo : lo + 100_000]
        blank = kind[at] == GONE  # its gram isn't needed
        yield pa.RecordBatch.from_arrays([pa.array(kind[at].astype(np.int32)), *(pa.array(c[at], mask=blank) for c in columns[:4]), pa.array(ids[at]), pa.array(place[at])], ["kind", *_KEY])


def _start(place):
    return F.shiftright(place, 32).cast("int")


def _size(place):
    return place.bitwiseAND(F.lit(0xFFFF)).cast("int")


def _paired(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans that go from the first contexts of each gram; rows come sorted by gram, then by place."""
    reach = length - GRAM
    held: list[tuple] = []
    key = None

    def spans() -> list[tuple[int, int, int]]:
        out = []
        grid = np.full((len(held), reach + length), 256, np.int16)  # the anchor is in column ``reach``
        for x, (_, place, text) in enumerate(held):
            left = reach - (place >> 16 & 0xFFFF)
            grid[x, left : left + len(text)] = np.frombuffer(text, np.uint8)
        for x in range(1, len(held)):
            ids, place, text = held[x]
            same = (grid[:x] == grid[x]) & (grid[x] < 256)
            left = np.where(same[:, :reach].all(axis=1), reach, np.argmin(same[:, :reach][:, ::-1], axis=1))
            right = np.where(same[:, reach:].all(axis=1), length, np.argmin(same[:, reach:], axis=1))
            before = place >> 16 & 0xFFFF  # bytes of the context before the anchor
            least, most = before - (len(text) - length), before  # windows, by how much they have before the anchor
            a, z = np.maximum(least, length - right), np.minimum(most, left)
            start = (place >> 32) + before
            out += [(ids, start - hi, hi - lo + length) for lo, hi in set(zip(a.tolist(), z.tolist(), strict=True)) if lo <= hi]
        return out

    for batch in batches:
        found = []
        for *gram, ids, place, text in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
            if gram != key:
                found += spans()
                held, key = [], gram
            held.append((ids, place, text))
        if found:
            yield _span_batch(found)
    if found := spans():
        yield _span_batch(found)


def _span_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    ids, start, size = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["id", "start", "size"])


def document_parts(docs: DataFrame) -> DataFrame:
    """id, text and base of every row: where its text begins in the document, 0 but for an id of several texts."""
    tag = F.xxhash64(whole_text()).alias("tag")
    rows = docs.select(node_id().alias("id"), "text", F.lit(0).cast("long").alias("base"))
    doubled = rows.select("id", tag).groupBy("id").agg(F.min("tag").alias("x"), F.max("tag").alias("y")).where("x != y")
    doubled = saved(doubled.select("id"), "doubled-ids")
    if not doubled.limit(1).count():
        return rows
    parts = rows.join(few(doubled), "id", "left_semi").select("id", tag, F.octet_length(whole_text()).alias("size")).distinct()
    before = Window.partitionBy("id").orderBy("tag").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(parts.select("id", "tag", F.sum("size").over(before).alias("base")), "bases")
    return rows.select("id", "text", tag).join(few(bases), ["id", "tag"], "left").select("id", "text", F.coalesce("base", F.lit(0).cast("long")).alias("base"))


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """id, start, size of byte spans that go; they may overlap.  ``docs`` are ``document_parts``."""
    if not GRAM + 8 <= length < 1 << 14:
        raise ValueError(f"length must be {GRAM + 8} to {(1 << 14) - 1}")
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(conf, int(total * 2 / (length - GRAM + 2) / BUCKET_ROWS) + 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for part in text_hash.slices(batch.column(1)):
                doc, *key, place = anchors(part, length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*key, ids[part.first + doc], place + (base[part.first + doc] << 32))], _KEY)

    suffixes = docs.where(F.octet_length("text") >= length).mapInArrow(find, _ANCHORS)
    found = saved(suffixes.repartitionByRange(buckets, *_KEY).mapInArrow(_bucket, "kind int, " + _ANCHORS), "suffix-buckets")

    gone = found.where(F.col("kind") == GONE).select("id", _start(F.col("place")).alias("start"), _size(F.col("place")).alias("size"))
    edge = found.where(F.col("kind") == EDGE)
    firsts = saved(edge.groupBy(*_GRAM, "context").agg(F.min(F.struct("id", "place")).alias("f")), "edge-contexts")
    met = edge.join(firsts, [*_GRAM, "context"])
    is_first = (F.col("id") == F.col("f.id")) & (F.col("place") == F.col("f.place"))
    across = met.where(~is_first).select("id", _start(F.col("place")).alias("start"), _size(F.col("place")).alias("size"))
    number = saved(firsts.groupBy(*_GRAM).agg(F.count("*").alias("contexts")).where("contexts > 1"), "edge-grams")
    edge_firsts = met.where(is_first).join(few(number), _GRAM).select(F.when(F.col("contexts") > PAIRED, MANY).otherwise(SEVERAL).alias("kind"), *_GRAM, "id", "place").distinct()
    several = saved(found.where(F.col("kind").isin(SEVERAL, MANY)).select("kind", *_GRAM, "id", "place").unionAll(edge_firsts), "several-contexts")

    per_doc = several.groupBy("id").agg(F.collect_list(F.struct("kind", *_GRAM, "place")).alias("places"))
    touched = docs.where(F.octet_length("text") >= length).join(few(several.select("id").distinct()), "id", "left_semi")
    texts = touched.join(per_doc, "id").select("id", "text", "places", "base")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each context that is to be paired, one for each stretch of windows of the others.

        A stretch has the hash of the bytes that all its windows share (a), of all its bytes (b),
        and of each window; windows are stretched by their distance from the anchor.
        """
        for batch in batches:
            for x in range(batch.num_rows):
                raw, own, doc, base = batch.column(1)[x].as_py().encode(), batch.column(2)[x].values, batch.column(0)[x].as_py(), batch.column(3)[x].as_py()
                kind, *gram, place = (own.field(j).to_numpy() for j in range(5))
                start, before, size = (place >> 32) - base, place >> 16 & 0xFFFF, place & 0xFFFF
                inside = (start >= 0) & (start < len(raw))  # the others are in other texts of this id
                pair = np.flatnonzero((kind == SEVERAL) & inside)
                blank = pa.nulls(len(pair), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(kind[pair]), *(pa.array(w[pair]) for w in gram), pa.array(np.full(len(pair), doc)), pa.array(place[pair]), pa.array([raw[start[j] : start[j] + size[j]] for j in pair], pa.binary()), blank, blank], names)
                apart = np.flatnonzero((kind == MANY) & inside)
                if len(apart):
                    data = np.frombuffer(raw, np.uint8)
                    one, two = text_hash.running(data, folded=False), text_hash.running(data, folded=False, other=True)
                    cuts = []
                    for j in apart.tolist():
                        anchor, most, least = start[j] + before[j], before[j], before[j] - (size[j] - length)
                        for k in range(least // STRETCH, most // STRETCH + 1):
                            low, high = max(least, STRETCH * k), min(most, STRETCH * k + STRETCH - 1)
                            cuts.append((anchor - STRETCH * k, anchor - high, high - low + 1, k, low))
                    core, p, n, k, low = np.array(cuts, np.int64).T
                    salt = lambda v: text_hash.mix(v.astype(np.uint64) + np.uint64(1))
                    a = text_hash.mix(text_hash.span_hash(one, core, core + length - STRETCH + 1) ^ salt(k))
                    b = text_hash.mix(text_hash.span_hash(two, p, p + n - 1 + length) ^ salt(n << 20 | low))
                    each = [np.arange(y, y + m) for y, m in zip(p.tolist(), n.tolist(), strict=True)]
                    hashes = [pa.array([text_hash.span_hash(sums, w, w + length).view(np.int64) for w in each], pa.list_(pa.int64())) for sums in (one, two)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), MANY, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(p), pa.int64()), pa.array(np.full(len(p), doc)), pa.array(p + base << 8 | n), pa.nulls(len(p), pa.binary()), *hashes], names)

    names = ["kind", "a", "b", "c", "id", "place", "context", "h1", "h2"]
    rows = saved(texts.mapInArrow(contexts, "kind int, a long, b long, c long, id long, place long, context binary, h1 array<long>, h2 array<long>"), "contexts")
    pairs = rows.where(F.col("kind") == SEVERAL).select("a", "b", "c", "id", "place", "context").repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", "id", "place")
    compared = pairs.mapInArrow(lambda batches: _paired(batches, length), "id long, start int, size int")

    stretches = rows.where(F.col("kind") == MANY).select("a", "b", "id", "place", "h1", "h2")
    unions = saved(stretches.groupBy("a", "b").agg(F.min(F.struct("id", "place")).alias("f")), "stretches")
    is_union_first = (F.col("id") == F.col("f.id")) & (F.col("place") == F.col("f.place"))
    of_union = stretches.join(unions, ["a", "b"])
    first_window = F.shiftright("place", 8).cast("int")
    whole = of_union.where(~is_union_first).select("id", first_window.alias("start"), (F.col("place").bitwiseAND(F.lit(255)) - 1 + length).cast("int").alias("size"))
    open_cores = unions.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    unsettled = of_union.where(is_union_first).join(open_cores, "a", "left_semi").select("id", "place", "h1", "h2").distinct()
    windows = unsettled.select("id", first_window.alias("p"), F.posexplode(F.arrays_zip("h1", "h2")).alias("k", "h")).select("h.h1", "h.h2", "id", (F.col("p") + F.col("k")).alias("start"))
    windows = saved(windows, "windows")
    earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("f"), F.max(F.struct("id", "start")).alias("l")).where("f != l").select("h1", "h2", "f")
    earliest = saved(earliest, "first-windows")  # so that a window that many texts have is split among tasks in the join
    again = windows.join(earliest, ["h1", "h2"]).where((F.col("id") != F.col("f.id")) | (F.col("start") != F.col("f.start")))
    return gone.unionAll(across).unionAll(compared).unionAll(whole).unionAll(again.select("id", "start", F.lit(length).alias("size")))


def dedup_substrings(docs: DataFrame, length: int = 100) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    rows = document_parts(docs)
    per_doc = saved(removed_spans(rows, length).groupBy("id").agg(F.collect_list(F.struct("start", "size")).alias("spans")), "removed-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sizes, removed, runs, kept = [], [], [], []
                for text, own, base in zip(part.column(1), part.column(2), part.column(3).to_pylist(), strict=True):
                    raw = (text.as_py() or "").encode()
                    sizes.append(len(raw))
                    flat = own.values
                    if flat is None or not len(flat):
                        removed.append(0), runs.append(0), kept.append(raw)
                        continue
                    start, size = flat.field("start").to_numpy().astype(np.int64) - base, flat.field("size").to_numpy()
                    inside = (start >= 0) & (start < len(raw))  # the others are in other texts of this id
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, start[inside], 1)
                    np.add.at(edge, (start + size)[inside], -1)
                    out = np.cumsum(edge[:-1]) > 0
                    removed.append(int(out.sum()))
                    runs.append(int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum()))
                    kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    touched = few(per_doc.select("id"))
    hit = rows.join(touched, "id", "left_semi").join(per_doc, "id").select("id", "text", "spans", "base")
    whole = rows.join(touched, "id", "left_anti").select("id", "text", F.lit(None).cast(per_doc.schema["spans"].dataType).alias("spans"), "base")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return hit.mapInArrow(cut, schema).unionAll(whole.mapInArrow(cut, schema))
