"""Training-order materialisation of token ids in fixed-stride shards.

Documents are encoded (begin, pieces, end) and cut into sequences of ``length`` ids, the last
one padded.  Sequences are numbered through all partitions of the encoded table.  A keyed
Feistel permutation over the next power of four, walked until it falls below the number of
sequences, gives every sequence its global slot: a shuffle without sorting by random numbers,
computed from key and number alone, and invertible.  Shard k holds slots k * per_shard and
onward in one partition and one row: a payload of equal strides, so that a reader can go on
from any slot, and the origin of every sequence.

Defined results: a null or empty text is one sequence with begin and end only; texts of any
length are encoded whole; rows without doc_id keep a null one; repeated rows have sequences
of their own; an empty table gives no shard; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import text_hash
from quire.llm.sentence_pieces import SPACE
from quire.llm.store import fresh_path

LENGTH, PER_SHARD, KEY, ROUNDS = 512, 1024, 20240607, 4
#: Shards in a file.
PER_FILE = 32
_coders: dict = {}


def _round_keys(key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return text_hash.mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, keys: np.ndarray, half: int) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (text_hash.mix(right + k) & mask)
    return (left << shift) | right


def _unfeistel(x: np.ndarray, keys: np.ndarray, half: int) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys[::-1]:
        left, right = right ^ (text_hash.mix(left + k) & mask), left
    return (left << shift) | right


def _walk(numbers: np.ndarray, n: int, key: int, step) -> np.ndarray:
    keys, half = _round_keys(key), _half_bits(n)
    out = step(np.asarray(numbers, np.uint64), keys, half)
    while (far := out >= np.uint64(n)).any():
        out[far] = step(out[far], keys, half)
    return out.astype(np.int64)


def slots_of(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the sequences with these numbers, of n in all."""
    return _walk(numbers, n, key, _feistel)


def numbers_of(slots: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Numbers of the sequences in these slots: the inverse of ``slots_of``."""
    return _walk(slots, n, key, _unfeistel)


class _Coder:
    """The library's encoder behind a bounded cache of units (a word with the spaces before it).

    Units encode independently as no piece holds a word start after another character, which is
    checked; so a text's ids are its units' ids in a row.
    """

    CACHED, CACHED_CHARS = 700_000, 48

    def __init__(self, model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.pieces.vocab_size() > 1 << 16:
            raise ValueError("ids don't fit in 16 bits")
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        if any(SPACE in name.lstrip(SPACE) for name in names) or self.pieces.encode(" a") == self.pieces.encode("a"):
            raise ValueError("the model doesn't encode word by word")
        self.ends = [np.array([i], "<u2").tobytes() for i in (self.pieces.bos_id(), self.pieces.eos_id())]
        self.begins = np.array([name.startswith(SPACE) for name in names])
        self.alone = np.array([self.pieces.piece_to_id(SPACE)], "<u2").tobytes()
        self.units: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not text:
            return b"".join(self.ends)
        if "  " in text or SPACE in text or text[0] == " ":
            keys = re.findall(f"{SPACE}({SPACE}*[^{SPACE}]*)", SPACE + text.replace(" ", SPACE))
        else:
            keys = text.split(" ")
        got = list(map(self.units.get, keys))
        if None in got:
            new = {k for k, ids in zip(keys, got, strict=True) if ids is None}
            made = {k: np.array(self.pieces.encode(k), "<u2").tobytes() if k else self.alone for k in new if not k or SPACE in k}
            if plain := [k for k in new if k and SPACE not in k]:
                ids = np.array(self.pieces.encode(" ".join(plain)), "<u2")
                cuts = [*(2 * np.flatnonzero(self.begins[ids])).tolist(), 2 * len(ids)]  # where a unit begins
                raw = ids.tobytes()
                made.update((k, raw[x:y]) for k, x, y in zip(plain, cuts[:-1], cuts[1:], strict=True))
            got = [made[k] if ids is None else ids for k, ids in zip(keys, got, strict=True)]
            if len(self.units) + len(made) > self.CACHED:
                self.units.clear()
            self.units.update((k, v) for k, v in made.items() if len(k) <= self.CACHED_CHARS)
        return self.ends[0] + b"".join(got) + self.ends[1]


def _coder(model: bytes) -> _Coder:
    key = hash(model)
    if key not in _coders:
        _coders[key] = _Coder(model)
    return _coders[key]


def encoded(docs: DataFrame, model: bytes, length: int = LENGTH) -> DataFrame:
    """part, first (number of the document's first sequence within the part), doc_id, ids (u16, padded to whole sequences), n_tokens."""
    shared, stride = docs.sparkSession.sparkContext.broadcast(model), 2 * length  # the model is a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, at = _coder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = batch.slice(lo, 200)
                ids, first, count = [], [], []
                for text in rows.column(1):
                    one = coder.encode(text.as_py() or "")
                    n = -(-len(one) // stride)
                    ids.append(one.ljust(n * stride, b"\0")), first.append(at), count.append(len(one) // 2)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([part] * rows.num_rows, pa.int32()), pa.array(first, pa.int64()), rows.column(0), pa.array(ids, pa.binary()), pa.array(count, pa.int64())], ["part", "first", "doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, first long, doc_id long, ids binary, n_tokens long")


def write_shards(docs: DataFrame, model: bytes, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, per_file: int = PER_FILE) -> DataFrame:
    """Write the shards to ``path`` as Parquet, a row each and ``per_file`` in a row in each file; returns them as a table.

    Columns: shard, first_slot, stride (bytes), payload, doc_ids, pieces (number of the
    sequence in its document), lengths (ids that are no padding).
    """
    spark = docs.sparkSession
    table_path = fresh_path(spark, "token-ids")
    encoded(docs, model, length).write.option("compression", "zstd").parquet(table_path)
    table = spark.read.schema("part int, first long, doc_id long, ids binary, n_tokens long").parquet(table_path)
    stride = 2 * length
    sizes = table.groupBy("part").agg(F.sum(F.octet_length("ids") / stride).cast("long").alias("n")).orderBy("part").collect()  # one row for each partition
    starts, total = {}, 0
    for row in sizes:
        starts[row["part"]] = total
        total += row["n"]
    schema = "shard int, first_slot long, stride int, payload binary, doc_ids array<long>, pieces array<int>, lengths array<int>"
    shards = max(1, -(-total // per_shard))
    base = spark.sparkContext.broadcast(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                whole = [x.as_py() for x in rows.column(3)]
                n = np.array([len(x) // stride for x in whole])
                owner = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                begin = rows.column(1).to_numpy() + np.array([base.value[p] for p in rows.column(0).to_pylist()], np.int64)
                slot = slots_of(begin[owner] + piece, total, key)
                tokens = rows.column(4).to_numpy()[owner] - piece * length
                cut = [whole[o][p * stride : (p + 1) * stride] for o, p in zip(owner.tolist(), piece.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), rows.column(2).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(np.minimum(tokens, length).astype(np.int32)), pa.array(cut, pa.binary())], ["shard", "slot", "doc_id", "piece", "tokens", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"doc_id": [], "piece": [], "tokens": [], "ids": []}
        shard, first = None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([stride], pa.int32()), pa.array([b"".join(held["ids"])], pa.binary()), pa.array([held["doc_id"]], pa.list_(pa.int64())), pa.array([held["piece"]], pa.list_(pa.int32())), pa.array([held["tokens"]], pa.list_(pa.int32()))], ["shard", "first_slot", "stride", "payload", "doc_ids", "pieces", "lengths"])

        for batch in batches:
            for one, slot, doc, piece, tokens, ids in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                if one != shard:
                    if shard is not None:
                        yield done()
                        for x in held.values():
                            x.clear()
                    shard, first = one, slot
                held["doc_id"].append(doc), held["piece"].append(piece), held["tokens"].append(tokens), held["ids"].append(ids)
        if shard is not None:
            yield done()

    dealt = table.mapInArrow(deal, "shard int, slot long, doc_id long, piece int, tokens int, ids binary")
    ranges = dealt.repartitionById(-(-shards // per_file), F.expr(f"cast(shard div {per_file} as int)")).sortWithinPartitions("slot")
    ranges.mapInArrow(fill, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_from(shards: DataFrame, slot: int, per_shard: int = PER_SHARD) -> DataFrame:
    """The sequences from ``slot`` on (slot, doc_id, piece, n_tokens, ids): earlier shards aren't read."""
    return sequences(shards.where(F.col("shard") >= slot // per_shard)).where(F.col("slot") >= slot)


def sequences(shards: DataFrame) -> DataFrame:
    """shard, slot, doc_id, piece, n_tokens, ids of every sequence, cut out of the payloads."""
    each = shards.select("shard", "first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "pieces", "lengths")).alias("at", "x"))
    ids = F.substring(F.col("payload"), F.col("at") * F.col("stride") + 1, F.col("x.lengths") * 2)
    return each.select("shard", (F.col("first_slot") + F.col("at")).alias("slot"), F.col("x.doc_ids").alias("doc_id"), F.col("x.pieces").alias("piece"), F.col("x.lengths").cast("long").alias("n_tokens"), ids.alias("ids"))
