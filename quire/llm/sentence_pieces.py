"""SentencePiece BPE encoding over a prefix table, and decoding.

For every prefix of a text the last token of its encoding is unique.  The table of these last
tokens is filled from left to right: an automaton names the pieces that end at a position,
and the one whose pair with the last token before it is compatible (the pair on its own
encodes to just these two) is the prefix's last token.  The ids are then recovered backwards.
This equals priority merging, since parts of an encoding are the encodings of their texts.

No piece holds a word start after another character, so the text falls into units (spaces and
the word after them) that encode independently; their ids are kept in a bounded cache.

Defined results: a null text encodes as the empty one (begin and end ids only); texts of any
length are encoded whole; repeated rows give repeated results; an empty table gives an empty
result.  Text columns beside the named ones are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED_UNITS, CACHED_UNIT_CHARS, CACHED_PAIRS = 700_000, 48, 1_000_000


class PrefixEncoder:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, kinds = proto.normalizer_spec, proto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with the identity normalizer and a word start in front are supported")
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        self.score, self.ids, self.byte_ids, self.surface = {}, {}, {}, []
        for i, piece in enumerate(proto.pieces):
            if piece.type == kinds.NORMAL:
                self.score[piece.piece], self.ids[piece.piece] = piece.score, np.array([i], "<u4").tobytes()
                self.surface.append(piece.piece.replace(SPACE, " ").encode())
            elif piece.type == kinds.BYTE:
                b = int(piece.piece[3:5], 16)
                self.byte_ids[b] = np.array([i], "<u4").tobytes()
                self.surface.append(bytes([b]))
            elif piece.type == kinds.UNKNOWN:
                self.surface.append(proto.trainer_spec.unk_surface.encode())
            elif piece.type == kinds.CONTROL:
                self.surface.append(b"")
            else:
                raise ValueError(f"unsupported piece {piece.piece!r}")
            if piece.piece == "<s>":
                self.begin = np.array([i], "<u4").tobytes()
            elif piece.piece == "</s>":
                self.end = np.array([i], "<u4").tobytes()
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a word start after another character")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1 and self._merge(p) == [p]:  # others are never made by merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """Priority merging of a short text: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: tuple[str, str]) -> bool:
        ok = self.pairs.get(pair)
        if ok is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            ok = self.pairs[pair] = self._merge(pair[0] + pair[1]) == list(pair)
        return ok

    def tokens(self, unit: str) -> list[str]:
        """The pieces of a unit; a character without a piece stands for itself."""
        n = len(unit)
        last: list[str] = [""] * (n + 1)  # last[i]: the last token of the prefix of length i
        pairs = self.pairs

        def settle(i: int, found: list[str]) -> None:
            for token in found:
                before = i - len(token)
                if not before:
                    last[i] = token
                    return
                pair = (last[before], token)
                ok = pairs.get(pair)
                if ok or ok is None and self._compatible(pair):
                    last[i] = token
                    return
            last[i] = unit[i - 1]

        at, found = 1, []
        for end, token in self.automaton.iter(unit):
            while at <= end:
                settle(at, found)
                at, found = at + 1, []
            found.append(token)
        while at <= n:
            settle(at, found)
            at, found = at + 1, []
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(last[i])
        out.reverse()
        return out

    def _unit_ids(self, key: str) -> bytes:
        unit = self.units
        ids = b"".join([self.ids[t] if t in self.ids else b"".join([self.byte_ids[b] for b in t.encode()]) for t in self.tokens(SPACE + key)])
        if len(key) <= CACHED_UNIT_CHARS:
            if len(unit) >= CACHED_UNITS:
                unit.clear()
            unit[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        if "  " in text or SPACE in text or text[0] == " ":
            keys = re.findall(f"{SPACE}({SPACE}*[^{SPACE}]*)", SPACE + text.replace(" ", SPACE))
        else:
            keys = text.split(" ")
        got = list(map(self.units.get, keys))
        if None in got:
            got = [self._unit_ids(k) if ids is None else ids for k, ids in zip(keys, got, strict=True)]
        return b"".join(got)

    def decode(self, ids: bytes) -> str:
        """The text of ids; a byte that is no part of UTF-8 gives U+FFFD."""
        pieces = list(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        first = next((k for k, p in enumerate(pieces) if p), None)
        if first is not None and pieces[first][:1] == b" ":
            pieces[first] = pieces[first][1:]
        raw = b"".join(pieces)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(c if not "\udc80" <= c <= "\udcff" else "�" for c in raw.decode("utf-8", "surrogateescape"))


_encoders: dict[bytes, PrefixEncoder] = {}


def encoder(model: bytes) -> PrefixEncoder:
    """The worker's encoder of this model, built once."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(model)
    return _encoders[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian u32 with begin and end) and decoded text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [coder.begin + coder.encode(t.as_py() or "") + coder.end for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents with its outputs digested in place."""
    out = encode_documents(docs, model, id_col, text_col)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
