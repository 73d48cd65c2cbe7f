"""Word hashes of Arrow text columns, computed over whole slices of documents at once.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A word's hash
is made of two polynomials over its bytes modulo 2^31 - 1, with bases and letters drawn apart,
taken from running sums of the slice, then mixed: 62 bits in all.  (Arithmetic modulo 2^64
won't do: Thue-Morse words of 1,024 letters collide there whatever base and letters are.)
Slices hold about ``SLICE_BYTES``; a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(_PRIME), np.uint64(31)
#: Bytes whose sums are taken at once.
_BLOCK = 1 << 16

_rng = np.random.default_rng(20240607)
_BASES = [int(x) for x in _rng.integers(1 << 20, _PRIME - 1, 2)]
#: Letters of the exact bytes, of another hash of these, and of bytes with A-Z lower-cased; a row for each polynomial.
_EXACT, _OTHER = _rng.integers(1, _PRIME, (2, 2, 256), dtype=np.uint64)
_FOLDED = _EXACT.copy()
_FOLDED[:, 65:91] = _EXACT[:, 97:123]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = {(j, down): np.ones(1, np.uint32) for j in (0, 1) for down in (False, True)}


class Slice(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of the documents, one after another
    offsets: np.ndarray  # where each document begins, and the end

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # index within the slice
    hash: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a text column in slices; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _powers_of(j: int, n: int, down: bool = False) -> np.ndarray:
    """The first n powers of base j, or of its inverse."""
    have = _powers[j, down]
    base = pow(_BASES[j], -1, _PRIME) if down else _BASES[j]
    while len(have) < n:
        have = np.concatenate([have, (have * np.uint64(pow(base, len(have), _PRIME)) % _P).astype(np.uint32)])
    _powers[j, down] = have[: 1 << 22].copy() if len(have) > 1 << 22 else have  # a very long document's powers aren't kept
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^63 modulo the prime."""
    x = (x & _P) + (x >> _BITS)
    x = (x & _P) + (x >> _BITS)
    return np.where(x >= _P, x - _P, x)


def running(data: np.ndarray, folded: bool = True, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """sums[i] of each polynomial: its value for the first i bytes; ``other`` gives a hash that is independent of the usual one."""
    letters = _FOLDED if folded else _OTHER if other else _EXACT
    out = []
    for j in (0, 1):
        up, sums, carry = _powers_of(j, len(data)), np.zeros(len(data) + 1, np.uint32), np.uint64(0)
        for at in range(0, len(data), _BLOCK):
            part = letters[j][data[at : at + _BLOCK]] * up[at : at + _BLOCK]
            part = (part & _P) + (part >> _BITS)  # below 2^32, so that a block's sum stays below 2^63
            part[0] += carry
            block = _reduced(np.cumsum(part))
            sums[at + 1 : at + 1 + len(block)] = block
            carry = block[-1]
        out.append(sums)
    return out[0], out[1]


def span_hash(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, from ``running``."""
    both = []
    for j in (0, 1):
        differ = sums[j][ends].astype(np.uint64) + (_P - sums[j][starts])
        both.append(_reduced(_reduced(differ) * _powers_of(j, len(sums[j]), True)[starts]))
    return mix(both[0] << np.uint64(32) | both[1])


def words(part: Slice, folded: bool = True) -> Words:
    blank = IS_BLANK[part.data]
    n = len(blank)
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        before[1:], after[:-1] = blank[:-1], blank[1:]
        edges = part.offsets[(part.offsets > 0) & (part.offsets < n)]
        before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    doc = np.searchsorted(part.offsets, starts, "right") - 1
    return Words(starts, ends, doc, span_hash(running(part.data, folded), starts, ends))


def shingles(found: Words, k: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash), sorted and distinct, of all k-word shingles; a shorter document's words are one shingle."""
    count = np.bincount(found.doc, minlength=docs)
    n, out, owner = len(found.hash), [], []
    if n >= k:
        h = found.hash[: n - k + 1] + np.uint64(k)
        for j in range(1, k):
            h = mix(h) + found.hash[j : n - k + 1 + j]
        same = found.doc[: n - k + 1] == found.doc[k - 1 :]
        out.append(mix(h)[same])
        owner.append(found.doc[: n - k + 1][same])
    first = np.concatenate([[0], np.cumsum(count)])
    for m in range(1, k):
        d = np.flatnonzero(count == m)
        if len(d):
            h = found.hash[first[d]] + np.uint64(m)
            for j in range(1, m):
                h = mix(h) + found.hash[first[d] + j]
            out.append(mix(h))
            owner.append(d)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, d = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[keep], h[keep]
