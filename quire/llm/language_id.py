"""Language of texts: script ranges narrow the candidates, Viterbi over word scores labels spans.

A word is a run of letters (with their marks) of one script, cut after ``LONGEST`` letters.
Its score for a language is the mean over gram orders of the logarithms of its letter grams'
shares in that language's training texts; grams reach over one place before and after the word.
Only languages that write a part of ``LEAST_SCRIPT`` of their letters in the word's script are
candidates, unless there is none.  The best labelling of a text's words, where each change of
language costs ``PENALTY``, gives spans of languages; the language of most letters is the
text's.

Viterbi's maxima run over segments of ``SEGMENT`` words at once, from every language that may
come before them; segments of a text are then joined, and walked back from the chosen ends.
The result is that of one pass over the text, whatever its length.

Training counts all texts of known language in tasks; Spark adds the counts.  The model's size
goes with the number of languages, not with the texts.

Defined results: a null text and one without a letter is ``und`` with score 0, as is every text
if nothing was learned; of languages with equally many letters, or equal scores, the first by
name wins; rows without id take no part in training and are not held out; repeated rows are
judged alike; texts of any length are read whole; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
ORDERS, BITS = (2, 3, 4), 15
DIM = 1 << BITS
LONGEST, SEGMENT = 24, 256
PENALTY, LEAST_SCRIPT, SMOOTHING, NEVER = 8.0, 0.01, 0.5, -1e4
#: Letters that are scored together; a longer text is alone, and scored in stretches of as many.
SLICE_CHARS = 1 << 20
#: Scripts and their code points.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(SCRIPTS) + 2  # 0: no letter, last: another script
_MARK = 255
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Script of each code point (0 for no letter), and its lower-case one."""
    if not _tables:
        script, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
        own = np.full(len(script), N_SCRIPTS - 1, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for low, high in ranges:
                own[low : high + 1] = k
        for x in range(len(script)):
            kind = unicodedata.category(chr(x))[0]
            if kind == "L":
                script[x] = own[x]
                small = chr(x).lower()
                lower[x] = ord(small) if len(small) == 1 else x
            elif kind == "M":
                script[x] = _MARK
        _tables.update(script=script, lower=lower)
    return _tables["script"], _tables["lower"]


class Words(NamedTuple):
    starts: np.ndarray  # code points
    ends: np.ndarray
    script: np.ndarray
    letters: np.ndarray  # how many


class Grams(NamedTuple):
    word: np.ndarray
    cell: np.ndarray  # of a table of len(ORDERS) * DIM


def words_and_grams(codes: np.ndarray) -> tuple[Words, list[Grams]]:
    """The words of code points, and their grams of each order."""
    scripts, lower = _letters()
    script = scripts[codes]
    n = len(codes)
    if n and (script == _MARK).any():  # marks go with the letter before them
        last = np.maximum.accumulate(np.where(script != _MARK, np.arange(n), -1))
        solid = np.where(last >= 0, script[last], 0)
        letter = (script != _MARK) & (script > 0)
        script = solid
    else:
        letter = script > 0
    inside = script > 0
    change = np.ones(n, bool)
    change[1:] = script[1:] != script[:-1]
    run = np.flatnonzero(change)
    place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    begin = inside & (change | (place % LONGEST == 0))
    starts = np.flatnonzero(begin)
    word = np.cumsum(begin) - 1
    found = Words(starts, starts + np.bincount(word[inside], minlength=len(starts)), script[starts], np.bincount(word[letter], minlength=len(starts)))
    own = np.where(inside, lower[codes], 32).astype(np.uint64)
    out = []
    for k, order in enumerate(ORDERS):
        m = n + 2 - order + 1
        padded, wide = np.concatenate([[np.uint64(32)], own, [np.uint64(32)]]), np.concatenate([[False], inside, [False]])
        if m <= 0:
            out.append(Grams(np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h, whole = np.full(m, order, np.uint64), np.ones(m, bool)
        for j in range(order):
            h = h * np.uint64(0x100000001B3) + padded[j : j + m]
            if 0 < j < order - 1:
                whole &= wide[j : j + m]
        first = wide[:m]
        at = np.flatnonzero(whole & (first | wide[1 : 1 + m]))
        cell = (h[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64) + k * DIM
        out.append(Grams(word[np.where(first[at], at - 1, at)], cell))
    return found, out


class Model(NamedTuple):
    names: list[str]
    table: np.ndarray  # cells x languages: logarithms of shares, divided by the number of orders
    writes: np.ndarray  # scripts x languages: whether it is a candidate


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of the ids that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all texts of known language."""
    width = len(ORDERS) * DIM + N_SCRIPTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, codes in zip(batch.column(0).to_pylist(), _codes(batch.column(1)), strict=True):
                own = total.setdefault(lang, np.zeros(width, np.int64))
                for stretch in _stretches(codes):
                    found, grams = words_and_grams(stretch)
                    for g in grams:
                        own += np.bincount(g.cell, minlength=width)
                    own[len(ORDERS) * DIM :] += np.bincount(found.script, weights=found.letters, minlength=N_SCRIPTS).astype(np.int64)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "cell", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # ``width`` rows a language
    names = sorted(set(got.column("lang").to_pylist()))
    count = np.zeros((width, len(names)))
    if names:
        place = {name: k for k, name in enumerate(names)}
        count[got.column("cell").to_numpy(), np.array([place[x] for x in got.column("lang").to_pylist()])] = got.column("n").to_numpy()
    table = np.zeros((len(ORDERS) * DIM, len(names)), np.float32)
    for k in range(len(ORDERS)):
        own = count[k * DIM : (k + 1) * DIM] + SMOOTHING
        table[k * DIM : (k + 1) * DIM] = np.log(own / own.sum(axis=0)) / len(ORDERS)
    letters = count[len(ORDERS) * DIM :]
    return Model(names, table, letters > LEAST_SCRIPT * letters.sum(axis=0))


def _codes(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4")


def _stretches(codes: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(codes), SLICE_CHARS):
        yield codes[at : at + SLICE_CHARS]


def word_scores(model: Model, codes: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of code points and their scores, words x languages; languages that are no candidates get NEVER."""
    found, grams = words_and_grams(codes)
    n = len(found.starts)
    score = np.zeros((n, len(model.names)), np.float32)
    for g in grams:
        if len(g.word):  # grams are in the order of their words
            first = np.flatnonzero(np.concatenate([[True], g.word[1:] != g.word[:-1]]))
            score[g.word[first]] += np.add.reduceat(model.table[g.cell], first, axis=0)
    may = model.writes[found.script]
    score[~may & may.any(axis=1)[:, None]] += NEVER
    return found, score


def best_labels(score: np.ndarray, cuts: np.ndarray, penalty: float = PENALTY, segment: int = SEGMENT) -> np.ndarray:
    """The language of each word in the labelling of greatest score; texts lie between ``cuts``.

    ``enter[s, p, l]`` is the best score of segment s that ends in l after language p, where the
    last p stands for the start of a text.
    """
    n, langs = score.shape
    out = np.zeros(n, np.int64)
    if not n or langs < 2:
        return out
    lengths = np.diff(cuts)
    pieces = -(-lengths // segment)
    first = np.cumsum(pieces) - pieces  # segments of a text follow each other
    text = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(text)) - first[text]
    start = cuts[:-1][text] + nth * segment
    size = np.minimum(segment, cuts[1:][text] - start)
    by_size = np.argsort(-size, kind="stable")
    still = np.searchsorted(-size[by_size], -np.arange(size.max(initial=0)), "left")  # segments longer than each step

    free = np.concatenate([np.where(np.eye(langs, dtype=bool), 0, -penalty), np.zeros((1, langs))])
    enter = np.repeat(free[None], len(text), axis=0)
    for step, many in enumerate(still):
        own = by_size[:many]
        v = enter[own]
        if step:
            v = np.maximum(v, v.max(axis=2, keepdims=True) - penalty)
        enter[own] = v + score[start[own] + step][:, None, :]

    before = np.zeros((len(text), langs), np.int64)  # language of the segment before, by the one this ends in
    reach = enter[:, langs].copy()  # right for first segments
    for k in range(1, int(pieces.max())):
        own = np.flatnonzero(nth == k)
        ways = reach[own - 1][:, :, None] + enter[own, :langs]
        before[own], reach[own] = ways.argmax(axis=1), ways.max(axis=1)
    end, prior = np.zeros(len(text), np.int64), np.full(len(text), langs)
    for k in range(int(pieces.max()) - 1, -1, -1):
        own = np.flatnonzero(nth == k)
        is_last = own + 1 == first[text[own]] + pieces[text[own]]
        after = np.minimum(own + 1, len(text) - 1)
        end[own] = np.where(is_last, reach[own].argmax(axis=1), prior[after])
        if k:
            prior[own] = before[own, end[own]]

    came = np.zeros((n, langs), np.int16)
    v = free[prior]
    own_lang = np.arange(langs)
    for step, many in enumerate(still):
        own = by_size[:many]
        now = v[own]
        if step:
            top = now.argmax(axis=1)
            moved = now[np.arange(many), top][:, None] - penalty
            stay = now >= moved
            came[start[own] + step] = np.where(stay, own_lang, top[:, None])
            now = np.where(stay, now, moved)
        v[own] = now + score[start[own] + step]
    label = end.copy()
    for step in range(len(still) - 1, -1, -1):
        own = by_size[: still[step]]
        out[start[own] + step] = label[own]
        if step:
            label[own] = came[start[own] + step, label[own]]
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, score (the language's part of the letters) and spans (start, end, lang; code points) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # goes with the number of languages
    names = ["id", "lang", "score", "spans"]

    def judged(model: Model, ids: pa.Array, texts: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(x) + 1 for x in texts])
        begins = np.cumsum(lengths) - lengths
        if len(texts) == 1:
            parts = [(k * SLICE_CHARS, *word_scores(model, x)) for k, x in enumerate(_stretches(texts[0]))]
        else:
            blank = np.array([10], np.uint32)
            parts = [(0, *word_scores(model, np.concatenate([y for x in texts for y in (x, blank)])))]
        starts, ends, letters = (np.concatenate([at * moves + getattr(w, name) for at, w, _ in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for name, moves in (("starts", 1), ("ends", 1), ("letters", 0)))
        score = np.concatenate([s for _, _, s in parts] or [np.zeros((0, len(model.names)), np.float32)])
        text = np.searchsorted(begins, starts, "right") - 1
        cuts = np.searchsorted(starts, np.append(begins, lengths.sum()))
        label = best_labels(score, cuts)
        m, langs = len(texts), max(1, len(model.names))
        by_lang = np.bincount(text * langs + label, weights=letters, minlength=m * langs).reshape(m, langs)
        best, total = by_lang.argmax(axis=1), by_lang.sum(axis=1)
        known = (total > 0) & bool(model.names)
        lang = [model.names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        share = np.where(known, by_lang[np.arange(m), best] / np.maximum(total, 1), 0.0)
        if model.names:
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(text))[: len(at)] - 1
            shift = begins[text[at]]
            fields = [pa.array(starts[at] - shift), pa.array(ends[last] - shift), pa.array([model.names[x] for x in label[at].tolist()], pa.string())]
            per_text = np.bincount(text[at], minlength=m)
        else:
            fields, per_text = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], np.zeros(m, np.int64)
        spans = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32), pa.StructArray.from_arrays(fields, ["start", "end", "lang"]))
        return pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(share), spans], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, texts = 0, 0, []
            for k, codes in enumerate(_codes(batch.column(1))):
                if texts and size + len(codes) > SLICE_CHARS:
                    yield judged(shared.value, batch.column(0).slice(at, len(texts)), texts)
                    at, size, texts = k, 0, []
                texts.append(codes)
                size += len(codes) + 1
            if texts:
                yield judged(shared.value, batch.column(0).slice(at, len(texts)), texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, score double, spans array<struct<start:long,end:long,lang:string>>")
