"""Comparison of revisions in blocks of pairs (``pair_blocks``).  The rules are those of ``compare``; there a row is a word."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.operators import revisions as R
from quire.operators.compare import HOLD_GAP, NEAR, REPORT_WORDS, SLIDE, VOTES, VOTING, longest_rising
from quire.operators.pair_blocks import CHUNK, DOUBLE, INT, LONG, STRING, in_blocks

#: Gaps that a block remembers.
MOST_GAPS = 50_000
RANGES = {c: LONG for c in R.RANGES}


class _Side:
    """A document of a block: x (word numbers of the words with a key), pos (their places among all), and runs of three words that are once in it, with their places."""

    __slots__ = ("all_lines", "at", "boxes", "lines", "links", "pos", "row", "runs", "starts", "words", "x")

    def __init__(self, x: np.ndarray, pos: np.ndarray, threes: np.ndarray) -> None:
        self.x, self.pos = x, pos
        runs, at, n = np.unique(threes, return_index=True, return_counts=True)
        at = np.sort(at[n == 1])
        self.runs, self.at = threes[at], at


def _sides(table: pa.Table) -> tuple[list[_Side], int, list[str]]:
    """The documents of a block, how many runs of three words there are, and the keys by number."""
    plain = lambda c: pa.concat_arrays(table.column(c).chunks)
    split = pc.split_pattern(plain("text"), "\n")
    coded = split.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy().astype(np.int32), split.offsets.to_numpy()
    keys = coded.dictionary.to_pylist()
    empty = keys.index("") if "" in keys else -1
    pos = [np.nonzero(codes[lo:hi] != empty)[0] for lo, hi in zip(ends, ends[1:], strict=False)]
    xs = [np.ascontiguousarray(codes[lo:hi][p]) for lo, hi, p in zip(ends, ends[1:], pos, strict=False)]
    whole = np.concatenate([*xs, np.zeros(2, np.int32)]).astype(np.int64)
    two = np.unique((whole[:-1] << 31) + whole[1:], return_inverse=True)[1].astype(np.int64)
    kinds, three = np.unique((two[:-1] << 31) + whole[2:], return_inverse=True)
    at = np.append(0, np.cumsum([len(x) for x in xs]))
    sides = [_Side(x, p, three[lo : lo + max(len(x) - 2, 0)]) for x, p, lo in zip(xs, pos, at, strict=False)]
    if "lines" in table.column_names:
        for side, lines in zip(sides, table.column("lines").to_pylist(), strict=True):
            side.all_lines = np.array(lines, np.int64)
            side.lines = side.all_lines[side.pos] if len(lines) else side.all_lines
            side.starts = np.append(True, np.diff(side.lines) != 0)[: len(side.x)]
    if "said" in table.column_names:
        for side, said in zip(sides, table.column("said").to_pylist(), strict=True):
            side.row = said.split("\n") if said else []
            side.words = [side.row[p] for p in side.pos.tolist()]
    return sides, len(kinds), keys


def comparison(pairs: DataFrame, docs: DataFrame, result: Callable, fields: dict[str, pa.DataType], matched: bool = True, chained: bool = True, opened: Callable = lambda side: None, chunk: int = CHUNK) -> DataFrame:
    """a, b and ``fields``; ``result`` takes both sides of a pair, the rising places i and j of their matched words (C5) and the keys by number.

    ``docs`` has doc_id, text (the keys, a line each) and, as ``result`` needs, lines (of each word) and said (the words, a line
    each).  If not ``matched``, i and j are the runs of three words that are once on each side (C3), or their longest rising chain (C4).
    """

    def of_block(table: pa.Table) -> Callable:
        sides, kinds, keys = _sides(table)
        for side in sides:
            opened(side)
        place, placed, known = np.full(kinds, -1, np.int64), [None], {}

        def found(a: int, b: int) -> tuple:
            p, q = sides[a], sides[b]
            if placed[0] != a:
                if placed[0] is not None:
                    place[sides[placed[0]].runs] = -1
                place[p.runs], placed[0] = p.at, a
            i = place[q.runs]
            there = i >= 0
            i, j = i[there], q.at[there]
            if len(i) and (np.diff(i) < 0).any():
                order = np.argsort(i)
                i, j = i[order], j[order]
                if chained:
                    kept = longest_rising(j.tolist())
                    i, j = i[kept], j[kept]
            if matched:
                if len(known) > MOST_GAPS:
                    known.clear()
                i, j = R.filled(p.x, q.x, i, j, known)
            return result(p, q, i, j, keys)

        return found

    return in_blocks(pairs, docs, of_block, fields, chunk)


def anchors(pairs: DataFrame, docs: DataFrame, chained: bool = False) -> DataFrame:
    """A, b, i, j where a run of three words occurs once on each side; C4: if ``chained``, those of a longest rising chain."""
    return comparison(pairs, docs, lambda p, q, i, j, keys: (i, j), {"i": INT, "j": INT}, matched=False, chained=chained)


def matched_words(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """A, b, i, j of all matched words."""
    return comparison(pairs, docs, lambda p, q, i, j, keys: (i, j), {"i": INT, "j": INT})


def similarity(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Matched words as a share of the longer side; 1 if both are empty."""

    def share(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        longer = max(len(p.x), len(q.x))
        return [len(i)], [len(i) / longer if longer else 1.0]

    return comparison(pairs, docs, share, {"matched": LONG, "similarity": DOUBLE})


def _gaps(runs: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """o_lo, o_hi, r_lo, r_hi between runs, one more than these; some may be empty on both sides."""
    i, j, n = runs.T
    return np.stack([np.append(0, i + n), np.append(i, n_a), np.append(0, j + n), np.append(j, n_b)], axis=1)


def change_rows(runs: np.ndarray, n_a: int, n_b: int, near: int = NEAR) -> np.ndarray:
    """The ranges of the changes, in order; changes ``near`` matched words apart are one."""
    gaps = _gaps(runs, n_a, n_b)
    gaps = gaps[(gaps[:, 1] > gaps[:, 0]) | (gaps[:, 3] > gaps[:, 2])]
    if not len(gaps):
        return gaps
    first = np.nonzero(np.append(True, gaps[1:, 0] - gaps[:-1, 1] > near))[0]
    last = np.append(first[1:], len(gaps)) - 1
    return np.stack([gaps[first, 0], gaps[last, 1], gaps[first, 2], gaps[last, 3]], axis=1)


def _numbered(rows: np.ndarray) -> tuple:
    return np.arange(1, len(rows) + 1), *rows.T


def changes(pairs: DataFrame, docs: DataFrame, near: int = NEAR) -> DataFrame:
    """A, b, change_no, o_lo, o_hi, r_lo, r_hi (half-open)."""
    return comparison(pairs, docs, lambda p, q, i, j, keys: _numbered(change_rows(R.runs_of(i, j), len(p.x), len(q.x), near)), {"change_no": LONG, **RANGES})


def _shift(p: _Side, q: _Side, gap: list[int], before: int, after: int) -> int:
    """By how many words a change on one side is to slide to start at a line's start (``compare.slid_to_lines``)."""
    o_lo, o_hi, r_lo, r_hi = gap
    if (o_lo == o_hi) == (r_lo == r_hi):
        return 0
    side, lo, hi = (q, r_lo, r_hi) if o_lo == o_hi else (p, o_lo, o_hi)
    x, starts, n = side.x, side.starts, len(side.x)
    if lo < n and starts[lo]:
        return 0
    for s in range(1, min(hi - lo, before, SLIDE) + 1):
        if lo < s or x[lo - s] != x[hi - s]:
            break
        if starts[lo - s]:
            return -s
    for s in range(1, min(hi - lo, after, SLIDE) + 1):
        if hi + s > n or x[lo + s - 1] != x[hi + s - 1]:
            break
        if starts[lo + s]:
            return s
    return 0


def slid_changes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Changes on one side only, moved by ``SLIDE`` words at most to start at a line's start, with shift."""

    def slid(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        rows = change_rows(R.runs_of(i, j), len(p.x), len(q.x))
        shift = np.array([_shift(p, q, c, SLIDE, SLIDE) for c in rows.tolist()], np.int64)
        return *_numbered(rows + shift[:, None]), shift

    return comparison(pairs, docs, slid, {"change_no": LONG, **RANGES, "shift": LONG})


def _slid_runs(p: _Side, q: _Side, runs: np.ndarray) -> np.ndarray:
    """``revisions.slid_matches`` of a pair."""
    n = [*runs[:, 2].tolist(), 0]
    want = [_shift(p, q, g, n[k - 1] if k else 0, n[k]) for k, g in enumerate(_gaps(runs, len(p.x), len(q.x)).tolist())]
    clash = [x > 0 > y and x - y > m for x, y, m in zip(want, want[1:], n, strict=False)]
    shift = np.array([0 if (k < len(clash) and clash[k]) or (k and clash[k - 1]) else s for k, s in enumerate(want)], np.int64)
    slid = np.stack([runs[:, 0] + shift[:-1], runs[:, 1] + shift[:-1], runs[:, 2] - shift[:-1] + shift[1:]], axis=1)
    return slid[slid[:, 2] > 0]


def _with_moves(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    runs = _slid_runs(p, q, R.runs_of(i, j))
    moves = R._moved(p.x, q.x, runs, R.MOVED_RUN, R.STRAY_RUN)
    return runs, moves[np.lexsort((moves[:, 0], moves[:, 1]))]


def move_ranges(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """A, b, move_no, o_lo, o_hi, r_lo, r_hi (half-open) of the moves, in the order of the revision."""

    def moved(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        i, j, n = _with_moves(p, q, i, j)[1].T
        return np.arange(1, len(i) + 1), i, i + n, j, j + n

    return comparison(pairs, docs, moved, {"move_no": INT, **{c: INT for c in R.RANGES}})


def changes_but_moves(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The changes of what didn't move, in places of all words."""

    def changed(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        runs, moves = _with_moves(p, q, i, j)
        rows = R.kept_changes(len(p.x), len(q.x), runs, moves) if len(moves) else change_rows(runs, len(p.x), len(q.x)).tolist()
        return _numbered(np.array(rows, np.int64).reshape(-1, 4))

    return comparison(pairs, docs, changed, {"change_no": LONG, **RANGES})


def change_report(pairs: DataFrame, docs: DataFrame, most: int = REPORT_WORDS) -> DataFrame:
    """Removed and added words (at most ``most`` of each) of every change."""

    def told(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        rows = change_rows(R.runs_of(i, j), len(p.x), len(q.x)).tolist()
        said = lambda side, lo, hi: " ".join(side.words[lo : min(hi, lo + most)])
        kinds = ["added" if o_hi == o_lo else "removed" if r_hi == r_lo else "changed" for o_lo, o_hi, r_lo, r_hi in rows]
        return np.arange(1, len(rows) + 1), kinds, [said(p, c[0], c[1]) for c in rows], [said(q, c[2], c[3]) for c in rows]

    return comparison(pairs, docs, told, {"change_no": LONG, "kind": STRING, "removed": STRING, "added": STRING})


def _boxes_of(side: _Side, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
    """change_no, page_index, line_no, kind, x0, y0, x1, y1 of the ranges of a side (``compare.change_boxes``)."""
    page, line, *corners = side.boxes
    out, n = [], hi - lo
    if n.any():
        change = np.repeat(np.arange(len(lo)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        first = np.nonzero(np.append(True, (np.diff(change) != 0) | (np.diff(page[at]) != 0) | (np.diff(line[at]) != 0)))[0]
        ends = [f.reduceat(c[at], first) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), corners, strict=True)]
        out += zip((change[first] + 1).tolist(), page[at][first].tolist(), line[at][first].tolist(), ["text"] * len(first), *(e.tolist() for e in ends), strict=True)
    for k in np.nonzero(n == 0)[0].tolist() if len(page) else ():
        start = max(int(lo[k]) - 30, 0)
        near = range(start, max(int(hi[k]), start + 1))
        near = [w for w in near if page[w] == page[near[-1]]]
        x0, y0, x1, y1 = corners
        w = max(near, key=lambda w: (y1[w], x1[w], x0[w], y0[w], page[w], line[w]))
        left = float(x1[w] + 1 if lo[k] > 0 else x0[w] - 3)
        out.append((k + 1, int(page[w]), int(line[w]), "gap", left, float(y0[w]), left + 2, float(y1[w])))
    return out


def change_boxes(pairs: DataFrame, docs: DataFrame, boxes: Callable) -> DataFrame:
    """A, b, change_no, side, page_index, line_no, kind, x0, y0, x1, y1 (``compare.change_boxes``).

    ``boxes`` gives page_index, line_no, x0, y0, x1, y1 of all words of a document by its words and their lines.
    """

    def placed(side: _Side) -> None:
        side.boxes = [c[side.pos] for c in boxes(side.row, side.all_lines)]

    def boxed(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        c = change_rows(R.runs_of(i, j), len(p.x), len(q.x))
        rows = [(r[0], k, *r[1:]) for k, side in enumerate((p, q)) for r in _boxes_of(side, c[:, 2 * k], c[:, 2 * k + 1])]
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * 9

    fields = {"change_no": LONG, "side": INT, "page_index": INT, "line_no": INT, "kind": STRING, "x0": DOUBLE, "y0": DOUBLE, "x1": DOUBLE, "y1": DOUBLE}
    return comparison(pairs, docs, boxed, fields, opened=placed)


def position_map(pairs: DataFrame, docs: DataFrame, pitch: float) -> DataFrame:
    """C11: a, b, y, mapped: every line with words of the original, mapped to a height in the revision (``compare.line_anchors``, ``mapped_places``)."""

    def mapped(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        met = np.unique(np.stack([p.lines[i], q.lines[j]], axis=1), axis=0)
        reached = np.maximum.accumulate(met[:, 1])
        met = met[np.append(True, met[1:, 1] > reached[:-1])[: len(met)]] * pitch
        y = np.unique(p.all_lines) * pitch
        if not len(met):
            return y, np.full(len(y), np.nan)
        down = np.searchsorted(met[:, 0], y, "right")
        (up_o, up_r), (down_o, down_r) = met[np.maximum(down - 1, 0)].T, met[np.minimum(down, len(met) - 1)].T
        o_gap, r_gap, into = down_o - up_o, down_r - up_r, y - up_o
        held = (o_gap <= 0) | (o_gap > HOLD_GAP) | (r_gap > HOLD_GAP)
        between = np.where(held, up_r + np.minimum(into, r_gap), up_r + into / np.where(held, 1.0, o_gap) * r_gap)
        return y, np.where(down == 0, y + down_r - down_o, np.where(down == len(met), up_r + into, between))

    return comparison(pairs, docs, mapped, {"y": DOUBLE, "mapped": DOUBLE})


def _renumbered(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``compare.renumbered`` of a pair: word numbers of both sides with links to the same place as one word each."""
    n, at = (len(p.x), len(q.x)), dict(zip(i.tolist(), j.tolist(), strict=True))
    x = p.x.tolist(), q.x.tolist()
    # link_no, lo, hi, target, name of the links that have words
    links = [[link for link in side.links if link[1] < min(link[2], n[k])] for k, side in enumerate((p, q))]
    targets = [{link[3] for link in side.links if link[3] is not None} for side in (p, q)]
    votes = Counter((ta, tb) for ta in targets[0] for i in range(ta, ta + VOTING) if i in at for tb in range(at[i] - VOTING + 1, at[i] + 1) if tb in targets[1])
    best: dict[int, tuple[int, int]] = {}  # of ta: votes, -tb
    for (ta, tb), count in votes.items():
        best[ta] = max(best.get(ta, (0, 0)), (count, -tb))
    best = {ta: b for ta, b in best.items() if b[0] >= VOTES}

    read = lambda k, link: tuple(x[k][link[1] : link[2]])
    named = [defaultdict(list), defaultdict(list)]
    for k in (0, 1):
        for link in sorted(links[k], key=lambda link: link[0]):
            if link[4] is not None:
                named[k][link[4]].append(link)
    shared = set()
    for name in named[0].keys() & named[1].keys():
        ours, theirs = named[0][name], named[1][name]
        alike = [read(0, link) for link in ours] == [read(1, link) for link in theirs]
        ta, tb = (max((link[3] for link in some if link[3] is not None), default=None) for some in (ours, theirs))
        denied = ta in best and tb is not None and -best[ta][1] != tb and best[ta][0] > votes.get((ta, tb), 0) and not alike
        if not denied:
            shared.add(name)

    first: dict[int, int] = {}  # one counterpart on either side
    for ta, (_, tb) in best.items():
        first[-tb] = min(first.get(-tb, ta), ta)
    places = {ta: ta for ta in first.values()}, first
    keyed = [[], []]
    for k in (0, 1):
        for link in sorted(links[k], key=lambda link: link[0]):
            key = ("n", link[4]) if link[4] in shared else ("t", places[k][link[3]]) if link[3] in places[k] else None
            if key:
                keyed[k].append((link, key))

    # words that differ between links to one place, paired in order
    listed = [defaultdict(list), defaultdict(list)]
    for k in (0, 1):
        for link, key in keyed[k]:
            listed[k][key].append(link)
    rows = [np.cumsum(side.starts) for side in (p, q)]
    new: dict[int, int] = {}
    for key in listed[0].keys() & listed[1].keys():
        met = [(a, b, read(0, a), read(1, b)) for a, b in zip(listed[0][key], listed[1][key], strict=False)]
        swaps = {(u, v) for _, _, s, t in met if len(s) == len(t) for u, v in zip(s, t, strict=True) if u != v}
        a, b, s, t = met[0]
        if not swaps or len(s) != len(t) or a[3] is None or b[3] is None:
            continue
        for step in range(VOTING):
            u, v = a[3] + step, b[3] + step
            if u < n[0] and v < n[1] and rows[0][u] == rows[0][a[3]] and rows[1][v] == rows[1][b[3]] and (x[0][u], x[1][v]) in swaps:
                new[v] = min(new.get(v, x[0][u]), x[0][u], key=keys.__getitem__)

    numbers: dict[tuple, int] = {}
    out = []
    for k in (0, 1):
        covered = {w for link, _ in keyed[k] for w in range(link[1], link[2])}
        words = [(w, -1, new.get(w, c) if k else c) for w, c in enumerate(x[k]) if w not in covered]
        words += [(link[1], link[0], numbers.setdefault(key, len(keys) + len(numbers))) for link, key in keyed[k]]
        out.append(np.array([w[2] for w in sorted(words)], np.int32))
    return out[0], out[1]


def renumbered_changes(pairs: DataFrame, docs: DataFrame, links: Callable) -> DataFrame:
    """The changes of ``compare.renumbered`` words; ``links`` gives link_no, lo, hi, target and name of a document's links by where its lines start."""

    def linked(side: _Side) -> None:
        side.links = links(side.starts)

    def changed(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, keys: list[str]) -> tuple:
        x, y = _renumbered(p, q, i, j, keys)
        return _numbered(change_rows(R.runs_of(*R.word_matches(x, y, {})), len(x), len(y)))

    return comparison(pairs, docs, changed, {"change_no": LONG, **RANGES}, opened=linked)
