"""Golden cases on tiny tables, and SQL twins on the smallest data."""

import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.matches import matches, smart_pattern
from quire.operators import chains, compare, elements, layout, outline, page_sets, passage_index, references, retrieval, review, search, sensitive, takeoff
from quire.streaming import state

SMALL = "/root/testdata/sf0.001"
PAGE = "doc_id long, page_index int, text string"


def page(spark, *texts):
    return spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], PAGE)


def found(frame):
    return sorted((r["doc_id"], r["start"], r["matched"]) for r in frame.collect())


def test_offsets(spark):
    rows = page(spark, "abcabc", "", "xabx", None).select("doc_id", matches(F.col("text"), "ab").alias("m")).collect()
    assert {r["doc_id"]: [(m["start"], m["len"]) for m in r["m"] or []] for r in rows} == {0: [(0, 2), (3, 2)], 1: [], 2: [(1, 2)], 3: []}


def test_smart_search_takes_dashes_for_spaces(spark):
    texts = page(spark, "cross reference, cross-reference, cross–reference", "say ‘so’ and 'so'", "crossreference")
    assert len(search.search(texts, "cross reference").collect()) == len(search.search(texts, '"cross-reference"').collect()) == 3
    assert len(search.search(texts, "say 'so' and").collect()) == 1
    assert search.search(texts, "cross", whole_word=True).count() == 3
    assert re.fullmatch(smart_pattern("a.b"), "a.b") and not re.fullmatch(smart_pattern("a.b"), "axb")


def test_wrapped_words_are_found(spark):
    pages = page(spark, "an AFFILIAT-\nED here", "an affiliat-\ned here\n12\nmore")
    hits = {(r["doc_id"], r["in_joined"], r["in_hyphened"]) for r in search.matching_pages(pages, "affiliat-ed").collect()}
    assert (0, True, True) in hits
    assert {r["doc_id"] for r in search.matching_pages(pages, "affiliated").collect()} == {1}


def test_ignored_patterns(spark):
    assert search.usable_patterns(spark, ["(", "x*", r"\[\d+\]"]) == [r"\[\d+\]"]
    got = search.search_ignoring(page(spark, "cats [1]and dogs, cats and dogs"), "cats and", [r"\[\d+\]"]).collect()
    assert sorted((r["start"], r["len"], r["direct"]) for r in got) == [(0, 11, False), (18, 8, True)]


def test_presets(spark):
    texts = page(spark, "123-45-6789 and 123456789", "a@b.co, c.d@e.org", "4111-1111-1111-1111", "Tel:555-123-4567", "12/31/2020, 2020-12-31, 5 Jan 2021")
    counts = {(r["doc_id"], r["preset"]): r["count"] for r in sensitive.scan(texts).groupBy("doc_id", "preset").count().collect()}
    assert counts[(0, "ssn")] == 2 and counts[(1, "email")] == 2 and counts[(2, "card")] == 1 and (0, "card") not in counts and counts[(3, "phone")] == 1 and counts[(4, "date")] == 3


def test_redaction_leaves_no_finding(spark):
    texts = page(spark, "mail a@b.co or a@b.co now", "none")
    masked = sensitive.redact(texts, sensitive.scan(texts))
    assert {r["doc_id"]: r["text"] for r in masked.collect()}[0] == "mail ██████ or ██████ now"
    assert {r["found"] for r in sensitive.leak_audit(masked).collect()} == {0}
    titles = spark.createDataFrame([(0, "About A@B.CO today"), (1, "a@b.co")], "doc_id long, title string")
    found = sensitive.whole_words(sensitive.scan(texts), texts)
    assert {r["title"] for r in sensitive.redact_titles(found, titles).collect()} == {"About [Redacted] today", "a@b.co"}


def test_titles_lose_whole_words(spark):
    pages = page(spark, "John Smithson, 123-45-6789")
    found = spark.createDataFrame([(0, 0, 0, 10, "John Smith"), (0, 0, 15, 11, "123-45-6789")], "doc_id long, page_index int, start int, len int, matched string")
    titles = spark.createDataFrame([(0, "Smithson, JOHN"), (0, "SSN 123-45-6789 on file"), (0, "Smith and Johnson")], "doc_id long, title string")
    assert {r["title"] for r in sensitive.redact_titles(sensitive.whole_words(found, pages), titles).collect()} == {"[Redacted], [Redacted]", "SSN [Redacted] on file", "Smith and Johnson"}


@pytest.mark.parametrize("preset", ["phone", "date"])
def test_formats_of_phones_and_dates(spark, preset):
    texts = {
        "phone": ["+1 (555) 123-4567", "555-123-4567", "+44 20 7946 0958", "020 7946 0958", "+49 30 123456", "03-1234-5678"],
        "date": ["12/31/2026", "31/12/2026", "31-12-2026", "2026-12-31", "25 Dec 2026", "25-December-2026", "01.02.2024", "15 Jan 24"],
    }[preset]
    assert {r["doc_id"] for r in sensitive.scan(page(spark, *texts)).where(f"preset = '{preset}'").collect()} == set(range(len(texts)))
    assert sensitive.scan(page(spark, "25 marvel 2026", "word5551234567")).where("preset = 'date'").count() == 0


def test_follow_up_questions(spark):
    asked = ["What about its price?", "Why?", "Tell me more", "Does the manual say that the frame is red here", "Where is the third table of values", "What does the manual say about frames"]
    turns = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(asked)], "conv_id long, turn long, role string, text string")
    assert [r["is_follow_up"] for r in retrieval.folded_questions(turns).orderBy("turn").collect()] == [True, True, True, False, False, False]


def test_indexed_search_is_the_whole_search(spark):
    rng = random.Random(5)
    stems = ["harbor", "har", "bor", "cliff", "cliffs", "of", "is a", "means", "ox", "crane", "lantern", "tide", "x9"]
    texts = [(k, " ".join(rng.choice(stems) + rng.choice(["", "", "s", ", "]) for _ in range(rng.randrange(12)))) for k in range(150)] + [(150, None), (151, "see $%& here"), (152, "")]
    vec = lambda: [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]
    passages = spark.createDataFrame([(k, t, vec() if k % 5 else None) for k, t in texts], "passage_id long, text string, vec array<float>")
    asks = ["What is a harbor cliff?", "har", "Define cliffs of", "lantern tide crane harbor ox x9", "$%&", "", None, "zebra", "zebra tide", "what is the bor is a"]
    questions = spark.createDataFrame([(k, t, vec()) for k, t in enumerate(asks)], "q_id long, text string, vec array<float>")
    every = retrieval.lexical_scores(questions.where("text IS NOT NULL"), passages)
    for k in (1, 3, 10):
        best = {}
        for r in every.collect():
            best.setdefault(r["q_id"], []).append((-r["lexical"], r["passage_id"]))
        right = {(q, p, -s) for q, found in best.items() for s, p in sorted(found)[:k]}
        got = {(r["q_id"], r["passage_id"], r["lexical"]) for r in passage_index.lexical_topk(questions, passages, k).collect()}
        assert got == right and {q for q, _, _ in right} == {0, 1, 2, 3, 4, 8, 9}
    known = questions.where("text IS NOT NULL")
    assert rows_of(passage_index.hybrid(known, passages, 4, 3)) == rows_of(retrieval.hybrid(known, passages, 4, 3))


def test_definitions_score_above_mentions(spark):
    questions = spark.createDataFrame([(1, "What is the control field?", [1.0, 0.0]), (2, "of", [0.0, 0.0])], "q_id long, text string, vec array<float>")
    texts = ["The control  field\nindicates the kind.", "A control field, which", "controlling fields of", "none"]
    passages = spark.createDataFrame([(k, t, [1.0, float(k)]) for k, t in enumerate(texts)] + [(9, None, [1.0])], "passage_id long, text string, vec array<float>")
    got = {(r["q_id"], r["passage_id"]): r["lexical"] for r in retrieval.lexical_scores(questions, passages).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 0.6, (1, 2): 0.25}
    near = {(r["q_id"], r["passage_id"]): round(r["similarity"], 3) for r in retrieval.vector_scores(questions, passages).collect()}
    assert near[(1, 0)] == 1 and near[(1, 1)] == 0.707 and near[(1, 9)] == near[(2, 0)] == -1
    best = [(r["passage_id"], r["rank"]) for r in retrieval.hybrid(questions, passages, 2, 1).where("q_id = 1").orderBy("rank").collect()]
    assert best == [(0, 1), (1, 2)]


def test_chunks(spark):
    long = "x" * 4000
    got = retrieval.chunks(page(spark, "short", "a text of twenty characters", long)).collect()
    lengths = [(r["doc_id"], r["chunk_no"], len(r["text"])) for r in sorted(got, key=lambda r: (r["doc_id"], r["chunk_no"]))]
    assert lengths == [(1, 0, 27), (2, 0, 1500), (2, 1, 1500), (2, 2, 1400)]


def test_headings_nest(spark):
    heads = spark.createDataFrame([(1, k, level) for k, level in enumerate([1, 3, 2, 1, 2])], "doc_id long, seq long, level int")
    assert [r["parent"] for r in outline.nested(heads).orderBy("seq").collect()] == [None, 0, 0, None, 3]


def test_sections(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 100.0), (1, 1, 0, 300.0), (1, 2, 1, None)], "doc_id long, node_no long, page_index int, y double")
    places = spark.createDataFrame([(1, 0, 0, 50.0), (1, 1, 0, 95.0), (1, 2, 0, 299.0), (1, 3, 1, 0.0), (2, 4, 0, 0.0)], "doc_id long, place_no long, page_index int, y double")
    assert {r["place_no"]: r["section"] for r in outline.sections_of(places, nodes).collect()} == {0: None, 1: 0, 2: 1, 3: 2, 4: None}


def test_tables_of_characters(spark):
    def chars(doc, line, x, y, text):
        return [(doc, 0, line, k, c, x + 5.0 * k, x + 5.0 * k + 5, float(y), y + 10.0, 10.0) for k, c in enumerate(text)]

    rows = []
    for n in range(12):  # two columns of text, whose lines are cut by the gutter
        rows += chars(1, n, 72, 100 + 14 * n, "a line of text on the left") + [(1, 0, n, 50 + k, c, 320 + 5.0 * k, 325 + 5.0 * k, 100.0 + 14 * n, 110.0 + 14 * n, 10.0) for k, c in enumerate("and one more on the right")]
    for n, (a, b, c) in enumerate([("Item", "Pieces", "Price"), ("Bolt", "12", "0.50"), ("Long nut", "7", "1.25")]):
        rows += [x for at, t in ((72, a), (200, b), (300, c)) for x in chars(2, n, at, 100 + 14 * n, t)]
    rows = [(d, p, line, k, *rest) for k, (d, p, line, _, *rest) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, char_no int, ch string, x0 double, x1 double, y0 double, y1 double, size double")
    pieces = layout.row_pieces(table)
    gutter = layout.gutters(pieces.withColumn("line_no", F.col("row")), 612)
    assert {r["doc_id"] for r in layout.borderless_tables(pieces).collect()} == {1, 2}
    cells = {(r["doc_id"], r["row_no"], r["col_no"]): r["text"] for r in layout.borderless_tables(pieces, gutter).collect()}
    assert len(cells) == 9 and cells[2, 3, 0] == "Long nut" and cells[2, 1, 2] == "Price" and cells[2, 2, 1] == "12"


def test_elements_and_their_export(spark):
    def line(page, n, text, x0, y0, x1, size=10.0, bold=False):
        return (1, page, n, text, float(x0), float(y0), float(x1), y0 + size, size, bold)

    rows = [line(0, 0, "A Title", 72, 100, 200, 16.0), line(0, 1, "Words of a para-", 72, 140, 300), line(0, 2, "graph that goes", 72, 154, 200), line(0, 3, "on.", 205, 155, 230)]
    rows += [line(0, 4, "Bold Head", 72, 190, 140, 10.0, True), line(0, 5, "Text below.", 72, 220, 180), line(0, 6, "x 1", 80, 255, 120), line(0, 7, "Behind the table.", 72, 320, 200)]
    rows += [line(1, n, f"left {n}", 72, 100 + 14 * n, 250) for n in range(6)] + [line(1, 6 + n, f"right {n}", 330, 100 + 14 * n, 500) for n in range(6)]
    lines = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean")
    cells = spark.createDataFrame([(1, 0, 0, r, c, t, 72.0 + 100 * c, 250.0 + 20 * r, 172.0 + 100 * c, 270.0 + 20 * r) for r, c, t in [(0, 0, "x"), (0, 1, "1"), (1, 0, ""), (1, 1, "2")]], "doc_id long, page_index int, table_no int, row int, col int, text string, x0 double, y0 double, x1 double, y1 double")
    gutter = layout.gutters(lines, 612)
    got = [(r["page_index"], r["kind"], r["level"], r["text"]) for r in elements.elements(lines, gutter, cells).orderBy("page_index", "seq").collect()]
    left, right = (" ".join(f"{side} {n}" for n in range(6)) for side in ("left", "right"))
    first = [("heading", 1, "A Title"), ("paragraph", None, "Words of a paragraph that goes on."), ("heading", 2, "Bold Head"), ("paragraph", None, "Text below."), ("table", None, "x\t1\n2"), ("paragraph", None, "Behind the table.")]
    assert got == [(0, *e) for e in first] + [(1, "paragraph", None, left), (1, "paragraph", None, right)]
    text = elements.layout_export(elements.elements(lines, gutter, cells)).first()["text"]
    assert text == "--- Page 1 ---\n\n" + "\n\n".join(e[2] for e in first) + f"\n\n--- Page 2 ---\n\n{left}\n\n{right}"
    assert elements.layout_export(elements.elements(lines.where("doc_id < 0"), gutter, cells.where("doc_id < 0"))).count() == 0


def test_running_lines_and_joins(spark):
    rows = [(1, p, k, t, y, y + 11) for p in range(6) for k, (t, y) in enumerate([("Head", 20.0), (f"body {p} {'abcdef'[p]}", 300.0), (f"{p + 1}", 770.0)])]
    lines = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, y0 double, y1 double")
    assert {r["text"] for r in layout.running_lines(lines, 792).where("NOT is_running").collect()} == {f"body {p} {'abcdef'[p]}" for p in range(6)}
    texts = spark.range(1).select(layout.join_lines(F.array(F.lit("a word-"), F.lit("break"), F.lit("Pre-"), F.lit("Fix"))).alias("t")).first()["t"]
    assert texts == "a wordbreak Pre- Fix"


def revision(spark, a, b):
    """Two texts; line ends count as white space and as line starts."""
    rows = [(d, k, w, re.sub(r"[^\w]", "", w.lower()), 0, n) for d, text in ((1, a), (2, b)) for k, (n, w) in enumerate((n, w) for n, line in enumerate(text.split("\n")) for w in line.split())]
    words = spark.createDataFrame(rows, "doc_id long, pos int, word string, key string, page_index int, line_no int")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    paired = compare.paired_words(pairs, words)
    return paired, compare.matches(paired, compare.chain(compare.anchors(paired)))


def spoken(paired, side, lo, hi):
    return " ".join(r["word"] for r in paired.where(f"side = {side} AND i >= {lo} AND i < {hi}").orderBy("i").collect())


HEADING = "9.6.11.7 Antenna Selection Indices Feedback frame format\nThe frame is an Action frame of category HT, as defined below."
TABLE = "Table 9-599 Noncompressed Beamforming frame Action field format\nOrder Information 1 Category 2 HT Action 3 MIMO Control"
AFTER = "The Category field is defined in the Action field clause."


def test_moved_text_is_no_change(spark):
    paired, same = revision(spark, "\n".join([HEADING, TABLE, AFTER]), "\n".join([TABLE, HEADING, AFTER.replace("Category", "Kind")]))
    moved = compare.moves(paired, same)
    (move,) = compare.move_ranges(moved).collect()
    text = spoken(paired, 0, move["o_lo"], move["o_hi"])
    assert text in {HEADING.replace("\n", " "), TABLE.replace("\n", " ")} and spoken(paired, 1, move["r_lo"], move["r_hi"]) == text
    (change,) = compare.changes_but_moves(paired, same, moved).collect()
    assert (spoken(paired, 0, change["o_lo"], change["o_hi"]), spoken(paired, 1, change["r_lo"], change["r_hi"])) == ("Category", "Kind")


def test_text_moved_far(spark):
    clauses = [f"Clause {k}: the party number {k * 7} shall deliver item {k * 13} to the site named {k * 3} at once" for k in range(60)]
    other = clauses[:40] + clauses[41:]
    other.insert(5, clauses[40])
    paired, same = revision(spark, "\n".join(clauses), "\n".join(other))
    same = compare.slid_matches(paired, same)
    assert same.join(paired.where("side = 0").select("i", F.col("key").alias("x")), "i").join(paired.where("side = 1").select(F.col("i").alias("j"), F.col("key").alias("y")), "j").where("x != y").count() == 0
    moved = compare.moves(paired, same)
    (move,) = compare.move_ranges(moved).collect()
    assert spoken(paired, 1, move["r_lo"], move["r_hi"]) == clauses[40]
    assert compare.changes_but_moves(paired, same, moved).count() == 0


def test_a_few_words_in_common_are_no_move(spark):
    head, tail = "alpha beta gamma delta epsilon one two three four five six seven", "zeta eta theta iota kappa"
    paired, same = revision(spark, f"{head}\nthe clause of the contractor shall supply goods was here\n{tail}", f"a new clause of the contractor shall supply services\n{head}\n{tail}")
    assert compare.moves(paired, same).count() == 0
    assert [spoken(paired, 0, r["o_lo"], r["o_hi"]) for r in compare.changes(paired, same).orderBy("o_lo").collect()] == ["", "the clause of the contractor shall supply goods was here"]


def test_added_text_begins_at_a_line(spark):
    before, clause, after = "Clause 249: goods go to the site.", "Clause 250: tools go to the site.", "Clause 251: staff go home."
    paired, same = revision(spark, f"{before}\n{after}", f"{before}\n{clause}\n{after}")
    found = compare.changes(paired, same)
    slid = compare.slid_to_lines(found, paired).collect()
    assert [spoken(paired, 1, r["r_lo"], r["r_hi"]) for r in slid] == [clause]
    late = found.selectExpr("pair_id", "change_no", "o_lo - 4 AS o_lo", "o_hi - 4 AS o_hi", "r_lo - 4 AS r_lo", "r_hi - 4 AS r_hi") if slid[0]["shift"] == 0 else found
    assert [spoken(paired, 1, r["r_lo"], r["r_hi"]) for r in compare.slid_to_lines(late, paired).collect()] == [clause]


def test_boxes_of_changes(spark):
    paired, same = revision(spark, "one two three four five six seven\neight nine", "one two THIRD FOURTH FIFTH six seven\nnine")
    boxes = spark.createDataFrame([(d, k, 0, int(k > 6), 10.0 * k, 20.0 * (k > 6), 10.0 * k + 8, 20.0 * (k > 6) + 11) for d in (1, 2) for k in range(9)], "doc_id long, pos int, page_index int, line_no int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["change_no"], r["side"]): (r["kind"], r["line_no"], r["x0"], r["x1"]) for r in compare.change_boxes(compare.changes(paired, same, near=0), paired, boxes).collect()}
    assert got == {(1, 0): ("text", 0, 20.0, 48.0), (1, 1): ("text", 0, 20.0, 48.0), (2, 0): ("text", 1, 70.0, 78.0), (2, 1): ("gap", 0, 69.0, 71.0)}


def test_gaps_have_anchors_of_their_own():
    # no run of three is there twice: single words, then the rarest ones
    assert compare.gap_matches("a x b y c".split(), "p a q b r c".split()) == [(0, 1), (2, 3), (4, 5)]
    assert compare.gap_matches("k k u v k".split(), "k w k k".split()) == [(0, 0), (1, 2), (4, 3)]
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(25))] for _ in range(2))
        got = compare.gap_matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_revisions(spark):
    text = " ".join(f"w{k} is here" for k in range(60))
    paired, same = revision(spark, text, text)
    assert compare.changes(paired, same).count() == 0 and compare.similarity(paired, same).first()["similarity"] == 1
    paired, one = revision(spark, text, text.replace("w30", "new"))
    report = compare.change_report(compare.changes(paired, one), paired).collect()
    assert [(r["kind"], r["removed"], r["added"]) for r in report] == [("changed", "w30", "new")]
    paired, more = revision(spark, text, text.replace("w30 is", "much was put in w30 is"))
    assert [(r["kind"], r["added"]) for r in compare.change_report(compare.changes(paired, more), paired).collect()] == [("added", "much was put in")]


def test_chains_in_blocks_are_the_whole_chains(spark):
    rng = random.Random(7)
    orders = [list(range(60)), list(range(40, 60)) + list(range(40)), rng.sample(range(90), 90), [k for two in zip(range(30), range(30, 60), strict=True) for k in two], [0], list(range(20))[::-1]]
    orders.append([x for base in (0, 30, 60) for x in rng.sample(range(base, base + 30), 30)])  # segments
    rows = [(n, n + 1, 2 * i, 3 * j) for n, order in enumerate(orders) for i, j in enumerate(order)]
    anchors = spark.createDataFrame(rows, "a long, b long, i long, j long")
    right = sorted((n, n + 1, 2 * k, 3 * order[k]) for n, order in enumerate(orders) for k in compare.longest_rising(order))
    for block, most in ((65_536, 1_000_000), (16, 40)):
        assert sorted(tuple(r) for r in chains.chain(anchors, block, most).collect()) == right, (block, most)
    assert chains.chain(anchors.where("a < 0")).count() == 0


def test_families_are_stars(spark):
    rng = random.Random(3)
    base = [[rng.randrange(10**6) for _ in range(30)] for _ in range(4)]
    texts = {}
    for d in range(80):  # families, some words of which change, and strangers that share a few runs
        own = list(base[d % 4])
        for _ in range(rng.choice([0, 1, 3, 9])):
            own[rng.randrange(30)] = rng.randrange(10**6)
        texts[d] = own
    texts.update({200: [1, 2], 201: [], 202: texts[3]})
    words = spark.createDataFrame([(d, k, f"w{w}") for d, t in texts.items() for k, w in enumerate(t)], "doc_id long, pos int, key string")
    sets = compare.run_sets(words)
    pairs = {frozenset((r["a"], r["b"])): r["similarity"] for r in compare.revision_pairs(sets).collect()}
    order = sorted((r["doc_id"] for r in sets.where("doc_id = class_id").collect()), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))
    leaders = []
    for d in order:
        if not any(frozenset((d, e)) in pairs for e in leaders):
            leaders.append(d)
    right = {d: (d, 1.0) if d in leaders else min(((e, pairs[frozenset((d, e))]) for e in leaders if frozenset((d, e)) in pairs), key=lambda x: (-x[1], x[0])) for d in order}
    got = {r["doc_id"]: (r["family_id"], r["similarity"]) for r in compare.families(sets).collect()}
    assert got == right and len(got) < len(leaders) * 12 and 200 not in got
    assert compare.families(sets.where("doc_id < 0")).count() == 0


def test_alignment_is_longest():
    assert compare.aligned(list("abcde"), list("xbxdx")) == [(1, 1), (3, 3)]
    assert compare.aligned(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]
    assert compare.aligned(["a"] * 3, ["b"] * 2000) == []
    assert compare.longest_rising([5, 1, 2, 9, 3]) == [1, 2, 4]


def test_long_gaps_with_few_edits_are_aligned():
    rng = random.Random(8)
    a = [str(rng.randrange(50)) for _ in range(6000)]
    b = ["first", *a[1:2500], "new", *a[2500:4000], *a[4300:-1], "last"]
    got = compare.aligned(a, b)
    assert len(got) == 5698 and all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert compare.aligned(a, b, 304) == [] and compare.aligned(a, b, 305) == got  # 2 changed at the ends, 1 new, 300 gone


def test_totals_use_the_first_unit(spark):
    marks = spark.createDataFrame([(1, 0, 1, "length", 283.4646, 0, 0), (1, 1, 2, "length", 283.4646, 0, 0), (1, 1, 3, "count", 0.0, 4, 0), (1, 1, 4, "count", 0.0, 4, 3)], "doc_id long, page_index int, mark_no long, type string, value double, group int, layer int")
    scales = spark.createDataFrame([(1, 1, takeoff.POINTS_PER_METRE / 50, "m")], "doc_id long, page_index int, per_unit double, unit string")
    rows = takeoff.schedule(takeoff.real_values(marks, scales), [3])
    assert {(r["page_index"], r["shown"]) for r in rows.collect()} == {(0, "10.00 m"), (1, "5.00 m"), (1, "1")}
    assert round(takeoff.totals(rows).first()["length"], 3) == 15.0
    assert takeoff.counts_by_group(rows).first()["n"] == 1


def test_threads(spark):
    rows = [(1, 1, None, "", 1), (1, 2, 1, "", 3), (1, 3, 2, "", 2), (1, 4, 1, "Accepted", 4), (1, 5, 1, "Rejected", 5), (1, 6, 99, "", 1), (1, 7, 8, "", 1), (1, 8, 7, "", 1)]
    comments = spark.createDataFrame([(d, o, p, s, c, "a", "Review") for d, o, p, s, c in rows], "doc_id long, obj long, parent_obj long, state string, created int, author string, state_model string")
    rooted = review.thread_roots(comments)
    assert {r["obj"]: r["root"] for r in rooted.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8}
    top = review.threads(rooted).where("root = 1").first()
    assert (top["reply_order"], top["status"]) == ("3,2", "Rejected")


def test_page_ranges_and_labels(spark):
    asked = spark.createDataFrame([(1, 9, "1-3, 5, 8-"), (2, 3, "3-1"), (3, 3, "2, 7")], "doc_id long, page_count long, spec string")
    got = {}
    for r in page_sets.page_ranges(asked).orderBy("doc_id", "at").collect():
        got.setdefault(r["doc_id"], []).append(r["page_index"])
    assert got == {1: [0, 1, 2, 4, 7, 8], 2: [2, 1, 0], 3: [1, -1]}
    numbers = spark.createDataFrame([(n,) for n in (1, 4, 9, 1994)], "n int").select(page_sets.roman(F.col("n")).alias("r"))
    assert [r["r"] for r in numbers.collect()] == ["I", "IV", "IX", "MCMXCIV"]


def test_line_snippets(spark):
    frame = spark.createDataFrame([("a short line", 2, 5), ("x" * 40 + "match" + "y" * 40, 40, 5)], "text string, start int, len int")
    got = [r["s"] for r in frame.select(search.line_snippet(F.col("text"), F.col("start"), F.col("len")).alias("s")).collect()]
    assert got == ["a short line", "..." + "x" * 30 + "match" + "y" * 30 + "..."]


def test_references(spark):
    texts = page(spark, "see Section 3.2(b) of the Master Agreement", "version 1.0.2 or 10.1.2.3", "as in 4.5.6 now")
    got = {(r["doc_id"], r["identifier"], r["base_id"], r["hint"]) for r in references.extract(texts).collect()}
    assert (0, "3.2(b)", "3.2", "Master Agreement") in got and (2, "4.5.6", "4.5.6", None) in got
    assert not any(d == 1 and i == "1.0.2" for d, i, *_ in got)


def test_lengths_as_drawings_write_them(spark):
    cases = [
        (72 / 18, "ft-in", "4'-0\""), (261.75 / 18, "ft-in", "14'-6 1/2\""), (184.875 / 18, "ft-in", "10'-3 1/4\""), (90.75 / 18, "ft-in", "5'-1/2\""), (46.5 / 18, "ft-in", "2'-7\""), (0.0, "ft-in", "0'-0\""), (-3.0, "ft-in", "0'-0\""),
        (2.5, "m", "2.50 m"), (3.14159, "cm", "3.1 cm"), (7.6, "mm", "8 mm"), (1.005, "ft", "1.00 ft"), (0.3125, "in", "5/16\""), (3.0, "in", "3\""), (11.99, "in", "12\""), (2.75, "in", "2 3/4\""),
    ]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, real double, unit string, want string")
    assert [r["got"] for r in frame.withColumn("got", takeoff.length_text(F.col("real"), F.col("unit"))).orderBy("k").collect()] == [c[2] for c in cases]
    areas = spark.createDataFrame([(1, 10.04, "ft-in"), (2, 10.4, "in"), (3, 2.0, "m"), (4, 20_000.0, "cm")], "k int, real double, unit string")
    assert [r["got"] for r in areas.withColumn("got", takeoff.area_text(F.col("real"), F.col("unit"))).orderBy("k").collect()] == ["10.0 sq ft", "10 sq in", "2.00 m²", "2.00 m²"]


def test_shapes(spark):
    cases = [
        ("rectangle", [(10, 10), (4, 2)], 48.0, 4), ("circle", [(0, 0), (3, 4)], 25 * math.pi, 180), ("arc", [(1, 0), (0, 1), (-1, 0)], math.pi, 91), ("arc", [(1, 0), (0, -1), (0, 1)], 1.5 * math.pi, 136),
        ("arc", [(0, 0), (1, 1), (2, 2)], 8**0.5, 2), ("arc", [(0, 0), (50, 1e-4), (100, 0)], 100.0, 2), ("arc", [(0, 0), (1, 1)], None, None), ("circle", [(0, 0)], None, None), ("rectangle", None, None, None), ("star", [(0, 0), (1, 1)], None, None),
    ]
    rows = [(k, kind, points and [(float(x), float(y)) for x, y in points]) for k, (kind, points, *_) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "k int, kind string, points array<struct<x:double,y:double>>")
    got = frame.select("k", takeoff.shape_value(F.col("kind"), F.col("points")).alias("v"), takeoff.traced(F.col("kind"), F.col("points")).alias("t")).orderBy("k").collect()
    for r, (_, _, value, drawn) in zip(got, cases, strict=True):
        assert (r["v"] is None) == (value is None) and (value is None or r["v"] == pytest.approx(value)) and (drawn is None or len(r["t"]) == drawn)
    assert got[3]["t"][45]["y"] == pytest.approx(-1) and got[3]["t"][-1]["y"] == pytest.approx(1)


def test_regions_take_replies_along(spark):
    marks = [
        (1, 0, 1, None, "note", 10, 10, 50, 30), (1, 0, 2, 1, "note", 400, 400, 410, 410), (1, 0, 3, 2, "popup", 0, 600, 9, 610), (1, 0, 4, None, "note", 50, 10, 90, 30), (1, 1, 5, 1, "note", 10, 10, 50, 30),
        (1, 0, 6, None, "link", 10, 10, 50, 30), (1, 0, 7, 6, "note", 300, 300, 320, 320), (1, 0, 8, None, "widget", 300, 90, 0, 20), (1, 0, 9, 8, "note", 500, 500, 510, 510), (1, 0, 10, 11, "note", 700, 700, 710, 710), (1, 0, 11, 10, "note", 20, 20, 25, 25),
        (1, 0, 12, 99, "widget", 700, 100, 710, 110), (1, 0, 13, 1, "widget", 700, 100, 710, 110), (2, 0, 1, None, "note", 10, 10, 50, 30), (1, 0, 14, None, None, 25, 25, 25, 40),
    ]
    frame = spark.createDataFrame([(*m[:5], *map(float, m[5:])) for m in marks], "doc_id long, page_index int, obj long, parent_obj long, kind string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    regions = spark.createDataFrame([(1, 0, 50.0, 30.0, 5.0, 5.0), (1, 0, 0.0, 0.0, 50.0, 300.0)], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    kept = {(r["doc_id"], r["page_index"], r["obj"]) for r in sensitive.scrub_regions(frame, regions).collect()}
    # 1 goes with 2 and 3; 8 is a field and goes without 9; 10 and 11 answer each other; 4 only touches the edge; 13 is a field and no reply; 14 has no area
    assert kept == {(1, 0, 4), (1, 1, 5), (1, 0, 6), (1, 0, 7), (1, 0, 9), (1, 0, 12), (1, 0, 13), (2, 0, 1), (1, 0, 14)}


def test_outlines_of_any_depth(spark):
    chain = [(1, k, k - 1 if k else None, f"t{k}") for k in range(40)]
    odd = [(2, 0, 99, "lost"), (2, 1, 0, "child"), (3, 0, 1, "a"), (3, 1, 0, "b"), (3, 2, 1, "c"), (3, 3, 3, "self"), (3, 4, 2, "below"), (4, 0, None, None)]
    nodes = spark.createDataFrame(chain + odd, "doc_id long, node_no long, parent_no long, title string").repartition(4)
    got = {(r["doc_id"], r["node_no"]): (r["depth"], r["path"], r["path_nos"]) for r in outline.outline_paths(nodes).collect()}
    assert all(got[1, k] == (k + 1, [f"t{j}" for j in range(k + 1)], list(range(k + 1))) for k in range(40))
    assert got[2, 1] == (2, ["lost", "child"], [0, 1]) and got[4, 0] == (1, [None], [0])
    assert all(got[3, k] == (1, [t], [k]) for k, t in enumerate(["a", "b", "c", "self", "below"]))
    assert outline.outline_paths(nodes.limit(0)).count() == 0


def found_in(spark, *texts):
    """Of each text: (kind, label, identifier, title, hint) of its references."""
    out = [[] for _ in texts]
    for r in references.extract(page(spark, *texts)).orderBy("doc_id", "start").collect():
        out[r["doc_id"]].append((r["kind"], r["label"], r["identifier"], r["title"], r["hint"]))
    return out


def test_reference_forms(spark):
    cases = {
        "as provided in Section 4.2(b) of the Master Services Agreement.": [("section", "Section", "4.2(b)", None, "Master Services Agreement")],
        "set out in Appendix C and Schedule 2, subject to Article II and § 12.3": [("appendix", "Appendix", "C", None, None), ("schedule", "Schedule", "2", None, None), ("article", "Article", "II", None, None), ("section", "§", "12.3", None, None)],
        "See the Table of Contents, part a of it, and the Partnership 2 clause": [],
        "Connect to 192.168.1.1, then retry with 1.0.2 or 2.03.1.": [],
        "as described in 35.5.2.3.1 and 9.4.2.170": [("section", None, "35.5.2.3.1", None, None), ("section", None, "9.4.2.170", None, None)],
        "per Section 3 in January.": [("section", "Section", "3", None, None)],
        "deliver under Section 3 to Buyer": [("section", "Section", "3", None, None)],
        "Section 3 of the Supply Agreement": [("section", "Section", "3", None, "Supply Agreement")],
        "Section 12 of Clean Air Act": [("section", "Section", "12", None, None)],
        "Section 5.6 of NIST SP 800-56A": [("section", "Section", "5.6", None, "NIST SP 800-56A")],
        "Section 4 of Schedule 2 applies": [("section", "Section", "4", None, None), ("schedule", "Schedule", "2", None, None)],
        "under the heading “Payment Terms” in the Supply Agreement": [("quoted title", None, "", "Payment Terms", "Supply Agreement")],
        "so-called “synergies” here": [],
        "shall follow the rules defined in 35.5.2.3.1 (General), where": [("section", None, "35.5.2.3.1", "General", None)],
        "see C.3 (MIB detail)": [("section", None, "C.3", "MIB detail", None)],
        "see 4.2 (Payment terms)": [("section", None, "4.2", "Payment terms", None)],
        "operates in the 2.4 GHz band per IEEE 802.11 and draft D3.0, about 1.5 times faster": [],
        "IEEE Std 802.11ax-2021 and 802.11be": [],
        "see Clause 35.5.2 (EHT UL MU operation)": [("clause", "Clause", "35.5.2", None, None)],
        "the rule in \"Section 4 of it\" stands": [("section", "Section", "4", None, None)],
        "see §§ 3": [("section", "§§", "3", None, None)],
        "sec. 3.1, Sections 4.2, clauses 7": [("section", "sec.", "3.1", None, None), ("section", "Sections", "4.2", None, None), ("clause", "clauses", "7", None, None)],
        "cl. 5, sch. 2, app. B": [("clause", "cl.", "5", None, None), ("schedule", "sch.", "2", None, None), ("appendix", "app.", "B", None, None)],
        "annexure C, 1.2 (Scope of work)": [("annex", "annexure", "C", None, None), ("section", None, "1.2", "Scope of work", None)],
        "": [],
    }
    assert dict(zip(cases, found_in(spark, *cases), strict=True)) == cases
    assert references.extract(spark.createDataFrame([(1, 0, None)], "doc_id long, page_index int, text string")).count() == 0


def test_outline_scores(spark):
    cases = [
        ("Section 4.2", "Section 4.2 – Payment", 100), ("Section 4.2", "4.2 Payment Terms", 85), ("Section 4.2", "4.2. Payment Terms", 85), ("Section 4.2", "Article 4.2 Payment", 80),
        ("Section 4.2", "4.25 Other", None), ("Section 4.2", "4.2.1 Invoices", None), ("Section 4.2", "Table 4.2", None), ("Section 4.2", "4.2(b) Late", None),
        ("Section 4.2(b)", "4.2 Payment Terms", 60), ("Section 4.2(b)", "4.2(b) Late Payment", 85), ("Section 4.2(b)", "4.2(b)(iv) Later", 85), ("Section 4.2(b)", "Section 4.2 x", 70),
        ("Appendix C", "Appendix C – Pricing", 100), ("Appendix C", "Schedule C", 80), ("Appendix C", "C. Pricing", None), ("Appendix C", "Appendix CD", None), ("Article II", "Article III", None),
        ("in 35.5.2.3.1 (General), where", "35.5.2.3.1 General", 95), ("in 35.5.2.3.1 (General), where", "35.5.2.3.1 Overview", 85), ("in 35.5.2.3.1 (General), where", "35.5.2.3.10 Other", None), ("in 35.5.2.3.1 (General), where", "35.5.2.3.1 General rules", 90),
        ("“Payment Terms”", "4.2 Payment Terms", 90), ("“Payment Terms”", "Payment", None), ("“Payment Terms”", "Section 4: Payment Terms and more", 60), ("“Terms”", "Terms of it", None), ("“Terms”", "TERMS", 90),
    ]
    refs = references.extract(page(spark, *(text for text, _, _ in cases)))
    outline = spark.createDataFrame([(100 + k, 0, 0, 10.0, title) for k, (_, title, _) in enumerate(cases)], "doc_id long, node_no long, page_index int, y double, title string")
    names = spark.createDataFrame([(d, "x", k) for k in range(len(cases)) for d in (k, 100 + k)], "doc_id long, name string, group_id long")
    got = {r["doc_id"]: r["score"] for r in references.candidates(refs, outline, names).collect()}
    assert [got.get(k) for k in range(len(cases))] == [score for *_, score in cases]


def test_links_into_numbered_documents(spark):
    docs = [(1, "rfc9110.pdf", None), (2, "RFC 9110 HTTP Semantics.pdf", None), (3, "notes.pdf", "\n RFC 9111\nHTTP Caching"), (4, None, "Group\nRequest for Comments: 9112\nmore"), (5, "x.pdf", "cites RFC 9113 only"), (6, "rfc9111-old.pdf", ""), (7, "myrfc77.pdf", "x" * 2000 + "Request for Comments: 88")]
    numbers = references.document_numbers(spark.createDataFrame(docs, "doc_id long, name string, text string"))
    assert {(r["number"], r["target_doc"]) for r in numbers.collect()} == {(9110, 1), (9111, 6), (9112, 4)}
    urls = [
        "https://www.rfc-editor.org/rfc/rfc9110#section-5.6.1", "http://datatracker.ietf.org/doc/html/rfc9110/", "https://ietf.org/rfc/RFC9112.txt", "https://notietf.org/rfc/rfc9110", "https://www.rfc-editor.org/info/rfc09110#top", "https://ietf.org/rfc/rfc9110#section-7",
        "https://ietf.org/rfc/rfc9110#appendix-B", "https://ietf.org/rfc/rfc9110#page-2", "https://ietf.org/rfc/std66", "", None, "https://ietf.org/rfc/rfc9999", "https://ietf.org/rfc/rfc9110#section-8",
    ]
    links = spark.createDataFrame([(50, k, u) for k, u in enumerate(urls)], "doc_id long, link_no long, url string")
    places = spark.createDataFrame([(1, "section-5.6.1", 3, 70.0), (1, "section-5.6.1", 9, 1.0), (4, "top", 1, 1.0)], "doc_id long, name string, page_index int, y double")
    outline = spark.createDataFrame([(1, 0, 4, 10.0, "7. Routing"), (1, 1, 5, 20.0, "Appendix B. Changes"), (1, 2, 6, 1.0, "8 One"), (1, 3, 7, 1.0, "8. Two")], "doc_id long, node_no long, page_index int, y double, title string")
    got = {r["link_no"]: (r["target_doc"], r["way"], r["target_page"]) for r in references.web_links(links, numbers, places, outline).collect()}
    assert got == {0: (1, "destination", 3), 1: (1, "document", 0), 2: (4, "document", 0), 5: (1, "outline", 4), 6: (1, "outline", 5)}


def test_hints(spark):
    cases = [
        ("Master Services Agreement.pdf", "Master Services Agreement", 20), ("MSA - Master Agreement v3.pdf", "Master Services Agreement", 20), ("Supply - Master Agreement v3.pdf", "Master Services Agreement", 8),
        ("MSA_final.pdf", "Master Services Agreement", 20), ("Schedule 2.pdf", "Master Agreement", -10), ("Anything.pdf", None, 0),
    ]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, target_name string, hint string, want int")
    assert [r["got"] for r in frame.withColumn("got", references.hint_adjustment()).orderBy("k").collect()] == [c[2] for c in cases]


def test_headings_against_mentions(spark):
    cases = [("", True, " Payment Terms", False), ("", False, " Payment Terms", True), ("see ", True, " of the Agreement", False), ("", False, "5 Other", False), ("", False, ".1 Invoices", False), ("", False, " percent of the fee", False), ("", False, " Payment Terms ........ 12", False), ("(3) ", True, "", False)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, before string, labelled boolean, after string, bold boolean")
    got = frame.select("k", references.heading_hit_score(F.col("before"), F.col("labelled"), F.col("after"), F.col("bold"), F.lit(False)).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [80, 75, None, None, None, 30, 35, 65]
    bare = frame.limit(2).select(references.heading_hit_score(F.col("before"), F.lit(False), F.col("after"), F.lit(False), F.lit(True)).alias("s"))
    assert {r["s"] for r in bare.collect()} == {None}


def test_full_text_fallback(spark):
    refs = references.extract(page(spark, "see Section 4.2 of the Master Agreement", "as in Section 4.2 of the Lost Deed", "Section 9.9 stands"))
    texts = ["Section 4.2 Payment Terms", "as said in Section 4.2 before", "Section 4.25 Other", "4.2 Payment ..... 12"]
    lines = spark.createDataFrame([(10, 0, k, 10.0 * k, t, False) for k, t in enumerate(texts)], "doc_id long, page_index int, line_no int, y0 double, text string, emphasised boolean")
    names = spark.createDataFrame([(0, "Home", 1), (1, "Other", 1), (2, "Third", 1), (10, "The Master Agreement", 1)], "doc_id long, name string, group_id long")
    got = references.heading_hits(refs, lines, names).collect()
    assert [(r["doc_id"], r["node_no"], r["score"]) for r in got if r["score"] >= references.LEAST_SCORE] == [(0, 0, 100), (0, 3, 55)]
    best = references.ranked(references.heading_hits(refs, lines, names)).where("rank = 1").collect()
    assert [(r["doc_id"], r["node_no"], r["confident"]) for r in best] == [(0, 0, True)]


def test_target_lines(spark):
    texts = [("y = a * x + b", 292.0), ("(27-19)", 293.0), ("where y is the output, see (27-19).", 332.0), ("Table 1: the settings", 420.0), ("goes on here", 433.0), ("Setting Table 10", 300.0), ("[2] Author, a title", 600.0), ("[12] Other, a title", 620.0), ("Figure 2 shows it", 642.0), ("in Figure 2 it is", 470.0), ("2.4 Safety of pumps", 700.0)]
    lines = spark.createDataFrame([(1, 0, k, y, y + 11, t) for k, (t, y) in enumerate(texts)], "doc_id long, page_index int, line_no int, y0 double, y1 double, text string")
    asked = [("Equation (27-19)", None, 292.0), ("Table 1", None, 290.0), ("Figure 2", None, 480.0), ("[2]", None, 10.0), ("the text", "#ref012", 10.0), ("Safety", None, 650.0), ("no such", None, 20.0)]
    links = spark.createDataFrame([(1, k, 0, y, label, uri) for k, (label, uri, y) in enumerate(asked)], "doc_id long, link_no int, page_index int, y double, label string, uri string")
    got = {r["link_no"]: (r["line_no"], r["context"]) for r in references.target_lines(links, lines).collect()}
    assert {k: n for k, (n, _) in got.items()} == {0: 1, 1: 3, 2: 8, 3: 6, 4: 7, 5: 10}
    assert got[1][1] == "Table 1: the settings goes on here"


def test_tables_drawn_with_lines(spark):
    shapes = [(100.0, y, 300.0, y + 1, False) for y in (200.0, 240.0, 280.0)] + [(x, 200.0, x + 1, 280.0, False) for x in (100.0, 200.0, 300.0)] + [(400.0, 500.0, 500.0, 560.0, True)]
    frame = spark.createDataFrame([(1, 0, k, *s) for k, s in enumerate(shapes)], "doc_id long, page_index int, shape_no int, x0 double, y0 double, x1 double, y1 double, stroked boolean")
    texts = [("Item A", 110.0, 210.0), ("$100", 210.0, 210.0), ("Item B", 110.0, 250.0), ("$200", 210.0, 250.0), ("alone", 420.0, 520.0), ("outside", 20.0, 20.0)]
    lines = spark.createDataFrame([(1, 0, k, x, y, x + 40, y + 12, t) for k, (t, x, y) in enumerate(texts)], "doc_id long, page_index int, line_no int, x0 double, y0 double, x1 double, y1 double, text string")
    assert rows_of(layout.ruled_tables(frame, lines).select("table_no", "row", "col", "text")) == [(1, 1, 0, "Item A"), (1, 1, 1, "$100"), (1, 2, 0, "Item B"), (1, 2, 1, "$200")]


def test_turned_pages_and_blocks(spark):
    import math

    upright = [("a heading", 50.0, 50.0, 560.0), ("left one", 50.0, 80.0, 290.0), ("right one", 320.0, 80.0, 560.0), ("left two", 50.0, 95.0, 290.0), ("right two", 320.0, 95.0, 560.0), ("far below", 50.0, 300.0, 290.0)]
    turn = lambda x, y, a=0.03: (math.cos(a) * (x - 306) - math.sin(a) * (y - 396) + 306, math.sin(a) * (x - 306) + math.cos(a) * (y - 396) + 396)
    rows = [(1, 0, k, t, *turn(x0, y), *turn(x1, y), *turn(x0, y + 12), *turn(x1, y + 12)) for k, (t, x0, y, x1) in enumerate(upright)]
    rows += [(1, 0, 6, "up", 10.0, 400.0, 10.0, 300.0, 20.0, 400.0, 20.0, 300.0)]  # a short sideways label doesn't count
    lines = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, ulx double, uly double, urx double, ury double, llx double, lly double, lrx double, lry double")
    got = {r["line_no"]: r for r in layout.line_blocks(layout.upright_lines(lines, 612, 792)).collect()}
    assert all(abs(got[k]["x0"] - x0) < 1e-6 and abs(got[k]["y0"] - y) < 1e-6 for k, (_, x0, y, _) in enumerate(upright))
    blocks = [got[k]["block_no"] for k in range(6)]
    assert blocks[1] == blocks[3] != blocks[2] == blocks[4] and len({blocks[0], blocks[1], blocks[2], blocks[5]}) == 4


ORIGINAL = ["Contents", "1 Scope 1", "2 Widgets 2", "Figure 2-1 Round widget 2", "1 Scope", "This standard covers the making of widgets for", "use in the field; see 2 for their shape.", "2 Widgets", "Widgets are round when made to this standard.", "Figure 2-1 Round widget"]
REVISED = ["Contents", "1 Scope 1", "2 Gadgets 2", "3 Widgets 3", "Figure 3-1 Round widget 3", "1 Scope", "This standard covers the making of widgets for", "use in the field; see 3 for their shape.", "2 Gadgets", "Gadgets are square in every case we know of.", "3 Widgets", "Widgets are round when made to this standard.", "Figure 3-1 Round widget"]


@pytest.mark.parametrize("names", [None, "kept", "numbers"])
def test_renumbered_links_are_no_change(spark, names):
    paired, plain = revision(spark, "\n".join(ORIGINAL), "\n".join(REVISED))
    first = lambda lines, n: sum(len(x.split()) for x in lines[:n])
    links = []

    def link(side, lines, line, to, kept, number, words=None):
        lo = first(lines, line) + (words or 0)
        name = {None: None, "kept": kept, "numbers": number}[names]
        links.append((side, len(links), lo, lo + (1 if words else len(lines[line].split())), first(lines, to), name))

    for side, lines, k, w in ((0, ORIGINAL, 2, 7), (1, REVISED, 3, 10)):
        link(side, lines, 1, w - 3 if side == 0 else w - 5, "H.scope", "section.1")
        link(side, lines, k, w, "H.widgets", f"section.{k}")
        link(side, lines, k + 1, w + 2, "F.round", f"figure.{k}")
        link(side, lines, 6 if side == 0 else 7, w, "H.widgets", f"section.{k}", words=5)
    link(1, REVISED, 2, 8, "H.gadgets", "section.2")
    frame = spark.createDataFrame([(1, 2, *x) for x in links], "a long, b long, side int, link_no int, lo int, hi int, target int, name string").withColumn("pair_id", F.struct("a", "b"))
    own = compare.renumbered(paired, plain, frame)
    same = compare.matches(own, compare.chain(compare.anchors(own)))
    found = compare.changes(own, same).orderBy("r_lo").collect()
    assert [(spoken(own, 0, r["o_lo"], r["o_hi"]), spoken(own, 1, r["r_lo"], r["r_hi"])) for r in found] == [("", "2 Gadgets 2"), ("", "2 Gadgets Gadgets are square in every case we know of.")]


def streamed(spark, folder, schema, rows, batch=4):
    """A stream of ``rows`` that brings a file of ``batch`` rows at a time, and the same rows as a table."""
    for n in range(0, len(rows), batch):
        frame = spark.createDataFrame(rows[n : n + batch], schema.replace("timestamp", "string"))
        for name in [f.split()[0] for f in schema.split(", ") if f.endswith("timestamp")]:
            frame = frame.withColumn(name, F.to_timestamp(name))
        frame.coalesce(1).write.parquet(f"{folder}/in/b{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"), spark.read.schema(schema).parquet(f"{folder}/in/*")


def finish(stream, folder, sink):
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/ck")
    query = (writer.foreachBatch(sink).outputMode("update") if callable(sink) else writer.format("memory").queryName(sink).outputMode("append")).start()
    query.processAllAvailable()
    query.stop()


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def at(k):
    return f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"


def test_states_and_searches_end_as_their_batch_twins(spark, tmp_path):
    stream, all_rows = streamed(spark, f"{tmp_path}/a", state.STATES, [(str(k % 5) if k % 5 else None, k % 7, at((5 * k) % 14)) for k in range(14)])
    out = f"{tmp_path}/a/out"
    finish(state.reading_states(stream), f"{tmp_path}/a", state.change_log(out))
    log = spark.read.parquet(out)
    assert rows_of(state.newest(log.select("key", "last_page", "updated_at"), "key", "updated_at", "last_page")) == rows_of(state.latest_states(all_rows.where("key IS NOT NULL")))
    # after a restart the state goes on: a later update counts, an older one changes nothing, and only the keys of the batch are written
    more = spark.createDataFrame([("1", 99, at(50)), ("2", 98, "2000-01-01")], "key string, last_page long, t string").selectExpr("key", "last_page", "to_timestamp(t) AS updated_at")
    more.coalesce(1).write.parquet(f"{tmp_path}/a/in/b900")
    finish(state.reading_states(stream), f"{tmp_path}/a", state.change_log(out))
    log = spark.read.parquet(out)
    assert [r[:2] for r in rows_of(log.where(F.col("v") == log.agg(F.max("v")).first()[0]).select("key", "last_page"))] == [("1", 99)]
    assert rows_of(state.newest(log.select("key", "last_page", "updated_at"), "key", "updated_at", "last_page")) == rows_of(state.latest_states(spark.read.schema(state.STATES).parquet(f"{tmp_path}/a/in/*").where("key IS NOT NULL")))
    stream, all_rows = streamed(spark, f"{tmp_path}/p", state.STATES, [(str(k), k, at((7 * k) % 20)) for k in range(20)])
    finish(stream, f"{tmp_path}/p", state.merge_and_prune(f"{tmp_path}/p/out", limit=6, kept=3))
    left = rows_of(state.pruned_version(spark, f"{tmp_path}/p/out", 4))
    assert 3 <= len(left) <= 6 and max(all_rows.collect(), key=lambda r: r["updated_at"])["key"] in [r[0] for r in left]
    searches = [(k % 2, ("Pump", "pump", "valve", "  ", f"q{k}")[k % 5], at(k)) for k in range(40)] + [(None, "x", at(1)), (1, None, at(1))]
    stream, all_rows = streamed(spark, f"{tmp_path}/s", state.SEARCHES, searches, batch=9)
    finish(state.search_lists(stream, kept=4), f"{tmp_path}/s", state.change_log(f"{tmp_path}/s/out"))
    want = state.recent_searches(all_rows.where("key IS NOT NULL"), kept=4)
    assert rows_of(state.listed_searches(spark.read.parquet(f"{tmp_path}/s/out"))) == rows_of(want) and want.where("key = 0").count() == 4


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    keep, frames = state.merge_and_prune(f"{tmp_path}/out"), [[("1", 5, at(1)), ("2", 6, at(1))], [("1", 7, at(2))]]
    batches = [spark.createDataFrame(rows, "key string, last_page long, t string").selectExpr("key", "last_page", "cast(t AS timestamp) AS updated_at") for rows in frames]
    for number in (0, 1, 1):
        keep(batches[number], number)
    assert [r[:2] for r in rows_of(state.pruned_version(spark, f"{tmp_path}/out", 1))] == [("1", 7), ("2", 6)]
    log = state.change_log(f"{tmp_path}/log")
    for number in (0, 1, 1):
        log(batches[number], number)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_keys_are_the_same_on_every_machine(spark):
    cases = [
        ("/Users/a/Library/Mobile Documents/com~apple~CloudDocs/x/y.pdf", False, "icloud:com~apple~CloudDocs/x/y.pdf"), ("/Users/b/Library/Mobile Documents/Other/z.pdf", None, "icloud:Other/z.pdf"), ("/home/c/Library/CloudStorage/Box//d/./z.pdf", False, "cloudstorage:Box/d/z.pdf"),
        ("/Volumes/GoogleDrive/z.pdf", False, "cloudstorage:GoogleDrive/z.pdf"), ("/Users/a/Documents/z.pdf", True, "icloud:Documents/z.pdf"), ("/Users/a/Documents/z.pdf", False, "/Users/a/Documents/z.pdf"), ("/Users/a/Desktop/z.pdf", True, "icloud:Desktop/z.pdf"), ("/opt/z/", True, "/opt/z"), ("/", None, "/"), (None, None, None),
    ]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, path string, synced boolean, want string")
    assert [r["got"] for r in frame.withColumn("got", state.canonical_key(F.col("path"), F.col("synced"))).orderBy("k").collect()] == [c[2] for c in cases]


def test_many_patterns_find_what_each_finds(spark):
    texts = ["an  error–page, Error - Page and “error page”", None, "", "x'y ‘x’ X’Y", "--a--b  --", "aaaa", "Ünï page Ünï", "error page" * 40]
    pages = spark.createDataFrame([(k, k, at(k), t) for k, t in enumerate(texts)], "doc_id long, page_index int, t string, text string").selectExpr("doc_id", "page_index", "to_timestamp(t) AS ts", "text").repartition(3)
    queries = ["error page", '"error page"', "x'y", "aa", "a b", "- a", "page ü", "no such", "Ünï", "error-page", ""]
    patterns = spark.createDataFrame(list(enumerate(queries)), "pattern_id long, query string")
    for block in (50_000, 4):
        got = sorted((r["pattern_id"], r["doc_id"], r["start"], r["len"], r["matched"]) for r in state.search_all(pages, patterns, block).collect())
        assert got == sorted((k, r["doc_id"], r["start"], r["len"], r["matched"]) for k, q in enumerate(queries) if q for r in state.standing_search(pages, q).collect()) and len(got) > 120
    assert state.search_all(pages, patterns.limit(0)).count() == 0


def test_patterns_may_change_while_the_stream_runs(spark, tmp_path):
    schema = "doc_id long, page_index int, ts timestamp, text string"
    table = f"{tmp_path}/patterns"
    versions = lambda *rows: spark.createDataFrame(rows, "pattern_id long, query string, active boolean, version int").write.mode("append").parquet(table)
    versions((1, "pump", True, 1), (2, "valve", True, 1))
    stream, _ = streamed(spark, str(tmp_path), schema, [(k, 0, at(k), "a pump, a valve and a filter") for k in range(3)])
    finish(stream, str(tmp_path), state.monitor(f"{tmp_path}/out", lambda: spark.read.parquet(table)))
    versions((3, "filter", True, 1), (2, "valve", False, 2), (1, "a pump", True, 2))
    spark.createDataFrame([(9, 0, "a pump, a valve and a filter")], "doc_id long, page_index int, text string").withColumn("ts", F.to_timestamp(F.lit(at(9)))).select("doc_id", "page_index", "ts", "text").coalesce(1).write.parquet(f"{tmp_path}/in/b900")
    finish(stream, str(tmp_path), state.monitor(f"{tmp_path}/out", lambda: spark.read.parquet(table)))
    got = sorted((r["doc_id"], r["pattern_id"], r["matched"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(k, p, w) for k in range(3) for p, w in ((1, "pump"), (2, "valve"))] + [(9, 1, "a pump"), (9, 3, "filter")]


def test_bursts_and_standing_searches_as_streams(spark, tmp_path):
    schema = "path long, ts timestamp, stamp long"
    events = [(k % 3, at(5 * (k // 6) * 60 + k % 6), k) for k in range(30)]
    stream, all_rows = streamed(spark, f"{tmp_path}/n", schema, [*events, (9, at(3000), 1), (9, at(3500), 2)], batch=6)
    finish(state.notifications(stream, burst="30 seconds", late="1 second"), f"{tmp_path}/n", "bursts")
    want = state.notifications(all_rows, burst="30 seconds").where("path != 9")
    assert rows_of(spark.table("bursts").where("path != 9")) == rows_of(want) and want.count() == 15
    pages = [(k, 0, at(k), "an error-page and an Error page" if k % 3 == 0 else "mail a@b.co" if k % 3 == 1 else None) for k in range(9)]
    stream, all_rows = streamed(spark, f"{tmp_path}/f", "doc_id long, page_index int, ts timestamp, text string", pages)
    finish(state.standing_search(stream, "error page"), f"{tmp_path}/f", "matches_found")
    assert rows_of(spark.table("matches_found")) == rows_of(state.standing_search(all_rows, "error page")) and spark.table("matches_found").count() == 6
    finish(state.standing_findings(stream), f"{tmp_path}/g", "findings")
    assert rows_of(spark.table("findings")) == rows_of(state.standing_findings(all_rows)) and spark.table("findings").count() == 3


def test_index_refresh_as_a_stream(spark, tmp_path):
    from quire.sources.corpus import page_text

    chunk = lambda d: retrieval.chunks(page_text(d))
    text = lambda k, version: f"document {k} in version {version} has a line of text"
    rows = [(k, text(k, 1), 1) for k in range(6)] + [(1, text(1, 2), 2), (2, "gone", 2), (3, text(3, 0), 0), (4, text(4, 1), 1)]
    stream, all_rows = streamed(spark, str(tmp_path), "doc_id long, text string, mtime int", rows, batch=6)
    finish(state.changed_documents(stream), str(tmp_path), state.refresh_index(f"{tmp_path}/out", chunk))
    log = spark.read.parquet(f"{tmp_path}/out")
    got = state.index_now(log)
    assert log.where("chunk_no IS NULL").count() == 8  # six documents and two later versions; older and equal ones change nothing
    assert rows_of(got) == rows_of(state.index_after(all_rows, chunk).select(got.columns)) and {r["doc_id"] for r in got.collect()} == {0, 1, 3, 4, 5}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["s1_page_text", "q1_smart_search", "r1_preset_scan", "c13_pair_discovery", "c13_families", "m4_totals", "d2_mark_tokens", "d3_custom_splits", "d4_page_labels", "l2_reading_order", "l5_ruled_tables", "l6_character_tables", "s4_layout_export", "r4_title_propagation", "t4_change_debouncing", "t5_monitor_counts", "v4_hybrid_topk", "v2_lexical_topk", "v3_vector_topk"])
def test_sql_twins(spark, name):
    import duckdb

    from quire.plans.registry import ORACLE_SQL_BY_QUERY, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    ours = QUERIES[name](spark, SMALL)
    theirs = con.execute(ORACLE_SQL_BY_QUERY[name])
    columns = [c[0] for c in theirs.description]
    plain = lambda rows: sorted(tuple(repr(round(v, 3)) if isinstance(v, float) else repr(v) for v in r) for r in rows)
    assert plain(tuple(r) for r in ours.select(*columns).collect()) == plain(theirs.fetchall())


def test_style_runs_of_lines_take_no_shuffle(spark):
    chars = [("a", 0.0, 5.0, 10.0, False), ("b", 5.0, 10.0, 10.0, False), (None, 10.0, 15.0, 10.0, False), ("c", 20.0, 25.0, 10.0, False), ("d", 25.0, 30.0, 12.0, False), ("é", 30.0, 35.0, 12.0, True), ("f", 35.0, 40.0, 12.0, None), ("g", 40.0, 45.0, None, None)]
    schema = "doc_id long, page_index int, line_no int, chars array<struct<ch: string, x0: double, x1: double, size: double, bold: boolean>>"
    lines = spark.createDataFrame([(1, 0, 0, chars), (1, 0, 1, chars[3:5]), (2, 0, 0, []), (2, 0, 1, None)], schema)
    by_line = layout.line_style_runs(lines)
    assert "Exchange" not in by_line._jdf.queryExecution().executedPlan().toString()
    expected = [(1, 0, 1, "ab c", 10.0, False), (1, 0, 2, "d", 12.0, False), (1, 0, 3, "é", 12.0, True), (1, 0, 4, "f", 12.0, None), (1, 0, 5, "g", None, None), (1, 1, 1, "c", 10.0, False), (1, 1, 2, "d", 12.0, False)]
    named = ["doc_id", "line_no", "run_no", "text", "size", "bold"]
    assert sorted(map(tuple, by_line.select(named).collect())) == expected
    each = lines.select("doc_id", "page_index", "line_no", F.posexplode("chars").alias("char_no", "c")).select("doc_id", "page_index", "line_no", "char_no", "c.*")
    assert sorted(map(tuple, layout.style_runs(each).select(named).collect())) == expected


def test_references_and_headings_are_read_once(spark):
    pages = spark.createDataFrame([(1, 0, "see Section 4.2(b) and Section 9, or “Payment Terms”")], "doc_id long, page_index int, text string")
    heads = [(2, 0, "4.2(b) Delivery"), (2, 1, "Section 4.2 Terms"), (2, 2, "Payment Terms and more"), (3, 0, "4.25 Other"), (9, 0, "Section 9 Elsewhere")]
    outline = spark.createDataFrame([(d, k, 0, 80.0 * k, t) for d, k, t in heads], "doc_id long, node_no long, page_index int, y double, title string")
    names = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "c", 7), (9, "d", 8)], "doc_id long, name string, group_id long")
    found = references.candidates(references.extract(pages), outline, names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert references.NUMBERING_FORM not in plan and references.QUOTED_FORM not in plan
    assert sorted(map(tuple, found.select("identifier", "target_doc", "node_no", "score").collect())) == [("", 2, 2, 60), ("4.2(b)", 2, 0, 85), ("4.2(b)", 2, 1, 70)]


def test_hopeless_gaps_are_left_at_once(monkeypatch):
    rows = []
    packed = compare.np.packbits
    monkeypatch.setattr(compare.np, "packbits", lambda *a, **k: rows.append(1) or packed(*a, **k))
    a, b = [f"a{k}" for k in range(700)], [f"b{k}" for k in range(700)]
    assert compare.aligned(["x", *a, "s", *a], ["x", *b, "s", *b]) == [(0, 0)] and not rows
    # 302 edits: neither 64 nor 256 can do, so one pass decides
    assert compare.aligned([*a[:150], "s", "t"], [*b[:150], "s", "u"]) == [(150, 150)] and len(rows) == 152


def test_gaps_are_spread_over_tasks(spark):
    rows = [(k, d, 0, i, w) for k in range(4) for d, text in ((0, "a b c x d"), (1, "a b c y z d")) for i, w in enumerate(text.split())]
    paired = spark.createDataFrame([((k, k + 10), side, i, i, w, w, False) for k, side, _, i, w in rows], "pair_id struct<a: long, b: long>, side int, i int, pos int, key string, word string, starts boolean")
    got = compare.matches(paired, compare.chain(compare.anchors(paired)))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pair_id"]["a"], r["i"], r["j"]) for r in got.collect()) == sorted((k, i, j) for k in range(4) for i, j in ((0, 0), (1, 1), (2, 2), (4, 5)))


def test_gaps_are_aligned_in_batches(spark):
    # two equal gaps, one on a single side only, and the same words as an anchor before a gap
    a, b = "q a b c x k d e f x k g h i", "a b c k y d e f k y g h i new"
    rows = [((p, p + 10), side, i, i, w, w, False) for p in range(3) for side, text in ((0, a), (1, b)) for i, w in enumerate(text.split())]
    paired = spark.createDataFrame(rows, "pair_id struct<a: long, b: long>, side int, i int, pos int, key string, word string, starts boolean")
    got = compare.matches(paired, compare.chain(compare.anchors(paired)))
    assert "MapInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
    right = [(1, 0), (2, 1), (3, 2), (5, 3), (6, 5), (7, 6), (8, 7), (10, 8), (11, 10), (12, 11), (13, 12)]
    assert sorted((r["pair_id"]["a"], r["i"], r["j"]) for r in got.collect()) == [(p, i, j) for p in range(3) for i, j in right]


def test_pages_go_to_blocks_in_batches(spark):
    rows = [(1, 0, 2, "below", 10.0, 24.0, 90.0, 34.0, 0.5), (1, 0, 1, "above", 10.0, 10.0, 95.0, 20.0, 0.5), (1, 0, 3, None, 200.0, 24.0, 290.0, 34.0, 0.5), (1, 1, 0, "alone", 10.0, 10.0, 20.0, 20.0, 0.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, angle double")
    blocks = layout.line_blocks(lines)
    assert "FlatMapGroups" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    assert blocks.columns == [*lines.columns, "block_no"]
    assert sorted(map(tuple, blocks.select("page_index", "line_no", "text", "angle", "block_no").fillna("").collect())) == [(0, 1, "above", 0.5, 0), (0, 2, "below", 0.5, 0), (0, 3, "", 0.5, 1), (1, 0, "alone", 0.0, 0)]


def test_strokes_meet_lines_before_their_characters(spark):
    from quire.plans.layout_queries import l10_underline_strike

    if os.path.isdir(SMALL):
        plan = l10_underline_strike(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("inline") < plan.index("Join")  # the plan is read from its end: characters are made behind all joins
        assert plan.count("inline") == 1
    lines = spark.createDataFrame([(1, 0, 0, 100.0, 12.0, "ab"), (1, 0, 1, 200.0, None, "c")], "doc_id long, page_index int, line_no int, baseline double, tallest double, text string")
    strokes = spark.createDataFrame([(1, 0, 0.0, 50.0, 101.5, 1.0), (1, 0, 0.0, 50.0, 97.0, 9.0)], "doc_id long, page_index int, sx0 double, sx1 double, sy double, thickness double")
    met = layout.line_strokes(lines, strokes)
    assert {r["line_no"]: r["strokes"] and len(r["strokes"]) for r in met.collect()} == {0: 2, 1: None}
    chars = met.select("*", F.lit(5.0).alias("x0"), F.lit(9.0).alias("x1"), F.lit(10.0).alias("size"))
    assert sorted(map(tuple, layout.stroke_flags(chars).select("line_no", "underline", "strike").collect())) == [(0, True, False), (1, False, False)]


def test_words_are_made_without_a_window(spark):
    rows = [(1, 0, 1, "-ated and well-"), (1, 0, 0, "  one\tinterpo-"), (1, 0, 2, "  late Well-"), (1, 1, 0, ""), (1, 1, 1, None), (1, 1, 2, "Known semi-"), (1, 1, 3, "\fcolon"), (2, 0, 0, "a-"), (2, 0, 1, "b-"), (2, 0, 2, "c 9-"), (2, 0, 3, "d"), (3, 0, 0, None)]
    lines = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string")
    got = compare.words(lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert [tuple(r) for r in got.orderBy("doc_id", "pos").select("doc_id", "pos", "word", "line_no").collect()] == [
        (1, 0, "one", 0), (1, 1, "interpo-", 0), (1, 2, "-ated", 1), (1, 3, "and", 1), (1, 4, "welllate", 1), (1, 5, "Well-", 2), (1, 6, "Known", 2), (1, 7, "semi-", 2), (1, 8, "colon", 3),
        (2, 0, "ab-", 0), (2, 1, "9-", 2), (2, 2, "d", 3),
    ]


def test_strokes_are_linked_on_their_page(spark):
    rng, rows = random.Random(5), []
    for page in range(4):
        for k in range(40):
            x, y, long = rng.uniform(-40, 400), rng.uniform(-40, 400), rng.uniform(12, 90)
            rows.append((7, page, 100 * page + k, k % 2 == 0, x, y, x + long * (k % 2 == 0), y + long * (k % 2)))
    strokes = spark.createDataFrame(rows, "doc_id long, page_index int, stroke long, level boolean, x0 double, y0 double, x1 double, y1 double")
    found = layout.touching(strokes)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    t = layout.TOUCH
    meet = lambda p, q: p[1] == q[1] and p[2] != q[2] and p[4] - t <= q[6] and p[6] + t >= q[4] and p[5] - t <= q[7] and p[7] + t >= q[5]
    group = {r[2]: r[2] for r in rows if any(meet(r, q) for q in rows)}
    while True:
        new = {r[2]: min([group[r[2]], *(group[q[2]] for q in rows if meet(r, q))]) for r in rows if r[2] in group}
        if new == group:
            break
        group = new
    assert 0 < len(set(group.values())) < len(group) < len(rows)
    assert {r["stroke"]: r["grid"] for r in found.collect()} == group


def test_pairs_as_rows_are_compared_like_words_as_rows(spark):
    from quire.operators import revisions

    rng = random.Random(11)
    rows, pairs = [], []
    for p in range(8):
        lines = [[f"w{rng.randrange(40 if p % 2 else 900)}" for _ in range(rng.randrange(3, 14))] for _ in range(30)]
        other = [list(x) for x in lines]
        block = other[4:7]
        del other[4:7]
        other[15:15] = block
        for _ in range(p):
            k = rng.randrange(len(other))
            other[k][rng.randrange(len(other[k]))] = f"n{rng.randrange(9)}"
            other.insert(rng.randrange(len(other)), list(other[rng.randrange(len(other))]))
            del other[rng.randrange(len(other))]
        other[20:20] = [lines[20][:2] + ["--"] + lines[20][2:]]
        pairs.append((2 * p, 2 * p + 1))
        for d, text in ((2 * p, lines), (2 * p + 1, other if p else [["--"]])):
            rows += [(d, k, w, w.strip("-"), 0, n) for k, (n, w) in enumerate((n, w) for n, line in enumerate(text) for w in line)]
    words = spark.createDataFrame(rows, "doc_id long, pos int, word string, key string, page_index int, line_no int").repartition(2).cache()
    frame = spark.createDataFrame(pairs, "a long, b long")
    paired = compare.paired_words(frame, words).cache()
    same = compare.matches(paired, compare.chain(compare.anchors(paired))).cache()
    lists = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "key", F.struct("page_index", "line_no").alias("place")))).alias("x")).select("doc_id", *(F.col(f"x.{c}").alias(f"{c}s") for c in ("word", "key", "place")))
    docs = revisions.compared(lists).cache()
    found = revisions.matches(revisions.pair_rows(frame, docs, "text", "starts")).cache()

    def alike(old, new, *columns):
        old, new = (sorted(map(tuple, x.select(*columns).collect())) for x in (old.select("pair_id.*", "*"), new))
        assert old == new
        return len(old)

    assert alike(same, revisions.matched_words(found), "a", "b", "i", "j") > 500
    assert alike(compare.similarity(paired, same), revisions.similarity(found), "a", "b", "matched", "similarity") == 8
    ranges = ["a", "b", "change_no", "o_lo", "o_hi", "r_lo", "r_hi"]
    changed, new = compare.changes(paired, same).cache(), revisions.changes(found).cache()
    assert alike(changed, new, *ranges) > 20
    assert alike(compare.change_report(changed, paired), revisions.change_report(new, docs), "a", "b", "change_no", "kind", "removed", "added") > 20
    assert alike(compare.slid_to_lines(changed, paired), revisions.slid_changes(new, docs), *ranges, "shift") > 20
    slid, runs = compare.slid_matches(paired, same).cache(), revisions.slid_matches(found)
    assert alike(slid, revisions.matched_words(runs), "a", "b", "i", "j") > 500
    moved, moves = compare.moves(paired, slid).cache(), revisions.with_moves(runs).cache()
    assert alike(compare.move_ranges(moved), revisions.move_ranges(moves), "a", "b", "move_no", "o_lo", "o_hi", "r_lo", "r_hi") > 5
    assert alike(compare.changes_but_moves(paired, slid, moved), revisions.changes_but_moves(moves), *ranges) > 20


def test_keys_of_lists_are_those_of_words(spark):
    lines = spark.createDataFrame([(1, 0, 0, "ΟΔΟΣ ﬁne “Ab” éa Σ‘x inter-"), (1, 0, 1, "nal -- ½ x y"), (2, 0, 0, ""), (3, 0, 0, "-- one")], "doc_id long, page_index int, line_no int, text string")
    for flags in ({}, {"ignore_case": True}, {"ignore_case": True, "ignore_punctuation": True}):
        rows = compare.word_keys(compare.words(lines), **flags).select("doc_id", "pos", "key").collect()
        listed = compare.listed_words(compare.key_lists(compare.word_lists(compare.line_lists(lines)), **flags), "keys").select("doc_id", "pos", "key").collect()
        assert sorted(rows) == sorted(listed) and len(rows) == 11


def test_anchors_of_pairs_as_rows(spark):
    from quire.operators import revisions

    rng = random.Random(5)
    texts = {}
    for p in range(6):
        blocks = [[f"b{p}x{k}y{n}" for n in range(rng.randrange(1, 7))] for k in range(40)] + [["same", "old", "words"]] * p
        texts[2 * p] = [w for x in blocks for w in x]
        texts[2 * p + 1] = [w for x in rng.sample(blocks, len(blocks)) for w in x][: 1 if p == 5 else None]
    words = spark.createDataFrame([(d, k, w, w, 0, k // 9) for d, text in texts.items() for k, w in enumerate(text)], "doc_id long, pos int, word string, key string, page_index int, line_no int")
    frame = spark.createDataFrame([(2 * p, 2 * p + 1) for p in range(6)], "a long, b long")
    old = compare.anchors(compare.paired_words(frame, words)).cache()
    rows = revisions.pair_rows(frame, spark.createDataFrame([(d, "\n".join(text)) for d, text in texts.items()], "doc_id long, text string"), "text")
    listed = lambda found: sorted(map(tuple, found.select("a", "b", "i", "j").collect()))
    new, chained = listed(revisions.anchors(rows)), listed(revisions.anchors(rows, chained=True))
    assert new == listed(old.select("pair_id.*", "i", "j")) and len(new) > 300
    assert chained == listed(compare.chain(old).select("pair_id.*", "i", "j")) and 30 < len(chained) < len(new) / 2


def test_pairs_are_no_broadcast(spark, capsys):
    from quire.operators import revisions

    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    docs = spark.createDataFrame([(k, f"w{k}") for k in (1, 2, 3)], "doc_id long, text string")
    rows = revisions.pair_rows(pairs, docs, "text")
    rows.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert sorted(map(tuple, rows.select("a", "b", "text_a", "text_b").collect())) == [(1, 2, "w1", "w2"), (1, 3, "w1", "w3")]


def test_references_of_a_page_take_no_shuffle(spark, capsys):
    text = "Section 1.2.3, 4.5.6 (Notes to “Section 7”), “Clause 8.1” and 192.168.1.2, SECTIONS a, sectionS 3, §§ 4, 5.06.1, 0.1.2 “Terms of Use”, Sch. IV"
    found = references.extract(page(spark, text))
    found.explain()
    out = capsys.readouterr().out
    assert not any(x in out for x in ("Exchange", "Window", "Sort"))
    got = [(r["kind"], r["label"], r["identifier"], r["title"]) for r in sorted(found.collect(), key=lambda r: r["start"])]
    assert got == [("section", "Section", "1.2.3", None), ("section", "Section", "7", None), ("clause", "Clause", "8.1", None), ("section", "sectionS", "3", None), ("section", "§§", "4", None), ("section", None, "0.1.2", None), ("quoted title", None, "", "Terms of Use"), ("schedule", "Sch.", "IV", None)]


def test_families_move_their_documents_once_a_block(spark):
    from quire.operators import pair_blocks

    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)] + [(100, 101)], "a long, b long")
    docs = spark.createDataFrame([(d, f"w{d}") for d in [*range(40), 100, 101, 200]], "doc_id long, text string")
    rows = pair_blocks.blocks(pairs, docs, chunk=64).cache()
    assert rows.where("b IS NULL").count() == 42 and rows.where("b IS NOT NULL").count() == 781  # not two texts for each pair
    assert rows.groupBy("block").agg(F.count_if(F.col("b").isNull()).alias("n")).count() == 2
    parted = pair_blocks.blocks(pairs, docs, chunk=8).cache()
    assert parted.where("b IS NOT NULL").select("a", "b").distinct().count() == 781
    assert parted.groupBy("block").agg(F.count_if(F.col("b").isNull()).alias("n")).agg(F.max("n")).first()[0] < 40
    alone = parted.where("b IS NOT NULL").join(parted.where("b IS NULL").select("block", F.col("a").alias("d")), "block").where("d = a OR d = b").groupBy("a", "b").count()
    assert alone.where("count != 2").count() == 0 and alone.count() == 781


def test_runs_of_one_document_are_not_listed(spark):
    texts = {1: "a b c d e f", 2: "a b c d x y", 3: "p q r s t u", 4: "p q r s t u", 5: "k l", 6: "a b c d e f"}
    words = spark.createDataFrame([(d, k, w) for d, t in texts.items() for k, w in enumerate(t.split())], "doc_id long, pos int, key string")
    got = {r["doc_id"]: r for r in compare.run_sets(words).collect()}
    assert {d: (r["class_id"], r["size"], len(r["runs"])) for d, r in got.items()} == {1: (1, 4, 4), 2: (2, 4, 2), 3: (3, 4, 4), 4: (3, 4, 4), 6: (1, 4, 4)}
    assert set(got[2]["runs"]) < set(got[1]["runs"]) and got[1]["runs"][-2:] == got[2]["runs"]  # the rarest come first
    pairs = compare.revision_pairs(compare.run_sets(words), least=0.3).collect()
    assert [(r["a"], r["b"], r["shared"], round(r["similarity"], 3)) for r in pairs] == [(1, 2, 2, 0.333)]


def test_blocks_compare_like_words_as_rows(spark):
    from pyspark.sql import Window

    from quire.operators import block_compare
    from quire.plans.compare_queries import word_boxes

    rng = random.Random(23)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 12))] for _ in range(45)]
    texts = {}
    for d in range(7):  # one family: lines that move, are added twice, lose words, and words without a key
        lines = [list(x) for x in base]
        for _ in range(d):
            k = rng.randrange(len(lines) - 6)
            block = lines[k : k + 4]
            del lines[k : k + 4]
            at = rng.randrange(len(lines))
            lines[at:at] = block
            lines[rng.randrange(len(lines))][0] = f"n{rng.randrange(5)}"
            lines.insert(rng.randrange(len(lines)), list(lines[rng.randrange(len(lines))]))
        lines[5].insert(1, "--")
        texts[d] = lines
    texts[7] = [["--"]]
    rows = [(d, k, w, w.strip("-"), n // 40, n % 40) for d, lines in texts.items() for k, (n, w) in enumerate((n, w) for n, line in enumerate(lines) for w in line)]
    words = spark.createDataFrame(rows, "doc_id long, pos int, word string, key string, page_index int, line_no int").repartition(2).cache()
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "a long, b long")
    lists = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "word", (F.col("page_index") * 40 + F.col("line_no")).alias("line")))).alias("x"))
    docs = lists.select("doc_id", F.array_join("x.key", "\n").alias("text"), F.col("x.line").alias("lines"), F.array_join("x.word", "\n").alias("said")).cache()
    paired = compare.paired_words(pairs, words).cache()
    same = compare.matches(paired, compare.chain(compare.anchors(paired))).cache()

    def alike(old, new, *columns):
        old, new = (sorted(map(tuple, x.select(*columns).collect())) for x in (old.select("pair_id.*", "*"), new))
        assert old == new
        return len(old)

    key, ranges = ["a", "b", "change_no"], ["o_lo", "o_hi", "r_lo", "r_hi"]
    assert alike(compare.anchors(paired), block_compare.anchors(pairs, docs), "a", "b", "i", "j") > 500
    assert alike(compare.chain(compare.anchors(paired)), block_compare.anchors(pairs, docs, chained=True), "a", "b", "i", "j") > 300
    assert alike(same, block_compare.matched_words(pairs, docs), "a", "b", "i", "j") > 1000
    assert alike(compare.similarity(paired, same), block_compare.similarity(pairs, docs), "a", "b", "matched", "similarity") == 28
    changed = compare.changes(paired, same).cache()
    assert alike(changed, block_compare.changes(pairs, docs), *key, *ranges) > 50
    assert alike(compare.slid_to_lines(changed, paired), block_compare.slid_changes(pairs, docs), *key, *ranges, "shift") > 50
    assert alike(compare.change_report(changed, paired), block_compare.change_report(pairs, docs), *key, "kind", "removed", "added") > 50
    slid = compare.slid_matches(paired, same).cache()
    moved = compare.moves(paired, slid).cache()
    assert alike(compare.move_ranges(moved), block_compare.move_ranges(pairs, docs), "a", "b", "move_no", *ranges) > 20
    assert alike(compare.changes_but_moves(paired, slid, moved), block_compare.changes_but_moves(pairs, docs), *key, *ranges) > 50

    by_line = Window.partitionBy("doc_id", "page_index", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x1, y0 = 72 + 6.0 * (F.sum(F.length("word") + 1).over(by_line) - 1), 100 + 14.0 * F.col("line_no")
    boxes = words.withColumn("x1", x1).select("doc_id", "pos", "page_index", "line_no", (F.col("x1") - 6 * F.length("word")).alias("x0"), y0.alias("y0"), "x1", (y0 + 11).alias("y1"))
    box = [*key, "side", "page_index", "line_no", "kind", "x0", "y0", "x1", "y1"]
    assert alike(compare.change_boxes(changed, paired, boxes), block_compare.change_boxes(pairs, docs, word_boxes), *box) > 100

    line = F.col("page_index") * 40 + F.col("line_no")
    placed = words.select("doc_id", "pos", line.alias("line"))
    at = lambda side, doc, name, i: paired.where(f"side = {side}").select("pair_id", F.col("i").alias(i), "pos", F.col(f"pair_id.{doc}").alias("doc_id")).join(placed, ["doc_id", "pos"]).select("pair_id", i, F.col("line").alias(name))
    lined = same.join(at(0, "a", "o_line", "i"), ["pair_id", "i"]).join(at(1, "b", "r_line", "j"), ["pair_id", "j"]).selectExpr("pair_id", "o_line", "r_line", "o_line * 14.0D AS o_y", "r_line * 14.0D AS r_y")
    places = pairs.select(F.struct("a", "b").alias("pair_id"), F.col("a").alias("doc_id")).join(placed.select("doc_id", "line").distinct(), "doc_id").selectExpr("pair_id", "line * 14.0D AS y")
    rounded = lambda x: x.withColumn("mapped", F.coalesce(F.round("mapped", 6), F.lit(-1.0)))
    assert alike(rounded(compare.mapped_places(places, compare.line_anchors(lined))), rounded(block_compare.position_map(pairs, docs, 14.0)), "a", "b", "y", "mapped") > 500


@pytest.mark.parametrize("seed", range(2))
def test_links_in_blocks_are_those_of_words_as_rows(spark, seed):
    from quire.operators import block_compare

    rng = random.Random(seed)
    texts, links = {}, {}
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(4, 9))] for _ in range(30)]
    for d in range(5):
        lines = [list(x) for x in base]
        for _ in range(2 * d):
            lines.insert(rng.randrange(len(lines)), [f"w{rng.randrange(50)}" for _ in range(5)])
        for n, words in enumerate(lines):
            words.insert(0, str(n))  # numbers that move on
        texts[d] = lines
        first = [sum(map(len, lines[:n])) for n in range(len(lines))]
        links[d] = [(n, first[n], first[n] + rng.choice([2, 3]), rng.choice([first[min(n + 2, len(lines) - 1)], first[(3 * n) % len(lines)], None]), rng.choice([None, f"s{n}", f"t{n // 4}"])) for n in range(1, len(lines), 2)]
    words = spark.createDataFrame([(d, k, w, w, 0, n) for d, lines in texts.items() for k, (n, w) in enumerate((n, w) for n, x in enumerate(lines) for w in x)], "doc_id long, pos int, word string, key string, page_index int, line_no int").cache()
    docs = spark.createDataFrame([(d, "\n".join(w for x in lines for w in x), [n for n, x in enumerate(lines) for _ in x]) for d, lines in texts.items()], "doc_id long, text string, lines array<int>")
    two = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    pairs = spark.createDataFrame(two, "a long, b long")
    by_size = {sum(map(len, lines)): links[d] for d, lines in texts.items()}
    assert len(by_size) == 5
    paired = compare.paired_words(pairs, words).cache()
    plain = compare.matches(paired, compare.chain(compare.anchors(paired))).cache()
    frame = spark.createDataFrame([(a, b, side, *x) for a, b in two for side, d in ((0, a), (1, b)) for x in links[d]], "a long, b long, side int, link_no int, lo int, hi int, target int, name string").withColumn("pair_id", F.struct("a", "b"))
    own = compare.renumbered(paired, plain, frame.drop("a", "b")).cache()
    old = compare.changes(own, compare.matches(own, compare.chain(compare.anchors(own)))).select("pair_id.a", "pair_id.b", "change_no", "o_lo", "o_hi", "r_lo", "r_hi")
    new = block_compare.renumbered_changes(pairs, docs, lambda starts: by_size[len(starts)])
    assert rows_of(old) == rows_of(new) and own.where("key LIKE '\x01%'").count() > 20 and old.count() > 30


def test_families_are_decided_in_few_jobs(spark, monkeypatch):
    rng = random.Random(9)
    texts = {}
    for d in range(120):  # neighbours share half their words: long chains of classes that wait for each other
        texts[d] = [f"w{k}" for k in range(8 * d, 8 * d + 16)]
        if d % 3 == 0:
            texts[500 + d] = [*texts[d][:14], f"x{rng.randrange(10**6)}"]
    words = spark.createDataFrame([(d, k, w) for d, t in texts.items() for k, w in enumerate(t)], "doc_id long, pos int, key string")
    sets = compare.run_sets(words).cache()
    written = []
    monkeypatch.setattr(compare, "saved", lambda df, label, own=compare.saved: written.append(label) or own(df, label))
    one = sorted(map(tuple, compare.families(sets, 0.25).collect()))
    assert written.count("heads") <= 2
    monkeypatch.setattr(compare, "LAST_RUNS", 0)
    rounds = sorted(map(tuple, compare.families(sets, 0.25).collect()))
    assert one == rounds and len({r[1] for r in one}) < len(one) == 160


def test_pages_as_rows_have_the_tables_of_characters(spark, capsys):
    from quire.operators import page_tables

    rng = random.Random(31)
    rows = []
    for page in range(60):
        n = 0
        for line in range(rng.randrange(2, 26)):
            y, at = 26.0 * line if page % 3 else 14.0 * line + rng.choice([0, 0, 0, 4]), rng.choice([60, 60, 60, 63, 90]) if page % 2 else 60
            kind = (2 if page % 8 else rng.choice([2, 2, 2, 0])) if page % 4 == 0 else rng.choice([0, 0, 0, 0, 0, 1, 2])
            texts = [(at, "text of a line that is long"), (330, "and what is right of it")] if kind == 2 else [(at + 120 * c, rng.choice(["7", "12", "x y", "long  nut", "0.50", " "])) for c in range(3 - kind)]
            for x, text in texts:
                for k, ch in enumerate(text):
                    rows.append((page // 7, page % 7, line, n, ch, x + 5.0 * k, x + 5.0 * k + rng.choice([5.0, 3.5]), y, y + 11, 10.0))
                    n += 1
    chars = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, char_no int, ch string, x0 double, x1 double, y0 double, y1 double, size double").cache()
    pieces = layout.row_pieces(chars).cache()
    gutter = layout.gutters(pieces.withColumn("line_no", F.col("row")), 612).cache()
    columns = ["doc_id", "page_index", "table_no", "row_no", "col_no", "text"]
    pages = page_tables.pages_of(chars).cache()
    new = page_tables.character_tables(pages, 612).select(columns)
    assert rows_of(new) == rows_of(layout.borderless_tables(pieces, gutter).select(columns)) and new.count() > 100 and gutter.count() > 3
    boxes = {}
    for r in pieces.collect():
        boxes.setdefault((r["doc_id"], r["page_index"]), []).append((r["x0"], r["x1"], r["y0"], r["y1"]))
    assert sorted((*p, g) for p, b in boxes.items() for g in page_tables.page_gutters(b, 612)) == rows_of(gutter.select("doc_id", "page_index", "gutter"))
    from quire.plans.layout_queries import l6_character_tables

    if os.path.isdir(SMALL):
        plan = l6_character_tables(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and plan.count("Aggregate") == 1


def test_equal_pages_are_grouped_once(monkeypatch):
    import numpy as np

    rng = random.Random(8)
    forms = [np.array([(x, y, x + rng.choice([0, 80]), y + rng.choice([0, 60])) for x, y in ((rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(40))]) for _ in range(3)]
    pages = []
    for n in range(30):
        order = rng.sample(range(40), 40)
        pages.append((np.array([rng.randrange(-(2**62), 2**62) for _ in order]), *forms[n % 3][order].T))
    right = [layout.stroke_groups(*page) for page in pages]
    calls = []
    monkeypatch.setattr(layout, "stroke_groups", lambda *page, own=layout.stroke_groups: calls.append(1) or own(*page))
    assert layout.page_groups(pages) == right and len(calls) == 3
    assert any(g is None for g in right[0]) and len({g for g in right[0] if g is not None}) > 1
