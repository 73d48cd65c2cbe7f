"""Small fixtures and brute-force twins of the training-data operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

from quire.llm import decontaminate, html_text, jaccard_join, language_id, line_dedup, quality, sentence_pieces, sharding, store, suffix_dedup, text_hash, token_alignment, token_shards, url_filter, vector_codes
from quire.llm.components import components

SCHEMA = "doc_id long, text string, lang string, _x int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with nulls, empties, copies, near copies, shared lines and passages, ties, repeated rows and one long text."""
    rng = random.Random(5)
    passage, line = words(rng, 40), "A shared line of some length"
    base = [words(rng, rng.randrange(3, 120)) for _ in range(25)]
    texts = [None, "", "  \n\t ", "One", "two words", "aaaa" * 60, "漢字 ñandú — “q”\n漢字"]
    texts += base + base[:6] + [b.replace("w1", "v1", 1) for b in base[6:14]]
    texts += [b + "\n" + line + "\n" + passage + "\n" + words(rng, 12) for b in base[14:20]] + [line.upper() + " \n  " + line, words(rng, 6000)]
    out = [(k, t, "en", 1) for k, t in enumerate(texts)]
    return [*out, (None, base[0], None, None), (None, None, None, None), out[10], out[10]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoding_equals_the_library(docs, rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = Counter()
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[(doc, np.array(ids, "<u4").tobytes(), library.decode(ids))] += 1
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in sentence_pieces.encode_documents(docs, MODEL).collect())
    assert got == want
    assert sentence_pieces.encode_digests(empty, MODEL).count() == 0


def test_encoding_of_odd_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_proto=MODEL), sentence_pieces.PrefixEncoder(MODEL)
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("  ▁ab cthe\n\té漢😀ñ<s>​AB.,12") for _ in range(rng.randrange(25)))
        ids = library.encode(text)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids)
    assert own.decode(np.array([3 + 0xC3, 3 + 0x41], "<u4").tobytes()) == "�A"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = token_shards.slots_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (token_shards.numbers_of(slots, n) == np.arange(n)).all()


def test_token_shards_round_trip(spark, docs, rows, empty, tmp_path):
    shards = token_shards.write_shards(docs, MODEL, str(tmp_path / "s"), length=64, per_shard=16, per_file=3)
    each = token_shards.sequences(shards).collect()
    assert sorted(r["slot"] for r in each) == list(range(len(each)))
    assert all(r["slot"] // 16 == r["shard"] for r in each)
    assert {len(r["payload"]) % r["stride"] for r in shards.collect()} == {0}
    library, got = sentencepiece.SentencePieceProcessor(model_proto=MODEL), defaultdict(list)
    for r in each:
        got[r["doc_id"]].append((r["piece"], bytes(r["ids"])))
    want = Counter((doc, len(ids := library.encode(text or "", add_bos=True, add_eos=True)), tuple(ids)) for doc, text, *_ in rows)
    for (doc, n, ids), times in want.items():  # each row's pieces, as often as it comes
        cut = [np.array(ids[k : k + 64], "<u2").tobytes() for k in range(0, n, 64)]
        assert all(sum((k, x) == piece for piece in got[doc]) >= times for k, x in enumerate(cut))
    assert sum(map(len, got.values())) == sum(-(-n // 64) * times for (_, n, _), times in want.items())
    assert {r["slot"] for r in token_shards.read_from(shards, 37, 16).collect()} == set(range(37, len(each)))
    assert token_shards.write_shards(empty, MODEL, str(tmp_path / "e")).count() == 0


def test_line_dedup(docs, rows, empty):
    key = lambda line: line.translate(LOWER).strip(" \t\n\x0b\x0c\r")
    order = lambda d: 1 << 63 if d is None else d
    first = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), order(doc)), order(doc))
    want = Counter()
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= order(doc)]
        want[(doc, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
        assert {"lang", "_x"} <= set(out.columns)
        assert Counter((r["doc_id"], r["_ld_lines"], r["_ld_dropped"], r["text"]) for r in out.collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "lang AS _ld_id", "_x AS _LD_gone", "1 AS row")
    out = line_dedup.dedup_lines(clashing, n_dropped="gone")
    assert out.columns == [*clashing.columns, "_ld_lines", "gone"]
    assert Counter((r["doc_id"], r["_ld_lines"], r["gone"], r["text"]) for r in out.collect()) == want


PAGES = [
    ('<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy now, it is cheap.</div><article><h1>Head &amp; tail</h1><p><b>One  two.<br><p>Three</p></article><footer>&copy; me</footer></body></html>', "Head & tail One two. Three"),
    ('<body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><div class="post-content"><h2>T</h2><p>Long text, with words. And more.</p></div><aside>s</aside><form>f<input></form><div class="comments"><p>Nice post, I like it a lot.</p></div></body>', "T Long text, with words. And more."),
    ("<p>No frame at all, only text.</p><p>More of it.", "No frame at all, only text. More of it."),
    ("a &lt; b", "a < b"),
    ("", ""),
    (None, ""),
    ("<script>x</script><nav>y</nav>", ""),
]


def test_html_text(spark):
    pages = spark.createDataFrame([(k, None if k % 2 else "u", page, k) for k, (page, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got == {k: (text, len(text)) for k, (_, text) in enumerate(PAGES)}
    assert html_text.extract(pages.limit(0)).count() == 0
    long = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    twice = spark.createDataFrame([(1, "u", long, 0, 0)] * 2, "page_id long, url string, html string, n_chars int, Text int")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract(twice).collect()] == [(" ".join([LONG] * 5000), 5000 * len(LONG) + 4999)] * 2


LONG = "A long paragraph, with several clauses; it goes on for a while, as the body of a page does. It has a second sentence, too."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a small box with an article's name takes nothing from the unmarked body
        (f"<body><div class='story'>Read more</div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></body>", f"{LONG} Short. {LONG}"),
        (f"<body><div><h1>Title</h1><p>{LONG}</p></div><section class='entry'><p>Win now</p></section></body>", f"Title {LONG}"),
        # unnamed adverts and link lists within the article go; headings, emphasis, links in text and short items stay
        (f"<article><h1>Title</h1><p>{LONG}</p><div>Buy now</div><p>So <b>it</b> <a href='x'>ends</a> here.</p></article>", f"Title {LONG} So it ends here."),
        (f"<article><p>{LONG}</p><ul><li><a href='x'>One more page</a></li><li><a href='y'>Another</a></li></ul><h2>End</h2><ol><li>first</li></ol></article>", f"{LONG} End first"),
        # words within other attributes' values say nothing, and values are read as browsers read them
        (f'<article><p>{LONG}</p><p title="the hidden garden">Lost para.</p><p data-id="menu">Kept.</p></article>', f"{LONG} Lost para. Kept."),
        ("<p title=don't>Text one.</p><p>Text two isn't.</p>", "Text one. Text two isn't."),
        (f"<article><p>{LONG}</p><p a = 'x > y' b=\"<p>\" c=</p>>So.</p><p =x \">Odd.</p></article>", f"{LONG} >So. Odd."),
        # a doubtful name stays or goes by its ratio, a clear one goes
        (f'<article><p>{LONG}</p><section class="related-work"><p>{LONG}</p></section></article>', f"{LONG} {LONG}"),
        (f'<article><p>{LONG}</p><section class="related-work"><p>See more</p></section></article>', LONG),
        (f'<article><p>{LONG}</p><section class="related-posts"><p>{LONG}</p></section><div id="comment-12"><p>{LONG}</p></div></article>', LONG),
        # what stands beside a part with an article's name stays if it reads like one
        (f'<body><div class="content"><p>{LONG}</p></div><div><p>{LONG} {LONG}</p></div><div>Home</div></body>', f"{LONG} {LONG} {LONG}"),
        # broken nesting
        (f"<article><p>{LONG}<div><p>{LONG}<ul><li>one<li>two</ul></b></i><p>end", f"{LONG} {LONG} one two end"),
        # short parts of an article stay: leads, captions, sentences, quotes, sections, addresses, headings with a header's name, the title before
        (f"<article><div class=lead>In short, this.</div><p>{LONG}</p><div class='caption'>A picture.</div></article>", f"In short, this. {LONG} A picture."),
        (f"<article><div>One.</div><p>{LONG}</p><div>Two.</div></article>", f"One. {LONG} Two."),
        (f"<article><div><p>{LONG}</p></div><div><blockquote>So it is said</blockquote></div></article>", f"{LONG} So it is said"),
        (f"<article><section><h2>A</h2><p>{LONG}</p></section><section class=faq><h2>B</h2><p>Yes.</p></section></article>", f"A {LONG} B Yes."),
        (f"<article><p>{LONG}</p><address>Some Street 1</address></article>", f"{LONG} Some Street 1"),
        (f"<article><h2 class='section-header'>Part</h2><p>{LONG}</p></article>", f"Part {LONG}"),
        (f"<article><p>{LONG}</p><div class='privacy'><p>{LONG} {LONG}</p></div></article>", f"{LONG} {LONG} {LONG}"),
        (f"<body><h1>Title</h1><div class=content><p>{LONG}</p></div><div>Home.</div></body>", f"Title {LONG}"),
        # no names at all
        (f"<body><div>Home</div><div><p>{LONG}</p></div></body>", LONG),
    ],
)
def test_html_text_with_misleading_or_missing_names(page, text):
    assert html_text.main_text(page) == text


def signed_hash(text):
    return int.from_bytes(xxhash.xxh64((text or "").encode(), seed=42).digest(), "big", signed=True)


def substrings_removed(known):
    """Brute force: counts of (id or None, n_bytes, n_removed, n_spans, kept) for rows in the operator's order."""
    node = lambda d, t: store.NODE_IDS + (signed_hash(t) & store.NODE_IDS - 1) if d is None else d
    seen, out = set(), {}
    for _, _, doc, text in sorted({(node(d, t), signed_hash(t), d, t or "") for d, t in known}, key=lambda x: x[:2]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out[(doc, text)] = (doc, len(raw), sum(gone), runs, bytes(x for x, o in zip(raw, gone, strict=True) if not o))
    return Counter(out[(d, t or "")] for d, t in known)


def removed_by(frame):
    return Counter((r["id"] if r["id"] < store.NODE_IDS else None, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(frame).collect())


@pytest.mark.parametrize("paired", [512, 2])
@pytest.mark.parametrize("broadcast", [2_000_000, -1])
def test_suffix_dedup(spark, docs, rows, empty, monkeypatch, paired, broadcast):
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    monkeypatch.setattr(store, "BROADCAST_ROWS", broadcast)
    assert removed_by(docs) == substrings_removed([(d, t) for d, t, *_ in rows])
    rng = random.Random(6)
    z, y = words(rng, 60), words(rng, 50)
    several = [(1, z), (1, z + "X"), (2, z), (3, y + z), (3, y), (3, None), (4, y), (4, y), (None, z), (2, y[:150] + z[40:])]
    assert removed_by(spark.createDataFrame(several, "doc_id long, text string")) == substrings_removed(several)
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 4, 20_000), rng.integers(0, 3, 20_000), rng.integers(-900, 900, 20_000)]
    assert np.array_equal(np.stack([c[suffix_dedup.multikey_order(columns)] for c in columns]), np.stack([c[np.lexsort(columns[::-1])] for c in columns]))


def jaccard_parts(known, k, p, q):
    sets = {}
    for doc, text in known:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "p", "q", "broadcast"), [(3, 9, 10, 2_000_000), (5, 4, 5, 2_000_000), (3, 9, 10, -1)])
def test_jaccard_components(docs, rows, empty, monkeypatch, k, p, q, broadcast):
    monkeypatch.setattr(store, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(jaccard_join, "SPREAD", 2)
    nodes = [(store.NODE_IDS + j if d is None else d, t) for j, (d, t, *_) in enumerate(rows)]  # rows without id come after all others
    want = Counter(n_and_part if n_and_part[1] < store.NODE_IDS else (n_and_part[0], None) for d, n_and_part in jaccard_parts(sorted(set(nodes), key=lambda x: x[0]), k, p, q).items())
    repeated = Counter(rows)
    want[jaccard_parts(nodes, k, p, q)[10]] += sum(n - 1 for n in repeated.values())
    got = jaccard_join.link_components(docs, k, p, q).collect()
    assert Counter((r["n_shingles"], r["component_id"] if r["component_id"] < store.NODE_IDS else None) for r in got) == want
    if broadcast > 0 and k == 3:
        assert jaccard_join.link_components(empty, k, p, q).count() == 0


def test_jaccard_of_one_id_with_several_texts(spark):
    """Its texts are one document, which links through any of them; a text without words links with nothing."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    frame = spark.createDataFrame([(5, a), (5, b), (7, b), (1, a), (9, "other words than these"), (5, None)], "doc_id long, text string")
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(frame).collect()) == [(1, 38, 1), (5, 0, 5), (5, 38, 1), (5, 38, 1), (7, 38, 1), (9, 2, 9)]


def test_one_of_each_group_stays(spark):
    a = " ".join(f"a{k}" for k in range(40))
    frame = spark.createDataFrame([(3, a, 1, 2), (4, a + " end", 3, 4), (5, "else", 5, 6), (None, a, 7, 8)], "doc_id long, text string, _jj_id int, Node int")
    out = jaccard_join.keep_first(frame)
    assert out.columns == frame.columns
    assert sorted(tuple(r) for r in out.collect()) == [(3, a, 1, 2), (5, "else", 5, 6)]


def test_jaccard_of_many_near_copies(spark):
    """Sets that differ from one base by a few words each: many pairs are near the bound on either side."""
    rng = random.Random(9)
    base = [f"t{k}" for k in range(90)]
    known = []
    for d in range(60):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(90)] = f"e{rng.randrange(999)}"
        known.append((d, " ".join(text)))
    small = [f"s{k}" for k in range(16)]
    known += [(100 + d, " ".join([*small, f"z{d}"] if d % 2 else small[: 16 - d % 3])) for d in range(12)]
    frame = spark.createDataFrame(known, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(frame).collect()}
    assert got == jaccard_parts(known, 3, 9, 10)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (40, 40), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 31: 30, 32: 30}


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = [(k, words(rng, 15 + k, 5000) + ". " + words(rng, 6, 5000) + ".") for k in range(30)] + [(98, None), (99, "  ")]
    clean = [(1000 + k, words(rng, 150, 5000)) for k in range(120)]
    leaked = [(k, words(rng, 70, 5000) + " " + items[k][1].upper().replace("X", "x").replace("W", "w") + " " + words(rng, 33 + k, 5000)) for k in range(30)]
    reworded = items[29][1].split()
    reworded[2], reworded[9], reworded[14] = "other", "words", "here"
    more = [(500, words(rng, 40) + " " + " ".join(reworded)), (501, None), (502, ""), (None, items[3][1])]
    docs = spark.createDataFrame(clean + leaked + more, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(k, k) for k in range(30)} | {(500, 29), (None, 3)}
    named = docs.selectExpr("doc_id", "text", "1 AS _dc_id", "2 AS node", "3 AS ID")
    out = decontaminate.drop_leaks(named, benchmark)
    assert out.columns == named.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {d for d, _ in clean} | {501, 502}
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_decontamination_finds_long_and_reworded_items(spark, monkeypatch):
    rng = random.Random(14)
    items = [(k, words(rng, (20, 45, 90, 140, 200, 300)[k % 6], 20000) + ". " + words(rng, 6, 20000) + ".") for k in range(36)]

    def reworded(text):
        own = text.split()
        body = [w if k % 20 < 11 else words(rng, 1, 20000) for k, w in enumerate(own[:-6])]
        if len(body) > 64:  # the changed words spread among the others
            body = [w if k % 9 % 2 == 0 else words(rng, 1, 20000) for k, w in enumerate(own[:-6])]
        return " ".join(body + own[-6:])

    docs = [(k, words(rng, 40, 20000) + " " + text + " " + words(rng, 50, 20000)) for k, text in items]
    docs += [(100 + k, words(rng, 37, 20000) + " " + reworded(text) + " " + words(rng, 90, 20000)) for k, text in items]
    docs += [(200 + k, words(rng, 200, 20000)) for k in range(60)]

    def brute(item, text):
        parse = decontaminate.read_items([(0, item), (1, text)])
        own, near, answer = parse.words[0], parse.words[1], parse.answers[0]
        for first in range(0, len(near), decontaminate.BLOCK):
            window = near[max(0, first - len(own)) : first + 2 * decontaminate.BLOCK + len(own)]
            share = decontaminate.common_length(own, window) / len(own)
            if share >= decontaminate.LEAKED or share >= decontaminate.PARAPHRASED and decontaminate.common_length(answer, window) >= decontaminate.ANSWERED * len(answer):
                return True
        return False

    expected = {(d, i) for d, text in docs for i, item in items if brute(item, text)}
    assert expected >= {(base + k, k) for base in (0, 100) for k in range(36)}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(*frames).collect()} == expected
    monkeypatch.setattr(decontaminate, "ITEMS", 14)
    monkeypatch.setattr(decontaminate, "SEARCHES", 2)  # three blocks in two scans
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(*frames).collect()} == expected


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_length(np.array(a, int), np.array(b, int)) == best[-1][-1]


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/1", "http://example.net/de/1", "https://x.org/fr/a?b", "https://x.org/en/a", "http://www.example.com/de/", "http://hub.example.com/en/1", "http://good.example.com/en/1", None, "no scheme", "http://x.net", "http://x.org?u=http://example.net/"]
    html = [None] * len(urls)
    html[5] = '<a href="http://example.net/de/1">x</a><a href="/own">y</a>'
    html[2] = "<a href='//good.example.com/en/1'>x</a>"
    pages = spark.createDataFrame([(k, u, h, 1) for k, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in url_filter.verdicts(pages).collect()}
    assert [got[k]["rule"] for k in range(len(urls))] == ["example.net/en/", "net/", "org/fr/", None, "example.com/de/", None, None, None, None, None, None]
    assert [got[k]["verdict"] for k in range(7)] == ["allow", "block", "allow", "allow", "block", "block", "allow"]
    assert got[5]["distrust"] > 0 and got[6]["trust"] > 0
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/1")
    assert (got[7]["host"], got[8]["path"], got[9]["path"], got[10]["host"]) == ("", "", "", "x.org")
    assert url_filter.verdicts(pages.limit(0)).count() == 0


def test_trust_spreads_between_hosts_of_a_domain(spark):
    """Siblings share through their domain, though it has no page; ties and repeated rows are judged alike; long names have no domain."""
    urls = [f"https://a.x.org/fr/{k}" for k in range(3)] + ["https://b.x.org/en/1", "https://b.x.org/en/1", "https://c.y.example.com/en/1"]
    urls += [f"https://d.y.example.com/de/{k}" for k in range(3)] + ["https://d.y.example.com/en/9", "http://" + "z." * 100_000 + "org/en/", "http://10.1.2.3:80/en/"]
    pages = spark.createDataFrame([(k, u, "<a href=/own>x</a>", 1.0) for k, u in enumerate(urls)], "page_id long, url string, html string, Trust double")
    edges = {(r["src"], r["dst"]): r["links"] for r in url_filter.host_edges(url_filter.ruled(pages)).collect()}
    assert edges[("b.x.org", "x.org")] == edges[("x.org", "b.x.org")] == 2 and ("d.y.example.com", "example.com") in edges
    assert {s for s, _ in edges} == {"a.x.org", "b.x.org", "x.org", "c.y.example.com", "d.y.example.com", "y.example.com", "example.com"}
    got = {r["page_id"]: r for r in url_filter.verdicts(pages).collect()}
    assert [got[k]["verdict"] for k in range(len(urls))] == ["allow"] * 5 + ["block"] * 5 + ["allow"] * 2
    assert got[3]["trust"] > 0 and got[3]["trust"] == got[4]["trust"] and got[5]["rule"] is None and got[9]["rule"] is None


def brute_ranks(edges, seeds, hosts):
    """PageRank by dense power steps; hosts without a way on give their rank to the seeds."""
    at = {h: k for k, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for s, d, n in edges:
        move[at[s], at[d]] += n
    out = move.sum(axis=1)
    seed = np.zeros(len(hosts))
    for h, n in seeds:
        seed[at[h]] += n
    seed /= seed.sum()
    rank = seed
    for _ in range(300):
        sent = np.where(out > 0, rank / np.where(out > 0, out, 1), 0) @ move
        rank = url_filter.DAMPING * (sent + rank[out == 0].sum() * seed) + (1 - url_filter.DAMPING) * seed
    return dict(zip(hosts, rank, strict=True))


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = [f"h{k}" for k in range(25)]
    edges = [(f"h{rng.randrange(20)}", f"h{rng.randrange(25)}", float(rng.randrange(1, 5))) for _ in range(60)]  # five hosts lead nowhere
    edges = [(s, d, n) for s, d, n in edges if s != d]
    seeds = [("h3", 2.0, 0.0), ("h7", 1.0, 0.0), ("h21", 0.0, 3.0), ("h4", 0.0, 1.0)]
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, links double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")).collect()
    trust = brute_ranks(edges, [(h, t) for h, t, _ in seeds], hosts)
    distrust = brute_ranks([(d, s, n) for s, d, n in edges], [(h, b) for h, _, b in seeds], hosts)
    for r in got:
        assert (r["trust"], r["distrust"]) == pytest.approx((trust[r["host"]], distrust[r["host"]]), abs=1e-4)
    assert sum(r["trust"] for r in got) == pytest.approx(1) and {r["host"] for r in got} >= {h for s, d, _ in edges for h in (s, d)}


def slow_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality(spark, docs, rows, empty):
    rng = random.Random(8)
    junk = lambda: " ".join(f"{rng.choice('#*$%&|')}{rng.choice('xyz')}{rng.choice('#*$%&|')}" for _ in range(60))
    known = [(k, junk() if k % 3 == 0 else words(rng, 60), k % 3 != 0) for k in range(150)]
    extra = spark.createDataFrame([(1000 + k, t) for k, t, _ in known], "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + k, int(good)) for k, _, good in known[:120]] + [(None, 1), (5, None), (1003, 0)], "doc_id long, quality int")
    model = quality.train(extra, labels)
    held = {r["doc_id"]: r for r in quality.judge(extra, model).collect()}
    assert all(held[1000 + k]["_q_kept"] == good for k, _, good in known[120:])
    out = quality.judge(docs, model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r["doc_id"], *(r["_q_" + x] for x in names)) for r in out.collect())
    assert got == Counter((d, *slow_counts(t or "")) for d, t, *_ in rows)
    assert all(not r["_q_kept"] for r in out.where("_q_base_failed").collect())
    clashing = docs.withColumnsRenamed({"lang": "_q_kept", "_x": "_Q_n_words"})
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    assert quality.keep_good(clashing, labels).count() == quality.keep_good(docs, labels).count()
    assert quality.judge(empty, model).count() == 0
    unlabelled = quality.train(extra, labels.limit(0))
    assert quality.judge(extra, unlabelled).where("NOT _q_kept AND NOT _q_base_failed").count() == 0


def test_sharding(spark, docs, rows, empty):
    got = sharding.place(docs, 7).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(7)) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sharding.place(empty, 7).count() == 0
    assert {r["size"] for r in got if r["text_crc32"] == 0} == {16}
    before = {r["doc_id"]: r["shard"] for r in sharding.place(spark.range(3000).selectExpr("id AS doc_id", "'x' AS text"), 10).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.place(spark.range(3000).selectExpr("id AS doc_id", "'x' AS text"), 11).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.6 * len(before)
    many = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.place(many, n).collect()} for n in (40, 41))
    assert sum(before[d] != after[d] for d in before) < 0.1 * len(before)  # an even share is 1 / 41


def test_word_hashes_follow_the_words():
    texts = ["A b  c", None, "a\tB c", "x" * 3_000_000, "", "é a"]
    seen = {}
    for part in text_hash.slices(pa.array(texts, pa.string()), limit=64):
        found = text_hash.words(part)
        for d in range(part.docs):
            seen[part.first + d] = found.hash[found.doc == d].tolist()
    assert seen[0] == seen[2] and len(seen[0]) == 3 and seen[1] == seen[4] == [] and len(seen[3]) == 1 and seen[5][1] == seen[0][0]


def test_quality_of_documents_with_several_texts(spark):
    rng = random.Random(9)
    rows = [(k, words(rng, 30, 60) if k % 2 else "zz " * 20 + words(rng, 9, 20)) for k in range(60)]
    rows += [(k, words(rng, 25)) for k in range(10)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    found = [quality.train(spark.createDataFrame(order, "doc_id long, text string").repartition(n), labels) for order, n in ((rows, 1), (rows[::-1], 3))]
    assert (found[0].weights == found[1].weights).all() and found[0].bias == found[1].bias


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse_words_have_hashes_of_their_own(spark, n):
    x, y = thue_morse(n), thue_morse(n, "ba")
    (part,) = text_hash.slices(pa.array([f"{x} {y} {x.upper()}"], pa.string()))
    first, second, third = text_hash.words(part).hash.tolist()
    assert first == third != second
    docs = spark.createDataFrame([(1, x), (2, y), (3, x + " one two"), (4, y + " one two"), (5, x + "\n" + y), (6, x + "\n" + x)], "doc_id long, text string")
    parts = {r["id"]: r["component_id"] for r in jaccard_join.link_components(docs).collect()}
    assert parts == {k: k for k in range(1, 7)}
    judged = {r["doc_id"]: r for r in quality.judge(docs, quality.Model(np.zeros((quality.KINDS, quality.DIM)), 20.0, 1.0, 0.0)).collect()}
    assert [judged[k]["_q_n_dup_lines"] for k in range(1, 7)] == [0, 0, 0, 0, 0, 1]
    assert removed_by(docs) == substrings_removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    leaks = decontaminate.leaks(docs.where("doc_id < 3"), spark.createDataFrame([(7, x)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} <= {(1, 7)}


def run_stages(spark, folder):
    """The pipeline's last table; every stage but the last must keep the columns of the documents."""
    import corpus_pipeline

    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(folder))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{folder}/stage{k}")
        frame = spark.read.parquet(f"{folder}/stage{k}")
    return frame


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_small_tables(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2) for d, t, *_ in rows], DOCUMENTS + ", n_dropped int, _q_kept int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, rows[12][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = run_stages(spark, tmp_path)
    assert hashlib.sha256(b"").hexdigest() not in {r["decoded_sha256"] for r in frame.collect()}


@pytest.mark.parametrize("texts", [[], [None, "", "too short"]])
def test_pipeline_without_rows(spark, tmp_path, texts):
    """Empty tables, and stages that keep nothing."""
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert run_stages(spark, tmp_path).count() == 0


def brute_codes(vectors, parts=4, entries=256, rounds=4):
    """Codebooks, codes and errors of integer vectors by plain Python."""
    size = len(vectors[0]) // parts
    cut = [[v[k * size : (k + 1) * size] for v in vectors] for k in range(parts)]
    books = [own[:entries] for own in cut]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            found = [near(p, books[k])[1] for p in cut[k]]
            new = list(books[k])
            for e in set(found):
                own = [p for p, f in zip(cut[k], found, strict=True) if f == e]
                new[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
            books[k] = new
    got = [[near(cut[k][r], books[k]) for k in range(parts)] for r in range(len(vectors))]
    return books, ["".join(f"{e:02x}" for _, e in g) for g in got], [sum(d for d, _ in g) for g in got]


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_vector_codes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(store, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    table = [(k, [rng.gauss(0, 1) for _ in range(8)], rng.choice([1, 2, None]), "a") for k in range(300)]
    table += [(300 + k, [1.0] * 8, 1, "b") for k in range(200)] + [table[3], table[3]]  # a common vector, repeated rows
    table += [(900, None, 1, "c"), (901, [1.0, None] + [0.0] * 6, 1, "c"), (902, [float("nan")] + [0.0] * 7, 1, "c"), (903, [float("inf")] * 8, 2, "c")]
    table += [(904, [1e30] * 8, 1, "c"), (905, [1.0] * 4, 1, "c"), (None, [-5e4, 2.0] * 4, 2, "c")]
    docs = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, _label string").repartition(3)
    kept = sorted((r for r in table if r[1] and len(r[1]) == 8 and all(x is not None and abs(x) < 1e6 for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books, codes, errors = brute_codes([[int(np.floor(x * 1024)) for x in r[1]] for r in kept], entries=64)
    out, trained = vector_codes.encode(docs, entries=64)
    assert [b.tolist() for b in trained.books] == books
    total = Counter()
    for r, e in zip(kept, errors, strict=True):
        total[r[2]] += e
    assert Counter((r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in out.collect()) == Counter((r[0], r[2], c, e, total[r[2]]) for r, c, e in zip(kept, codes, errors, strict=True))
    back = {r["id"]: r["vector"] for r in vector_codes.decode(out, trained).collect()}
    assert back[5] == [x / 1024 for b, e in zip(books, bytes.fromhex(codes[[r[0] for r in kept].index(5)]), strict=True) for x in b[e]]


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    none, trained = vector_codes.encode(spark.createDataFrame([], schema))
    assert none.count() == 0 and trained.books[0].size == 0
    blank, _ = vector_codes.encode(spark.createDataFrame([(1, [], "x"), (2, [], None)], schema))
    assert sorted((r["code"], r["error"]) for r in blank.collect()) == [("00000000", 0)] * 2
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 6, "x")], schema))


@pytest.mark.parametrize("scale", [1, 3, 1000, 1 << 27])
def test_tree_finds_what_a_scan_finds(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale + 1, (256, 4)) * rng.integers(0, 2, (256, 1))
    queries = np.concatenate([rng.integers(-scale, scale + 1, (2000, 4)), points])
    index, distance = vector_codes.nearest(points, vector_codes.gnat(points), queries)
    every = ((queries[:, None].astype(object) - points.astype(object)) ** 2).sum(axis=2).astype(np.int64)
    assert (distance == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


FILES = token_alignment.read_vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, from the libraries' whole encodings."""
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_str(FILES.a), sentencepiece.SentencePieceProcessor(model_proto=FILES.b)
    first.encode_special_tokens = True
    letters = token_alignment.byte_alphabet()
    groups = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(raw.decode(), add_special_tokens=False).ids]
        pieces = [(i, second.id_to_piece(i)) for i in second.encode(text or "")]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            groups.append([])
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts, out, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        places = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
        for cut in cuts:
            upto = [p[cut] for p in places]
            out.append(tuple([i for i, _ in side[x:y]] for side, x, y in zip((a, b), at, upto, strict=True)))
            at = upto
        groups.append(out)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in own.items()),
         hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else "")
        for g, own in zip(groups, links, strict=True)
    ]


def odd_texts(n):
    rng = random.Random(8)
    pool = ["a", "b", "the", " ", "  ", "\n", "\t", " \n ", "é", "漢字", "😀", "▁", "'s", "123", "...", "\x00", "\x1c", "\u180e", "\xa0", "<|endoftext|>", "<s>", "<0x41>", "\u2028", "ab" * 30, "\x85"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("hot_pairs", [1_000_000, 40, 0])
def test_token_alignment(spark, rows, hot_pairs):
    texts = [r[1] for r in rows] + odd_texts(400) + ["a" * 5000, "=" * 3000 + "-" * 777, "漢" * 2000, " " * 30_000, "x" + "\n" * 20_000 + " y"]
    table = spark.createDataFrame([(k % 300, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    got = Counter(tuple(r) for r in token_alignment.score(table, FILES, hot_pairs=hot_pairs).collect())
    assert got == Counter((k % 300, *x) for k, x in enumerate(brute_alignment(texts)))


def test_token_alignment_of_no_documents(spark, empty):
    assert token_alignment.score(empty, FILES).count() == 0 == token_alignment.align(empty, FILES).count()


def test_token_groups(spark):
    (r,) = token_alignment.align(spark.createDataFrame([(1, "internationalization of naïve tokens")], "doc_id long, text string"), FILES).collect()
    coder = token_alignment.Encoders(FILES)
    ends = [[b"".join(names[i] for i in ids[:k]) for k in upto] for names, ids, upto in ((coder.a_bytes, r["a_ids"], r["a_upto"]), (coder.b_bytes, r["b_ids"], r["b_upto"]))]
    assert ends[0] == ends[1] and ends[0][-1] == " internationalization of naïve tokens".encode() and len(ends[0]) > 2


def one_pass(score, penalty):
    """Viterbi word by word: the greatest total, and what a labelling adds up to."""
    best = list(score[0])
    for row in score[1:]:
        top = max(best) - penalty
        best = [max(b, top) + x for b, x in zip(best, row, strict=True)]
    return max(best)


@pytest.mark.parametrize("segment", [1, 3, 7, 256])
def test_labels_are_the_best_ones(segment):
    rng = np.random.default_rng(segment)
    for langs in (1, 2, 5):
        cuts = np.cumsum([0, 0, 1, 40, 7, 0, 21, 300, 0])
        score = rng.normal(0, 2, (cuts[-1], langs)) + np.repeat(rng.normal(0, 1, (cuts[-1] // 9 + 1, langs)), 9, axis=0)[: cuts[-1]]
        label = language_id.best_labels(score, cuts, 3.0, segment)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                own = score[low:high][np.arange(high - low), label[low:high]].sum() - 3.0 * (label[low + 1 : high] != label[low : high - 1]).sum()
                assert own == pytest.approx(one_pass(score[low:high].tolist(), 3.0))


SAMPLES = {
    "en": "the house is on the hill and the people of the town think that it was there before they came",
    "de": "das haus steht auf dem berg und die leute der stadt denken dass es schon da war bevor sie kamen",
    "ru": "дом стоит на холме и люди города думают что он был там до того как они пришли",
    "el": "το σπίτι είναι στον λόφο και οι άνθρωποι της πόλης πιστεύουν ότι ήταν εκεί",
}


def test_language_id(spark, empty):
    train = [(k, t, lang) for k, (lang, t) in enumerate(SAMPLES.items())] + [(None, "x", None), (9, None, "en")]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.names == sorted(SAMPLES)
    mixed = "the people of the town think that Die Leute der Stadt denken dass 12 люди города думают!"
    texts = [None, "", "12 - \n", "THE TOWN", "der Berg", "город", "漢字", mixed, " ".join([SAMPLES["de"]] * 3000), "e\u0301a the house", "the" * 400_000]
    table = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(3, "THE TOWN", 2.0)], "doc_id long, text string, score double").repartition(2)
    got = {r["id"]: r for r in language_id.identify(table, model).collect()}
    assert [(got[k]["lang"], got[k]["score"]) for k in (0, 1, 2)] == [("und", 0.0)] * 3 and got[0]["spans"] == []
    assert [got[k]["lang"] for k in (3, 4, 5, 8, 9, 10)] == ["en", "de", "ru", "de", "en", "en"] and got[6]["lang"] in SAMPLES
    assert got[8]["spans"] == [(0, len(texts[8]), "de")] and got[10]["spans"] == [(0, 1_200_000, "en")]
    assert [(mixed[s["start"] : s["end"]], s["lang"]) for s in got[7]["spans"]] == [("the people of the town think that", "en"), ("Die Leute der Stadt denken dass", "de"), ("люди города думают", "ru")]
    assert got[7]["score"] == pytest.approx(27 / (27 + 26 + 16)) and got[7]["lang"] == "en"
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {(r["lang"], r["score"], len(r["spans"])) for r in language_id.identify(table, nothing).collect()} == {("und", 0.0, 0)}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    truth = {r["doc_id"]: r["lang"] for r in docs.where(language_id.held_out()).collect() if r["lang"] and r["text"] and len(r["text"]) > 20}
    got = {r["id"]: r["lang"] for r in language_id.identify(docs.where(language_id.held_out()), model).collect()}
    assert np.mean([got[k] == v for k, v in truth.items()]) > 0.95
