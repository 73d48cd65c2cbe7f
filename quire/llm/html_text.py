"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with its path of tags from the root, with their class and id
names (digits left out); inline tags at its end don't count, so a paragraph is one with its
emphasis and links.  Blocks of one path are taken together: the length of their text and its
punctuation give the path's ratio, the text and punctuation an average block of the path
carries; the text of links counts a tenth.  Ratios of paragraphs, headings and the like are
smoothed over the neighbouring paths of their container, and all are weighed by what tags and
names say: parts of an article and unmarked ones alike, names that may say otherwise
``DOUBTFUL``, and a menu, footer, advert, comment and the like not at all.  Paths whose weighed
ratio reaches a share of the page's deviation are content, whatever they are called.  Short
paragraphs, headings, list items, cells and sentences stay if they lie in the container that
such paths share and aren't mostly links; so does the page's title before them.

A class or id names a part outside the article if all its words do, general ones (``site``,
``list``) aside: ``comment-list`` does, ``related-work`` is doubtful.  Attributes are read as
browsers read them, so words within other values say nothing.

Text nodes of content paths are decoded, their white space made single, and joined by block.

Defined results: a null or empty html has no text; broken markup is closed as a browser would
(a block start ends an open paragraph, the end of the input ends all); repeated rows are
judged alike; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text.
HIDDEN = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "option", "button"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr"}
#: Block starts that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "dialog", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
ENDS_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SCOPES = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th", "ul", "ol", "blockquote", "figure", "fieldset"}
#: Elements that hold no part of the article, wherever they stand.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
#: Words of class and id names that say the same.
OUTSIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "disclaimer", "footer", "foot", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "topbar", "widget"}
#: Words beside these that change nothing.
GENERAL_NAMES = {"", "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "policy", "post", "posts", "primary", "right", "section", "side", "site", "slot", "stories", "text", "thread", "top", "unit", "user", "wrap", "wrapper"}
#: Of these, words that an article's own parts have too: its headings, and texts about such matters.
HEADER_NAMES = {"header", "foot"}
WEAK_NAMES = HEADER_NAMES | {"privacy", "disclaimer", "banner"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
INSIDE_TAGS, INSIDE_NAMES = {"article", "main"}, {"article", "post", "entry", "story", "content", "main", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that stay when short, beside content.
TEXTUAL = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "address"}
#: Weights of what tags and names say; text that is never shown, and white space between texts, have none.
INSIDE, UNMARKED, DOUBTFUL, OUTSIDE_WEIGHT, NEVER, SPACE = 2.0, 1.0, 0.5, 0.0, -1.0, -2.0
SMOOTHING, SHARE_OF_DEVIATION, LINK_WEIGHT = 1, 0.5, 0.1

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ATTRIBUTE + r")*+)(?:>|\Z)", re.S)
_VALUE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?""", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、！？；：]")
_BLANK = re.compile(r"\s+")
_SENTENCE = re.compile(r"""[.!?:;…。！？：；][)\]"'”’»]*\s*\Z""")


def _named(value: str, inside: bool) -> float | None:
    """What one class or id name says; ``inside`` an article, some words say less."""
    words = re.split(r"[^a-z]+", value)
    outside = [w for w in words if w in OUTSIDE_NAMES]
    if inside and outside and set(outside) <= WEAK_NAMES:
        return None if set(outside) <= HEADER_NAMES else DOUBTFUL
    if outside:
        return OUTSIDE_WEIGHT if all(w in OUTSIDE_NAMES or w in GENERAL_NAMES for w in words) else DOUBTFUL
    return INSIDE if any(w in INSIDE_NAMES for w in words) else None


def _says(tag: str, attributes: str, inside: bool) -> tuple[float | None, str]:
    """The weight that an element's tag and attributes give (None: they say nothing), and its part of the path."""
    said, names = [], []
    if tag in HIDDEN:
        said.append(NEVER)
    elif tag in OUTSIDE:
        said.append(OUTSIDE_WEIGHT)
    elif tag in INSIDE_TAGS:
        said.append(INSIDE)
    for name, raw in _VALUE.findall(attributes) if attributes and not attributes.isspace() else ():
        name, value = name.lower(), raw.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            said.append(NEVER)
        elif name == "role" and value in OUTSIDE_ROLES:
            said.append(OUTSIDE_WEIGHT)
        elif name in ("class", "id") and tag not in ("html", "body"):
            for own in value.split():
                told = _named(own, inside)
                if told is not None and not (told < UNMARKED and tag in INSIDE_TAGS):
                    said.append(told)
                names.append(("." if name == "class" else "#") + re.sub(r"[^\w-]|\d", "", own))
    low, high = min(said, default=UNMARKED), max(said, default=UNMARKED)
    return (low if low < UNMARKED else high if said else None), tag + "".join(sorted(set(names)))


def _tag(step: str) -> str:
    return re.split(r"[.#]", step, maxsplit=1)[0]


class _Node:
    __slots__ = ("block", "linked", "path", "text", "weight")

    def __init__(self, path: str, weight: float, block: int, text: str):
        steps = path.split("/")
        self.linked = any(_tag(step) == "a" for step in steps)
        while _tag(steps[-1]) in INLINE:
            steps.pop()
        self.path, self.weight, self.block, self.text = "/".join(steps), weight, block, text


def text_nodes(page: str) -> list[_Node]:
    """The shown text nodes of a page in order, with path, weight and block number."""
    stack: list[tuple[str, str, float]] = []  # tag, path, weight
    out, block, at = [], 0, 0

    def add(raw: str) -> None:
        path, weight = stack[-1][1:] if stack else ("", UNMARKED)
        if weight != NEVER and raw:
            out.append(_Node("", SPACE, block, " ") if raw.isspace() else _Node(path, weight, block, raw))

    def close(tags: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            return out
        add(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            add(html.escape(m[0][9:].removesuffix("]]>")))
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if m[1]:
            if tag not in VOID:
                scope = SCOPES - {tag} if tag in INLINE or tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else {"body"}
                close({tag}, scope)
            continue
        if tag in ENDS_P:
            close({"p"}, SCOPES)
        if tag in ENDS_LIKE:
            close(*ENDS_LIKE[tag])
        if tag == "body":  # a head that was never closed ends here
            close({"head"}, set())
        if tag in VOID:
            continue
        above = stack[-1] if stack else ("", "", UNMARKED)
        said, step = _says(tag, m[3], above[2] == INSIDE)
        if tag == "header" and above[2] != INSIDE:
            said = OUTSIDE_WEIGHT
        weight = above[2] if said is None or above[2] <= OUTSIDE_WEIGHT else said
        if said == NEVER:
            weight = NEVER
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].rstrip().endswith("/") and tag in HIDDEN:
            continue
        stack.append((tag, f"{above[1]}/{step}", weight))


def content_paths(nodes: list[_Node]) -> set[tuple[str, float]]:
    """(path, weight) of the paths whose smoothed and weighed ratio passes the page's threshold, and the short ones beside them."""
    text: dict[tuple[str, float], list[float]] = {}
    blocks: dict[tuple[str, float], set[int]] = {}
    for node in nodes:
        if node.weight >= OUTSIDE_WEIGHT:
            stat = text.setdefault((node.path, node.weight), [0.0, 0.0, 0.0])
            size = len(node.text.strip())
            stat[0] += size * (LINK_WEIGHT if node.linked else 1)
            stat[1] += 0 if node.linked else len(_PUNCTUATION.findall(node.text))
            stat[2] += size if node.linked else -size
            blocks.setdefault((node.path, node.weight), set()).add(node.block)
    if not text:
        return set()
    paths = list(text)  # in page order
    stats, n = np.array([text[p] for p in paths]), np.array([len(blocks[p]) for p in paths])
    ratio = (stats[:, 0] / n) * (1 + stats[:, 1] / n)
    fused = ratio.copy()
    groups: dict[tuple[str, float], list[int]] = {}
    for k, (path, weight) in enumerate(paths):
        up, _, step = path.rpartition("/")
        if _tag(step) in TEXTUAL and stats[k, 2] <= 0:
            groups.setdefault((up, weight), []).append(k)
    for own in groups.values():
        padded = np.pad(ratio[own], SMOOTHING, mode="edge")
        fused[own] = np.maximum(ratio[own], sum(padded[j : j + len(own)] for j in range(2 * SMOOTHING + 1)) / (2 * SMOOTHING + 1))
    fused *= np.minimum(UNMARKED, [weight for _, weight in paths])
    threshold = SHARE_OF_DEVIATION * float(np.std(fused))
    chosen = {p for p, f in zip(paths, fused, strict=True) if f > 0 and f >= min(threshold, fused.max())}
    return chosen | {paths[k] for own in groups.values() for k in own if fused[k] > 0 and _beside(*paths[k], chosen)}


def _beside(path: str, weight: float, chosen: set[tuple[str, float]]) -> bool:
    """Whether a short text lies in the container of a chosen path that is marked alike, or is a heading above one in an article."""
    up, _, step = path.rpartition("/")
    for other, marked in chosen:
        home = other.rpartition("/")[0]
        if marked == weight and (up == home or weight == INSIDE and (f"{up}/".startswith(f"{home}/") or _tag(step) in HEADINGS and home.startswith(f"{up}/"))):
            return True
    return False


def _between(nodes: list[_Node], chosen: set[tuple[str, float]]) -> set[int]:
    """Blocks that stay though their paths are short: those of the container that the chosen ones share.

    In that container, paragraphs, headings and the like stay, and other blocks that end as a
    sentence does, if they aren't mostly links; outside an article or main part only between the
    first and last chosen block.  The h1 nearest before the chosen blocks stays if these hold none
    and it stands in a container of theirs.
    """
    own = [n for n in nodes if (n.path, n.weight) in chosen]
    if not own:
        return set()
    steps = [n.path.split("/")[:-1] for n in own]
    shared = steps[0]
    for other in steps[1:]:
        same = next((k for k, (x, y) in enumerate(zip(shared, other, strict=False)) if x != y), min(len(shared), len(other)))
        shared = shared[:same]
    article = max((k for k, x in enumerate(shared) if _tag(x) in INSIDE_TAGS), default=None)
    home = "/".join(shared if article is None else shared[: article + 1])  # all of an article, or the container
    first, last = own[0].block, own[-1].block
    blocks: dict[int, list[_Node]] = {}
    for node in nodes:
        if node.weight > OUTSIDE_WEIGHT and (node.path, node.weight) not in chosen:
            blocks.setdefault(node.block, []).append(node)
    out, titles = set(), []
    for block, parts in blocks.items():
        linked = sum(len(n.text) for n in parts if n.linked)
        if linked * 2 > sum(len(n.text) for n in parts):
            continue
        up, _, step = parts[0].path.rpartition("/")
        inside = f"{parts[0].path}/".startswith(f"{home}/") and (article is not None or first < block < last)
        plain = parts[0].weight != DOUBTFUL and all(n.weight != DOUBTFUL for n in parts)
        if inside and plain and (_tag(step) in TEXTUAL or _SENTENCE.search("".join(n.text for n in parts))):
            out.add(block)
        elif _tag(step) == "h1" and block < first and f"{home}/".startswith(f"{up}/"):
            titles.append(block)
    if titles and not any(_tag(n.path.rpartition("/")[2]) == "h1" for n in own):
        out.add(titles[-1])
    return out


def main_text(page: str) -> str:
    """The text of the page's content paths and of the short blocks among them: blocks in order, joined by one space."""
    nodes = text_nodes(page)
    chosen = content_paths(nodes)
    short = _between(nodes, chosen)
    blocks: dict[int, list[str]] = {}
    for node in nodes:
        if (node.path, node.weight) in chosen or node.block in short and node.weight > OUTSIDE_WEIGHT:
            blocks.setdefault(node.block, []).append(node.text)
        elif node.weight == SPACE and node.block in blocks:
            blocks[node.block].append(" ")
    done = (_BLANK.sub(" ", html.unescape("".join(parts))).strip() for parts in blocks.values())
    return " ".join(b for b in done if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(p.as_py() or "") for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
