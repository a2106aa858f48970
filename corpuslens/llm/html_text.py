"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks at its block-level tags. A block is described by its
word count and link density, those of its neighbours, and what encloses it
(page furniture, names of class, id or role that tell of it, an article). A
decision tree, trained on a small labelled table of blocks, keeps or drops each
block. The table is laid out by rule from ``EXAMPLES``: kinds of page parts, in
random order and lengths from a fixed seed, with the label of each part.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import arrow_map, schema_with

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)(?=[\s/>])"
    r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML elements by role, and words of class, id or role names.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search "
    "section summary table tbody td tfoot th thead tr ul video audio "
    "noscript template select svg math iframe object canvas datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form fieldset menu dialog button label legend option header search "
                      "noscript template select svg math iframe object canvas datalist".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbox sponsor sponsored sponsors promo promotion promoted "
    "banner cookie cookies consent gdpr notice notices notification alert alerts warning disclaimer popup modal overlay "
    "comment comments commentlist reply replies respond disqus discussion sidebar side rail aside widget widgets menu "
    "menus nav navbar navigation navigational breadcrumb breadcrumbs crumbs pager pagination footer foot foots "
    "bottom copyright legal header head masthead topbar toolbar top related recommended recommendations more "
    "share sharing social follow newsletter subscribe subscription signup login signin search form tags tagcloud "
    "complementary contentinfo skip meta byline adsbygoogle taboola outbrain".split())
ARTICLE = frozenset("article main content post entry story text body maincontent articlebody".split())
_TITLED = frozenset("header head top".split())  # names that an article's own heading may bear
# Hints that hold even on an element named as an article, and words by which a
# name tells what something else is like (``has-sidebar``).
_STRONG = frozenset("comment comments commentlist reply replies respond disqus ad ads advert adverts advertisement "
                    "sponsor sponsored promo promotion related recommended newsletter".split())
# Hints that name many other things as well: they tell nothing of long texts, so
# the tree weighs them against the words and links.
_WEAK = frozenset("legal more bottom side foot rail skip meta form search tag tags follow reply discussion alert warning".split())
_ABOUT = frozenset("has with no without".split())
# Words that only say that a name is a box; beside a word of ARTICLE they change nothing.
_BOX = frozenset("wrapper wrap container inner outer area box page section block column col copy full wide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "hinted",
            "in_article", "heading", "paragraph", "in_article_header", "beside_article", "weakly_hinted")


def _described(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Furniture, hinted, article, header, weakly hinted of an opening tag. Forms
    are judged once the page is read (``_layout_forms``)."""
    names: set[str] = set()
    named = away = False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id", "role"):
                for one in value.split():
                    words = {x.lower() for x in _NAME.findall(one)}
                    if not words & _ABOUT:
                        names.update(words)
                        told = {x for x in words if not x.isdigit()}
                        named |= bool(told & ARTICLE) and told <= ARTICLE | _BOX  # ``sidebar-content`` is no article
            elif key == "style":
                away |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            else:
                away |= key == "hidden" or value.lower() == "true"
    article = tag in ("article", "main") or named and tag not in ("body", "html")
    hints = names & HINTS
    header = tag == "header" or bool(hints & _TITLED)
    if article:
        hints &= _STRONG
    if tag in ("body", "html"):
        hints = set()  # names of the whole page's look
    hints -= _TITLED
    return (tag in FURNITURE and tag not in ("header", "form", "fieldset")) or away, bool(hints - _WEAK), article, header, bool(hints & _WEAK)


#: A block of the article's own text: so many words, so few of them linked.
_TEXT_WORDS, _TEXT_LINKS = 12, 0.3


def _layout_forms(found: list[tuple], articles: dict[int, int]) -> set[int]:
    """The forms that wrap a page rather than ask for something: those around an
    article element, or around more than half of the page's text."""
    own: dict[int, int] = {}
    total = 0
    for _, (words, linked, *_), forms in found:
        if words >= _TEXT_WORDS and linked <= _TEXT_LINKS * words:
            total += words
            for f in forms:
                own[f] = own.get(f, 0) + words
    return set(articles) | {f for f, n in own.items() if 2 * n > total and n >= 50}


def blocks(page: str) -> list[tuple[str, tuple]]:
    """Non-empty blocks of a page in order: decoded text in one line, and
    ``words, linked words, furniture, hinted, in_article, heading, paragraph,
    header, weakly hinted``."""
    found: list[tuple[str, tuple, tuple]] = []
    # open block elements: tag, what holds within (furniture, hinted, article,
    # header, weakly hinted, heading), and the open forms
    stack: list[tuple[str, tuple, tuple]] = [("", (False,) * 6, ())]
    opened: dict[str, int] = {}
    articles: dict[int, int] = {}  # forms with an article element
    forms = 0
    parts: list[str] = []
    linked, anchor = 0, False

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            words = text.count(" ") + 1
            tag, (furniture, hinted, article, header, weak, heading), inside = stack[-1]
            found.append((text, (words, min(linked, words), furniture, hinted, article, heading,
                                 tag in ("p", "blockquote", "pre", "li", "td"), header, weak), inside))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
                if anchor:
                    linked += len(text.split())
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            anchor = not m[2]
        elif tag in BLOCK:
            if parts:
                close_block()
            linked = 0
            if m[2]:
                while opened.get(tag):
                    last = stack[-1][0] == tag
                    pop()
                    if last:
                        break
            elif tag not in VOID and not m[4].endswith("/"):
                if stack[-1][0] == "p" or stack[-1][0] == tag in ("li", "td", "tr", "dd", "dt", "option"):
                    pop()  # ends where the next one begins
                _, above, inside = stack[-1]
                own = _described(tag, m[4])
                if tag in ("form", "fieldset"):
                    forms += 1
                    inside = (*inside, forms)
                elif tag in ("article", "main"):
                    articles.update((f, 1) for f in inside)
                stack.append((tag, (*(a or b for a, b in zip(above, own)), above[5] or tag in HEADINGS), inside))
                opened[tag] = opened.get(tag, 0) + 1
    close_block()
    layout = _layout_forms(found, articles)
    return [(text, (*f[:2], f[2] or any(x not in layout for x in inside), *f[3:])) for text, f, inside in found]


def features(found: list[tuple[str, tuple]]) -> np.ndarray:
    """One row of FEATURES for each block of a page."""
    x = np.zeros((len(found), len(FEATURES)), np.float32)
    if found:
        raw = np.array([f for _, f in found], np.float32)
        words, links = raw[:, 0], raw[:, 1] / np.maximum(raw[:, 0], 1)
        x[:, 0], x[:, 1] = words, links
        x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
        header, article = raw[:, 7] > 0, raw[:, 4] > 0
        x[:, 6] = (raw[:, 2] > 0) | (header & ~article)
        x[:, 7:11] = raw[:, 3:7]
        x[:, 11] = header & article
        x[:, 12] = article.any() & ~article
        x[:, 13] = raw[:, 8]
    return x


#: Kinds of page parts: markup with ``{n-m}`` for that many words, ``{a}`` for a
#: linked word; whether its text is the article's; where it stands (0: around
#: the article, 1: in it, 2: around one that its element tells, 3: in such a one).
EXAMPLES = (
    ("<nav><ul><li>{a}</li><li>{a}</li><li>{a}</li></ul></nav>", False, 0),
    ("<div class='menu'>{a}{a}{a}</div>", False, 0),
    ("<ul id='main-nav'><li>{a}<li>{a}</ul>", False, 0),
    ("<header><div>{1-6}</div>{a}</header>", False, 0),
    ("<div id='header'><h1>{1-4}</h1></div>", False, 0),
    ("<footer>&copy; {1-20}</footer>", False, 0),
    ("<div class='site-footer'><p>{2-30}</p>{a}</div>", False, 0),
    ("<aside><h3>{1-4}</h3><p>{3-40}</p></aside>", False, 0),
    ("<div class='sidebar'><p>{3-60}</p>{a}</div>", False, 0),
    ("<div class='sidebar-content'><p>{3-60}</p>{a}</div>", False, 0),
    ("<div class='footer-text'><p>{2-30}</p></div>", False, 0),
    ("<div id='cookie-text'>{4-40}</div>", False, 0),
    ("<div class='modal-body'><p>{4-60}</p></div>", False, 0),
    ("<div class='ad'>{2-25}</div>", False, 0),
    ("<div class='ad-box'><p>{2-25}</p></div>", False, 1),
    ("<p class='sponsored'>{3-30}</p>", False, 1),
    ("<div class='cookie-notice'><p>{4-40}</p><button>{1-2}</button></div>", False, 0),
    ("<div role='alert'>{3-25}</div>", False, 0),
    ("<form><label>{1-3}</label><input><button>{1-2}</button></form>", False, 0),
    ("<form><p>{3-20}</p></form>", False, 1),
    ("<section id='comments'><h2>{1-3}</h2><div class='comment'><p>{1-90}</p></div></section>", False, 0),
    ("<div class='comments'><p>{1-90}</p></div>", False, 1),
    ("<div class='related'><p>{a}{a}{a}</p></div>", False, 1),
    ("<aside>{3-40}</aside>", False, 1),
    ("<div style='display:none'>{1-40}</div>", False, 0),
    ("<div>{a}{a}{a}{a}</div>", False, 0),
    ("<div><a href='/'>{1-3}</a></div>", False, 0),
    ("<div>{1-4}</div>", False, 0),
    ("<div>&copy; {2-14}</div>", False, 0),
    ("<p class='legal'>{2-14}</p>", False, 0),
    ("<div class='meta'>{1-6}</div>", False, 0),
    ("<p class='more'>{a}</p>", False, 1),
    ("<div class='alert'>{2-12}</div>", False, 0),
    ("<div class='msg'>{2-40}</div>", False, 2),
    ("<p>{2-40}</p>", False, 2),
    ("<h1>{1-14}</h1>", True, 1),
    ("<header><h1>{1-14}</h1></header>", True, 1),
    ("<h2>{1-9}</h2>", True, 1),
    ("<p>{1-4}</p>", True, 1),
    ("<p>{5-220}</p>", True, 1),
    ("<p><b>{8-120}<br>", True, 1),
    ("<p>{20-90}{a}{10-40}</p>", True, 1),
    ("<ul><li>{1-20}</li><li>{2-12}</li></ul>", True, 1),
    ("<blockquote>{4-60}</blockquote>", True, 1),
    ("<pre>{4-60}</pre>", True, 1),
    ("<table><tr><td>{1-5}</td><td>{1-5}</td></tr></table>", True, 1),
    ("<div>{20-150}</div>", True, 1),
    ("<p class='story-more'>{16-160}</p>", True, 1),
    ("<div class='bottom'><p>{16-160}</p><p>{16-160}</p></div>", True, 1),
    ("<ol><li><a href='/r'>{4-16}</a></li><li><a href='/r'>{4-16}</a></li><li><a href='/r'>{4-16}</a></li></ol>", True, 3),
)
#: Titles that stand first in an article, as most do.
TITLES = ("<h1>{2-14}</h1>", "<header><h1>{2-14}</h1></header>", "<h2>{2-9}</h2>", "", "<p>{1-12}</p>")
FRAMES = ("<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div class='post-body'>{}</div>",
          "<main><article>{}</article></main>", "<form><article>{}</article></form>", "<div>{}</div>", "<div>{}</div>",
          "<div class='legal-text'>{}</div>", "<div class='read-more-body'>{}</div>")
#: Frames that tell nothing, or the wrong thing, of what they hold.
BARE = frozenset(("<div>{}</div>", "<div class='legal-text'>{}</div>", "<div class='read-more-body'>{}</div>"))
EXAMPLE_PAGES = 1200


def labelled_blocks(frames: tuple[str, ...] = FRAMES) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of all blocks of EXAMPLE_PAGES pages, and
    whether each belongs to the article. Pages have one of ``frames`` around it."""
    rng = np.random.default_rng(20)
    rows, labels = [], []
    plain = [e for e in EXAMPLES if e[2] == 0]
    beside = [e for e in EXAMPLES if e[2] != 1]
    within = {True: [e for e in EXAMPLES if e[2] == 1], False: [e for e in EXAMPLES if e[2] in (1, 3)]}

    def part(example) -> str:
        word = "keep" if example[1] else "drop"
        fill = lambda m: " ".join([word] * int(rng.integers(int(m[1]), int(m[2]) + 1))) + " "
        return re.sub(r"\{(\d+)-(\d+)\}", fill, example[0]).replace("{a}", f"<a href='/x'>{word}</a> ")

    for _ in range(EXAMPLE_PAGES):
        pick = lambda of, n: "".join(part(of[k]) for k in rng.integers(0, len(of), n))
        frame = frames[rng.integers(0, len(frames))]
        bare = frame in BARE
        around, inside = (plain if bare else beside), within[bare]
        title = part((TITLES[rng.integers(0, len(TITLES))], True, 1))
        long = "".join(part(("<p>{16-160}</p>", True, 1)) for _ in range(2)) if bare else ""
        page = pick(around, rng.integers(0, 5)) + frame.format(title + long + pick(inside, rng.integers(1, 12))) + pick(around, rng.integers(0, 5))
        found = blocks(f"<html><head><title>t</title></head><body>{page}</body></html>")
        rows.append(features(found))
        labels.extend("keep" in text for text, _ in found)
    return np.concatenate(rows), np.array(labels)


class Tree:
    """A binary decision tree: Gini splits at midpoints of observed values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 6):
        self.feature, self.cut, self.below, self.above, self.value = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least) -> int:
        node = len(self.value)
        for column, v in zip((self.feature, self.cut, self.below, self.above, self.value), (-1, 0.0, -1, -1, bool(y.mean() >= 0.5))):
            column.append(v)
        if depth and len(y) >= 2 * least and 0 < y.sum() < len(y):
            best = (1e-9, -1, 0.0)
            whole = 2 * y.mean() * (1 - y.mean()) * len(y)
            for k in range(x.shape[1]):
                order = np.argsort(x[:, k], kind="stable")
                v, hit = x[order, k], np.cumsum(y[order])
                n = np.arange(1, len(v) + 1)
                at = np.flatnonzero(v[1:] > v[:-1])
                at = at[(n[at] >= least) & (len(v) - n[at] >= least)]
                if len(at):
                    left, right = hit[at] / n[at], (hit[-1] - hit[at]) / (len(v) - n[at])
                    gain = whole - 2 * (left * (1 - left) * n[at] + right * (1 - right) * (len(v) - n[at]))
                    top = int(gain.argmax())
                    if gain[top] > best[0]:
                        best = (float(gain[top]), k, float((v[at[top]] + v[at[top] + 1]) / 2))
            if best[1] >= 0:
                low = x[:, best[1]] <= best[2]
                self.feature[node], self.cut[node] = best[1], best[2]
                self.below[node] = self._grow(x[low], y[low], depth - 1, least)
                self.above[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, below, above, value = map(np.array, (self.feature, self.cut, self.below, self.above, self.value))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            f = feature[at[rows]]
            low = x[rows, f] <= cut[at[rows]]
            at[rows] = np.where(low, below[at[rows]], above[at[rows]])
        return value[at]


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    return Tree(*labelled_blocks())


def extract(pages: list[str], tree: Tree) -> list[str]:
    """Main text of each page: kept blocks in page order, one a line."""
    found = [blocks(p) for p in pages]
    keep = tree.predict(np.concatenate([features(f) for f in found])) if found else []
    out, at = [], 0
    for f in found:
        out.append("\n".join(text for (text, _), k in zip(f, keep[at:at + len(f)]) if k))
        at += len(f)
    return out


def _extracted(tree: Tree):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = extract([p or "" for p in part.column(1).to_pylist()], tree)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])
    return run


def main_text(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Each row of ``pages`` (all columns but the markup) as a struct ``row``,
    with the main ``text`` of its whole page: blocks in page order, one a line,
    white space as single spaces, character references decoded.

    Null or empty markup, or a page without an article, gives an empty text.
    Rows are independent, so repeated rows, nulls and columns of any name pass
    through; an empty table gives no rows.
    """
    rest = [F.col(f"`{c}`") for c in pages.columns if c != markup]
    src = pages.select(F.struct(*rest).alias("row"), F.col(f"`{markup}`").cast("string").alias("_html"))
    return arrow_map(src, _extracted(trained_tree()), schema_with([src.schema["row"]], "text string"))
