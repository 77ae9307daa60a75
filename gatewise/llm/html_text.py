"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with its path of tags from the root. For every distinct
path the text outside links, the punctuation and the number of blocks are summed. The
ratios of text and of punctuation to blocks are fused into one score of the path, which is
smoothed over the paths that come before and after it in the page and share its container,
and, anywhere inside the container of the heaviest path, with that path. It is then compared
with a share of the best score. The blocks of the paths above it are the article.

What a tag or a class says of an element (navigation, advert, comments ...) decides nothing:
it multiplies the scores of the paths below it, unless the heaviest path lies there too.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import by_value, map_texts, with_fields

by_value(__name__)

#: Comments and declarations; a tag, where a quote opens a value only right after "="; text; a lone "<".
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is no markup up to their own end tag.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose content is no text of a page.
_UNSEEN = {"head", "template", "object", "svg", "canvas", "select", "option", "optgroup", "datalist", "button", "audio", "video", "annotation", "annotation-xml"}
_OF_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "map",
}
_P_ENDS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dt", "dd", "td", "th", "tr",
}
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "select", "menu"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold running text; only such paths lend each other their score.
_PROSE = _HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "td", "th", "caption", "summary"}

#: Tags, roles and words of a class or id that speak against an element.
_BESIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_QUOTE = re.compile(r"(?:^|[^a-z])(?:pull-?)?quotes?(?:$|[^a-z])", re.I)
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|toolbar", re.I)
_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|adsense|adsbox|sponsor(?:ed|s)?|promo(?:tions?)?|banners?|nav|navbar|navigation|menus?|menubar|breadcrumbs?|"
    r"footer|sidebars?|aside|widgets?|comments?|commentlist|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletters?|"
    r"subscribe|subscription|signup|login|search|share|sharing|social|related|recommend(?:ed|ations?)?|recirc|toolbar|pagination|pager|taglist|copyright|disclaimer)"
    r"(?:$|[^a-z])",
    re.I,
)
_HEAD_WORDS = re.compile(r"(?:^|[^a-z])(?:header|masthead)(?:$|[^a-z])", re.I)
_ABOUT_OTHERS = re.compile(r"(?:^|\s)(?:no|not|has|with|without)[-_]\S*", re.I)
_SPACE = re.compile(r"\s+")
#: Punctuation of sentences; the dots of an address are none.
_PUNCTUATION = re.compile(r"[.,;:!?…]+(?=[\s\"'»”’)\]]|$)|[。，、；：！？]")

#: Share of the best score that a path needs.
SHARE = 0.25
#: Paths looked at on either side when scores are smoothed, and steps up to a common container.
WINDOW, REACH = 3, 3
#: What a score is multiplied by below an element with a word against it.
DOUBT = 0.02


class _Block:
    __slots__ = ("element", "linked", "parts", "path")

    def __init__(self, path: int, element: int):
        self.path, self.element, self.linked, self.parts = path, element, 0, []


class _Open:
    """An open element; inline ones share path and number of the element around them."""

    __slots__ = ("element", "framed", "path", "tag", "unseen")

    def __init__(self, tag: str, path: int, element: int, framed: bool, unseen: bool):
        self.tag, self.path, self.element, self.framed, self.unseen = tag, path, element, framed, unseen


class Page:
    """The blocks of a page, and its distinct paths as a tree (``parent`` of each, its last ``tag``, how it is ``doubted``).

    ``articles`` holds the path of every article element. ``element`` has the element of
    every block, and ``around`` the element around each, with its path.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.doubted = [-1], [""], [0]
        self.blocks: list[tuple[int, int, str]] = []
        self.articles: list[int] = []
        self.element: list[int] = []
        self.around: list[tuple[int, int]] = [(-1, 0)]
        self._numbers: dict[tuple[int, str, int], int] = {}
        self._read(page)

    def _path(self, parent: int, tag: str, names: str, doubted: int) -> int:
        key = (parent, f"{tag}.{names}", doubted)
        found = self._numbers.get(key)
        if found is None:
            found = self._numbers[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.doubted.append(doubted)
        return found

    def _read(self, page: str) -> None:
        stack = [_Open("", 0, 0, False, False)]
        opened: dict[str, int] = {}
        out: list[_Block] = []
        now: _Block | None = None
        unseen, at, end = 0, 0, len(page)

        def close(to: int) -> None:
            nonlocal now, unseen
            while len(stack) > to:
                gone = stack.pop()
                opened[gone.tag] -= 1
                unseen -= gone.unseen
                if gone.tag not in _INLINE and not opened.get("math"):
                    now = None

        def close_up_to(tags: set[str], stop) -> None:
            """Close the innermost open element of ``tags`` with what is in it, unless ``stop`` comes first."""
            if not any(opened.get(t) for t in tags):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    close(i)
                    return
                if stop(stack[i].tag):
                    return

        while at < end:
            m = _TOKEN.match(page, at)
            at = m.end()
            name = m.group(2)
            if not name:
                text = m.group()
                if unseen or text[0] == "<" and len(text) > 1:
                    continue
                if now is None:
                    if text.isspace():
                        continue
                    now = _Block(stack[-1].path, stack[-1].element)
                    out.append(now)
                text = html.unescape(text)
                now.parts.append(text)
                if opened.get("a"):
                    now.linked += len(text.strip())
                continue
            tag = name.lower()
            if m.group(1):
                if tag in ("p", "br"):
                    now = None
                close_up_to({tag}, lambda t: False)
                continue
            if opened.get("head") and tag not in _OF_HEAD:
                close_up_to({"head"}, lambda t: False)
            if tag in _P_ENDS:
                close_up_to({"p"}, lambda t: t not in _INLINE)  # an open paragraph ends here
                now = None
            if tag in _SAME_ENDS:
                close_up_to(_SAME_ENDS[tag], lambda t: t in _SCOPES)
            if tag in ("br", "hr"):
                now = None
                continue
            if tag == "plaintext" or tag in _VOID or tag in ("svg", "math") and m.group(3).endswith("/"):
                continue
            if tag in _RAW:
                over = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else end
                continue
            around = stack[-1]
            attributes = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
            unseen_here = tag in _UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
            if tag in _INLINE or opened.get("math"):
                stack.append(_Open(tag, around.path, around.element, around.framed, unseen_here))
            else:
                now = None
                framed = around.framed or tag in ("article", "main", "section")
                names = " ".join(sorted(c for c in attributes.get("class", "").split() if not any(x.isdigit() for x in c)))
                path = self._path(around.path, tag, names, _doubted(tag, attributes, around.framed))
                stack.append(_Open(tag, path, len(self.around), framed, unseen_here))
                self.around.append((around.element, path))
                if tag == "article":
                    self.articles.append(path)
            opened[tag] = opened.get(tag, 0) + 1
            unseen += unseen_here
        for block in out:
            text = _SPACE.sub(" ", "".join(block.parts)).strip()
            if text:
                self.blocks.append((block.path, min(block.linked, len(text)), text))
                self.element.append(block.element)


#: How an element can be doubted: by a word of its class or id, or by its tag or role.
_BY_WORD, _BY_TAG = 1, 2


def _doubted(tag: str, attributes: dict[str, str], framed: bool) -> int:
    """What speaks against an element, 0 if nothing does: ``_BY_TAG`` or ``_BY_WORD``.

    Inside an article a header and a noscript are nothing special, and an aside whose class
    calls it a quote belongs to the text anywhere.
    """
    names = attributes.get("class", "")
    if tag == "aside" and _QUOTE.search(names):
        return 0
    if tag in _BESIDE or tag in ("header", "noscript") and not framed or _ROLE.search(attributes.get("role", "")):
        return _BY_TAG
    if tag in _HEADINGS or tag in ("html", "body", "article", "main"):
        return 0
    named = _ABOUT_OTHERS.sub(" ", f"{names} {attributes.get('id', '')}")
    return _BY_WORD if _WORDS.search(named) or not framed and _HEAD_WORDS.search(named) else 0


def _container(page: Page, path: int) -> int:
    """The outermost article around ``path``, else the outermost main, else its parent without sections; 0 if that is the page itself."""
    around, p = [], page.parent[path]
    while p > 0:
        around.append(p)
        p = page.parent[p]
    for tag in ("article", "main"):
        found = [p for p in around if page.tag[p] == tag]
        if found:
            return found[-1]
    plain = [p for p in around if page.tag[p] not in ("html", "body")]
    return next((p for p in plain if page.tag[p] != "section"), plain[-1] if plain else 0)


def _kinship(page: Page, a: int, b: int) -> float:
    """1 / steps to the common container of two paths of running text, one of which lies right in it; else 0."""
    if page.tag[a] not in _PROSE or page.tag[b] not in _PROSE:
        return 0.0
    for near, far in ((a, b), (b, a)):
        home, up = page.parent[near], far
        for steps in range(1, REACH + 1):
            up = page.parent[up]
            if up < 0:
                break
            if up == home:
                return 1 / steps
    return 0.0


def path_scores(page: Page, window: int = WINDOW, doubt: float = DOUBT) -> tuple[dict[int, float], list[float]]:
    """The fused and smoothed score of every path that holds text, in page order, and the score of every block.

    Of a path with n blocks, c characters outside links and p punctuation marks the ratios
    fuse to ``c/n * (1 + log(1 + p/n)) * sqrt(c)``; 0 if more than half of its text is links. Smoothing
    takes the mean with the paths up to ``window`` before and after, weighted by kinship, and
    never lowers a score. ``doubt`` multiplies scores of doubted paths; doubts about elements
    around the heaviest path (most text, after ``doubt``) are void, and so are words against
    what is around the only article element of a page. A block has the score of its path. In
    the element that contains most of the heaviest path it has at least the mean of the ratio
    of its path and of the heaviest one, so headings, tables, lists and short sections stay
    with their text, at any depth.
    """
    order: dict[int, int] = {}
    for path, _, _ in page.blocks:
        order.setdefault(path, len(order))
    plain, points, linked, count = (np.zeros(len(order)) for _ in range(4))
    for path, in_links, text in page.blocks:
        i = order[path]
        plain[i] += len(text) - in_links
        points[i] += len(_PUNCTUATION.findall(text))
        linked[i] += in_links
        count[i] += 1
    prose = linked <= plain
    ratio = np.where(prose, plain / count * (1 + np.log1p(points / count)) * np.sqrt(plain), 0.0)
    paths = list(order)
    score = ratio.copy()
    for i, a in enumerate(paths):
        total, weight = ratio[i], 1.0
        for j in range(max(0, i - window), min(len(paths), i + window + 1)):
            if j != i and prose[i] and (k := _kinship(page, a, paths[j])):
                total += k * ratio[j]
                weight += k
        score[i] = max(ratio[i], total / weight)
    own = list(page.doubted)
    if len(page.articles) == 1:
        p = page.parent[page.articles[0]]
        while p > 0:
            own[p] = 0 if own[p] == _BY_WORD else own[p]
            p = page.parent[p]

    def doubted() -> np.ndarray:
        below = [bool(x) for x in own]
        for p in range(1, len(below)):  # a parent has the smaller number
            below[p] |= below[page.parent[p]]
        return np.where([below[p] for p in paths], doubt, 1.0)

    if not paths:
        return {}, []
    heaviest = int(np.argmax(plain * prose * doubted()))
    p, home = paths[heaviest], _container(page, paths[heaviest])
    while p > 0:
        own[p] = 0
        p = page.parent[p]
    factor = doubted()
    score, shared = score * factor, np.where(prose, (ratio + ratio[heaviest]) / 2, 0.0) * factor
    each = [score[order[path]] for path, _, _ in page.blocks]
    if home:
        below = _elements_inside(page, home, paths[heaviest])
        each = [max(x, shared[order[path]]) if below[e] else x for x, (path, _, _), e in zip(each, page.blocks, page.element, strict=True)]
    return dict(zip(paths, score.tolist(), strict=True)), [float(x) for x in each]


def _elements_inside(page: Page, home: int, heaviest: int) -> list[bool]:
    """Whether each element lies in the one of path ``home`` that holds most text of the path ``heaviest``."""
    held = [-1] * len(page.around)  # the element of path ``home`` around each
    for e in range(1, len(held)):
        parent, path = page.around[e]
        held[e] = e if path == home else held[parent]
    weight: dict[int, int] = {}
    for (path, linked, text), e in zip(page.blocks, page.element, strict=True):
        if path == heaviest:
            weight[held[e]] = weight.get(held[e], 0) + len(text) - linked
    most = max(weight, key=lambda e: (weight[e], -e))
    return [h == most and most >= 0 for h in held]


def main_text(page: str | None, share: float = SHARE, window: int = WINDOW, doubt: float = DOUBT) -> str:
    """The article of ``page``, its blocks joined by an empty line; "" if there is none. A ``br`` ends a block as a paragraph does."""
    read = Page(page or "")
    _, scores = path_scores(read, window, doubt)
    least = share * max(scores, default=0.0)
    return "\n\n".join(text for (_, _, text), score in zip(read.blocks, scores, strict=True) if score >= least and score > 0)


def extract(pages: DataFrame, html_col: str = "html", share: float = SHARE) -> DataFrame:
    """``pages`` with ``text``, the main text of each page, and ``n_chars``, its code points.

    Null and empty pages, and pages without text outside links, give an empty text. Input
    columns of these names give way, others pass unchanged; repeated rows stay as they are,
    and an empty table gives an empty one. A formula (math) is part of its sentence, graphics
    (svg) and fallbacks of embedded objects are no text, an aside is a sidebar unless its
    class calls it a quote, and a noscript counts inside an article only.
    """
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def make():
        def step(texts, batch):
            out = [main_text(t, share) for t in texts]
            return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}

        return step

    return map_texts(pages, html_col, with_fields(pages.schema, new), make)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
