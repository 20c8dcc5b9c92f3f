"""Main text of html pages by tree scoring: paragraphs give points to the elements around them, the best container and siblings are kept.

What is no article by its kind goes first: menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles,
reader comments, and hidden elements; by tag, role, and the words of class and id. Every paragraph that is left (a block's own text)
passes 1 point for each ``CHARS`` characters and each comma, and 1 for itself, to its container, half of that to the next one outwards,
and so on. An element that says that it holds the article counts more; where a page has article or main elements, the best is one of them or
stands in one. Points are discounted by the share of linked text; the container
of most points is the best, of equal ones the outermost first. Its siblings of at least ``SIBLING`` of its points are kept, and so are headings and
long paragraphs without many links beside it; beside an article or main element, only its like and headings. Inside, lists that are links for the greater part go.

The text: character references decoded once, white space (any by Unicode) inside a block one space, blocks joined by one space in page
order; nothing else is left out or cut.

Defined results: null or empty html, and pages without text, give an empty text; repeated rows are rows of their own, null ids and urls
stay; an empty table gives no rows; extra columns are ignored. A page is held by one task; all else streams.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.html import BLOCK, Node, parse

#: Characters worth a point; the share of the best's points that keeps a sibling; characters of a long paragraph; shares of linked text of menus.
CHARS, SIBLING, LONG, LINKED, LINKS = 100, 0.2, 80, 0.5, 3
#: How much points count in elements that name the article.
ARTICLE, NAMED = 3.0, 1.5
#: Points an article has before any paragraph.
BASE = 1.0

_TAGS = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input fieldset iframe object embed"
    " svg math canvas audio video map dialog menu datalist noframes xmp noembed".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist status".split())
#: Words of classes and ids that name what is no article, and starts of such words.
_WORDS = frozenset(
    "ad ads advert adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe subscription signup share sharing social sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs pager"
    " pagination footer header masthead topbar toolbar comment comments replies reply respond disqus related recommended recommendations widget login"
    " search skip copyright disclaimer teaser teasers outbrain taboola paywall hidden feedback".split()
)
#: Those of lists that may hold article elements of their own.
_LISTS = frozenset("reply replies respond disqus related recommended recommendations teaser teasers ad ads sponsored outbrain taboola".split())
_STARTS = ("comment", "sidebar", "footer", "advert", "breadcrumb", "cookie", "newsletter", "sponsor", "navigation", "navbar")
_ARTICLE_WORDS = frozenset("article content post entry story main text body".split())
_NOT = frozenset("no has with without".split())
_WORD = re.compile(r"[a-z]+")
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMA = re.compile("[,،、，]")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _words(node: Node, named: dict[str, str]) -> list[str]:
    """Words of class and id, without those that a class like has-sidebar only mentions."""
    out: list[str] = []
    for name in f"{named.get('class', '')} {named.get('id', '')}".split():
        words = _WORD.findall(_CAPITAL.sub("-", name).lower())
        if not _NOT.intersection(words):
            out += words
    return out


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    return any(isinstance(x, Node) and x.tag in tags for x, entering in node.walk() if entering and x is not node)


def _is_article(node: Node, inside: bool) -> bool:
    """Whether an element may hold the article: not what its tag, role, class, id or style say is something else. inside: of an article or main element."""
    if node.tag in _TAGS:
        return False
    if not node.written:
        return node.tag != "header" or inside
    named = node.attributes()
    style = named.get("style", "").replace(" ", "").lower()
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return False
    if named.get("role", "").lower() in _ROLES or node.tag == "header" and not inside:
        return False
    if node.tag in ("html", "body", "main"):
        return True
    words = _words(node, named)
    if inside and node.tag in ("header", *_HEADINGS):
        words = [w for w in words if w != "header"]
    if any(w in _LISTS or w.startswith(_STARTS) for w in words):
        return node.tag != "article" and _holds(node, ("main",))
    return not _WORDS.intersection(words) or node.tag != "article" and _holds(node, ("article", "main"))


class _Facts:
    """What scoring gathers of one element: text and linked text in characters, links, and points."""

    __slots__ = ("chars", "linked", "links", "points", "own", "commas")

    def __init__(self):
        self.chars = self.linked = self.links = self.commas = self.own = 0
        self.points = 0.0

    def score(self) -> float:
        return self.points * (1 - self.linked / self.chars) if self.chars else self.points


def _prune(root: Node) -> None:
    """Take out all that is no article, in place."""
    inside = 0
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        step = node.tag in ("article", "main")
        if not entering:
            inside -= step
            continue
        inside += step
        node.parts = [x for x in node.parts if isinstance(x, str) or _is_article(x, inside > 0)]
        stack.append((node, False))
        stack.extend((x, True) for x in reversed(node.parts) if isinstance(x, Node))


def _weight(node: Node) -> float:
    if node.tag in ("article", "main"):
        return ARTICLE
    if node.written and _ARTICLE_WORDS.intersection(_words(node, named := node.attributes())) or "articleBody" in node.written:
        return NAMED
    return 1.0


def _score(root: Node) -> dict[Node, _Facts]:
    """Facts of every block, from the innermost outwards. A block's own text is a paragraph; points halve from container to container."""
    facts: dict[Node, _Facts] = {}
    blocks: list[Node] = []
    passed: list[float] = []
    links = 0
    for part, entering in root.walk():
        if isinstance(part, str):
            own = facts[blocks[-1]]
            n = len(" ".join(part.split()))
            own.own += n
            own.commas += len(_COMMA.findall(part)) if not links else 0
            own.linked += n if links else 0
        elif part.tag == "a":
            links += 1 if entering else -1
            facts[blocks[-1]].links += entering
        elif part.tag in BLOCK or part is root:
            if entering:
                facts[part] = _Facts()
                blocks.append(part)
                passed.append(BASE if part.tag in ("article", "main") else 0.0)
                continue
            mine, points = facts[blocks.pop()], passed.pop()
            mine.chars += mine.own
            plain = mine.own - min(mine.linked, mine.own)
            gives = 1 + mine.commas + plain / CHARS if plain and part.tag not in _HEADINGS else 0.0
            mine.points = points * _weight(part)
            if blocks:
                outer = facts[blocks[-1]]
                outer.chars += mine.chars
                outer.linked += mine.linked
                outer.links += mine.links
                passed[-1] += gives + points / 2
            if part.tag not in ("p", *_HEADINGS) and gives:
                # text that stands in a container without a paragraph of its own
                mine.points += gives * _weight(part)
    return facts


def _within_articles(root: Node, facts: dict[Node, _Facts]) -> list[Node]:
    """Blocks in and of the articles and main elements of a page, or all its blocks if it has none."""
    out, inside = [], 0
    for part, entering in root.walk():
        if isinstance(part, Node):
            inside += (part.tag in ("article", "main")) * (1 if entering else -1)
            if entering and part in facts and (inside or part.tag in ("article", "main")):
                out.append(part)
    return out or list(facts)


def _chosen(root: Node, facts: dict[Node, _Facts]) -> list[Node]:
    """The best container and what is kept beside it, in page order."""
    containers = [x for x in _within_articles(root, facts) if x.tag not in ("p", *_HEADINGS) and facts[x].points > 0]
    if not containers:
        return [root]
    best = max(containers, key=lambda x: facts[x].score())  # of equal ones the first, which is the outermost
    if best.parent is None:
        return [best]
    least = SIBLING * facts[best].score()

    def kept(x: Node | str) -> bool:
        if x is best or not isinstance(x, Node) or x not in facts:
            return x is best
        f = facts[x]
        share = f.linked / f.chars if f.chars else 1.0
        if x.tag in ("h1", "h2"):
            return share < LINKED
        if best.tag in ("article", "main") and x.tag not in ("article", "main"):
            return False
        if x.tag == "p":
            return f.chars >= LONG and share < LINKED / 2
        return f.points > 0 and f.score() >= least

    return [x for x in best.parent.parts if kept(x)]


def main_text(html: str | None) -> str:
    """The article of a page as one line of text."""
    root = parse(html)
    _prune(root)
    facts = _score(root)

    def keep(node: Node) -> bool:
        f = facts.get(node)
        menu = f is not None and node.tag in ("ul", "ol", "dl", "div", "section", "table") and f.links >= LINKS and f.linked > LINKED * f.chars
        return not menu or f.chars - f.linked >= LONG

    texts = (x.text(keep) for x in _chosen(root, facts))
    return " ".join(x for x in texts if x)


@F.pandas_udf(StringType())
def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


#: The same for pages whose article is one element of that name, without markup but paragraphs, headings, line ends and bold text.
ORACLE_SQL = r"""
    WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
    d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
    SELECT page_id, url, text, length(text) AS n_chars FROM d"""


def main_texts(pages: DataFrame, *columns: str, html: str = "html") -> DataFrame:
    """The columns named, text and n_chars (code points) of each page."""
    text = _main_texts(F.col(html).cast("string"))
    return pages.select(*columns, text.alias("text")).select(*columns, "text", F.length("text").cast("long").alias("n_chars"))
