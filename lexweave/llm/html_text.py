"""Main text of web pages by two-pass block rules.

The first pass classifies each block by stop-word density, length and link density; what a page itself marks
as menu, notice, form and the like is no main text, unless it holds most of the running text. The second
pass gives blocks that the first left open the label of their nearest decided neighbours, where standing
in the article, or outside it, counts as a neighbour's word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexweave.llm._common import map_rows

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that
    the their they this to was we were which who will with you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im
    in ist mit nach nicht oder sich sie sind so über um und von war wie wir zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus
    pour que qui sa se ses son sont sur un une vous
    al como con de del el en es esta este fue ha la las lo los más me no para pero por que se sin su sus un
    una y ya""".split()
)
# Elements of HTML.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search
    section summary table tbody td tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page; it is skipped unread up to the end tag.
RAW_TAGS = frozenset("script style noscript template iframe object svg textarea select title noembed noframes".split())
#: Elements that are boilerplate wherever they stand.
OUTER_TAGS = frozenset("nav footer aside form menu dialog button search head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role attributes that mark boilerplate.
OUTER_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertising advertorial alert alerts banner banners breadcrumb
    breadcrumbs byline comment comments commentary consent contentinfo cookie cookies copyright disclaimer discussion disqus
    dialog footer footnav gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices
    notification overlay pager pagination paywall popup privacy promo promotion promoted related recommended replies respond
    search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar
    tracking widget complementary""".split()
)
#: Words that may stand beside those in one name, as in ``sidebar-left``; any other makes the name another thing's.
PLAIN_WORDS = frozenset(
    """area bar block bottom box center column container content div first footer global group header inner item items
    last left link links list main outer page panel post reader right row section site slot sub text top unit user
    view wrap wrapper zone""".split()
)
#: Share of stop words from which a block is running text, or may be.
STOP_HIGH, STOP_LOW = 0.30, 0.15
#: Characters up to which a block is short, and from which running text is decided.
SHORT, LONG = 70, 140
#: Share of characters in links from which a block is boilerplate.
LINKS = 0.35
#: Share of a page's running text from which an element holds most of it.
MOST = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?([A-Za-z][^\s/>]*)([^>]*)>"  # a quote that is never closed
    r"|</?[A-Za-z][^>]*\Z|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    #: Share of its characters that stand in links.
    linked: float
    #: Numbers of the elements around it that are marked as boilerplate (by their tag: below 0); in the article.
    marks: tuple[int, ...]
    article: bool
    #: The element it stands in.
    tag: str
    #: Share of stop words among its words.
    stops: float = 0.0
    label: str = ""

    def __post_init__(self):
        words = WORD.findall(self.text.lower())
        self.stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _names_boilerplate(value: str) -> bool:
    """Whether one of the names in an attribute is a boilerplate word, alone or beside plain ones."""
    for name in value.split():
        words = [w.lower() for w in NAME.findall(name) if not w.isdigit()]
        if not OUTER_WORDS.isdisjoint(words) and all(w in OUTER_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether attributes mark boilerplate, and whether they mark the article."""
    outer = article = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            outer = True
        elif name == "itemprop" or name == "role":
            article |= value.lower() in ("articlebody", "main", "article")
        outer |= _names_boilerplate(value)
    return outer, article


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order. Unclosed elements end where an element around them ends, links where a block does."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []  # tag, marked elements around, in the article
    parts: list[str] = []
    linked = breaks = marked_so_far = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, breaks
        text = SPACES.sub(" ", unescape("".join(parts))).strip()
        if text:
            tag, marks, article = next((x for x in reversed(stack) if x[0] in BLOCK_TAGS), ("", (), False))
            out.append(Block(text, min(1.0, linked / len(text)), marks, article, tag))
        parts.clear()
        linked = breaks = 0

    at = 0
    while (m := TOKEN.match(html, at)) is not None:
        at = m.end()
        tag = m[1] or m[3]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
            if in_link:
                linked += len(SPACES.sub(" ", piece).strip())
            continue
        tag, closing, attributes = tag.lower(), m[0][1] == "/", m[2] or m[4] or ""
        if tag in RAW_TAGS:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            in_link = False
        if tag == "a":
            in_link = not closing
        if tag in VOID_TAGS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        _, marks, article = stack[-1] if stack else ("", (), False)
        marked, main = _marks(attributes) if attributes else (False, False)
        if tag in ("article", "main") or main:
            if not article:
                marks = ()  # an article ends a menu or header that was left open
            article = True
        firm = tag in OUTER_TAGS and tag != "form" or tag == "header" and not article
        if firm or (marked or tag == "form") and tag not in ("html", "body"):
            marked_so_far += 1
            marks = (*marks, -marked_so_far if firm else marked_so_far)
        stack.append((tag, marks, article))
        if not attributes.endswith("/") or tag in BLOCK_TAGS:
            continue
        stack.pop()
    flush()
    return out


def by_text(b: Block) -> str:
    """The first pass, from the block alone: good, bad, or open as near (running text, perhaps) or short."""
    if b.linked > LINKS:
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.linked else "short"
    if b.stops >= STOP_HIGH and len(b.text) >= LONG:
        return "good"
    return "near" if b.stops >= STOP_LOW else "sparse"


def classify(found: list[Block]) -> list[Block]:
    """Labels the blocks good or bad, in two passes.

    An element that a class or a form marks is no boilerplate if it holds most of the page's running text,
    and more text than an article without marks. Where neighbours differ and are as near, the one in the same kind of element
    counts, a heading goes with what follows, and else running text is good, other text bad.
    """
    for b in found:
        b.label = by_text(b)
    held: dict[int, int] = {}
    for b in found:
        if b.label in ("good", "near"):
            for mark in b.marks:
                held[mark] = held.get(mark, 0) + len(b.text)
    least = max(MOST * sum(len(b.text) for b in found if b.label in ("good", "near")), sum(len(b.text) for b in found if b.article and not b.marks and b.label != "bad"))
    pardoned = {mark for mark, n in held.items() if mark > 0 and n > least and n >= LONG}
    outer = [not pardoned.issuperset(b.marks) for b in found]
    running = [b for b, out in zip(found, outer, strict=True) if not out and b.label in ("good", "near")]
    # an article that holds most of the running text has a say on what the first pass left open, and on what stands outside
    speaks = 2 * sum(len(b.text) for b in running if b.article) >= sum(len(b.text) for b in running) and any(b.article for b in found)
    for b, out in zip(found, outer, strict=True):
        if out or speaks and not b.article:
            b.label = "bad"
        elif speaks and b.label != "bad":
            b.label = "good"
    for wanted in (("near",), ("short", "sparse")):
        # running text doesn't take after menus and notices, which the page itself tells apart from it
        decided = [k for k, b in enumerate(found) if b.label in ("good", "bad") and not (outer[k] and wanted == ("near",))]
        labels: dict[int, str] = {}
        for k, b in enumerate(found):
            if b.label not in wanted:
                continue
            at = bisect_left(decided, k)
            sides = [decided[x] for x in (at - 1, at) if 0 <= x < len(decided)]
            near = {found[d].label for d in sides}
            if len(near) == 1:
                labels[k] = near.pop()
            elif not near:
                labels[k] = "good" if b.label == "near" else "bad"
            elif b.tag in HEADINGS:
                labels[k] = found[sides[1]].label
            elif k - sides[0] != sides[1] - k:
                labels[k] = found[min(sides, key=lambda d: abs(d - k))].label
            else:
                alike = [d for d in sides if found[d].tag == b.tag]
                labels[k] = found[alike[0]].label if len(alike) == 1 else "good" if b.label == "near" else "bad"
        for k, label in labels.items():
            found[k].label = label
    return found


def extract(html: str | None) -> str:
    """The main text: good blocks in page order, one in a line."""
    return "\n".join(b.text for b in classify(blocks(html or "")) if b.label == "good")


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; null html and pages without main text give the empty text."""
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField(url_col, df.schema[url_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def each(rows: dict[str, list]) -> dict[str, list]:
        texts = [extract(h) for h in rows[html_col]]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(df.select(id_col, url_col, html_col), schema, each)
