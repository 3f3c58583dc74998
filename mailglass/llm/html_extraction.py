"""HTML extraction: line-block distribution.

Markup goes; what block elements hold becomes lines. Menus, forms, adverts and the like leave blank lines, and so do lines
that are mostly links. Over the lines, a window's sum of text lengths is taken at each place. Where the sum rises over a
threshold the text surges, where it falls to nothing it dives, and what lies between belongs to the article.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mailglass.llm.common import append_columns

#: Lines in a window, and characters from which a window surges (or half of the page's largest window, if that is less).
WINDOW = 3
SURGE = 80

#: Elements whose text is never the article's, elements that end a line, void elements.
DROPPED = frozenset("head title nav footer aside form script style noscript template svg math iframe object canvas button select option textarea input label menu dialog audio video figure map".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tag may be missing: the next block ends them.
LOOSE = frozenset("p li dt dd td th tr option".split())
#: Words that mark what is not the article, in a class, id or role whose other parts only say where it is or what shape it has.
MARK = r"(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|widgets?|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|comments?|commentlist|replies|disqus|respond|pagination|pager|skip|toolbar|complementary|contentinfo|(?:site|page|top)[_-]?header)"
#: Where such an element is or whose it is; what shape it has.
WHERE = r"(?:site|page|top|bottom|left|right|main|primary|secondary|global|post|article|entry|user|users|reader|readers|visitor|guest|inline|sticky|floating|fixed|mobile|desktop|google|facebook|fb|wp|js|block|module|component|widget|mid|in)"
SHAPE = r"(?:inline|body|thread|tree|module|panel|overlay|layer|native|sticky|floating|fixed|mobile|desktop|responsive|placeholder|label|zone|region|row|col|column|count|holder|frame|space|spot|strip|card|teaser|hero|leaderboard|rectangle|skyscraper|mpu|prompt|cta|header|meta|main|v\d+)"
MARKS = re.compile(
    rf"(?:^|\s)(?:{WHERE}[_-]+)*{MARK}(?:[_-]+(?:{MARK}|\d+|wrap(?:per)?|container|box|block|list|area|section|inner|outer|top|bottom|left|right|links?|items?|icons?|buttons?|form|bar|title|content|posts?|articles?|stories|text|unit|slot|to|{SHAPE}))*(?:$|\s)",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*-)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


#: Articles with less than this share of the largest one's text are teasers; so are all, if so much more stands outside.
TEASER, OUTSIDE = 0.25, 3


@dataclass
class Line:
    text: str
    links: int  # characters inside links
    inside: bool  # of an article or main element
    article: int  # the number of the outermost article it stands in, 0 for none


def holders(tokens: list[re.Match]) -> set[int]:
    """The places of start tags whose elements hold an article or main element."""
    stacks: dict[str, list[tuple[int, int]]] = {}
    found, seen = set(), 0
    for m in tokens:
        close, tag = (m[2], m[3]) if m[3] else (m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if not close and tag in ("article", "main"):
            seen += 1
        elif not close and tag not in VOID and tag not in LOOSE:
            stacks.setdefault(tag, []).append((m.start(), seen))
        elif close and stacks.get(tag):
            at, before = stacks[tag].pop()
            if seen > before:
                found.add(at)
    return found | {at for opened in stacks.values() for at, before in opened if seen > before}


#: A reader's comment, which pages often mark up as an article inside the article.
COMMENT = re.compile(r"(?:^|\s)(?:div[_-]+)?(?:user[_-]+|reader[_-]+)?(?:comment|reply)(?:[_-]+(?:body|item|content|entry|text|\d+))*(?:$|\s)", re.I)


def is_dropped(tag: str, attrs: str, inside: bool, holds: bool, in_article: bool) -> bool:
    """inside: of an article or main element; holds: the element holds such a one, and so is no part to drop unless it stands in
    an article itself, as a list of comments does."""
    if tag in DROPPED and tag not in ("figure",):
        return True
    if tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    named = " ".join(next(filter(None, m), "") for m in _NAMED.findall(attrs))
    if tag == "article":
        return in_article and bool(COMMENT.search(named))
    if _HIDDEN.search(attrs):
        return True
    if tag not in BLOCKS or (holds and not in_article) or (inside and tag in HEADINGS):  # an element inside a line is part of its sentence
        return False
    return bool(MARKS.search(named) or (in_article and COMMENT.search(named)))


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; a dropped element leaves a blank one."""
    lines: list[Line] = []
    parts: list[str] = []
    links = depth = inside = article = at = number = 0
    skip, level = "", 0

    def flush() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, links, inside > 0, number if article else 0))
        parts, links = [], 0

    tokens = list(_TOKEN.finditer(page))
    holding = holders(tokens)
    for m in tokens:
        if not skip and m.start() > at:
            parts.append(piece := page[at : m.start()])
            links += len(piece.strip()) if depth else 0
        at = m.end()
        close, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if tag is None:
            continue
        tag = tag.lower()
        if skip:
            if close and tag == skip:
                level -= 1
            elif not close and tag == skip and tag not in LOOSE:
                level += 1
            elif skip in LOOSE and tag in BLOCKS and (tag in LOOSE or close):
                level = 0
            if level > 0 or (close and tag == skip):
                skip = skip if level > 0 else ""
                continue
            skip = ""
        if tag in BLOCKS:
            flush()
        if tag == "a":
            depth = 0 if close else 1
        elif tag in ("article", "main"):
            inside = max(0, inside + (-1 if close else 1))
            if tag == "article":
                number += not close and not article
                article = max(0, article + (-1 if close else 1))
        # An article counts as inside of itself by now.
        if not close and tag not in VOID and not attrs.endswith("/") and is_dropped(tag, attrs, inside > 0, m.start() in holding, article > (tag == "article")):
            if tag == "article":
                article, inside = article - 1, inside - 1
            flush()
            if lines and lines[-1].text:  # several dropped elements in a row are one gap
                lines.append(Line("", 0, inside > 0, number if article else 0))
            skip, level = tag, 1
    if not skip:
        parts.append(page[at:])
    flush()
    return lines


def without_teasers(lines: list[Line]) -> list[Line]:
    """The lines without those of small articles beside a large one. Where most text stands outside, no article is the page's."""
    size: dict[int, int] = {}
    for x in lines:
        size[x.article] = size.get(x.article, 0) + (len(x.text) if x.article or 10 * x.links < 7 * len(x.text) else 0)
    outside, most = size.pop(0, 0), max(size.values(), default=0)
    if not most or any(x.inside and x.text and not x.article for x in lines):
        return lines
    if outside > OUTSIDE * most:
        return [Line(x.text if not x.article else "", x.links, False, 0) for x in lines]
    return [x if not x.article or size[x.article] >= TEASER * most else Line("", 0, x.inside, 0) for x in lines]


def main_text(page: str) -> str:
    """The text of the page's articles (without one, of its main element), and what lies between the surges and dives of the
    other line blocks; a space between lines."""
    lines = without_teasers(lines_of(page))
    within = any(x.inside and x.text for x in lines)
    explicit = any(x.article and x.text for x in lines)
    kept = [x.text if (x.inside or not within) and (within or 10 * x.links < 7 * len(x.text)) else "" for x in lines]
    sizes = [len(t) for t in kept]
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    if not any(sums):
        return ""
    surge = min(SURGE, max(sums) / 2)
    out, on = [], False
    for x, t, s in zip(lines, kept, sums, strict=True):
        on = s >= surge or (on and s > 0)
        if t and (on or x.article or (x.inside and not explicit)):
            out.append(t)
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) of the main text of each whole page; one pass, no shuffle.

    Null and empty pages have an empty text. Repeated rows get equal results; columns called text or n_chars give way.
    """

    def work(texts: list[str]) -> list[pa.Array]:
        found = [main_text(t) for t in texts]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return append_columns(pages, html_col, work, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
