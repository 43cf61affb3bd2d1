"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by place (menus, footers, adverts, forms,
comments), link density, length and stop-word density; pass two lets undecided short blocks take the label of
the nearest decided blocks of their part of the page. Inside an article or main element a block is dropped
only for its links or its place, because texts without common words are articles as well.

Cases: null and empty pages give an empty text; unclosed and truncated tags end with the page; repeated rows
are repeated; other columns of the input are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import slices, tidy

#: Common words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so
    de la le et les des en un du une que est pour qui dans par sur pas au plus ce il se ne sont avec son cette ou mais comme on tout nous sa leur
    der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem
    el los las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre""".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that stay open until they are closed; paragraphs, list items and inline tags are often left open.
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header main menu nav ol section select table ul button".split())
#: Boilerplate that is often left unclosed, so an article inside it counts as outside.
SOFT_TAGS = frozenset("head header menu nav".split())
BOILER_TAGS = frozenset("aside button dialog fieldset footer form head menu nav select".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object canvas audio video".split())
BOILER_NAMES = re.compile(
    r"(?:^|\s|(?<!with)(?<!has)(?<!no)[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|disclaimer|"
    r"comments?|comment-?list|replies|disqus|respond|discussion|share|sharing|social|related|recommend\w*|popular|trending|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|widget|tags?|toc|copyright|legal|skip|hidden)(?:$|[\s_-])",
    re.I,
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<(?=[/A-Za-z])[^>]*\Z""", re.S)
LINK_OPEN, LINK_CLOSE = re.compile(r"<a[\s>]", re.I), re.compile(r"</a[\s>]", re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))""", re.I)

MAX_LINK_DENSITY, SHORT_CHARS, LONG_CHARS, STOPS_LOW, STOPS_HIGH = 0.4, 70, 200, 0.12, 0.25


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name in ("class", "id"):
            found = BOILER_NAMES.search(value)
            # an article's own header holds its title
            if found and not (in_article and "header" in found.group().lower()):
                return True
        elif name == "role" and value.lower() in BOILER_ROLES:
            return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, in boilerplate, article number or 0) of each block in page order."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    bad = soft = in_link = False
    article = articles = 0

    def close() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                links = "".join(linked)
                out.append((text, len(" ".join((html.unescape(links) if "&" in links else links).split())) if links else 0, bad, article))
            parts.clear()
            linked.clear()

    # a link that is closed before the next one opens holds the blocks inside it; one that is left open ends with its block
    opens, closes = ([m.start() for m in pattern.finditer(page)] for pattern in (LINK_OPEN, LINK_CLOSE))
    held = False
    at = 0
    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing, attributes = (m.group(1) or m.group(4)) == "/", m.group(3) or m.group(6) or ""
        if tag in RAW_TAGS and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = not closing
            if in_link:
                k, j = bisect_left(closes, at), bisect_left(opens, at)
                held = k < len(closes) and (j == len(opens) or closes[k] < opens[j])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS and tag not in CONTAINERS:
            if not closing and attributes and (tag in ("span", "label")) and _boilerplate(tag, attributes, bool(article)):
                stack.append((tag, bad, article))
                close()
                bad = True
            elif closing and stack and stack[-1][0] == tag:
                close()
                _, bad, article = stack.pop()
            continue
        close()
        in_link = in_link and held
        if tag not in CONTAINERS and not (tag in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6") and attributes):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, bad, article = stack[k]
                    del stack[k:]
                    break
            continue
        if tag not in CONTAINERS:
            continue
        stack.append((tag, bad, article))
        if tag in ("article", "main") and not article and (not bad or soft):
            articles += 1
            article, bad = articles, False
        if not bad and _boilerplate(tag, attributes, bool(article)):
            bad, soft = True, tag in SOFT_TAGS
    close()
    return out


def keep(found: list[tuple[str, int, bool, int]]) -> list[bool]:
    """Two passes: True for the blocks of the main text."""
    has_article = any(article and not bad for _, _, bad, article in found)
    labels: list[bool | None] = []
    for text, links, bad, article in found:
        n = len(text)
        label: bool | None = None
        if bad or links > MAX_LINK_DENSITY * n or (has_article and not article):
            label = False
        elif "©" in text and n < LONG_CHARS and not article:
            label = False
        else:
            words = text.lower().split()
            stops = sum(w in STOP_WORDS for w in words) / len(words)
            if n >= SHORT_CHARS and stops >= (STOPS_HIGH if n < LONG_CHARS else STOPS_LOW):
                label = True
            elif n >= LONG_CHARS and not article and stops < STOPS_LOW / 4 and links:
                label = False
        labels.append(label)
    decided = list(labels)
    last: dict[int, int] = {}
    before: list[int | None] = []
    for k, (_, _, _, article) in enumerate(found):
        before.append(last.get(article))
        if labels[k] is not None and not found[k][2]:
            last[article] = k
    last.clear()
    for k in range(len(found) - 1, -1, -1):
        article = found[k][3]
        if labels[k] is None:
            near = [(abs(k - j), not labels[j], labels[j]) for j in (before[k], last.get(article)) if j is not None]
            # nothing decided in this part of the page: it is text, since no rule speaks against it
            decided[k] = min(near)[2] if near else True
        elif not found[k][2]:
            last[article] = k
    return [bool(x) for x in decided]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, good in zip(found, keep(found), strict=True) if good)


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text in `into`; all other columns but `column` are kept."""
    out = pages.drop(column, into).withColumn(into, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                texts = [main_text(x) for x in part.column(column).to_pylist()]
                kept = [c for c in part.schema.names if c not in (column, into)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return pages.mapInArrow(tidy(run), out)


def op4_html_extraction(spark, sf_dir):
    from newsdesk.llm.tables import read

    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
