"""Main text of HTML pages by two passes over text blocks.

Pass one decides each block by what it says: blocks that are mostly link text are boilerplate; long
blocks with many stop words are text; longer blocks without them, outside an article, are
boilerplate, and so are labels: runs of two and more short blocks without a stop word or closing
mark that are no headings, items or cells. The rest - short blocks, and longer ones of middling density - is
ambiguous. Structure counts as a feature of a block: an element that the main text does not include by
definition (menu, page header, footer, sidebar, form, advert, notice, reader comments, hidden parts)
makes its blocks boilerplate; one whose name only hints at that (related, share, menu and the like)
raises what a block must show, so that prose stays and labels go; an article lowers it.
Pass two gives an ambiguous block the label of its nearest decided neighbours: inside an article
(article, main, or an element that is named as one) the neighbours there alone count and a tie, or
none, is text; outside an article of a page that has one, both sides must be text; on a page
without one the nearer side decides, and a tie, or none, is text.

Stop-word densities are held against the page's densest longer block: where that has less than
STOP_HIGH, as in a language whose stop words are not listed, both limits shrink in proportion.

Character references are decoded, white space inside a block becomes one space, and blocks are
joined by one line feed in page order. Markup that is cut off, unclosed or wrongly nested is read
as far as it goes: only script, style and their like run to the end of the page without an end tag;
a head ends at the first thing that can't stand in one, and an unclosed button, svg or the like at
the next block or with its parent. Defined results: null and empty pages, and pages without text, give the empty
string; repeated pages are read each. Other columns pass through if asked for; a column text among
them is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from orbitweave.llm.common import arrow_map, free_of, texts_of

# Common words of each language that hardly stand in menus and labels.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this from have or by not but what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more her two like him see could no than been its now my made did get",
    "fr": "de la le et les des en un une du est que qui dans pour pas au sur par plus avec il elle ce cette son sa ses ne se sont mais ou nous vous ils leur aux été être avoir fait comme tout on dont même",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}
_stop = {w for words in STOP_WORDS.values() for w in words.split()}

#: Elements whose content is neither text nor markup: only their own end tag ends them.
RAW = "script style iframe textarea title".split()
#: Elements of markup whose text is never the page's; they stand in a line.
SKIP = set("head noscript template svg canvas select option button annotation annotation-xml".split())
#: What may stand in a head.
HEAD = set("base link meta noscript template".split())
#: Start tags that end an element of SKIP without an end tag.
BREAKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split())
#: Elements that hold what is not the article.
AROUND = set("nav footer aside form fieldset dialog menu".split())
ARTICLE = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
INLINE |= SKIP | set("object embed audio video source track param math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mfenced mover munder munderover mtable mtr mtd mlabeledtr mstyle mpadded mphantom menclose merror mspace mmultiscripts mprescripts none semantics maction".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in class or id that name what is not the article, and words that only hint at it.
NAMES = set("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion sidebar aside widget widgets cookie cookies consent gdpr notice notices notification comment comments commentlist disqus newsletter breadcrumb breadcrumbs nav navbar navigation pagination pager footer masthead".split())
HINTS = set("alert banner respond reply replies social share sharing related recommended subscribe subscription popup modal overlay menu toolbar skip login signup".split())
HEADER = {"header", "heading", "head"}
OWN = set("article entry post content main maincontent story body text page title".split())
#: Names that make an element an article if nothing else is said of it.
CONTAINERS = set("article entry post content main maincontent story".split())

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z" % "|".join(RAW),
    re.S | re.I,
)
_attribute = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_word = re.compile(r"[^\W\d_]+")
_skipped = re.compile("<(?:%s)(?![a-z0-9-])" % "|".join(SKIP), re.I)
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

LONG, SHORT, LABEL = 200, 70, 40
STOP_HIGH, STOP_LOW, LINKS = 0.3, 0.15, 0.5
#: Elements without a meaning of their own, in which short blocks can be labels.
LABELS_IN = set("div section center".split())
CLOSING = tuple(".,;:!?…。！？)]}\"'”»|")


class Block:
    __slots__ = ("text", "linked", "around", "hinted", "article", "element", "label")

    def __init__(self, text: str, linked: int, around: bool, hinted: bool, article: int, element: str):
        self.text, self.linked, self.around, self.hinted, self.article, self.element, self.label = text, linked, around, hinted, article, element, ""


def role_of(name: str, attrs: str, inside: bool) -> str:
    """'around' for an element that holds what is not the article, 'hinted' for one whose name hints at
    that, 'article' for one that holds it, else ''. inside: whether it stands in an article already."""
    if name in AROUND or name == "header" and not inside:
        return "around"
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attrs)} if attrs.strip() else {}
    if said:
        if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or _hidden.search(said.get("style", "")) or said.get("role", "").lower() in ROLES:
            return "around"
        if name not in ("html", "body"):
            words = {w.lower() for w in _parts.findall(f"{said.get('class', '')} {said.get('id', '')}")}
            if name not in ARTICLE and (words & NAMES or words & HEADER and not words & OWN and not inside and name not in INLINE):
                return "around"
            if name not in ARTICLE and words & HINTS:
                return "hinted"
            if words & CONTAINERS and words <= OWN and name not in INLINE and not name.startswith("h"):
                return "article"
            if said.get("role", "").lower() in ("main", "article") or said.get("itemprop", "") == "articleBody" or words & {"article", "entry", "post", "story"} and words & {"content", "body", "text"}:
                return "article"
    return "article" if name in ARTICLE else ""


def unclosed(tokens: list[re.Match]) -> set[int]:
    """Places of the start tags of SKIP that have no end tag."""
    opened: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        if (name := (m["name"] or "").lower()) in SKIP:
            if not m["end"]:
                opened.setdefault(name, []).append(i)
            elif opened.get(name):
                opened[name].pop()
    return {i for found in opened.values() for i in found}


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    tokens: Iterable[re.Match] = _token.finditer(html)
    stray: set[int] = set()
    if _skipped.search(html):
        tokens = list(tokens)
        stray = unclosed(tokens)
    pieces: list[str] = []
    open_elements: list[tuple[str, str]] = []
    around = hinted = article = links = n_articles = current = skipped = 0
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                element = next((n for n, _ in reversed(open_elements) if n not in INLINE), "")
                out.append(Block(text, linked, around > 0, hinted > 0, current if article else 0, element))
            pieces.clear()
        linked = 0

    def leave(role: str, name: str) -> None:
        nonlocal around, hinted, article, links, skipped
        skipped -= role in ("skip", "stray")
        around -= role == "around"
        hinted -= role == "hinted"
        article -= role == "article"
        links -= name == "a"

    def leave_from(k: int) -> None:
        for n, r in reversed(open_elements[k:]):
            leave(r, n)
        del open_elements[k:]

    def add(text: str) -> None:
        nonlocal linked
        if skipped and open_elements[-1][0] == "head" and text.strip():
            leave_from(len(open_elements) - 1)
        if text and not skipped:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    for i, m in enumerate(tokens):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if skipped and not m["end"]:
            if name in BREAKS and (found := [k for k, (_, r) in enumerate(open_elements) if r == "stray"]):
                leave_from(found[0])
            if skipped and open_elements[-1][0] == "head" and name not in HEAD:
                leave_from(len(open_elements) - 1)
        if skipped:
            pass
        elif name not in INLINE:
            end_block()
        elif name == "br":
            pieces.append(" ")
        if m["end"]:
            for k in range(len(open_elements) - 1, -1, -1):
                if open_elements[k][0] == name:
                    roles = {r for _, r in open_elements[k:]}
                    if roles & {"around", "hinted", "article"} or roles & {"skip", "stray"} and name not in INLINE:
                        end_block()
                    leave_from(k)
                    break
                if open_elements[k][1] in ("around", "hinted", "article") and name in INLINE | {"p", "li", "div"} and open_elements[k][0] not in INLINE:
                    break  # a stray end tag does not leave a menu or an article
        elif name not in VOID and not m["attrs"].endswith("/"):
            role = "" if skipped else ("stray" if i in stray and name != "head" else "skip") if name in SKIP else role_of(name, m["attrs"], article > 0)
            if role in ("around", "hinted", "article"):
                end_block()
            skipped += role in ("skip", "stray")
            open_elements.append((name, role))
            around += role == "around"
            hinted += role == "hinted"
            links += name == "a"
            if role == "article":
                if not article:
                    n_articles += 1
                    current = n_articles
                article += 1
            if name in ("p", "li", "td", "th", "dt", "dd", "option", "tr"):
                # such an element ends an open one of its kind
                for k in range(len(open_elements) - 2, -1, -1):
                    if open_elements[k][1] or open_elements[k][0] in ("ul", "ol", "table", "dl"):
                        break
                    if open_elements[k][0] == name:
                        leave(open_elements[k][1], name)
                        del open_elements[k]
                        break
    add(html[at:])
    end_block()
    return out


def density(block: Block) -> float:
    """The share of stop words."""
    words = _word.findall(block.text.lower())
    return sum(w in _stop for w in words) / max(1, len(words))


def is_label(block: Block) -> bool:
    """A short block that says nothing: no stop word, no closing mark, and no heading, paragraph, item
    or cell."""
    return len(block.text) < LABEL and block.element in LABELS_IN and not block.text.endswith(CLOSING) and not density(block)


def decide(block: Block, share: float, scale: float) -> str:
    """Pass one, of a block by itself: 'text', 'around', or '' for an ambiguous block. share: its
    stop-word density, 0 for a short one; scale: what both limits are multiplied by."""
    n, high, low = len(block.text), STOP_HIGH * scale, STOP_LOW * scale
    if block.linked > LINKS * n or block.around:
        return "around"
    if block.hinted:
        return "text" if n >= LONG and share >= high else "" if n >= SHORT and share >= low and block.article else "around"
    if n < SHORT:
        return "" if block.article or not block.linked else "around"
    if share >= high and (n >= LONG or block.article):
        return "text"
    if share >= low or block.article:
        return ""
    return "around"


def first_pass(found: list[Block]) -> None:
    """Labels all blocks that are decided by themselves, and runs of labels."""
    shares = [density(b) if len(b.text) >= SHORT and b.linked <= LINKS * len(b.text) and not b.around else 0.0 for b in found]
    scale = min(1.0, max(shares, default=0.0) / STOP_HIGH)
    for b, share in zip(found, shares, strict=True):
        b.label = decide(b, share, scale)
    labels = [not b.label and is_label(b) for b in found]
    for i, b in enumerate(found):
        if labels[i] and (i > 0 and labels[i - 1] or i + 1 < len(found) and labels[i + 1]):
            b.label = "around"


def nearest(found: list[Block], order: range) -> list[tuple[int, str] | None]:
    """For each block the place and label of the decided block last seen in that order: of the same
    article, or of the page for a block in none."""
    out: list[tuple[int, str] | None] = [None] * len(found)
    page: tuple[int, str] | None = None
    own: dict[int, tuple[int, str]] = {}
    for i in order:
        b = found[i]
        out[i] = own.get(b.article) if b.article else page
        if b.label:
            page = i, b.label
            if b.article and not b.around:
                own[b.article] = i, b.label
    return out


def inherited(i: int, b: Block, before: tuple[int, str] | None, after: tuple[int, str] | None, has_article: bool) -> str:
    """Pass two for one ambiguous block."""
    labels = [x[1] for x in (before, after) if x]
    if b.article:
        return "around" if labels == ["around", "around"] else "text"
    if has_article:
        return "text" if labels == ["text", "text"] else "around"
    if before and after and before[1] != after[1]:
        near = before if i - before[0] < after[0] - i else after if after[0] - i < i - before[0] else None
        return near[1] if near else "text"
    return labels[0] if labels else "text"


def second_pass(found: list[Block]) -> None:
    """Labels ambiguous blocks from their decided neighbours."""
    has_article = any(b.article for b in found)
    before, after = nearest(found, range(len(found))), nearest(found, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        b.label = b.label or inherited(i, b, before[i], after[i], has_article)


def main_text(html: str) -> str:
    found = blocks(html)
    first_pass(found)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "text")


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all but html) of pages with text. A column of pages of that name is not
    kept: the new one wins."""
    keep = free_of([c for c in pages.columns if c != html] if keep is None else keep, ["text"])
    at, at_kept = pages.columns.index(html), [pages.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at_kept), pa.array([main_text(h) for h in texts_of(batch.column(at))], pa.string())], names=[*keep, "text"])

    return arrow_map(pages, run, "".join(f"`{c}` {dict(pages.dtypes)[c]}, " for c in keep) + "text string")
