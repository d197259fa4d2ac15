"""Main text of web pages, by two passes of rules over their blocks.

A page is cut into blocks, runs of text between the tags that begin or end a
paragraph. The first pass decides blocks by what they stand in, their share of
link text, their length and their share of stop words. It leaves short blocks
and others without a clear sign open. The second pass gives an open block the label of the
nearest decided blocks before and after it.

Where a page names its article (``article``, else ``main``), blocks outside it are
dropped, and open blocks inside it fall only between two dropped ones.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.llm.common import renamed, slices

#: Blocks below this many characters are open.
LENGTH_LOW = 70
#: Blocks above this many characters with enough stop words are text.
LENGTH_HIGH = 200
#: Shares of stop words: below the first no text, from the second on text.
STOP_LOW, STOP_HIGH = 0.08, 0.16
#: Blocks with a higher share of link text are menus.
MAX_LINKS = 0.5

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a all also an and any are as at be but by can for from had has have he his if in is it its more no not of on one or our so that
    the their there they this to up was we were what which who will with you
    als am auch auf aus bei dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch
    nur oder sein sich sie sind um und von vor war wenn wie wird zu zum zur über
    au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous ou par pas plus pour que qui sa se ses son
    sur un une vous
    al como con del desde dos el entre era ese esta este fue hay las lo los me muy más nos o para pero por qué si sin sobre su sus
    también te tiene todo una uno y ya
    """.split()
)

# Element names of HTML.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FORMATTING = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s"}
FORMATTING |= {"samp", "small", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt"}
BLOCKS |= {"fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav"}
BLOCKS |= {"noscript", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "template"}
BLOCKS |= {"tfoot", "th", "thead", "tr", "ul"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "noscript", "template", "svg", "object", "audio", "video"}
ASIDE |= {"canvas", "map", "head", "search", "fieldset"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: An element ends where one of the same kind begins, unless one of the second set lies between.
ENDED_BY_NEXT = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ENDED_BY_NEXT |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Words of class and id names that mark what is not the article.
ASIDE_NAMES = frozenset(
    """
    ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent
    cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay
    pager pagination popup promo promotion promotions recommended related reply replies respond share sharing sidebar signup social
    sponsor sponsored subscribe subscription toolbar widget widgets
    """.split()
)
#: Before a marking word, these say that the element merely has such a part beside it.
BESIDE = {"has", "no", "with", "without"}

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_COMMENT_END = re.compile(r"--!?>")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Block(NamedTuple):
    text: str
    links: float  # share of its characters in links
    heading: bool
    paragraph: bool
    aside: bool  # stands in a part that is not the article
    container: int  # 2 in an article, 1 in the main part, else 0


class _Open(NamedTuple):
    name: str
    aside: bool
    header: bool
    container: int


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _marked(attributes: dict[str, str]) -> bool:
    """Whether a class or id name says that this is not the article."""
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for name in value.split():
            words = [w.lower() for w in _NAME_WORD.findall(name)]
            if any(w in ASIDE_NAMES and not (i and words[i - 1] in BESIDE) for i, w in enumerate(words)):
                return True
    return "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def blocks(page: str) -> list[Block]:
    """Blocks of a page in their order, white space made one space, character references decoded."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", False, False, 0)]
    counts: dict[str, int] = {}
    parts: list[str] = []
    link_from: int | None = None  # depth at which the current link began
    linked, total, breaks, kind = 0, 0, 0, ""

    def text(piece: str) -> None:
        nonlocal linked, total, breaks
        if stack[-1].aside and stack[-1].name not in BLOCKS and not (len(stack) > 1 and stack[-2].aside):
            return  # an aside inside a line
        piece = entities.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if not piece.isspace():
            breaks = 0
            size = len(piece)
            total += size
            linked += size if link_from is not None else 0

    def flush() -> None:
        nonlocal linked, total, breaks
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                at = stack[-1]
                heading = kind in HEADINGS
                aside = at.aside or (at.header and not (at.container and heading))
                out.append(Block(joined, linked / max(total, 1), heading, kind == "p", aside, at.container))
            parts.clear()
        linked = total = breaks = 0

    def pop_to(depth: int) -> None:
        nonlocal link_from
        for gone in stack[depth:]:
            counts[gone.name] -= 1
        del stack[depth:]
        if link_from is not None and link_from > len(stack):
            link_from = None

    def close(names: set[str], stops: set[str]) -> None:
        if not any(counts.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                return pop_to(depth)
            if stack[depth].name in stops:
                return

    at = 0
    while True:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        follows = page[begin + 1 : begin + 2]
        if not (follows.isascii() and (follows.isalpha() or follows in ("/", "!", "?")) and follows):
            text(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            text(page[at:begin])
        if page.startswith("<!--", begin):
            found = _COMMENT_END.search(page, begin + 2)
            if not found:
                break
            at = found.end()
            continue
        tag = _TAG.match(page, begin + 1)
        if not tag:  # a declaration, or a tag that the end of the page cuts
            end = page.find(">", begin)
            if end < 0 or follows.isalpha():
                break
            at = end + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name == "a":
                link_from = None
            if name in BLOCKS:
                flush()
            if name not in FORMATTING and counts.get(name):
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                pop_to(depth)
                kind = stack[-1].name
            continue
        if name in RAW:
            found = _RAW_END[name].search(page, at)
            if not found:
                break
            at = found.start()
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name in BLOCKS:
            flush()
            close({"p"}, {"td", "th", "button", "object"})
            if name in ENDED_BY_NEXT:
                close(*ENDED_BY_NEXT[name])
            kind = name
        attributes = _attributes(tag[3])
        if name == "a" and "href" in attributes:
            link_from = len(stack)
        if name in VOID or name in FORMATTING:
            continue
        up, role = stack[-1], attributes.get("role", "").lower()
        whole = name in ("html", "body", "main")
        aside = up.aside or name in ASIDE or role in ASIDE_ROLES or (not whole and name not in HEADINGS and _marked(attributes))
        part = 2 if name == "article" or attributes.get("itemprop") == "articleBody" else 1 if name == "main" or role == "main" else 0
        if part and not up.aside and up.header:
            up = up._replace(header=False)
        header = up.header or name == "header" or "header" in (w.lower() for w in _NAME_WORD.findall(attributes.get("class", "") + " " + attributes.get("id", "")))
        stack.append(_Open(name, aside, header and not whole, max(up.container, part)))
        counts[name] = counts.get(name, 0) + 1
    flush()
    return out


def _stop_share(text: str, stop_words: frozenset[str]) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in stop_words for w in words) / max(len(words), 1)


def _first_pass(found: list[Block], container: int, stop_words: frozenset[str]) -> list[bool | None]:
    """True for text, False for what is dropped, None for open blocks."""
    inside = [not b.aside and b.container >= container for b in found]
    shares = [_stop_share(b.text, stop_words) if ok else 0.0 for b, ok in zip(found, inside)]
    size = sum(len(b.text) for b, ok in zip(found, inside) if ok)
    # a language that the list does not hold: judge by length and links alone
    known = sum(s * len(b.text) for b, s in zip(found, shares)) >= STOP_LOW / 2 * size
    labels: list[bool | None] = []
    for b, ok, share in zip(found, inside, shares):
        if not ok:
            labels.append(False)
        elif b.heading:
            labels.append(None)
        elif b.links > MAX_LINKS or (not container and b.text.startswith("©")):
            labels.append(False)
        elif len(b.text) < LENGTH_LOW:
            labels.append(None)
        elif not known or share >= STOP_HIGH:
            labels.append(True if container or len(b.text) > LENGTH_HIGH or share >= STOP_HIGH else None)
        elif share >= STOP_LOW:
            labels.append(True if container else None)
        else:
            labels.append(None if container else False)
    return labels


def _second_pass(found: list[Block], labels: list[bool | None], container: int) -> list[bool]:
    n, edge = len(found), bool(container) or True not in labels  # a page of open blocks alone is text
    # inside an article, what is no part of it says nothing about the blocks beside it
    counts = [label is not None and not (edge and (b.aside or b.container < container)) for b, label in zip(found, labels)]
    before, after = [(0, edge)] * n, [(0, edge)] * n  # (distance, label)
    last = (-1, edge)
    for i in range(n):
        before[i] = (i - last[0], last[1])
        last = (i, labels[i]) if counts[i] else last
    last = (n, edge)
    for i in range(n - 1, -1, -1):
        after[i] = (last[0] - i, last[1])
        last = (i, labels[i]) if counts[i] else last
    out = []
    for b, label, (back, left), (ahead, right) in zip(found, labels, before, after):
        if label is not None:
            out.append(label)
        elif left == right:
            out.append(left)
        elif container:
            out.append(True)
        elif b.heading:
            out.append(right)
        else:
            out.append((left if back < ahead else right) if back != ahead else b.paragraph)
    return out


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """Text of the article of one page, a block a line."""
    found = blocks(page)
    container = max((b.container for b in found if not b.aside), default=0)
    labels = _second_pass(found, _first_pass(found, container, stop_words), container)
    return "\n".join(b.text for b, ok in zip(found, labels) if ok)


def _rows(batches, stop_words: frozenset[str]):
    for part in slices(batches, 0):
        texts = [main_text(page, stop_words) if page else "" for page in part.column(0).to_pylist()]
        columns = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """The columns ``keep`` of ``pages``, ``text`` (empty if there is none) and ``n_chars``, its code points.

    One row per row: repeated rows stay, whatever is null in them. A null page reads as an empty one. A page is
    taken whole. Kept columns may not be called ``text`` or ``n_chars``; other columns don't matter.
    """
    source, kept, names = renamed(pages, keep, ("text", "n_chars"), F.col(html).cast("string"))
    return source.mapInArrow(partial(_rows, stop_words=stop_words), f"{kept}text string, n_chars long").toDF(*names, "text", "n_chars")


__all__ = ["Block", "blocks", "extract", "main_text"]
