"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf tag path.
Per path the lengths and the punctuation of its blocks are summed and divided by
their number; the two ratios are smoothed along the page, fused by multiplication and
cut at a threshold.  Blocks on surviving paths vote for the element that holds
them; the main text is all blocks inside the elements so chosen.  Elements that
never hold main text (navigation, footers, forms, scripts, adverts, comments and
so on, by tag, role or class) are cut away first; a class or id cuts nothing if the
elements of that name hold most of the page's unlinked text and no article or main
element with text stands beside them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Gaussian smoothing of the path ratios, in blocks, and the share of the highest that survives.
SIGMA = 1.0
KEEP = 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLANK = re.compile(r"[\s ]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br", "picture", "source",
}
EXCLUDED = {
    "head", "title", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "label", "fieldset",
    "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "menu", "dialog", "xmp", "noembed", "noframes",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
_UNWANTED = re.compile(
    r"^(?:ads?|adv|advert\w*|advertis\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|side|sidebars?|rail|widgets?|foot|footers?|head|headers?|masthead|"
    r"topbar|toolbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|register|search|share|sharing|social|follow|related|recommended|"
    r"recommendations|trending|popular|comments?|commentlist|respond|replies|reply|disqus|discussion|copyright|legal|disclaimer|tags|skip|hidden|print|byline|aside|form)$"
)
# Names that count at any place of a class or id, and words before a name that take its meaning away.
_ADVERT = re.compile(r"^(?:ads?|adv|advert\w*|advertis\w*|adsense|sponsor\w*|cookies?|gdpr)$")
_DENIED = {"no", "non", "not", "has", "have", "with", "without"}
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
# An opening tag ends an open element of the second set.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in ("p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "hr", "fieldset", "address", "details")},
}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "nav", "header", "footer", "aside", "form", "blockquote", "td", "th", "details", "figure"}


@dataclass
class _Element:
    name: str
    label: str
    number: int
    out: bool
    cut: str = ""


@dataclass
class Block:
    """A run of text between block borders, with the element path around it."""

    path: tuple[str, ...]
    elements: tuple[int, ...]
    text: str
    linked: int
    cuts: frozenset[str] = frozenset()


def _bad_name(value: str) -> bool:
    """Whether a class or id ends in an unwanted word, or is an advert's, with no word before that denies it."""
    ws = [w.lower() for w in _PARTS.split(value) if w]
    while len(ws) > 1 and ws[-1].isdigit():
        ws.pop()
    if not ws or _DENIED.intersection(ws[:-1]):
        return False
    return bool(_UNWANTED.match(ws[-1])) or any(_ADVERT.match(w) for w in ws)


def _unwanted(name: str, tag: str) -> tuple[bool, str, str]:
    """Whether an element is cut away whatever it holds, the class or id that speaks against it, and its label in paths."""
    if name in EXCLUDED:
        return True, "", name
    label, cut = name, ""
    for key, a, b, c in _MARK.findall(tag[len(name) + 1 :]):
        value = (a or b or c).strip()
        key = key.lower()
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, "", label
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, "", label
        if key in ("class", "id"):
            if name not in ("html", "body", "article", "main"):
                cut = cut or next((f"{name}.{w}" for w in value.split() if _bad_name(w)), "")
            if key == "class" and value:
                label = f"{name}.{value.split()[0]}"
    return False, cut, label


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order; cut-away elements give none.

    If classes and ids would leave nothing, they cut nothing.
    """
    found = _parsed(html, True)
    size = lambda b: max(len(b.text) - b.linked, 0)
    held: dict[str, int] = defaultdict(int)
    for b in found:
        for cut in b.cuts:
            held[cut] += size(b)
    half = 0.5 * sum(size(b) for b in found)
    # Beside an article or main element with text, what is named unwanted is cut whatever its size.
    marked = {e for b in found if not b.cuts and size(b) for e, label in zip(b.elements, b.path) if label.split(".")[0] in ("article", "main")}
    kept = [b for b in found if not b.cuts or all(held[cut] > half for cut in b.cuts) and (not marked or marked.intersection(b.elements))]
    return kept if any(size(b) for b in kept) else _parsed(html, False)


def _parsed(html: str, named: bool) -> list[Block]:
    """Text blocks with the class or id names that speak against them, if ``named``.  Unclosed and stray tags are tolerated."""
    stack = [_Element("#", "#", 0, False)]
    found: list[Block] = []
    text: list[str] = []
    linked, number, at, end = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal text, linked
        if text:
            clean = _BLANK.sub(" ", unescape("".join(text))).strip()
            if clean:
                around = [e for e in stack if e.name not in INLINE]
                found.append(Block(tuple(e.label for e in around), tuple(e.number for e in around), clean, linked, frozenset(e.cut for e in around if e.cut)))
        text, linked = [], 0

    def close(to: int) -> None:
        for e in stack[to:]:
            if e.name not in INLINE:
                flush()
                break
        del stack[to:]

    while at < end:
        token = _TOKEN.search(html, at)
        piece = html[at : token.start()] if token else html[at:]
        if piece and not stack[-1].out:
            text.append(piece)
            if any(e.name == "a" for e in stack):
                linked += len(piece)
        if not token:
            break
        at = token.end()
        tag = token.group()
        if tag == "<":
            if not stack[-1].out:
                text.append("&lt;")
            continue
        if tag[1] in "!?":
            if tag.startswith("<![CDATA[") and not stack[-1].out:
                text.append(tag[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = _NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            continue
        if name == "br":
            if not stack[-1].out:
                text.append(" ")
            continue
        ends = CLOSES.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    close(k)
                    break
                if stack[k].name in SCOPES:
                    break
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        number += 1
        out, cut, label = _unwanted(name, tag)
        cut = cut if named else ""
        # Text of an inline element belongs to the block around it.
        out = out or name in INLINE and bool(cut)
        stack.append(_Element(name, label, number, out or stack[-1].out, cut))
        if tag.endswith("/>") and name not in ("p", "div", "span"):
            close(len(stack) - 1)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(html, at)
            if not stop:
                break
            at = stop.start()
    flush()
    return found


def _smoothed(values: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(values, kernel, "same") / np.convolve(np.ones(len(values)), kernel, "same")


def content(found: list[Block]) -> list[Block]:
    """The blocks of the main text, in page order."""
    if not found:
        return []
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in found:
        one = sums[b.path]
        one[0] += max(len(b.text) - b.linked, 0)
        one[1] += len(_PUNCTUATION.findall(b.text))
        one[2] += 1
    long = _smoothed(np.array([sums[b.path][0] / sums[b.path][2] for b in found]))
    stops = _smoothed(np.array([(sums[b.path][1] + 1) / sums[b.path][2] for b in found]))
    fused = long * stops
    keep = fused >= KEEP * fused.max()
    if not fused.max():
        return []
    weight: dict[int, float] = defaultdict(float)
    total = 0.0
    for b, f, k in zip(found, fused, keep):
        if k:
            size = max(len(b.text) - b.linked, 0)
            total += size
            for e in b.elements:
                weight[e] += size
    # Semantic containers settle the choice; otherwise the deepest element with most of the kept text.
    named = {e: p for b in found for e, p in zip(b.elements, b.path)}
    marked = [e for e, p in named.items() if p.split(".")[0] in ("article", "main") and weight[e] > 0]
    if marked and sum(weight[e] for e in marked) >= 0.5 * total:
        chosen = set(marked)
    else:
        heavy = [e for e, w in weight.items() if w >= 0.8 * total and named[e].split(".")[0] not in _LEAVES]
        chosen = {max(heavy)} if heavy else {0}
    return [b for b in found if chosen.intersection(b.elements)]


_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "dt", "dd", "pre", "blockquote"}


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in content(blocks(html))) if html else ""


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and ``text, n_chars`` per row of ``pages``.

    The whole page is read, whatever its length.  Character references are
    decoded, white space inside a block (``<br>`` too) becomes one space, blocks are
    joined by a newline.  A null or empty page, and one without text, gives an
    empty text of 0 characters.  Extra columns are ignored.
    """
    carry = carry if carry is not None else ["page_id", "url"]
    chosen = pages.select(*[F.col(c) for c in carry], F.col(html_col).cast("string").alias("_html"))
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(width)], pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                names=[*[f"c{k}" for k in range(width)], "text", "n_chars"],
            )

    kinds = [f"c{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)]
    return chosen.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"])).withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry)})
