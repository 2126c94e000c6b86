"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its root-to-leaf tag path (names with
classes and ids; inline tags do not count). For every path the text outside links and the punctuation are added up; their
ratios to the number of the path's blocks are fused as a product, smoothed with a Gaussian over neighbouring blocks in page order,
averaged over the path and multiplied by the path's weight: SHUN for each element that its tag, role, class or id marks as menu,
header, footer, sidebar, notice, advert, form or comments, FAVOUR for an article or main element. Paths whose value reaches the
spread of the page's values (or a share of the highest) are content, and so is the path of the greatest total. The page's text is
that of its content paths, and of headings, lists, quotes and tables directly beside them, unless marked or mostly links. Only what
browsers do not show as text is left out when reading: scripts, styles, controls, hidden elements.

Defined results: null and empty pages, and pages without text, give the empty text; broken markup is read as browsers
read it in the main (paragraphs and list items end where the next begins, unknown end tags are skipped, an unclosed
comment or tag ends with the page); text outside any tag counts. Pages are judged each by itself, so repeated rows and other
columns do not matter; an empty table gives an empty result. Paths are numbers of (parent, name), so time is linear in the page
however deep its tags are nested.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = RAW | frozenset("head button select option input svg math canvas audio video object embed map datalist".split())
SHUNNED = frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar alertdialog".split())
#: Words of a class or id that mark boilerplate, and those that take it back in a name such as has-sidebar.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies discussion consent cookie cookies gdpr notice notices notification alert "
    "footer foot footnav header masthead topbar nav navbar navigation menu menus sidebar side aside widget widgets related recommended recommendations promo promotion promoted sponsor sponsored sponsors share sharing social "
    "subscribe subscription newsletter signup login popup modal overlay toolbar pagination pager paging skip tags tagcloud copyright legal disclaimer search form outbrain taboola".split()
)
UNMARKED = frozenset("has with no without is show hide".split())
#: What the start of a tag ends: an open element of the set, no further out than the limits.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_LIMITS = frozenset("ul ol dl table select body html article section div".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul dt dd".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that may stand beside content paths.
BESIDE = _HEADINGS | frozenset("ul ol li dl dt dd blockquote table thead tbody tfoot tr td th caption figure figcaption pre".split())
LINKS, SHUN, FAVOUR, SHARE, WIDTH = 0.5, 0.02, 8.0, 0.25, 0.3


class Block(NamedTuple):
    path: int
    text: str
    linked: int  # characters inside links


class Paths:
    """Tag paths as numbers, those of parents smaller: parent, tag, weight, and whether their last element is marked."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.weight, self.marked = [-1], [""], [1.0], [False]

    def child(self, parent: int, name: str, tag: str, marked: bool) -> int:
        found = self.number.get((parent, name))
        if found is None:
            found = self.number[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            weight = self.weight[parent] * (SHUN if marked else FAVOUR if tag in ("article", "main") else 1.0)
            self.weight.append(max(weight, 1e-200))
            self.marked.append(marked)
        return found


def _element(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element shows no text, whether it is marked, and its name in paths. inside: within an article, where headers carry the headline."""
    named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t") else {}
    names = f"{named.get('class', '')} {named.get('id', '')}".split()
    out = tag in DROPPED or "hidden" in named or named.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")))
    marked = tag in SHUNNED or (tag == "header" and not inside) or named.get("role", "").lower() in ROLES
    if not marked and tag not in ("html", "body", "article", "main"):
        for name in names:
            words = re.split(r"[-_:0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            marked |= words[0] not in UNMARKED and not MARKS.isdisjoint(words) and not (inside and tag == "header" and set(words) & MARKS <= {"header", "side", "tags", "form"})
    return out, marked, ".".join([tag, *names, *["marked"] * marked])


def read_blocks(page: str) -> tuple[list[Block], Paths]:
    """Blocks with text, in page order, and their paths."""
    blocks: list[Block] = []
    paths = Paths()
    stack: list[tuple[str, int, bool]] = []  # tag, path, left out (itself or an outer one)
    places: dict[str, list[int]] = defaultdict(list)  # of open tags in the stack
    solid: list[int] = []  # places of those that aren't inline
    parts: list[str] = []
    linked = [0]

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1][1] if stack else 0, text, min(linked[0], len(text))))
            parts.clear()
            linked[0] = 0

    def add(raw: str) -> None:
        if not (stack and stack[-1][2]):
            parts.append(raw)
            if places["a"]:
                linked[0] += len(html.unescape(raw).strip())

    def end(depth: int) -> None:
        if solid and solid[-1] >= depth:
            flush()
        for tag, _, _ in reversed(stack[depth:]):
            places[tag].pop()
            if tag not in INLINE:
                solid.pop()
        del stack[depth:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places[tag] and (tag not in INLINE or not solid or solid[-1] < places[tag][-1]):
                end(places[tag][-1])
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in _CLOSES_P and places["p"] and solid[-1] == places["p"][-1]:
            end(solid[-1])
        if tag in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
            end(len(stack) - 1)
        ends = _ENDS.get(tag, ())
        while ends and (depth := last(ends)) > last(_LIMITS):
            end(depth)
            if tag not in ("tr", "tbody", "tfoot"):
                break
        if tag not in INLINE:
            flush()
        out, marked, name = _element(tag, m[3], bool(places["article"] or places["main"]))
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            above = stack[-1] if stack else ("", 0, False)
            if tag not in INLINE:
                solid.append(len(stack))
            places[tag].append(len(stack))
            stack.append((tag, above[1] if tag in INLINE and not marked else paths.child(above[1], name, tag, marked), out or above[2]))
    flush()
    return blocks, paths


def content_paths(blocks: list[Block], paths: Paths) -> np.ndarray:
    """Whether each path's smoothed, fused ratios reach the threshold, by its number."""
    n = len(paths.parent)
    at = np.array([b.path for b in blocks])
    count = np.maximum(np.bincount(at, minlength=n), 1)
    length = np.bincount(at, [len(b.text) - b.linked for b in blocks], n)
    marks = np.bincount(at, [len(_PUNCTUATION.findall(b.text)) for b in blocks], n)
    fused = length / count * (marks + 0.5) / count
    kernel = np.exp(-np.arange(-1, 2) ** 2 / WIDTH)
    smooth = np.convolve(fused[at], kernel, "full")[1:-1] / np.convolve(np.ones(len(at)), kernel, "full")[1:-1]
    score = np.bincount(at, smooth, n) / count * paths.weight
    total = score * length
    limit = min(float(score[at].std()) or np.inf, SHARE * float(score.max()))
    return (np.bincount(at, minlength=n) > 0) & ((score >= limit) & (score > 0) | (total == total.max()))


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block."""
    blocks, paths = read_blocks(page or "")
    if not blocks:
        return ""
    chosen = content_paths(blocks, paths)
    n, parent = len(paths.parent), paths.parent
    length, linked, near, holds = [0] * n, [0] * n, [False] * n, [False] * n
    for b in blocks:
        length[b.path] += len(b.text)
        linked[b.path] += b.linked
    for i in range(1, n):
        holds[parent[i]] |= bool(chosen[i])
    for i in range(1, n):
        near[i] = (holds[parent[i]] or near[parent[i]]) and paths.tag[i] in BESIDE and not paths.marked[i]
    kept = [bool(chosen[i]) or (near[i] and linked[i] <= LINKS * length[i]) for i in range(n)]
    return "\n".join(b.text for b in blocks if kept[b.path])


_FIELDS = [("text", T.StringType()), ("n_chars", T.LongType())]


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in _FIELDS]))
def main_text(pages: pa.Array) -> pa.Array:
    texts = [extract(x.as_py()) for x in pages]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", main_text("html").alias("x")).select("page_id", "url", "x.*")
