"""Operator 3: main text of HTML pages by tree scoring.

A page is cut into blocks (the text between two block-level tags). Each block
earns points for length and commas; the points go to the containers above it,
halved for the grandparent and thinned further up, and a container's sum is
discounted by its link density. The best container is kept, or the outermost
article or main that holds it, and beside it and what holds it everything that
is not mostly links, however short; what its tags, roles or
class names mark as menu, header, footer, sidebar, notice, advert, form,
script, style or reader comments is left out everywhere.

A name marks by all its words ("cookie-notice", "post-comments"), not by one of
them ("search-results", "form-of-government"; these lower the score only).
Headings are never left out by name. An id, which may come from a title, marks
only divisions, lists and tables outside article and main, and only if it is
no word that titles use ("related"); inside, such words do not mark as class
names either. A form, header or fieldset is the page itself if it holds an
article or main or, where there is none outside it, most of the page's
paragraphs (of the article's, inside one): only its labels and controls are
left out.

The text is the kept blocks in page order joined by one line feed; within a
block, character references are decoded, white space (of any kind, and line
breaks by tag) becomes one space, and ends are trimmed. Nothing else is
dropped or capped.

Cases: null, empty or text-less html gives an empty text; unclosed and stray
tags, unclosed comments and arbitrarily deep nesting are accepted (no
recursion); rows are independent, so ties, repeated rows, null ids or urls
and other columns do not matter.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.common import table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)""", re.S)
_QUOTE = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in
        ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "select", "button", "canvas", "video", "audio")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("head nav footer aside menu dialog".split())
_FRAME = frozenset("form header fieldset".split())  # left out unless they hold the page
_CONTROLS = frozenset("label legend datalist optgroup option output meter progress".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BY_ID = frozenset("div center ul ol dl table td".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar note".split())
_NEVER_DROP = frozenset("html body article main".split())
_NEGATIVE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion sidebar side aside menu nav navbar navigation "
                      "breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments respond replies reply discussion disqus cookie cookies consent gdpr notice "
                      "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
                      "widgets pager pagination skip hidden form search copyright legal disclaimer".split())
_POSITIVE = frozenset("content article main body post entry story text page".split())
# Negative words that titles, and so ids and the names of an article's parts, use as well.
_TOPICS = frozenset("legal discussion social related recommended recommendations search form alert consent copyright disclaimer notice notices side foot header reply "
                    "replies respond promotion subscribe subscription signup login skip cookie cookies widget widgets".split())
# Words of layout that do not change what a name marks.
_LAYOUT = _POSITIVE | frozenset("area bar block bottom box btn button buttons center col column container first global group icons inner item items last left links list outer panel "
                                "posts primary region right row secondary section site sticky the top wrap wrapper".split())
_ABOUT = frozenset("with has no without".split())
_CONTAINER = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "body": 0.0, "html": 0.0, "#root": 0.0}
# A start tag of the key closes open elements of the values, up to the nearest of the scope.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_SCOPE = frozenset("table ul ol dl article section div main body html nav aside footer header form blockquote".split())
_PARAGRAPH_BARRIERS = _SCOPE - {"ul", "ol", "dl"}
# Beside the best container, what has this share of its characters in links is taken for a menu.
_LINKS = 0.5
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[\s_\-:.]+")


@lru_cache(4096)
def _mark(name: str) -> int:
    """What a class name or id says: 0 nothing, 1 some word of boilerplate, 2 boilerplate by all its words, 3 several such words or a notice, 4 boilerplate by a word that is no topic."""
    parts = [x for x in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
    parts = [x for x in (re.sub(r"\d+$", "", x) for x in parts) if x]
    bad = [x for x in parts if x in _NEGATIVE]
    if not bad or any(x in _ABOUT for x in parts):
        return 0
    if not all(x in _NEGATIVE or x in _LAYOUT for x in parts) or parts[-1] not in _NEGATIVE and any(x in _POSITIVE for x in parts):
        return 1
    if any(x not in _TOPICS for x in bad):
        return 4
    return 3 if len(bad) > 1 or bad[0].startswith("notice") else 2


def _beside(tag: str, attrs: str, within: bool) -> tuple[bool, bool, bool]:
    """(left out, is the main container by role, named a little like boilerplate) from a start tag, ``within`` an article or main or not."""
    if tag in _DROP:
        return True, False, False
    if not attrs or attrs.isspace():
        return False, False, False
    main = doubt = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, False
        if name == "role":
            if value.lower() in _DROP_ROLES and tag not in _NEVER_DROP and (value.lower() != "form" or tag != "form"):
                return True, False, False
            main |= value.lower() in ("main", "article")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, False
        elif name in ("class", "id") and tag not in _NEVER_DROP and tag not in _HEADINGS:
            mark = max(map(_mark, value.split()), default=0)
            doubt |= mark > 0
            if name == "id":
                out = mark == 4 and tag in _BY_ID and not within
            else:
                out = mark >= (4 if tag in _FRAME else 3 if within else 2)
            if out:
                return True, False, False
    return False, main, doubt


def _points(text: str) -> float:
    n = len(text)
    return min(n / 100, 3.0) + text.count(",") + text.count("、") + text.count("，") + (1.0 if n >= 25 else n / 25)


def _without_frames(tags: list[str], parents: list[int], mains: list[bool], blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The blocks but those in a form, header or fieldset that holds neither an article or main nor, of it or else of the page, most of the paragraphs.
    A header within an article or main, which holds its title, is left out only if it is mostly links."""
    n = len(tags)
    chars, main_chars, within = [0] * n, [0] * n, [False] * n  # of paragraphs; of those in an article or main
    said, in_links_of = [0] * n, [0] * n  # of all blocks
    for k in range(n):
        within[k] = mains[k] or k > 0 and within[parents[k]]
    for node, text, in_links in blocks:
        said[node] += len(text)
        in_links_of[node] += in_links
        if tags[node] not in _HEADINGS and in_links < _LINKS * len(text):
            chars[node] += len(text)
            main_chars[node] += len(text) * within[node]
    for k in range(n - 1, 0, -1):
        for sums in (chars, main_chars, said, in_links_of):
            sums[parents[k]] += sums[k]
    out = [False] * n
    for k in range(1, n):
        if tags[k] == "header" and within[parents[k]]:
            small = in_links_of[k] >= _LINKS * said[k]
        elif main_chars[0]:
            small = 2 * main_chars[k] <= main_chars[0] if within[k] else not main_chars[k]
        else:
            small = 2 * chars[k] <= chars[0]
        out[k] = out[parents[k]] or tags[k] in _FRAME and small
    return [b for b in blocks if not out[b[0]]]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tags, parents, weights, mains = ["#root"], [-1], [0.0], [False]  # the tree: block-level elements only
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their node (inline ones share their parent's)
    blocks: list[tuple[int, str, int]] = []  # (node, text, characters within links)
    left_out = links = articles = frames = 0  # open elements of the kinds
    kinds: list[tuple[bool, bool, bool, bool]] = [(False, False, False, False)]
    doubts: list[int] = []  # nodes named a little like boilerplate
    chunks: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if chunks:
            text = _SPACE.sub(" ", "".join(chunks)).strip()
            if text:
                blocks.append((stack[-1][1], text, len(_SPACE.sub(" ", "".join(linked)).strip())))
            chunks.clear()
            linked.clear()

    def said(raw: str) -> None:
        if raw and not left_out:
            if "&" in raw:
                raw = _html.unescape(raw)
            chunks.append(raw)
            if links:
                linked.append(raw)

    open_at: dict[str, list[int]] = {}  # depths in the stack of the open elements of a name
    scopes: list[int] = []  # of those that bound what a tag closes by itself
    block_depths: list[int] = []

    def nearest(*names: str) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    def pop_to(depth: int) -> None:
        nonlocal left_out, links, articles, frames
        while len(stack) > depth:
            name = stack[-1][0]
            if name in _BLOCK:
                flush()
                block_depths.pop()
            if name in _SCOPE:
                scopes.pop()
            stack.pop()
            open_at[name].pop()
            out, link, article, frame = kinds.pop()
            left_out -= out
            links -= link
            articles -= article
            frames -= frame

    at, end, quotes = 0, len(page), True
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m[2] is None:  # comment, doctype, processing instruction
            said(page[at:m.start()])
            at = m.end()
            continue
        # The tag ends at the first > outside quotes. Where a quote is never closed, quotes no longer count, from there on.
        close = page.find(">", m.end())
        if close < 0:  # no tag ends any more
            said(page[at:])
            break
        q = _QUOTE.search(page, m.end()) if quotes else None
        while q and q[0] != ">":
            shut = page.find(q[0], q.end())
            q = _QUOTE.search(page, shut + 1) if shut >= 0 else None
        if q:
            close = q.start()
        else:
            quotes = False
        said(page[at:m.start()])
        attrs = page[m.end():close]
        at = close + 1
        tag = m[2].lower()
        if m[1]:
            match = nearest("h1", "h2", "h3", "h4", "h5", "h6") if tag in _HEADINGS else nearest(tag)
            barrier = 0
            if tag not in _BLOCK and block_depths:
                barrier = block_depths[-1]
            elif tag in ("p", "li", "dd", "dt"):
                barrier = nearest(*_PARAGRAPH_BARRIERS)
            elif tag in ("td", "tr", "th"):
                barrier = nearest("table")
            if match > barrier:
                pop_to(match)
            if tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            said(" ")
            continue
        if tag in _RAW and not attrs.rstrip().endswith("/"):
            shut = _RAW[tag].search(page, at)
            at = shut.end() if shut else end
            said(" ") if tag in ("button", "select") else None
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            scope = scopes[-1] if scopes else 0  # what this tag closes by itself
            if (p := nearest("p")) > max(scope, nearest("li", "td", "th")):
                pop_to(p)
            for _ in range(3):
                if (other := nearest(*_CLOSES.get(tag, ()))) > (scopes[-1] if scopes else 0):
                    pop_to(other)
            flush()
        out, role, doubt = _beside(tag, attrs, articles > 0)
        out |= frames > 0 and tag in _CONTROLS
        main = role or tag in ("article", "main")
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        if tag in _BLOCK:
            block_depths.append(len(stack))
            if doubt:
                doubts.append(len(tags))
            tags.append(tag)
            parents.append(stack[-1][1])
            weights.append(_CONTAINER.get(tag, 0.0) + 25.0 * role)
            mains.append(main)
            stack.append((tag, len(tags) - 1))
        else:
            stack.append((tag, stack[-1][1]))
        kinds.append((out, tag == "a", main, tag in _FRAME))
        left_out += out
        links += tag == "a"
        articles += main
        frames += tag in _FRAME
    pop_to(1)
    flush()
    n = len(tags)
    if not _FRAME.isdisjoint(tags):
        blocks = _without_frames(tags, parents, mains, blocks)
    if not blocks:
        return ""

    score, chars, link_chars = [0.0] * n, [0] * n, [0] * n
    holder = [0] * n  # the nearest container from an element on, itself included
    for k in range(n):
        holder[k] = k if tags[k] in _CONTAINER else holder[parents[k]]
    for node, text, in_links in blocks:
        points, level, k = _points(text) * (1 - in_links / len(text) if in_links < len(text) else 0.0), 0, holder[node]
        while True:
            score[k] += points if level == 0 else points / (2 if level == 1 else 3 * level)
            level += 1
            if level > 8 or k == 0:
                break
            k = holder[parents[k]]
        chars[node] += len(text)
        link_chars[node] += in_links
    for k in range(n - 1, 0, -1):  # children come after their parents
        chars[parents[k]] += chars[k]
        link_chars[parents[k]] += link_chars[k]
    final = [-1.0] * n
    for k in range(n):
        if tags[k] in _CONTAINER and chars[k]:
            final[k] = (score[k] + weights[k]) * (1 - min(1.0, link_chars[k] / chars[k]))
    for k in doubts:
        final[k] /= 2
    best = max(range(n), key=lambda k: (final[k], -k))
    if final[best] <= 0:
        best = 0
    k = best
    while k >= 0:
        if mains[k]:
            best = k
        k = parents[k]
    above, k = set(), parents[best]
    while k >= 0:
        above.add(k)
        k = parents[k]
    inside = [False] * n
    for k in range(n):
        part = parents[k] in above and k not in above and link_chars[k] < _LINKS * chars[k]
        inside[k] = k == best or k > 0 and inside[parents[k]] or part
    return "\n".join(text for node, text, in_links in blocks if inside[node] or node in above and in_links < _LINKS * len(text))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col`` = the main text (replacing a column of that
    name) instead of ``html_col``. A narrow projection: no shuffle."""

    @F.pandas_udf(T.StringType())
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(main_text, na_action=None)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, out_col)]
    return pages.select(*kept, text_of(F.col(html_col)).alias(out_col))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")) \
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
