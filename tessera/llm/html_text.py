"""HTML extraction by tag-path ratios.

A page's text is cut into blocks, each under its root-to-leaf path of block elements with their
class, id and role. For each path these are summed over all its blocks: length of text, punctuation,
length of link text. Its ratios are text a block and punctuation a block, smoothed with those of the
neighbouring paths in page order; the share of text that is no link; and a ratio for the marks of
boilerplate on the path. They are fused by their product. The fused scores are smoothed over the
tree of paths: a path takes over a share of the best score under each of its ancestors, the less
the deeper that lies, and less across the border of an article or main element, so that a heading or
a short item beside content passes and a menu does not. Blocks of the paths whose score is
``THRESHOLD`` of the best or more are the text, in page order.

Marks are one ratio among the others and decide nothing alone: elements that are boilerplate by tag
or by a word of their class weigh little, those of which only a part of a longer class name is such
a word weigh more, and a form or such a part of a name does not count where it wraps half of the
page's text.

Null, empty and text-less pages give the empty text. Unclosed and misnested tags are repaired as
far as blocks need it. Nothing is cut off. Repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches, texts

# Elements of HTML by their role here.
RAW = "script style template noscript iframe textarea title svg math object select noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr img input".split()
)
#: What elements weigh that are boilerplate by their tag; ``header`` outside of articles, ``form``
#: where it holds less than half of the text.
TAGS = {"nav": 0.002, "footer": 0.002, "aside": 0.002, "menu": 0.002, "dialog": 0.002, "button": 0.002, "head": 0.002, "fieldset": 0.002, "header": 0.005, "form": 0.002}
# Words of a class, id or role that mark boilerplate, in any part of a name.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments disqus replies respond breadcrumb breadcrumbs "
    "cookie cookies consent gdpr newsletter subscribe popup pagination pager copyright footer navigation contentinfo complementary".split()
)
# Those that mark it as a whole name, and weigh less as a part of one.
PARTS = frozenset(
    "nav navbar menu menus sidebar side header masthead topbar toolbar banner promo promotion notice notices alert alerts modal overlay dialog signup login "
    "share sharing social related recommended recommendations widget widgets search disclaimer skip".split()
)
#: What a marked name weighs, and a name with a marked part, outside and inside of articles.
NAME, PART, PART_INSIDE = 0.002, 0.15, 0.4
#: A start tag of the left closes an open element of the right, up to the nearest other block.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"},
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(" + "|".join(RAW) + r""")(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1(?=[\s/>])[^>]*>|$)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""",
    re.S | re.I,
)
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")
NAMES = re.compile(r"[^\s]+")
WORD = re.compile(r"[a-z]+")
#: Share of the best path's score from which a path is content.
THRESHOLD = 0.1
#: What a path takes over of the best score under its parent, for each level deeper, and across the
#: border of an article or main element.
SHARE, DEEPER, BORDER = 0.3, 0.5, 0.3
#: Of the neighbours in page order; what a path of links alone keeps.
NEIGHBOURS, LINKS = 0.2, 0.35


class Paths:
    """The tree of a page's paths: for each its parent, tag, marks, and the sums over its blocks."""

    def __init__(self):
        self.ids: dict[tuple[int, str, str], int] = {}
        self.parent, self.tag, self.marks = [-1], [""], [""]
        self.blocks, self.text, self.links, self.punctuation = [0], [0], [0], [0]

    def child(self, parent: int, tag: str, marks: str) -> int:
        found = self.ids.setdefault((parent, tag, marks), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent), self.tag.append(tag), self.marks.append(marks)
            for sums in (self.blocks, self.text, self.links, self.punctuation):
                sums.append(0)
        return found

    def add(self, path: int, text: str, links: int) -> None:
        self.blocks[path] += 1
        self.text[path] += len(text)
        self.links[path] += min(links, len(text))
        self.punctuation[path] += len(PUNCTUATION.findall(text))


def mark_weight(marks: str, inside: bool, wraps: bool) -> float:
    weight = 1.0
    for name in NAMES.findall(marks.lower()):
        if name in MARKS or name in PARTS:
            weight = min(weight, NAME)
        else:
            words = set(WORD.findall(name))
            if words & MARKS:
                weight = min(weight, NAME)
            elif words & PARTS and not wraps:
                weight = min(weight, PART_INSIDE if inside else PART)
    return weight


def blocks_of(html: str) -> tuple[Paths, list[tuple[int, str]]]:
    """The page's paths, and each block's path and text, in page order."""
    paths, blocks = Paths(), []
    stack, opened = [0], Counter()
    parts: list[str] = []
    links = in_link = 0

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1], text))
                paths.add(stack[-1], text, links)
            parts.clear()
        links = 0

    def close() -> None:
        opened[paths.tag[stack.pop()]] -= 1

    at = 0
    for token in TOKEN.finditer(html):
        if token.start() > at:
            piece = html[at : token.start()]
            parts.append(piece)
            links += len(piece) * in_link
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token[2])
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        end_block()
        if tag in VOID:
            continue
        if closing:
            if opened[tag] > 0:
                while paths.tag[stack[-1]] != tag:
                    close()
                close()
            continue
        while paths.tag[stack[-1]] == "p" or paths.tag[stack[-1]] in CLOSES.get(tag, ()):  # a block ends an open paragraph
            close()
        marks = " ".join(m.strip("\"'") for m in MARKED.findall(token[4])) if token[4] else ""
        stack.append(paths.child(stack[-1], tag, marks))
        opened[tag] += 1
    if at < len(html):
        parts.append(html[at:])
    end_block()
    return paths, blocks


def path_scores(paths: Paths) -> list[float]:
    """Each path's fused and smoothed score."""
    n, parent, tag = len(paths.parent), paths.parent, paths.tag
    under = [t - k for t, k in zip(paths.text, paths.links, strict=True)]
    for i in range(n - 1, 0, -1):  # children come after their parents
        under[parent[i]] += under[i]
    inside, weight = [False] * n, [1.0] * n
    for i in range(1, n):
        wraps = 2 * under[i] >= under[0]
        own = 1.0 if tag[i] == "header" and inside[parent[i]] or tag[i] == "form" and wraps else TAGS.get(tag[i], 1.0)
        if tag[i] not in ("html", "body", "article", "main"):
            own = min(own, mark_weight(paths.marks[i], inside[parent[i]], wraps))
        inside[i] = inside[parent[i]] or tag[i] in ("article", "main")
        weight[i] = weight[parent[i]] * own
    held = [i for i in range(n) if paths.blocks[i]]
    ratios = [((paths.text[i] - paths.links[i]) / paths.blocks[i], (paths.punctuation[i] + 0.5) / paths.blocks[i]) for i in held]
    score, rest = [0.0] * n, [0.0] * n
    for k, i in enumerate(held):
        near = [ratios[j] for j in (k - 1, k + 1) if 0 <= j < len(held)]
        smooth = [(1 - NEIGHBOURS) * x + NEIGHBOURS * sum(r[m] for r in near) / len(near) if near else x for m, x in enumerate(ratios[k])]
        solid = 1 - paths.links[i] / paths.text[i]
        # the path's whole text weighs in, so that one long caption does not outdo an article
        score[i] = weight[i] * (smooth[0] * smooth[1] * (1 + solid * paths.text[i])) ** (1 / 3)
        rest[i] = weight[i] * max(LINKS, solid)
    # the best score under each path, less for each level and across an article's border
    best = list(score)
    for i in range(n - 1, 0, -1):
        up = best[i] * (1.0 if not paths.parent[i] or score[i] == best[i] else DEEPER) * (BORDER if tag[i] in ("article", "main") else 1.0)
        best[parent[i]] = max(best[parent[i]], up)
    around = list(best)
    for i in range(1, n):
        around[i] = max(best[i], around[parent[i]])
    return [max(score[i], SHARE * around[parent[i]] * rest[i]) if paths.blocks[i] else 0.0 for i in range(n)]


def main_text(html: str | None) -> str:
    paths, blocks = blocks_of(html) if html else (None, [])
    if not blocks:
        return ""
    scores = path_scores(paths)
    least = THRESHOLD * max(scores)
    return "\n".join(text for path, text in blocks if scores[path] >= least > 0)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, main ``text`` and ``n_chars`` of every page."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [main_text(h) for h in texts(batch.column(2))]
        return {id_col: batch.column(0), url_col: batch.column(1), "text": found, "n_chars": [len(t) for t in found]}

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return map_batches(pages.select(id_col, url_col, html_col), rows, f"{kinds}, text string, n_chars bigint")
