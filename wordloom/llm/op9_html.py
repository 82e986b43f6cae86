"""Main text of web pages by composite text density.

For every node of the document tree: characters per tag, adjusted for how many of both belong to links; a node's density sum adds up
its children's densities, its own text counting as one more child. The node of the largest sum is the article's core. The
least density on the path from the body to it is the threshold: what stands beside that path belongs to the article if it is
as dense, else it is left out, and so is a dense list of links inside the core.

Only what can't be an article by its element, role or state is no text from the start (scripts, forms, nav, footers, hidden
nodes), and reader comments, which are as dense as any article. Other names of classes decide nothing alone: a node whose whole
class or id is a usual name for adverts and notices counts as less dense.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key closes open elements of the value, up to a scope's end.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LISTS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
SCOPE = {"table", "td", "th", "caption", "object", "button", "template", "html"}
#: What is never part of an article: elements, roles, and names of reader comments.
NOT_TEXT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "template", "svg", "canvas", "object", "dialog", "menu", "datalist", "audio", "video", "map"}
NOT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
COMMENTS = {"comment", "comments", "comment-list", "commentlist", "comments-area", "disqus", "disqus_thread", "respond", "replies"}
#: Whole names that make a node DOUBT times as dense.
DOUBTFUL = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "sidebar", "menu", "navbar", "breadcrumbs", "cookies", "cookie-notice", "cookie-banner", "notice", "newsletter", "social", "share", "related", "header", "footer"}
DOUBT = 0.125
PARAGRAPH = {"p", "li", "td", "th", "tr", "dt", "dd", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


class Tree:
    """Nodes in document order; pieces: (node, its own text), or (node, None) where the node opens or closes, in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.skip, self.depth, self.doubt = ["html"], [-1], [False], [0], [False]
        self.pieces: list[tuple[int, str | None]] = []
        stack, at, n = [0], 0, len(source)
        while True:
            m = _TAG.search(source, at)
            plain = source[at : m.start() if m else n]
            if plain:
                self.pieces.append((stack[-1], plain))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.close(stack, name)
                continue
            attrs = m[3] if m[2] else m[6]
            if name in ("html", "body") and name in self.tag[1:] or name == "html":
                continue
            self.imply(stack, name)
            k = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            skip, doubt = self.judge(name, attrs or "", stack)
            self.skip.append(self.skip[stack[-1]] or skip)
            self.doubt.append(self.doubt[stack[-1]] or doubt)
            self.pieces.append((k, None))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            elif name not in VOID:  # in HTML a slash at the end closes nothing
                stack.append(k)
        self.count()

    def imply(self, stack: list[int], name: str) -> None:
        if name in BLOCK:
            for j in range(len(stack) - 1, 0, -1):
                if self.tag[stack[j]] == "p":
                    self.pop(stack, j)
                    break
                if self.tag[stack[j]] in SCOPE:
                    break
        if name in CLOSES:
            for j in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[j]]
                if t in CLOSES[name]:
                    self.pop(stack, j)
                elif t in LISTS[name]:
                    break
        if name == "body":
            self.close(stack, "head")
        if self.tag[stack[-1]] == "head" and name in BLOCK | {"a", "b", "i", "span", "img"}:
            stack.pop()

    def close(self, stack: list[int], name: str) -> None:
        for j in range(len(stack) - 1, 0, -1):
            if self.tag[stack[j]] == name:
                self.pop(stack, j)
                return
            if name == "p" and self.tag[stack[j]] in SCOPE:
                return

    def pop(self, stack: list[int], j: int) -> None:
        for k in reversed(stack[j:]):
            self.pieces.append((k, None))
        del stack[j:]

    def judge(self, name: str, attrs: str, stack: list[int]) -> tuple[bool, bool]:
        """Whether a node is no text at all, and whether its name is doubtful."""
        if name in NOT_TEXT:
            return True, False
        if name == "header" and not any(self.tag[k] in ("article", "main") for k in stack):
            return True, False
        if not attrs.strip():
            return False, False
        a = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _ATTR.findall(attrs)}
        if name in ("html", "body"):
            return False, False
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) or a.get("role") in NOT_ROLES:
            return True, False
        names = {*a.get("class", "").split(), a.get("id", "").strip()}
        return bool(names & COMMENTS), bool(names & DOUBTFUL)

    def count(self) -> None:
        """Characters, tags, and both within links, of each node with all it holds; and the share of links in the page."""
        n = len(self.tag)
        self.chars, self.tags, self.link_chars, self.link_tags, self.own = ([0] * n for _ in range(5))
        link, page, linked = [False] * n, 0, 0
        for k in range(1, n):
            link[k] = link[self.parent[k]] or self.tag[k] == "a"
        for k, text in self.pieces:
            if text is not None and (size := len("".join(text.split()))):
                page += size
                linked += size * link[k]
                if not self.skip[k]:
                    self.own[k] += size
                    self.chars[k] += size
                    self.link_chars[k] += size * link[k]
        for k in range(n - 1, 0, -1):
            if self.skip[k]:
                continue
            p = self.parent[k]
            self.tags[p] += self.tags[k] + 1
            self.link_tags[p] += self.link_tags[k] + (self.tag[k] == "a")
            self.chars[p] += self.chars[k]
            self.link_chars[p] += self.link_chars[k]
        self.share = linked / max(1, page)

    def density(self, c: int, t: int, lc: int, lt: int) -> float:
        """Composite text density of c characters and t tags, lc and lt of them in links."""
        if not c:
            return 0.0
        t = max(1, t)
        base = math.log(c / max(1, c - lc) * lc + self.share * c + math.e)
        rest = c / max(1, lc) * t / max(1, lt)
        return c / t * math.log(rest) / math.log(base) if base > 1 and rest > 1 else c / t * (1 - lc / c)

    def densities(self) -> list[float]:
        by = zip(self.chars, self.tags, self.link_chars, self.link_tags, self.doubt)
        return [self.density(c, t, lc, lt) * (DOUBT if d else 1) for c, t, lc, lt, d in by]

    def linky(self, k: int) -> bool:
        return 2 * self.link_chars[k] > self.chars[k]

    def article(self) -> tuple[int, set[int]]:
        """The node whose subtree holds the main text, and the nodes in it that are left out."""
        density = self.densities()
        children: list[list[int]] = [[] for _ in density]
        total = [self.density(o, 1, o if self.tag[k] == "a" else 0, 0) * (DOUBT if self.doubt[k] else 1) for k, o in enumerate(self.own)]
        for k in range(1, len(density)):
            if not self.skip[k]:
                children[self.parent[k]].append(k)
                if self.tag[k] != "a":
                    total[self.parent[k]] += density[k]
        best = max((k for k in range(len(density)) if not self.skip[k]), key=lambda k: (total[k], -self.depth[k], -k))
        # A phrase or one paragraph is no article; what holds it is.
        while best > 0 and (self.tag[best] not in BLOCK or self.tag[best] in PARAGRAPH):
            best = self.parent[best]
        path = [best]
        while path[-1] > 0 and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        least = min(density[k] for k in path)
        out, top = set(), best
        for k in children[best]:
            if self.tag[k] in BLOCK and (self.linky(k) and self.link_tags[k] and density[k] < least or self.doubt[k] and density[k] < max((total[j] for j in children[best] if j != k), default=0)):
                out.add(k)
        for k, up in zip(path, path[1:]):
            if self.tag[k] in ("article", "main"):  # what the page itself marks as its article ends there
                break
            beside = [j for j in children[up] if j != k and self.chars[j]]
            dense = {j for j in beside if density[j] >= least and not self.linky(j)}
            # A heading goes with the text below it; text of the parent itself is text in between.
            after = k
            for j in sorted(beside, reverse=True):
                if j < k and self.tag[j] in HEADINGS and after - j > 0 and not self.doubt[j]:
                    dense.add(j)
                elif j < k and j not in dense:
                    break
            if dense or self.own[up]:
                out.update(j for j in beside if j not in dense)
                top = up
        return top, out

    def blocks(self, top: int, left_out: set[int]) -> list[str]:
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = k == top or (k > top and inside[self.parent[k]] and k not in left_out)
        out, now = [], []
        for k, text in self.pieces:
            if not inside[k]:
                continue
            if text is None:
                if self.tag[k] in BLOCK:
                    out.append(now)
                    now = []
                elif self.tag[k] == "br":
                    now.append(" ")
            elif not self.skip[k]:
                now.append(text)
        out.append(now)
        return [b for x in out if (b := " ".join(html.unescape("".join(x)).split()))]


def main_text(source: str | None) -> str:
    """Blocks of the main text, joined by an empty line; empty for null, empty or textless pages."""
    if not source:
        return ""
    tree = Tree(source)
    return "\n\n".join(tree.blocks(*tree.article()))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    The whole html is read; broken markup (open quotes, missing or stray end tags) ends in some tree and never in an error.
    Null and empty html, and pages without text outside menus and the like, give an empty text. Null ids and urls, repeated
    rows and an empty table pass through; other columns aren't read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array(list(map(len, text)), pa.int64())})

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
