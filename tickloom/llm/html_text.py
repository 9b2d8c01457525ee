"""Main text of web pages by scoring the page's tree.

A tolerant reader builds the tree. Elements that never hold main text are dropped by their name or role; those that are only named like such
(class, id) stay if they hold most of the page's paragraphs, unless they are named as noise as a whole. Each paragraph gives points for its length and commas to its parent and,
halved, to its grandparent; a container's points are scaled by the share of its text outside links. The best container, or the article element
around it, is kept with its siblings of few links; of an article, with those that score near it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside button select option input script style noscript iframe textarea title svg canvas object template menu dialog label fieldset audio video math xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h2 h3 h4 h5 h6 figcaption".split())
CLOSED_BY = {"p": BLOCKS - frozenset(("html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "figcaption")), "li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option",))}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of classes and ids: kinds of content that is never main text, page layout, what such names are put before or after, and names of content.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies disqus respond cookie cookies consent gdpr notice notices related recommended newsletter subscribe subscription widget widgets disclaimer paywall".split())
LAYOUT = frozenset("banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead popup modal overlay share sharing social signup login search pagination pager toolbar tags copyright skip".split())
HOLDERS = frozenset("area bar block box container content form inner item items links list module panel posts section slot stories thread unit wrap wrapper".split())
MODIFIERS = frozenset("has hide is no non not show with without".split())
CONTENT = frozenset("article body content entry main page post story text".split())
#: Where a run of short links is a menu.
MENUS = frozenset("ul ol td dl table tr".split())
#: What an element's name says: main text never, nor where named so as a whole; layout; or only in part.
NEVER, NOISY, LAID_OUT, PERHAPS = 4, 3, 2, 1
QUOTE = re.compile("[>\"']")
WORDY = re.compile(r"[a-z]+|[A-Z][a-z]*")
NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Node:
    """An element: name, parent, and children that are nodes or decoded text."""

    __slots__ = ("name", "parent", "children", "score", "noise")

    def __init__(self, name: str, parent: Node | None, noise: int = 0):
        self.name, self.parent, self.children, self.score, self.noise = name, parent, [], 0.0, noise


def named(value: str) -> int:
    """NOISY or LAID_OUT if a class or id names the element as such, PERHAPS if it only says something about it ("has-ads"), else 0."""
    out, content = 0, False
    for token in html.unescape(value).split():
        words = [w.lower() for w in WORDY.findall(token)]
        content = content or len(words) == 1 and words[0] in CONTENT
        hits = [w for w in words if w in NOISE or w in LAYOUT]
        if hits:
            last = [w for w in words if w not in HOLDERS][-1:]  # "comment-list", but not "comments-open"
            whole = last and last[0] in hits and words[0] not in MODIFIERS
            out = max(out, (NOISY if last[0] in NOISE else LAID_OUT) if whole else PERHAPS)
    return PERHAPS if out and content else out


def noisy(name: str, attributes: str) -> int:
    """NEVER, NOISY, LAID_OUT, PERHAPS or 0, by an element's name and attributes."""
    if name in DROPPED:
        return NEVER
    out = {"header": LAID_OUT, "form": PERHAPS}.get(name, 0)
    if not attributes or name in ("html", "body"):
        return out
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.strip().lower() in ROLES - {"form", "banner"} or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return NEVER
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return NEVER
        if key == "role" and value.strip().lower() in ("form", "banner"):
            out = max(out, LAID_OUT)
        if key in ("class", "id"):
            out = max(out, named(value))
    return min(out, PERHAPS) if name in ("article", "main") else out


def scan(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, whether it closes) of every tag, comment (name "") and CDATA section (name "#") of the page, from left to right.

    A tag ends at the first > outside quotes. Where quotes leave a tag open to the page's end, they are not heeded from there on, so the
    page is read in linear time.
    """
    at, size, quotes = 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        nxt = page[start + 1 : start + 2]
        if nxt in ("!", "?"):
            mark, stop = ("<!--", "-->") if page.startswith("<!--", start) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", start) else ("<!", ">")
            end = page.find(stop, start + len(mark) if mark != "<!" else start)
            if end < 0 and mark == "<!":
                return
            at = size if end < 0 else end + len(stop)
            yield start, at, "#" if mark == "<![CDATA[" else "", page[start + 9 : size if end < 0 else end] if mark == "<![CDATA[" else "", False
            continue
        closing = nxt == "/"
        m = NAME.match(page, start + 1 + closing)
        if not m:
            at = start + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            return
        if quotes and (page.find('"', m.end(), end) >= 0 or page.find("'", m.end(), end) >= 0):
            i = m.end()
            while True:
                found = QUOTE.search(page, i)
                if found is None:
                    quotes = False
                    break
                if found[0] == ">":
                    end = found.start()
                    break
                i = page.find(found[0], found.end()) + 1
                if not i:
                    quotes = False
                    break
        at, name = end + 1, m[0].lower()
        attributes = page[m.end() : end]
        if name in RAW and not closing:  # its text is no markup
            close = raw_end(name).search(page, at)
            at = size if close is None else close.end()
        yield start, at, name, attributes, closing


@lru_cache(maxsize=64)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?:[\s/][^>]*)?>", re.I)


def parse(page: str) -> Node:
    """The page's tree. Void and raw-text elements, implied ends of paragraphs, items and cells, and stray end tags are allowed for."""
    root = Node("#root", None)
    stack, places, blocks_at = [root], {}, [0]  # open elements, where those of a name stand, and where blocks do

    def close(to: int) -> None:
        while len(stack) > to:
            name = stack.pop().name
            places[name].pop()
            if blocks_at[-1] == len(stack):
                blocks_at.pop()

    at = 0
    for start, end, name, attributes, closing in scan(page):
        if start > at:
            stack[-1].children.append(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        if name == "#":
            stack[-1].children.append(attributes)
            continue
        if closing:
            where = places.get(name)
            if where and (name in BLOCKS or where[-1] > blocks_at[-1]):  # an inline end tag doesn't close a block
                close(where[-1])
            continue
        while stack[-1].name in CLOSED_BY and name in CLOSED_BY[stack[-1].name]:
            close(len(stack) - 1)
        if name in BLOCKS:  # inline elements left open inside a paragraph or item don't keep it open
            up = stack[blocks_at[-1]]
            if up.name in CLOSED_BY and name in CLOSED_BY[up.name]:
                close(blocks_at[-1])
        child = Node(name, stack[-1], noisy(name, attributes))
        stack[-1].children.append(child)
        if name not in RAW and name not in VOID and not attributes.rstrip().endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks_at.append(len(stack))
            stack.append(child)
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def settle(root: Node, firm: bool) -> None:
    """Decide which named elements stay (noise 0), by the characters of their paragraphs. An element that is only perhaps noise stays if
    it holds over half of the page's, or an article longer than all the rest; one that is named as layout as a whole only for such an
    article; one that is named as noise never, whatever it holds. Unless firm, layout is only perhaps noise. The header of an article keeps
    its headings."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.name == "header" and node.parent is not None and (node.parent.name in ("article", "main") or node.parent.name == "div" and node.parent.parent is not None and node.parent.parent.name in ("article", "main")):
            node.noise, node.children = 0, [c for c in descendants(node) if c.name in HEADINGS]
        if not firm and node.noise == LAID_OUT:
            node.noise = PERHAPS
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.noise != NEVER]
    inside: dict[Node, bool] = {}
    for node in order:
        bare = node.name in ("div", "section", "article", "main", "form", "center", "body", "#root")
        inside[node] = True if bare else node.name in PARAGRAPHS or inside.get(node.parent, False)
    text, article = {}, {}  # characters, and those of the longest article or main
    for node in reversed(order):
        kids = [c for c in node.children if isinstance(c, Node) and c in text]
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) if inside[node] else 0
        text[node] = own + sum(text[c] for c in kids if c.noise < LAID_OUT)
        article[node] = max([text[node] if node.name in ("article", "main") else 0, *(article[c] for c in kids if c.noise != NOISY)])
    total, longest = text[root], article[root]
    for node in order:
        if node.noise == PERHAPS:
            most = 2 * text[node] > total or article[node] > total - text[node]
            node.noise = 0 if most or node.name in ("article", "main") and 2 * text[node] >= longest else PERHAPS
        elif node.noise == LAID_OUT and article[node] > total:
            node.noise = 0


def descendants(node: Node) -> Iterator[Node]:
    """The elements below a node in page order, but not those below headings."""
    stack = [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        x = stack.pop()
        yield x
        if x.name not in HEADINGS:
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def score(root: Node) -> Node:
    """Give every container its points and return the best one. Text lengths and link lengths are summed bottom-up without recursion."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.noise]
    text, linked, commas, links, paragraphs = {}, {}, {}, {}, {}
    for node in reversed(order):
        own = [c for c in node.children if isinstance(c, str)]
        kids = [c for c in node.children if isinstance(c, Node) and not c.noise]
        text[node] = sum(len(" ".join(c.split())) for c in own) + sum(text[c] for c in kids)
        linked[node] = text[node] if node.name == "a" else sum(linked[c] for c in kids)
        links[node] = (node.name == "a") + sum(links[c] for c in kids)
        if node.name in MENUS and links[node] >= 3 and linked[node] >= 0.95 * text[node] and text[node] < 30 * links[node]:
            node.noise = LAID_OUT  # a menu, whatever its name
            text[node] = linked[node] = links[node] = 0
        commas[node] = sum(c.count(",") + c.count("，") + c.count("、") for c in own) + sum(commas[c] for c in kids)
        bare = node.name in ("div", "section", "article", "main", "body") and any(c.strip() for c in own)
        if (node.name in PARAGRAPHS or bare) and text[node]:
            points = paragraphs[node] = 1 + commas[node] + min(text[node] / 100, 3)
            up, share = (node if bare else node.parent), 1.0
            for _ in range(2):
                if up is None:
                    break
                up.score += points * share
                up, share = up.parent, share / 2
    # the points of an article's own paragraphs, those of articles inside it apart
    nearest: dict[Node, Node | None] = {}
    points_of: dict[Node, float] = {}
    for node in order:
        nearest[node] = node if node.name == "article" else nearest.get(node.parent) if node.parent is not None else None
        if node in paragraphs and nearest[node] is not None:
            points_of[nearest[node]] = points_of.get(nearest[node], 0.0) + paragraphs[node]
    best, most = root, -1.0
    for node in order:
        if node.name in BLOCKS or node is root:
            node.score += {"article": 8, "main": 6, "div": 2}.get(node.name, 0) if text[node] else 0
            node.score *= 1 - linked[node] / text[node] if text[node] else 0
            if node.score > most and text[node]:
                best, most = node, node.score
    # of the articles that hold the best container, the outermost whose own paragraphs score is the container
    around, up = [], best
    while up is not None:
        if up.name == "article":
            around.append(up)
        up = up.parent
    if around:
        enough = 0.2 * max(points_of.get(a, 0.0) for a in around)
        best = next((a for a in reversed(around) if points_of.get(a, 0.0) > 0 and points_of[a] >= enough), around[-1])
    kept = [best]
    if best.parent is not None:
        kept = []
        # beside a part of the text stand its other parts; beside an article, or a division of the whole page, other things
        wide = best.name != "article" and not (best.name in ("div", "main") and best.parent.name in ("body", "html", "#root"))
        for c in best.parent.children:
            if c is best or wide and isinstance(c, str):
                kept.append(c)
            elif isinstance(c, Node) and not c.noise and text[c]:
                density = linked[c] / text[c]
                if wide and density < 0.25 or c.name == best.name and c.score >= max(10, 0.2 * best.score) or c.name in ("p", "pre", "blockquote") and best.name != "article" and (text[c] > 80 and density < 0.25 or density == 0):
                    kept.append(c)
    out = Node("#kept", None)
    out.children = kept
    return out


def blocks(node: Node) -> list[str]:
    """The text blocks under a node in page order, white space made single spaces; line breaks count as white space."""
    out, held, stack = [], [], [node]

    def flush() -> None:
        line = " ".join("".join(held).split())
        if line:
            out.append(line)
        held.clear()

    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.noise:
            continue
        elif x.name == "br":
            held.append("\n")
        elif x.name in BLOCKS:
            flush()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds; empty if there is none. A page whose text all lies in elements named like
    page layout is read again with these."""
    if not page:
        return ""
    for firm in (True, False):
        root = parse(page)
        settle(root, firm)
        found = blocks(score(root))
        if found:
            return "\n".join(found)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars (code points).

    A null or empty page, or one without main text, has an empty text and 0; null ids and urls stay null; equal rows each give a
    row; other columns are not read; an empty table gives no rows.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
