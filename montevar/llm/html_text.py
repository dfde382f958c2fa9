"""Main text of web pages by composite text density.

Every DOM node gets a link-adjusted number of characters per tag; a node's density sum is the sum over its
children.  The subtree with the largest sum is the article; the smallest density on the
path from it to the body is the threshold at which further subtrees count as content too.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from montevar.llm import common

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead "
    "tr ul".split())
CLOSES_P = BLOCK - frozenset("caption body html tbody tfoot thead tr legend".split())
SKIPPED = frozenset(
    "head nav header footer aside form menu dialog button select option input label fieldset svg math canvas audio video "
    "object embed map".split()) | RAW
SCOPE = frozenset("table td th caption button object html".split())
#: An opening tag of the first kind closes an open one of the second, up to the given ancestors.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)),
           "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
           "a": (("a",), tuple(SCOPE))}
# Words that name page furniture in class and id attributes, and landmark roles.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription paywall share sharing social comment comments disqus respond replies "
    "related recommended popup modal overlay widget toolbar pagination pager login signin signup search copyright "
    "disclaimer skip".split())
READERS = frozenset("comment comments disqus respond replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: str = "", parent: "Node | None" = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _tag_end(page: str, at: int) -> int:
    """Position of the ``>`` that ends the tag, quoted values skipped; the end of the page if there is none."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = min((q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end
        # A quote opens a value only behind an equals sign.
        if page[at:quote].rstrip()[-1:] == "=":
            close = page.find(page[quote], quote + 1)
            if close < 0:
                return end
            at = close + 1
        else:
            at = quote + 1


def parse(page: str) -> Node:
    """DOM of a page; unclosed, stray and implied tags are mended as browsers do in common cases."""
    root = here = Node("html")
    at, size = 0, len(page)
    opened: dict[str, int] = {}                                     # open elements by name

    def close(names, scope) -> None:
        """Close the innermost open element of ``names``, unless one of ``scope`` is further in."""
        nonlocal here
        if not any(opened.get(n) for n in names):
            return
        node = here
        while node is not root and node.tag not in names and node.tag not in scope:
            node = node.parent
        if node is root or node.tag not in names:
            return
        while here is not node.parent:
            opened[here.tag] -= 1
            here = here.parent

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            here.children.append(html_lib.unescape(page[at:lt]))
        if lt >= size:
            break
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.find(">", lt) + 1
                continue
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find("]]>", lt) if page.startswith("<![CDATA[", lt) else page.find(">", lt)
            at = size if end < 0 else end + (3 if page.startswith("<![CDATA[", lt) else 1)
            continue
        found = _TAG.match(page, lt)
        if not found:
            if page.startswith("</", lt):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                here.children.append("<")
                at = lt + 1
            continue
        name = found[2].lower()
        end = _tag_end(page, found.end())
        at = end + 1
        if found[1]:
            if name not in ("html", "body"):                        # what follows those still belongs to the page
                close((name,), SCOPE if name == "p" else ())
            continue
        attrs = page[found.end():end]
        if name in ("html", "body"):
            if name == "body":                                      # a head left open ends here
                opened.clear()
                here = Node("body", attrs, root)
                opened["body"] = 1
                root.children.append(here)
            continue
        if name in CLOSES_P:
            close(("p",), SCOPE)
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", here.tag):
            close((here.tag,), ())
        node = Node(name, attrs, here)
        here.children.append(node)
        if name in RAW:
            finish = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            if finish is None:
                at = size
            else:
                after = page.find(">", finish.end())
                at = size if after < 0 else after + 1
        elif name not in VOID and not (attrs.endswith("/") and name in ("path", "circle", "rect", "use")):
            here = node
            opened[name] = opened.get(name, 0) + 1
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)}


#: How surely an element is furniture: by a name that wrappers of whole pages carry as well, by a name of its own,
#: or whatever it holds.
MAYBE, LIKELY, SURE = 1, 2, 3


def furniture(node: Node) -> int:
    """0, or how surely the element is a menu, header, footer, sidebar, notice, advert, form, hidden part or reader comments."""
    found = 0
    if node.tag in SKIPPED:
        found = MAYBE if node.tag == "form" else LIKELY if node.tag in ("aside", "header", "footer", "dialog") else SURE
    if not node.attrs.strip(" /") or node.tag in ("html", "body", "main"):
        return found
    attrs = _attributes(node.attrs)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return SURE
    role = attrs.get("role", "").lower()
    if role in ROLES:
        found = max(found, MAYBE if role in ("form", "search") else LIKELY)
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()
        words = [w for w in re.split(r"[^a-z]+", words) if w]
        # One word, or two of which the first or last names the part; "has-comments" or "no-sidebar" do not.
        if not words or {"no", "has", "with", "without"} & set(words):
            continue
        if words[-1] in FURNITURE or words[0] in READERS:
            found = max(found, SURE if READERS & {words[0], words[-1]} else LIKELY)
        elif words[0] in FURNITURE:                                  # "nav-fixed", "sidebar-layout", "ad-free"
            found = max(found, MAYBE)
    return found


def _prune(root: Node) -> None:
    """Take furniture out of the tree, but go into an element that may be a wrapper of the page.

    An element named like furniture by half a name is one if it holds an article, a main element or half of the page's text outside
    links; one named by a name of its own if it holds nearly all of that text.  What is sure goes.
    """
    nodes = _in_order(root)
    plain, marked = {}, set()
    for node in reversed(nodes):
        own = 0
        for child in node.children:
            if isinstance(child, str):
                own += len("".join(child.split()))
            else:
                own += plain[id(child)]
                if child.tag in ("article", "main") or id(child) in marked:
                    marked.add(id(node))
        plain[id(node)] = 0 if node.tag == "a" or node.tag in RAW or node.tag == "head" else own
    whole, stack = plain[id(root)], [root]

    def goes(node: Node) -> bool:
        sure = furniture(node)
        if sure == MAYBE:
            return id(node) not in marked and 2 * plain[id(node)] < max(whole, 1)
        return sure == SURE or sure == LIKELY and 10 * plain[id(node)] < 9 * max(whole, 1)

    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not goes(c)]
        stack.extend(c for c in node.children if not isinstance(c, str))


def _in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def measure(body: Node) -> list[Node]:
    """Densities and density sums of all nodes below ``body``, in page order."""
    nodes = _in_order(body)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t = node.chars, max(node.tags, 1)
        lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
        plain = max(c - node.link_chars, 1)
        base = math.log(c / plain * node.link_chars + share * c + math.e)
        inside = c / lc * t / lt
        # Below one the logarithm turns negative: as many link characters as characters.
        node.density = c / t * math.log(inside) / math.log(base) if c and inside > 1 and base > 1.0000001 else (
            c / t * math.log(inside) if c and inside > 1 else 0.0)
    for node in nodes:
        node.total = sum(c.density for c in node.children if not isinstance(c, str))
    return nodes


def content_nodes(body: Node) -> list[Node]:
    """Roots of the content subtrees, in page order."""
    nodes = measure(body)
    best = max(nodes, key=lambda n: n.total)                        # the first of equal ones
    if best.total <= 0:
        return [body]
    threshold, node, top = math.inf, best, best
    while node is not None and node is not body.parent:
        threshold = min(threshold, node.density)
        if node.tag in ("article", "main"):                         # the marked article is never left in parts
            top = node
        node = node.parent
    while top.parent is not None and top is not body and top.parent is not body and any(
            not isinstance(c, str) and c is not top and c.density >= threshold for c in top.parent.children):
        top = top.parent                                            # an article whose parts lie side by side
    above, node = set(), top                                        # what holds the article is gone through
    while node is not None:
        above.add(id(node))
        node = node.parent
    chosen, stack = [], [body]
    while stack:
        node = stack.pop()
        if node is top or node is not body and node.density >= threshold and id(node) not in above:
            chosen.append(node)
            continue
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return chosen


def blocks(roots: list[Node]) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
        parts.clear()

    for root in roots:
        end()
        stack: list = [root]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item is None:
                end()
            elif item.tag in ("br", "td", "th"):
                stack.extend(reversed(item.children))
                parts.append(" ")
            elif item.tag in BLOCK:
                end()
                stack.append(None)
                stack.extend(reversed(item.children))
            else:
                stack.extend(reversed(item.children))
        end()
    return out


def main_text(page: str | None) -> str:
    """Main text of one page: blocks in page order, one line each."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    bodies = [n for n in root.children if not isinstance(n, str) and n.tag == "body"]
    body = root if not bodies or len(bodies) > 1 else bodies[0]
    return "\n".join(blocks(content_nodes(body)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` with ``text`` (main text, empty if none) in place of the html.

    A null or empty page has an empty text; broken markup is mended, never an error; very long and deeply nested pages
    take time in proportion to their length; repeated rows and an empty table are returned as they are.  An existing column ``text`` is replaced.
    """
    others = [c for c in pages.columns if c not in (html_col, "text")]
    src = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            texts = pa.array([main_text(column[i].as_py()) for i in range(batch.num_rows)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts], schema=batch.schema)

    return src.mapInArrow(run, src.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
