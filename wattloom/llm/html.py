"""Main text of HTML pages by tree scoring.

A page becomes a tree; elements that are never the article (navigation, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are cut by tag, role, hidden state
and the words of their class and id (some only where the element holds no prose or is mostly links).  Every paragraph passes points for its length and commas to its
ancestors, halved and thirded on the way up; an ancestor's sum is discounted by its link density.  The best
container is kept with the siblings that are prose, lists, tables, headings or bare text too; inside it nothing is left out.

A null page has the empty text.  Unclosed and truncated markup is closed as browsers do; a page without
paragraphs keeps all that was not cut.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# HTML's own element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
P_SCOPE = set("html table td th caption button object template".split())

NEVER = set("head script style noscript template iframe object embed applet svg canvas audio video nav footer aside dialog menu search form button select input "
            "textarea option datalist title noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
# names of parts that are not the article: always cut, wherever the word stands in a name
BESIDE = set("ad ads adv advert adverts advertisement advertising adsense adslot comment comments commentlist consent cookie cookies disqus footer footnav gdpr login menu menubar "
             "modal nav navbar navigation newsletter overlay paywall popup replies reply respond shoutbox sidebar sidenav signup sponsor sponsored subscribe subscription".split())
# cut as a whole name; as part of a longer one only where the element holds no prose
PERHAPS = set("banner header hidden masthead notice notices notification skip skyscraper toolbar topbar tracking widget widgets".split())
# cut only where the element is mostly links
LINKED = set("breadcrumb breadcrumbs pager pagination promo promoted promotion recommended related rss share sharing social tags".split())
CONTENT = set("article main body html".split())
LIKELY = set("article body content main".split())       # names of containers
HAS = re.compile(r"(?:(?<=\s)|^|(?<=[-_]))(?:has|with|no|without)[-_]\S*", re.I)
PROSE = 40              # characters
SHORT = 200             # characters; a shorter text is looked for again under weaker class rules
PARAGRAPH = set("p pre td blockquote li dd".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())


LEVELS = 8          # ancestors that a paragraph passes points to


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "linked", "score", "depth")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.linked = 0
        self.score = 0.0
        self.depth = parent.depth + 1 if parent else 0


def _attributes(raw: str) -> dict:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def parse(page: str) -> Node:
    root = here = Node("html", {}, None)
    opened: Counter = Counter()              # open elements by tag, so that no search goes up a deep tree in vain

    def leave(at, to):
        """Ends the open elements from ``at`` up to, not with, its ancestor ``to``."""
        while at is not to:
            opened[at.tag] -= 1
            at = at.parent
        return to

    def closed(node, tags, scope):
        """Where to go on if an open element of ``tags`` within ``scope`` ends here."""
        if not any(opened[x] for x in tags):
            return node
        at = node
        while at.parent is not None and at.tag not in scope:
            if at.tag in tags:
                return at.parent
            at = at.parent
        return node

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if not m:
            here.children.append(entities.unescape(page[pos:]))
            break
        if m.start() > pos:
            here.children.append(entities.unescape(page[pos:m.start()]))
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            at = here
            while opened[tag] and at.parent is not None and at.tag != tag and (tag in BLOCK or at.tag not in BLOCK):
                at = at.parent
            if opened[tag] and at.parent is not None and at.tag == tag:
                here = leave(here, at.parent)
            continue
        attrs = _attributes(m[3])
        if tag in ("html", "body") and not any(isinstance(c, Node) and c.tag == "body" for c in root.children):
            if tag == "html":
                root.attrs = attrs
                continue
            here = leave(here, root)         # a body ends an open head
        elif tag in ("html", "body"):
            continue
        if tag in BLOCK:
            here = leave(here, closed(here, {"p"}, P_SCOPE))
        if tag in CLOSES:
            while (up := closed(here, CLOSES[tag], SCOPE[tag])) is not here:
                here = leave(here, up)
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            if tag == "textarea":
                node.children.append(entities.unescape(page[pos:end.start() if end else n]))
            pos = end.end() if end else n
        elif tag not in VOID:
            here = node
            opened[tag] += 1
    return root


def _holds_article(form: Node) -> bool:
    """Whether a form wraps an article: it has an article or main element, or much text in paragraphs."""
    chars, todo = 0, [(form, False)]
    while todo:
        node, inside = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip()) if inside else 0
            elif c.tag in ("article", "main"):
                return True
            elif c.tag == "form" or c.tag not in NEVER:
                todo.append((c, inside or c.tag == "p"))
    return chars >= SHORT


def _cut(node: Node, inside: bool, rule: int = 0) -> bool:
    """Whether an element is never part of an article; inside: it stands in an article or main element.  Rule 0 looks at all
    words of class and id, 1 at names that are one such word, 2 at none of them."""
    a, tag = node.attrs, node.tag
    if (tag in NEVER and not (tag == "form" and _holds_article(node))) or (tag == "header" and not inside):
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return tag not in ("html", "body")
    if a.get("role", "").lower() in ROLES:
        return True
    if tag in CONTENT or tag in HEADING:
        return tag == "article" and bool({"comment", "comments", "reply"} & _names(a))
    if rule == 2:
        return False
    perhaps = PERHAPS - {"header"} if inside else PERHAPS
    whole = {x.lower() for x in f"{a.get('class', '')} {a.get('id', '')}".split()}
    if LIKELY & whole:
        return False
    if (BESIDE | perhaps) & whole:
        return True
    if rule == 1:
        return False
    names = _names(a)
    if BESIDE & names:
        return True
    links = _density(node)
    return bool(perhaps & names and (links > 0.25 or node.chars < PROSE)) or bool(LINKED & names and links > 0.5)


def _names(a: dict) -> set:
    """Words of class and id, without those that say what an element has or lacks (has-sidebar, page-with-comments)."""
    return {w.lower() for w in WORD.findall(HAS.sub(" ", f"{a.get('class', '')} {a.get('id', '')}"))}


def _prune(root: Node, rule: int = 0) -> list[Node]:
    """Cuts what is never article and lists the elements left, parents first."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        out.append(node)
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _cut(c, inside, rule)]
        todo += [(c, inside) for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _elements(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters of each element's text and those inside links."""
    for node in reversed(nodes):
        node.chars = node.linked = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
            else:
                node.chars += c.chars
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.chars


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _is_paragraph(node: Node) -> bool:
    if node.tag in PARAGRAPH:
        return True
    return node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in node.children)


def _commas(node: Node) -> int:
    return sum(sum(c.count(x) for x in ",،、，") for c in node.children if isinstance(c, str)) + sum(
        _commas_inline(c) for c in node.children if isinstance(c, Node) and c.tag not in BLOCK)


def _commas_inline(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        at = todo.pop()
        for c in at.children:
            if isinstance(c, str):
                total += sum(c.count(x) for x in ",،、，")
            elif c.tag not in BLOCK:
                todo.append(c)
    return total


def best_container(nodes: list[Node]) -> tuple[Node, list[Node | str]]:
    """The best-scored container and the siblings (elements and bare text) kept with it, in page order."""
    for node in nodes:
        if not _is_paragraph(node) or not node.chars:
            continue
        points = (1 + _commas(node) + min(node.chars / 100, 3)) * min(1.0, node.chars / 25) * (1 - _density(node))
        up, level = node.parent if node.tag in PARAGRAPH else node, 0
        while up is not None and level < LEVELS:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    best = None
    for node in nodes:
        final = node.score * (1 - _density(node))
        node.score = final
        if final > 0 and (best is None or final > best.score):
            best = node
    if best is None:
        return nodes[0], [nodes[0]]
    at = best
    while at is not None:                    # an article or main element around the best container is the article
        if at.tag in ("article", "main"):
            best = at
            break
        at = at.parent
    if best.parent is None:
        return best, [best]
    kept = []
    for c in best.parent.children:
        if isinstance(c, str):
            good = c.strip() != ""
        elif c is best or c.tag in HEADING:
            good = True
        elif c.tag in ("div", "section", "form"):
            # another part of the article: prose, or a box of one that scored
            bonus = 0.2 * best.score if c.attrs.get("class") and c.attrs.get("class") == best.attrs.get("class") else 0.0
            good = _density(c) < 0.3 and (c.chars >= 2 * PROSE or c.score + bonus >= max(10.0, 0.2 * best.score))
        else:
            good = c.chars > 0 and (_density(c) < 0.5 if c.tag in BLOCK else True)
        if good:
            kept.append(c)
    return best, kept


def _blocks(kept: list[Node | str]) -> list[str]:
    """The text of each block, all of it; white space inside one is a space."""
    out, buffer = [], []

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append(text)

    todo = list(reversed(kept))
    while todo:
        at = todo.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            buffer.append(at)
        elif at.tag == "br":
            buffer.append(" ")
        else:
            if at.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(at.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    text = ""
    for rule in range(3):
        root = parse(page)
        _measure(_elements(root))             # names are judged with what the element holds
        nodes = _prune(root, rule)
        _measure(nodes)
        _, kept = best_container(nodes)
        found = "\n\n".join(_blocks(kept))
        # a second look has to find far more than the first one
        if not text or len(found) >= max(SHORT, 4 * len(text)):
            text = found
        if len(text) >= SHORT:
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html); n_chars counts code points."""
    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
