"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import over_batches

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset(
    "script style noscript template iframe object embed svg canvas video audio map form button input select option optgroup textarea "
    "label fieldset legend nav footer aside menu dialog head title".split()
)
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption header footer nav aside address hr br details summary center hgroup".split()
)
#: Elements whose text counts as a paragraph.
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
#: An opening tag of the key ends an open element of the value.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: These stop the search for an element to end.
SCOPES = frozenset("ul ol dl table article section div main body html".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - frozenset(["br", "html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"])
#: Words of class, id and role that mark parts around an article; those that also name layouts, which count only
#: where no word of TOWARDS stands beside them; words that mark an article.
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|contentinfo|cookies?|consent|disqus|foot(?:er)?|gdpr|"
    r"masthead|menu|modal|nav\w*|newsletter|notices?|pager|pagination|popup|promo\w*|replies|sharing|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-]|\d)",
    re.I,
)
LAYOUT = re.compile(r"(?:^|[\s_-])(?:header|related|search|share|side(?:bar)?|skip|social|tags)(?=$|[\s_-]|\d)", re.I)
TOWARDS = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?=$|[\s_-])", re.I)

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z))", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "items", "names", "dropped", "score", "n_text", "n_link", "commas")

    def __init__(self, tag: str, up: Node | None, names: str = "", dropped: bool = False):
        self.tag, self.up, self.names, self.dropped = tag, up, names, dropped
        self.items: list[Node | str] = []
        self.score = 0.0
        self.n_text = self.n_link = self.commas = 0


def tree(page: str) -> Node:
    """The elements of a page; unclosed and stray tags are tolerated, comments are left out."""
    root = at = Node("#root", None)
    pos, n = 0, len(page)
    while pos < n:
        found = _TAG.search(page, pos)
        if not found:
            rest = page[pos:]
            at.items.append(rest)
            break
        if found.start() > pos:
            at.items.append(page[pos : found.start()])
        pos = found.end()
        name = found[2]
        if not name:
            continue
        if not found[4]:  # the page was cut within a tag
            break
        name = name.lower()
        if found[1]:
            to = at
            while to is not root and to.tag != name:
                to = to.up
            if to is not root:
                at = to.up
            elif name == "p":
                at.items.append(Node("p", at))
            continue
        if name in ENDS or name in ENDS_P:
            ends, to = ENDS.get(name, ()), at
            while to is not root and to.tag not in SCOPES:
                if to.tag in ends or to.tag == "p" and name in ENDS_P:
                    at = to.up
                    break
                to = to.up
        attributes = found[3]
        names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
        node = Node(name, at, names, name in OUTSIDE or bool(attributes and _HIDDEN.search(attributes)))
        at.items.append(node)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = close.end() if close else n
            continue
        at = node
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Kept elements, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            yield node
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]


def _leave_out(root: Node) -> None:
    """Drops parts whose names or kind say that they surround an article."""
    for node in _walk(root):
        named = node.tag not in ("html", "body", "article", "main", "#root") and node.names
        if node.tag == "header":
            up = node.up
            while up is not None and up.tag not in ("article", "main"):
                up = up.up
            node.dropped = up is None
        if named and (AWAY.search(named) or LAYOUT.search(named) and not TOWARDS.search(named)):
            node.dropped = True


def _measure(nodes: list[Node]) -> None:
    """Lengths, link lengths and commas of each element's whole text, and the paragraphs' points for their ancestors."""
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, str):
                node.n_text += len(x.strip())
                node.commas += x.count(",")
            elif not x.dropped:
                node.n_text += x.n_text
                node.n_link += x.n_text if x.tag == "a" else x.n_link
                node.commas += x.commas
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(x, str) and len(x.strip()) > 25 for x in node.items)
        if node.tag in PARAGRAPHS and node.n_text or loose:
            points = (1 + node.commas + min(node.n_text / 100, 3)) * (1 - density(node))
            share, up = 1.0, node if loose else node.up
            for level in range(5):
                if up is None:
                    break
                up.score += points * share
                share, up = (0.5 if level == 0 else share * 2 / 3), up.up
    for node in nodes:
        if node.tag in ("article", "main"):
            node.score += 25
        elif node.names and TOWARDS.search(node.names):
            node.score += 10
        node.score *= 1 - density(node)


def density(node: Node) -> float:
    return min(1.0, node.n_link / node.n_text) if node.n_text else 0.0


def _kept(best: Node) -> list[Node]:
    """The best container and the siblings that read like parts of it, in page order."""
    if best.up is None:
        return [best]
    least, out = max(10.0, best.score * 0.2), []
    for x in best.up.items:
        if not isinstance(x, Node) or x.dropped:
            continue
        prose = x.tag == "p" and x.n_text > 80 and density(x) < 0.25
        if x is best or prose or x.tag not in ("ul", "ol", "table") and x.score >= least and density(x) < 0.5:
            out.append(x)
    return out


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts between the ends of blocks, white space still as in the page."""
    run: list[str] = []
    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            yield "".join(run)
            run.clear()
        elif isinstance(x, str):
            run.append(x)
        elif not x.dropped:
            if x.tag in BLOCKS:
                yield "".join(run)
                run.clear()
                todo.append(None)
            todo += reversed(x.items)
    yield "".join(run)


def main_text(page: str | None) -> str:
    """The article of a page as one line; empty where there is none."""
    if not page:
        return ""
    root = tree(page)
    _leave_out(root)
    nodes = list(_walk(root))
    _measure(nodes)
    best = max(nodes, key=lambda x: x.score, default=None)
    if best is None or best.score <= 0:
        best = next((x for x in nodes if x.tag in ("article", "main")), next((x for x in nodes if x.tag == "body"), root))
    clean = (_BLANK.sub(" ", html.unescape(x)).strip() for x in _blocks(_kept(best)))
    return " ".join(x for x in clean if x)


def extract(pages: DataFrame, col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of column ``col``, and ``n_chars``, its code points.

    Paragraphs score their length and commas for their ancestors, less with every level and with the share of
    link text; the best container and like siblings are kept, without menus, site headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and reader comments. Null, empty and text-free pages give an empty
    text; pages cut off within a tag keep what comes before. Rows are independent: repeated rows give repeated
    results, columns named text or n_chars are replaced and all others kept. No page is cut.
    """
    pages = pages.drop(*({"text", "n_chars"} - {col}))
    out = [f.name for f in pages.schema.fields if f.name not in ("text", "n_chars")]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(x) for x in batch.column(col).to_pylist()]
        columns = [batch.column(c) for c in out]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*out, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in out)
    return pages.mapInArrow(over_batches(work), ", ".join(filter(None, [fields, "text string, n_chars long"])))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``."""
    return extract(pages.select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
