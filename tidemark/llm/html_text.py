"""HTML extraction by tree scoring.

A page is read into a tree of its block elements. Every paragraph earns points: one, one for each comma, and up to three for its
length, less its share of links; they go to its container in full and to each ancestor above by `DECAY` less. Elements that by
their element, role, class or id look like boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments) are
suspects: a suspect goes only if the page has paragraphs enough without it. One that a weak sign marks (a word somewhere in a
class) stays if it holds more of the paragraph points than all the rest; one that its element, role or whole class names, if it
holds `SPARE` times the rest. They are judged from the page's end to its start, first those of a clear sign with at most a share of
1 / (SPARE + 1) of the points, then the other clear ones, then the weak ones; points that went no longer count.

A container's points are discounted by its link density. The best container is kept, with the `article` or `main` around it,
and those of its siblings that score a fifth of it or read like running text or a heading. Its blocks are the text.

Blocks are the runs of text between the tags of block elements. Character references are decoded, white space (as str.split()
has it) becomes one space, and blocks are joined in page order by a newline. Inline tags go; a line break counts as a space.

Defined results: a null or empty page, or one without text, gives an empty text; so does a page whose every text is in one menu,
script, style or other element of `GONE`. Unclosed and unmatched tags are mended as browsers do roughly: a block start ends an
open paragraph, an end tag closes what is open inside. A tag or comment that the page's end cuts off is dropped. Rows that repeat
are all kept; extra columns are dropped. An empty table gives an empty result. Pages of any length and depth are read whole, in
time proportional to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, trimmed

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
TOKEN = re.compile(r"""<(?:!--(?P<comment>)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<odd>/?[a-zA-Z!?])[^>]*+>)""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=>/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr "
    "nav header footer aside form fieldset legend button select option optgroup menu dialog details summary center hgroup template svg canvas object video audio".split()
)
GONE = frozenset("nav button select option menu dialog template svg canvas object video audio head".split())
CUT = frozenset("footer aside form fieldset header".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay "
    "share sharing social related recommended recommendations widget widgets pagination pager toolbar skip".split()
)
KEEP_WORDS = frozenset("article entry post content main story body".split())
#: a word beside these tells of a page or box that has, or has not, the thing; so does a modifier after "--"
ABOUT = frozenset("has have with without no not is hide show page layout theme".split())
DECAY = 0.45
SPARE = 9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())


class Node:
    __slots__ = ("tag", "parent", "sign", "inside", "gone", "chars", "links", "n_links", "points", "own", "held", "kept", "menu")

    def __init__(self, tag: str, parent: Node | None, sign: int = 0):
        self.tag, self.parent, self.sign = tag, parent, sign
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.gone = sign == 3 or parent is not None and parent.gone
        self.chars = self.links = self.n_links = 0
        self.points = self.own = self.held = 0.0
        self.kept = self.menu = False

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0

    def above(self) -> Iterator[Node]:
        n = self
        while n is not None:
            yield n
            n = n.parent


def suspicion(tag: str, attrs: str, inside: bool) -> int:
    """3: never text, 2: boilerplate by element, role or a whole class or id, 1: by a word in one, 0: none.

    inside: within an article or main, whose own header holds its title.
    """
    if tag in GONE:
        return 3
    found = 2 if tag in CUT and not (tag == "header" and inside) else 0
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return found
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            found = 2
        elif name == "role" and value in CUT_ROLES:
            found = 2
        elif name in ("class", "id") and tag not in ("body", "html", "main"):
            for part in value.split():
                words = [w for w in re.split(r"[^a-z]+", part) if w]
                if "--" in part or ABOUT.intersection(words):
                    continue
                keep = KEEP_WORDS.intersection(words)
                if any(w in CUT_WORDS for w in words) or "header" in words and not inside and not keep:
                    found = max(found, 2 if len(words) == 1 or not keep and words[-1] in CUT_WORDS else 1)
    return found


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int, int]]]:
    """The nodes, parents first, and the blocks (node, text, characters in links, links) that are not gone."""
    root = Node("", None)
    nodes, blocks, stack = [root], [], [root]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = n_links = link = 0

    def flush() -> None:
        nonlocal linked, n_links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            top = stack[-1]
            if text and not top.gone:
                blocks.append((top, text, min(linked, len(text)), n_links))
        linked = n_links = 0

    def close(to: int) -> None:
        flush()
        opened.subtract(n.tag for n in stack[to:])
        del stack[to:]

    def put(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].gone:
            pieces.append(text)
            if link:
                linked += len(text.strip())

    at, end, last = 0, len(page), page.rfind(">") + 1  # no tag ends after `last`
    while at < end:
        m = TOKEN.search(page, at, last)
        if m is None:
            cut = re.compile(r"<[a-zA-Z/!?]").search(page, at)
            put(page[at : cut.start() if cut else end])
            break
        put(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        if m["odd"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCKS:
                if opened[name]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
                else:
                    flush()
                link = 0
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                at = end
            else:
                gone = page.find(">", stop.end())
                at = end if gone < 0 else gone + 1
            continue
        if name == "a":
            link = 1
            n_links += 1
        elif name in ("br", "wbr"):
            put(" " if name == "br" else "")
        elif name in BLOCKS:
            flush()
            link = 0
            if name == "hr":
                continue
            closes = CLOSES.get(name)
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i].tag
                if tag == "p" or tag in HEADINGS and name in HEADINGS or closes and tag in closes:
                    close(i)
                    break
                if tag in LISTS or tag not in ("p", "li", "dt", "dd", "td", "th", "tr") and not (closes and name in ("tr", "td", "th") and tag in ("tbody", "thead", "tfoot")):
                    break
            top = stack[-1]
            node = Node(name, top, suspicion(name, m["attrs"], top.inside or top.tag in ("article", "main")))
            nodes.append(node)
            stack.append(node)
            opened[name] += 1
    flush()
    return nodes, blocks


def worth(node: Node, text: str, linked: int) -> float:
    """The points of a paragraph."""
    if len(text) < 25 and node.tag != "p" or node.tag in HEADINGS:
        return 0.0
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def cut(nodes: list[Node], blocks: list[tuple[Node, str, int, int]]) -> None:
    """Marks suspects, and all below them, as gone, from the page's end to its start: small ones of a clear sign first, weak signs last."""
    for node, text, linked, _ in blocks:
        node.own += worth(node, text, linked)
    total = sum(n.own for n in nodes)
    for sign, spare, most in ((2, SPARE, total / (SPARE + 1)), (2, SPARE, total), (1, 1, total)):
        for n in nodes:
            n.held = 0.0 if n.gone else n.own
        for n in reversed(nodes):
            if n.sign == sign and not n.gone and n.held <= most and not n.held > spare * (total - n.held) + 1e-9:
                total -= n.held
                n.gone, n.held = True, 0.0
            if n.parent is not None:
                n.parent.held += n.held
        for n in nodes:
            n.gone = n.gone or n.parent is not None and n.parent.gone


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    cut(nodes, blocks)
    blocks = [b for b in blocks if not b[0].gone]
    if not blocks:
        return ""
    for node, text, linked, n_links in blocks:
        node.chars += len(text)
        node.links += linked
        node.n_links += n_links
        first = node.parent if node.tag in ("p", "li", "blockquote", "pre", "td") and node.parent else node
        first.points += worth(node, text, linked)
    for n in reversed(nodes):
        if n.parent is not None and not n.gone:
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.n_links += n.n_links
            n.parent.points += DECAY * n.points
    held = [n for n in nodes if not n.gone and n.chars]
    for n in held:
        n.points *= 1 - n.density()
    best = max(reversed(held), key=lambda n: (n.points, n.chars - n.links))  # of equals the innermost
    for n in best.above():
        if n.tag in ("article", "main"):
            best = n
            if n.tag == "article":
                break
    best.kept = True
    own = best.parent
    if own is not None:
        for n in held:
            if n.parent is own and n is not best:
                prose = n.tag == "p" and n.chars > 80 and n.density() < 0.25
                title = n.tag in HEADINGS and n.density() < 0.5
                n.kept = n.points >= max(3, best.points / 5) or prose or title
    for n in nodes:
        if n.parent is not None:
            n.kept = n.kept or n.parent.kept
            # lists that are links alone are menus, wherever they stand
            n.menu = n.parent.menu or n.tag in LISTS and n.n_links >= 3 and n.density() > 0.8
    return "\n".join(text for node, text, _, _ in blocks if not node.menu and (node.kept or node is own and len(text) > 80))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(trimmed(run), SCHEMA)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
