"""Main text of web pages by a site style tree.

A page is read as a tree of elements.  An element is known by its path: the tags from the body down,
with classes and ids, digits left out, and its seed (below) if it has one.  Pages of a host are merged
by path into the site's style tree, in which every node has

* presentation importance: the entropy of the styles (sequences of child tags) with which pages show
  it, to the base of the number m of pages that have it;
* content importance, from the text blocks at or below it: 1 less the mean of log(n)/log(m) over its
  distinct blocks, n the number of pages that hold the block there;
* entropy: content importance for nodes without children; else (1 - g^l) * presentation + g^l *
  content importance, g = 0.9, l its mean number of children; not told where fewer than PAGES pages have it;
* importance: PRIORS[seed] * entropy; where that is not told 1, or 0 for nodes with a seed.

A branch is removed if its importance is below LOW; nothing but silent elements (scripts, styles, form
controls and the like) goes any other way.  Seeds say what html and its authors tell of an element: 2 for
furniture by tag, role or a name made of furniture words alone (menus, page headers, footers, sidebars,
notices, adverts, forms, comments), and for what lies outside the article or main element of a page that
has one; 1 for names that may mean something else (class "share", or a furniture word among others, as in
"menu-planning"), which entropy saves where pages show it in different ways with different text.

Names do not count on an element that holds an article (not one within an article) or main, nor, inside
one, on a heading or an element that holds an h1 (or, for words of headers, any heading); and if they leave
a page without text, they do not count on that page.  Bare running text and headings inside article or main,
and these two themselves, are kept however often a host repeats them, and branches without a seed stay on
a page if less than LEFT of its text would be left, so that copies of an article are not lost.

Html is never shuffled: one pass counts, aggregated within tasks first, another removes.  Only those nodes
go to the second whose importance removes what has no seed or keeps what has one (names that differ on
every page make no such nodes, being on too few pages for entropy to tell): by broadcast if they are few,
else by a salted join on the host.  Reading takes time in proportion to the page, whatever it holds.

Defined results: null and empty html has an empty text; a null url is a host of its own; unclosed and
stray tags are taken as HTML does (a tag that never ends takes the rest of the page with it); character
references are decoded as HTML5 does; repeated rows are pages each; very long pages are read whole; text
counts for the REACH elements around it; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, salted_join

LOW, PAGES, DECAY = 0.25, 4, 0.9
#: The share of a page's text that entropy alone must leave.
LEFT = 0.1
#: What the entropy of a node counts for, by its seed.
PRIORS = (1.0, 0.4, 0.2)
#: Elements around a text block, from the innermost, for whose content it counts.
REACH = 64
#: Characters of a path; longer ones are known by their hash.
PATH = 240
#: Hosts' branches that are broadcast at most.
BROADCAST_ROWS = 50_000
#: Counts a task holds before it hands them on.
HELD = 200_000

# HTML's void elements, those whose content is no text of the page, block-level
# elements, and elements that an opening tag of the same group closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title head button option datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr".split())
#: Silent elements that cannot hold an article or main, so that one ends them; the first two end at any block-level tag.
NARROW = ("svg", "math", "button", "select", "option", "optgroup", "datalist")
#: Elements of svg and math that hold html.
EMBEDDING = frozenset(["foreignobject", "desc", "annotation-xml"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section div body".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tbody thead tfoot tr td th b i em strong a span code br figure figcaption section article main".split())
#: Words of names: those of furniture, those that may mean something else, and those that only say where or what kind of box.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promotion sidebar sidebars aside menu menus nav navs navbar navigation breadcrumb breadcrumbs footer footers masthead topbar header cookie cookies consent gdpr"
    " notice notices notification notifications alert alerts popup popups modal newsletter related recommended recommendations comment comments commentlist disqus reply replies respond toolbar pagination pager".split()
)
WEAK = frozenset("side share sharing search social subscribe subscription signup login widget widgets overlay".split())
PLACES = frozenset("page site main top bottom left right primary secondary inner outer wrapper wrap container content area section block box bar list item items links link row col column posts articles form button buttons text title global mobile desktop sticky fixed has with and post entry layout results count thread form field".split())
HEADERS = frozenset(["header", "masthead"])

_NAME = r"[a-zA-Z][^\s/>]*+"
# A tag, attribute by attribute and without going back, so that a failed match costs one reading.
_TAG = re.compile(rf"""<(/?)({_NAME})((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?)?|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
_DIGITS = re.compile(r"\d+")
_PIECES = re.compile(r"[^\W_]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


def seed_of(names: str, headed: bool = False) -> int:
    """The seed by an element's class or id: 2 for furniture, 1 where entropy is to tell, 0; words of headers say nothing of an element with headings."""
    most = 0
    for token in names.split():
        pieces = [_DIGITS.sub("", x).lower() for x in _PIECES.findall(_HUMPS.sub("-", token))]
        pieces = [x for x in pieces if x and not (headed and x in HEADERS)]
        strong, weak = any(x in STRONG for x in pieces), any(x in WEAK for x in pieces)
        known = all(x in STRONG or x in WEAK or x in PLACES for x in pieces)
        if known and (strong or (weak and len(pieces) > 1)):
            most = 2
        elif strong or (known and weak):
            most = max(most, 1)
    return most


class Node:
    """sure: furniture by its tag or role or those around it; seed and path are set once the page is read."""

    __slots__ = ("block", "children", "cut", "in_article", "label", "main", "named", "own", "parent", "path", "scope", "seed", "sure", "tag")

    def __init__(self, tag: str, label: str, parent: "Node | None", own: bool, named: str, scope: int) -> None:
        self.tag, self.label, self.parent, self.own, self.named, self.scope = tag, label, parent, own, named, scope
        self.sure = own or (parent is not None and parent.sure)
        self.main = tag in MAIN or (parent is not None and parent.main)
        self.in_article = parent is not None and parent.main and (parent.tag == "article" or parent.in_article)
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.children: list[str] = []
        self.seed, self.cut, self.path = 0, False, label

    def sets_path(self) -> None:
        label = f"{self.label}~{self.seed}" if self.seed else self.label
        path = f"{self.parent.path}>{label}"
        self.path = path if len(path) <= PATH else "#" + xxhash.xxh64_hexdigest(path)


def _opened(tag: str, attributes: str, parent: Node, scope: int) -> Node:
    label, named, own = tag, "", tag in NOISE_TAGS or (tag == "header" and not parent.main)
    if attributes and "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if name.lower() == "role":
                own = own or value.lower() in NOISE_ROLES
            else:
                if tag not in ("body", "html", "article", "main"):
                    named += " " + value
                label += "." + _DIGITS.sub("", " ".join(value.split()))
    return Node(tag, label, parent, own, named, scope)


def _judge(nodes: list[Node], found: list[tuple[Node, list]]) -> None:
    """Sets seeds and paths, parents first."""
    central: set[Node] = set()
    titled: set[Node] = set()
    headed: set[Node] = set()

    def mark(marked: set[Node], node: Node | None, inside: bool) -> None:
        while node is not None and node not in marked and (node.main or not inside):
            marked.add(node)
            node = node.parent

    for node in nodes:
        if node.tag in MAIN and not node.sure and not node.in_article:  # not comments or cards in an article
            mark(central, node.parent, False)
        elif node.main and node.tag in HEADINGS:
            mark(headed, node, True)
            if node.tag == "h1":
                mark(titled, node, True)
    for node in nodes[1:]:
        if node.named and node not in central and node not in titled and not (node.main and node.tag in HEADINGS):
            node.seed = seed_of(node.named, node in headed)
        if node.own or (central and not node.main and node not in central and node.parent in central):
            node.seed = 2
            node.named = ""
        node.sets_path()
    if central:  # text beside the article or main, in an element of its own
        for k, (home, pieces) in enumerate(found):
            if home in central:
                beside = Node("#text", "#text", home, False, "", 0)
                beside.seed = 2
                beside.sets_path()
                nodes.append(beside)
                found[k] = (beside, [(beside, raw) for _, raw in pieces])


class _Hidden:
    """The elements open from the outermost silent one on."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}

    def last(self, tag: str) -> int:
        at = self.at.get(tag)
        return at[-1] if at else -1

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.at[self.open.pop()].pop()

    def takes(self, tag: str, closing: bool, closed: bool) -> bool:
        """Keeps the elements at a tag; whether the tag is theirs."""
        if closing:
            if (k := self.last(tag)) < 0:
                return False
            self.cut(k)
            return True
        # Implied ends: an option by the next one, a select by a control or table part, others by what they cannot hold.
        chosen = self.last("select")
        if tag in ("option", "optgroup"):
            ends = [k for t in (("option",) if tag == "option" else ("option", "optgroup")) if self.at.get(t) for k in self.at[t][-1:] if k > chosen]
            if ends:
                self.cut(min(ends))
        elif chosen >= 0 and tag in ("select", "input", "td", "th", "tr"):
            self.cut(chosen)
            if tag in ("select", "input"):
                return True
        elif self.open and tag in BLOCKS and not any(self.at.get(t) for t in EMBEDDING):
            narrow = NARROW if tag in MAIN else NARROW[:2]
            firsts = [self.at[t][0] for t in narrow if self.at.get(t)]
            if firsts and not any(self.last(t) > min(firsts) for t in SILENT if t not in narrow):
                self.cut(min(firsts))
        if not self.open and tag not in SILENT:
            return False
        if tag not in VOID and not closed:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(tag)
        return True


def blocks(page: str | None) -> tuple[list[tuple[Node, list[tuple[Node, str]]]], list[Node]]:
    """The text blocks of a page in order, each with its element and its pieces (element, raw text), and all elements."""
    page = page or ""
    root = Node("body", "body", None, False, "", 0)
    stack, nodes = [root], [root]
    places: dict[str, list[int]] = {}
    found: list[tuple[Node, list[tuple[Node, str]]]] = []
    pieces: list[tuple[Node, str]] = []

    def flush() -> None:
        nonlocal pieces
        if any(not raw.isspace() for _, raw in pieces):
            found.append((pieces[0][0].block, pieces))
        pieces = []

    def text(raw: str) -> None:
        if raw:
            pieces.append((stack[-1], raw))

    def last(tag: str) -> int:
        at = places.get(tag)
        return at[-1] if at else 0

    def pop_to(k: int) -> None:
        while len(stack) > max(1, k):
            places[stack.pop().tag].pop()

    at, size = 0, len(page)
    hidden = _Hidden()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at and not hidden.open:
            text(page[at:start])
        if start == size:
            break
        mark = page[start + 1 : start + 2]
        if not (mark.isascii() and mark.isalpha()) and not (mark == "/" and page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha()):
            if mark and mark in "!?/":  # comments, sound or bogus
                end = page.find("-->", start + 2) if page.startswith("<!--", start) else page.find(">", start)
                at = size if end < 0 else end + (3 if page.startswith("<!--", start) else 1)
            else:
                if not hidden.open:
                    text("<")
                at = start + 1
            continue
        m = _TAG.match(page, start)
        if m is None:  # it never ends
            break
        at = m.end()
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        closed = attributes.endswith("/") or m[2].endswith("/")
        if tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = size if end is None else page.find(">", end.end()) + 1 or size
            continue
        if tag in ("html", "head", "body"):
            flush()
            if closing:
                hidden.cut(0)
            continue
        if (hidden.open or tag in SILENT) and hidden.takes(tag, closing, closed):
            continue
        if hidden.open or tag in SILENT:  # an end tag from outside: it ends the silent elements in its element
            if not places.get(tag):
                continue
            hidden.cut(0)
        if tag in BLOCKS:
            flush()
        if closing:
            if places.get(tag):
                pop_to(last(tag))
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        if tag in ENDS_P and last("p") > stack[-1].scope:
            pop_to(last("p"))
        if tag in CLOSES:
            ends = [k for t in CLOSES[tag] if (k := last(t)) > stack[-1].scope]
            if ends:
                pop_to(min(ends))
        node = _opened(tag, attributes, stack[-1], stack[-1].scope)
        stack[-1].children.append(tag)
        nodes.append(node)
        if not closed or tag in BLOCKS:
            if tag in SCOPES:
                node.scope = len(stack)
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    _judge(nodes, found)
    return found, nodes


def _text(raws: list[str]) -> str:
    return " ".join(entities.unescape("".join(raws)).split())


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(page: str | None, overruled: frozenset[str] | set[str] = frozenset()) -> str:
    """The page's blocks without branches of low importance, one to a line; overruled: paths of nodes whose importance is low without a seed, or not low with one."""
    found, nodes = blocks(page)

    def low(n: Node) -> bool:
        if n.seed:
            return n.path not in overruled
        bare = n.tag in MAIN or (n.label == n.tag and n.tag in RUNNING)
        return n.path in overruled and n.tag in BLOCKS and not (n.main and bare)

    def kept(cut: Callable[[Node], bool]) -> list[str]:
        for n in nodes[1:]:  # parents come before their children
            n.cut = n.parent.cut or cut(n)
        texts = (_text([raw for node, raw in pieces if not node.cut]) for home, pieces in found if not home.cut)
        return [t for t in texts if t]

    out = kept(low)
    if overruled and any(not n.seed and low(n) for n in nodes):
        seeded = kept(lambda n: bool(n.seed) and low(n))
        if sum(map(len, out)) < LEFT * sum(map(len, seeded)):
            out = seeded
    return "\n".join(out or kept(lambda n: bool(n.seed) and not n.named and low(n)))


def page_counts(page: str | None) -> set[tuple[str, int, str, int, int]]:
    """(path, seed, kind, value, children) of a page, each once: kind s has a style's hash, u that of a block of text at or below the element.

    Elements within a block count only if they have a seed, since entropy alone removes none of them.
    """
    found, nodes = blocks(page)
    own = {(n.path, n.seed, "s", xxhash.xxh64_intdigest(" ".join(n.children)) - 2**63, len(n.children)) for n in nodes if n.seed or n.tag in BLOCKS}

    def below(node: Node | None, raws: list[str], to: Node | None) -> None:
        if not (text := _text(raws)):
            return
        h = xxhash.xxh64_intdigest(text) - 2**63
        for _ in range(REACH):
            if node is to or node is None:
                return
            if node.seed or node.tag in BLOCKS:
                own.add((node.path, node.seed, "u", h, 0))
            node = node.parent

    for home, pieces in found:
        below(home, [raw for _, raw in pieces], None)
        for node, raw in pieces:
            if node is not home:
                below(node, [raw], home)
    return own


def counts(pages: DataFrame) -> DataFrame:
    """(host, path, seed, kind, value, pages, total) over all pages of a host; total sums children of styles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "path", "seed", "kind", "value", "pages", "total"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(*key[:5], n, n * key[5]) for key, n in held.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((host, *x) for x in page_counts(page))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = pages.mapInArrow(run, "host string, path string, seed int, kind string, value long, pages long, total long")
    return counted.groupBy("host", "path", "seed", "kind", "value").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"))


def style_tree(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(host, path, seed, pages, presentation, content, importance) of every node of every host's style tree."""
    counted = counts(pages.select(F.col(host_col).alias("host"), F.col(html_col).cast("string").alias("html")))
    on_pages = pages.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("m"))
    n, kind = F.col("pages"), F.col("kind")
    when = lambda k, x: F.when(kind == k, x)
    node = counted.groupBy("host", "path", "seed").agg(
        F.sum(when("s", n)).alias("shown"),
        F.sum(when("s", n * F.ln(n))).alias("spread"),
        F.sum(when("s", F.col("total"))).alias("children"),
        F.count(when("u", n)).alias("below"),
        F.sum(when("u", F.ln(n))).alias("repeats"),
    )
    node = node.join(on_pages, "host")
    m = F.least("shown", "m")
    presentation = F.when(m <= 1, 1.0).otherwise((F.ln("shown") - F.col("spread") / F.col("shown")) / F.ln(F.greatest("shown", F.lit(2))))
    content = F.when((m <= 1) | (F.col("below") == 0), 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("repeats") / F.col("below") / F.ln(F.greatest(m, F.lit(2)))))
    keep = F.pow(F.lit(DECAY), F.col("children") / F.col("shown"))
    node = node.withColumns({"presentation": presentation, "content": content})
    entropy = F.when(F.col("children") == 0, F.col("content")).otherwise((1 - keep) * F.col("presentation") + keep * F.col("content"))
    prior = F.element_at(F.array(*map(F.lit, PRIORS)), F.col("seed") + 1)
    importance = F.when(m >= PAGES, prior * entropy).otherwise(F.when(F.col("seed") == 0, 1.0).otherwise(0.0))
    return node.select("host", "path", "seed", m.alias("pages"), "presentation", "content", importance.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every page."""
    tables = Tables(pages.sparkSession)
    kinds = dict(pages.dtypes)
    hosted = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("html"), _host(url_col).alias("host"))
    overruled = style_tree(hosted).where(((F.col("importance") < LOW) == (F.col("seed") == 0)) & (F.col("path") != "body")).select("host", "path")
    overruled = tables.keep(overruled, "overruled")
    by_host = overruled.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("overruled"))
    joined = hosted.join(F.broadcast(by_host), "host", "left") if overruled.count() <= BROADCAST_ROWS else salted_join(hosted, by_host, ["host"], id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                key = tuple(paths or ())
                if key not in sets:
                    if len(sets) > 4096:
                        sets.clear()
                    sets[key] = frozenset(key)
                texts.append(main_text(page, sets[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return joined.select(id_col, url_col, "html", "overruled").mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string")
