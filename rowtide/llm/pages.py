"""Main text of web pages: page structure and site template removal.

Template removal: every element's subtree is hashed bottom-up (tag, class, texts and child hashes); Spark counts on how many
pages of a host each hash stands; container elements whose subtree recurs on many pages of their host are deleted. Running
text (paragraphs, headings, an article's own lists and tables) is never deleted for recurring: articles quote and copy each
other.

Structure: scripts, styles, menus and the like go by their tags. Forms, asides, roles, hidden elements and class names only hint at
what an element is: it stays if it holds half of the page's running text and no heading, ``main`` or ``article`` lies outside
it. Within an article or ``main``, names and asides need a second hint before they take text away, and lines of running text
never go by a name. What is left of the ``article`` elements is the text if that is most of what is left of ``main`` (or of the page), or if
the article has the heading; else what is left of ``main``, or of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import by_bytes
from rowtide.sources.shared import cut

#: A subtree is part of a host's template if it stands on so many pages, and on this share of them; where that would be more
#: than MANY pages, on MANY pages and this lower share.
LEAST_PAGES, SHARE, MANY, LOW_SHARE = 5, 0.4, 50, 0.01
#: Template hashes up to this many are broadcast (16 bytes each and the hosts' names); more are joined by shuffle, where the pages
#: of a host are dealt to SALTS tasks.
MOST_BROADCAST, SALTS = 100_000, 64

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|[!?][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button math mi mo mn ms mtext mrow msup msub mfrac msqrt".split())
#: Elements whose subtrees can be template, and those that can be it within an article too.
CONTAINERS = frozenset("div section ul ol dl table aside form figure nav header footer menu details fieldset center".split())
BOXES = frozenset("div section aside form nav header footer menu fieldset".split())
#: Elements without text of the page.
DROPPED = frozenset("head script style template nav footer button select datalist textarea iframe object svg canvas audio video noembed noframes title".split())
#: Elements that are no part of an article, unless they hold the page.
HINTED = frozenset("form dialog menu noscript aside".split())
#: Elements of running text: within an article they never go by their names, nor does what stands in their lines.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
FOREIGN = frozenset(("svg", "math"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments respond reply replies discussion disqus".split())
#: Words of a class or id that name what is not the article, if they lead or end the name.
NAMES = COMMENTS | frozenset(
    "nav navbar navigation menu submenu sidebar footer masthead header topbar toolbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager newsletter subscribe signup login search widget copyright".split()
)
#: Names that need no second hint within an article, if the whole class or id says nothing else but where or how it is put.
PLAIN_NAMES = COMMENTS | frozenset("nav navbar navigation submenu sidebar footer ad ads adv advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs pagination pager newsletter subscribe".split())
PUT = frozenset("box area block container wrapper list section bar unit slot links panel inner outer top bottom left right".split())
#: A name with one of these words tells what state the page is in ("has-sidebar", "comments-open"), not what the element is.
STATES = frozenset("has no with without is not open opened closed enabled disabled active inactive sticky fixed free".split())
#: What an opening tag closes if it is the innermost block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}


class Element:
    """An element with what it holds: texts and elements in order, characters of running text and of all text, main and article
    elements, h1, headings; ``inside``: an article holds it, ``within``: an article or main, ``line``: an element of running text."""

    __slots__ = ("attributes", "chars", "children", "digest", "headings", "inside", "line", "marks", "running", "tag", "titles", "trace", "within")

    def __init__(self, tag: str, attributes: dict[str, str], inside: bool, within: bool = False, line: bool = False):
        self.tag, self.attributes, self.inside, self.within, self.line = tag, attributes, inside, within, line
        self.children: list = []
        self.chars = 0
        self.trace: list[str] = [tag, attributes.get("class", "")]
        self.digest = self.running = 0
        self.marks = int(tag in ("article", "main") or attributes.get("role") == "main")
        self.titles = int(tag == "h1")
        self.headings = int(tag in ("h1", "h2", "h3"))


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)} if text.strip("/ \n") else {}


def _named(attributes: dict[str, str]) -> str | None:
    """The word of a class or id that names what is not the article."""
    for key in ("class", "id"):
        for name in attributes.get(key, "").split():
            words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
            if words and STATES.isdisjoint(words):
                for word in (words[0], words[-1]):
                    if word in NAMES:
                        return word
    return None


def _only_names(attributes: dict[str, str]) -> bool:
    """Whether a class or id says nothing but that this is no article: a plain name, or several names."""
    for key in ("class", "id"):
        for name in attributes.get(key, "").split():
            words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
            rest = [w for w in words if w not in PUT]
            if rest and all(w in NAMES for w in rest) and (len(rest) > 1 or rest[0] in PLAIN_NAMES):
                return True
    return False


def _goes(x: Element, root: Element) -> bool:
    """Whether an element of the page ``root`` is no part of the article.

    Within an article or main, a name alone takes no running text away: it needs a second hint (an element or role of the kind, or
    text that is mostly links), or must say nothing else.
    """
    if x.tag in ("html", "body", "main"):
        return False
    if x.tag in DROPPED:
        return not (x.tag == "button" and x.within and x.line)
    a, own_header = x.attributes, x.inside and x.headings > 0
    name = _named(a) if a else None
    if name == "header" and own_header:
        name = None
    tagged = x.tag in HINTED or x.tag == "header" and not own_header
    role = bool(a) and a.get("role", "").lower() in ROLES
    hidden = bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())
    hinted = tagged or role or name is not None
    if hinted and x.within:
        linked = x.chars > 2 * x.running
        named = name is not None and not x.line and x.tag not in LINES and (linked or tagged or role or _only_names(a))
        hinted = named or role or tagged and (x.tag != "aside" or linked)
    return (hinted or hidden) and not _holds_all(x, root, name)


def _holds_all(x: Element, root: Element, name: str | None = None) -> bool:
    if not 0 < root.running <= 2 * x.running:
        return False
    if root.marks + root.titles:
        return x.marks + x.titles == root.marks + root.titles
    return name not in COMMENTS  # without any mark, comments may be longer than the article


def parse(page: str) -> Element:
    """The page as a tree."""
    import xxhash

    root = Element("", {}, False)
    stack, articles, mains, lines, foreign = [root], 0, 0, 0, 0
    open_: Counter[str] = Counter()

    def close() -> None:
        nonlocal articles, mains, lines, foreign
        x = stack.pop()
        up = stack[-1]
        open_[x.tag] -= 1
        articles -= x.tag == "article"
        mains -= x.tag == "main" or x.attributes.get("role") == "main"
        lines -= x.tag in LINES
        foreign -= x.tag in FOREIGN
        x.digest = xxhash.xxh64_intdigest("\0".join(x.trace)) - (1 << 63)
        x.trace = []
        up.trace.append(str(x.digest))
        up.children.append(x)
        if x.tag in DROPPED or x.tag == "aside" and not x.within:
            return
        up.chars += x.chars
        if x.tag != "a":
            up.running += x.running
        up.headings += x.headings
        if x.tag != "header" or x.inside or x.marks:
            up.marks += x.marks
            up.titles += x.titles

    def text(raw: str) -> None:
        if raw:
            shown = entities.unescape(raw) if "&" in raw else raw
            words = shown.split()
            stack[-1].children.append(shown)
            stack[-1].trace.append(" ".join(words))
            n = sum(map(len, words))
            stack[-1].running += n
            stack[-1].chars += n

    at = 0
    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            close()
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break  # the end of an inline element does not close blocks
            continue
        if tag not in INLINE:
            ends = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    if not CLOSES.get(tag, set()) & {y.tag for y in stack[-1:]}:
                        break
                elif stack[k].tag not in INLINE:
                    break
        if tag in VOID:
            stack[-1].children.append("" if tag in INLINE else " ")
            stack[-1].trace.append(tag)
            continue
        stack.append(Element(tag, _attributes(m[3]), articles > 0, articles + mains > 0, lines > 0))
        open_[tag] += 1
        articles += tag == "article"
        mains += tag == "main" or stack[-1].attributes.get("role") == "main"
        lines += tag in LINES
        foreign += tag in FOREIGN
        ended = m[3].endswith("/")
        if tag in RAW and not foreign:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            if end[0] or not ended:
                stack[-1].trace.append(page[at : end.start()])
                at = end.end()
            close()
        elif ended and (foreign or tag in DROPPED):
            close()  # nothing of the page can be meant to stand in it
    text(page[at:])
    while len(stack) > 1:
        close()
    return root


def digests(root: Element) -> set[int]:
    """Hashes of the page's subtrees that may be template."""
    out, todo = set(), [root]
    while todo:
        x = todo.pop()
        if x.tag in (BOXES if x.inside else CONTAINERS):
            out.add(x.digest)
        todo.extend(y for y in x.children if not isinstance(y, str))
    return out


def article_text(root: Element, templates: frozenset[int] = frozenset()) -> str:
    """The main text of a page, without subtrees in ``templates``."""

    def stays(x: Element) -> bool:
        if x.digest in templates and x.tag in (BOXES if x.inside else CONTAINERS) and not (root.marks + root.titles and _holds_all(x, root)):
            return False
        return not _goes(x, root)

    def shown(elements: list[Element]) -> str:
        out: list[str] = []
        todo: list = list(reversed(elements))
        chosen = set(map(id, elements))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif id(x) in chosen or stays(x):
                if x.tag not in INLINE:
                    out.append(" ")
                    todo.append(" ")
                todo.extend(reversed(x.children))
            else:
                out.append(" ")
        return " ".join("".join(out).split())

    articles, mains, titled = [], [], False  # titled: an h1 outside the articles
    todo = [(root, False)]
    while todo:
        x, in_main = todo.pop()
        if x is not root and not stays(x):
            continue
        if x.tag == "article":
            articles.append(x)
            continue
        if not in_main and (x.tag == "main" or x.attributes.get("role") == "main"):
            mains.append(x)
            in_main = True
        titled |= x.tag == "h1"
        todo.extend((y, in_main) for y in reversed(x.children) if not isinstance(y, str))
    whole = shown(mains or [root])
    if not articles:
        return whole
    headed = [x for x in articles if x.titles]
    if len(headed) == 1 and 2 * headed[0].running >= sum(x.running for x in articles):
        articles = headed
    text = shown(articles)
    return text if 2 * len(text) >= len(whole) or not titled and any(x.headings for x in articles) else whole


def _pages(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("html").to_pylist()]


def templates(pages: DataFrame) -> DataFrame:
    """(host, digest) of the subtrees that recur on many pages of their host.

    ``pages``: host, html. Pages without a host (null) have no template; equal pages of a host count once. Counts are added up
    before the shuffle, and their key holds the hash, so a host with a third of all pages is spread.
    """

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                hosts, numbers, found = [], [], []
                for host, number, page in zip(part.column("host").to_pylist(), part.column("_page").to_pylist(), _pages(part), strict=True):
                    own = digests(parse(page))
                    found += own
                    hosts += [host] * len(own)
                    numbers += [number] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(numbers, pa.int64()), pa.array(found, pa.int64())], ["host", "page", "digest"])

    known = pages.where("host is not null").withColumn("_page", F.xxhash64("html"))
    sizes = known.groupBy("host", "_page").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    found = known.select("host", "_page", "html").mapInArrow(found_in, "host string, page long, digest long").distinct()
    counts = found.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= LEAST_PAGES)
    enough = F.least(F.col("pages") * SHARE, F.greatest(F.lit(float(MANY)), F.col("pages") * LOW_SHARE))
    return counts.join(sizes, "host").where(F.col("on") >= enough).select("host", "digest")


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` (url, html) with ``text`` and ``n_chars`` (code points); columns of these names are replaced.

    Null html gives the empty text; a url without a host keeps its page out of template removal; repeated rows are pages of
    their own, but evidence of a template only once. An empty table gives an empty result. A host's list of template hashes is
    bounded: each stands on a share of its pages.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hosted = pages.select(*kept, F.when(F.length(host) > 0, host).alias("_host"))
    found = cut(templates(hosted.select(F.col("_host").alias("host"), "html")))
    lists = found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("digest").alias("_templates"))
    if found.count() <= MOST_BROADCAST:
        joined = hosted.join(F.broadcast(lists), "_host", "left")
    else:
        salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = hosted.withColumn("_salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS))).join(salted, ["_host", "_salt"], "left")
    joined = joined.select(*kept, "_templates")
    schema = pages.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                texts = [article_text(parse(page), frozenset(known or ())) for page, known in zip(_pages(part), part.column("_templates").to_pylist(), strict=True)]
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*kept, "text", "n_chars"])

    return joined.mapInArrow(extract, schema)
