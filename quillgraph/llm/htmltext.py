"""HTML extraction with site template removal.

A tolerant parser turns each page into elements. The hash of an element's subtree covers its tag, attributes and all
it holds. Spark counts, per host, in how many different main texts each subtree occurs, so that copies of one page or
article count once; subtrees in at least ``LEAST_PAGES`` of them and ``SHARE`` of the host's are template and are deleted, along with
elements that by tag, role, class or id are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments. Inside an article a header is its headline and stays, headings stay whatever they are called, paragraphs and other running elements go only by a class that is
a furniture word and nothing else, and a box with a doubtful name (alert, legal; share, related) stays if it is text: not mostly links, and for the second kind with a sentence. An article element that is named a comment, reply or teaser
is none of the main part, nor is one within an article that has text of its own (reader comments are marked up so). Paragraphs, headings, list items, cells and inline elements that lie inside the article element are never template by
themselves, but lists, tables, figures and other boxes that hold them may be. A subtree with ``NEARLY`` all words of the main part stays, and so does all of an article of which less than the rest would be left. Where a page
has an article (or main) element its text is the result, else what is left of the body.

White space is what ``str.split`` takes for it. Blocks are separated by block elements and line breaks.

Defined results: null and empty html give an empty text; a quote opens a quoted value only after an equals sign; a null or unparsable url is a host of its own, named by the
empty string; repeated rows pass and count once; unclosed and truncated markup closes at the end; columns other than
page_id, url and html are ignored; pages of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint

#: The share is low, so that what only one section of a large host repeats is found too.
LEAST_PAGES, SHARE = 5, 0.01
NEARLY = 0.9
#: Hosts' template hashes that may be broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
MOST_COUNTED = 200_000
#: Hosts whose sets a task holds.
MOST_HOSTS = 256

# Fixed values of the HTML standard and of common page layouts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noframes".split())
DROP = set("head script style noscript template iframe nav footer aside form button select textarea input svg canvas object embed dialog menu title".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption b i em strong a span u s small sub sup code br hr tbody thead tr img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_CLOSERS = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that an implied end does not reach beyond.
WALLS = set("table ul ol dl article section div main body aside nav header footer form blockquote".split())
WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|masthead|footer|ads?|adbox|adslot|adunit|adwrap\w*|adsbygoogle|advert\w*|sponsor\w*|promo\w*|banner|cookies?|gdpr|ccpa|consent|notices?|newsletter|"
    r"subscribe|signup|login|popup|modal|overlay|comments?|comment-?list|disqus|respond|replies|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
#: Names that an article's own boxes have too: of warnings and terms, and of what goes unless it is text.
PLAIN = re.compile(r"(?:^|[\s_-])(?:header|copyright|legal|alert)(?:$|[\s_-])", re.I)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|related|recommended|widgets?|toolbar)(?:$|[\s_-])", re.I)
#: Class or id of an article or main element that is not the page's own.
SIDE_ARTICLE = re.compile(r"(?:^|\s)(?:comment|reply|response|teaser|related|recommended|promo|sponsor(?:ed)?|ad|advert\w*)(?:[_-]?(?:\d+|item|body|box|card|entry|post|content))?(?:$|\s)", re.I)
SENTENCE = re.compile(r"\w[\"'\u201d\u00bb)\]]*[.!?\u2026\u3002](?:[\"'\u201d\u00bb)\]]*(?:\s|$))")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Element:
    tag: str
    attrs: str = ""
    kids: list = field(default_factory=list)
    raw: bool = False


def parse(text: str) -> Element:
    """The page as a tree; ends that are missing are implied, ends without a start are ignored."""
    root = Element("#root")
    stack = [root]
    open_ = Counter()  # tags in the stack, so that no end is looked for in vain

    def shut(i: int) -> None:
        open_.subtract(e.tag for e in stack[i:])
        del stack[i:]

    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if not m.group().startswith(("<!", "<?")):
                stack[-1].kids.append(m.group())
            continue
        tag = tag.lower()
        if m.group(1):
            if open_[tag] > 0:
                shut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in P_CLOSERS or tag in CLOSES:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in P_CLOSERS else set())
            for i in range(len(stack) - 1, 0, -1) if any(open_[t] > 0 for t in ends) else ():
                if stack[i].tag in ends:
                    shut(i)
                    break
                if stack[i].tag in WALLS:
                    break
        e = Element(tag, m.group(3).strip().rstrip("/"))
        stack[-1].kids.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(text, at)
            stop = end.start() if end else n
            e.raw = True
            e.kids.append(text[at:stop])
            close = text.find(">", stop)
            at = n if not end or close < 0 else close + 1
        elif tag not in VOID:
            stack.append(e)
            open_[tag] += 1
    return root


def prose(e: Element, sentence: bool) -> bool:
    """Whether a box holds running text: words, most of them outside links, and with ``sentence`` the end of one."""
    words = linked = 0
    plain: list[str] = []
    work = [(e, False)]
    while work:
        x, link = work.pop()
        if isinstance(x, str):
            n = len(x.split())
            words, linked = words + n, linked + n * link
            if not link:
                plain.append(x)
        elif not x.raw:
            work += [(k, link or x.tag == "a") for k in reversed(x.kids)]
    return words > 0 and linked * 2 < words and (not sentence or bool(SENTENCE.search(entities.unescape("".join(plain)))))


def attributes(e: Element) -> Iterator[tuple[str, str]]:
    return ((m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "") for m in ATTRIBUTE.finditer(e.attrs))


def furniture(e: Element, inside: bool = False) -> bool:
    """Whether tag, role, class or id mark a part that is not the article's text; ``inside``: for an element of the main part."""
    if e.tag in DROP:
        return True
    if not e.attrs or e.tag in ("html", "body"):
        return e.tag == "header" and not inside
    for name, value in attributes(e):
        if name == "hidden" or (name == "role" and value.lower() in ROLES) or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if e.tag in ("article", "main"):
            if name in ("class", "id") and SIDE_ARTICLE.search(value):
                return True
        elif inside and e.tag in HEADINGS:
            continue
        elif inside and e.tag in PROSE:
            if name == "class" and any(m and m.group() == word for word in value.split() for m in [WORDS.search(word)]):
                return True
        elif name in ("data-ad", "data-advert") or name.startswith(("data-ad-", "data-google-query")):
            return True
        elif name in ("class", "id") and (WORDS.search(value) or (PLAIN.search(value) and not (inside and prose(e, False))) or (DOUBTFUL.search(value) and not (inside and prose(e, True)))):
            return True
    return e.tag == "header" and not inside


def side_articles(top: Element) -> set[int]:
    """Articles within an article that has text of its own: its readers' comments."""
    found, own, work = [], False, list(top.kids)
    while work:
        e = work.pop()
        if isinstance(e, str):
            own = own or bool(e.strip())
        elif e.tag == "article":
            found.append(id(e))
        elif not (e.raw or e.tag in HEADINGS or furniture(e, True)):
            work += e.kids
    return set(found) if own else set()


def main_part(root: Element) -> tuple[list[Element], bool]:
    """The article elements (outermost, outside furniture), else main ones, else the whole page; whether found."""
    for wanted in ("article", "main"):
        found, work = [], [root]
        while work:
            e = work.pop()
            if e.tag == wanted and not furniture(e):
                found.append(e)
            elif e.tag == "#root" or not furniture(e):
                work += [k for k in reversed(e.kids) if isinstance(k, Element)]
        if found:
            return found, True
    return [root], False


def subtrees(root: Element) -> Iterator[tuple[Element, int, bool]]:
    """(element, hash of its subtree, whether it may be template), children before parents."""
    inside = {id(e) for e in (main_part(root)[0] if main_part(root)[1] else [])}
    hashes: dict[int, int] = {}
    work: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while work:
        e, within, ready = work.pop()
        if not ready:
            work.append((e, within, True))
            deep = within or id(e) in inside
            work += [(k, deep, False) for k in e.kids if isinstance(k, Element)]
            continue
        parts = [e.tag, e.attrs]
        for k in e.kids:
            parts.append(" ".join(k.split()) if isinstance(k, str) else f"\0{hashes[id(k)]}")
        hashes[id(e)] = h = xxhash.xxh64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        yield e, h, e.tag not in ("#root", "html", "body", "article", "main", "head") and not (within and e.tag in PROSE)


def deleted(root: Element, template: set[int] | frozenset[int]) -> set[int]:
    """The ids of the template elements of a page."""
    order = list(subtrees(root))
    if not any(free and h in template for _, h, free in order):
        return set()
    tops, found = main_part(root)
    within: set[int] = set()
    aside = {i for t in tops if t.tag == "article" for i in side_articles(t)}
    work = list(tops) if found else []
    while work:
        e = work.pop()
        within.add(id(e))
        work += [k for k in e.kids if isinstance(k, Element)]

    def words(gone: set[int]) -> tuple[dict[int, int], int]:
        n: dict[int, int] = {}
        for e, _, _ in order:
            n[id(e)] = 0 if id(e) in gone or id(e) in aside or e.raw or furniture(e, id(e) in within) else sum(len(k.split()) if isinstance(k, str) else n[id(k)] for k in e.kids)
        return n, sum(n[id(t)] for t in tops)

    n, whole = words(set())
    gone = {id(e) for e, h, free in order if free and h in template and n[id(e)] <= NEARLY * whole}
    return set() if found and words(gone)[1] < (1 - NEARLY) * whole else gone


def extract(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's main text without furniture and template subtrees."""
    if not page:
        return ""
    root = parse(page)
    return text_of(root, deleted(root, template) if template else set())


def text_of(root: Element, gone: set[int]) -> str:
    blocks: list[list[str]] = [[]]
    tops, found = main_part(root)
    for top in tops:
        aside = side_articles(top) if top.tag == "article" else set()
        blocks.append([])
        work: list = [top]
        while work:
            e = work.pop()
            if e is None:
                blocks.append([])
            elif isinstance(e, str):
                blocks[-1].append(entities.unescape(e))
            elif e is top or not (furniture(e, found) or id(e) in gone or id(e) in aside):
                if e.raw and e is not top:
                    continue
                if e.tag in BLOCK:
                    blocks.append([])
                    work.append(None)
                work += reversed(e.kids)
        blocks.append([])
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def host_of(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def template(pages: DataFrame) -> DataFrame:
    """(host, h): subtrees that recur in a host's different main texts. ``pages`` has host."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def out() -> pa.RecordBatch:
            host, h, body = zip(*seen) if seen else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(h, pa.int64()), pa.array(body, pa.int64())], ["host", "h", "body"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = page.as_py()
                if text:
                    root = parse(text)
                    body = xxhash.xxh64_intdigest(text_of(root, set()).encode("utf-8", "surrogatepass")) - (1 << 63)
                    seen.add((host, None, body))  # stands for the main text itself
                    seen.update((host, h, body) for _, h, free in subtrees(root) if free)
                if len(seen) > MOST_COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    found = checkpoint(pages.select("host", "html").mapInArrow(count, "host string, h long, body long").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(f"h is null or n >= {LEAST_PAGES}"))
    sizes = found.where("h is null").select("host", F.col("n").alias("texts"))
    return found.where("h is not null").join(sizes, "host").where(F.col("n") >= F.col("texts") * SHARE).select("host", "h")


def clean(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row."""
    rows = host_of(pages)
    marks = checkpoint(template(rows).groupBy("host").agg(F.collect_list("h").alias("marks")))  # at most 1 / SHARE times a page's subtrees
    size = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    marked = rows.join(F.broadcast(marks) if size <= BROADCAST_ROWS else marks, "host", "left").select("page_id", "url", "html", "host", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}  # a host's set is made once while few others come between
        for b in batches:
            texts = []
            for page, host, m in zip(b.column(2), b.column(3).to_pylist(), b.column(4), strict=True):
                if host not in known:
                    if len(known) >= MOST_HOSTS:
                        known.clear()
                    known[host] = frozenset(m.as_py() or ())
                texts.append(extract(page.as_py(), known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return marked.mapInArrow(run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns, one row per page."""
    return clean(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
