"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, named by their path of tags and classes, and
its text blocks, named by path and text. Over all pages of a host, tokens with
the same occurrence vector (how often each page has them) form an equivalence
class. Vectors are compared by a fingerprint that adds up in any order (an XOR
of hashes of page and count, beside the number of pages; a token that each of
its pages has equally often stands there as so many tokens of once), so the
statistics cover every page and the hottest host is pre-aggregated like any
other; copies of a page count once, for they tell nothing of what is open. A
class of several tokens on enough pages, however often a page has them, is valid
if its tokens of a kind first stand in one order on all pages. Valid classes
nest into the host's template, each token before, in or after the article of the
pages; what the template leaves open are slots, and block texts that belong to
it are boilerplate, inside articles too.

Of the slots those remain that are neither in an element whose tag, role, class
or id says menu, header, footer, sidebar, notice, advert, form, script, style or
comments, nor outside the page's article. Names that an article's own parts may
bear too (share, related, legal, search) say so outside articles only; inside
them it is the template that tells repeated text, unless nearly all of an
article repeats: then its pages are near copies, and it stays whole. A name or
tag decides for each piece of text that its element holds, so an advert or a
button within a paragraph takes no other text with it. Where a page has no text in an article
but its host's template has one, the slots between the template's tokens before
and after the article stand for it.
Character references are decoded, white space in a block becomes one blank,
blocks join in page order by a line feed.

Defined cases: null html is an empty page with an empty text; broken and cut
html is read leniently (raw text elements end at their end tag or the page's
end, an unfinished tag is dropped, paragraphs and list items close each other);
hosts with too few pages have no template, so only the page itself decides; a
null or odd url is a host of its own; repeated rows get repeated results.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _shared, _words

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(?=[a-zA-Z/!])[^>]*\Z", re.S)
_NAMED = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text for readers: code, form fields, inert markup and what stands for a missing feature.
_RAW = frozenset("script style noscript template textarea title iframe noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag closes if they are open above the nearest container.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_FORMATTING = frozenset("a b i u em strong small big tt s strike font code span sub sup mark q cite abbr".split())
_BOILERPLATE_TAGS = frozenset("nav header footer aside form button select input dialog menu label datalist fieldset".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead topbar toolbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments disqus replies "
    "pagination pager contentinfo complementary form".split()
)
#: Of these, names of places on a page. In an article, whose headings and cards bear them in part ('section-header'), they count as whole names only, and not on headings.
_PLACES = frozenset("sidebar aside menu nav navbar navigation header footer masthead topbar toolbar banner".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Below this share of open text, what an article's pages repeat is the article: near copies, not boilerplate.
NEAR_COPY = 0.2
#: Names that parts of an article may bear too.
_OUTSIDE_NAMES = frozenset("side alert search share sharing social related recommended respond widget skip copyright legal disclaimer".split())
_MAIN_TAGS = frozenset(["article", "main"])
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    name: str
    path: str
    dropped: bool
    main: bool


@dataclass
class Page:
    """Elements (e) and blocks (t) of a page in its order: kind, path, text, dropped, main."""

    tokens: list[tuple[str, str, str, bool, bool]] = field(default_factory=list)


def _element(name: str, attributes: str, above: Element) -> Element:
    named, whole, label = [], set(), ""
    if attributes and "=" in attributes:
        for key, value in _NAMED.findall(attributes):
            value = value.strip("\"'")
            key = key.lower()
            named += _SPLIT.split(_CAMEL.sub(" ", value).lower())
            whole.update(value.lower().split())
            if key == "itemprop" or key == "role":
                named.append(value.lower())
            if key in ("class", "id"):
                label += f".{re.sub(r'[0-9]+', '', value.strip().lower())}"
    words = frozenset(named)
    main = name in _MAIN_TAGS or bool(words & {"articlebody"}) or (not above.main and "main" in words and "role" in attributes)
    if above.main or main:
        said = bool(words & (_BOILERPLATE_NAMES - _PLACES)) or (name not in _HEADINGS and bool(whole & _PLACES))
    else:
        said = bool(words & (_BOILERPLATE_NAMES | _OUTSIDE_NAMES))
    # The page's own frame is never boilerplate by its class alone.
    dropped = above.dropped or name in _BOILERPLATE_TAGS or (said and name not in ("html", "body", "article", "main"))
    return Element(name, f"{above.path}/{name}{label}", dropped, above.main or main)


def parse(text: str) -> Page:
    page, stack, parts, at, n = Page(), [Element("", "", False, False)], [], 0, len(text)

    def end_block():
        """Each piece of a block's text goes by the element that holds it; what is dropped is a token of its own."""
        for dropped in (False, True):
            own = [piece for piece, e in parts if e.dropped == dropped]
            joined = "".join(own) if own else ""
            if "&" in joined:
                joined = entities.unescape(joined)
            joined = " ".join(joined.split())
            if joined:
                top = next(e for e in reversed(stack) if e.name not in _FORMATTING)
                page.tokens.append(("t", top.path, joined, dropped, next(e for _, e in parts if e.dropped == dropped).main))
        parts.clear()

    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            parts.append((text[at:], stack[-1]))
            break
        if m.start() > at:
            parts.append((text[at : m.start()], stack[-1]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK:
                end_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if name in _BLOCK or name not in _FORMATTING:
                        del stack[k:]
                    else:
                        del stack[k]
                    break
                if name in _FORMATTING and stack[k].name in _BLOCK:
                    break  # a formatting end tag doesn't close blocks
            continue
        if name in _VOID:
            if name == "hr":
                end_block()
            elif name == "br":
                parts.append((" ", stack[-1]))
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(text, at) if not m[3].rstrip().endswith("/") else None
            if end is None and not m[3].rstrip().endswith("/"):
                at = n
            elif end is not None:
                close = text.find(">", end.end())
                at = n if close < 0 else close + 1
            continue
        if name in _BLOCK:
            end_block()
            # A block start closes an open paragraph, and what stands open in it.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in _BLOCK:
                    break
            if name in _CLOSES:
                closed, until = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in until:
                        break
                    if stack[k].name in closed:
                        del stack[k:]
        element = _element(name, m[3], stack[-1])
        if name in _BLOCK:
            page.tokens.append(("e", element.path, "", element.dropped, element.main))
        if not m[3].endswith("/") or name in _BLOCK:
            stack.append(element)
    end_block()
    return page


def _token(kind: str, path: str, text: str = "") -> int:
    # A character reference can name half a pair, which is no UTF-8.
    return int.from_bytes(hashlib.blake2b(f"{kind}\x00{path}\x00{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


BEFORE, INSIDE, AFTER, ANYWHERE = 0, 1, 2, 3


def _sides(page: Page) -> list[int | None]:
    """Of each token, whether it stands before, in or after the page's article; None on pages without one."""
    inside = [i for i, t in enumerate(page.tokens) if t[4]]
    if not inside:
        return [None] * len(page.tokens)
    return [INSIDE if t[4] else BEFORE if i < inside[0] else AFTER if i > inside[-1] else ANYWHERE for i, t in enumerate(page.tokens)]


def host(url: Column) -> Column:
    """The url's host, lower-case; the whole url where it has none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.when(found == "", F.coalesce(url, F.lit(""))).otherwise(found))


def page_tokens(pages: DataFrame) -> DataFrame:
    """A row for each distinct page and token: host, page (a number of its html), token, kind, count, first place and side."""

    def run(batches):
        for batch in batches:
            out = []
            for site, page_id, html in zip(*(_words.column(batch, c).to_pylist() for c in ("host", "page", "html")), strict=True):
                page, seen = parse(html or ""), {}
                for place, ((kind, path, text, _, _), side) in enumerate(zip(page.tokens, _sides(page), strict=True)):
                    one = seen.setdefault((kind, path, text), [0, place, side])
                    one[0] += 1
                    one[2] = side if one[2] == side else ANYWHERE
                out += [(site, page_id, _token(kind, path, text), kind == "t", n, place, side) for (kind, path, text), (n, place, side) in seen.items()]
            names, kinds = ["host", "page", "token", "is_text", "n", "place", "side"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    numbered = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    found = numbered.mapInArrow(run, "host string, page long, token long, is_text boolean, n long, place long, side long")
    return found.groupBy("host", "page", "token").agg(*(F.max(c).alias(c) for c in ("is_text", "n", "place", "side")))


def templates(pages: DataFrame, *, min_pages: int = 8, min_share: float = 0.5) -> DataFrame:
    """(host, token, is_text, class_id, place, side): tokens of the valid classes, nested by place and side."""
    tokens = _shared.written(page_tokens(pages), "page-tokens")
    vectors = tokens.groupBy("host", "token").agg(F.count("*").alias("pages"), F.when(F.min("n") == F.max("n"), F.bit_xor(F.xxhash64("page"))).otherwise(F.bit_xor(F.xxhash64("page", "n"))).alias("vector"), F.min("place").alias("place"), F.max("is_text").alias("is_text"), F.min("side").alias("low"), F.max("side").alias("high"))
    vectors = vectors.withColumn("side", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(ANYWHERE)).drop("low", "high")
    # A page's frame is on all of a host's pages, so the most frequent token counts them.
    most = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))
    frequent = vectors.where(F.col("pages") >= min_pages).join(most, "host").where(F.col("pages") >= F.col("host_pages") * min_share)
    classes = frequent.select("host", "token", "is_text", "place", "side", F.xxhash64("host", "pages", "vector").alias("class_id"))
    large = classes.groupBy("class_id").agg(F.count("*").alias("size")).where("size > 1").select("class_id")
    classes = _shared.written(classes.join(large, "class_id").select("host", "token", "is_text", "place", "side", "class_id"), "page-classes")
    # Ordered: on every page the class's tokens of a kind stand in one order.
    placed = tokens.join(classes.select("host", "token", "class_id"), ["host", "token"])
    orders = placed.groupBy("class_id", "page", "is_text").agg(F.hash(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])).alias("sequence"))
    valid = orders.groupBy("class_id", "is_text").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).where("low = high").select("class_id", "is_text")
    return classes.join(valid, ["class_id", "is_text"]).select("host", "token", "is_text", "class_id", "place", "side")


def main_text(html: str, template: dict[int, int] | None = None) -> str:
    """The text of the slots that remain. template: tokens of the host's template and their sides."""
    page = parse(html)
    sides = [template.get(_token(*t[:3])) for t in page.tokens] if template else [None] * len(page.tokens)
    slots = [i for i, t in enumerate(page.tokens) if t[0] == "t" and not t[3]]
    inside = [i for i in slots if page.tokens[i][4]]
    if not inside and template and INSIDE in template.values():
        # The article's place, by what the template has before and after it.
        begin = max((i for i, s in enumerate(sides) if s == BEFORE), default=-1)
        end = min((i for i, s in enumerate(sides) if s == AFTER and i > begin), default=len(sides))
        slots = [i for i in slots if begin < i < end]
    left = [i for i in inside or slots if sides[i] is None]
    if inside and sum(len(page.tokens[i][2]) for i in left) < NEAR_COPY * sum(len(page.tokens[i][2]) for i in inside):
        left = inside
    return "\n".join(page.tokens[i][2] for i in left)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame, *, min_pages: int = 8, min_share: float = 0.5, max_broadcast_tokens: int = 100_000) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    template = _shared.written(templates(pages, min_pages=min_pages, min_share=min_share).select("host", "token", "side"), "page-templates")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))

    def output(batch, by_page):
        urls = _words.column(batch, "url")
        texts = [main_text(h or "", t) for h, t in zip(_words.column(batch, "html").to_pylist(), by_page, strict=True)]
        return pa.RecordBatch.from_arrays([_words.column(batch, "page_id"), urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if template.limit(max_broadcast_tokens + 1).count() <= max_broadcast_tokens:
        by_host: dict[str, dict[int, int]] = {}
        for site, token, side in template.collect():  # max_broadcast_tokens rows at most
            by_host.setdefault(site, {})[token] = side
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches):
            for batch in batches:
                yield output(batch, [shared.value.get(h) for h in _words.column(batch, "host").to_pylist()])

        return rows.mapInArrow(run, SCHEMA)

    # A host's template is one list; the join with it can be split where a host is hot.
    lists = template.groupBy("host").agg(F.collect_set(F.struct("token", "side")).alias("tokens"))

    def run_joined(batches):
        for batch in batches:
            yield output(batch, [{t["token"]: t["side"] for t in x or ()} for x in _words.column(batch, "tokens").to_pylist()])

    return rows.join(lists, "host", "left").mapInArrow(run_joined, SCHEMA)
