"""Main text of pages, with site templates removed.

Every element's subtree (tags, classes, text) is hashed. Spark counts, per host, on how many pages (by url) a
subtree stands; those on ``TEMPLATE_PAGES`` pages of a host are its templates, however many pages it has, and are deleted
from its pages. Elements that are
menus, headers, footers, sidebars, notices, adverts, forms or comments by tag, role or class go on any page,
as a site of few pages repeats nothing. If a page has an article (or a main element) only that is
read. Sites also repeat articles, under several urls: text blocks inside an article are never templates, and neither is a subtree that
holds over half of its text, nor anything in it. Inside an article, and for text blocks anywhere, only a whole class name (or one
followed by the name of a part, as in "share-buttons") counts: "social-science" is no social box. A form that holds over half of
the page's text is the page.
"""

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.frames import kept

# A template stands on at least so many pages of its host.
TEMPLATE_PAGES = 8
HELD_COUNTS = 200_000
# So many templates (8 bytes each) may be sent to all tasks; more are joined to the pages' own subtrees by a shuffle.
BROADCAST_KEYS = 500_000

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, elements whose content is not shown, and
# elements that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
EMBEDDED = frozenset("noscript template svg math object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr caption".split())
# Drawings and formulas have rules of their own: nothing in them is raw, "/>" ends any element, and a tag of HTML ends an unclosed one,
# except in those of their elements that may hold HTML.
FOREIGN = frozenset(("svg", "math"))
HTML_INSIDE = frozenset("foreignobject annotation-xml mi mo mn ms mtext".split())
HTML_ONLY = BLOCKS | frozenset("b big br code em embed i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
# A start tag of the key ends an open element of these (as far as no block of another kind lies between).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "article", "main"))
# What is no main text, by tag, by role, and by a word of class or id.
DROPPED_TAGS = frozenset(
    "nav footer aside form head button select option optgroup input dialog menu search audio video map".split()
) | RAW | EMBEDDED
# These belong to a form; an article may use them for its own parts.
FORM_PARTS = frozenset("label fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs header footer masthead cookie cookies consent notice notices gdpr newsletter subscribe signup"
    " popup modal overlay comment comments disqus related share sharing social widget pagination pager skip".split()
)
# Names of parts that may follow such a word in one class name.
PART_NAMES = frozenset(
    "area articles bar block box button buttons container content form icons inner item items label link links list main notice panel post posts"
    " row section slot text title unit widget wrap wrapper".split()
)
# These words name parts of the page; inside an article they name its own title.
PAGE_ONLY = frozenset("header masthead banner".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)",
    re.S,
)
# "/" ends an element unless it belongs to a value without quotes.
_VALUE_END = re.compile(r"=\s*[^\s\"']*/\Z")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _part_of(name: str) -> str:
    """The word a class name stands for: itself, or what comes before the name of a part."""
    words = re.split("[_-]+", name)
    return words[0] if len(words) > 1 and PART_NAMES.issuperset(words[1:]) else name


class Page:
    """The elements of a page in the order of their start tags, with the hashes of their subtrees."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.dropped: list[bool] = [False]  # by tag, role or class
        self.hash: list[int | None] = [None]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self._open: list[int] = [0]
        self._count: Counter = Counter()  # open elements by tag
        self._marks: list[list[str]] = [[]]  # what the open elements hold so far
        self._foreign: list[int] = []  # open drawings and formulas, and as negative numbers their elements that may hold HTML
        self._forms: list[int] = []
        self._read(source)
        while len(self._open) > 1:
            self._close()
        # Elements in an embedded one that has an end are not shown. One without an end hides nothing.
        self.hidden: list[bool] = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            self.hidden[k] = self.hidden[self.parent[k]] or self.tag[k] in EMBEDDED and self.dropped[k]
        # Characters of text in each element.
        self.chars: list[int] = [0] * len(self.tag)
        for k, text in self.events:
            if text is not None and not self.hidden[k]:
                self.chars[k] += len("".join(text.split()))
        for k in range(len(self.tag) - 1, 0, -1):
            if self.tag[k] not in RAW:
                self.chars[self.parent[k]] += self.chars[k]
            if self.tag[k] == "form" and self.dropped[k]:
                self.dropped[k] = False  # for now: whether it is the page is seen when all is summed
                self._forms.append(k)
        for k in self._forms:
            self.dropped[k] = 2 * self.chars[k] <= self.chars[0]
        self.first_main = next((k for k, tag in enumerate(self.tag) if tag in MAIN and not self.hidden[k]), None)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            start = source.find("<", at)
            if start < 0:
                return self._text(source[at:])
            found = _TOKEN.match(source, start) or _BROKEN.match(source, start)
            if found is None:
                # A bracket that begins no tag is text.
                following = source.find("<", start + 1)
                following = end if following < 0 else following
                self._text(source[at:following])
                at = following
                continue
            if start > at:
                self._text(source[at:start])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[4] == "" and at == end:
                return None  # the page breaks off inside a tag
            if found[1]:
                self._end(tag)
                continue
            if tag in HTML_ONLY and self._in_foreign():
                self._close_to(self._foreign[-1])
            foreign = self._in_foreign()
            self._start(tag, found[3])
            if (foreign or tag in EMBEDDED) and tag not in VOID and found[3].endswith("/") and not _VALUE_END.search(found[3]):
                self._close(ended=True)
            elif tag in RAW and not foreign:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else end
                self._end(tag)
        return None

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.events.append((self._open[-1], text))
        squeezed = " ".join(text.split())
        if squeezed:
            self._marks[-1].append(squeezed)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._end_open("p", (BLOCKS - {"p"}) | EMBEDDED)
        for other in ENDS.get(tag, ()):
            self._end_open(other, EMBEDDED | {"ul", "ol", "dl", "table", "select"})
        named = {}
        if "=" in attributes:
            named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        place = len(self.tag)
        inside = self._count["article"] + self._count["main"] > 0
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.hash.append(None)
        names = f"{named.get('class', '')} {named.get('id', '')}".lower().split() if named else []
        if tag == "article":
            words = set(names)  # "comment" is one, "comment-open" is not
        elif inside or tag in TEXT_BLOCKS:
            words = {_part_of(name) for name in names}
        else:
            words = {word for name in names for word in re.split("[_-]+", name)}
        if inside:
            words -= PAGE_ONLY
        self.dropped.append(
            tag not in WHOLE
            and (tag in DROPPED_TAGS or tag == "header" and not inside or tag in FORM_PARTS and not inside and self._count["form"] > 0)
            or tag not in ("html", "body", "main")
            and (named.get("role", "").lower() in DROPPED_ROLES or not DROPPED_WORDS.isdisjoint(words))
        )
        if tag in BLOCKS:
            self.events.append((place, None))
        elif tag in SPACES:
            self.events.append((place, " "))
        if tag in VOID:
            self._marks[-1].append(f"<{tag}>")
            return
        if self._in_foreign() and tag in HTML_INSIDE:
            self._foreign.append(-place)
        elif tag in FOREIGN:
            self._foreign.append(place)
        self._open.append(place)
        self._count[tag] += 1
        self._marks.append([f"<{tag} {named.get('class', '')}>"])

    def _end_open(self, tag: str, border) -> None:
        """End the innermost open ``tag`` unless an element of ``border`` lies inside it."""
        if not self._count[tag]:
            return None
        for k in reversed(self._open):
            if self.tag[k] == tag:
                return self._close_to(k)
            if self.tag[k] in border:
                return None
        return None

    def _end(self, tag: str) -> None:
        # An end tag of an inline element does not reach out of its block.
        self._end_open(tag, () if tag in BLOCKS or tag in EMBEDDED else BLOCKS)

    def _in_foreign(self) -> bool:
        return bool(self._foreign) and self._foreign[-1] > 0

    def _close_to(self, place: int) -> None:
        """Close ``place``, whose end was found, and before it what is open inside."""
        while self._open[-1] != place:
            self._close()
        self._close(ended=True)

    def _close(self, ended: bool = False) -> None:
        place, marks = self._open.pop(), self._marks.pop()
        self._count[self.tag[place]] -= 1
        if self._foreign and abs(self._foreign[-1]) == place:
            self._foreign.pop()
        if self.tag[place] in EMBEDDED:
            if ended:
                del marks[1:]  # what is not shown makes no difference to a template
            else:
                self.dropped[place] = False
        self.hash[place] = xxhash.xxh64_intdigest("\x00".join(marks).encode("utf-8", "surrogatepass")) >> 1
        self._marks[-1].append(f"{self.hash[place]:x}")
        if self.tag[place] in BLOCKS:
            self.events.append((place, None))

    def _placed(self) -> tuple[list[bool], list[bool]]:
        """Per element: whether it lies in (or is) a main element, and whether it is or holds the first one, or is the page."""
        inside, holds = [False] * len(self.tag), [tag in WHOLE for tag in self.tag]
        for k in range(1, len(self.tag)):
            inside[k] = inside[self.parent[k]] or self.tag[k] in MAIN and not self.hidden[k]
        up = self.first_main or 0
        while up > 0:
            holds[up] = True
            up = self.parent[up]
        return inside, holds

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that would be templates if they recur."""
        inside, holds = self._placed()
        return {
            self.hash[k] for k in range(1, len(self.tag))
            if self.hash[k] is not None and self.tag[k] in BLOCKS and not self.hidden[k]
            and (self.tag[k] in MAIN or not holds[k] and not (inside[k] and self.tag[k] in TEXT_BLOCKS))
        }

    def text(self, templates: set[int]) -> str:
        """The blocks that are left, in page order, one per line."""
        inside, holds = self._placed()
        gone, spared, main = [False] * len(self.tag), [False] * len(self.tag), [0] * len(self.tag)
        has_main = False
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            recurs = self.hash[k] in templates and self.tag[k] in BLOCKS
            main[k] = k if self.tag[k] in MAIN and inside[k] and not main[up] else main[up]
            # A copy of an article, or of the part that holds most of its text.
            spared[k] = spared[up] or recurs and main[k] > 0 and 2 * self.chars[k] > self.chars[main[k]]
            template = recurs and not holds[k] and not spared[k] and self.tag[k] not in MAIN and not (inside[k] and self.tag[k] in TEXT_BLOCKS)
            dropped = self.dropped[k] and not (holds[k] and k != self.first_main and self.tag[k] not in MAIN)
            gone[k] = gone[up] or dropped or template
            has_main = has_main or self.tag[k] in MAIN and not gone[k]
        blocks, piece = [], []
        for k, text in self.events:
            if text is None:
                if piece and not self.hidden[k]:
                    blocks.append("".join(piece))
                    piece = []
            elif not gone[k] and (inside[k] or not has_main):
                piece.append(text)
        blocks.append("".join(piece))
        lines = (" ".join(block.split()) for block in blocks)
        return "\n".join(line for line in lines if line)


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found[1].lower() or None if found else None


def site_key(host: str, subtree: int) -> int:
    """One number for a subtree of a host."""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), subtree) >> 1


def site_templates(pages: DataFrame) -> DataFrame:
    """(subtree), the ``site_key`` of every subtree that is a template of its host."""

    def counted(batches):
        counts: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["subtree", "n"])

        for batch in batches:
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                if host is None:
                    continue
                for subtree in Page(source or "").candidates():
                    counts[site_key(host, subtree)] += 1
                if len(counts) > HELD_COUNTS:
                    yield sent()
                    counts.clear()
        if counts:
            yield sent()

    def each(batches):
        for batch in batches:
            keys, subtrees = [], []
            for key, url, source in zip(*(batch.column(name).to_pylist() for name in ("key", "url", "html"))):
                host = host_of(url)
                found = [] if host is None else [site_key(host, subtree) for subtree in Page(source or "").candidates()]
                keys += [key] * len(found)
                subtrees += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(subtrees, pa.int64())], names=["key", "subtree"])

    # Most urls stand in one row and are counted where they are read; the rows of others count once for all.
    keyed = pages.select(F.xxhash64("url").alias("key"), "url", "html")
    several = kept(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "several")
    side = F.broadcast(several) if several.count() <= BROADCAST_KEYS else several
    once = keyed.join(side, "key", "left_anti").select("url", "html").mapInArrow(counted, "subtree bigint, n bigint")
    again = keyed.join(side, "key", "left_semi").mapInArrow(each, "key bigint, subtree bigint").distinct().select("subtree", F.lit(1).cast("bigint").alias("n"))
    rows = once.unionByName(again)
    return rows.groupBy("subtree").agg(F.sum("n").alias("n")).filter(F.col("n") >= TEMPLATE_PAGES).select("subtree")


def _page_templates(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """(_key, templates): the templates on each page that has any, from (key, url, html)."""

    def own(batches):
        for batch in batches:
            keys, subtrees = [], []
            for key, url, source in zip(*(batch.column(name).to_pylist() for name in ("key", "url", "html"))):
                host = host_of(url)
                found = [] if host is None else [site_key(host, subtree) for subtree in Page(source or "").candidates()]
                keys += [key] * len(found)
                subtrees += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(subtrees, pa.int64())], names=["_key", "subtree"])

    rows = keyed.select("key", "url", "html").mapInArrow(own, "_key bigint, subtree bigint")
    # A page has no more of them than subtrees.
    return rows.join(templates, "subtree", "left_semi").groupBy("_key").agg(F.collect_set("subtree").alias("templates"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text and n_chars.

    A null html is empty, an empty page has an empty text; a page without a host loses no templates; very long pages are read whole;
    repeated rows come back as often as they are there, and all rows of a url count as one page; an empty table gives an empty
    result. Other columns are not looked at.
    """
    templates = kept(site_templates(pages), "templates")
    few = templates.count() <= BROADCAST_KEYS
    known = np.sort(np.array([r.subtree for r in templates.collect()], dtype=np.int64)) if few else None
    rows = pages.select("page_id", "url", "html")
    if not few:
        # Equal pages have equal templates, so they may share a key.
        keyed = rows.withColumn("key", F.xxhash64("url", "html"))
        rows = keyed.join(_page_templates(keyed, templates), F.col("key") == F.col("_key"), "left").select("page_id", "url", "html", "templates")

    def extracted(batches):
        for batch in batches:
            texts = []
            own = batch.column("templates").to_pylist() if not few else [None] * batch.num_rows
            for url, source, listed in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), own):
                page, host = Page(source or ""), host_of(url)
                subtrees = [] if host is None else list(page.candidates())
                keys = np.array([site_key(host, subtree) for subtree in subtrees], dtype=np.int64)
                if few:
                    place = np.searchsorted(known, keys)
                    hit = known[np.minimum(place, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), dtype=bool)
                else:
                    hit = np.isin(keys, np.array(listed or [], dtype=np.int64))
                texts.append(page.text({subtrees[k] for k in np.flatnonzero(hit)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")
