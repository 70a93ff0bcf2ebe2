"""Main text of web pages by deduction of their template.

Pages of one host are compared in groups. Their tokens are elements, each named by its path of tags and classes, and texts,
each named by its path and words. ``classes`` groups the tokens that have the same occurrence vector, which is how often each
page of the group has them; pages with the same texts count once. A class that ``FEW`` pages have is valid. Elements nest as
the pages' trees do, and a text's class nests in that of an element around it if it agrees with it on nearly all pages that
have the element (on all pages, both are one class). Such a text is the template's, wherever in the element it stands, if
it has ``SIZE`` words or more, or if the list, box or table around it holds such texts alone; a shorter line between texts
that vary ("By Staff") is of the slot that it stands in. What the template leaves are slots. If no slot of a group has text,
nothing tells template and article apart, and all texts stay.

The elements that nearly every page has once, in one order, are the template's frame. If an article or main element of the
frame has most of the text that varies, its slots are the article; without one, all slots are. Elements that are boilerplate
by their tag (``APART_TAGS``) go. A word of a class, id, role or label (``APART_WORDS``) is weak evidence, for what varies
from page to page as an article does (adverts, comments, related items): it doesn't count for an element that a page has
once if nearly all the varying text is in it, or the page's article or main element is (``overruled``).

A host with many pages is dealt to groups of about ``GROUP`` pages and ``GROUP_BYTES`` bytes by a hash, so no task gets a
host, and rows that repeat their id and url without end are dealt again by their place; the pages of hosts with fewer than
``FEW`` pages are compared with each other, as their own vectors are too short to tell a template.

Defined cases: a null, empty or textless page has the text ''; a null or strange url has no host; unclosed elements end with
their parents; unclosed comments, scripts and styles reach to the end of the page; a page of any length is taken whole, in time
proportional to it, and elements more than ``DEPTH`` deep count as part of the one around them;
repeated rows are pages of their own, but count once in vectors; ties of elements go to the deeper, then to the later name;
an empty table gives an empty result. Added columns replace input columns of their name.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._links import bounded
from ._store import materialise

GROUP = 64
GROUP_BYTES = 32 << 20
#: A part with so many times the pages of a group holds repeated rows.
REPEATED = 8
FEW = 4
#: Words of a text that is a valid class by itself.
SIZE = 9
#: Of a group's pages, the part that must have a token of the frame, or on which a nested class must agree.
SUPPORT = 0.9
#: Of the varying text, the part that an element must hold to overrule words, and the part that an article must hold.
COVERAGE, MOST = 0.8, 0.5

RAW = re.compile(r"<(script|style|title|noscript|template|iframe|textarea|xmp)\b", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*)")
DELIMITER = re.compile("[\"'>]")
#: A text, or a tag without angle brackets inside, as nearly all are; it looks no farther than the next bracket.
PLAIN = re.compile(r"""([^<]++)|<(/?)([a-zA-Z][^\s/>"'<]*+)((?:[^"'<>]++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
NAMED = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that a new one of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What is boilerplate by its tag, or by a word of its class, id or role.
APART_TAGS = frozenset("nav footer aside head button select dialog menu svg object audio video canvas".split())
#: As a word is: some sites have their pages in a form.
WEAK_TAGS = frozenset({"form"})
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar menu navbar nav navigation breadcrumb breadcrumbs footer header masthead toolbar share sharing social related recommended recommendations comments "
    "comment commentlist disqus reply replies respond login search widget complementary contentinfo pagination pager skip copyright legal".split()
)
TAKEN = frozenset({"article", "main"})
#: Elements that group others.
GROUPING = frozenset("div section ul ol dl table figure details fieldset blockquote address center".split())
_WORD = re.compile(r"[a-z]+")
#: Elements inside one another; deeper ones count as part of the last, as in browsers.
DEPTH = 128


def tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(closing, tag, attributes, text) of tags and texts in order, in time proportional to the source.

    Comments, declarations and elements of raw text are passed over; a tag ends at the first > outside quotes, and a < that
    begins none is text.
    """
    marks: list[int] = []
    ends: dict[int, int] = {}  # by place among the marks, where a tag that reaches it outside quotes ends

    def end_of(at: int) -> int:
        if not marks:
            marks.extend(m.start() for m in DELIMITER.finditer(source))
        k, passed = bisect_left(marks, at), []
        while k < len(marks) and k not in ends:
            passed.append(k)
            c = source[marks[k]]
            if c == ">":
                ends[k] = marks[k]
                break
            close = source.find(c, marks[k] + 1)
            k = len(marks) if close < 0 else bisect_left(marks, close) + 1
        found = ends.get(k, -1)
        ends.update(dict.fromkeys(passed, found))
        return found

    at, size = 0, len(source)
    while at < size:
        plain = PLAIN.match(source, at)
        if plain:
            text, closing, name, attributes = plain.groups("")
            if text or closing or name[0] not in "sStTnNiIxX" or not RAW.match(source, at):
                yield closing, name, attributes, text
                at = plain.end()
                continue
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        raw = RAW.match(source, at)
        end = end_of(raw.end()) if raw else -1
        if end >= 0:
            close = _closing(raw[1].lower()).search(source, end + 1)
            at = close.end() if close else size
            continue
        if source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at + 2)
            at = size if end < 0 else end + 1
            continue
        tag = TAG.match(source, at)
        end = end_of(tag.end()) if tag else -1
        if end >= 0:
            yield tag[1], tag[2], source[tag.end() : end], ""
            at = end + 1
        else:
            yield "", "", "", "<"
            at += 1


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


class Page:
    """Elements (path, tag, parent, boilerplate) and blocks of text pieces (element, text) of a page, in order."""

    def __init__(self, source: str | None):
        self.paths, self.tags, self.parents, self.barred, self.weak = [""], [""], [-1], [False], [False]
        self.blocks: list[list[tuple[int, str]]] = []
        block: list[tuple[int, str]] = []
        stack, opened, deeper = [0], Counter(), Counter()
        known: dict[tuple[str, str], str] = {}

        def end_block() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def end_elements(at: int) -> None:
            opened.subtract(self.tags[e] for e in stack[at:])
            del stack[at:]

        for closing, tag, attributes, text in tokens(source or ""):
            if text:
                block.append((stack[-1], text))
                continue
            tag = tag.lower()
            if tag == "br":
                block.append((stack[-1], " "))
                continue
            if tag not in INLINE:
                end_block()
            if closing:
                if deeper[tag]:
                    deeper[tag] -= 1
                    continue
                at = next(k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == tag) if opened[tag] else 0
                if at and not (tag in INLINE and any(self.tags[e] not in INLINE for e in stack[at + 1 :])):
                    end_elements(at)
                continue
            ended = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1) if ended else ():
                if self.tags[stack[k]] in ended:
                    end_elements(k)
                    break
                if self.tags[stack[k]] not in INLINE:
                    break
            if tag in VOID:
                continue
            if len(stack) > DEPTH:
                deeper[tag] += 1
                continue
            opened[tag] += 1
            named = {n.lower(): (a or b or c).lower() for n, a, b, c in NAMED.findall(attributes)} if attributes else {}
            parent = stack[-1]
            words = {w for v in named.values() for w in _WORD.findall(v)}
            barred = self.barred[parent] or tag in APART_TAGS or (tag == "header" and not self._within(parent))
            stack.append(len(self.tags))
            classes = ".".join(sorted(re.sub(r"\d+", "", named.get("class", "")).split()))
            step = self.paths[parent], f"{tag}.{classes}" if classes else tag
            self.paths.append(known.setdefault(step, "/".join(step)))
            self.tags.append(tag)
            self.parents.append(parent)
            self.barred.append(barred and tag not in ("html", "body"))
            self.weak.append(tag not in ("html", "body") and (tag in WEAK_TAGS or bool(words & APART_WORDS)))
        end_block()
        self.mark(frozenset())

    def mark(self, freed: frozenset[str]) -> None:
        """Find the boilerplate; words don't count for the paths in ``freed``."""
        self.apart = [False]
        for e in range(1, len(self.tags)):
            above = self.apart[self.parents[e]] and self.tags[e] not in ("html", "body")
            weak = self.weak[e] and self.tags[e] not in TAKEN and self.paths[e] not in freed
            self.apart.append(above or self.barred[e] or weak)

    def above(self, element: int) -> list[int]:
        """The element and those around it, without the root."""
        out = []
        while element > 0:
            out.append(element)
            element = self.parents[element]
        return out

    def _within(self, element: int) -> bool:
        while element > 0:
            if self.tags[element] in TAKEN:
                return True
            element = self.parents[element]
        return False

    def words(self) -> list[tuple[str, str, int]]:
        """(path, words, element) of each block's pieces in elements that aren't boilerplate."""
        out = []
        for block in self.blocks:
            kept = [(e, t) for e, t in block if not self.apart[e]]
            said = " ".join(html.unescape("".join(t for _, t in kept)).split())
            if said:
                out.append((self.paths[kept[0][0]], said, kept[0][0]))
        return out


def overruled(pages: list[Page]) -> frozenset[str]:
    """Paths of elements that words mark as boilerplate and whose text says otherwise.

    These are elements that no page has twice, of two kinds: those with nearly all the varying text of the pages that have
    them, or of the article or main element around them, unless such an element elsewhere has text; and those around the
    only article or main element of most pages that have them.
    """
    seen: Counter[tuple[str, str]] = Counter()
    twice: set[str] = set()
    for page in pages:
        seen.update({(page.paths[e], " ".join(t.split())) for block in page.blocks for e, t in block})
        twice.update(p for p, n in Counter(page.paths).items() if n > 1)
    constant = {t for t, n in seen.items() if len(pages) >= FEW and n >= SUPPORT * len(pages)}
    held, whole, around, had = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        weak = [e for e in range(1, len(page.tags)) if page.weak[e] and page.tags[e] not in TAKEN and not page.barred[e] and page.paths[e] not in twice]
        if not weak:
            continue
        sizes: Counter[int] = Counter()
        taken: set[int] = set()
        for block in page.blocks:
            for e, t in block:
                said = " ".join(t.split())
                if not said or page.barred[e]:
                    continue
                over = page.above(e)
                if (page.paths[e], said) not in constant:
                    sizes[0] += len(said)
                    for a in over:
                        sizes[a] += len(said)
                if not page.apart[e]:
                    taken.update(a for a in over if page.tags[a] in TAKEN)
        for e in weak:
            had[page.paths[e]] += 1
            inside = next((a for a in page.above(e) if a in taken), 0)
            if sizes[inside] and (inside or not taken):
                held[page.paths[e]] += sizes[e]
                whole[page.paths[e]] += sizes[inside]
        for e, tag in enumerate(page.tags):
            alone = tag in TAKEN and not page.weak[e] and page.apart[e] and not page.barred[e] and page.paths[e] not in twice
            if alone and sizes[e] and not any(page.tags[a] == "article" or tag == "main" for a in taken):
                around.update({page.paths[a] for a in page.above(e)} & {page.paths[w] for w in weak})
    return frozenset(p for p in had if whole[p] and held[p] >= COVERAGE * whole[p] or 2 * around[p] > had[p])


Token = tuple[str, str]


def classes(pages: list[Page]) -> dict[tuple[int, ...], list[Token]]:
    """Equivalence classes: (path, words) of texts and (path, '') of elements by their occurrence vector over ``pages``."""
    found: dict[Token, dict[int, int]] = defaultdict(dict)
    for k, page in enumerate(pages):
        for path, n in Counter(page.paths).items():
            found[path, ""][k] = n
        for (path, words), n in Counter((p, w) for p, w, _ in page.words()).items():
            found[path, words][k] = n
    out: dict[tuple[int, ...], list[Token]] = defaultdict(list)
    for token, vector in found.items():
        out[tuple(vector.get(k, 0) for k in range(len(pages)))].append(token)
    return out


def _nested(inner: tuple[int, ...], outer: tuple[int, ...]) -> bool:
    """Whether a class agrees with one around it on nearly all pages that have the latter."""
    have = [k for k, n in enumerate(outer) if n]
    return len(have) >= FEW and sum(inner[k] == outer[k] for k in have) >= SUPPORT * len(have)


def constants(pages: list[Page]) -> set[Token]:
    """The template's texts."""
    distinct = [*{tuple(w[:2] for w in page.words()): page for page in reversed(pages)}.values()]
    if len(distinct) < FEW:
        return set()
    around: dict[Token, list[str]] = {}
    for page in distinct:
        for path, words, element in page.words():
            if (path, words) not in around:
                around[path, words] = ["", *(page.paths[e] for e in page.above(element))]
    vector_of = {token: vector for vector, tokens in classes(distinct).items() for token in tokens}
    valid = {t for t in around if sum(n > 0 for n in vector_of[t]) >= FEW and any(_nested(vector_of[t], vector_of[p, ""]) for p in around[t])}
    live = {p for t in around if t not in valid for p in around[t]}
    found = set()
    for path, words in valid:
        box = next((p for p in around[path, words][1:] if p.rsplit("/", 1)[-1].split(".")[0] in GROUPING), "")
        if len(words.split()) >= SIZE or (box and box not in live):
            found.add((path, words))
    return found if len(found) < len(around) else set()


def frame(pages: list[Page]) -> tuple[set[str], set[tuple[str, str]], str]:
    """(paths of the frame's elements, the template's texts, path of the article or '' for all slots) of a group of pages."""
    needed = max(1, SUPPORT * len(pages))
    vectors: dict[str, dict[int, int]] = defaultdict(dict)
    orders: list[dict[str, int]] = []
    for k, page in enumerate(pages):
        for path, n in Counter(page.paths[1:]).items():
            vectors[path][k] = n
        orders.append({p: at for at, p in reversed([*enumerate(page.paths)])})
    elements = [p for p, vector in vectors.items() if len(vector) >= needed and max(vector.values()) == 1]
    # The order of the frame is that of the page with most of it; tokens that another page has elsewhere aren't valid.
    leading = max(orders, key=lambda o: sum(t in o for t in elements), default={})
    ranked = sorted((t for t in elements if t in leading), key=leading.get)
    for order in orders:
        places = [order[t] for t in ranked if t in order]
        if places != sorted(places):
            top, kept = -1, []
            for t in ranked:
                if t not in order or order[t] > top:
                    kept.append(t)
                    top = order.get(t, top)
            ranked = kept
    paths, labels = set(ranked), constants(pages)

    held: Counter[str] = Counter()
    total = 0
    for page in pages:
        for path, words, element in page.words():
            if (path, words) in labels:
                continue
            size = len(words)
            total += size
            while element > 0:
                if page.paths[element] in paths:
                    held[page.paths[element]] += size
                element = page.parents[element]
    enough = [p for p in paths if p.rsplit("/", 1)[-1].split(".")[0] in TAKEN and total and held[p] >= MOST * total]
    return paths, labels, max(enough, key=lambda p: (p.count("/"), p), default="")


def extract(sources: Iterable[str | None]) -> list[str]:
    """The main text of each page of a group."""
    sources = list(sources)
    pages = {s: Page(s) for s in dict.fromkeys(sources)}
    freed = overruled([*pages.values()])
    for page in pages.values() if freed else ():
        page.mark(freed)
    _, labels, article = frame([*pages.values()])
    found = {}
    for source, page in pages.items():
        said = page.words()
        inside = [(p, w) for p, w, _ in said if not article or p == article or p.startswith(article + "/")]
        if not inside:  # a page without the group's article: all its text, or that of an article of its own
            inside = [(p, w) for p, w, e in said if page._within(e)] or [(p, w) for p, w, _ in said]
        found[source] = " ".join(w for p, w in inside if (p, w) not in labels)
    return [found[s] for s in sources]


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``pages`` without their html, with ``text`` and ``n_chars``."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(html_col).alias("html"), host.alias("host"), F.xxhash64(id_col, url_col).alias("deal"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))
    hosts = materialise(sizes, "hosts")
    own = (F.col("n") >= FEW) & (F.col("host") != "")
    parts = F.greatest(F.ceil(F.col("n") / GROUP), F.least(F.ceil(F.col("bytes") / GROUP_BYTES), F.ceil(F.col("n") / FEW)))
    large = hosts.filter(own).select("host", parts.alias("parts"))
    rest = hosts.filter(~own).agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(parts).first()[0]
    dealt = rows.join(bounded(large), "host", "left")
    group = F.when(F.col("parts").isNull(), F.lit("")).otherwise(F.col("host"))
    dealt = dealt.select("row", "html", group.alias("group"), F.pmod("deal", F.coalesce("parts", F.lit(rest))).alias("part"))
    crowded = dealt.groupBy("group", "part").agg(F.count("*").alias("n")).filter(F.col("n") > REPEATED * GROUP)
    crowded = materialise(crowded.select("group", "part", F.ceil(F.col("n") / GROUP).alias("times")), "crowded")
    dealt = dealt.withColumn("place", F.monotonically_increasing_id()).join(bounded(crowded), ["group", "part"], "left")
    dealt = dealt.withColumn("again", F.pmod("place", F.coalesce("times", F.lit(1)))).drop("place", "times")
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("text", StringType()), StructField("n_chars", LongType())])

    def solve(part: pa.Table) -> pa.Table:
        texts = extract(part.column("html").to_pylist())
        return pa.table({"row": part.column("row"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return dealt.groupBy("group", "part", "again").applyInArrow(solve, schema).select("row.*", "text", "n_chars")
