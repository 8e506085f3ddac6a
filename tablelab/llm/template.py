"""HTML extraction: the text that is left when the template of a site's pages is taken away.

The method is that of Arasu and Garcia-Molina (2003). A page is a sequence of
tokens: opened elements and runs of text, each told apart by its role, the path
of elements around it (names, and words of class and id). The occurrence vector of
a token says how often it occurs on each page of its host. Tokens that share a
vector form an equivalence class. A class is kept if it is large (``TOKENS``), frequent
(``PAGES`` pages and half of the host's), ordered (on every page its tokens repeat in one
order) and nested (it never interleaves with another class: the smaller one of the
two goes). The valid classes, one inside the other, are the host's template; what
stands between their tokens are the slots.

Slots are extracted by where they lie in the template. Elements that are menus,
headers, footers, sidebars, forms, scripts and the like, or whose class, id or role
says so (notices, adverts, comments), hold no main text. On a page with an article
or main element the slots inside it are extracted, whole: a passage that articles of
a host share stays. On other pages texts that belong to the template (notices
without a name, say) are left out, too.

Vectors are added up by Spark as fingerprints, one term a page, so that no host is
ever gathered: a host that holds a third of all pages is as many small rows as it
has different tokens. Pages of one host with the same texts count once, so that
copies do not become a template. A template's tokens stand on half of the host's
pages, so there are at most twice as many as a page has; they go to the pages of
their host as a broadcast up to ``BROADCAST`` tokens in all, and else in a join whose
busy hosts are spread over ``SALT``-page portions.

Defined cases: a null html is empty, and its text, too; pages of a null or broken
url have the host of the empty name; broken markup is read as far as it goes (an
element that is never closed ends with its parent); references are decoded, unknown
ones stay; pages of hosts with fewer than ``PAGES`` pages have no template and are
extracted by their elements alone; repeated rows are returned each time; very long
pages are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablelab.llm import kernels
from tablelab.session import materialise

TOKENS, PAGES, SALT, BROADCAST = 2, 3, 4096, 1_000_000

#: Elements of HTML.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")
VOID = frozenset("area base br col embed hr input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
NOT_MAIN = frozenset("nav header footer aside form button select option datalist dialog head template svg math menu object canvas audio video".split()) | set(RAW)
MAIN = frozenset(("article", "main"))
#: Elements that end an open one of the same kind.
ENDS = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
#: Elements at whose beginning an open paragraph ends.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id or role that say what is not main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar header masthead footer contentinfo sidebar aside complementary "
    "widget widgets related recommended share sharing social comment comments respond reply replies disqus newsletter subscribe subscription signup "
    "login popup modal overlay search hidden".split()
)
COMMENTS = frozenset("comment comments reply replies respond".split())

#: Attributes up to the end of the tag; quoted values may hold ``>``, a quote that is never closed ends with the tag.
_INSIDE = r"(?:[^<>\"']|\"[^\"<]{0,4096}\"|'[^'<]{0,4096}')*+(?=>|\Z)|[^>]*"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:" + _INSIDE + r")(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<shut>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>" + _INSIDE + r")(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", re.I)


def _digest(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)))


class Element:
    __slots__ = ("name", "role", "main", "out")

    def __init__(self, name: str, role: int, main: bool, out: bool) -> None:
        self.name, self.role, self.main, self.out = name, role, main, out


def _opened(name: str, attributes: str, parent: Element) -> Element:
    says = sorted({w for m in _ATTRIBUTE.finditer(attributes) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())}) if attributes else []
    named = COMMENTS if name in MAIN else NAMES if name not in ("html", "body") else ()
    out = parent.out or name in NOT_MAIN or any(w in named for w in says) or (bool(attributes) and _HIDDEN.search(attributes) is not None)
    return Element(name, _digest(parent.role, name, *says), parent.main or name in MAIN or "role" in attributes and "main" in says, out)


def tokens(page: str) -> Iterator[tuple[int, str | None, bool, bool, int]]:
    """The page's tokens in order: number, text (None: an element is opened), whether it may be main text, whether inside an article, and its block.

    Texts come as they stand in the page; inline elements do not cut a block.
    """
    stack, block, here = [Element("", 0, False, False)], 0, 0

    def text(piece: str) -> Iterator[tuple]:
        if piece and not piece.isspace():
            top = stack[-1]
            yield _digest(top.role, "text", " ".join(piece.split())), piece, not top.out, top.main, block
        elif piece:
            yield 0, " ", not stack[-1].out, stack[-1].main, block

    for m in _TAG.finditer(page):
        yield from text(page[here : m.start()])
        here = m.end()
        name = m["name"]
        if m["raw"] is not None:
            block += m["raw"].lower() not in ("script", "style", "noscript")
            continue
        if name is None:
            continue
        name = name.lower()
        attributes = m["attributes"] or ""
        if name in INLINE:
            if m["shut"]:
                if stack[-1].name == name:
                    del stack[-1]
            elif attributes and name not in VOID and name != "img":
                top = _opened(name, attributes, stack[-1])
                if top.out and not stack[-1].out:  # an advert or a notice within a line
                    stack.append(top)
            continue
        block += 1
        if m["shut"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if at:
                del stack[at:]
            continue
        if name in VOID:
            continue
        ends = "p" if name in BLOCKS else ENDS.get(name)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == ends:
                    del stack[i:]
                    break
                if ends == "p" and stack[i].name not in INLINE or stack[i].name in ("ul", "ol", "dl", "table"):
                    break
        top = _opened(name, attributes, stack[-1])
        if not (attributes.endswith("/") and name in ("svg", "math")):
            stack.append(top)
        yield top.role, None, not top.out, top.main, block
    yield from text(page[here:])


def extract(page: str, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page, its host's template taken away."""
    found = list(tokens(page))
    article = any(main and usable for _, _, usable, main, _ in found)
    blocks: dict[int, list[str]] = {}
    for number, text, usable, main, block in found:
        if text is not None and usable and (main if article else number not in template):
            blocks.setdefault(block, []).append(text)
    cleaned = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
    return " ".join(b for b in cleaned if b)


def _host(url: Column) -> Column:
    """A number for the host of a URL, without user and port; the empty name where there is none."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.xxhash64(F.lower(F.regexp_replace(name, r"^.*@|:\d*$", "")))


def _sequences(pages: DataFrame) -> DataFrame:
    """``host``, ``texts`` (a digest of the texts that may be main) and ``tokens`` in page order of every page."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for page in batch.column(1):
                own = list(tokens(page.as_py() or ""))
                texts.append(_digest(*[n for n, t, usable, _, _ in own if t and n and usable]))
                found.append(np.array([n for n, *_ in own if n], np.uint64).view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            digests = pa.array(np.array(texts, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, held], names=["host", "texts", "tokens"])

    rows = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(scan, "host long, texts long, tokens array<long>")
    # Pages with the same texts count once; which of them does not depend on the order of rows.
    return rows.groupBy("host", "texts").agg(F.min("tokens").alias("tokens"), F.count("*").alias("copies"))


def _vectors(sequences: DataFrame) -> DataFrame:
    """``host``, ``token``, ``pages`` and two sums of fingerprints, a term a page and number of occurrences there."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            column = batch.column(2)
            row = np.repeat(np.arange(len(host)), np.diff(column.offsets.to_numpy()))
            token = column.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((token, row))
            row, token = row[order], token[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (token[1:] != token[:-1])]))
            times = np.diff(new, append=len(row)).astype(np.uint64)
            term = kernels.mix(texts[row[new]].view(np.uint64) + times * kernels.numbers(71, 1)[0])
            low, high = (term & np.uint64(0xFFFFFFFF)).astype(np.int64), (term >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (host[row[new]], token[new], low, high))], names=["host", "token", "low", "high"])

    rows = sequences.select("host", "texts", "tokens").mapInArrow(terms, "host long, token long, low long, high long")
    return rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def _with_templates(rows: DataFrame, templates: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` with the column ``template`` of their ``host`` (null: none): by broadcast if all templates are small together."""
    if (templates.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST:
        return rows.join(F.broadcast(templates), "host", "left")
    hosts = hosts.select("host", "rows")
    portions = templates.join(hosts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor(F.col("rows") / SALT).cast("int"))))
    busy = hosts.filter(F.col("rows") >= SALT).select("host", F.floor(F.col("rows") / SALT).cast("int").alias("most"))
    # At most one host in SALT rows is busy.
    salted = rows.join(busy, "host", "left")
    salted = salted.withColumn("salt", F.coalesce(F.floor(F.rand(7) * (F.col("most") + 1)).cast("int"), F.lit(0))).drop("most")
    return salted.join(portions.drop("rows"), ["host", "salt"], "left").drop("salt")


def _checked(rows: DataFrame) -> DataFrame:
    """``host``, ``class``, ``shape`` (its tokens in their order) and ``whole`` for each class on each page: ordered, and nested with the others."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, None] = {}
            for host, found, template in zip(*(c.to_pylist() for c in batch.columns)):
                of = {t["token"]: t["class"] for t in template}
                size: dict[int, int] = {}
                for c in of.values():
                    size[c] = size.get(c, 0) + 1
                order: dict[int, list[int]] = {}
                for t in found:
                    if t in of:
                        order.setdefault(of[t], []).append(t)
                bad, stack, place = set(), [], {}
                for c, own in order.items():
                    n = size[c]
                    if len(own) % n or len(set(own[:n])) != n or own != own[:n] * (len(own) // n):
                        bad.add(c)
                for t in found:
                    c = of.get(t)
                    if c is None or c in bad:
                        continue
                    if c in place:
                        while stack[-1] != c:  # an open class inside would go on outside
                            other = stack[-1]
                            loser = min(c, other, key=lambda x: (size[x], x))
                            bad.add(loser)
                            if loser == c:
                                break
                            stack.pop()
                            place.pop(other)
                        if c in bad:
                            stack.remove(c)
                            place.pop(c)
                            continue
                    else:
                        stack.append(c)
                        place[c] = 0
                    place[c] += 1
                    if place[c] == size[c]:
                        stack.pop()
                        place.pop(c)
                for c, own in order.items():
                    seen[(host, c, _digest(*own[: size[c]]), c not in bad)] = None
            columns = list(zip(*seen)) or [[], [], [], []]
            shapes = np.array(columns[2], np.uint64).view(np.int64)
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(shapes), pa.array(columns[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "class", "shape", "whole"])

    return rows.mapInArrow(check, "host long, class long, shape long, whole boolean")


def deduce_templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host`` and its ``template`` (tokens and their classes); and of every host its ``distinct`` pages and all its ``rows``."""
    sequences = materialise(_sequences(pages), "sequences")
    hosts = sequences.groupBy("host").agg(F.count("*").alias("distinct"), F.sum("copies").alias("rows"))
    frequent = _vectors(sequences).filter(F.col("pages") >= PAGES).join(hosts, "host").filter(F.col("pages") * 2 >= F.col("distinct"))
    frequent = materialise(frequent.select("host", "token", F.xxhash64("pages", "low", "high").alias("class")), "vectors")
    large = frequent.groupBy("host", "class").agg(F.count("*").alias("n")).filter(F.col("n") >= TOKENS).select("host", "class")
    classes = frequent.join(large, ["host", "class"])

    def by_host(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("template"))

    candidates = materialise(by_host(classes), "classes")
    rows = _with_templates(sequences.select("host", "tokens"), candidates, hosts).filter("template IS NOT NULL")
    judged = _checked(rows.select("host", "tokens", "template")).groupBy("host", "class")
    valid = judged.agg(F.min("shape").alias("a"), F.max("shape").alias("b"), F.bool_and("whole").alias("whole"))
    valid = valid.filter((F.col("a") == F.col("b")) & F.col("whole")).select("host", "class")
    return materialise(by_host(classes.join(valid, ["host", "class"])), "templates"), hosts


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url`` and the main ``text`` of every page, with its length ``n_chars``."""
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    templates, hosts = deduce_templates(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cache: dict[int, frozenset] = {}
            texts = []
            for host, page, template in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if host not in cache:
                    cache[host] = frozenset(t % (1 << 64) for t in template or ())
                texts.append(extract(page or "", cache[host]))
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), out], names=["id", "url", "text"])

    tokens_only = templates.select("host", F.col("template.token").alias("template"))
    joined = _with_templates(rows.withColumn("host", _host(F.col("url"))), tokens_only, hosts).select("host", "id", "url", "html", "template")
    kind = rows.schema["id"].dataType.simpleString()
    done = joined.mapInArrow(cut, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
