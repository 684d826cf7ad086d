"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged: nodes with equal paths are one node of the site's tree, which counts the
pages that have it, their presentations (the kinds of children that the node has in a page) and their contents (texts of a
leaf), over all blocks, those of articles included. A node whose presentation is the same everywhere and whose contents recur
on many pages carries little information. With m pages and shares p_i of the presentations below node E, the importance is

    node(E)      = -sum p_i log_m p_i,                                   1 where m = 1
    composite(E) = (1 - g^l) node(E) + g^l (mean of the composites of its children), l presentations
    leaf(E)      = 1 - mean over contents a of log_m(pages with a)

Branches below LOW are removed from each page wherever they stand, in articles too; an article that is low as a whole stays,
as pages that are copies of each other have nothing else. What stands outside of a page's `article` or `main`, and elements
of which a part of a class or id names another role (`search-tips`), are kept where their branch reaches HIGH, and dropped
otherwise. Elements that state their role outright (nav, footer, aside, form, script ..., or a class, id or role that is such
a word as a whole, as `ad`) are no main text whatever their importance: menus and adverts can differ on every page, and then
the tree can't tell them from text.

Pages are parsed once; blocks and nodes are written to the shared folder, and all else are DataFrame functions, but for the
composites of one site's tree. Counts are pre-aggregated before their shuffles. Only nodes of at least MIN_PAGES pages are
weighed, as shares of fewer say little; a host of fewer pages has no low and no high branch. So a host's tree is bounded by
its pages' mean number of nodes, not by their number. The branches of a host are joined back, by broadcast only when Spark
finds them small.

Defined cases: a null or empty page has an empty text; a null url or one without a host belongs to host ''; pages are read
whole, in time that grows as they do; unclosed and stray tags are tolerated as browsers do, a tag that the page's end cuts off is
dropped, and of an element within more than DEPTH others only the node is its ancestor's, while its text stays; repeated pages give repeated rows and count as pages of their
site; ties in importance don't matter, as branches are compared with fixed levels; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A tag up to its end, which isn't within a quoted value; a quote that isn't closed is no quote. And up to the first `>`.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
TAG_START = re.compile(r"</?[a-zA-Z]")
SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that an opening tag of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are no main text by their kind, and classes, ids or roles that say so.
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select input textarea svg canvas object menu dialog head".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side-bar rail widget nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments discussion disqus reply replies respond form search pagination pager toolbar skip copyright legal".split())
CONTENT_TAGS = frozenset(["article", "main"])
GAMMA, LOW, HIGH, MIN_PAGES = 0.9, 0.2, 0.5, 4
#: Elements below this depth are part of their ancestor's node, and names of nodes longer than NAME are shortened by a hash.
DEPTH, NAME = 64, 64
#: What elements say of a block: it is noise outright, perhaps noise, nothing, or text.
OUTRIGHT, PERHAPS, NOTHING, TEXT = -2, -1, 0, 1


def stated(tag: str, attributes: str, above: int) -> int:
    """What an element says of its blocks, given what those above it say."""
    if above == OUTRIGHT or tag in NOISE_TAGS or (tag == "header" and above != TEXT):  # a header within content holds its headline
        return OUTRIGHT
    out = TEXT if tag in CONTENT_TAGS and above != PERHAPS else above  # an article among comments is one
    if not attributes or tag in ("html", "body"):
        return out
    for m in NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if name == "header" and above == TEXT:
                continue
            if name in NOISE_WORDS:
                return OUTRIGHT
            if not NOISE_WORDS.isdisjoint(re.split(r"[-_]+", name)):
                out = PERHAPS
    return out


def label(tag: str, attributes: str) -> str:
    """How a node is named in paths: its tag and classes."""
    names = sorted({x for m in NAMED.finditer(attributes) if m[1].lower() == "class" for x in (m[2] or m[3] or m[4] or "").split()}) if attributes else []
    name = ".".join([tag, *names]).replace(">", "")
    return name if len(name) <= NAME else f"{tag[:NAME]}.{zlib.crc32(name.encode(errors='replace')):08x}"


def blocks(page: str) -> list[tuple[str, str, int]]:
    """The blocks of a page in order: path, text, and what its elements say of it."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = []  # tag, path, role
    text: list[str] = []
    open_ = Counter[str]()  # elements on the stack
    at, pattern = 0, TAG

    def close(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            open_[tag] -= 1
        del stack[depth:]

    def end_block() -> None:
        if text:
            joined = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if joined:
                _, path, role = stack[-1] if stack else ("", "", NOTHING)
                out.append((path, joined, role))

    size = len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        text.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1 or size
            continue
        m = pattern.match(page, start)
        if m is None and TAG_START.match(page, start):
            pattern = SHORT_TAG  # quotes leave this tag without an end: it and those after it end at their first `>`
            m = pattern.match(page, start)
            if m is None:  # the page's end cuts the tag off
                break
        if m is None:
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), m[1]
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                text.append(" ")
            continue
        end_block()
        if closing:
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] not in ("p", "td", "th") or tag == "li":
                    break
        elif stack and stack[-1][0] == "p":
            close(len(stack) - 1)  # a block element ends a paragraph
        _, path, role = stack[-1] if stack else ("", "", NOTHING)
        if tag in RAW:
            e = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = e.end() if e else size
            continue
        if tag in VOID:
            continue
        stack.append((tag, f"{path}>{label(tag, m[3])}" if len(stack) < DEPTH else path, stated(tag, m[3], role)))
        open_[tag] += 1
    end_block()
    return out


def nodes(found: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """The nodes of a page's tree and their presentations."""
    children: dict[str, set[str]] = {}
    for path, _, _ in found:
        known = path in children
        children.setdefault(path, set())
        while path and not known:
            above, _, name = path.rpartition(">")
            known = above in children
            children.setdefault(above, set()).add(name)
            path = above
    return [(path, " ".join(sorted(names))) for path, names in children.items() if path]


def kept(found: Column, low: Column, high: Column) -> Column:
    """The texts of blocks that are main text, given the low and high branches of their site."""
    within = lambda b, tops: F.exists(tops, lambda x: (b.path == x) | F.startswith(b.path, F.concat(x, F.lit(">"))))
    has_article = F.exists(found, lambda b: b.role == TEXT)
    open_ = F.filter(found, lambda b: (b.role == TEXT) | ((b.role != OUTRIGHT) & (((b.role == NOTHING) & ~has_article) | within(b, high))))
    chosen = F.filter(open_, lambda b: ~within(b, low))
    whole = F.filter(open_, lambda b: b.role == TEXT)
    return F.transform(F.when((F.size(chosen) == 0) & has_article, whole).otherwise(chosen), lambda b: b.text)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def composite(rows: pd.DataFrame) -> dict[str, float]:
    """Composite importance of each node of one site's tree from its summary (path, m, n_s, s_log, n_c, c_log)."""
    nodes = {r.path: r for r in rows.itertuples()}
    below: dict[str, list[str]] = {}
    for p in nodes:
        below.setdefault(p.rpartition(">")[0], []).append(p)
    out: dict[str, float] = {}
    for path in sorted(nodes, key=lambda p: -p.count(">")):
        r = nodes[path]
        if r.m <= 1:
            out[path] = 1.0
            continue
        log_m = math.log(r.m)
        node = (log_m - r.s_log / r.m) / log_m
        parts = [out[c] for c in below.get(path, ())]
        if r.n_c:
            parts.append(1 - r.c_log / r.n_c / log_m)
        weight = GAMMA ** max(1, r.n_s)
        out[path] = (1 - weight) * node + weight * (sum(parts) / len(parts) if parts else node)
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """host, id, url, the blocks and the nodes of each page (pages: host, id, url, html)."""
    block = pa.struct([("path", pa.string()), ("text", pa.string()), ("role", pa.int32())])
    node = pa.struct([("path", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 512, 2 << 20):
                found = [blocks(page or "") for page in b.column(3).to_pylist()]
                made = []
                for kind, rows in ((block, found), (node, [nodes(x) for x in found])):
                    flat = [x for r in rows for x in r]
                    columns = zip(*flat, strict=True) if flat else [()] * len(kind)
                    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
                    edges = [0]
                    for r in rows:
                        edges.append(edges[-1] + len(r))
                    made.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["host", "id", "url", "blocks", "nodes"])

    schema = T.StructType([*(pages.schema[n] for n in ("host", "id", "url")), *T.StructType.fromDDL("blocks array<struct<path:string,text:string,role:int>>, nodes array<struct<path:string,value:string>>").fields])
    return common.cut(pages.select("host", "id", "url", "html").mapInArrow(common.tidy(run), schema), "parsed-pages")


def branches(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, high: float = HIGH) -> DataFrame:
    """host, low, high: the topmost branches of low and of high importance of each host that has any (pages: as parsed)."""
    one = lambda kind, x, value: F.struct(F.lit(kind).alias("kind"), x.path.alias("path"), F.xxhash64(value).alias("v"))
    inside = F.filter("blocks", lambda b: b.path != "")
    seen = F.concat(F.transform("nodes", lambda x: one("s", x, x.value)), F.array_distinct(F.transform(inside, lambda b: one("c", b, b.text))))
    counts = pages.select("host", F.explode(seen).alias("x")).select("host", "x.*").groupBy("host", "path", "kind", "v").agg(F.count("*").alias("n"))
    is_s, is_c = F.col("kind") == "s", F.col("kind") == "c"
    tree = counts.groupBy("host", "path").agg(
        F.sum(F.when(is_s, F.col("n"))).alias("m"),
        F.count(F.when(is_s, 1)).alias("n_s"),
        F.sum(F.when(is_s, F.col("n") * F.ln("n")).otherwise(0.0)).alias("s_log"),
        F.count(F.when(is_c, 1)).alias("n_c"),
        F.sum(F.when(is_c, F.ln("n")).otherwise(0.0)).alias("c_log"),
    )

    def tops(paths: list[str]) -> list[str]:
        found = set(paths)
        return sorted(p for p in found if not any(p[:i] in found for i, c in enumerate(p) if c == ">"))

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        importance = {p: x for p, x in composite(pdf).items() if p.rpartition(">")[2].partition(".")[0] not in ("html", "body")}
        found = tops([p for p, x in importance.items() if x < low]), tops([p for p, x in importance.items() if x >= high])
        return pd.DataFrame({"host": [key[0]], "low": [found[0]], "high": [found[1]]}, dtype=object)

    return tree.where(F.col("m") >= min_pages).groupBy("host").applyInPandas(judge, "host string, low array<string>, high array<string>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and its number of code points for each page."""
    base = parsed(pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    judged = common.cut(branches(base), "branches")
    none = F.array().cast("array<string>")
    joined = base.join(judged, "host", "left")
    text = F.array_join(kept(F.col("blocks"), F.coalesce("low", none), F.coalesce("high", none)), "\n")
    out = joined.select("id", "url", text.alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
