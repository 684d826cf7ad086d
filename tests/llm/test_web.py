"""WARC, HTML, chat and nearest neighbours."""

import io
import math
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from mavelake.llm import ann, chat, html, warc
from mavelake.llm.common import table

from ..helpers import same


def test_warc_sql(spark, duck, sf_dir):
    same(warc.digests(spark, table(spark, sf_dir, "pages")).toPandas(), duck.sql(warc.ORACLE_SQL).df())


def test_warc_round_trip(spark, tmp_path):
    big, long = "xé" * 2000, "y" * 400_000
    rows = [(1, "http://a/ü b", big), (2, "u", big), (3, None, big), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (2, "u", big), (8, "u\r\nX: y", long)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    index, folder = warc.archive(spark, pages, str(tmp_path / "archive"))
    assert folder.startswith("file:///")
    got = warc.read(index, folder, payloads=True).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1) for r in got) == sorted((i or -1, len((t or "").encode()), "revisit" if t == big and i != 3 else "response", 3 if t == big and i != 3 else -1) for i, _, t in rows)
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {big, "", "short", long}
    one = warc.fetch(index, folder, spark.createDataFrame([(5,), (1,)], "record_id long")).collect()
    assert sorted((r.page_id, r.record_type) for r in one) == [(1, "revisit"), (5, "response")]
    assert warc.digests(spark, pages.limit(0)).count() == 0
    # any frame can be read by itself, and a plain reader can read the whole file
    import zstandard

    fs, _ = warc.open_store(folder)
    path = index.first().bundle
    with fs.open_input_file(path) as f:
        frames = warc.seek_table(f, f.size())
        f.seek(0)
        data = f.read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert sum(u for *_, u in frames) == len(whole) and len(list(warc.parse(whole))) > 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="nav-open"><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
 three<br>four<p>five &copy; &eacute;&#8364;<script>var x="</p>";</script><ul><li>a<li>b</ul>
<aside>side</aside><form><input value="q">Search</form><blockquote>quote</blockquote><div class="ad">buy</div></article>
<section id="comments"><p>great post</p></section><footer>&copy; site</footer></body>"""


def texts_of(spark, pages, host="one"):
    """Texts of pages, each the only one of its site."""
    df = spark.createDataFrame([(i, f"http://{host}{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract(df).orderBy("page_id").collect()]


def test_html_blocks(spark):
    pages = [PAGE, "<div><p>just <i>text</i></p></div>", "<p>cut <a hre", "a < b", "<!-- x -->", "<article><p>a</p><div class='search-tips'>b</div></article>"]
    assert texts_of(spark, pages) == ["Head & line\nOne two three four\nfive © é€\na\nb\nquote", "just text", "cut", "a < b", "", "a"]
    assert html.blocks("") == []


def test_html_comments_and_headlines():
    page = '<article><div class="header"><h1>Title</h1></div><p>text</p></article><section class="comments-area"><article class="comment"><p>reader</p></article></section><div class="user-comments"><article><p>one more</p></article></div>'
    assert [(text, role == html.TEXT) for _, text, role in html.blocks(page)] == [("Title", True), ("text", True), ("reader", False), ("one more", False)]


def test_html_unclosed_quotes():
    """A quote that isn't closed is no quote; where quotes leave a tag without an end, it ends at its first `>`."""
    texts = lambda page: [text for _, text, _ in html.blocks(page)]
    assert texts('<p title="x>hello</p><p>b') == ["hello", "b"]
    assert texts("<p title=it's>hello</p>") == ["hello"]
    assert texts('<p title="a>b">hello <b x=\'>\'>bold</b></p>') == ["hello bold"]
    assert texts('<p a="> <p b=">c') == ["c"]
    assert texts("a <b and c") == ["a"] and texts("1 < 2 </ 3 <") == ["1 < 2 </ 3 <"] and texts("a<!-- b") == ["a"] and texts("a<!b") == ["a"]


@pytest.mark.parametrize("page", ["<div>x" * 166_000, '<a "' * 250_000, '<a b="> "' * 110_000, "<!" * 500_000, "<div>" * 100_000 + "</x>" * 100_000, "</p><p>y" * 120_000])
def test_html_long_pages(page):
    """A megabyte of unclosed elements, tags and quotes takes time in proportion."""
    began = time.process_time()
    found = html.blocks(page)
    tree = html.nodes(found)
    assert time.process_time() - began < 6
    assert len(found) == max(page.count(">x"), page.count(">y"), '> "' in page) and len(tree) <= html.DEPTH


def test_style_tree(spark):
    """What recurs on all pages of a site is dropped; what differs stays."""
    page = lambda i: f'<html><body><div class="top"><div class="x"><p>All rights at Example</p><p>Write to us</p></div></div><div class="body"><div class="y"><p>story {i} {i * 7}</p><p>more of {i}</p></div></div></body></html>'
    rows = [(i, f"http://s.example/{i}", page(i)) for i in range(12)] + [(50, "http://other.example/1", page(50)), (51, None, None), (52, "bad url", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i] == f"story {i} {i * 7}\nmore of {i}" for i in range(12))
    assert got[50] == "All rights at Example\nWrite to us\nstory 50 350\nmore of 50" and got[51] == "" and got[52] == ""
    assert html.extract(df.limit(0)).count() == 0


def test_style_tree_in_articles(spark):
    """What recurs in the articles of all pages of a site is dropped; an article that recurs as a whole stays."""
    page = lambda i: f'<html><body><article><p>story {i} {i * 7}</p><div class="tail"><p>Write to the author</p></div></article></body></html>'
    rows = [(i, f"http://s.example/{i}", page(i)) for i in range(12)] + [(50 + i, f"http://same.example/{i}", page(50)) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} {i * 7}" for i in range(12))
    assert all(got[50 + i] == "story 50 350\nWrite to the author" for i in range(6))


class Plain(HTMLParser):
    """Blocks of the pages of `pages`, by the standard library's parser: (path, text, kind)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.text = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        joined = " ".join("".join(self.text).split())
        self.text = []
        if joined and not {"script", "style", "title"} & set(self.stack):
            kind = "noise" if {"nav", "footer", "div.ad", "head"} & set(self.stack) else "text" if "article" in self.stack else ""
            self.out.append(("".join(">" + x for x in self.stack), joined, kind))

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            return
        if tag == "br":
            self.text.append(" ")
            return
        self.end()
        if self.stack and self.stack[-1] == "p":
            self.stack.pop()
        if tag != "meta":
            self.stack.append(".".join([tag, *sorted(dict(attrs).get("class", "").split())]))

    def handle_endtag(self, tag):
        if tag in ("a", "b"):
            return
        self.end()
        while any(x.split(".")[0] == tag for x in self.stack):
            if self.stack.pop().split(".")[0] == tag:
                break

    def handle_data(self, data):
        self.text.append(data)


def brute_importance(pages):
    """Composite importance of every node of one site, by the definition, from scratch."""
    styles, contents = defaultdict(list), defaultdict(lambda: defaultdict(set))
    for i, found in enumerate(pages):
        paths = {p[: j or None] for p, *_ in found for j in [0, *(k for k, c in enumerate(p) if c == ">" and k)]}
        for p in paths:
            styles[p].append(frozenset(q.rpartition(">")[2] for q in paths if q.rpartition(">")[0] == p))
        for p, t, _ in found:
            contents[p][t].add(i)

    def of(p):
        m, kinds = len(styles[p]), Counter(styles[p])
        if m == 1:
            return 1.0
        node = -sum(k / m * math.log(k / m, m) for k in kinds.values())
        below = [of(q) for q in styles if q.rpartition(">")[0] == p and len(styles[q]) >= html.MIN_PAGES]
        if contents[p]:
            below.append(1 - sum(math.log(len(x), m) for x in contents[p].values()) / len(contents[p]))
        g = html.GAMMA ** len(kinds)
        return (1 - g) * node + g * (sum(below) / len(below) if below else node)

    return {p: of(p) for p in styles if len(styles[p]) >= html.MIN_PAGES and not p.endswith((">html", ">body"))}


def brute_texts(rows):
    """Texts of pages (id, url, html) by a plain tree for each site."""
    sites, out = defaultdict(list), {}
    for i, url, page in rows:
        sites[url.split("/")[2].lower()].append((i, Plain(page or "").out))
    for found in sites.values():
        importance = brute_importance([b for _, b in found])
        under = lambda p, ok: any((p == q or p.startswith(q + ">")) and ok(x) for q, x in importance.items())  # noqa: E731, B023
        for i, b in found:
            article = any(k == "text" for *_, k in b)
            open_ = [(p, t, k) for p, t, k in b if k == "text" or (k == "" and (not article or under(p, lambda x: x >= html.HIGH)))]
            chosen = [t for p, t, _ in open_ if not under(p, lambda x: x < html.LOW)]
            out[i] = "\n".join(chosen or [t for _, t, k in open_ if k == "text"])
    return out


def test_html_table(spark, sf_dir):
    """The whole table, and pages of the same make with recurring and outlying parts, against the plain tree."""
    pages = table(spark, sf_dir, "pages")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    extra = []
    for n, (i, _, page) in enumerate(rows[:24]):
        more = page.replace("</article>", f"<section><p>Sent by the desk</p><p>Read on</p></section></article><section><p>{'All rights kept' if n % 2 else 'No rights kept'}</p></section><div class='more'><p>A note of page {n}</p></div>")
        extra.append((10**6 + i, f"http://made{n % 3}.example/{i}", more))
    df = spark.createDataFrame(rows + extra, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    want = brute_texts(rows + extra)
    assert {i: t for i, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())
    mine = [got[i][0] for i, *_ in extra]
    assert not any("Sent by the desk" in t or "rights kept" in t for t in mine) and all("A note of page" in t for t in mine)


def test_html_ties_and_repeats(spark):
    """Equal pages of a site keep their articles and give equal rows."""
    page = "<html><body><article><p>one</p><p>one</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://a.example/", page)] * 5, "page_id long, url string, html string")
    assert [r.text for r in html.extract(df).collect()] == ["one\none"] * 5


def test_chat(spark, duck, sf_dir):
    same(chat.digests(chat.with_probe(table(spark, sf_dir, "conversations"))).toPandas(), duck.sql(chat.ORACLE_SQL).df())
    rows = [(1, 0, "user", "a\\#<: \\\\h </turn>\n### x"), (1, 1, "assistant", "b\\"), (1, 2, "assistant", None), (1, 3, None, "end"), (None, None, "odd: role", "x"), (2, 0, "user", ""), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.expand(df)
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.trained) for r in chat.read_back(ex).collect()}
    assert back == {1: ([(r[2] or "", r[3] or "") for r in rows[:4]], "b\\"), None: ([("odd: role", "x")], ""), 2: ([("user", "")], ""), 3: ([("assistant", "t")] * 2, "tt")}
    mine = ex.where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in mine] == [2, 3, 4] and mine[0].formatted[mine[0].loss_start :][: mine[0].loss_chars] == "b\\\\" and mine[2].loss_chars == 0
    assert chat.digests(df.limit(0)).count() == 0
    plan = chat.digests(chat.with_probe(table(spark, sf_dir, "conversations")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "LogicalRDD" not in plan and "ExistingRDD" not in plan


def brute_nearest(ids, x, q, k):
    d = np.sqrt(((x - q[1]) ** 2).sum(1))
    return [(i, v) for v, i in sorted((v, i) for v, i in zip(d.tolist(), ids, strict=True) if i != q[0])][:k]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_ann_recall(spark, sf):
    rows = table(spark, sf, "embeddings").toPandas()
    ids, x = rows.vec_id.tolist(), np.array(rows.embedding.tolist(), float)
    got = ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 10 == 0).toPandas()
    hits = n = 0
    for q, part in got.groupby("query_id"):
        want = brute_nearest(ids, x, (q, x[ids.index(q)]), 10)
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(want) + 1))
        hits += len(set(part.vec_id) & {i for i, _ in want})
        n += len(want)
        d = {i: float(np.sqrt(((x[ids.index(i)] - x[ids.index(q)]) ** 2).sum())) for i in part.vec_id}
        assert np.allclose(part.score, [d[i] for i in part.vec_id], rtol=0, atol=1e-12)
    assert hits / n >= 0.9


def test_ann_far_from_origin(spark):
    """Exact within the candidates even where distances are small beside the norms."""
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, probes=16).toPandas()
    for q in range(0, 400, 20):
        part = got[got.query_id == q].sort_values("rank")
        assert list(zip(part.vec_id, part.score, strict=True)) == brute_nearest(list(range(400)), x, (q, x[q]), 10)


def test_ann_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(1, 8)] + [(100, [1.0, 0, 0, 0, 0]), (200, None), (300, []), (400, [0.0] * 5), (500, [1.0, None, 0, 0, 0]), (600, [float("nan"), 1, 1, 1, 1.0]), (700, [float("inf"), 1, 1, 1, 1.0]), (800, [1.0, 2.0]), (None, [1.0] * 5)]
    rows += [(20 + i, [0.5, 0.5, 0, 0, 0]) for i in range(40)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = ann.search(df, F.col("vec_id") % 100 == 0, split_rows=8).orderBy("query_id", "rank").collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 5 and None not in v and np.isfinite(v).all() and any(v)]
    want = brute_nearest([i for i, _ in good], np.array([v for _, v in good]), (100, np.array([1.0, 0, 0, 0, 0])), 10)
    mine = [r for r in got if r.query_id == 100]
    assert [(r.vec_id, round(r.score, 9)) for r in mine] == [(i, round(v, 9)) for i, v in want] and {r.query_id for r in got} == {100}
    few = ann.search(df.where("vec_id IN (1, 2, 100)"), F.col("vec_id") == 100).count()
    assert few == 2 and ann.search(df.limit(0), F.col("vec_id") == 1).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_rotation_keeps_lengths(dim):
    x = np.random.default_rng(dim).normal(size=(10, dim))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 0), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("size", [1e160, 1e-200, 1e307])
def test_nearest_of_any_size(spark, size):
    """Squares of these components overflow or vanish, but the distances are doubles."""
    x = np.random.default_rng(8).normal(size=(200, 16)) / 8
    found = []
    for by in (1.0, size):
        df = spark.createDataFrame([(i, [float(c) for c in v * by]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found.append(ann.search(df, F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").toPandas())
    assert len(found[0]) == 20 and (found[0].vec_id == found[1].vec_id).all()
    assert np.allclose(found[0].score * size, found[1].score, rtol=1e-12, atol=0)
