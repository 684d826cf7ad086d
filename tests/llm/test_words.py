"""Token alignment, URL templates and spelling variants: against the libraries and brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mavelake.llm import spelling, tokenalign, urltree
from mavelake.llm.bpe import printable_bytes
from mavelake.llm.common import table
from mavelake.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
needs_files = pytest.mark.skipif(not (os.path.exists(A) and os.path.exists(B)), reason="no tokenizer files here")
ODD = [None, "", " ", "  ", "a", "\u2581 x", "a \u2581", "x\n\ny  z ", "<|endoftext|> <s> </s> <0x41>", "日本語テキスト" * 9000, "z" * 40000, "  lead", "trail  ", "a \n b", "\x00 a\x1c b", "x\u0085 y", "\ufeffa b\u200b c", "\U0001f600\U0001f600 é é", "'s don't 'S", "abcXYZ123qjxz" * 5000, "the the the", "the the the"]


# --- tokens -----------------------------------------------------------------------------------------------------------


class Plain:
    """Both libraries over whole texts, and a loop with two pointers over the tokens' ends."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        alphabet = printable_bytes()
        self.of_a = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab().items() if set(t) <= alphabet.keys()}

    def of_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def document(self, text):
        """(groups, links), or None where there are no tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.of_a[i] for i in a], [self.of_b(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return None
        groups, links, i, j, end_a, end_b = [([a[0]], [b[0]])], [], 0, 0, len(x[0]), len(y[0])
        while True:
            links.append((a[i], b[j]))
            if end_a == end_b:
                i, j = i + 1, j + 1
                if i == len(a):
                    return groups, links
                groups.append(([a[i]], [b[j]]))
                end_a, end_b = end_a + len(x[i]), end_b + len(y[j])
            elif end_a < end_b:
                i += 1
                end_a += len(x[i])
                groups[-1][0].append(a[i])
            else:
                j += 1
                end_b += len(y[j])
                groups[-1][1].append(b[j])

    def rows(self, documents):
        found = [(i, self.document(t)) for i, t in documents]
        count, best = Counter(p for _, d in found if d for p in set(d[1])), defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        out = []
        for i, d in found:
            if d is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            groups, links = d
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def rows_of(df, *options):
    got = tokenalign.digests(df, A, B, hot_pairs=options[0] if options else tokenalign.HOT_PAIRS)
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()), key=str)


@needs_files
@pytest.mark.parametrize("hot", [tokenalign.HOT_PAIRS, 40])
def test_alignment_of_odd_texts(spark, plain, hot):
    """Nulls, empty texts, long runs without spaces, repeated rows and ids, clashing column names; pairs joined either way."""
    documents = [*enumerate(ODD), (3, "again the same id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in documents], "doc_id long, text string, _row int, pairs string")
    assert rows_of(df, hot) == plain.rows(documents)


@needs_files
def test_alignment_of_the_table(spark, plain, sf_dir):
    df = table(spark, sf_dir, "documents")
    assert rows_of(df) == plain.rows([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


@needs_files
def test_alignment_of_nothing(spark):
    assert rows_of(spark.createDataFrame([], "doc_id long, text string")) == []


@needs_files
def test_alignment_keeps_groups_and_pairs(spark):
    found = tokenalign.align(spark.createDataFrame([(1, "ab"), (2, "ab")], "doc_id long, text string"), A, B, keep_groups=True)
    groups = {r.groups for r in found.documents.collect()}
    assert len(groups) == 1 and re.fullmatch(r"[\d,|;]+", groups.pop())
    assert all(r.n_docs == 2 for r in found.pairs.collect())


@needs_files
@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab c\n\t'1é日\u2581\u00a0\U0001f600"), max_size=30), max_size=4), st.integers(1, 40))
def test_pieces_of_texts(plain, texts, piece):
    """Groups don't depend on where a text is cut into pieces, nor on what has been met before."""
    engine = _engine()
    before = tokenalign.PIECE, tokenalign.LONG
    tokenalign.PIECE, tokenalign.LONG = piece, max(2, piece // 3)
    try:
        got = tokenalign._aligned(engine, texts, True)
    finally:
        tokenalign.PIECE, tokenalign.LONG = before
    for text, row in zip(texts, got, strict=True):
        d = plain.document(text)
        assert row[5] == ("" if d is None else ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[0]))
        assert row[3] == (len(d[1]) if d else 0)


_MADE = []


def _engine():
    if not _MADE:
        with open(A, "rb") as a, open(B, "rb") as b:
            _MADE.append(tokenalign.Aligner(a.read(), b.read()))
    return _MADE[0]


# --- spelling ---------------------------------------------------------------------------------------------------------


def one_edit(s, t):
    if len(s) > len(t):
        s, t = t, s
    if len(s) == len(t):
        return sum(x != y for x, y in zip(s, t, strict=True)) == 1
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def plain_variants(count):
    out = {}
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 10 * count[w]:
            form[w] = best
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, count[w], len(near[w]), count[form[w]] if w in form else None)
    return out


def plain_words(documents):
    count = Counter()
    for i, text in documents:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_the_table(spark, sf_dir):
    df = table(spark, sf_dir, "documents").limit(120)
    got = variants_of(spelling.digests(df))
    assert got == plain_variants(plain_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))


def test_variants_of_odd_texts(spark):
    """Nulls, empty texts, very long words, ties, repeated rows, letters beyond ASCII, clashing names."""
    long = "xy" * 4000
    documents = [(1, None), (2, ""), (None, "Straße Straßen ÀÉÎÕÜàé ×÷×÷×÷×"), (3, f"{long} {long} {long}z {long}z"), *[(4, "marmelade Marmelade marmelad marmelad marmelady MARMELADE 12 ab")] * 3, (5, "marmelade " * 70), (6, "aaaaaaa aaaaaaaa " * 9 + "aaaaaab aaaaaab aaaaaba aaaaaba")]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in documents], "doc_id long, text string, n int, word string")
    assert variants_of(spelling.digests(df)) == plain_variants(plain_words(documents))
    assert variants_of(spelling.digests(spark.createDataFrame([], "doc_id long, text string"))) == {}


@pytest.mark.parametrize("most", [2, 1024])
def test_variants_in_split_buckets(spark, most):
    """One parent's variants share both halves with nearly all others: buckets are split until one letter is left."""
    parent = "abcdefghij"
    words = {parent: 10**6} | {parent[:i] + c + parent[i + 1 :]: 10 + i for i in range(10) for c in "xyz"} | {parent[:i] + "q" + parent[i:]: 100 for i in range(11)} | {parent[:i] + parent[i + 1 :]: 7 for i in range(10)} | {"abcdefghxx": 1, "a": 3, "b": 2, "": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants_of(spelling.variants(df, most=most)) == plain_variants(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=9), unique=True, max_size=40), st.sampled_from([2, 3]))
def test_index_pairs(words, q):
    words.sort(key=lambda w: (len(w), w))
    got = {(i, j) for i, j, _ in spelling.index_pairs(words, q)}
    assert got == {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}


# --- URLs -------------------------------------------------------------------------------------------------------------


def plain_rule(host, path, rules=urltree.RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_templates(paths):
    """{(host, path): (template, purity)} by recursion over each host's tree."""
    rules = {p: plain_rule(*p) for p in paths}
    good = {p: None if r is None else r.verdict == "allow" for p, r in rules.items()}
    segments = {p: [s for s in p[1].split("/") if s] for p in paths}
    template = {p: () for p in paths}
    for d in range(urltree.DEPTH):
        kinds, totals = Counter(), Counter()
        for p in paths:
            if len(segments[p]) > d:
                kinds[p[0], template[p], segments[p][d]] += 1
                totals[p[0], template[p]] += 1
        new = {}
        for p in paths:
            if len(segments[p]) > d:
                n, t = kinds[p[0], template[p], segments[p][d]], totals[p[0], template[p]]
                named = n >= urltree.LEAST and n >= urltree.SHARE * t
                new[p] = (*template[p], segments[p][d].replace("*", "%2A").replace("|", "%7C") if named else "*")
            else:
                new[p] = template[p]
        template = new
    template = {p: (*t, "**") if len(segments[p]) > urltree.DEPTH else t for p, t in template.items()}
    merged = dict(template)
    for d in reversed(range(max(map(len, template.values()), default=0))):
        nodes = defaultdict(dict)
        for p, t in merged.items():
            if len(t) > d:
                b = nodes[p[0], t[:d]].setdefault(t[d], {"segment": t[d], "n": 0, "labelled": 0, "good": 0, "next": Counter()})
                b["n"] += 1
                b["labelled"] += good[p] is not None
                b["good"] += good[p] is True
                b["next"][t[d + 1] if len(t) > d + 1 else ""] += 1
        classes = {k: urltree.merged(list(v.values())) for k, v in nodes.items()}
        merged = {p: (*t[:d], classes[p[0], t[:d]][t[d]], *t[d + 1 :]) if len(t) > d else t for p, t in merged.items()}
    share = lambda of, prior, weight: (sum(good[p] is True for p in of) + weight * prior) / (sum(good[p] is not None for p in of) + weight)
    whole = share(paths, 0.5, 2)
    hosts, leaves = defaultdict(list), defaultdict(list)
    for p in paths:
        hosts[p[0]].append(p)
        leaves[p[0], merged[p]].append(p)
    return {p: ("/" + "/".join(merged[p]), share(leaves[p[0], merged[p]], share(hosts[p[0]], whole, urltree.WEIGHT), urltree.WEIGHT)) for p in paths}


def check_urls(spark, urls):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    got = {r.page_id: r for r in urltree.judge(df).collect()}
    assert got.keys() == set(range(len(urls)))
    parts = [plain_parts(u) for u in urls]
    judged = plain_templates(set(parts))
    for i, p in enumerate(parts):
        rule, (template, purity) = plain_rule(*p), judged[p]
        r = got[i]
        assert (r.host, r.path, r.rule, r.template) == (*p, rule.name if rule else None, template)
        assert r.purity == pytest.approx(purity)
        assert r.verdict == (rule.verdict if rule else "block" if purity < 0.5 else "allow")
    return got


def test_urls_of_the_table(spark, sf_dir):
    check_urls(spark, [r.url for r in table(spark, sf_dir, "pages").select("url").collect()])


def test_odd_urls(spark):
    """Nulls, no scheme, ports, queries before paths, deep and very long paths, stars and bars, ties, repeated rows."""
    deep = "http://d.net/" + "/".join(f"s{i % 3}" for i in range(30))
    urls = [None, "", "no-scheme", "HTTP://WWW.Example.ORG/es/1", "http://example.org", "http://example.org?x=/es/", "http://EXAMPLE.org#/es/", "x://y://z/fr/", "http://badexample.org/es/", "http://com/fr/1", "http://a.com/fr", "http://a.com/FR/", "http://É.com/de/", *[deep] * 4, deep + "/x", "http://l.net/" + "v" * 50000, *["http://t.net/*/a|b"] * 3, "http://t.net/*/q", "http://t.net//x///y/"]
    check_urls(spark, urls)


def test_templates_decide(spark):
    """Where one language of a host is blocked and another allowed, a section without a rule follows the one that it is like."""
    urls = [f"http://a.com/{lang}/{kind}/{i}" for lang, kind in (("de", "shop"), ("fr", "news")) for i in range(60)]
    urls += [f"http://a.com/{lang}/{kind}/x{i}" for lang, kind in (("es", "shop"), ("en", "news")) for i in range(60)]
    got = check_urls(spark, urls)
    verdicts = {lang: {r.verdict for r in got.values() if r.path.startswith(f"/{lang}/")} for lang in ("de", "fr", "es", "en")}
    assert verdicts == {"de": {"block"}, "fr": {"allow"}, "es": {"block"}, "en": {"allow"}}


def test_no_urls(spark):
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
