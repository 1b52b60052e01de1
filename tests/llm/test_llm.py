"""Each operator against a brute-force version, and on empty, null, long, tied and repeated rows."""
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ripplescope.llm import bpe, html_extraction, jaccard_join, lm_scoring, media, near_dup, packing, pii, token_counts, toxicity
from ripplescope.llm._graph import components

LONG = " ".join(f"w{i % 997}é" for i in range(30_000))
TEXTS = ["a  b\n\n c's 12 <|endoftext|>!", "", None, " ", "The cat, the Cat. THE", "x" * 3000, LONG, "The cat, the Cat. THE", "naïve Öl \x1c 字 😀\t\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with those of the operators' own."""
    rows = [(i, t, "n", 1.0, "w") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "n", 1.0, "w"), (None, "the null id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, score double, n string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = token_counts.token_counts(docs, path).collect()
    assert len(rows) == len(TEXTS) + 2 and token_counts.token_counts(empty, path).count() == 0
    for r in rows:
        text = "the null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(tok.encode(text, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_token_counts_of_random_texts():
    from tokenizers import Tokenizer

    path, rng = P.path("byte_bpe_50k.json"), random.Random(1)
    tok, counter = Tokenizer.from_file(path), token_counts._counter(path)
    texts = ["".join(rng.choice([" ", "  ", "\n", "a", "é", "1", "!", "'s", "字", "\x1c", " "]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert counter.counts(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_bpe(docs, empty):
    import tiktoken

    how = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(how[0]), special_tokens={})
    for r in bpe.round_trip(docs, *how).collect():
        text = "the null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe.round_trip(empty, *how).count() == 0
    again = bpe.decode(bpe.encode(docs, *how), *how)
    assert again.columns == ["doc_id", "ids", "decoded"] and again.count() == len(TEXTS) + 2


def test_bpe_of_random_texts():
    import tiktoken

    how, rng = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(2)
    coder = bpe._coder(*how)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["".join(rng.choice(["a", "th", "in", " ", "  ", "\n", "é", "1", "!", "'s", "\x1c", "😀"]) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["ab" * 3000]
    assert [np.frombuffer(i, "<u4").tolist() for i in coder.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        coder.decode(np.array([10**6]), np.array([1]))


def test_media(docs, empty):
    rows = media.media(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and media.media(empty).count() == 0
    for r in rows:
        raw = ("the null id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = media.payload_of(raw)
        assert len(payload) % 64 == 0 and payload.startswith(raw) and not payload[len(raw) :].strip(b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by = {r.doc_id: r[1:] for r in rows}
    assert by[4] == by[7] and by[1] == by[2]


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    pieces = lambda x: {x[a:b] for a, b in zip([0, *media.cuts(x)], media.cuts(x))}
    assert b"".join(body[a:b] for a, b in zip([0, *media.cuts(body)], media.cuts(body))) == body
    assert len(pieces(body) & pieces(b"new" + body)) > 0.8 * len(pieces(body))


def test_media_stored_form(docs):
    """The stored form put together here from the text gives the same sizes, digest and feature."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=media.LEVEL)
    for r in media.media(docs.filter("doc_id in (0, 1, 5, 6)")).collect():
        payload = media.payload_of((TEXTS[r.doc_id] or "").encode())
        ends = media.cuts(payload)
        chunks = [payload[a:b] for a, b in zip([0, *ends], ends)]
        stored = b"".join(hashlib.sha256(c).digest() + pack.compress(c) for c in chunks)
        counts = Counter(payload)
        entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in counts.values())
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert (int(said["chunks"]), int(said["values"])) == (len(chunks), len(counts)) and abs(float(said["entropy"]) - entropy) < 1e-3 and abs(float(said["mean"]) - sum(payload) / len(payload)) < 1e-3


def test_long_texts(spark):
    """Tens of megabytes in one row, in many words and in one."""
    import tiktoken
    from tokenizers import Tokenizer

    texts = {1: "some words, and more; " * 900_000, 2: "x" * 2_000_000}
    long = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    how = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    row = bpe.round_trip(long.filter("doc_id = 1"), *how).select(F.size("ids").alias("n"), F.sha2("decoded", 256).alias("h")).first()
    assert row.h == hashlib.sha256(texts[1].encode()).hexdigest()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(how[0]), special_tokens={})
    assert row.n == len(enc.encode_ordinary(texts[1]))
    path = P.path("byte_bpe_50k.json")
    assert token_counts.token_counts(long.filter("doc_id = 1"), path).first().n_tokens == len(Tokenizer.from_file(path).encode(texts[1], add_special_tokens=False).ids)
    assert {r.doc_id: r.n_shingles for r in jaccard_join.jaccard_join(long, 3, 90).collect()} == {1: 4, 2: 1}
    assert {r.doc_id: r.n_tokens for r in lm_scoring.score(long, F.lit(False)).collect()} == {1: 3_600_001, 2: 2}
    assert {r.doc_id: r.payload_sha256 for r in media.media(long).collect()} == {i: hashlib.sha256(media.payload_of(t.encode())).hexdigest() for i, t in texts.items()}


def test_words_that_cross_blocks(monkeypatch):
    from ripplescope.llm import _words

    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "C", " ", "\n", "é", "x" * 50]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    whole = _words.word_hashes(texts)
    monkeypatch.setattr(_words, "BLOCK", 37)
    assert all((a == b).all() for a, b in zip(whole, _words.word_hashes(texts)))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    cut = packing.pieces(docs, path, capacity=256, tail=16)
    rows = packing.pack(cut, capacity=256, group_tokens=4096).filter("doc_id is not null").toPandas()
    assert packing.pack(packing.pieces(empty, path)).count() == 0
    for i, text in enumerate(TEXTS):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        times = 2 if i == 0 else 1
        mine = rows[rows.doc_id == i].sort_values("start")
        assert mine.length.sum() == times * len(ids) and (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, seq in rows.groupby("sequence_id"):
        assert seq.length.sum() <= 256
    lengths = np.sort(np.random.default_rng(0).integers(1, 4000, 3000))[::-1]
    parts = packing.assign(lengths, np.minimum(lengths, 128), 4096)
    fill = Counter()
    for _, _, size, k, offset in parts:
        assert offset == fill[k]
        fill[k] += size
    assert max(fill.values()) <= 4096 and 4096 * len(fill) < 1.01 * lengths.sum()


def test_pii_matches_plain_search(spark, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    rng = random.Random(3)
    parts = ["a@b.c", "_", "%", ".", "-", " ", "1", "22", "256", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "", "é", "😀", "@", "d@e", "+", "00000", "\n", "(", ")"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for i in range(1500)}
    texts |= {9000: None, 9001: "1" * 20000 + " x@" + "a." * 9000 + "b", 9002: "1-" * 20000, 9003: "a" * 30000, 9004: "+1" + "(" * 20000}
    found = pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for r in found.collect():
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, x) in enumerate(patterns.items()) for m in re.finditer(x, texts[r.doc_id] or "") if ok(kind, m[0]))
        assert [(s.start, s.rank, s.end, s.kind) for s in r.pii if s.rank < 4] == spans
    assert pii.find(empty).count() == 0
    row = pii.redact(pii.find(spark.createDataFrame([(1, "mail a@b.co, IBAN DE89 3704 0044 0532 0130 00, DE00 3704 0044 0532 0130 00, ssn 123-45-6789 or 123-45-6789" + "." * 90)], "doc_id long, text string"))).first()
    assert row.text.startswith("mail [EMAIL], IBAN [IBAN], DE00") and "ssn [NID]" in row.text
    key = "4ffd0c85c7b8d733c0b5c7d364eda8ac88d929d1"
    row = pii.redact(pii.find(spark.createDataFrame([(1, f'token = "{key}" but commit {key}')], "doc_id long, text string"))).first()
    assert row.text.startswith('token = "[SECRET]"')


def test_pii_in_long_texts(spark):
    """Many spans, and overlapping ones, in runs: offsets and the redacted text against a plain version."""
    n = 3000
    text = "é".join(f" u{i}@m.org 10.0.0.{i % 300} +1 (555) 10{i:05d}" for i in range(n))
    frame = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, None)], "doc_id long, text string, pii string")
    rows = pii.find(frame, out_col="spans").collect()
    assert rows[0].pii == "x" and rows[0].spans == rows[1].spans and rows[2].spans == []
    by = {k: [text[s.start : s.end] for s in rows[0].spans if s.kind == k] for k in ("email", "ip", "phone")}
    assert by["email"] == [f"u{i}@m.org" for i in range(n)] and by["ip"] == [f"10.0.0.{i % 300}" for i in range(n) if i % 300 < 256] and len(by["phone"]) == n
    at, out = 0, []
    for s in rows[0].spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    redacted = pii.redact(pii.find(frame, out_col="spans"), spans_col="spans").filter("text is not null").first().text
    assert redacted == "".join(out) + text[at:]
    assert pii.find(frame).columns == ["doc_id", "text", "pii"]


def test_html():
    page = """<html><head><title>no</title><script>var t="</p>";</script></head><body class="has-menu"><div id="top-menu"><a href=x>Home</a></div><div class="ad">Buy, now. Buy.</div>
    <article class="post"><h1>The   title</h1><p><b>First, one&amp;two.<br><p>A second paragraph, longer; with marks.</p><ul><li>one<li>two</ul><form>sign up</form></article>
    <div class="comments"><p>Great, nice article. I like it a lot, really.</p></div><footer>&copy; me</footer></body></html>"""
    assert html_extraction.main_text(page) == "The title\n\nFirst, one&two.\n\nA second paragraph, longer; with marks.\n\none\n\ntwo"
    assert [html_extraction.main_text(p) for p in (None, "", "<p></p>", "plain", "<div class=ad>only, this.</div>", "<a 'b")] == ["", "", "", "plain", "only, this.", "<a 'b"]
    assert html_extraction.main_text("<p>" + "word, " * 50_000 + "</p>").count("word,") == 50_000


@pytest.mark.parametrize("tag,n", [("article", 4), ("article", 400), ("div", 4), ("div", 400)])
def test_html_keeps_what_is_beside_the_longest_container(tag, n):
    long = "".join(f"<p>Sentence {i}, which is long; it has marks, and words.</p>" for i in range(n))
    page = f"<body><ul><li><a href=x>Home page</a></ul><{tag}><h1>The title</h1><p>A lead.</p><div><section>{long}</section></div><section><h2>More</h2><p>A short section, the last.</p></section></{tag}></body>"
    text = html_extraction.main_text(page).split("\n\n")
    assert text[:2] == ["The title", "A lead."] and text[-1] == "A short section, the last." and text[2].startswith("Sentence 0") and len(text) >= n + 3
    assert "Home page" not in text and "More" in text


def test_html_marks_take_no_wrapper_out():
    body = "".join(f"<p>Sentence {i}, which is long; it has marks, and words.</p>" for i in range(9))
    talk = "".join(f"<article><p>Comment {i}, which is as long; it has marks, and words.</p></article>" for i in range(9))
    for wrap in ('<div class="page has-sidebar">', '<div class="content no-comments">', '<section id="main-menu-page"><div class="has-ad">'):
        for inner in (body, f"<article>{body}</article>"):
            text = html_extraction.main_text(f"<body><p>A stray line.</p>{wrap}{inner}<div class=ad>Buy, now.</div></div></section></body>")
            assert text.count("Sentence") == 9 and "Buy" not in text
    text = html_extraction.main_text(f"<body><div class=post>{body}</div><div id=comments>{talk}</div></body>")
    assert text.count("Sentence") == 9 and "Comment" not in text
    assert html_extraction.main_text("<p>x</p><div class=ad>Only, this.</div><div class=ad>And, this.</div>") == "x\n\nOnly, this.\n\nAnd, this."
    text = html_extraction.main_text(f'<body><div class="has-sidebar"><article>{body}</article><div id="comments">{talk}</div></div></body>')
    assert text.count("Sentence") == 9 and "Comment" not in text


def test_html_odd_pages():
    body = "".join(f"<p>Sentence {i}, which is long; it has marks, and words.</p>" for i in range(9))
    text = html_extraction.main_text(f'<p>Skip.</p><div class="layout has-sidebar"><article>{body}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, then.</p></article></div>')
    assert text.count("Sentence") == 9 and "Let x=1, then." in text
    assert "no" not in html_extraction.main_text(f'<script src="a.js"/>var x = "no, no.";</script><article>{body}</article>')
    for deep in ("<div>" * 10_000 + "one, two." + "</div>" * 10_000, "<div>one, two." * 10_000, "<b>" * 10_000 + "one, two."):
        assert "one, two." in html_extraction.main_text(deep)


def test_html_against_a_plain_version():
    """A second reader for pages of one article: what html.parser gives inside the article, but for comments and notices in it."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.inside, self.out, self.now = [], 0, [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "input"):
                self.now.append(" ")
                return
            if tag == "article":
                self.inside += 1
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            bad = tag in ("aside", "form", "script", "style", "nav", "footer", "header") or tag == "div" and any(x in names for x in ("comment", "ad", "share", "related", "newsletter", "promo"))
            self.skip.append((tag, bad))
            if tag not in ("a", "b", "em", "i", "strong", "span", "code"):
                self.flush()

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "em", "i", "strong", "span", "code"):
                self.flush()
            while self.skip and self.skip.pop()[0] != tag:
                pass
            if tag == "article":
                self.inside -= 1

        def handle_data(self, data):
            if self.inside and not any(bad for _, bad in self.skip):
                self.now.append(data)

        def flush(self):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

    rng = random.Random(6)
    for _ in range(60):
        para = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(8, 60))) + rng.choice([".", ", so.", "; &amp; more."])
        inner = f"<h1>{para()}</h1>" + "".join(rng.choice([f"<p>{para()}</p>", f"<p>{para()} <a href=x>{para()}</a> <em>x</em></p>", f"<ul><li>{para()}</li><li>{para()}</li></ul>", f"<h2>{para()}</h2><p>{para()}</p>", "<aside>see, also.</aside>", '<div class="share">Share, it.</div>']) for _ in range(rng.randint(3, 12)))
        page = f"<body><nav><a href=a>Home</a></nav><div class='side'><ul><li><a href=b>Other page</a></li></ul></div><article>{inner}</article><div id=comments>" + "".join(f"<p>{para()}</p>" for _ in range(rng.randint(0, 3))) + "</div><footer>me</footer></body>"
        plain = Plain()
        plain.feed(page)
        assert html_extraction.main_text(page) == "\n\n".join(plain.out)


def test_html_rows(spark):
    rows = html_extraction.extract(spark.createDataFrame([(1, "u", "<p>a b</p>", 7), (1, "u", "<p>a b</p>", 7), (None, None, None, None)], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(map(str, rows)) == sorted(["Row(page_id=1, url='u', text='a b', n_chars=3)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])


def _shingles(text, k):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("words,percent", [(3, 90), (2, 80)])
def test_jaccard_join(spark, docs, empty, words, percent):
    rng = random.Random(words)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 12, 20, 60, 200]))] for _ in range(30)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(w) if i % 60 else rng.choice(["", None, "  "]), "x"))
    sets = {i: _shingles(t, words) for i, t, _ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), top(i)) for i in sets}
    if words == 3:
        rows = jaccard_join.jaccard_join(docs, 3, 90).collect()
        assert len(rows) == len(TEXTS) + 2 and {r.component_id for r in rows if r.doc_id in (4, 7)} == {4}
        assert jaccard_join.jaccard_join(empty, 3, 90).count() == 0


def test_light_sizes():
    assert jaccard_join.boundary({}, 90) == 0
    assert jaccard_join.boundary({10: (100, 1e6), 30: (100, 1e3)}, 90) in range(10, 30)
    for n in range(1, 60):
        for m in range(n, 60):
            least = jaccard_join.need(n, m, 90)
            assert all((100 * o >= 90 * (n + m - o)) == (o >= least) for o in range(n + 1))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {n: n for pair in links for n in pair}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == {n: top(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_scoring(docs, empty):
    held = F.col("doc_id") % 4 == 1
    rows = lm_scoring.score(docs, held).collect()
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "the null id"}
    tokens = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [b" "]
    counts = Counter(w for r in rows if not r.held_out for w in tokens(texts[r.doc_id]))
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(TEXTS) + 2 and {r.train_tokens for r in rows} == {total}
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known) == (r.doc_id is not None and r.doc_id % 4 == 1, len(own), sum(counts[w] > 0 for w in own))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), rel_tol=1e-9) and -1e7 < r.score < 0
    assert lm_scoring.score(empty, held).count() == 0
    only = lm_scoring.score(docs.filter("doc_id = 4"), F.lit(True)).first()
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0)


def test_rare_tokens_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "EXACT", 2)
    docs = spark.createDataFrame([(1, "a a a b c"), (2, "a b zz"), (3, "c c q")], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm_scoring.score(docs, F.col("doc_id") == 3).collect()} == {1: 6, 2: 4, 3: 3}


def test_tokens_beyond_ten_thousand_are_known(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "EXACT", 1)
    docs = spark.createDataFrame([(1, "a " * 10_500), (2, "b " * 10_600), (3, "a b q")], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm_scoring.score(docs, F.col("doc_id") == 3).collect()} == {1: 10_501, 2: 10_601, 3: 3}


def test_filter_counts():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 4000).astype(np.uint64))
    f = lm_scoring.Filter(bytes(1 << 12), 8, 2)
    assert not f.counts(keys).any()
    count = np.random.default_rng(1).integers(0, 3000, len(keys))
    f = lm_scoring.build_segment(keys, count)
    found = f.counts(keys)
    seen = count > 0
    assert (found[seen] >= count[seen] * 2 ** -0.125 - 1e-6).all() and (np.abs(np.log2(found[seen] / count[seen])) <= 0.126).mean() > 0.97 and (found[~seen] == 0).mean() > 0.9


@pytest.mark.parametrize("setting", [("BITS_EACH", 10), ("CHUNK", 1 << 12), ("EXACT", 4)])
def test_lm_score_keeps_every_pair(spark, monkeypatch, setting):
    """Against exact counts, whatever the sizes: a level's middle is off by 2 ** (1 / 8) at most."""
    monkeypatch.setattr(lm_scoring, *setting)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    tokens = {i: ["^", *t.split(), "$"] for i, t in rows}
    learned = [w for i, w in tokens.items() if i % 5]
    one, two = Counter(x for w in learned for x in w), Counter(p for w in learned for p in zip(w, w[1:]))
    space = sum(one.values()) - one["^"] + len(one)  # without starts, and one more
    found = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 == 0).collect()
    assert len(found) == len(rows)

    def exact(w, m, left_out=False):
        mine, pairs = (Counter(w), Counter(zip(w, w[1:]))) if left_out else (Counter(), Counter())
        return sum(math.log10((two[a, b] - pairs[a, b] + m * (one[b] + 1 - mine[b]) / space) / (one[a] - mine[a] + m)) for a, b in zip(w, w[1:]))

    likely = {m: sum(exact(w, m, True) for w in learned) for m in lm_scoring.WEIGHTS}
    close = [m for m in likely if all(abs(r.score - exact(tokens[r.doc_id], m)) <= 0.0477 * r.n_tokens for r in found)]
    assert close and max(likely[m] for m in close) >= 1.01 * max(likely.values())


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op10_near_dup", "media_payloads", "pii_base_kinds", "lm_base_scores"])
def test_queries_match_sql(spark, name):
    import duckdb

    from ripplescope.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    columns = sorted(expected.columns)
    found = queries.queries()[name](spark, data)
    assert sorted(found.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[i] for i in at) for r in expected.fetchall())


def _toxic_rows(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(["ta", "re", "mi", "on", "sel", "du"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(60)] = rng.choice(["scumbag", "vileness", "hatework"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark, docs, empty):
    rows = _toxic_rows(1200)
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    test = [(scored[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    good = sum(a > b for a, x in test if x for b, y in test if not y) / (sum(y for _, y in test) * sum(not y for _, y in test))
    assert good > 0.95
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in edge) and len({r.score for r in edge if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(texts, labels.filter("toxic = 0")) == 0.0 and toxicity.train(empty, labels) == pytest.approx(0.25, abs=0.05)
    assert toxicity.score(docs, 0.25).first().score == 0.25


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 16))
    rows, n = [], 0
    for b in base:
        for _ in range(rng.integers(1, 5)):
            rows.append((n, (b + rng.normal(size=16) * rng.choice([0.02, 0.2])).astype(np.float32).tolist(), int(n % 2)))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], None), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] + [1.0] * 15, 1), (n + 5, [1.0, 2.0], 1), (n + 5, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = near_dup.near_duplicates(frame).collect()
    assert len(found) == len(rows) and near_dup.near_duplicates(frame.filter("false")).count() == 0
    x = [np.array(r[1], np.float64) if r[1] is not None else None for r in rows]
    fine = [v is not None and np.isfinite(v).all() and v.any() and rows[i][2] is not None for i, v in enumerate(x)]
    true = {r[0]: 0 for r in rows}
    for i, v in enumerate(x):
        for j, u in enumerate(x):
            if i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(u) == len(v) and v @ u / math.sqrt((v @ v) * (u @ u)) >= 0.98:
                true[rows[i][0]] += 1
    by = {r.vec_id: r for r in found}
    ids = [r[0] for r in rows if r[0] is not None and r[0] != n + 5]
    assert all(by[i].n_links <= true[i] for i in ids) and sum(by[i].n_links for i in ids) >= 0.9 * sum(true[i] for i in ids)
    assert by[n + 5].n_links == 1 and by[n + 5].kept and by[None].component_id == 0 and not by[None].kept
    assert all(by[i].n_links == 0 and by[i].kept for i in range(n + 1, n + 5))


def _cliques(spark):
    """Clumps of near copies, as doubles, with what links there are."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(90):
        base = rng.normal(size=24)
        rows += [((base + rng.normal(size=24) * 0.05).tolist(), int(k % 2)) for _ in range(int(rng.integers(1, 14)))]
    frame = spark.createDataFrame([(i, v, y, "own", 1) for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<double>, label int, node string, c int").repartition(3)
    x = np.array([v for v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([y for _, y in rows])
    near = (x @ x.T >= 0.98) & (y[:, None] == y[None, :])
    np.fill_diagonal(near, False)
    return frame, near


@pytest.mark.parametrize("settings", [{}, {"SAMPLE": 64, "SHARD": 20, "CELL_ROWS": 30}, {"BLOCK": 50}, {"SETTINGS": ()}])
def test_near_duplicate_components(spark, monkeypatch, settings):
    """With one level of cells, two, several blocks in a shard, and the exact way."""
    for name, value in settings.items():
        monkeypatch.setattr(near_dup, name, value)
    frame, near = _cliques(spark)
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        if (new == label).all():
            break
        label = new
    found = {r.vec_id: r for r in near_dup.near_duplicates(frame).collect()}
    links = sum(found[i].n_links for i in range(len(near)))
    assert all(found[i].n_links <= near[i].sum() for i in range(len(near))) and links >= 0.95 * near.sum()
    assert "SETTINGS" not in settings or links == near.sum()
    assert sum(found[i].component_id != label[i] for i in range(len(near))) <= 0.02 * len(near) and all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    assert 200 >= counts[0] > counts[1] == counts[2] > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == counts[2]


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage against a plain version over clashing names, nulls, repeated rows and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = _toxic_rows(800)
    spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    mail = [(2000, "write to a@b.org " + rows[1][1], 5, "n"), (2000, "write to a@b.org " + rows[1][1], 5, "n"), (None, None, None, None), (2001, "", 0, "n")]
    columns = "doc_id long, text string, n_chars long, node string, score double, pii string"
    docs = spark.createDataFrame([(i, t, len(t), "n", 2.0, "p") for i, t, _ in rows] + [(*r, None, None) for r in mail], columns).repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "pii", "packing"]
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, model, keep=("text",)).collect()}
    kept = [r for r in docs.collect() if score[r.doc_id, r.text] < corpus_pipeline.REJECT]
    assert Counter(clean.collect()) == Counter(kept) and 500 < len(kept) < len(rows)
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    single = stages["jaccard_join"](spark, clean, str(tmp_path)).collect()
    sets = [_shingles(r.text, 5) for r in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {}
    for r, g in zip(kept, group):
        least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in single) == Counter(least.values())
    single = spark.createDataFrame(single, docs.schema)
    told = {r.doc_id: r for r in stages["pii"](spark, single, str(tmp_path)).collect()}
    for r in single.collect():
        want = None if r.text is None else r.text.replace("a@b.org", "[EMAIL]")
        assert told[r.doc_id].text == want and told[r.doc_id].n_chars == (None if want is None else len(want)) and told[r.doc_id].node == r.node
    packed = stages["packing"](spark, single, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == set(told) and max(Counter(p.sequence_id for p in packed for _ in range(p.length)).values()) <= 4096
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, b), (4, c), (5, a), (5, "a text of its own, long enough"), (6, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (3, b), (4, c), rows[8], (6, ""), (6, None)])


def test_pipeline_rejects_nothing_without_a_model(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 9


ARTICLE = "<article><h1>The title here</h1>" + "".join(f"<p>Paragraph {i} says something, at length; and ends here.</p>" for i in range(6)) + "</article>"


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><meta a=b>{}", "<body><form action=x>{}</form></body>", "<body><form id=f><div>{}</div><label>q</label><input></form><p>Foot.</p></body>", "<p title=it's>Lead, in.</p>{}",
    "<body><video src=a>{}</body>", "<svg><svg><path d=1/></svg></svg><svg>{}", "<select><option>a{}", "<object data=x>{}", "<template>{}", "<noscript>{}", "<script>var x=1;{}", "<title>Hello{}", '<a href="x>y</a>{}', "<nav><ul><li>a</ul>{}",
    '<p class=">">x</p><a b=">">{}',
])
def test_html_keeps_the_article_of_broken_pages(page):
    text = html_extraction.main_text(page.format(ARTICLE))
    assert [f"Paragraph {i} says" in text for i in range(6)] == [True] * 6 and "The title here" in text


def test_html_of_mangled_pages():
    """Tags without their end, quotes out of place and elements left open before, between and after an article's paragraphs."""
    rng = random.Random(8)
    bits = ["<video src=x>", "<svg><svg></svg>", "<p a=it's>", "<b>", "<div class='x'>", "</div>", "<head>", "<nav>", "<select>", '<i t="a>b">', "<form>", "</form>", "</p>", "< b", "<!-- c > d -->", "<!doctype x>", "<iframe src=a></iframe>", "<script>if (a<b) c('<p>')</script>"]
    for _ in range(200):
        page = "".join(rng.choices(bits, k=4)) + "<article>" + "".join(f"<p>Paragraph {i} says something, at length; and ends here.</p>" + rng.choice(["", *bits[:5], *bits[7:10]]) for i in range(6)) + "</article>" + "".join(rng.choices(bits, k=3))
        assert all(f"Paragraph {i} says" in html_extraction.main_text(page) for i in range(6)), page


def test_html_forms_go_but_for_the_page_itself():
    form = "<form><p>Write to us, please.</p><input></form>"
    assert "Write" not in html_extraction.main_text(f"<body>{ARTICLE}{form}</body>")
    assert "Write" not in html_extraction.main_text(f"<body><video>no</video><aside>no</aside>{ARTICLE}{form}</body>") and "no" not in html_extraction.main_text(f"<nav>no</nav>{ARTICLE}")


@pytest.mark.parametrize("bit", ["<a ", '<a "x"', '<a x=">"', "<!--", "<!", "<script>", "<title>", "<svg>", "</svg>", "<nav>", "<form>", "<p x='", "<x>", '<a class="x ', "=<a=", "<td><b><dd>"])
def test_html_takes_time_in_proportion(bit):
    began = time.perf_counter()
    html_extraction.main_text(bit * (1_200_000 // len(bit)))
    html_extraction.main_text(bit * (1_200_000 // len(bit)) + ">")
    assert time.perf_counter() - began < 12


def test_bpe_of_many_long_words_and_other_patterns():
    import tiktoken

    path, rng = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(9)
    assert bpe.CUT == P.PATTERN
    coder, ranks = bpe._coder(path, P.PATTERN), bpe.read_ranks(path)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(10_000))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == enc.encode_ordinary(text)
    for pattern in (r"\p{Lu}?\p{Ll}+|\p{N}{1,3}|\s+|.", r"[a-z]+| "):
        other, enc = bpe._coder(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        texts = ["HelloWorld, 12345 times. a b", "", *(t for t in TEXTS if t)]
        assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_other_tokenizers_are_honoured(spark):
    from tokenizers import Tokenizer

    texts = [t for t in TEXTS if t] + ["Hello world", "a (b) c's"]
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing._Ids(path).encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing._ids(P.path("word_bpe_49k.json")).cuts and token_counts._counter(path).cuts
    other = token_counts._Counter(P.path("word_bpe_49k.json"))
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert not other.cuts and other.counts(texts) == [len(words.encode(t, add_special_tokens=False)) for t in texts]


def test_packing_leaves_large_ids_alone(spark):
    rows = [(9007199254740993, "a b"), (None, "c"), (9007199254740995, None), (-9223372036854775807, "d e f")]
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path("word_bpe_49k.json"))
    found = packing.pack(cut).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows) and {r.sequence_id for r in found} == {0}
    names = packing.pieces(spark.createDataFrame([("x", "a"), (None, "b")], "doc_id string, text string"), P.path("word_bpe_49k.json"))
    assert {r.doc_id for r in packing.pack(names).collect()} == {"x", None}


def test_toxicity_scores_from_compressed_lengths(spark):
    """Each score again: windows cut by a plain loop, compressed one by one with the model's two dictionaries."""
    import zstandard

    rows = _toxic_rows(400)
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(texts, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    dictionaries, weights = model
    how = zstandard.ZstdCompressionParameters(window_log=15, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0)

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(b" " + window + b" "))

    def windows(raw):
        space, i = b" \t\n\r\x0b\x0c", 0
        while i < len(raw):
            if raw[i] in space:
                i += 1
                continue
            ends = [j for j in range(i + 1, min(i + 64, len(raw)) + 1) if j == len(raw) or raw[j] in space]
            stop = max(ends, default=i + 64)
            yield raw[i:stop]
            i = stop

    some = [t for t in (*(r[1] for r in rows[:25]), "", "x" * 200, "a\x0bb  \n c", " A b ") if t is not None]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in toxicity.score(frame, model).collect():
        d = [length(w, dictionaries[1]) - length(w, dictionaries[0]) for w in windows(some[r.doc_id].encode().lower())]
        top = sorted(d, reverse=True)[:3] or [0]
        over = sum(x - 2 for x in d if x > 2) / math.sqrt(len(d) + 5)
        z = sum(w * x for w, x in zip(weights, (1, top[0], sum(top), over)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def _sentence_texts(n):
    rng = random.Random(n)
    stock = [" ".join(f"w{rng.randrange(5000)}" for _ in range(9)) for _ in range(20)]
    return [" ".join(rng.sample(stock, 10)) for _ in range(n)]


def test_jaccard_join_of_texts_from_common_sentences(spark, monkeypatch):
    """No two link; of the pairs that meet in the lists few come out of them."""
    seen, plain, room = [], jaccard_join._crossed, jaccard_join._has_room

    def counted(rest, percent):
        found = plain(rest, percent)
        monkeypatch.setattr(jaccard_join, "_has_room", lambda *_: F.lit(True))
        seen.append((found.count(), plain(rest, percent).count()))
        monkeypatch.setattr(jaccard_join, "_has_room", room)
        return found

    monkeypatch.setattr(jaccard_join, "_crossed", counted)
    texts = _sentence_texts(1000)
    found = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 3, 90).collect()
    assert all(r.component_id == r.doc_id for r in found)
    assert seen[0][1] > 10_000 and seen[0][0] < 0.02 * seen[0][1]


def test_bits_of_listed_shingles_never_rule_a_link_out(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        a = [rng.getrandbits(63) - 2**63 for _ in range(rng.choice([1, 3, 9, 40, 400]))]
        b = rng.sample(a, rng.randint(0, len(a))) + [rng.getrandbits(63) for _ in range(rng.randint(1, 20))]
        rows.append((k, a, b, len(a) + rng.randint(0, 5), len(b) + rng.randint(0, 5)))
    both = spark.createDataFrame(rows, "k int, a array<long>, b array<long>, na int, nb int")
    x = both.select("k", F.col("na").alias("n"), *jaccard_join._bits("a")).alias("x")
    y = both.select("k", F.col("nb").alias("n"), *jaccard_join._bits("b")).alias("y")
    kept = {r[0] for r in x.join(y, F.col("x.k") == F.col("y.k")).filter(jaccard_join._has_room("x", "y", 80)).select("x.k").collect()}
    for k, a, b, na, nb in rows:
        if len(set(a) & set(b)) + max(na - len(a), nb - len(b)) >= jaccard_join.need(na, nb, 80):
            assert k in kept


def test_near_duplicate_counts_agree_with_components(spark):
    """A vector with links is in a component with others, one without is alone, and both ends of a pair count it."""
    frame, near = _cliques(spark)
    found = {r.vec_id: r for r in near_dup.near_duplicates(frame).collect()}
    members = Counter(r.component_id for r in found.values())
    assert all((r.n_links > 0) == (members[r.component_id] > 1) for r in found.values())
    assert sum(r.n_links for r in found.values()) % 2 == 0


def test_pipeline_stages_keep_columns_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rows = _toxic_rows(200)
    docs = spark.createDataFrame([(i, t, 1.5, 7, ["x"], "own") for i, t, _ in rows], "doc_id long, text string, __score double, __row int, __spans array<string>, __pii_text string")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "__score", "__row", "__spans", "__pii_text"]
        assert docs.count() > 50 and docs.filter("__score <> 1.5 or __row <> 7 or __spans[0] <> 'x' or __pii_text <> 'own'").count() == 0
