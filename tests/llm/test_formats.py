"""Chat, fingerprint, BPE, HTML and embedding operators, registered queries and the pipeline."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bourselake.llm import bpe, chat_format, embedding_dedup, fingerprints, html_text
from bourselake.llm.chat_format import DELTA, EDIT, MESSAGE, REGENERATE

LOG = "conv_id long, seq long, kind string, message string, role string, text string, turns int, position string, formatted int"


def log(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], LOG)


def test_events_fold_into_final_messages(spark):
    rows = [
        (1, 5, DELTA, "b", None, "lo "), (1, 4, DELTA, "b", "assistant", "Hel"), (1, 1, MESSAGE, "a", "user", "hi"), (1, 6, DELTA, "b", None, "you"),
        (1, 2, EDIT, "a", "user", "hello?"), (1, 7, MESSAGE, "c", "user", "more"), (1, 8, REGENERATE, "b", None, "New"), (1, 9, DELTA, "b", None, " text"),
        (1, 10, MESSAGE, "d", "user", None), (2, None, None, None, None, "x"), (2, None, None, None, None, "x"), (None, 1, MESSAGE, None, "user", "lost"),
    ]
    got = {}
    for r in sorted(chat_format.fold_events(log(spark, rows)).collect(), key=lambda r: (str(r.conv_id), r.position)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "hello?"), ("assistant", "New text"), ("user", "")], 2: [("", "x"), ("", "x")], None: [("user", "lost")]}
    assert chat_format.render(chat_format.fold_events(log(spark, []))).count() == 0


HARD = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s> [\\INST]", "[OUT]x[[OUT]]", "", "a\\", "\\", "<", "</s", "日本\n🤖[/INST]", "[" * 50 + "INST]", "$1 \\1", "x" * 200_000]


def test_rendering_is_reversible(spark):
    roles = ["user", "assistant", "system", None, "assistant\n", "a\\nb", "</s>", "\\", "\\\n"]
    rows = [(i, j, MESSAGE, None, role, text) for i, role in enumerate(roles) for j, text in enumerate([*HARD, None])]
    chats = chat_format.render(chat_format.fold_events(log(spark, rows))).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()
    assert len(chats) == len(roles)
    for chat in chats:
        want = [(roles[chat.conv_id] or "", text or "") for text in [*HARD, None]]
        assert [(t.role, t.text) for t in chat.turns] == want
        learned = roles[chat.conv_id] == "assistant"
        assert len(chat.loss_spans) == (len(want) if learned else 0) and all(t.learned == learned for t in chat.turns)
        for span, (_, text) in zip(chat.loss_spans, want, strict=False):
            part = chat.formatted[span["from"] : span["to"]]
            assert part == text or any(c in text for c in "<[")
        marks = [chat.formatted.count(m) for m in ("<s>", "[INST]", "[/INST]", "[OUT]", "</s>")]
        n = len(want)
        assert marks == [1, 0, 0, n, n] if learned else marks == [1, n, n, 0, 0]


def brute_fingerprint(text, size=5):
    """The same rule with plain loops."""
    words = [w for w in text.lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    bins = [None] * fingerprints.BINS
    for i in range(max(len(one) - size, 0) + 1):
        h = 42
        for x in one[i : i + size]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        h >>= 1
        b = h >> 56
        bins[b] = h if bins[b] is None else min(bins[b], h)
    out = []
    for b, x in enumerate(bins):
        if x is None:
            for t in range(1, fingerprints.ATTEMPTS + 1):
                h = xxhash.xxh64_intdigest(t.to_bytes(4, "little") + b"", xxhash.xxh64_intdigest(b.to_bytes(4, "little"), 42))
                x = bins[signed(h) % fingerprints.BINS]
                if x is not None:
                    break
            else:
                x = next(bins[(b + t) % fingerprints.BINS] for t in range(1, fingerprints.BINS + 1) if bins[(b + t) % fingerprints.BINS] is not None)
        out.append((x & 255) - 128)
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, own string, next_text int")


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 20, 90, 300, 2000, 7, 7, 150, 40)] + ["", None, "  \t ", "Same Text", "same text", "日本"]
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)] + [(0, "a repeated id"), (None, "no id")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.document_fingerprints(documents(spark, rows)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    checked = 0
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        if 0 in (i, ordered[(k + 1) % len(ordered)][0]):
            continue  # the order of repeated ids is that of hashes
        (r,) = by_id[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = (brute_fingerprint(t) for t in (text, edited, following))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x + 128:02x}" for x in own) and r.edited_fingerprint == "".join(f"{x + 128:02x}" for x in changed)
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            if own and other:
                same = sum(x == y for x, y in zip(own, other, strict=True)) / 128
                assert math.isclose(near, max(0, (same - 1 / 256) / (1 - 1 / 256)))
            else:
                assert near == float(own == other)
        checked += 1
    assert checked >= len(rows) - 5
    assert fingerprints.document_fingerprints(documents(spark, [])).count() == 0
    (alone,) = fingerprints.document_fingerprints(documents(spark, [(1, "abcd")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(60):
        words = [f"w{rng.random()}" for _ in range(1000)]
        other = list(words)
        at = 10 * (i % 30)
        other[:at] = [f"v{rng.random()}" for _ in range(at)]
        a, b = ({tuple(x[j : j + 5]) for j in range(996)} for x in (words, other))
        rows.append((i, " ".join(words), " ".join(other)))
        want.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = [r[0] for r in df.orderBy("i").select(fingerprints.likeness("fa", "fb")).collect()]
    errors = np.array(got) - np.array(want)
    assert abs(errors.mean()) < 0.03 and errors.std() < 0.06


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, sf_dir, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    tokenizer = Tokenizer.from_file(vocabulary)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", None, " ", "don't WE'LL I'vE", "<|startoftext|>hi<|endoftext|><|END|>", "İstanbul ΟΔΟΣ ẞ ﬁ", "日本語 12½Ⅷ", "é é 🤖👍🏽", "\x00a\x00", "a" * 5000, "ab " * 60_000]
    texts += ["".join(rng.choice("abcdeinorst'") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x4E00, 0x4EFF), rng.randint(0x1F300, 0x1F5FF)])) for _ in range(40)) for _ in range(300)]
    rows = [*enumerate(texts), (0, texts[0]), (None, "x")]
    got = bpe.encode(documents(spark, rows), vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        want = tokenizer.encode("x" if r.doc_id is None else texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    few = {r.doc_id: r for r in bpe.digests(documents(spark, rows[:50]), vocabulary).collect()}
    for r in got:
        if r.doc_id in range(1, 50):
            ids = np.array(r.ids, "<u4").tobytes()
            assert few[r.doc_id][1:] == (len(r.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
    assert bpe.encode(documents(spark, []), vocabulary).count() == 0


def test_bpe_forgets_and_learns_again(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.Encoder(bpe.load(vocabulary))
    texts = [f"alpha beta{i} gamma{i * i} delta" for i in range(200)]
    again = list(bpe.Encoder(bpe.load(vocabulary)).encode(texts))
    assert [x for i in range(0, 200, 8) for x in encoder.encode(texts[i : i + 8])] == again


ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph with <a href='x'>a link</a> and words,\n  <b>some</b> of them\tbold.<p>Second&nbsp;paragraph &lt;tag&gt; &#233;.<ul><li>One<li>Two</ul>"
TEXT = "Title & more First paragraph with a link and words, some of them bold. Second paragraph <tag> é. One Two"
AROUND = [
    "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>", '<div class="ad">Buy this now, it is very good and cheap.</div>', "<header><h2>Site name</h2><p>The motto of this site</p></header>",
    "<footer>&copy; us, all rights reserved</footer>", "<aside><p>Other things you may read about, and more of them.</p></aside>", '<div id="cookie-notice"><p>We use cookies on this site for all the usual reasons.</p></div>',
    "<form action='/s'><p>Sign up for letters</p><input name=q><button>Go</button></form>", '<section class="comments"><h3>3 comments</h3><article class="comment"><p>A reader says that this is a good article and that it helped.</p></article></section>',
    "<script>if (a < b) { document.write('<p>no</p>') }</script>", "<style>p > b { color: red }</style>", "<!-- <p>hidden</p> -->", '<div class="sidebar-right"><p>Side text</p></div>', '<div style="display: none">unseen</div>',
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', "<div><div class='post-body'>{}</div></div>", "<main><article><div>{}</div></article></main>"])
def test_the_article_alone_is_left(shell):
    rng = random.Random(6)
    for _ in range(10):
        parts = rng.sample(AROUND, 6)
        html = f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(parts[:3])}{shell.format(ARTICLE)}{''.join(parts[3:])}</body></html>"
        assert html_text.main_text(html) == TEXT, html


@pytest.mark.parametrize(
    ("html", "text"),
    [(None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<p>b</p>c", "a b c"), ("a < b > c", "a < b > c"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("x<br>y<br/>z", "x y z"),
     ("<p>un<b>bro</b>ken</p>", "unbroken"), ("<script>never closed <p>x", ""), ("<![CDATA[kept]]>", "kept"), ("<p title='a>b'>in</p>", "in"), ("<nav>only menu</nav>", "")],
)
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_names_that_only_hold_a_word_cut_nothing():
    text = "A long enough sentence of the article, with all the words that it takes."
    around = "<nav><a href='/'>Home</a></nav>"
    assert html_text.main_text(f"<body>{around}<div class='content has-sidebar'><p>{text}</p><p>{text}</p></div></body>") == f"{text} {text}"
    parts = ["<h2 id='side-effects'>{}</h2>", "<section id='discussion'><p>{}</p></section>", "<section class='related-work'><p>{}</p></section>", "<p id='search-results'>{}</p>"]
    for part in parts:
        html = f"<body>{around}<article><h1>Title</h1><p>{text}</p>{part.format(text)}<div class='related'><a href='a'>One</a> <a href='b'>Two</a> <a href='c'>Three</a></div><p>{text}</p></article></body>"
        assert html_text.main_text(html) == f"Title {text} {text} {text}"
    assert html_text.main_text(f"<article class='post comments-open'><p>{text}</p><div class='sidebar'>{text}</div></article>") == text


def test_pages_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "t", 1), (1, "u", f"<article>{ARTICLE}</article>", "t", 1), (None, None, None, None, None), (2, "v", "<p>" + "word " * 100_000, "t", 1)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 499_999)]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert len(html_text.main_text("<div>" * 50_000 + "deep")) == 4


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 16)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    rng = np.random.default_rng(4)
    rows, centres = [], rng.normal(size=(6, 12))
    for i in range(150):
        v = centres[rng.integers(6)] + rng.normal(size=12) * rng.choice([0.02, 0.15, 0.35])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(200 + i, list(rows[i][1]), rows[i][2]) for i in range(20)]  # copies
    rows += [(300, [2 * x for x in rows[0][1]], rows[0][2]), (301, [-x for x in rows[0][1]], rows[0][2])]
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] + [1.0] * 11, 1), (403, [float("inf")] + [1.0] * 11, 1), (404, [None, *rows[0][1][1:]], rows[0][2]), (405, [], 1)]
    rows += [(406, rows[0][1], None), (407, rows[0][1][:5], rows[0][2]), (None, rows[0][1], rows[0][2]), (408, [1e-30] * 12, 2), (409, [1e30] * 12, 2)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, rep string")
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for (i, a, la), (j, b, lb) in itertools.combinations(good, 2):
        if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
            links.append((i, j))
    assert len(links) > 300
    above = {i: i for i, *_ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(above[i], above[j])
            changed |= above[i] != low or above[j] != low
            above[i] = above[j] = low
    counts = {i: sum(i in link for link in links) for i in above}
    got = embedding_dedup.near_embeddings(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == sorted((i, counts[i], above[i], above[i] == i) for i in above)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, None)]
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_queries_equal_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from bourselake.llm import queries

    connection = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = connection.execute(sql).df()
        got = queries.QUERIES[name](spark, sf_dir).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        order = [c for c in ("doc_id", "vec_id", "conv_id") if c in columns]
        for a, b in zip(*(x.sort_values(order)[columns].astype(str).to_numpy().tolist() for x in (got, want)), strict=True):
            assert a == b, name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = set(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept = {r.doc_id for r in rows}
        assert len(rows) == len(kept) and kept <= ids
        if name == "quality":
            assert len([i for i in ids - kept if quality.get(i) == 1]) <= 0.03 * len(ids)
            assert any(quality.get(i) == 0 for i in ids - kept)
        if name in ("language_id", "near_dedup"):
            assert all(before[r.doc_id] == r.text for r in rows)
        if name == "substring_dedup":
            assert all(len(r.text) == r.n_chars <= len(before[r.doc_id]) for r in rows)
        ids = kept
    packed = corpus_pipeline.packing(spark, docs, sf_dir).toPandas()
    assert set(packed["doc_id"]) == ids and packed.groupby("bin_id")["length"].sum().max() <= 2048
    again = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(map(tuple, again[["doc_id", "part", "length"]].to_numpy().tolist())) == sorted(map(tuple, packed[["doc_id", "part", "length"]].to_numpy().tolist()))


@pytest.mark.parametrize(
    "part",
    [
        '<p title="the hidden fort">{0}</p>',
        '<p>{0} <a href="/hidden/x">{0}</a></p>',
        '<div data-hidden="false"><p>{0}</p></div>',
        '<section data-id="comments"><p>{0}</p></section>',
        '<div data-class="footer"><p>{0}</p></div>',
        "<p data-style='display:none'>{0}</p>",
        '<section data-note="id=sidebar"><p>{0}</p></section>',
        "<section data-note='class=\"footer\" hidden'><p>{0}</p></section>",
        "<section data-class=sidebar data-x=hidden><p>{0}</p></section>",
        '<blockquote class="side"><p>{0}</p></blockquote>',
        "<noscript><p>{0}</p>",
        "<template><p>{0}</p>",
    ],
)
def test_values_and_other_names_cut_nothing(part):
    text = "The garrison left the valley before the snow came and nobody wrote down why."
    html = f"<html><body><nav><a href='/'>Home</a></nav><article><p>{text}</p>{part.format('A word about the ' + text)}<p>{text}</p></article></body></html>"
    got = html_text.main_text(html)
    assert got.startswith(text) and got.endswith(text) and "A word about the" in got and "Home" not in got


@pytest.mark.parametrize("part", ['<div hidden><p>{0}</p></div>', "<div class=sidebar><p>{0}</p></div>", "<div id='footer'><p>{0}</p></div>", '<div data-x="1" style="display: none"><p>{0}</p></div>'])
def test_own_names_still_cut(part):
    text = "The garrison left the valley before the snow came and nobody wrote down why."
    got = html_text.main_text(f"<html><body><article><p>{text}</p>{part.format('Not this.')}<p>{text}</p></article></body></html>")
    assert got == f"{text} {text}"


def plain_density(page, off, i):
    """The composite density of a node from its own subtree, walked anew."""
    from math import e, log

    def inside(j, k):
        while j != k and j:
            j = page.parents[j]
        return j == k

    def linked(j):
        while j:
            if page.tags[j] == "a":
                return True
            j = page.parents[j]
        return False

    nodes = range(len(page.tags))
    size = lambda k, only_links=False: sum(len("".join(t.split())) for j, t in page.texts if t and not off[j] and inside(j, k) and (linked(j) or not only_links))
    body = next((j for j in nodes if page.tags[j] == "body"), 0)
    below = [j for j in nodes if j != i and j and not off[j] and inside(j, i)]
    c, lc, t, lt = size(i), size(i, True), max(len(below), 1), max(sum(page.tags[j] == "a" for j in below), 1)
    if not c:
        return 0.0
    share = size(body, True) / size(body)
    base = log(c / max(c - lc, 1) * lc + share * c + e)
    return c / t * max(log(c / max(lc, 1) * t / lt), 0.0) / max(log(max(base, 1.0001)) + 1, 1)


@pytest.mark.parametrize("seed", range(8))
def test_densities_against_brute_force(seed):
    rng = random.Random(seed)

    def part(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "a", "span", "nav", "section"])
            inner = part(depth - 1) if depth and tag != "p" else " ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 12)))
            out.append(f"<{tag}>{inner}</{tag}>")
        return "".join(out)

    page = html_text.Page(f"<html><body>{part(3)}some text</body></html>")
    off, _ = html_text._off(page)
    _, _, densities = html_text._densities(page, off)
    for i in range(len(page.tags)):
        want = 0.0 if off[i] else plain_density(page, off, i)
        assert densities[i] == pytest.approx(want, rel=1e-9), (page.tags[i], i)
