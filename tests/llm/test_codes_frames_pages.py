"""Vector codes and fill-in-middle against brute force, page extraction on pages of known text."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from pyrogrid.llm import fim, main_text, vector_codes

VEC = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("a.b", T.StringType()),
    ]
)


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VEC)


def brute_codes(rows, entries, rounds, parts=4):
    """Lloyd's rounds with all comparisons, in Python's whole numbers."""
    kept = [
        (r[0], [math.floor(1024 * x) for x in r[1]], r[2])
        for r in rows
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    dim = len(kept[0][1])
    cut = [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in cut]

    def near(x, book):
        return min((sum((u - v) ** 2 for u, v in zip(x, c, strict=True)), i) for i, c in enumerate(book))

    for turn in range(rounds + 1):
        hits = [[near(r[1][a:b], book) for (a, b), book in zip(cut, books, strict=True)] for r in kept]
        if turn == rounds:
            break
        for p, (a, b) in enumerate(cut):
            for i in range(len(books[p])):
                mine = [r[1][a:b] for r, h in zip(kept, hits, strict=True) if h[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(
        repr((r[0], bytes(i for _, i in h), sum(d for d, _ in h))) for r, h in zip(kept, hits, strict=True)
    ), books


@pytest.mark.parametrize("entries", [5, 16])
def test_codes_are_brute_force(spark, entries):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), int(i % 3)) for i in range(120)]
    rows += [(200 + i, [0.5] * 16, None) for i in range(60)]  # a third of all in one vector
    rows += [(300 + i, np.round(rng.normal(size=16)).tolist(), 1) for i in range(60)]  # ties
    rows += [(7, rows[7][1], 1), (None, [-0.25] * 16, 2), (None, None, 1), (400, [float("nan")] * 16, 1),
             (401, [None] * 16, 1), (402, [float("inf")] + [0.0] * 15, 1)]
    got, books = vector_codes.vector_codes(vector_frame(spark, rows).repartition(3), entries=entries)
    want, want_books = brute_codes(rows, entries, 4)
    assert sorted(repr((r.vec_id, bytes(r.code), r.error)) for r in got.collect()) == want
    assert [b.astype(int).tolist() for b in books] == want_books


def test_codes_of_odd_tables(spark):
    empty, _ = vector_codes.vector_codes(vector_frame(spark, []))
    assert empty.count() == 0
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (3, [2.0, 2.0, 3.0, 4.0, 5.0], None)]
    got, _ = vector_codes.vector_codes(vector_frame(spark, rows))
    assert {r.vec_id: (r.code is None, r.error) for r in got.collect()} == {
        1: (True, None), 2: (False, 0), 3: (False, 0)
    }
    nothing, _ = vector_codes.vector_codes(vector_frame(spark, [(1, [], 1), (2, [], 1)]))
    assert {bytes(r.code) for r in nothing.collect()} == {b"\0\0\0\0"}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(vector_frame(spark, [(1, [1e30] * 4, 1)]))


def test_balls_skip_work_and_agree():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, size=(40, 8)).astype(float)
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 60)
    before = vector_codes.Balls(centres)
    old = before.nearest(x)
    balls = vector_codes.Balls(np.floor(centres + rng.normal(size=centres.shape) * 30))
    assert (balls.moved(x, old) == balls.nearest(x)).all()
    assert (balls.moved(x, rng.integers(0, 40, len(x))) == balls.nearest(x)).all()
    balls.compared = balls.stable = 0
    balls.moved(x, old)
    assert balls.stable > 0.9 * len(x) and balls.compared < 0.1 * len(x) * 40


def brute_fim(ident, text, seed=1, rate=90, spm=20):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return ident, n, "plain", None, None, t
    if h4 % 100 < spm:
        return ident, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return ident, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("frame", [1, 7, 1 << 16])
def test_fill_in_middle_is_brute_force(spark, docs_of, frame):
    rng = random.Random(2)
    letters = "aé日😀 \n<>PSḾ\x00"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "x"), (303, "a<P"), (304, "<<S>"), (305, "é<M>"), (None, "né"),
             (5, rows[5][1]), (306, "<" * 50), (307, "日" * 30_000 + "<M" + "b" * 10)]
    docs = docs_of(rows).selectExpr("*", "'x' AS form", "'y' AS `a.b`")
    archives = fim.fill_in_middle(docs, frame_bytes=frame)
    want = [brute_fim(*r) for r in rows]
    texts = [(r.doc_id, r.form, r.text) for r in fim.output_texts(archives).collect()]
    assert sorted(map(repr, texts)) == sorted(repr((w[0], w[2], w[5])) for w in want)
    sha = [
        (*w[:5], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for w, r in zip(want, rows, strict=True)
    ]
    assert sorted(map(repr, map(tuple, fim.digests(archives).collect()))) == sorted(map(repr, sha))
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_only_cut_frames_are_opened():
    codec = fim.Codec()
    data = np.frombuffer(("é" * 5000).encode(), np.uint8)
    text = fim.Store.of(data, codec, 100)
    opened = []
    codec.open = lambda body, read=codec.open: opened.append(body) or read(body)
    part = fim.Store(text.select(120, 4321), codec)
    assert len(opened) == 2 and part.n == 4201
    assert b"".join(part.read()).decode() == "é" * 4201


P = "A paragraph with quite some words in it, so that it weighs enough for any window of lines."
PAGES = [
    # Named parts around an unnamed article.
    (f'<div id="top"><a href=x>Home</a> | <a>News</a></div><div class="cookie-notice">We use cookies.</div>'
     f'<div class="x1"><h1>Title</h1><p>{P}</p><p>Er.</p><p>{P} <a>link</a> end</p></div>'
     f'<div class="x2"><h3>Comments</h3><p>{P}</p></div><div id="footer">(c) 2020</div>',
     f"Title\n{P}\nEr.\n{P} link end"),
    # Cells without closing tags, the page in one form.
    (f"<form action=x><table><tr><td class=menu><a>a</a><td><h1>T &lt;1&gt;</h1><p>{P}<br>next<p>{P}</table></form>",
     f"T <1>\n{P} next\n{P}"),
    # A main element with short paragraphs, a sidebar in it, comments after it.
    (f"<main><nav><a>x</a></nav><p>Hi.</p><aside><p>{P}</p></aside><p>Bye &eacute; &#233; &#xe9;</p></main>"
     f'<section class="comments"><article class="comment"><p>{P}</p></article></section>', "Hi.\nBye é é é"),
    (f"<header><h1>Site</h1></header><div class=content><p>{P}</p><form><label>Mail</label><input><button>Go"
     f"</button></form><p>{P}2</p></div><footer>F</footer>", f"{P}\n{P}2"),
    (f'<p>{P}</p><p>a < b and c > d</p><script>if (a<b) {{ w("<p>x</p>") }}</script><p>tail &amp</p>',
     f"{P}\na < b and c > d\ntail &"),
    # Nothing named: a link list and a footer of few words.
    (f'<div class="wrap"><div class="hd">Site name</div><ul><li><a>A</a><li><a>B</a><li><a>C</a></ul>'
     f'<div class="bd"><p>{P}</p><ul><li>one</li><li>two</li></ul><p>{P}</p></div><div class="ft">Imprint</div></div>',
     f"{P}\none\ntwo\n{P}"),
    # Truncated, unclosed advert before the article, white space of all kinds.
    ('<div class="ad">Buy<article><h1>a\n\t b</h1><p><b>c d<br><p>e</article><footer>f', "a b\nc d\ne"),
    ('<body class="no-sidebar"><article class="post"><p>x</p><!-- <p>no</p> --><style>p{}</style></article>', "x"),
    (f'<article><p>{P}</p><div class="share"><a>S</a></div>' + "<ul>" + "<li><a>t</a></li>" * 4 + "</ul>"
     f"<div class=comments><p>{P}</p></div><p>Last.</p></article>", f"{P}\nLast."),
    ("<nav><ul><li><a>x</a></ul></nav>", ""), ("", ""), (None, ""), ("<p", ""), ("plain text only", "plain text only"),
    ("<script>never closed <p>x</p>", ""), ('<p title="a>b">y</p>', "y"),
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_main_text_of_known_pages(i):
    page, want = PAGES[i]
    assert main_text.extract(page) == want


def test_pages_keep_their_rows(spark):
    schema = "page_id long, url string, html string, text string, `a.b` string"
    rows = [(None, None, None), (1, "u", PAGES[0][0]), (1, "u", PAGES[0][0]), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = sorted(repr(tuple(r)) for r in main_text.main_texts(pages).collect())
    want = [(i, u, main_text.extract(h), len(main_text.extract(h))) for i, u, h in rows]
    assert got == sorted(map(repr, want))
    assert main_text.main_texts(pages.limit(0)).count() == 0


def test_long_and_broken_pages_end():
    for page in ("<div>" * 20_000 + "x" + "</p>" * 20_000, "<a " * 50_000, '<p a="' * 50_000, "<" * 50_000):
        main_text.extract(page)
    many = "".join(f"<div><p>word {i}" for i in range(20_000))
    assert len(main_text.extract(many).split("\n")) == 20_000
    long = f"<article>{('<p>' + P) * 30_000}</article>"
    assert main_text.extract(long) == "\n".join([P] * 30_000)


def test_windows():
    weights = np.array([0, 90, 0, 0, 0, 5, 100, 0, 3, 0, 0, 0])
    assert main_text.window_sums(weights, 3).tolist() == [90, 90, 0, 5, 105, 105, 103, 3, 3, 0, 0, 0]
    assert main_text.surges(weights, 3, 80) == [(1, 2), (5, 9)]
