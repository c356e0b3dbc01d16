"""Language, quality and page text."""

import numpy as np
import pytest
from llm_brute import empty, frame
from punctua.llm import html, language, quality
from punctua.llm import runs as R
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op3_language(spark, SF)
    assert got.count() == docs.count()
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_defined_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "12 34 !?"), (None, "le la les " * 9),
                         (5, "the of and " * 40000), (5, "the of and " * 40000)])
    model = {"en": b"the of and to in is that it " * 40, "fr": b"le la les des une est que " * 40}
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(docs, model).collect()}
    assert got == {(1, "und", False), (2, "und", False), (3, "und", False), (None, "fr", True),
                   (5, "en", True)}
    assert language.fit(empty(docs)) == {}
    assert [r.lang_pred for r in language.predict(docs, {}).collect()] == ["und"] * 6
    assert language.predict(empty(docs), model).count() == 0


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op8_quality(spark, SF)
    own = got.join(labels, "doc_id").where("held_out")
    good, bad = (own.where(f"quality = {q}").agg(F.avg("predicted")).first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.1
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_defined_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a"), (None, "ab cd"), (5, "x " * 300000)])
    some = spark.createDataFrame([(3, 1, 0), (5, None, 0), (None, 0, 1), (2, 7, 0)],
                                 "doc_id bigint, quality int, toxic int")
    scores = [r.score for r in quality.scored(docs, some).collect()]
    assert scores == [1.0] * 5  # one class only: its share
    assert [r.score for r in quality.scored(docs, empty(some)).collect()] == [0.5] * 5
    assert quality.scored(empty(docs), some).count() == 0
    both = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (1, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")
    assert quality.scored(docs, both).count() == 5
    assert quality.accepted(docs, both).columns == docs.columns


def test_quality_learns_from_a_class_of_copies(spark):
    """Thousands of copies and 200 other texts: the copies take no place in the sample."""
    good, bad = "the quiet river runs", "BUY $$$ NOW !!!"
    rows = [(k, f"{bad} copied") for k in range(8000)]
    rows += [(10_000 + k, f"{bad} {k * 7919 % 1000}") for k in range(200)]
    rows += [(20_000 + k, f"{good} {k * 104729 % 10007}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 20_000).cast("int").alias("quality"))
    model = quality.fit(docs, labels, sample_rows=250)
    assert model.weights is not None
    # The same texts, once each, are the same sample.
    once = quality.fit(docs.where("doc_id = 0 OR doc_id >= 10000"), labels, sample_rows=250)
    assert np.count_nonzero(model.weights) >= 0.9 * np.count_nonzero(once.weights)
    got = {r.doc_id: r.score for r in quality.predict(docs.where("doc_id % 10 = 0"), model).collect()}
    assert all((score >= 0.7) == (i >= 20_000) for i, score in got.items())


def test_counts_of_the_classifier_are_whole(spark, monkeypatch):
    docs = frame(spark, [(k, f"text {k} abc") for k in range(30)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, quality int")
    rows = quality.labelled(docs, labels, "doc_id", "text", "quality")
    n, counts = quality.class_counts(quality.described(rows))
    assert n.tolist() == [15, 15]
    monkeypatch.setattr(quality, "SENT", 0)  # by shuffle
    shuffled = quality.labelled(docs, labels, "doc_id", "text", "quality")
    assert (quality.class_counts(quality.described(shuffled))[1] == counts).all()
    want = np.zeros(quality.SIZE, dtype=int)
    for k in range(1, 30, 2):
        want[quality.indicators(f"text {k} abc".encode())] += 1
    assert (counts[1] == want).all()


def test_texts_are_described_and_counted_by_one_worker(spark, monkeypatch):
    docs = frame(spark, [*((k, f"text {k} abc") for k in range(30)), (30, None), (31, "")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(32)], "doc_id bigint, quality int")
    rows = quality.labelled(docs, labels, "doc_id", "text", "quality")
    plain = quality.class_counts(quality.described(rows))
    one = quality.class_counts(rows, "text", quality.indicators)
    assert all((a == b).all() for a, b in zip(one, plain)) and one[0].tolist() == [16, 16]
    chained, summed = [], R.summed

    def seen(table, *rest):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        chained.append(plan.count("InArrow") + plan.count("InPandas"))
        return summed(table, *rest)

    monkeypatch.setattr(R, "summed", seen)
    quality.fit(docs, labels)
    assert chained == [0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script>
</head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
%s
<aside>Aside</aside><div id="comments"><p>A reader says something quite long about this.</p></div>
<form><label>Name</label><input></form><footer>&copy; 2024"""
BODY = """<h1>Head &amp; line</h1><p>First   long paragraph with\n <b>bold</b> words &lt;here&gt; and more.
<p>Short.</p><div class="share">Share</div><ul><li>One item</li><li>Two<br>lines</li></ul>
<p>Another paragraph of the text, long enough to count as content of the page.</p>"""
TEXT = ("Head & line\nFirst long paragraph with bold words <here> and more.\nShort.\nOne item\n"
        "Two lines\nAnother paragraph of the text, long enough to count as content of the page.")


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_page_text(tag):
    assert html.main_text(PAGE % f"<{tag}>{BODY}</{tag}>") == TEXT


def test_page_text_keeps_all_sections_without_an_article():
    first, second = "long words of the text " * 40, "more words of it " * 12
    page = (f"<body><nav>Menu</nav><div><h1>Title</h1><section><p>{first}</p></section>"
            f"<section><p>{second}</p><p><a href='/x'>A line that is a link</a></p></section></div>"
            "<footer>End</footer></body>")
    want = ["Title", first.strip(), second.strip(), "A line that is a link"]
    assert html.main_text(page).split("\n") == want
    split = f"<body><div><p>{first}</p></div><div class='ad'>Buy</div><div><p>{second}</p></div>"
    assert html.main_text(split).split("\n") == [first.strip(), second.strip()]


@pytest.mark.parametrize("cards", [1, 6])
def test_page_text_beside_teaser_articles(cards):
    text, card = "long words of the text " * 40, "a card that leads to another page " * 5
    teasers = f"<article><h2>Card</h2><p>{card}</p></article>" * cards
    for page in (f"<body><div><h1>Title</h1><p>{text}</p></div>{teasers}</body>",
                 f"<body>{teasers}<main><h1>Title</h1><p>{text}</p></main></body>"):
        got = html.main_text(page).split("\n")
        assert "Title" in got and text.strip() in got
    whole = f"<body><article><h1>Title</h1><p>{text}</p></article><div><p>{card}</p></div></body>"
    assert html.main_text(whole).split("\n") == ["Title", text.strip()]  # it holds most


@pytest.mark.parametrize("mark", [
    'class="layout has-sidebar"', 'id="content-with-sidebar"', 'class="search-results"',
    'class="notice-of-change"', 'class="right-sidebar"', 'class="notice"', 'id="search"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_page_text_in_a_wrapper_with_a_noise_word(mark, tag):
    wrapped = f"<div {mark}><div class='widget sidebar'>Side</div><{tag}>{BODY}</{tag}></div>"
    assert html.main_text(PAGE % wrapped) == TEXT
    long = "<div id='comments'>" + "<p>A reader says this at length.</p>" * 50 + "</div>"
    if tag != "div":  # long comments beside an article go
        assert html.main_text(PAGE % (wrapped + long)) == TEXT


def test_page_text_beside_a_long_advert():
    advert = f"<div class='ad'>{'Buy this now. ' * 50}</div>"
    assert html.main_text(PAGE % f"{advert}<article>{BODY}</article>") == TEXT
    results = "Found at length here. " * 60
    page = f"<section class='search'><p>{results}</p></section><article><p>Card</p></article>"
    assert results.strip() in html.main_text(f"<body>{page}</body>").split("\n")


@pytest.mark.parametrize("mark", ["cookie-notice", "site-footer", "relatedPosts", "comment-list",
                                  "ad-slot-2", "post sidebar", "share"])
def test_page_text_without_marked_noise(mark):
    noise = f"<div class='{mark}'><article class='post'><p>Some other words.</p></article></div>"
    assert html.main_text(PAGE % f"<div>{BODY}</div>{noise}") == TEXT


def test_page_defined_cases(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "just text", None),
            (4, "w", "<p>a", "y"), (4, "w", "<p>a", "y"), (5, "z", "<nav>only a menu</nav>", "y"),
            (6, "z", "<article>" + "<p>word</p>" * 20000, "y"), (7, "q", "<div>" * 3000 + "deep", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[None] == ("just text", 9)
    assert got[4] == ("a", 1) and got[5] == ("", 0) and got[6][1] == 5 * 20000 - 1
    assert got[7] == ("deep", 4)
    assert html.extract(pages).count() == len(rows) and html.extract(empty(pages)).count() == 0


def test_smoothing_keeps_level_and_spreads_peaks():
    assert np.allclose(html.smoothed(np.full(9, 5.0)), 5.0)
    peak = html.smoothed(np.array([0, 0, 0, 0, 9.0, 0, 0, 0, 0]))
    assert peak.argmax() == 4 and peak[3] == peak[5] > peak[2] > 0


def test_shared_weights_travel_compressed(spark):
    """Every executor keeps a file of what is shared; weights are mostly zeros."""
    weights = np.zeros(1 << 20)
    weights[::1000] = 0.5
    sent = R.shared(spark, quality.Model(weights, 1.0, 0.0, 0.5))
    assert len(sent.value) < weights.nbytes // 20
    assert (R.given(sent).weights == weights).all()
