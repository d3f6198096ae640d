import pytest
from paceline.llm import html_crf
from paceline.llm.dom import leaves


def test_leaves():
    page = "<div>a <b>b</b>c<br>d<p>e&amp;f&nbsp; g<p>h<!-- x <p> --><script>'</p>'</script>i<ul><li>j<li><a href='>'>k</a></ul>"
    found = leaves(page)
    assert [x.text for x in found] == ["a bc d", "e&f g", "hi", "j", "k"]
    assert found[-1].link_chars == 1 and found[-1].path[-1] == "li" and found[3].path.count("li") == 1
    assert leaves(None) == leaves("") == leaves("<p></p><style>p{}</style>") == []
    assert [x.text for x in leaves("<p>cut <b")] == ["cut <b"]


def test_leaves_keep_embedded_text():
    text = lambda page: [x.text for x in leaves(page)]
    assert text("<p>Let <math><mi>x</mi><mo>=</mo>1</math> be</p>") == ["Let x=1 be"]
    assert text("<p>a <svg><title>icon</title><path/></svg> b</p>") == ["a b"]
    assert text("<select><option>A<option>B</select><object><p>old</object><canvas>c</canvas>") == ["A", "B", "old c"]
    for tag in ("select", "svg", "math", "canvas", "object", "svg><title"):
        found = leaves(f"<div>menu<{tag}></div><article><p>The article.</p></article>")
        assert [x.text for x in found] == ["menu", "The article."] and found[1].path == ("article", "p")
    assert leaves("<select><option>A<article><p>b")[1].path == ("article", "p")
    found = leaves("<p>x<math>y</math></p><p>z</p>")
    assert [x.embedded for x in found] == [{"math"}, frozenset()] and "in=math" in html_crf.page_features(found)[0]
    assert text("<p>a</p><script>b<p>c") == ["a"]


def test_held_out_pages():
    model = html_crf.trained()
    wrong = total = 0
    for page, labels in html_crf.labelled_pages(200, 99):
        got = model.decode(html_crf.page_features(leaves(page)))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert total > 2000 and wrong <= 0.005 * total


#: Pages written by hand, of other make than the labelled ones, with the text that a reader would call the article.
PAGES = [
    ("<body><article><p>First para of text here.</p></article>", ["First para of text here."]),
    ("<p>Only one line", ["Only one line"]),
    (
        "<div id=main-content><div class=comment-free><p>The inner paragraph is long enough to be text.</p></div><p>Next.</p></div>",
        ["The inner paragraph is long enough to be text.", "Next."],
    ),
    (
        "<article><h1>T</h1><p>One para.</p><p>And a second one.</p><svg><path><p>After unclosed svg.</p></article>",
        ["T", "One para.", "And a second one.", "After unclosed svg."],
    ),
    (
        """<html><head><title>Harbour news</title></head><body class="single postid-12 has-sidebar">
        <div id="masthead"><div class="logo"><a href="/">Harbour news</a></div><p>All that floats</p></div>
        <div class="menu-main-container"><ul><li><a href="/">Home</a></li><li><a href="/b">Boats</a></li></ul></div>
        <div class="site-inner no-comments"><div class="entry-content">
        <h1>The ferry is late again</h1>
        <p>On Monday the ferry left at noon, two hours late; nobody <a href="/w">was told</a> why.</p>
        <p>"We wait," said the harbour master</p>
        <ul><li>Monday: two hours</li><li>Tuesday: none</li></ul>
        <div class="share-buttons"><a href="#">Tweet</a> <a href="#">Mail</a></div>
        <p>The council meets on Friday.</p></div></div>
        <div class="sidebar"><h3>Most read</h3><ol><li><a href="/1">Tides of May</a></li></ol><p>Write to us, we like mail.</p></div>
        <div class="comments-area"><h3>2 thoughts</h3><div class="comment"><p>I was on it and it was worse than you write.
        We had no water.</p></div><div class="comment"><p>Same here.</p></div></div>
        <div class="footer-widgets"><p>Harbour news is made by volunteers.</p></div></body></html>""",
        ["The ferry is late again", "On Monday the ferry left at noon, two hours late; nobody was told why.", '"We wait," said the harbour master',
         "Monday: two hours", "Tuesday: none", "The council meets on Friday."],
    ),
    (
        """<table><tr><td><ul><li><a href=a.htm>Start</a><li><a href=b.htm>Fish</a><li><a href=c.htm>Links</a></ul></td>
        <td><h2>Smoking eels</h2><p>Take fresh eels, gut them, and salt them for a night.<p>Dry them in wind.
        Smoke over alder for three hours.</td></tr></table><center>Copyright 1999 Old Smoker</center>""",
        ["Smoking eels", "Take fresh eels, gut them, and salt them for a night.", "Dry them in wind. Smoke over alder for three hours."],
    ),
    (
        """<!doctype html><header><a href="/"><h1>Shop blog</h1></a><nav aria-label="Main"><ul><li><a href="/p">Products</a></li></ul></nav></header>
        <main><nav class="breadcrumb"><ol><li><a href="/">Blog</a></li><li><a href="/x">Care</a></li></ol></nav>
        <article><header><h1>How to oil an axe</h1></header><p>Clean the head first.</p><pre>oil, rag, time</pre>
        <figure><img src=a.jpg><figcaption>An oiled head.</figcaption></figure><blockquote>Less is more, as they say.</blockquote>
        <h2>Handles</h2><p>Linseed oil, warm.</p></article>
        <section id="comments"><h2>Comments</h2><article class="comment"><p>Works for me, thanks a lot for the long text.</p></article></section></main>
        <aside><h2>Related</h2><ul><li><a href="/k">Knives</a></li></ul></aside>
        <form><label>Mail</label><input name=m><button>Join</button></form><div role="alert">We use cookies to sell you axes.</div>
        <footer><p>© Shop</p><p>Contact us any time.</p></footer>""",
        ["How to oil an axe", "Clean the head first.", "oil, rag, time", "An oiled head.", "Less is more, as they say.", "Handles", "Linseed oil, warm."],
    ),
    (
        "<ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><h1>Notes</h1><p>Text one is here and so on.</p><div>A block.</div><p>&copy; 2020 Me</p>",
        ["Notes", "Text one is here and so on.", "A block."],
    ),
    (
        """<div class="cookie-banner"><p>This site needs cookies to work as you expect it to.</p><button>OK</button></div>
        <main class="page-content"><section><h2>Opening hours</h2><table><tr><th>Day</th><th>Hours</th></tr><tr><td>Friday</td><td>9 to 5</td></tr></table>
        </section><section class="newsletter-signup"><p>Get our letter once a month.</p></section></main>""",
        ["Opening hours", "Day", "Hours", "Friday", "9 to 5"],
    ),
    (
        """<nav><a href=/>A</a></nav><div class="advertisement"><p>Buy two and pay for one, only this week in all our shops.</p></div>
        <p class="skip-link"><a href="#x">Skip</a></p><form role="search"><input><button>Go</button></form><footer>© nobody</footer>""",
        [],
    ),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages_of_other_make(page, want):
    assert html_crf.extract(page, html_crf.trained()).split("\n\n") == (want or [""])


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    model = html_crf.Field({f"f{i}": i for i in range(6)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=(2, 2)))
    for _ in range(20):
        page = [[f"f{j}" for j in r.choice(6, 2, replace=False)] for _ in range(6)]
        e = model.emissions(page)

        def weight(path):
            s = model.ends[0, path[0]] + model.ends[1, path[-1]] + sum(e[i, x] for i, x in enumerate(path))
            return s + sum(model.moves[a, b] for a, b in zip(path, path[1:]))

        assert tuple(model.decode(page)) == max(itertools.product((0, 1), repeat=6), key=weight)


def test_query(spark):
    nav = '<nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
    rows = [
        (1, "u", f"<html><body>{nav}<article><h1>Title</h1><p>Some  text &lt;here&gt;.</p><p>More\ntext.</p></article><footer>© x</footer>", 5),
        (1, "u", None, 5), (None, None, "", None), (2, "v", nav, 1), (3, "w", "<article><p>" + "word " * 60000 + "</p></article>", 0),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {(r["page_id"], r["url"], r["text"][:60], r["n_chars"]) for r in html_crf.extract_pages(df).collect()}
    first = "Title\n\nSome text <here>.\n\nMore text."
    assert got == {(1, "u", first, len(first)), (1, "u", "", 0), (None, None, "", 0), (2, "v", "", 0), (3, "w", ("word " * 20)[:60], 299999)}
    assert html_crf.extract_pages(df.limit(0)).count() == 0
