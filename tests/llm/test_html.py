"""Main text of pages."""

import html as entities
import re

import pytest

from clientele.llm import html
from tests.conftest import SF_DIR


def text(source, templates=()):
    return html.Page(source).text(set(templates))


@pytest.mark.parametrize(
    "source, expected",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two</p>three", "one\ntwo\nthree"),
        ("<p> a\n\t b &lt;c&gt; &#233;&#xe9;&copy </p>", "a b <c> éé©"),
        ("<p><b>bold<br><p>next <i>x</b>y</i></p>", "bold\nnext xy"),
        ("<ul><li>1<li>2<ul><li>2a</ul><li>3</ul>", "1\n2\n2a\n3"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a b\nc"),
        ("<nav>n</nav><header>h</header><article><header><h1>T</h1></header><p>x</p><aside>s</aside></article><footer>f</footer>", "T\nx"),
        ('<div class="cookie-notice">n</div><div id="sidebar">s</div><div role="search">r</div><p class="lead">x', "x"),
        ('<article class="post comment-open"><p>x</p><section class="comments"><article>no</article></section></article>', "x"),
        ('<div class="has-sidebar"><main><p>x</p></main><div class="ad">a</div></div>', "x"),
        ('<body><article class="comment">no</article><p>x</p></body>', "x"),
        ('<script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><noscript>no</noscript><p>x</p><p', "x"),
        ("<p title='a>b' data-x=\"<p>\">x</p></div></section>1 < 2 & 3", "x\n1 < 2 & 3"),
        ("<title>t</title><form><p>f</p></form><button>b</button><select><option>o</select><h2>x</h2>", "x"),
        ("<div>" * 30_000 + "deep", "deep"),
        ("<a" * 5_000, ""),
    ],
)
def test_pages(source, expected):
    assert text(source) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<article><p>a</p><svg class='icon'/><p>b</p></article><p>c</p>", "a\nb"),
        ("<article><p>a <math display=\"block\" /> b</p><p>c</p></article>", "a b\nc"),
        ("<article><p>a</p><object data='x'><p>b</p></article><footer>f</footer>", "a\nb"),
        ("<object data='x'><article><p>a</p></article>", "a"),
        ("<article><div><canvas></div><p>a</p><noscript><p>b</article>", "a\nb"),
        ("<article><p>a<svg><title>t<p>b</p><svg><g><text>t</text><p>c</article>", "a\nb\nc"),
        ("<article><svg><style/><title/><path d=''/></svg><p>a</p></article>", "a"),
        ("<article><svg><title>t</svg><p>a</p><svg><foreignObject><p>no</p></foreignObject></svg>b</article>", "a\nb"),
        ("<p>a <object><div>no</div><p>no</object> b</p>", "a b"),
        ("<template><article>no</article></template><noscript><main>no</main></noscript><article>a</article>", "a"),
        ("<object data=a/>no</object><p>a<canvas/>b", "ab"),
        ("<math><mi>no</mi></math>a<script>'<svg>'</script>b<iframe><p>no</iframe>c", "abc"),
        ("<svg><foreignObject>" + "<div>" * 30_000 + "</svg>a", "a"),
    ],
)
def test_embedded_elements_hide_no_text_behind_them(source, expected):
    assert text(source) == expected


def test_templates_go_but_not_from_articles(spark):
    box = "<div><div>Read our other pages</div><p>Join us today</p></div>"
    rows = [(k, f"http://User@Site.example:80/{k}", f"<body>{box}<p>own {k}</p></body>") for k in range(20)]
    rows += [(100 + k, f"http://articles.example/{k}", "<article><p>the same text</p></article>") for k in range(20)]
    rows += [(200, "http://small.example/", f"<body>{box}</body>"), (201, None, f"<body>{box}</body>"), (202, "http://site.example/y", None), (203, "no url", "")]
    rows += [(204, "http://site.example/z", f"<p>q{box}")] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(map(tuple, html.main_texts(pages).collect()), key=str)
    both = "Read our other pages\nJoin us today"
    expected = {k: f"own {k}" for k in range(20)} | {100 + k: "the same text" for k in range(20)} | {200: both, 201: both, 202: "", 203: "", 204: "q"}
    assert got == sorted(((i, u, expected[i], len(expected[i])) for i, u, _ in rows), key=str)
    assert html.main_texts(pages.limit(0)).collect() == []


@pytest.mark.parametrize("few", [500_000, 0])
def test_a_template_of_one_section_goes_on_a_large_host(spark, monkeypatch, few):
    monkeypatch.setattr(html, "BROADCAST_KEYS", few)
    box = "<div><p>News of our section</p></div>"
    # Ten pages of 400 are below a twentieth; six pages, one of them in two rows, make no template; another host has its own.
    rows = [(k, f"http://large.example/{k}", f"<body>{box if k < 10 else ''}{'<ul><li>rare</ul>' if k < 6 else ''}<p>own {k}</p></body>") for k in range(400)]
    rows += [(500, "http://other.example/", f"<body>{box}</body>"), (3, "http://large.example/3", rows[3][2]), (None, "http://large.example/x", "<p>x")]
    got = sorted(map(tuple, html.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "text").collect()), key=str)
    expected = [(k, f"own {k}") for k in range(6, 400)] + [(k, f"rare\nown {k}") for k in [*range(6), 3]] + [(500, "News of our section"), (None, "x")]
    assert got == sorted(expected, key=str)


def test_given_pages(spark):
    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html.main_texts(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("name", ["ad-hoc", "social-science", "share-price", "related-work", "menu-driven", "comment-free"])
def test_class_names_that_only_begin_like_a_part_of_the_page(name):
    assert text(f'<article><p class="{name}">a</p><div class="{name}"><p>b</p></div></article>') == "a\nb"
    assert text(f'<body><p class="{name}">a</p></body>') == "a"


@pytest.mark.parametrize("name", ["share", "share-buttons", "related_posts", "ad-slot", "comments", "comment-list", "newsletter-box"])
def test_class_names_of_parts_of_the_page(name):
    assert text(f'<article><p>a</p><div class="{name}">no</div></article>') == "a"


def test_a_form_around_the_page_is_the_page():
    assert text("<form action=x><div><p>the text of the page</p><label>no</label><input></div></form>") == "the text of the page"
    assert text("<form><article><p>a</p></article><p>no</p></form>") == "a"
    assert text("<p>the text of the page</p><form><label>Name</label><input></form>") == "the text of the page"
    assert text("<article><p>a</p><fieldset><legend>Box</legend><p>b</p></fieldset><label>c</label></article>") == "a\nBox\nb\nc"


def site(spark, pages):
    rows = [(k, url, source) for k, (url, source) in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in html.main_texts(docs).collect()}


def test_articles_under_several_urls_keep_their_text(spark):
    body = "<div class=content><p>One.</p><ul><li>a<li>b</ul><p>Two is long enough.</p></div>"
    box = "<div><a href=x>Follow us</a></div>"
    pages = [(f"http://copies.example/?{k}", f"<article><h1>T{k}</h1>{body}{box}</article>") for k in range(8)]
    pages += [(f"http://whole.example/?{k}", f"<article><h1>T</h1><ul><li>a</ul><p>One.</p></article><div>menu</div>") for k in range(8)]
    got = site(spark, pages)
    assert [got[k] for k in range(8)] == [f"T{k}\nOne.\na\nb\nTwo is long enough." for k in range(8)]
    assert [got[k] for k in range(8, 16)] == ["T\na\nOne."] * 8


def test_rows_of_one_url_are_one_page(spark):
    assert set(site(spark, [("http://once.example/", "<div><p>Text without an article</p></div>")] * 9).values()) == {"Text without an article"}


def test_long_pages_and_extra_columns(spark):
    source = "<article>" + "<p>word &amp; word</p>" * 200_000 + "</article>"
    docs = spark.createDataFrame([(1, "http://a.example/", source, 5, "x")], "page_id bigint, url string, html string, subtree int, key string")
    r = html.main_texts(docs).first()
    assert r.n_chars == 200_000 * len("word & word") + 199_999


def plain_templates(pages):
    """(host, subtree hash) of all that stand on eight urls, counted by hand on whole pages."""
    found = {}
    for url, source in pages:
        host = html.host_of(url)
        for subtree in html.Page(source or "").candidates() if host else ():
            found.setdefault((host, subtree), set()).add(url)
    return {key for key, urls in found.items() if len(urls) >= html.TEMPLATE_PAGES}


def test_templates_of_given_pages_are_those_counted_by_hand(spark, monkeypatch):
    monkeypatch.setattr(html, "TEMPLATE_PAGES", 2)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = [(r.url, r.html) for r in pages.collect()]
    own = plain_templates(rows)
    assert {r.subtree for r in html.site_templates(pages).collect()} == {html.site_key(*key) for key in own}
    got = sorted((r.url, r.text) for r in html.main_texts(pages).collect())
    assert got == sorted((url, html.Page(source or "").text({s for h, s in own if h == html.host_of(url)})) for url, source in rows)
