import hashlib
import html
import time
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsflow.functions import dates as D
from newsflow.functions import text as T
from newsflow.functions import urls as U
from newsflow.operators.pages import image_url, main_text, page_title

from helpers import column

REFERENCES = [
    "a &amp; b &lt;b&gt;x&lt;/b&gt; &#x27; &#39; &copy2024 &notit; &notin; &#128; &#x80; &#0;",
    "&#xD800; &#1114112; &#99999999999999; &bogus; &nbsp;| & && &; &#; &#x; &amp;amp; &#13; &#11;",
    "&#x1F600; &CounterClockwiseContourIntegral; &ampx &#0065 &#x10FFFF; &#xFDD0; &#000000000000065;",
    "plain", "a < b", "", "&amp&lt &frac12 &frac12; &euro; &eur", None,
]


def test_references_equal_the_html_rules(spark):
    expected = [None if r is None else html.unescape(r) for r in REFERENCES]
    assert column(spark, REFERENCES, T.decode_references) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="&#x;0123456789abcdefgltmpnosuoy <", max_size=40), min_size=20, max_size=60))
def test_references_on_random_texts(spark, texts):
    assert column(spark, texts, T.decode_references) == [html.unescape(t) for t in texts]


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("&lt;b&gt;x&lt;/b&gt;", "x"),
        ("a < b", "a < b"),
        ("&#x27;", "'"),
        ("\u0000z\u0007", "z"),
        ("  edge 　", "edge"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("<p>a<b>c</b>d</p>", "a\nc\nd"),
        ("x<!-- c > d -->y", "x\ny"),
        ("<script>var a='</p>';</script>k<a title='x>y'>link</a>", "k\nlink"),
        ("<style>p{}</style><template>no</template>yes", "yes"),
        ("a  \t b", "a b"),
        ("a\tb", "a b"),
        ("&amp;amp; x", "& x"),
        (None, ""),
    ],
)
def test_normalize_text(spark, given_text, expected):
    assert column(spark, [given_text], T.normalize_text) == [expected]


URLS = [
    "http://A.com/x/", "https://a.com/x?q=1#f", "http://h:80/a;b/c;p", "http://u:p@h/", "ftp://x//",
    "http:///", "example.com/a/", "", "http://h;x", "HTTP://H/Path//", " http://a.com",
    "http://h/a b/", "//net/p/", None, "http://[::1]/x/", "https://x", "http:/one", "https://a/?#;",
]


def test_url_key_equals_the_url_parser(spark):
    def key(url):
        p = urlparse(url or "")
        return (f"{p.scheme}://{p.netloc}" + p.path.rstrip("/")).lower() if url else ""

    assert column(spark, URLS, U.url_key) == [key(u) for u in URLS]


def test_is_http_url(spark):
    def valid(url):
        p = urlparse(url or "")
        return p.scheme in ("http", "https") and p.netloc != ""

    assert column(spark, URLS, U.is_http_url) == [valid(u) for u in URLS]


def test_hash_id_is_a_sha256_prefix(spark):
    url = "https://example.com/x"
    assert column(spark, [url], U.hash_id) == [hashlib.sha256(url.encode()).hexdigest()[:24]]


DATES = {
    "2025-01-15T10:30:00Z": "2025-01-15T10:30:00Z",
    "2025-01-15T10:30:00+05:30": "2025-01-15T10:30:00Z",
    "2025-01-15T10:30:00-05:00": "2025-01-15T10:30:00-05:00Z",
    "2025-1-5": "2025-01-05T00:00:00Z",
    "Wed, 15 Jan 2025 10:30:00": "2025-01-15T10:30:00Z",
    "15 Jan 2025": "2025-01-15T00:00:00Z",
    "January 15, 2025": "2025-01-15T00:00:00Z",
    "JAN 5, 2025": "2025-01-05T00:00:00Z",
    "2025-01-15 10:30:00": "2025-01-15T10:30:00Z",
    "2025-01-15 10:30:00 and more": None,
    "2025-02-30": None,
    "junk": None,
}


def test_article_date_text(spark):
    assert column(spark, DATES, D.article_date_text) == list(DATES.values())
    assert column(spark, [None], D.article_date_text) == [None]


def test_offset_is_dropped_by_default_and_applied_on_request(spark):
    texts = ["2025-01-15T10:30:00+05:30", "2025-01-15T10:30:00.5+00:00Z"]

    def shown(**options):
        return column(spark, texts, lambda c: D.article_date(c, **options).cast("string"))

    assert shown() == ["2025-01-15 10:30:00", "2025-01-15 10:30:00.5"]
    assert shown(apply_offset=True) == ["2025-01-15 05:00:00", "2025-01-15 10:30:00.5"]


def test_feed_date_cuts_the_zone(spark):
    texts = ["Wed, 01 Jan 2025 12:00:00 +0530", "Wed, 01 Jan 2025 12:00:00 GMT", "January 15, 2025", "x"]
    assert column(spark, texts, D.feed_date_text) == [
        "2025-01-01T12:00:00Z", "2025-01-01T12:00:00Z", "2025-01-15T00:00:00Z", None,
    ]


def test_compact_count(spark):
    texts = ["1,234", "1.2k", "56", "x", " 7 ", "", "1.5", "1.29K", None]
    assert column(spark, texts, T.compact_count) == [1234, 1200, 56, 0, 7, 0, 0, 1290, 0]


def test_title_case_equals_python(spark):
    texts = ["e-commerce", "it's AI 3d", "ÉCOLE été", "web  development"]
    assert column(spark, texts, T.title_case) == [t.title() for t in texts]


def test_title_key(spark):
    texts = ["One two three. Four? Five! Sixes Seven eights", "to be or", None, "Éclair über naïve"]
    assert column(spark, texts, T.title_key) == [
        "five four seven sixes three", "", "", "naïve éclair über",
    ]


def test_clean_tag_list(spark):
    tags = [[" C++", "Py-thon", "AI", "ai", "x", ""] + [f"tag{i}" for i in range(12)], None]
    got = column(spark, tags, lambda c: T.clean_tag_list(c, 10), "array<string>")
    assert got == [["py-thon", "ai"] + [f"tag{i}" for i in range(8)], []]


def test_strip_equals_python(spark):
    texts = ["  x y 　\n", "\x1c\x1fz\x85", "  ", "none"]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]


def test_excerpt_and_paragraphs(spark):
    assert column(spark, ["a b c d", "a b", None], lambda c: T.excerpt_words(c, 3)) == [
        "a b c...", "a b", "",
    ]
    texts = [
        "A. B? C! D. E. tail", "A. B. tail", "x\n\n \n\ny", "lit\\n\\nbreak", "<p>kept</p>\n\nas is", "",
    ]
    assert column(spark, texts, T.paragraphs) == [
        ["A. B? C! D.", "E."], ["A. B. tail"], ["x", "y"], ["lit", "break"], ["<p>kept</p>\n\nas is"], [],
    ]


def test_long_texts_stay_linear(spark):
    """Texts that make careless patterns quadratic."""
    n = 200_000
    texts = ["w " * n, " " * n + "x", "word" * n, " <" * n]
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    got = column(spark, texts, lambda c: F.length(T.normalize_text(c)) + F.size(T.paragraphs(c)))
    assert len(got) == len(texts)


N = 100_000
HOSTILE = [
    "<td></td>" * N, "<!--" * N, "<!--" * N + "-->x", "<nav>a" * N, "<script>" * N, "<rt>a" * N, "<rt>a" * N + "</rt>b",
    "</script>" * N, "<a " + "b='c' " * 50_000 + ">x", "<a" * N, "<a href=\"" * N, "<" * N, "&" * N, "<title>" * N,
    "<article>" * N, "<meta property='og:image' " * N, "<div class=\"ad\">" * N, "<html " * N,
    # one tag with very many attributes, whole or unfinished
    "<meta " + "property='og:image' " * N, "<meta " + "content='x' " * N + ">", "<meta " + "content='x' property='og:imag' " * N,
    "<meta " + "name='twitter:image' " * N + "content=", "<meta " + "content=' " * N, "<meta property='og:image' content='' " * N, "<meta content='' property='og:image'>" * N, "<html " + "lang= " * N,
]


def test_meta_images(spark):
    """Attribute before or behind its content, several of both, signs in values, unfinished tags."""
    cases = {
        "<meta property='og:image' content='a'>": "a", "<meta content=\"b\" property=\"og:image\">": "b",
        "<META x Property='og:image' content='c' content='d'>": "d", "<meta content='a' content='e' property='og:image'>": "e",
        "<meta content='a' property='og:image' content='f'>": "f", "<meta content='a>b' property='og:image'>": "a>b",
        "<meta property='og:image' content=''><meta property='og:image' content='x'>": None,
        "<meta property='og:image'><meta content='n'>": None, "<meta property='og:image:alt' content='n'>": None,
        "<meta name='twitter:image' content='t'><meta content='o' property='og:image'>": "o",
        "<meta name='twitter:image' content='t'>": "t", "<meta name='twitter_image' content='t'>": None,
        "<meta content='a' property='og:image' y content='unfinished": "a", "<meta content='p' property='og:image' q><meta property='og:image' content='z'>": "z",
        "<metadata property='og:image' content='n'>": None, "no tag": None, "": None, None: None,
        "<meta content='1' property='og:image' property='og:image'><i>": "1", "<meta <meta property='og:image' content='w'": "w",
    }
    assert dict(zip(cases, column(spark, list(cases), image_url), strict=True)) == cases


@pytest.mark.parametrize("cleaner", [T.normalize_text, T.joined_text, main_text, image_url, page_title])
def test_hostile_markup_takes_linear_time(spark, cleaner):
    column(spark, ["<p>warm</p>"], cleaner)
    for text in HOSTILE:
        began = time.perf_counter()
        column(spark, [text], lambda c: F.length(cleaner(c)), "string")
        assert time.perf_counter() - began < 3, text[:20]  # planning and transfer included


def test_hidden_markup(spark):
    texts = ["a<!-- <b> --><i>b</i>c", "a<!-- open", "x</script>y", "<SCRIPT src='a'>1 < 2</Script >b", "p<style>q</style>r<style>s</style>t",
             "<td></td><td>a</td> <td>b</td>", None, "", "a<rt>x</rt>b<rp>(</rp>c", "1 < 2 > 1"]
    assert column(spark, texts, T.strip_tags) == [
        "a\nb\nc", "a<!-- open", "x\ny", "\nb", "p\nr\nt", "\na\n \nb\n", None, "", "a\nb\nc", "1 < 2 > 1"]
    pages = ["<title>A &amp; B</title><title>C</title>", "<title>open", "<TITLE\n>x</TITLE>", None]
    assert column(spark, pages, page_title) == ["A & B", "", "x", ""]
    bodies = ["<body>a<article>b<article>c</article>d</article>e</body>", "<main>x", "<body><nav>n</nav><p>p</p></body>"]
    assert column(spark, bodies, main_text) == ["bcd", "x", "p"]


# --------------------------------------------------------------- SQL functions
def test_sql_functions_equal_the_column_functions(spark):
    from newsflow.functions.sql import register_functions

    urls = ["HTTPS://Example.com/A/b//?q=1#f", " \x01http://x.org/a;p\n/c/", "ftp://h/", "no url", "https:///", "", None, "http://é.example/Ü/"]
    titles = ["it's a LONG way, o'neill and éclair2go", "", None, "an of", "Über-große Straße zwei drei vier fünf sechs", "q\u00a0r 日本語テキスト"]
    register_functions(spark)
    found = spark.createDataFrame([(u,) for u in urls], "url string")
    pairs = {"url_key": U.url_key, "is_http_url": U.is_http_url, "hash_id": lambda c: U.hash_id(c, 24)}
    for name, own in pairs.items():
        rows = found.select(F.expr(f"{name}(url)").alias("sql"), own(F.col("url")).alias("own")).collect()
        assert [r.sql for r in rows] == [r.own for r in rows], name
    found = spark.createDataFrame([(t,) for t in titles], "title string")
    for name, own in {"title_key": T.title_key, "title_case": T.title_case}.items():
        rows = found.select(F.expr(f"{name}(title)").alias("sql"), own(F.col("title")).alias("own")).collect()
        assert [r.sql for r in rows] == [r.own for r in rows], name
    listed = spark.sql("SELECT title, word FROM {t} t, LATERAL title_words(t.title) ORDER BY title, pos", t=found).collect()
    assert [r.word for r in listed if r.title == titles[4]] == ["über", "große", "straße", "zwei", "drei"]
    assert not [r for r in listed if r.title in ("", "an of", None)]
