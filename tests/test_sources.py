import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsflow.operators.pages import main_text, page_metadata
from newsflow.sources import cards, feeds, posts, registry, stories
from newsflow.sources.conform import conform_article, union_feeds
from newsflow.sources.html import tree

from helpers import column, raw, article

DATA = os.path.join(os.path.dirname(__file__), "data")


def value(df, name, kind="bigint"):
    return df.withColumn(name, F.try_variant_get("metadata", f"$.{name}", kind))


def test_stories(spark):
    got = stories.read_stories(spark, f"{DATA}/stories")
    got = value(value(got, "score"), "comments_count").orderBy("_ord").collect()
    assert [r._ord >> 20 for r in got] == [12345, 12347, 12348, 12349]
    first, ask, jobs, blank = got
    assert (first.title, first.url, first.author) == ("Test Story", "https://example.com", "testuser")
    assert (first.score, first.comments_count, first.category) == (100, 50, "General")
    assert first.published_at == "2024-01-15T09:50:00Z"
    assert ask.category == "Ask HN" and ask.url.endswith("item?id=12347") and not ask._has_page
    assert ask.content.startswith("I'm curious")
    assert (jobs.category, jobs.score, jobs.published_at, jobs.author) == ("Jobs", 0, None, "Unknown")
    assert (blank.title, blank.published_at) == ("Untitled", None)


def test_distinct_stories_never_share_a_place(spark, monkeypatch):
    def items(n, item, parts):
        rows = spark.range(0, n, 1, parts).selectExpr(
            f"CAST({item} AS bigint) AS id", "'story' AS type", "concat('t', id) AS title", "'u' AS url", "'b' AS by",
            "1L AS time", "id AS score", "0L AS descendants", "'' AS text")
        return rows.unionByName(rows.where("score < 10"))

    for item in ("NULL", "7"):
        got = stories.parse_stories(items(60_000, item, 4)).select("_ord", "title")
        assert got.count() == got.select("_ord").distinct().count() == got.select("title").distinct().count() == 60_000

    monkeypatch.setattr(stories, "_PLACE_BITS", 3)  # more crawls than places
    of = [stories.parse_stories(
        items(20, "NULL", n).unionByName(items(30, "5", n)).unionByName(items(1, "6", n)).unionByName(items(1, "2", n)))
        for n in (1, 5)]
    of = [{tuple(x) for x in value(r, "hn_id").select("_ord", "hn_id", "title").collect()} for r in of]
    assert of[0] == of[1] and len({o for o, *_ in of[0]}) == len(of[0]) == 52
    assert [i for _, i, _ in sorted(of[0])] == [None] * 20 + [2] + [5] * 30 + [6]


def test_rss(spark):
    got = feeds.read_rss(spark, f"{DATA}/rss").orderBy("_ord").collect()
    assert [r.title for r in got] == ["T1 GPT release", "Old breach", "Second file"]
    first, plain, second = got
    assert (first.author, first.published_at) == ("Ann", "2025-01-01T12:00:00Z")
    assert first.summary == "HelloWorld& more" and first.content == "Bodytext"
    assert first.tags == ["Startups", "Venture", "Startups"] and first.category == "Startups"
    assert first.image_url == "https://img.example.com/1.png"
    assert (plain.author, plain.category, plain.published_at) == (
        "Unknown", "Tech News", "2025-01-15T00:00:00Z",
    )
    assert second.image_url == "https://img.example.com/b.png"


def test_categorised_rss(spark):
    got = feeds.read_rss_categorised(spark, f"{DATA}/rss", "Enterprise").orderBy("_ord").collect()
    assert [r.category for r in got] == ["AI/ML", "Security", "Enterprise"]
    assert got[0].tags == ["Startups", "Venture"] and got[1].author == "Bob"


def test_same_order_of_arrival_under_any_partitioning(spark):
    a = feeds.read_rss_items(spark, f"{DATA}/rss").select("_ord", "link").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        b = feeds.read_rss_items(spark, f"{DATA}/rss").select("_ord", "link").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(a, key=lambda r: r._ord) == sorted(b, key=lambda r: r._ord)


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "_ord bigint, html string")


def test_article_cards(spark):
    html = (
        "<article><h2><a href='/a'>One <b>two</b></a></h2><span class='post-byline x'>Ann</span>"
        "<time datetime='2025-01-15T10:30:00Z'>t</time><div class='excerpt'><div>Short</div> text</div></article>"
        "<article><h3>No link</h3></article><article><p>no title</p></article>"
    )
    fallback = "<div class='post-card'><div><h3>Deep</h3></div><p><a href='/d'>go</a></p></div><div class='x'></div>"
    got = cards.read_article_list_html(pages(spark, html, fallback, None)).orderBy("_ord").collect()
    assert [(r.title, r.url, r.author, r.published_at, r.summary) for r in got] == [
        ("Onetwo", "/a", "Ann", "2025-01-15T10:30:00Z", "Shorttext"),
        ("Deep", "/d", "Unknown", None, ""),
    ]


def test_product_cards(spark):
    box = (
        "<div class='styles_item__x'><a href='/posts/one'><h3>One</h3></a><p>One</p>"
        "<span>A tagline that is long enough</span><b> 12 </b><b>345</b><i class='user'>Ann</i>"
        "<em class='topic'>AI</em><em class='topic'> </em><img srcset='s.png 2x, t.png 3x'></div>"
    )
    by_link = "<div><div><a href='/posts/two-x'>Two</a></div></div>"
    got = cards.read_product_cards_html(pages(spark, box, by_link))
    got = value(value(got, "upvotes"), "image_url", "string").orderBy("_ord").collect()
    assert [(r.title, r.url, r.author, r.summary, r.upvotes, r.tags, r.image_url) for r in got] == [
        ("One", "https://www.producthunt.com/posts/one", "Ann", "A tagline that is long enough", 345,
         ["AI"], "s.png"),
        ("Two", "https://www.producthunt.com/posts/two-x", "Unknown", "", 0, [], None),
    ]
    assert got[0].published_at is None and got[0].category == "Product Launch"


def test_repo_rows(spark):
    row = (
        "<article class='Box-row'><h2><a href='/owner/repo'> owner / repo </a></h2>"
        "<p class='col-9 my'>A React thing</p><span itemprop='programmingLanguage'>Rust</span>"
        "<a href='/owner/repo/stargazers'> 1,234 </a><a href='/owner/repo/forks'>1.2k</a>"
        "<span><svg></svg>56 stars today</span><a class='avatar' href='https://x/y'></a>"
        "<a class='avatar' href='/ann'></a><a class='avatar' href='/a/b'></a></article>"
        "<article class='Box-row'><h2><a href='/short'>x</a></h2></article>"
    )
    got = cards.read_repo_rows_html(pages(spark, row))
    for name in ("stars", "forks", "today_stars"):
        got = value(got, name)
    r = value(got, "image_url", "string").first()
    assert got.count() == 1
    assert (r.title, r.url, r.author) == ("owner / repo", "https://github.com/owner/repo", "ann")
    assert (r.category, r.tags, r.content) == ("Web Development", ["Rust"], "A React thing")
    assert (r.stars, r.forks, r.today_stars) == (1234, 1200, 56)
    assert r.image_url.endswith("/owner/repo")


def test_repo_category_order(spark):
    texts = ["a mail server", "web api", "api", "kubernetes", "privacy", "", None]
    assert column(spark, texts, cards.repo_category) == [
        "AI/ML", "Web Development", "Backend", "DevOps", "Security", "Open Source", "Open Source",
    ]


def test_json_posts_depth_and_scripts(spark):
    def nested(levels):
        return '{"k": ' * levels + '{"name": "n", "tagline": "t", "slug": "s", "topics": ["x", "y"]}' + "}" * levels

    html = [
        f'<script type="application/json">{nested(10)}</script>',
        f'<script type="application/json">{nested(11)}</script>',
        f'<script type="application/json">oops</script><script id="__NEXT_DATA__">{nested(0)}</script>',
        "<p>none</p>",
    ]
    found = posts.find_json_posts(posts.page_json(pages(spark, *html)))
    got = sorted((r._ord >> cards.POSITION_BITS, r.url, tuple(r.tags)) for r in found.collect())
    url = "https://www.producthunt.com/posts/s"
    assert got == [(0, url, ("x", "y")), (2, url, ("x", "y"))]


def test_json_posts_members(spark):
    payload = (
        '[{"name": "A", "tagline": "t", "slug": "a", "createdAt": "", "featuredAt": "2025-01-15", '
        '"votesCount": 7, "user": {"name": "Ann"}, "child": {"name": "B", "tagline": "", "slug": null}},'
        ' {"name": "C", "tagline": "t"}]'
    )
    df = spark.createDataFrame([(5, payload)], "_ord bigint, payload string")
    got = value(posts.find_json_posts(df), "upvotes").orderBy("title").collect()
    assert [(r.title, r.author, r.published_at, r.upvotes, r.summary) for r in got] == [
        ("A", "Ann", "2025-01-15T00:00:00Z", 7, "t"), ("B", "Unknown", None, 0, ""),
    ]
    assert len({r._ord for r in got}) == 2


def test_conform_defaults(spark):
    df = raw(spark, [article(title="  ", author=" ", category=None, tags=None, published_at="x")])
    r = conform_article(df.drop("summary"), "feed").first()
    assert (r.source, r.title, r.author, r.category, r.summary, r.tags, r.published_at) == (
        "feed", "Untitled", "Unknown", "General", "", [], None,
    )


def test_first_feed_wins(spark):
    def feed(*urls):
        return raw(spark, [article(url=u, title=f"{u}{i}") for i, u in enumerate(urls)])

    merged = union_feeds([feed("b", "a", "b"), feed("a", "c")], ["daily", "weekly"]).orderBy("_ord")
    assert [(r.title, r.timespan) for r in merged.collect()] == [
        ("b0", "daily"), ("a1", "daily"), ("c1", "weekly"),
    ]


def test_register_sources(spark):
    empty = registry.default_sources(spark).limit(0)
    first = registry.register_sources(empty)
    assert [r.name for r in first.orderBy("id").collect()][0] == "hackernews" and first.count() == 5
    assert registry.register_sources(first).count() == 5
    assert registry.list_sources(first).columns == ["id", "name", "display_name", "url", "is_active"]


def test_page_extraction(spark):
    html = (
        '<html lang="en"><head><title> A &amp; B </title>'
        "<meta content='https://i/t.png' name='twitter:image'><meta property='og:image' content=''></head>"
        "<body><nav>menu</nav><main><h1>Head</h1><p>One  two</p><div class=\"ad\">buy</div>"
        "<!-- c --><p>Three &lt;x&gt;</p><aside>side</aside></main><footer>foot</footer></body></html>"
    )
    df = spark.createDataFrame([("http://Host.com/x", html)], "url string, html string")
    r = page_metadata(df).withColumn("text", main_text(F.col("html"))).first()
    assert (r.page_title, r.page_lang, r.page_host, r.image_url) == (
        "A & B", "en", "host.com", "https://i/t.png",
    )
    assert r.text == "Head\nOne two\nThree <x>"
    assert column(spark, [None, "", "plain"], main_text) == ["", "", "plain"]


def test_card_readers_need_no_package_on_executors(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((cards.article_cards, cards.tree)))
    code = (
        "import pickle; find, tree = pickle.load(open('f.pkl', 'rb'));"
        "print(len(list(find(tree('<article><h2><a href=x>t</a></h2></article>')))))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert out.stdout.strip() == "1", out.stderr


def test_hostile_pages_are_read(spark):
    n = 50_000
    pages = ["<p>" * n, "<li>x" * n, "<div>" * n + "</div>" * n, "</div>" * n, "<div>" * n + "</p>" * n,
             "<article><h2><a href='/u'>t</a></h2><div class='author'>" + "<b>" * n + "who</article>"]
    df = spark.createDataFrame(list(enumerate(pages)), "_ord bigint, html string")
    assert [(r.title, r.author) for r in cards.read_article_list_html(df).collect()] == [("t", "who")]
    assert cards.read_repo_rows_html(df).count() == cards.read_product_cards_html(df).count() == 0


def test_implied_ends():
    root = tree("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><th>3</table><p>x<p>y")
    assert [n.text() for n in root.all("li")] == ["a", "bc", "c"]
    assert [n.text() for n in root.all("tr")] == ["12", "3"] and [n.text() for n in root.all("p")] == ["x", "y"]


def test_positions_never_collide(spark):
    page = "<article><h2><a href='/u'>t</a></h2></article>" * 3
    with pytest.raises(Exception, match="card|range"):
        cards.read_article_list_html(spark.createDataFrame([(1 << 60, page)], "_ord bigint, html string")).collect()


def test_only_text_topics(spark):
    payload = '{"name": "n", "tagline": "t", "slug": "s", "topics": [{"name": "AI"}, "x", 5, null, ["y"], "z"]}'
    df = spark.createDataFrame([(1, payload)], "_ord bigint, payload string")
    assert posts.find_json_posts(df).first().tags == ["x", "z"]


def test_large_feed_is_read_by_several_tasks(spark, tmp_path):
    """Items on several lines, cut anywhere by the splits: all of them, in their order, and nothing is shuffled."""
    from newsflow.sources import feeds

    (tmp_path / "in").mkdir()
    for name, first in (("b.xml", 3000), ("a.xml", 0)):
        items = "\n".join(
            f"<item>\n <title>Title {i}</title>\n<link>https://e.com/{i}</link><description>{'x' * (i % 97)}</description></item>"
            for i in range(first, first + 3000))
        (tmp_path / "in" / name).write_text(f"<rss><channel><title>t</title>{items}\n</channel></rss>")
    (tmp_path / "in" / "c.xml").write_text("<rss></rss>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        small = feeds.read_rss(spark, str(tmp_path / "in"))
        assert small.rdd.getNumPartitions() > 10
        rows = small.select("url", "_ord").orderBy("_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = feeds.read_rss(spark, str(tmp_path / "in"))
    assert [r.url for r in rows] == [f"https://e.com/{i}" for i in range(6000)]
    assert [r.url for r in whole.orderBy("_ord").collect()] == [r.url for r in rows]
    assert len({r._ord for r in rows}) == 6000
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any("payload" in x for x in plan.split("\n") if "Exchange" in x)


def test_items_are_not_shuffled_whatever_size_spark_expects(spark, tmp_path):
    from newsflow.sources import feeds

    (tmp_path / "a.xml").write_text("".join(f"<item><title>T{i}</title><link>https://e.com/{i}</link></item>" for i in range(20)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = feeds.read_rss(spark, str(tmp_path))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not any("payload" in x for x in plan.split("\n") if "Exchange" in x)
        assert [r.url for r in read.orderBy("_ord").collect()] == [f"https://e.com/{i}" for i in range(20)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feed_files_are_as_many_as_the_parts_of_the_scan(spark, sf_dir, tmp_path):
    """A fixed number of files makes each of them, and the task that writes it, grow with the input."""
    from checks import queries as Q

    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(spark.read.text(Q._feed_files(spark, str(tmp_path))).inputFiles()) >= 8


def test_line_files_are_as_many_as_the_parts_of_the_scan(spark, sf_dir, tmp_path):
    from checks import queries as Q

    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    half = Q._line_files(spark, str(tmp_path), str(tmp_path / "lines"))
    lines = spark.read.text(str(tmp_path / "lines"))
    assert lines.count() == spark.read.parquet(str(tmp_path / "documents.parquet")).count()
    assert len(lines.inputFiles()) >= 8 and half == -(-len(lines.inputFiles()) // 2)
