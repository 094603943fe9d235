"""DuckDB SQL for the queries of ``checks.queries``, over the same tables."""

from __future__ import annotations

from checks.queries import CORPUS_BOOST, CORPUS_COMPANIES, CORPUS_LEXICON, CORPUS_RULES
from newsflow import rules as R
from newsflow import views as V

WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x0b]"


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def list_of(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]::VARCHAR[]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{BLANK}+|{BLANK}+\z', '', 'g')"


def pick(options, index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {text(o)}" for i, o in enumerate(options) if o is not None)
    return f"CASE {index} {whens} END"


# ------------------------------------------------------------------ test views
FIRST_LINE = r"regexp_extract(text, '^([^.\n]*)', 1)"
DOC_DAY = "(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER))"
RAW = f"""
raw AS (
  SELECT doc_id AS ord, source, lang, n_chars,
    substr({FIRST_LINE}, 1, 120) AS title,
    'https://' || source || '.example.com/' || lang || '/' || doc_id
      || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END AS url,
    CASE WHEN doc_id % 4 <> 0 THEN 'author ' || (doc_id % 17) END AS author,
    CASE doc_id % 5 WHEN 0 THEN strftime({DOC_DAY}, '%Y-%m-%d')
      WHEN 1 THEN strftime({DOC_DAY}, '%Y-%m-%d') || 'T06:30:00+05:30'
      WHEN 2 THEN strftime({DOC_DAY}, '%B %-d, %Y')
      WHEN 3 THEN strftime({DOC_DAY}, '%Y-%m-%d') || ' 12:15:00'
      ELSE 'junk' END AS published_at,
    CASE WHEN doc_id % 3 = 0
      THEN '<p>' || replace(replace(text, '&', '&amp;'), chr(10), '</p>' || chr(10) || '<p>') || '</p>'
      ELSE replace(text, '&', '&amp;') || '&nbsp; &lt;b&gt;caf&eacute;&lt;/b&gt; ' END AS content,
    substr(text, 1, 300) AS summary,
    {pick(V.CATEGORY_CASES, f"doc_id % {len(V.CATEGORY_CASES)}")} AS category,
    [lang, upper(source), 'C++', 'News Desk', lang] AS tags,
    doc_id % 97 AS score, n_chars % 13 AS upvotes
  FROM documents)"""

NEWS = f"news AS (SELECT doc_id AS ord, {FIRST_LINE} AS title, text AS content FROM documents)"

GAPPY = f"""{RAW},
gappy AS (
  SELECT * REPLACE (
    CASE WHEN ord % 13 = 0 THEN ' ' || chr(9) WHEN ord % 17 = 0 THEN NULL ELSE title END AS title,
    CASE WHEN ord % 19 = 0 THEN NULL WHEN ord % 23 = 0 THEN 'ftp://' || url
      WHEN ord % 29 = 0 THEN 'https:///nohost' ELSE url END AS url)
  FROM raw)"""


def is_blank(c: str) -> str:
    return rf"({c} IS NULL OR regexp_full_match({c}, '{BLANK}*'))"


def url_key(c: str) -> str:
    """Key from the separately extracted parts of the URL."""
    scheme = rf"regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)"
    host = rf"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
    path = rf"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    cut = rf"regexp_replace(regexp_replace({path}, ';[^/]*$', ''), '/+$', '')"
    return f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE lower({scheme} || '://' || {host} || {cut}) END"


def is_http(c: str) -> str:
    return rf"coalesce(regexp_matches({c}, '^(?i:https?)://[^/?#]+'), false)"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{WORD}+')"


def title_key(c: str) -> str:
    return (
        f"array_to_string(list_sort(list_slice(list_filter({words(c)}, "
        f"lambda w: length(w) > 3), 1, 5)), ' ')"
    )


# published date, scrape date for the unreadable ones
PUBLISHED = f"""CASE ord % 5
  WHEN 1 THEN try_cast(replace(split_part(published_at, '+', 1), 'T', ' ') AS TIMESTAMP)
  WHEN 2 THEN try_strptime(published_at, '%B %d, %Y')
  WHEN 4 THEN TIMESTAMP '2024-03-01 00:00:00'
  ELSE try_cast(published_at AS TIMESTAMP) END"""
PUBLISHED_TEXT = f"strftime({PUBLISHED}, '%Y-%m-%d %H:%M:%S')"
SCRAPED_TEXT = "'2024-03-01 00:00:00'"


def normal_text(c: str) -> str:
    """References of the test texts, tags, blanks, control characters."""
    plain = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&eacute;", "é"), ("&quot;", '"'),
                       ("&nbsp;", " "), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', '{char}')"
    plain = rf"regexp_replace({plain}, '(</?[A-Za-z][^>]*>)+', chr(10), 'g')"
    plain = rf"regexp_replace({plain}, '[ \t]+', ' ', 'g')"
    plain = rf"regexp_replace({plain}, '\n\n\n+', chr(10) || chr(10), 'g')"
    plain = rf"regexp_replace({plain}, '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    return strip(plain)


def standard_category(c: str) -> str:
    key = strip(f"lower({c})")
    exact = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in R.CATEGORY_MAP.items())
    part = " ".join(
        f"WHEN contains({key}, {text(k)}) THEN {text(v)}" for k, v in R.CATEGORY_MAP.items()
    )
    title = (
        rf"array_to_string(list_transform(regexp_extract_all({key}, '\p{{L}}+|[^\p{{L}}]+'), "
        "lambda r: upper(r[1:1]) || r[2:]), '')"
    )
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN 'Tech News' ELSE "
        f"coalesce(CASE {key} {exact} END, CASE {part} END, {title}) END"
    )


CLEAN_TAGS = "array_to_string([t for t in [lang, lower(source), 'news desk'] if length(t) > 1], '|')"


def keep_first(view: str, key: str) -> str:
    """Rows of the view whose ord is the smallest of their key."""
    return f"(SELECT * FROM {view} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord) = 1)"


# -------------------------------------------------------------- text analytics
def categorized(view: str, title: str, content: str, rules, current: str = "NULL") -> str:
    """CTEs ending in ``verdict(ord, category, confidence)``: one join row per
    keyword that occurs, counted by the text that its removal saves."""
    table = values(
        (i, text(c.name), 3 * len(c.keywords), j, text(kw), len(kw), c.weight)
        for i, c in enumerate(rules)
        for j, kw in enumerate(c.keywords)
    )
    return f"""
texts AS (
  SELECT ord, {title} AS title, lower({title} || ' ' || coalesce({content}, '')) AS body,
    lower({title}) AS head, {current} AS current FROM {view}),
rule(cat, name, top, pos, kw, n, w) AS {table},
hit AS (
  SELECT ord, cat, name, top, pos,
    (length(body) - length(replace(body, kw, ''))) // n
      * CASE WHEN contains(head, kw) THEN 2 ELSE 1 END * w::DOUBLE AS points
  FROM texts, rule WHERE contains(body, kw)),
scored AS (
  SELECT ord, cat, name, top, list_sum(list(points ORDER BY pos)) AS score
  FROM hit GROUP BY ord, cat, name, top),
best AS (
  SELECT *, least(score / top, 1.0) AS confidence FROM scored
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, cat) = 1),
verdict AS (
  SELECT t.ord,
    CASE WHEN coalesce(t.title, '') = '' OR b.ord IS NULL THEN coalesce(nullif(t.current, ''), 'Tech News')
      WHEN b.confidence < 0.1 AND coalesce(t.current, '') <> '' THEN t.current
      ELSE b.name END AS category,
    CASE WHEN coalesce(t.title, '') = '' THEN 0.0 ELSE coalesce(b.confidence, 0.0) END AS confidence
  FROM texts t LEFT JOIN best b USING (ord))"""


def keyworded(view: str, key: str, body: str, k: int, boost=R.TECH_TERMS, name="keyworded") -> str:
    """CTEs ending in ``name(key, keywords)``: words exploded with their
    position, counted, ranked."""
    edge = WORD[1:-1]
    # a token is a whole run of word characters that is plain latin
    return f"""
{name}_token AS (
  SELECT {key}, unnest(l) AS word, generate_subscripts(l, 1) AS pos
  FROM (SELECT {key}, regexp_extract_all(lower(coalesce({body}, '')), '[{edge}]+') AS l FROM {view})),
{name}_count AS (
  SELECT {key}, word, count(*) * CASE WHEN list_contains({list_of(boost)}, word) THEN 2 ELSE 1 END AS n,
    min(pos) AS pos
  FROM {name}_token
  WHERE regexp_full_match(word, '[a-z][a-z0-9]*') AND length(word) >= 3
    AND NOT list_contains({list_of(R.STOP_WORDS)}, word)
  GROUP BY {key}, word),
{name}_top AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, pos) AS rank FROM {name}_count
  QUALIFY rank <= {k}),
{name}_list AS (SELECT {key}, list(word ORDER BY rank) AS found FROM {name}_top GROUP BY {key}),
{name} AS (
  SELECT v.{key}, coalesce(l.found, []::VARCHAR[]) AS words, array_to_string(coalesce(l.found, []::VARCHAR[]), '|') AS keywords
  FROM (SELECT DISTINCT {key} FROM {view}) v LEFT JOIN {name}_list l USING ({key}))"""


def mood(view: str, key: str, body: str, lexicon, name="mood") -> str:
    return f"""
{name}_words AS (
  SELECT {key}, list_distinct({words(f"coalesce({body}, '')")}) AS w FROM {view}),
{name}_count AS (
  SELECT {key}, greatest(len(w), 1) AS size,
    len(list_filter(w, lambda x: list_contains({list_of(lexicon.positive)}, x))) AS p,
    len(list_filter(w, lambda x: list_contains({list_of(lexicon.negative)}, x))) AS n
  FROM {name}_words),
{name} AS (
  SELECT {key}, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label,
    p AS positive, n AS negative, abs(p - n) / size AS confidence FROM {name}_count)"""


DEFAULT_LEXICON = R.Lexicon()
# title, summary and content as the analytics read them
FULL = "coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '')"

# stored articles (no deduplication, texts as they came)
ARTICLES = f"""{RAW},
filled AS (
  SELECT * REPLACE (coalesce(author, 'Unknown') AS author,
    coalesce(nullif(category, ''), 'Tech News') AS category) FROM raw),
{categorized("filled", "title", FULL, CORPUS_RULES)},
{keyworded("filled", "ord", FULL, 5)},
{mood("filled", "ord", FULL, CORPUS_LEXICON)},
articles AS (
  SELECT ord, ord + 1 AS id, substr(sha256(url), 1, 24) AS hash_id, source AS source_name, title, url, author,
    {PUBLISHED} AS published_at, TIMESTAMP '2024-03-01 00:00:00' AS scraped_at,
    CASE WHEN ord % 50 <> 7 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds((ord * 7919) % 500000) END AS generated_at,
    content, summary, {standard_category("f.category")} AS category,
    {CLEAN_TAGS} AS tags, length(content) > 100 AS has_content, score, upvotes,
    v.category AS ai_category, v.confidence AS ai_confidence, k.words AS ai_keywords,
    m.label AS sentiment, m.confidence AS sentiment_score
  FROM filled f JOIN verdict v USING (ord) JOIN keyworded k USING (ord) JOIN mood m USING (ord))"""

VIEW = f"""id, hash_id, source_name, title, url, author,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  md5(substr(summary, 1, 200)) AS summary_md5, category, tags"""
NEWEST = "published_at DESC NULLS FIRST, hash_id"

RUNS = """
runs AS (
  SELECT 'source' || (user_id % 5) AS source_name, ts AS started_at,
    CASE WHEN event_type <> 'view' THEN ts + to_seconds(k) END AS completed_at,
    CASE WHEN event_type <> 'view' THEN k END AS duration_seconds,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status,
    CASE WHEN event_type IN ('purchase', 'signup') THEN k ELSE 0 END AS articles_added,
    CASE WHEN event_type IN ('purchase', 'signup') THEN k // 10 ELSE 0 END AS articles_pruned
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE event_type <> 'click')"""

SOURCES = """
sources AS (
  SELECT DISTINCT CAST(replace(source, 'src', '') AS INTEGER) + 1 AS id, source AS name,
    'S' || substr(source, 2) AS display_name, 'https://' || source || '.example.com' AS url,
    CAST(replace(source, 'src', '') AS INTEGER) % 2 = 0 AS is_active, 6 AS scrape_frequency_hours
  FROM documents WHERE CAST(replace(source, 'src', '') AS INTEGER) % 4 <> 3)"""

# ----------------------------------------------------------------------- pages
HTML_TEXT = "html"
for _pattern in (r"<!--.*?-->", r"<script\b.*?</script>", r"<style\b.*?</style>", r"<nav\b.*?</nav>",
                 r"<header\b.*?</header>", r"<footer\b.*?</footer>", r"<aside\b.*?</aside>",
                 r'<div class="ad".*?</div>'):
    HTML_TEXT = f"regexp_replace({HTML_TEXT}, '{_pattern}', ' ', 'gis')"


def decoded(c: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"),
                       ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


_BODY = rf"coalesce(nullif(regexp_extract(h, '<article\b[^>]*>(.*)</article>', 1, 'is'), ''), h)"
_LINES = rf"regexp_replace({_BODY}, '</?(?:p|br|h[1-6]|div|li|ul|ol|tr|table|blockquote|pre|section)\b[^>]*>', chr(10), 'gi')"
_TEXT = decoded(f"regexp_replace({_LINES}, '<[^>]*>', '', 'g')")
_TEXT = rf"regexp_replace({_TEXT}, '[ \t]+', ' ', 'g')"
MAIN_TEXT = strip(rf"regexp_replace({_TEXT}, '{BLANK}*\n{BLANK}*', chr(10), 'g')")
PAGE_TITLE = strip(decoded(r"regexp_extract(html, '<title\b[^>]*>(.*?)</title>', 1, 'is')"))
PAGE_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
PAGE_TEXTS = f"""
page_texts AS (
  SELECT page_id AS ord, page_id, url, {PAGE_TITLE} AS title, {PAGE_HOST} AS source, {MAIN_TEXT} AS page_text
  FROM (SELECT *, {HTML_TEXT} AS h FROM pages))"""


def linked_items(extra: str) -> str:
    return f"""{PAGE_TEXTS},
first_page AS {keep_first("page_texts", "url")},
linked AS (
  SELECT d.doc_id, p.url, CASE d.doc_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'Note ' || d.doc_id ELSE d.text END AS body
  FROM documents d JOIN pages p
    ON p.page_id = CASE WHEN d.doc_id % 3 = 0 THEN 0 ELSE d.doc_id % (SELECT count(*) FROM pages) END)
SELECT l.doc_id, {extra} FROM linked l JOIN first_page f USING (url)"""


# -------------------------------------------------------------------- sources
def _feed(category: str, author: str, tags: str) -> str:
    body = "replace(text, '&', '&amp;')"
    shown = strip(decoded(body))
    return rf"""
SELECT * FROM (
  SELECT doc_id, title, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'https://' || source || '.example.com/' || doc_id END AS url,
    {author} AS author,
    strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') || 'T07:08:09Z' AS published_at,
    {category} AS category, {tags} AS tags,
    CASE WHEN doc_id % 2 = 0 THEN 'https://img.example.com/' || doc_id || '.png' END AS image_url,
    md5(substr({shown}, 1, 500)) AS summary_md5,
    md5({shown} || 'end') AS content_md5
  FROM (SELECT *, {strip(f"{FIRST_LINE} || CASE WHEN doc_id % 5 = 0 THEN ' gaming' ELSE '' END")} AS title FROM documents))
WHERE url <> '' AND title <> ''"""


def first_matching(c: str, rules, otherwise: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({c}, {text(n)})" for n in needles) + f" THEN {text(name)}"
        for name, needles in rules
    )
    return f"CASE {whens} ELSE {otherwise} END"


CARD_TEXT = "replace(replace(text, '&', 'and'), '<', '(')"

# -------------------------------------------------------- upsert test frames
UPSERT = f"""{ARTICLES},
stored AS (SELECT * FROM articles WHERE ord % 3 <> 2),
doubled AS (
  SELECT ord, title, url, hash_id, source_name, category FROM articles WHERE ord % 2 = 0
  UNION ALL
  SELECT ord + 1099511627776, title || ' (again)', url, hash_id, source_name, category
  FROM articles WHERE ord % 2 = 0 AND ord % 10 = 0),
incoming AS (
  SELECT ord, CASE WHEN ord % 26 <> 0 THEN title END AS title, url,
    CASE WHEN ord % 7 = 0 THEN 'other' || hash_id ELSE hash_id END AS hash_id, source_name, category
  FROM doubled),
matched AS (
  SELECT i.*, coalesce(h.hash_id, u.hash_id) AS target
  FROM incoming i LEFT JOIN stored h ON h.hash_id = i.hash_id LEFT JOIN stored u ON u.url = i.url),
latest AS (
  SELECT * FROM matched WHERE title IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY coalesce(target, hash_id) ORDER BY ord DESC) = 1),
prepared AS (
  SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY coalesce(target, chr(10) || url) ORDER BY ord DESC) = 1)"""

GENERATED = "strftime(generated_at, '%Y-%m-%d %H:%M:%S')"

CUTOFF = "(SELECT min(generated_at) FROM (SELECT generated_at FROM articles ORDER BY generated_at DESC NULLS FIRST LIMIT 100))"


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


SURVIVORS = f"""{GAPPY},
by_url AS {keep_first("gappy", url_key("url"))},
present AS (SELECT * FROM by_url WHERE NOT {is_blank("title")} AND NOT {is_blank("url")}),
valid AS (SELECT * FROM present WHERE {is_http("url")}),
by_title AS {keep_first("valid", title_key(normal_text("title")))}"""

CLEANED = """
cleaned AS (
  SELECT ord, source, lang, {n_title} AS title, url, {n_summary} AS summary, {n_content} AS content,
    category, author, published_at, tags, score
  FROM {kept})"""


def cleaned(kept: str) -> str:
    return CLEANED.format(
        n_title=normal_text("title"), n_summary=normal_text("summary"),
        n_content=normal_text("content"), kept=kept,
    )


ORACLE: dict[str, str] = {
    # ------------------------------------------------------------------ sources
    "stories": f"""
SELECT doc_id AS story_id, CASE WHEN {is_blank("title")} THEN 'Untitled' ELSE title END AS title,
  CASE WHEN doc_id % 4 <> 0 THEN 'https://' || source || '.example.com/' || doc_id
    ELSE 'https://news.ycombinator.com/item?id=' || doc_id END AS url,
  CASE WHEN doc_id % 9 <> 0 THEN source ELSE 'Unknown' END AS author,
  CASE doc_id % 6 WHEN 0 THEN 'Ask HN' WHEN 1 THEN 'Show HN' WHEN 2 THEN 'Tell HN' WHEN 3 THEN 'Jobs'
    ELSE CASE WHEN contains(lower(title), 'hiring') OR contains(lower(title), 'job') THEN 'Jobs' ELSE 'General' END
    END AS category,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 61), '%Y-%m-%dT%H:%M:%SZ') AS published_at,
  md5(CASE WHEN {is_blank('text')} THEN '' ELSE text END) AS content_md5,
  CASE WHEN doc_id % 8 <> 0 THEN n_chars ELSE 0 END AS score, n_chars % 50 AS comments_count
FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'Ask HN: ' WHEN 1 THEN 'Show HN: ' WHEN 2 THEN 'Tell HN: '
    WHEN 4 THEN 'ask hn: ' ELSE '' END || substr({FIRST_LINE}, 1, 120)
    || CASE WHEN doc_id % 6 = 3 THEN ' is Hiring' ELSE '' END AS title FROM documents)
WHERE doc_id % 7 <> 0""",
    "rss_items": _feed(
        "CASE WHEN doc_id % 4 <> 0 THEN lang ELSE 'Tech News' END",
        "CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'Unknown' END",
        "CASE WHEN doc_id % 4 <> 0 THEN lang || '|' || source || '|' || lang ELSE '' END",
    ),
    "rss_categorised": _feed(
        first_matching("lower(title)", R.FEED_TITLE_RULES, "'Enterprise'"),
        "CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'Desk' END",
        "CASE WHEN doc_id % 4 <> 0 THEN lang || '|' || source ELSE '' END",
    ),
    "article_cards": f"""
SELECT doc_id, 'name' AS title, '/' || lang || '/repo' || doc_id AS url, 'By' || source AS author,
  '2024-02-03T00:00:00Z' AS published_at, 'Tech News' AS category, md5({strip(CARD_TEXT)}) AS summary_md5
FROM documents""",
    "product_cards": f"""
SELECT doc_id, 'Product ' || doc_id AS title, 'https://www.producthunt.com/posts/p' || doc_id AS url,
  'm' || doc_id AS author, lang || '|' || source AS tags, 'Product Launch' AS category,
  md5(CASE WHEN length(blurb) > 20 THEN substr(blurb, 1, 300) ELSE '' END) AS summary_md5, n_chars % 90 AS upvotes
FROM (SELECT *, {strip(CARD_TEXT + " || ' and enough words'")} AS blurb FROM documents)""",
    "repo_rows": f"""
SELECT doc_id, lang || ' / repo' || doc_id AS title, 'https://github.com/' || lang || '/repo' || doc_id AS url,
  'user' || doc_id AS author, source AS tags,
  {first_matching("lower(description)", R.REPO_RULES, "'Open Source'")} AS category,
  md5(description) AS content_md5, n_chars * 3 AS stars,
  CAST(trunc((n_chars // 100) / 10 * 1000) AS BIGINT) AS forks, n_chars % 70 AS today_stars
FROM (SELECT *, {strip(CARD_TEXT + " || CASE WHEN doc_id % 3 = 0 THEN ' web server' ELSE '' END")} AS description FROM documents)""",
    "json_posts": """
SELECT doc_id, 'Post ' || doc_id AS title, 'https://www.producthunt.com/posts/p' || doc_id AS url, source AS author,
  CASE WHEN doc_id % 2 = 0 THEN '2024-01-05T00:00:00Z' ELSE '2024-01-06T00:00:00Z' END AS published_at,
  lang AS summary, lang || '|' || source AS tags, CASE WHEN doc_id % 3 <> 0 THEN n_chars ELSE 0 END AS upvotes
FROM documents
UNION ALL
SELECT doc_id, 'Inner ' || doc_id, 'https://www.producthunt.com/posts/i' || doc_id, 'Unknown', NULL, 't', '', 0
FROM documents""",
    "compact_counts": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN cents WHEN 1 THEN CAST(trunc((cents // 1000) / 10 * 1000) AS BIGINT)
  WHEN 2 THEN 0 ELSE cents END AS n
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""",
    "union_feeds": q(RAW + r""",
cut AS (SELECT regexp_replace(url, '[0-9]+/?$', '') AS url, ord FROM raw)""", """
SELECT url, ord AS doc_id, ['daily', 'weekly', 'monthly'][CAST(ord % 3 AS INTEGER) + 1] AS timespan
FROM cut QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord % 3, ord) = 1"""),
    "conform_article": q(RAW, f"""
SELECT ord AS doc_id, source, CASE WHEN ord % 6 = 0 OR {is_blank("title")} THEN 'Untitled' ELSE title END AS title, url,
  coalesce(author, 'Unknown') AS author,
  CASE ord % 5 WHEN 0 THEN published_at || 'T00:00:00Z'
    WHEN 2 THEN strftime(try_strptime(published_at, '%B %d, %Y'), '%Y-%m-%dT%H:%M:%SZ')
    WHEN 3 THEN replace(published_at, ' ', 'T') || 'Z' END AS published_at,
  coalesce(nullif(category, ''), 'General') AS category, '' AS tags,
  md5(CASE WHEN ord % 5 = 0 OR {is_blank("summary")} THEN '' ELSE summary END) AS summary_md5
FROM raw"""),
    "register_sources": q(SOURCES, f"""
SELECT id, name, display_name, url, is_active, scrape_frequency_hours FROM sources
UNION ALL
SELECT CAST((SELECT max(id) FROM sources) + pos AS INTEGER), name, display_name, url, true, 6
FROM {values((i, text(n), text(d), text(u)) for i, (n, d, u, _) in enumerate(R.DEFAULT_SOURCES, 1))} v(pos, name, display_name, url)"""),
    "list_sources": q(SOURCES, "SELECT id, name, display_name, url, is_active FROM sources"),
    # -------------------------------------------------------------------- pages
    "page_metadata": rf"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://img/a&b.png' WHEN 1 THEN 'https://img/t.png' END AS image_url,
  {PAGE_TITLE} AS page_title, nullif(regexp_extract(html, '<html\b[^>]*\blang="([^"]*)"', 1), '') AS page_lang,
  {PAGE_HOST} AS page_host
FROM pages""",
    "page_main_text": q(PAGE_TEXTS, """
SELECT page_id, CAST(length(page_text) AS INTEGER) AS n_chars, md5(page_text) AS text_md5 FROM page_texts"""),
    "enrich_feed_content": "WITH " + linked_items("""
  CASE WHEN l.doc_id % 5 = 0 THEN 'https://img/own.png' WHEN length(l.body) < 500 THEN 'https://img/page.png' END AS image_url,
  md5(CASE WHEN length(l.body) < 500 AND f.page_text <> '' THEN f.page_text ELSE l.body END) AS content_md5""").strip(),
    "enrich_story_content": "WITH " + linked_items("""
  md5(CASE WHEN l.doc_id % 4 <> 0 AND (l.doc_id % 2 <> 0 OR l.body = '') AND f.page_text <> '' THEN f.page_text
    WHEN l.doc_id % 2 = 0 THEN l.body ELSE '' END) AS content_md5""").strip(),
    # ----------------------------------------------------------------- cleaning
    "url_dedup": f"""
SELECT page_id, url, {url_key("url")} AS url_key FROM pages
QUALIFY row_number() OVER (PARTITION BY {url_key("url")} ORDER BY page_id) = 1""",
    "drop_missing_required": q(GAPPY, f"""
SELECT ord AS doc_id, title, url FROM gappy WHERE NOT {is_blank("title")} AND NOT {is_blank("url")}"""),
    "validate_urls": q(GAPPY, f"SELECT ord AS doc_id, url FROM gappy WHERE {is_http('url')}"),
    "fill_defaults": q(RAW, """
SELECT ord AS doc_id, coalesce(author, 'Unknown') AS author, coalesce(nullif(category, ''), 'Tech News') AS category
FROM raw"""),
    "standardize_dates": q(RAW, f"""
SELECT ord AS doc_id, CASE WHEN ord % 5 <> 4 THEN strftime({PUBLISHED}, '%Y-%m-%dT%H:%M:%SZ') END AS iso,
  {PUBLISHED_TEXT} AS published_at, {SCRAPED_TEXT} AS scraped_at FROM raw"""),
    "standardize_dates_offset": q(RAW, f"""
SELECT ord AS doc_id, strftime({PUBLISHED} - CASE WHEN ord % 5 = 1 THEN INTERVAL '5 hours 30 minutes' ELSE INTERVAL '0 hours' END,
  '%Y-%m-%d %H:%M:%S') AS published_at FROM raw"""),
    "normalize_text": q(RAW, f"""
SELECT ord AS doc_id, CAST(length({normal_text("content")}) AS INTEGER) AS n_chars,
  md5({normal_text("content")}) AS content_md5, md5({normal_text("title")}) AS title_md5 FROM raw"""),
    "standardize_category": q(RAW, f"SELECT ord AS doc_id, {standard_category('category')} AS category FROM raw"),
    "clean_tags": q(RAW, f"SELECT ord AS doc_id, {CLEAN_TAGS} AS tags FROM raw"),
    "stream_status": """
SELECT count(*) FILTER (WHERE event_type = 'purchase') AS articles_generated,
  count(DISTINCT event_id % 4) AS scrapes_completed, CAST(0 AS BIGINT) AS scrapes_failed, CAST(0 AS BIGINT) AS running
FROM events""",
    "sql_url_functions": f"""
SELECT {url_key("url")} AS url_key, count(*) AS pages, min(substr(sha256(url), 1, 24)) AS hash_id,
  count(*) FILTER (WHERE regexp_matches(url, '^(?i:https?)://[^/?#]+')) AS http_pages
FROM pages GROUP BY ALL""",
    "sql_title_words": f"""
SELECT doc_id, title_key, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS word
FROM (SELECT doc_id, {title_key(FIRST_LINE)} AS title_key,
  list_slice(list_filter({words(FIRST_LINE)}, lambda w: length(w) > 3), 1, 5) AS l FROM documents)""",
    "title_dedup": q(RAW, f"""
SELECT ord AS doc_id, {title_key("title")} AS title_key FROM {keep_first("raw", title_key("title"))}"""),
    "title_dedup_keep_empty": q(RAW, f"""
SELECT ord AS doc_id FROM raw
QUALIFY {title_key("title")} = '' OR row_number() OVER (PARTITION BY {title_key("title")} ORDER BY ord) = 1"""),
    "derive_fields": q(RAW, """
SELECT ord AS doc_id, CAST(length(content) AS INTEGER) AS content_length, length(content) > 100 AS has_content,
  substr(sha256(url), 1, 24) AS hash_id FROM raw"""),
    "cleaning_report": q(SURVIVORS, """
, n AS (SELECT (SELECT count(*) FROM gappy) AS n0, (SELECT count(*) FROM by_url) AS n1,
    (SELECT count(*) FROM present) AS n2, (SELECT count(*) FROM valid) AS n3, (SELECT count(*) FROM by_title) AS n4)
SELECT 1 AS step, 'remove_url_duplicates' AS operation, n0 AS before, n1 AS after, n0 - n1 AS removed FROM n
UNION ALL SELECT 2, 'handle_missing_values', n1, n2, n1 - n2 FROM n
UNION ALL SELECT 3, 'validate_urls', n2, n3, n2 - n3 FROM n
UNION ALL SELECT 4, 'remove_similar_titles', n3, n4, n3 - n4 FROM n"""),
    "clean_articles": q(SURVIVORS + "," + cleaned("by_title"), f"""
SELECT ord AS doc_id, source, title, url, coalesce(author, 'Unknown') AS author, {PUBLISHED_TEXT} AS published_at,
  {standard_category("category")} AS category, {CLEAN_TAGS} AS tags, substr(sha256(url), 1, 24) AS hash_id,
  CAST(length(content) AS INTEGER) AS content_length, length(content) > 100 AS has_content
FROM cleaned"""),
    "to_records": q(f"""{RAW},
by_title AS {keep_first(f"(SELECT * FROM raw WHERE NOT {is_blank('title')})", title_key(normal_text("title")))},
{cleaned("by_title")},
{keyworded("cleaned", "ord", FULL, 5)}""", f"""
SELECT substr(sha256(url), 1, 24) AS hash_id, source AS source_name, title, url, {standard_category("category")} AS category,
  {CLEAN_TAGS} AS tags, keywords AS ai_keywords, length(content) > 100 AS has_content, score
FROM cleaned JOIN keyworded USING (ord)"""),
    "clean_pages": q(f"""{PAGE_TEXTS},
raw AS (SELECT ord, source, title, url, '' AS summary, page_text AS content FROM page_texts),
by_url AS {keep_first("raw", url_key("url"))},
valid AS (SELECT * FROM by_url WHERE NOT {is_blank("title")} AND {is_http("url")}),
by_title AS {keep_first("valid", title_key(normal_text("title")))},
cleaned AS (SELECT ord, source, url, {normal_text("title")} AS title, '' AS summary, {normal_text("content")} AS content FROM by_title),
{categorized("cleaned", "title", FULL, R.CATEGORY_RULES)},
{keyworded("cleaned", "ord", FULL, 5)},
{mood("cleaned", "ord", FULL, DEFAULT_LEXICON)}""", """
SELECT c.ord AS page_id, source, c.title, substr(sha256(url), 1, 24) AS hash_id, CAST(length(content) AS INTEGER) AS content_length,
  v.category AS ai_category, round(v.confidence, 6) AS ai_confidence, k.keywords AS ai_keywords,
  m.label AS sentiment, round(m.confidence, 6) AS sentiment_score
FROM cleaned c JOIN verdict v USING (ord) JOIN keyworded k USING (ord) JOIN mood m USING (ord)"""),
    # ----------------------------------------------------------- text analytics
    "categorize": q(f"{RAW}, {categorized('raw', 'title', 'content', R.CATEGORY_RULES)}", """
SELECT ord AS doc_id, category, round(confidence, 6) AS confidence FROM verdict"""),
    "categorize_corpus_rules": q(f"{RAW}, {categorized('raw', 'title', 'content', CORPUS_RULES, 'category')}", """
SELECT ord AS doc_id, category, round(confidence, 6) AS confidence FROM verdict"""),
    "categorize_news_items": q(f"{NEWS}, {categorized('news', 'title', 'content', R.CATEGORY_RULES)}", """
SELECT ord AS doc_id, category, round(confidence, 6) AS confidence FROM verdict"""),
    "keywords_news_items": q(f"{NEWS}, {keyworded('news', 'ord', 'title || chr(32) || content', 5)}",
                             "SELECT ord AS doc_id, keywords FROM keyworded"),
    "categorize_cleaned": q(f"{RAW}, {categorized('raw', 'title', FULL, R.CATEGORY_RULES)}", """
SELECT ord AS doc_id, category AS ai_category, round(confidence, 6) AS ai_confidence FROM verdict"""),
    "recategorize": q(
        f"""{RAW},
thin AS (SELECT * REPLACE (CASE WHEN ord % 2 = 0 THEN summary ELSE content END AS content) FROM raw),
{categorized('thin', 'title', 'content', CORPUS_RULES, 'category')}""", """
SELECT ord AS doc_id, category, round_even(confidence, 3) AS ai_confidence FROM verdict"""),
    "keywords": q(keyworded("documents", "doc_id", "text", 10), "SELECT doc_id, keywords FROM keyworded"),
    "keywords_boosted": q(f"{RAW}, {keyworded('raw', 'ord', FULL, 5, CORPUS_BOOST)}",
                          "SELECT ord AS doc_id, keywords FROM keyworded"),
    "conversation_keywords": q(f"""
turns AS (SELECT *, conv_id * 100000 + turn AS key FROM conversations),
{keyworded("turns", "key", "text", 3)}""", """
SELECT conv_id, turn, keywords FROM turns JOIN keyworded USING (key)"""),
    "entities": f"""
SELECT doc_id, array_to_string(list_filter([{", ".join(
        f"nullif(regexp_extract(priced, '(?i){n}', 0), '')" for n in R.COMPANIES + CORPUS_COMPANIES
    )}], lambda c: c IS NOT NULL), '|') AS companies, '' AS technologies,
  array_to_string(list_slice(regexp_extract_all(priced, '\\$[0-9,]+(?:\\.[0-9]+)?(?:\\s*(?:million|billion|M|B|m|b))?'), 1, 5), '|') AS amounts
FROM (SELECT *, text || ' raised $' || n_chars || ',5.25 million, $7 B' AS priced FROM documents)""",
    "sentiment": q(mood("documents", "doc_id", "text", DEFAULT_LEXICON), """
SELECT doc_id, label, CAST(positive AS INTEGER) AS positive, CAST(negative AS INTEGER) AS negative,
  round(confidence, 6) AS confidence FROM mood"""),
    "sentiment_corpus_words": q(mood("documents", "doc_id", "text", CORPUS_LEXICON), """
SELECT doc_id, label, CAST(positive AS INTEGER) AS positive, CAST(negative AS INTEGER) AS negative,
  round(confidence, 6) AS confidence FROM mood"""),
    "enrich": q(f"""{RAW},
{categorized("raw", "title", FULL, CORPUS_RULES)},
{keyworded("raw", "ord", FULL, 5)},
{mood("raw", "ord", FULL, CORPUS_LEXICON)}""", """
SELECT ord AS doc_id, category AS ai_category, round(v.confidence, 6) AS ai_confidence, keywords AS ai_keywords,
  label AS sentiment, round(m.confidence, 6) AS sentiment_score
FROM verdict v JOIN keyworded USING (ord) JOIN mood m USING (ord)"""),
    "article_table": q(ARTICLES, """
SELECT id, hash_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at, category, tags, ai_category,
  round(ai_confidence, 6) AS ai_confidence, array_to_string(ai_keywords, '|') AS ai_keywords, sentiment,
  round(sentiment_score, 6) AS sentiment_score FROM articles"""),
    "confident_count": q(f"{RAW}, {categorized('raw', 'title', FULL, CORPUS_RULES)}", """
SELECT count(*) AS n_articles, count(*) FILTER (confidence > 0.5) AS n_confident FROM verdict"""),
    # -------------------------------------------------------------------- joins
    "resolve_source": q(SOURCES, """
SELECT doc_id, source AS source_name, s.id AS source_id FROM documents LEFT JOIN sources s ON s.name = source"""),
    "split_new_vs_existing": q(UPSERT, """
SELECT ord AS row_id, CASE WHEN target IS NULL THEN 'new' ELSE 'known' END AS kind, coalesce(target, '') AS target
FROM matched"""),
    # ------------------------------------------------------------- aggregations
    "stats_total": "SELECT count(*) AS total_articles FROM documents",
    "stats_by_source": "SELECT source AS source_name, count(*) AS n_articles FROM documents GROUP BY ALL",
    "stats_by_category": q(RAW, f"""
SELECT {standard_category("category")} AS category, count(*) AS n_articles FROM raw GROUP BY ALL"""),
    "last_scraped": q(RUNS, "SELECT strftime(max(completed_at), '%Y-%m-%d %H:%M:%S') AS last_scraped FROM runs"),
    "last_scraped_without_runs": f"SELECT {SCRAPED_TEXT} AS last_scraped",
    "is_scraping": q(RUNS, "SELECT count(*) FILTER (status = 'running') > 0 AS is_scraping FROM runs"),
    "sentiment_distribution": q(ARTICLES, "SELECT sentiment, count(*) AS n_articles FROM articles GROUP BY ALL"),
    "total_analyzed": q(ARTICLES, "SELECT count(sentiment) AS total_analyzed FROM articles"),
    "ai_categories": q(ARTICLES, """
SELECT ai_category, count(*) AS n_articles FROM articles WHERE ai_confidence >= 0.5 GROUP BY ALL"""),
    "confidence_by_category": q(ARTICLES, """
SELECT category, round(avg(ai_confidence), 2) AS avg_confidence FROM articles GROUP BY ALL"""),
    "top_keywords": q(ARTICLES, """
SELECT keyword, count(*) AS n_articles FROM (SELECT unnest(ai_keywords) AS keyword FROM articles)
GROUP BY ALL ORDER BY n_articles DESC, keyword LIMIT 20"""),
    "insights": q(ARTICLES, """
SELECT 'sentiment' AS metric, sentiment AS key, count(*)::DOUBLE AS value FROM articles GROUP BY ALL
UNION ALL SELECT 'ai_category', ai_category, count(*)::DOUBLE FROM articles WHERE ai_confidence >= 0.5 GROUP BY ALL
UNION ALL SELECT 'confidence', category, round(avg(ai_confidence), 2) FROM articles GROUP BY ALL
UNION ALL SELECT 'total_analyzed', 'all', count(sentiment)::DOUBLE FROM articles
UNION ALL SELECT 'keyword', keyword, n::DOUBLE FROM (
  SELECT keyword, count(*) AS n FROM (SELECT unnest(ai_keywords) AS keyword FROM articles)
  GROUP BY ALL ORDER BY n DESC, keyword LIMIT 20)"""),
    "dashboard_kpis": q(ARTICLES, """
SELECT count(*) AS total_articles, count(DISTINCT source_name) AS active_sources,
  count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS categories,
  count(generated_at) AS generated FROM articles"""),
    # --------------------------------------------------------------- list views
    "article_by_id": q(ARTICLES, f"""
SELECT {VIEW.replace("substr(summary, 1, 200)", "summary")}, ai_category, sentiment FROM articles WHERE id = 42"""),
    "article_summaries": q(ARTICLES, f"SELECT {VIEW}, ai_category, sentiment FROM articles"),
    "article_feed": q(ARTICLES, f"""
SELECT {VIEW}, (SELECT count(*) FROM articles) AS total, (SELECT count(*) FROM articles) AS filtered_total,
  (SELECT count(*) FROM articles) > 40 AS has_more
FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 20 OFFSET 20)"""),
    "article_feed_filtered": q(ARTICLES + """,
chosen AS (SELECT * FROM articles WHERE source_name = 'src3' AND category = 'Ask Hn')""", f"""
SELECT {VIEW}, (SELECT count(*) FROM articles) AS total, (SELECT count(*) FROM chosen) AS filtered_total,
  (SELECT count(*) FROM chosen) > 5 AS has_more
FROM (SELECT * FROM chosen ORDER BY scraped_at DESC NULLS FIRST, hash_id LIMIT 5)"""),
    "trending": q(ARTICLES, f"""
SELECT {VIEW}, trend_score
FROM (SELECT *, score + upvotes AS trend_score FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 100)
  ORDER BY trend_score DESC, {NEWEST} LIMIT 20)"""),
    "articles_positive": q(ARTICLES, f"""
SELECT {VIEW}, round(sentiment_score, 6) AS sentiment_score FROM articles WHERE sentiment = 'positive'
ORDER BY articles.sentiment_score DESC NULLS FIRST, hash_id LIMIT 15"""),
    "articles_negative": q(ARTICLES, f"""
SELECT {VIEW}, round(sentiment_score, 6) AS sentiment_score FROM articles WHERE sentiment = 'negative'
ORDER BY articles.sentiment_score ASC NULLS LAST, hash_id LIMIT 15"""),
    "latest_ticker": q(ARTICLES, f"""
SELECT title, source_name, category, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, hash_id
FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 6)"""),
    # -------------------------------------------------------- table maintenance
    "upsert_articles": q(UPSERT, f"""
SELECT coalesce(p.hash_id, s.hash_id) AS hash_id, s.url, coalesce(p.title, s.title) AS title, s.source_name, s.category,
  {GENERATED} AS generated_at, '2024-05-23 00:00:00' AS created_at,
  CASE WHEN p.ord IS NULL THEN '2024-05-23 00:00:00' ELSE '2024-06-01 00:00:00' END AS updated_at
FROM stored s LEFT JOIN prepared p ON p.target = s.hash_id
UNION ALL
SELECT hash_id, url, title, source_name, category, '2024-06-01 00:00:00', '2024-06-01 00:00:00', '2024-06-01 00:00:00'
FROM prepared WHERE target IS NULL"""),
    "upsert_stats": q(UPSERT, """
SELECT (SELECT count(*) FROM prepared WHERE target IS NULL) AS added,
  (SELECT count(*) FROM prepared WHERE target IS NOT NULL) AS updated,
  (SELECT count(*) FROM incoming WHERE title IS NOT NULL) - (SELECT count(*) FROM prepared) AS skipped,
  (SELECT count(*) FROM incoming WHERE title IS NULL) AS errors"""),
    "prune_newest": q(ARTICLES, f"""
SELECT id FROM articles WHERE generated_at IS NULL OR generated_at >= {CUTOFF}"""),
    "prune_newest_many": """
SELECT o_orderkey FROM orders QUALIFY rank() OVER (ORDER BY o_orderdate DESC NULLS FIRST) <= 12000""",
    "prune_report": q(ARTICLES, f"""
SELECT count(*) AS total, count(*) FILTER (generated_at IS NULL OR generated_at >= {CUTOFF}) AS kept,
  count(*) FILTER (generated_at < {CUTOFF}) AS deleted, strftime({CUTOFF}, '%Y-%m-%d %H:%M:%S') AS cutoff
FROM articles"""),
    "log_runs": q(RUNS, """
SELECT source_name, status, count(*) AS n_runs, CAST(sum(duration_seconds) AS BIGINT) AS seconds,
  CAST(sum(articles_added) AS BIGINT) AS articles_added FROM runs GROUP BY ALL"""),
    # ------------------------------------------------------------------- runs
    "run_feeds": q(f"""{RAW}, {PAGE_TEXTS},
docs AS {keep_first(f"(SELECT * FROM raw WHERE NOT {is_blank('title')})", title_key(normal_text("title")))},
page_url AS {keep_first("page_texts", url_key("url"))},
page_ok AS (SELECT * FROM page_url WHERE NOT {is_blank("title")} AND {is_http("url")}),
kept AS {keep_first("page_ok", title_key(normal_text("title")))},
n AS (SELECT (SELECT count(*) FROM documents) AS d0, (SELECT count(*) FROM docs) AS d1,
  (SELECT count(*) FROM pages) AS p0, (SELECT count(*) FROM kept) AS p1)""", """
SELECT 0 AS run, 'documents' AS source, d0 AS scraped, d1 AS added, 0::BIGINT AS updated, 0::BIGINT AS skipped, 0::BIGINT AS errors, d1 + p1 AS stored FROM n
UNION ALL SELECT 1, 'pages', p0, p1, 0, 0, 0, d1 + p1 FROM n
UNION ALL SELECT 2, 'pages', p0, 0, p1, 0, 0, d1 + p1 FROM n"""),
    "interleave_sources": """
SELECT CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id), doc_id) AS INTEGER) AS turn, source, doc_id
FROM documents QUALIFY turn <= 10""",
    "run_status": q(RUNS, """
SELECT CAST(sum(articles_added) AS BIGINT) AS articles_generated, CAST(sum(articles_pruned) AS BIGINT) AS articles_pruned,
  count(*) FILTER (status = 'success') AS scrapes_completed, count(*) FILTER (status = 'failed') AS scrapes_failed,
  count(*) FILTER (status = 'running') AS running, strftime(min(started_at), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(completed_at), '%Y-%m-%d %H:%M:%S') AS last_tick_at,
  strftime(max(completed_at) FILTER (status = 'success'), '%Y-%m-%d %H:%M:%S') AS last_scrape_at,
  arg_max(source_name, completed_at) FILTER (status = 'success') AS last_source_scraped FROM runs"""),
    "source_health": q(RUNS + """,
counted AS (
  SELECT source_name, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'success') AS completed,
    count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY source_name),
queue AS (
  SELECT 'source' || (user_id % 7) AS source_name, count(*) AS n FROM events
  WHERE event_type = 'click' AND user_id % 7 <> 2 GROUP BY ALL),
facts AS (
  SELECT c.*, coalesce(n, 0) AS queue_size, running = 0 AS stopped, coalesce(n, 0) = 0 AND completed > 0 AS dry,
    failed > completed AND completed > 0 AS failing
  FROM counted c LEFT JOIN queue USING (source_name))""", """
SELECT source_name, CASE WHEN dry OR failing THEN 'degraded' WHEN stopped THEN 'stopped' ELSE 'healthy' END AS status,
  concat_ws('|', CASE WHEN stopped THEN 'Pipeline is not running' END, CASE WHEN dry THEN 'Article queue is empty' END,
    CASE WHEN failing THEN 'More scrapes failing than succeeding' END) AS issues,
  running, completed, failed, queue_size FROM facts"""),
    "stream_dedup": "SELECT DISTINCT 'https://example.com/' || user_id AS url FROM events",
    # ------------------------------------------------------------- presentation
    "excerpts": rf"""
SELECT doc_id, md5(CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[1:100], ' ') || '...' END) AS excerpt_md5
FROM (SELECT doc_id, text, regexp_split_to_array(text, '{BLANK}+') AS w FROM documents)""",
    "paragraphs": rf"""
WITH shown AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE replace(text, chr(10), ' ') END AS t
  FROM documents),
parts AS (
  SELECT doc_id, CASE WHEN contains(t, chr(10) || chr(10)) THEN
      list_transform(list_filter(string_split(t, chr(10) || chr(10)), lambda p: NOT regexp_full_match(p, '{BLANK}*')),
        lambda p: {strip("p")})
    WHEN len(s) < 4 THEN [t]
    ELSE list_transform(range(0, (len(s) + 3) // 4), lambda g:
      {strip("array_to_string(list_transform(s[g * 4 + 1 : g * 4 + 4], lambda x: " + strip("x") + "), ' ')")}) END AS p
  FROM (SELECT *, regexp_extract_all(t, '[^.!?]+[.!?]+') AS s FROM shown))
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, md5(unnest(p)) AS paragraph_md5 FROM parts""",
    "bylines": q(RAW, """
SELECT ord AS doc_id, coalesce(author, 'Newsflow Desk') AS byline, CASE WHEN author IS NULL THEN 'NE' ELSE 'AU' END AS initials,
  CAST(length(content) AS INTEGER) AS body_chars FROM raw"""),
}

# one micro-batch of all stories; posts without own URL share the key of the item page
ORACLE["stream_ingest"] = f"""
WITH s AS ({ORACLE["stories"]}),
base AS (SELECT story_id AS ord, title, url, category FROM s),
by_url AS {keep_first("base", url_key("url"))},
by_title AS {keep_first("by_url", title_key(normal_text("title")))}
SELECT substr(sha256(url), 1, 24) AS hash_id, url, {normal_text("title")} AS title,
  {standard_category("category")} AS category, 'hackernews' AS source_name
FROM by_title"""
ORACLE["read_stories"] = ORACLE["stories"]
for _name, _items in (("read_rss", "rss_items"), ("read_rss_categorised", "rss_categorised")):
    ORACLE[_name] = f"SELECT * EXCLUDE (doc_id) FROM ({ORACLE[_items]})"
ORACLE["stream_unique"] = """
WITH RECURSIVE e AS (
  SELECT event_id, epoch_us(ts) AS us, user_id, CAST(floor((floor(epoch_us(ts) / 1e6) - 1704067200) / 259200) AS INTEGER) AS day
  FROM events),
seen AS (
  SELECT event_id, us, user_id, row_number() OVER (PARTITION BY user_id ORDER BY
    CASE WHEN event_id % 7 = 0 THEN least(day + 1, 9) ELSE day END, us, event_id) AS n
  FROM e WHERE NOT (day = 0 AND event_id % 13 = 0)),
run AS (
  SELECT user_id, n, us AS at, true AS passes, event_id FROM seen WHERE n = 1
  UNION ALL
  SELECT s.user_id, s.n, CASE WHEN s.us >= r.at + 432000000000 THEN s.us ELSE r.at END, s.us >= r.at + 432000000000, s.event_id
  FROM run r JOIN seen s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT event_id, 'https://example.com/' || user_id AS url FROM run WHERE passes"""
ORACLE["stream_quarantine"] = """
SELECT 'hackernews' AS source, '{"type": "story", "id": ' || doc_id || ', "title": ' AS payload, 'not an item' AS reason
FROM documents WHERE doc_id % 10 = 3"""
ORACLE["write_raw"] = "SELECT source, count(*) AS n_articles, min(doc_id) AS first_doc FROM documents GROUP BY source"
ORACLE["run_feeds_retained"] = """
SELECT 0 AS run, 'documents' AS source, 100::BIGINT AS stored
UNION ALL SELECT 1, 'pages', 100::BIGINT"""
ORACLE["article_feed_after"] = q(ARTICLES, f"""
SELECT {VIEW} FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 20 OFFSET 20)""")
ORACLE["ticker"] = q(ARTICLES, f"""
SELECT title, source_name, category, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, hash_id, 'latest' AS kind
FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 6)
UNION ALL
SELECT title, source_name, category, strftime(published_at, '%Y-%m-%d %H:%M:%S'), hash_id, 'trending'
FROM (SELECT * FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 25) ORDER BY score + upvotes DESC, {NEWEST} LIMIT 5)""")
