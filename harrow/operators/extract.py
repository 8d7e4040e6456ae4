"""Records out of parsed pages. Everything here is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.functions.text import blank_to_null, let, number_from_text, strip
from harrow.operators import dom
from harrow.operators.dom import COMMENT, DOCTYPE, RAW, TEXT, filled_attr, find_all, find_first, step, subtree, text_of

Rule = list[list[dict]]


def _nodes() -> Column:
    return F.col("nodes")


def one(tag=None, cls=(), attrs=()) -> Rule:
    """A rule of one alternative with one step."""
    return [[step(tag, cls, attrs)]]


# The selectors a thread page is read with.
AUTHOR_RULE = [[step(cls="author")], [step(cls="username")], [step(attrs=[("class", "*=", "author")])]]
TIME_RULE = [[step(cls="post-time")], [step(cls="time")], [step(attrs=[("class", "*=", "time")])]]
VIEWS_RULE = [[step(cls="views")], [step(attrs=[("class", "*=", "view")])]]
REPLIES_RULE = [[step(cls="replies")], [step(attrs=[("class", "*=", "reply")])]]
THREAD_CONTENT_RULE = [[step(cls="post-content")], [step(cls="content")], [step("article")]]

# The parts of one entry in a news list.
ARTICLE_RULES: dict[str, Rule] = {
    "article": one(cls="article"),
    "title": one(cls="title"),
    "author": one(cls="author"),
    "date": one(cls="date"),
    "summary": one(cls="body"),
    "link": one("a", attrs=[("href", "has", None)]),
}
UNKNOWN_AUTHOR = "未知作者"

# Where the text of a news article is looked for, best place first.
ARTICLE_CONTENT_PLACES: list[Rule] = [
    [[step(cls="article"), step(cls="body")]],
    [[step(attrs=[("id", "=", "single")]), step(cls="article"), step(cls="body")]],
    one(cls="article-body"),
    one(cls="article-content"),
    one(cls="post-body"),
    one(cls="post-content"),
    one(cls="news-detail"),
    one(cls="news-content"),
    one(cls="detail-content"),
    [[step("article"), step(cls="content")]],
    one(attrs=[("id", "=", "content")]),
    one(cls="content"),
]

# Signs that a list page has more to load.
LOAD_MORE_RULE = [
    [step("a", "more", [("data-action", "=", "switch_page")])],
    [step("a", "load-more")],
    [step("button", "load-more")],
    [step(attrs=[("data-action", "*=", "load")])],
    [step(attrs=[("data-action", "*=", "more")])],
]
LOAD_MORE_WORDS = ["查看更多", "load more", "加载更多", "show more", "更多"]
# Fixed value: a host whose links are files, never articles.
FILE_LINK_MARKS = [*U.LINK_IMAGE_MARKS, "res.xdcdn.net"]

ANY_LINK = one("a", attrs=[("href", "has", None)])


def forum_image_candidate(img: Column) -> Column:
    """First filled of src, data-src, data-original."""
    return F.coalesce(*[filled_attr(img, a) for a in ("src", "data-src", "data-original")])


def news_image_candidate(img: Column) -> Column:
    """Widest srcset entry, else the lazy source, else src without its size."""

    def entry(item: Column) -> Column:
        size = F.regexp_extract(F.substring_index(item, " ", -1), r"(\p{Nd}+)w", 1)
        url = strip(F.regexp_replace(item, r" [^ ]*$", ""))
        return F.struct(blank_to_null(size).try_cast("bigint").alias("width"), url.alias("url"))

    items = F.filter(
        F.transform(F.split(filled_attr(img, "srcset"), ","), strip), lambda i: F.contains(i, F.lit(" "))
    )
    nothing = F.struct(F.lit(0).cast("bigint").alias("width"), F.lit(None).cast("string").alias("url"))
    widest = F.aggregate(
        F.transform(items, entry),
        nothing,
        lambda best, e: F.when(F.coalesce(e["width"], F.lit(0)) > best["width"], e).otherwise(best),
    )
    return F.coalesce(
        blank_to_null(widest["url"]),
        filled_attr(img, "data-src"),
        U.strip_size_suffix(filled_attr(img, "src")),
    )


def _absolute(base: Column, link: Column) -> Column:
    return F.when(F.startswith(link, F.lit("http")), link).otherwise(U.resolve_url(base, link))


def distinct_urls(base: Column, candidates: Column) -> Column:
    """Make absolute, keep the first of equal URLs, in order."""
    filled = F.filter(candidates, lambda c: c.isNotNull() & (c != ""))
    return F.array_distinct(F.transform(filled, lambda c: _absolute(base, c)))


def forum_images(nodes: Column, base: Column, found: Column, formats=None) -> Column:
    """E12 for threads: candidates of the matched elements that look like images."""
    urls = distinct_urls(base, F.transform(found, forum_image_candidate))
    return F.filter(urls, lambda u: U.is_image_url(u, formats))


def matches(nodes: Column, rule: Rule | Column, scope: Column | None = None) -> Column:
    """The elements of a rule that is fixed or comes from a column."""
    return find_all(nodes, rule, scope) if isinstance(rule, list) else dom.find_all_by(nodes, rule, scope)


def first_match(nodes: Column, rule: Rule | Column, scope: Column | None = None) -> Column:
    return F.get(matches(nodes, rule, scope), F.lit(0))


def thread_entries(nodes: Column, base: Column, list_rule: Rule | Column, link_rule: Rule | Column) -> Column:
    """(title, thread_url) of every list element with a usable link, in order; rules are fixed or from a column."""

    def row(item: Column) -> Column:
        return let(
            first_match(nodes, link_rule, subtree(nodes, item)),
            lambda link: F.struct(
                text_of(nodes, link).alias("title"),
                U.resolve_url(base, filled_attr(link, "href")).alias("thread_url"),
            ),
        )

    return F.filter(F.transform(matches(nodes, list_rule), row), lambda r: r["thread_url"].isNotNull())


def thread_list(parsed: DataFrame, list_rule: Rule | Column, link_rule: Rule | Column, *keys: str) -> DataFrame:
    """One row per list element with a usable link."""
    items = thread_entries(_nodes(), F.col("url"), list_rule, link_rule)
    return (
        parsed.select(*keys, F.posexplode(items).alias("pos", "t"))
        .select(*keys, (F.col("pos") + 1).alias("pos"), "t.title", "t.thread_url")
        .withColumn("thread_id", U.thread_id(F.col("thread_url")))
    )


def first_text(nodes: Column, rule: Rule | Column, scope: Column | None = None, separator: str = "") -> Column:
    """Text of the first match; NULL when nothing matches."""
    return let(
        first_match(nodes, rule, scope),
        lambda e: F.when(e["lo"].isNotNull(), text_of(nodes, e, separator)),
    )


def thread_metadata(
    nodes: Column,
    author: Rule = AUTHOR_RULE,
    time: Rule = TIME_RULE,
    views: Rule = VIEWS_RULE,
    replies: Rule = REPLIES_RULE,
) -> Column:
    """Author, time, views and replies; a missing field stays NULL."""

    def number(rule: Rule) -> Column:
        return let(first_text(nodes, rule), lambda t: F.when(t.isNotNull(), number_from_text(t)))

    return F.struct(
        first_text(nodes, author).alias("author"),
        first_text(nodes, time).alias("post_time"),
        number(views).alias("views"),
        number(replies).alias("replies"),
    )


def thread_content(nodes: Column, rule: Rule = THREAD_CONTENT_RULE) -> Column:
    """E5: texts of the first content container, one per line."""
    return F.coalesce(first_text(nodes, rule, separator="\n"), F.lit(""))


def thread_detail(parsed: DataFrame, image_rule: Rule | Column, *keys: str) -> DataFrame:
    """One row per thread page."""
    nodes, url = _nodes(), F.col("url")
    found = matches(nodes, image_rule)
    return parsed.where(F.col("nodes").isNotNull()).select(
        *keys,
        url.alias("thread_url"),
        U.thread_id(url).alias("thread_id"),
        forum_images(nodes, url, found).alias("images"),
        thread_metadata(nodes).alias("metadata"),
        thread_content(nodes).alias("content"),
    ).withColumn("image_count", F.size("images"))


def next_page(nodes: Column, url: Column, rule: Rule | Column) -> Column:
    """The resolved link of the first match, else NULL."""
    return let(first_match(nodes, rule), lambda e: U.resolve_url(url, filled_attr(e, "href")))


def article_link(nodes: Column, article: Column, title: Column, link_rule: Rule | Column) -> Column:
    """The link of a list entry, trying the safest place first."""
    def is_file(href: Column) -> Column:
        return U.contains_any(F.lower(href), FILE_LINK_MARKS)

    in_title = filled_attr(find_first(nodes, ANY_LINK, subtree(nodes, title)), "href")
    by_rule = filled_attr(first_match(nodes, link_rule, subtree(nodes, article)), "href")
    hrefs = F.filter(
        F.transform(find_all(nodes, ANY_LINK, subtree(nodes, article)), lambda e: dom.attr(e, "href")),
        lambda h: ~is_file(h),
    )
    with_digit = lambda hs: F.get(F.filter(hs, lambda h: F.regexp_like(h, F.lit(r"\p{Nd}"))), F.lit(0))
    return F.coalesce(
        F.when(title["lo"].isNotNull(), in_title),
        let(by_rule, lambda h: F.when(~is_file(h), h)),
        let(hrefs, lambda hs: F.coalesce(with_digit(hs), blank_to_null(F.get(hs, F.lit(0))))),
    )


def article_entries(nodes: Column, site_base: Column, rules: dict[str, Rule | Column] | None = None) -> Column:
    """The entries of a news list page; those without title or link are dropped.

    Rules are fixed, or columns of steps where every site has its own (``sources.rules.with_news_rules``).
    """
    rules = {**ARTICLE_RULES, **(rules or {})}

    def row(article: Column) -> Column:
        scope = subtree(nodes, article)
        return let(
            first_match(nodes, rules["title"], scope),
            lambda title: F.struct(
                F.when(title["lo"].isNotNull(), text_of(nodes, title)).alias("title"),
                F.coalesce(first_text(nodes, rules["author"], scope), F.lit(UNKNOWN_AUTHOR)).alias("author"),
                first_text(nodes, rules["date"], scope).alias("date"),
                F.coalesce(first_text(nodes, rules["summary"], scope), F.lit("")).alias("summary"),
                article_link(nodes, article, title, rules["link"]).alias("link"),
            ),
        )

    def finished(r: Column) -> Column:
        return F.struct(
            U.article_id(r["link"]).alias("article_id"),
            r["title"].alias("title"), r["author"].alias("author"), r["date"].alias("date"),
            r["summary"].alias("summary"),
            U.absolute_article_url(site_base, r["link"]).alias("article_url"),
        )

    rows = F.filter(
        F.transform(matches(nodes, rules["article"]), row),
        lambda r: r["link"].isNotNull() & (r["title"] != ""),
    )
    return F.transform(rows, finished)


def article_list(parsed: DataFrame, *keys: str, site_base: Column, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row per news list entry."""
    entries = article_entries(_nodes(), site_base, rules)
    return parsed.select(*keys, F.posexplode(entries).alias("pos", "a")).select(
        *keys, (F.col("pos") + 1).alias("pos"), "a.*"
    )


def article_detail(parsed: DataFrame, *keys: str, places: list[Rule] | None = None) -> DataFrame:
    """Text and images of the best content container, else of the whole body."""
    nodes, url = _nodes(), F.col("url")
    places = ARTICLE_CONTENT_PLACES if places is None else places
    container = F.coalesce(*[find_first(nodes, p) for p in places], find_first(nodes, one("body")))

    def detail(box: Column) -> Column:
        inside = subtree(nodes, box)
        linked = F.filter(
            F.transform(find_all(nodes, one("a"), inside), lambda a: filled_attr(a, "href")), U.has_image_mark
        )
        shown = F.transform(find_all(nodes, one("img"), inside), news_image_candidate)
        return F.struct(
            F.coalesce(text_of(nodes, box), F.lit("")).alias("content"),
            F.coalesce(
                let(linked, lambda l: distinct_urls(url, F.when(F.size(l) > 0, l).otherwise(shown))),
                F.array().cast("array<string>"),
            ).alias("images"),
        )

    return (
        parsed.where(nodes.isNotNull())
        .select(*keys, url.alias("article_url"), let(container, detail).alias("d"))
        .select(*keys, U.article_id(F.col("article_url")).alias("article_id"), "article_url", "d.content", "d.images")
    )


def has_load_more(nodes: Column) -> Column:
    """A load-more element, or one of the words in any text or comment."""
    texts = F.exists(
        nodes,
        lambda n: n["tag"].isin(TEXT, RAW, COMMENT, DOCTYPE)
        & U.contains_any(F.lower(n["text"]), LOAD_MORE_WORDS),
    )
    return (F.size(find_all(nodes, LOAD_MORE_RULE)) > 0) | texts


def next_page_number(nodes: Column) -> Column:
    """``data-page`` of the first element that has it; NULL when not a number."""
    first = find_first(nodes, one(attrs=[("data-page", "has", None)]))
    return strip(dom.attr(first, "data-page")).try_cast("int")
