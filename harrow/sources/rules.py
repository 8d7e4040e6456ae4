"""Site rules, crawl targets, presets and forum types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.functions.selectors import selector_steps, unsupported_selector
from harrow.functions.text import blank_to_null
from harrow.operators.skew import lookup

TEMPLATE_FILES = ["example.json", "template.json"]

_SELECTORS = "struct<thread_list:string,thread_link:string,image:string,next_page:string>"
_CRAWLER = (
    "struct<max_concurrent_requests:int,download_delay:double,request_timeout:int,use_adaptive_queue:boolean,"
    "queue_size:int,use_proxy:boolean,rotate_user_agent:boolean>"
)
_IMAGE = (
    "struct<min_width:int,min_height:int,min_size:bigint,max_size:bigint,allowed_formats:array<string>,"
    "enable_deduplication:boolean>"
)
# Entries of the url lists are strings or objects; both arrive as text.
SITE_FILE = (
    "name string, crawler_type string, forum_type string, base_url string, login_url string, "
    f"selectors {_SELECTORS}, crawler {_CRAWLER}, image {_IMAGE}, urls array<string>, news_urls array<string>, "
    "example_threads array<string>, boards array<struct<name:string,url:string>>"
)
TARGET = "struct<type:string,name:string,url:string>"


def read_site_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every settings file of a folder, one row each; ``is_good`` tells whether it could be read."""
    text = F.col("value")
    is_object = F.try_parse_json(text).isNotNull() & F.startswith(F.trim(text), F.lit("{"))
    return (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
        .select("value", F.col("_metadata.file_name").alias("file"))
        .where(~F.col("file").isin(TEMPLATE_FILES))
        .select(
            "file",
            F.regexp_replace("file", r"\.json$", "").alias("site"),
            is_object.alias("is_good"),
            "value",
        )
    )


def good_files(files: DataFrame) -> DataFrame:
    """The settings of the files that could be read."""
    settings = F.from_json("value", SITE_FILE)
    return files.where("is_good").select("site", settings.alias("s")).select("site", "s.*")


def bad_files(files: DataFrame) -> DataFrame:
    """The files that are skipped."""
    return files.where("NOT is_good").select("file", "value")


def _target(entry: Column) -> Column:
    """An entry of a url list: an object written as JSON, or a bare URL."""
    is_object = F.startswith(F.trim(entry), F.lit("{"))
    bare = F.struct(
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("name"), entry.alias("url")
    )
    return F.struct(
        is_object.alias("is_object"),
        F.when(is_object, F.from_json(entry, TARGET)).otherwise(bare).alias("t"),
    )


def site_rules(files: DataFrame) -> DataFrame:
    """One normalised row per site with a single list of targets."""
    kind = F.coalesce(
        blank_to_null(F.col("crawler_type")),
        F.when(F.col("forum_type") == "news", "news").otherwise("bbs"),
    )
    kind = F.when(kind.isin("bbs", "news"), kind).otherwise("bbs")
    empty = F.array().cast("array<string>")
    listed = F.transform(F.coalesce("urls", "news_urls", "example_threads", empty), _target)
    is_board = lambda e: e["is_object"] & (e["t"]["type"] == "board")
    legacy = F.transform(
        F.col("boards"),
        lambda b: F.struct(F.lit("board").alias("type"), b["name"].alias("name"), b["url"].alias("url")),
    )
    prepend = (
        (F.col("crawler_type") == "bbs")
        & F.coalesce(F.size("boards") > 0, F.lit(False))
        & ~F.coalesce(F.exists("_listed", is_board), F.lit(False))
    )
    plain = F.transform(F.filter("_listed", lambda e: ~e["is_object"]), lambda e: e["t"])
    objects = F.transform(F.filter("_listed", lambda e: e["is_object"]), lambda e: e["t"])
    in_order = F.transform("_listed", lambda e: e["t"])
    selectors = F.col("selectors")
    return (
        files.withColumn("crawler_type", kind)
        .withColumn("_listed", listed)
        .select(
            "site",
            F.coalesce("name", F.lit("Unknown Forum")).alias("name"),
            "crawler_type",
            F.coalesce("forum_type", F.lit("custom")).alias("forum_type"),
            F.coalesce("base_url", F.lit("")).alias("base_url"),
            "login_url",
            *[
                F.coalesce(selectors[c], F.lit("")).alias(f"{c}_selector")
                for c in ("thread_list", "thread_link", "image", "next_page")
            ],
            "crawler",
            "image",
            F.when(prepend, F.concat(legacy, plain, objects)).otherwise(in_order).alias("targets"),
            F.coalesce(legacy, F.array().cast("array<struct<type:string,name:string,url:string>>")).alias("legacy_boards"),
        )
    )


def targets(rules: DataFrame) -> DataFrame:
    """One row per target of a site, in order."""
    return rules.select("site", F.posexplode("targets").alias("pos", "t")).select("site", "pos", "t.*")


def boards(rules: DataFrame) -> DataFrame:
    """The boards to crawl: a site's board targets or, where it has none, the boards of its older setting."""
    is_board = lambda t: (t["type"] == "board") & (t["url"] != "")
    listed = F.filter("targets", is_board)
    older = rules["legacy_boards"] if "legacy_boards" in rules.columns else F.filter("targets", lambda _: F.lit(False))
    none = rules.where(F.size(listed) == 0).select("site", F.posexplode(older).alias("pos", "t")).select("site", "pos", "t.*").where("url <> ''")
    some = targets(rules).where((F.col("type") == "board") & (F.col("url") != ""))
    return some.select("site", "pos", "name", "url").unionByName(none.select("site", "pos", "name", "url"))


def page_entries(rules: DataFrame) -> DataFrame:
    """Single pages to crawl, with their name when they have one."""
    other = F.coalesce(F.col("type") != "board", F.lit(True))
    return targets(rules).where(other & (F.col("url") != "")).select("site", "pos", "name", "url")


def entry_urls(rules: DataFrame) -> DataFrame:
    """The URLs of all targets."""
    return targets(rules).where(F.col("url") != "").select("site", "pos", "url")


# What is known about the common forum systems.
PRESETS = [
    {
        "forum_type": "discuz",
        "name": "Discuz",
        "thread_list_selector": "tbody[id^='normalthread'], tbody[id^='stickthread']",
        "thread_link_selector": "a.s.xst, a.xst",
        "image_selector": "img.zoom,img[file],img[aid],div.pattl img,div.pcb img",
        "next_page_selector": "a.nxt, div.pg a.nxt",
        "max_concurrent_requests": 3,
        "download_delay": 2.0,
        "min_width": 300,
        "min_height": 300,
        "min_size": 30000,
    },
    {
        "forum_type": "phpbb",
        "name": "phpBB",
        "thread_list_selector": "li.row",
        "thread_link_selector": "a.topictitle",
        "image_selector": "dl.attachbox img, div.content img",
        "next_page_selector": "a.next",
    },
    {
        "forum_type": "vbulletin",
        "name": "vBulletin",
        "thread_list_selector": "li.threadbit",
        "thread_link_selector": "a.title",
        "image_selector": "div.content img, img.attachment",
        "next_page_selector": "a[rel='next']",
    },
]
# Settings a site has when nothing says otherwise.
DEFAULTS = {
    "thread_list_selector": "div.thread-item",
    "thread_link_selector": "a.thread-link",
    "image_selector": "img.post-image, img[src*='jpg'], img[src*='png']",
    "next_page_selector": "a.next-page",
    "max_concurrent_requests": 5,
    "download_delay": 1.0,
    "min_width": 200,
    "min_height": 200,
    "min_size": 10240,
}
_PRESET_SCHEMA = (
    "forum_type string, name string, thread_list_selector string, thread_link_selector string, "
    "image_selector string, next_page_selector string, max_concurrent_requests int, download_delay double, "
    "min_width int, min_height int, min_size int"
)


def forum_presets(spark: SparkSession) -> DataFrame:
    """One row per known forum system."""
    names = [f.split()[0] for f in _PRESET_SCHEMA.split(", ")]
    rows = [tuple({**DEFAULTS, **p}.get(n) for n in names) for p in PRESETS]
    types = [f.split()[1] for f in _PRESET_SCHEMA.split(", ")]
    literal = [F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, types, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*literal)).alias("p")).select("p.*")


def with_presets(sites: DataFrame) -> DataFrame:
    """The settings of each site's forum system; unknown systems get the defaults.

    The preset table has one row per forum system known to this module, so it
    can be broadcast whatever the number of sites.
    """
    presets = forum_presets(sites.sparkSession).drop("name")
    values = [c for c in presets.columns if c != "forum_type"]
    joined = sites.withColumn("forum_type", F.lower("forum_type")).join(F.broadcast(presets), "forum_type", "left")
    return joined.select(*sites.columns, *[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) for c in values])


# Pages of a host that one task joins with very many rules; pages are wide.
HOT_PAGES = 4096
SELECTOR_COLUMNS = ["thread_list_selector", "thread_link_selector", "image_selector", "next_page_selector"]


def bad_selectors(rules: DataFrame) -> DataFrame:
    """Selectors that cannot be used, with the reason; a site listed here would find nothing by them."""
    every = F.array(*[F.struct(F.lit(c).alias("setting"), F.col(c).alias("selector")) for c in SELECTOR_COLUMNS])
    return (
        rules.select("site", F.explode(every).alias("s")).select("site", "s.*")
        .withColumn("reason", unsupported_selector(F.col("selector"))).where("reason IS NOT NULL")
    )


def one_per_host(rules: DataFrame) -> DataFrame:
    """The first site, by name, of every host; two settings files of a host must not double its pages."""
    host = U.site_key(F.col("base_url"))
    named = "site" if "site" in rules.columns else "base_url"
    firsts = rules.groupBy(host.alias("_host")).agg(F.min_by(F.struct(*rules.columns), F.struct(named, "base_url")).alias("_r"))
    return firsts.select("_r.*")


def repeated_hosts(rules: DataFrame) -> DataFrame:
    """Hosts with more than one settings file, and the sites that share it."""
    return rules.groupBy(U.site_key(F.col("base_url")).alias("host")).agg(
        F.array_sort(F.collect_list("site")).alias("sites")).where(F.size("sites") > 1)


def with_site_rules(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Attach to every page the rules of its site as structured steps.

    Done before the pages are parsed. Few rules are broadcast and the pages stay
    where they are; with very many, the pages of a hot host are spread by id.
    """
    steps = one_per_host(rules).select(
        U.site_key(F.col("base_url")).alias("host"),
        "forum_type",
        "base_url",
        *[selector_steps(F.col(c)).alias(c.replace("_selector", "_rule")) for c in SELECTOR_COLUMNS],
    )
    return lookup(pages.withColumn("host", U.host(F.col(url))), steps, "host", page_id, HOT_PAGES)


# The selectors of a news list that a site does not set.
NEWS_SELECTORS = {
    "article": ".article", "title": ".title", "author": ".author", "date": ".date", "summary": ".body", "link": "a[href]",
}


def with_news_rules(pages: DataFrame, rules: DataFrame, site: str = "site", page_id: str = "page_id") -> DataFrame:
    """J5 for news lists: attach the selectors of each page's site as steps, ``<name>_rule`` for each of ``NEWS_SELECTORS``.

    ``rules`` has the site and any of ``<name>_selector``; what is absent, NULL or
    blank, for a site or for all, is the usual selector. Of several rows of a site
    the smallest counts.
    """
    given = [n for n in NEWS_SELECTORS if f"{n}_selector" in rules.columns]
    if given:
        one = rules.groupBy(site).agg(F.min(F.struct(*[f"{n}_selector" for n in given])).alias("_r")).select(site, "_r.*")
        pages = lookup(pages, one, site, page_id, HOT_PAGES)
    steps = {
        f"{n}_rule": selector_steps(F.coalesce(blank_to_null(F.trim(f"{n}_selector")), F.lit(usual)) if n in given else F.lit(usual))
        for n, usual in NEWS_SELECTORS.items()
    }
    return pages.withColumns(steps).drop(*[f"{n}_selector" for n in given])


def news_rule_columns() -> dict[str, Column]:
    """The columns of ``with_news_rules`` as rules for ``extract.article_entries``."""
    return {n: F.col(f"{n}_rule") for n in NEWS_SELECTORS}


ImageHook = Callable[[Column, Column], Column]
_image_hooks: dict[str, ImageHook] = {}


def register_forum(forum_type: str, image_hook: ImageHook) -> None:
    """Give a forum type its own rewrite of image URLs: (url, base_url) -> url."""
    _image_hooks[forum_type.lower()] = image_hook


register_forum("discuz", U.full_size_attachment)


def _with_base(hook: ImageHook, site_base: Column) -> Callable[[Column], Column]:
    return lambda url: hook(url, site_base)


def process_images(images: Column, forum_type: Column, site_base: Column) -> Column:
    """Rewrite image URLs by forum type; types without a hook keep theirs."""
    out = images
    for name, hook in _image_hooks.items():
        rewritten = F.transform(images, _with_base(hook, site_base))
        out = F.when(F.lower(forum_type) == name, rewritten).otherwise(out)
    return out


def sites_to_crawl(
    configured: DataFrame | None = None, preset: DataFrame | None = None, detected: DataFrame | None = None
) -> DataFrame:
    """The site rules to use; given rules win over a preset, a preset over detection."""
    for choice in (configured, preset, detected):
        if choice is not None:
            return choice
    raise ValueError("give configured rules, a preset or detected rules")


def rules_by_precedence(configured: DataFrame, preset: DataFrame, detected: DataFrame, key: str = "site") -> DataFrame:
    """X2 for every site: given rules win over a preset, a preset over detection."""
    ranked = configured.withColumn("_place", F.lit(0))
    for place, more in enumerate((preset, detected), 1):
        ranked = ranked.unionByName(more.withColumn("_place", F.lit(place)), allowMissingColumns=True)
    values = [c for c in ranked.columns if c not in (key, "_place")]
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*values), "_place").alias("_r"))
    return best.select(key, "_r.*")
