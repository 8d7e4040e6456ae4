"""Guess the extraction rules of unknown sites.

A page is judged inside its own row (no shuffle); sites are judged by partially
aggregated votes over their pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.functions.selectors import class_selector, id_selector, link_selector, selector_steps
from harrow.functions.text import let
from harrow.operators import dom
from harrow.operators.dom import attr, filled_attr, find_all, find_all_by, step, subtree, text_of

# Marks of the forum systems, in the order they are tested.
FORUM_MARKS = ["discuz", "phpbb", "vbulletin"]
OTHER_FORUM = "custom"
LIST_CLASS_WORDS = ["thread", "topic", "post-item", "list-item"]
LIST_ID_WORDS = ["thread", "topic"]
LIST_PRESETS = {
    "discuz": (
        "tbody[id^='normalthread'], tbody[id^='stickthread']",
        [[step("tbody", attrs=[("id", "^=", "normalthread")])], [step("tbody", attrs=[("id", "^=", "stickthread")])]],
    ),
    "phpbb": ("li.row", [[step("li", "row")]]),
}
MIN_ITEMS, MAX_ITEMS, ITEMS_PER_PAGE = 5, 50, 20
TOP_PATTERNS = 10
NOT_CONTENT_WORDS = ["avatar", "icon", "logo", "banner", "smilie", "emoji"]
IMAGE_EXTENSION = r"(?i)\.(jpg|jpeg|png|gif|webp|bmp)"
IMAGE_PLACES = {
    "div.content img": [[step("div", "content"), step("img")]],
    "div.post-content img": [[step("div", "post-content"), step("img")]],
    "div.message img": [[step("div", "message"), step("img")]],
    "article img": [[step("article"), step("img")]],
    "div.postcontent img": [[step("div", "postcontent"), step("img")]],
    "div.t_fsz img": [[step("div", "t_fsz"), step("img")]],
    "img.zoom": [[step("img", "zoom")]],
    "img[file]": [[step("img", attrs=[("file", "has", None)])]],
}
NEXT_WORDS = ["下一页", "下一頁", "next", "next page", "›", "»", "&gt;"]
NEXT_PLACES = {
    "a.next": [[step("a", "next")]],
    "a.nxt": [[step("a", "nxt")]],
    "a.next-page": [[step("a", "next-page")]],
    "a[rel='next']": [[step("a", attrs=[("rel", "=", "next")])]],
    "li.next a": [[step("li", "next"), step("a")]],
    "div.pagination a.next": [[step("div", "pagination"), step("a", "next")]],
}
GOOD_CONFIDENCE = 0.7

CANDIDATE = "struct<selector:string,confidence:double>"


def candidate(selector: Column | str, confidence: Column | float) -> Column:
    selector = F.lit(selector) if isinstance(selector, str) else selector
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(selector.alias("selector"), confidence.cast("double").alias("confidence"))


def best_candidate(candidates: Column, default: Column) -> Column:
    """Highest confidence, the first one on ties; NULL entries are no candidates."""
    real = F.filter(candidates, lambda c: c["confidence"].isNotNull())
    best = F.aggregate(
        real,
        F.lit(None).cast(CANDIDATE),
        lambda a, c: F.when(F.coalesce(c["confidence"] > a["confidence"], F.lit(True)), c).otherwise(a),
    )
    return F.coalesce(best, default)


def share(n: Column, of: int) -> Column:
    return F.least(F.lit(1.0), n / F.lit(of))


def by_count(nodes: Column, text: str, rule: list, full: int) -> Column:
    """A candidate that is the surer the more elements it matches; NULL when none."""
    return let(F.size(find_all(nodes, rule)), lambda n: F.when(n > 0, candidate(text, share(n, full))))


def forum_type(html: Column) -> Column:
    """The first system named anywhere in the page."""
    low = F.lower(html)
    out = F.when(F.contains(low, F.lit(FORUM_MARKS[0])), FORUM_MARKS[0])
    for mark in FORUM_MARKS[1:]:
        out = out.when(F.contains(low, F.lit(mark)), mark)
    return out.otherwise(OTHER_FORUM)


def list_confidence(lengths: Column) -> Column:
    """Trust by number of items times the share of items as long as the first."""

    def trust(lens: Column) -> Column:
        n, first = F.size(lens), F.get(lens, F.lit(0))
        base = (
            F.when((n >= 10) & (n <= 30), 0.9).when((n >= 5) & (n < 10), 0.7).when(n > 30, 0.6).otherwise(0.4)
        )
        alike = F.size(F.filter(lens, lambda x: (x >= first - 100) & (x < first + 100)))
        return F.when(n > 0, base * (alike / n)).otherwise(F.lit(0.0))

    return let(lengths, trust)


def ranked_values(values: Column) -> Column:
    """Distinct values of an array as (minus_n, first, value), most frequent first,
    first met first on ties.

    Values are sorted and counted by the lengths of their runs, so the work is
    n log n whatever the number of distinct values.
    """
    occurrences = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("place"))))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["value"] != x["value"]), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda begin: F.transform(
                begin,
                lambda i, k: F.struct(
                    (i - F.coalesce(F.get(begin, k + 1), F.size(s))).alias("minus_n"),
                    F.get(s, i)["place"].alias("first"),
                    F.get(s, i)["value"].alias("value"),
                ),
            ),
        )

    return F.array_sort(let(occurrences, runs))


def page_patterns(nodes: Column) -> Column:
    """A9/T1 for one page: its ten most frequent (tag, classes) that occur five times."""
    marked = F.filter(nodes, lambda e: F.size(e["classes"]) > 0)
    ranked = ranked_values(
        F.transform(marked, lambda e: F.struct(e["tag"].alias("tag"), e["classes"].alias("classes")))
    )
    return F.transform(
        F.filter(F.slice(ranked, 1, TOP_PATTERNS), lambda p: p["minus_n"] <= -MIN_ITEMS),
        lambda p: F.struct(
            p["value"]["tag"].alias("tag"), p["value"]["classes"].alias("classes"), (-p["minus_n"]).alias("n")
        ),
    )


def list_candidate(nodes: Column, system: Column) -> Column:
    """The selector of the repeated list items of a page."""
    def usual(n: Column) -> Column:
        return (n >= MIN_ITEMS) & (n <= MAX_ITEMS)

    def by_word(found: Column, name: Callable[[Column], Column]) -> Column:
        def judge(es: Column) -> Column:
            trust = list_confidence(F.transform(es, lambda e: e["length"]))
            return F.when(usual(F.size(es)), candidate(name(F.get(es, F.lit(0))), trust))

        return let(found, judge)

    def class_hits(word: str) -> Column:
        return F.filter(nodes, lambda e: F.contains(F.lower(F.array_join(e["classes"], " ")), F.lit(word)))

    def id_hits(word: str) -> Column:
        return F.filter(nodes, lambda e: F.contains(F.lower(attr(e, "id")), F.lit(word)))

    named = [by_word(class_hits(w), class_selector) for w in LIST_CLASS_WORDS]
    named += [by_word(id_hits(w), lambda e: id_selector(e["tag"], attr(e, "id"))) for w in LIST_ID_WORDS]
    repeated = F.transform(
        F.filter(page_patterns(nodes), lambda p: usual(p["n"])),
        lambda p: candidate(F.concat_ws(".", p["tag"], F.get(p["classes"], F.lit(0))), share(p["n"], ITEMS_PER_PAGE)),
    )
    generic = best_candidate(F.concat(F.array(*named), repeated), candidate("", 0.0))
    preset = F.lit(None).cast(CANDIDATE)
    for name, (text, rule) in LIST_PRESETS.items():
        preset = F.when(system == name, by_count(nodes, text, rule, ITEMS_PER_PAGE)).otherwise(preset)
    return F.coalesce(preset, generic)


def link_candidate(nodes: Column, list_selector: Column) -> Column:
    """The selector of the thread link inside the first list item."""
    any_link = [[step("a", attrs=[("href", "has", None)])]]
    # Without a list rule the whole document is the list item.
    root = F.get(F.filter(nodes, lambda e: e["tag"] == "html"), F.lit(0))
    document = F.struct(F.lit(-1).alias("lo"), (F.size(nodes) - 1).alias("hi"), root["classes"].alias("classes"))
    first = let(selector_steps(list_selector), lambda rule: F.get(find_all_by(nodes, rule), F.lit(0)))
    matched = let(first, lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), e["classes"].alias("classes")))
    item = F.when(list_selector != "", matched).when(F.size(nodes) > 0, document)

    def judge(box: Column) -> Column:
        def by_length(links: Column) -> Column:
            """Longest text; on ties the link that comes first."""
            longest = F.aggregate(
                F.transform(links, lambda a: F.struct(F.length(text_of(nodes, a)).alias("n"), a["classes"].alias("classes"))),
                F.lit(None).cast("struct<n:int,classes:array<string>>"),
                lambda best, x: F.when(F.coalesce(x["n"] > best["n"], F.lit(True)), x).otherwise(best),
            )
            return let(longest, lambda x: candidate(link_selector(x["classes"], box["classes"]), 0.6))

        def pick(links: Column) -> Column:
            good = F.get(F.filter(links, lambda a: U.is_thread_link(attr(a, "href"))), F.lit(0))
            named = let(
                good, lambda a: F.when(a["lo"].isNotNull(), candidate(link_selector(a["classes"], box["classes"]), 0.9))
            )
            return F.coalesce(named, F.when(F.size(links) > 0, by_length(links)), candidate("a", 0.3))

        return F.when(box["lo"].isNull(), candidate("", 0.0)).otherwise(
            let(find_all(nodes, any_link, subtree(nodes, box)), pick)
        )

    return let(item, judge)


def is_content_image(img: Column) -> Column:
    """no avatar, icon or logo, and not smaller than 100 where a size is given.

    A width that is no number also keeps the height from being looked at.
    """
    def small(name: str) -> Column:
        return F.coalesce(filled_attr(img, name).try_cast("int") < 100, F.lit(False))

    width = filled_attr(img, "width")
    readable = width.isNull() | width.try_cast("int").isNotNull()
    decorative = U.contains_any(F.lower(F.coalesce(attr(img, "src"), F.lit(""))), NOT_CONTENT_WORDS)
    return ~(decorative | small("width") | (readable & small("height")))


def common_image_class(nodes: Column) -> Column:
    """A10 for one page: the most frequent class of its content images, first met on ties."""
    images = F.filter(nodes, lambda e: (e["tag"] == "img") & is_content_image(e))
    names = F.flatten(F.transform(images, lambda e: e["classes"]))
    return F.get(ranked_values(names), F.lit(0))["value"]


def image_class_counts(parsed: DataFrame, *unit: str) -> DataFrame:
    """A10 for any unit: the most frequent class of content images."""
    images = dom.elements(parsed, *unit, "page_id").where(F.col("tag") == "img").select(
        *unit, "page_id", "lo", F.struct("attrs").alias("img"), "classes"
    )
    return (
        images.where(is_content_image(F.col("img")))
        .select(*unit, "page_id", "lo", F.posexplode("classes").alias("i", "class"))
        .groupBy(*unit, "class")
        .agg(F.count("*").alias("n"), F.min(F.struct("page_id", "lo", "i")).alias("first"))
        .groupBy(*unit)
        .agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "class")).alias("b"))
        .select(*unit, F.col("b.class").alias("class"), (-F.col("b.m")).alias("n"))
    )


def image_candidate(nodes: Column) -> Column:
    """P5: the selector of the content images."""
    n_content = F.size(F.filter(nodes, lambda e: (e["tag"] == "img") & is_content_image(e)))
    by_class = let(
        common_image_class(nodes),
        lambda c: F.when(c.isNotNull(), candidate(F.concat(F.lit("img."), c), share(n_content, 10))),
    )
    by_place = [by_count(nodes, text, rule, 5) for text, rule in IMAGE_PLACES.items()]
    has_file = F.exists(
        nodes,
        lambda e: F.coalesce(
            (e["tag"] == "img") & F.regexp_like(attr(e, "src"), F.lit(IMAGE_EXTENSION)), F.lit(False)
        ),
    )
    fallback = F.when(has_file, candidate("img[src]", 0.5)).otherwise(candidate("img", 0.3))
    return best_candidate(F.array(by_class, *by_place), fallback)


def next_candidate(nodes: Column) -> Column:
    """The selector of the link to the next page."""
    links = find_all(nodes, [[step("a", attrs=[("href", "has", None)])]])
    worded = F.get(
        F.filter(links, lambda a: U.contains_any(F.lower(text_of(nodes, a)), NEXT_WORDS)), F.lit(0)
    )
    by_word = let(worded, lambda a: F.when(a["lo"].isNotNull(), candidate(link_selector(a["classes"]), 0.9)))
    by_place = F.coalesce(
        *[F.when(F.size(find_all(nodes, rule)) > 0, candidate(text, 0.8)) for text, rule in NEXT_PLACES.items()]
    )
    return F.coalesce(by_word, by_place, candidate("", 0.0))


def page_profiles(parsed: DataFrame, *keys: str, system: str = "forum_type") -> DataFrame:
    """The guessed rules of every page; ``system`` names the column with P1."""
    nodes = F.col("nodes")
    lists = parsed.where(nodes.isNotNull()).withColumn("thread_list", list_candidate(nodes, F.col(system)))
    judged = lists.select(
        *keys,
        F.col(system).alias("forum_type"),
        "thread_list",
        link_candidate(nodes, F.col("thread_list.selector")).alias("thread_link"),
        image_candidate(nodes).alias("image"),
        next_candidate(nodes).alias("next_page"),
    )
    return _with_overall(judged)


def _with_overall(judged: DataFrame) -> DataFrame:
    parts = ["thread_list", "thread_link", "image", "next_page"]
    total = F.col(f"{parts[0]}.confidence")
    for p in parts[1:]:
        total = total + F.col(f"{p}.confidence")
    overall = total / 4
    return judged.withColumn("overall", overall).withColumn(
        "status", F.when(F.col("overall") >= GOOD_CONFIDENCE, "success").otherwise("uncertain")
    )


def site_profiles(profiles: DataFrame, site: str = "site") -> DataFrame:
    """P7 per site: the forum system of most pages and, for each rule, the selector
    with the highest total confidence over the site's pages (its mean is reported).

    Every step is a partially aggregated count, so a huge site is no hot spot.
    """
    names = ["thread_list", "thread_link", "image", "next_page"]
    votes = F.array(
        F.struct(F.lit("forum_type").alias("rule"), F.col("forum_type").alias("selector"), F.lit(1.0).alias("confidence")),
        *[
            F.struct(
                F.lit(n).alias("rule"),
                F.col(f"{n}.selector").alias("selector"),
                F.col(f"{n}.confidence").alias("confidence"),
            )
            for n in names
        ],
    )
    best = (
        profiles.select(site, F.explode(votes).alias("v"))
        .groupBy(site, "v.rule", "v.selector")
        .agg(F.sum("v.confidence").alias("weight"), F.count("*").alias("pages"))
        .groupBy(site, "rule")
        .agg(
            F.min(F.struct((-F.round("weight", 9)).alias("w"), "selector", "weight", "pages")).alias("b"),
            F.sum("pages").alias("all_pages"),
        )
        .groupBy(site)
        .agg(
            F.max("all_pages").alias("n_pages"),
            F.max(F.when(F.col("rule") == "forum_type", F.col("b.selector"))).alias("forum_type"),
            *[
                F.max(
                    F.when(
                        F.col("rule") == n,
                        candidate(F.col("b.selector"), F.col("b.weight") / F.col("b.pages")),
                    )
                ).alias(n)
                for n in names
            ],
        )
    )
    return _with_overall(best)


def detected_rules(site_profile: DataFrame, base: Column, site: str = "site") -> DataFrame:
    """A profile in the shape of ``sources.rules.site_rules`` rows."""
    return site_profile.select(
        F.col(site).alias("site"),
        F.concat(F.lit("Auto-"), F.col("forum_type")).alias("name"),
        F.lit("bbs").alias("crawler_type"),
        "forum_type",
        base.alias("base_url"),
        *[F.col(f"{n}.selector").alias(f"{n}_selector") for n in ("thread_list", "thread_link", "image", "next_page")],
    )


def pattern_counts(parsed: DataFrame, *unit: str) -> DataFrame:
    """Occurrences of every (tag, classes) per unit and where it was met first."""
    return (
        dom.elements(parsed, *dict.fromkeys([*unit, "page_id"]))
        .where(F.size("classes") > 0)
        .groupBy(*unit, "tag", "classes")
        .agg(F.count("*").alias("n"), F.min(F.struct("page_id", "lo")).alias("first_at"))
    )


def top_patterns(counts: DataFrame, *unit: str, keep: int = TOP_PATTERNS, at_least: int = MIN_ITEMS) -> DataFrame:
    """The ten most frequent patterns of a unit that occur at least five times.

    Spark keeps only the ten best per unit before the shuffle (window group limit).
    """
    order = W.partitionBy(*unit).orderBy(F.col("n").desc(), "first_at")
    return (
        counts.withColumn("place", F.row_number().over(order))
        .where((F.col("place") <= keep) & (F.col("n") >= at_least))
        .drop("first_at")
    )
