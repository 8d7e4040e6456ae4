"""URL, identifier and file-name functions, all pure Catalyst columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import blank_to_null, first_group, let

# The order of the patterns decides which one wins.
THREAD_ID_PATTERNS = [
    r"/thread[/-](\p{Nd}+)",
    r"/t[/-](\p{Nd}+)",
    r"tid=(\p{Nd}+)",
    r"id=(\p{Nd}+)",
    r"/(\p{Nd}+)\.html",
    r"/(\p{Nd}+)/?$",
    r"/(\p{Nd}+)[?&#]",
]
ARTICLE_ID_PATTERNS = [
    r"/(\p{Nd}+)/?$",
    r"/(\p{Nd}+)[?&#]",
    r"[?&]id=(\p{Nd}+)",
    r"[?&]article_id=(\p{Nd}+)",
    r"/article/(\p{Nd}+)",
    r"/news/(\p{Nd}+)",
]
# What makes a URL look like an image, and like a thread link.
IMAGE_URL_FORMATS = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]
IMAGE_URL_WORDS = ["image", "img", "photo", "pic", "attachment"]
DOWNLOAD_FORMATS = ["jpg", "jpeg", "png", "gif", "webp"]
LINK_IMAGE_MARKS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
NOT_THREAD_WORDS = ["javascript:", "#", "user", "member", "avatar"]
THREAD_WORDS = ["thread", "topic", "viewthread", "t/", "tid="]

# RFC 3986 appendix B, groups: scheme, authority, path, query, fragment.
_RFC3986 = (
    r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_SCHEME, _AUTHORITY, _PATH, _QUERY, _FRAGMENT = 1, 2, 3, 4, 5
# Path, query and fragment that come out of resolving as they went in.
_PLAIN_REST = r"[^?#\t\r\n]*(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?$"
_MARK = "\ue000"  # a private-use character, never part of a URL


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _RFC3986, group)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    hit = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def url_digest(url: Column) -> Column:
    """the id used when no pattern matches."""
    return F.substring(F.md5(url), 1, 16)


def thread_id(url: Column) -> Column:
    """F1."""
    return F.coalesce(first_group(url, THREAD_ID_PATTERNS), url_digest(url))


def article_id(url: Column) -> Column:
    """F2; apply it to the link as written, before it is made absolute."""
    return F.coalesce(first_group(url, ARTICLE_ID_PATTERNS), url_digest(url))


def host(url: Column) -> Column:
    """Authority of the URL, port included; NULL when there is none."""
    return blank_to_null(_part(url, _AUTHORITY))


def site_key(site: Column) -> Column:
    """host of a URL, or of a bare host name."""
    full = F.when(F.startswith(site, F.lit("http")), site).otherwise(F.concat(F.lit("https://"), site))
    return F.coalesce(host(full), site)


def board_key(board: Column) -> Column:
    """an empty board stands for the whole site."""
    return F.coalesce(blank_to_null(board), F.lit("all"))


def base_url(url: Column) -> Column:
    """``scheme://host``."""
    return F.concat(F.lower(_part(url, _SCHEME)), F.lit("://"), _part(url, _AUTHORITY))


def _drop_dot_segments(segments: Column) -> Column:
    def push(done: Column, s: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), push)
    tail = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(kept, tail)


def _merge_path(base_path: Column, ref_path: Column) -> Column:
    def folder(parts: Column) -> Column:
        return F.when(
            F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts)

    def squeeze(parts: Column) -> Column:
        inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(parts) < 3, parts).otherwise(
            F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, -1, 1))
        )

    relative = let(
        F.concat(let(F.split(base_path, "/", -1), folder), F.split(ref_path, "/", -1)), squeeze
    )
    segments = F.when(F.startswith(ref_path, F.lit("/")), F.split(ref_path, "/", -1)).otherwise(relative)
    path = F.array_join(let(segments, _drop_dot_segments), "/")
    return let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _parts(url: Column) -> Column:
    """Array of the five parts, from one match; parts that are absent are empty."""
    marked = F.regexp_replace(url, _RFC3986, _MARK.join(f"${g}" for g in range(1, 6)))
    return F.split(marked, _MARK, -1)


def _resolve_parts(x: Column) -> Column:
    names = ("scheme", "authority", "path", "query", "fragment")
    b = {"whole": x["base"], **{n: x["b"][i] for i, n in enumerate(names)}}
    r = {"whole": x["ref"], **{n: x["r"][i] for i, n in enumerate(names)}}
    scheme = F.lower(b["scheme"])

    def assemble(authority: Column, path: Column, query: Column) -> Column:
        rooted = F.when((path == "") | F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
        return F.concat(
            scheme,
            F.when(scheme != "", ":").otherwise(""),
            F.when(authority != "", F.concat(F.lit("//"), authority, rooted)).otherwise(path),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
            F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(""),
        )

    own_scheme = (r["scheme"] != "") & (F.lower(r["scheme"]) != scheme)
    plain_path = F.startswith(r["path"], F.lit("/")) & ~F.contains(r["path"], F.lit("/."))
    inherited = F.coalesce(blank_to_null(r["query"]), b["query"])
    return (
        F.when(r["whole"] == "", b["whole"])
        .when(own_scheme, r["whole"])
        .when(r["authority"] != "", assemble(r["authority"], r["path"], r["query"]))
        .when(plain_path, assemble(b["authority"], r["path"], r["query"]))
        .when(r["path"] == "", assemble(b["authority"], b["path"], inherited))
        .otherwise(let(_merge_path(b["path"], r["path"]), lambda p: assemble(b["authority"], p, r["query"])))
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """resolve a link against its page following RFC 3986.

    Most links are whole URLs or rooted paths without dot segments: those are
    kept, or put behind the site, without being taken apart.
    """
    site = F.regexp_extract(base, r"^https?://[^/?#]+", 0)
    whole = F.regexp_like(ref, F.lit(r"^https?://[^/?#\s]+" + _PLAIN_REST))
    rooted = F.regexp_like(ref, F.lit(r"^(?!//)(?![^?#]*/\.)/" + _PLAIN_REST)) & (site != "")
    clean = F.regexp_replace(ref, r"^[\x00-\x20]+|[\t\r\n]", "")
    taken_apart = lambda x: F.struct(
        x["base"].alias("base"), x["ref"].alias("ref"), _parts(x["base"]).alias("b"), _parts(x["ref"]).alias("r")
    )
    general = let(let(F.struct(base.alias("base"), clean.alias("ref")), taken_apart), _resolve_parts)
    return F.when(whole, ref).when(rooted, F.concat(site, ref)).otherwise(general)


def absolute_article_url(site_base: Column, ref: Column) -> Column:
    """F4, the simpler rule of news lists: put the site base in front."""
    return (
        F.when(F.startswith(ref, F.lit("http")), ref)
        .when(F.startswith(ref, F.lit("/")), F.concat(site_base, ref))
        .otherwise(F.concat(site_base, F.lit("/"), ref))
    )


def is_image_url(url: Column, formats: Sequence[str] | None = None) -> Column:
    """has scheme and host, and an image ending or an image word; never NULL."""
    low = F.lower(url)
    ending = r"\.(" + "|".join(formats or IMAGE_URL_FORMATS) + r")$"
    looks = F.regexp_like(low, F.lit(ending)) | contains_any(low, IMAGE_URL_WORDS)
    whole = F.regexp_like(url, F.lit(r"^[\x00-\x20]*[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+"))
    return F.coalesce(whole & looks, F.lit(False))


def strip_size_suffix(src: Column) -> Column:
    """``photo-100x100.jpg`` -> ``photo.jpg``."""
    return F.regexp_replace(src, r"-\p{Nd}+x\p{Nd}+(\.[a-zA-Z]+)$", "$1")


def full_size_attachment(url: Column, site_base: Column) -> Column:
    """F8: rewrite of forum attachment links to the full-size image."""
    rooted = F.when(
        F.startswith(url, F.lit("forum.php")) | F.startswith(url, F.lit("/forum.php")),
        F.concat(site_base, F.lit("/"), F.regexp_replace(url, "^/+", "")),
    ).otherwise(url)
    small = F.contains(rooted, F.lit("mod=attachment")) & ~F.contains(rooted, F.lit("nothumb"))
    return F.when(small, F.concat(rooted, F.lit("&nothumb=yes"))).otherwise(rooted)


def image_filename(url: Column) -> Column:
    """original file name without size suffixes, or a digest name."""
    path = F.regexp_replace(_part(url, _PATH), r";[^/]*$", "")
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"-\p{Nd}+x\p{Nd}+", "")
    return F.when(F.contains(name, F.lit(".")) & (name != "."), name).otherwise(
        F.concat(F.substring(F.md5(url), 1, 12), F.lit(".jpg"))
    )


def generated_filename(
    url: Column,
    index: Column,
    at: Column,
    board: Column | None = None,
    thread: Column | None = None,
    formats: Sequence[str] = tuple(DOWNLOAD_FORMATS),
) -> Column:
    """name of a downloaded image; ``at`` is the clock, so runs repeat."""
    ext = F.lower(F.substring_index(F.substring_index(url, ".", -1), "?", 1))
    ext = F.when(ext.isin(list(formats)), ext).otherwise(F.lit("jpg"))
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    number = F.format_string("%03d", index)
    if board is None and thread is None:
        return F.concat(F.lit("image_"), number, F.lit("_"), stamp, F.lit("."), ext)
    unknown = F.lit("unknown")
    owner = F.concat_ws(
        "_",
        F.coalesce(board, unknown) if board is not None else unknown,
        F.coalesce(thread, unknown) if thread is not None else unknown,
    )
    return F.concat(owner, F.lit("_"), number, F.lit("_"), stamp, F.lit("."), ext)


def page_url(base: Column, page: Column) -> Column:
    """URL of the n-th list page."""
    sep = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(page == 1, base).otherwise(F.concat(base, sep, F.lit("page="), page.cast("string")))


def has_image_mark(href: Column) -> Column:
    """The link points at an image file."""
    return contains_any(F.lower(href), LINK_IMAGE_MARKS)


def is_rejected_link(href: Column) -> Column:
    """Q4: scripts, anchors and member pages are never thread links."""
    return contains_any(F.lower(href), NOT_THREAD_WORDS)


def is_thread_link(href: Column) -> Column:
    """Q4: not rejected, and naming a thread or topic."""
    return ~is_rejected_link(href) & contains_any(F.lower(href), THREAD_WORDS)


def forum_save_path(root: Column, board: Column, thread: Column, file: Column) -> Column:
    """``<root>/<board>/<thread>/<file>``."""
    return F.concat_ws("/", root, F.coalesce(board, F.lit("unknown")), thread, file)


def news_save_path(root: Column, domain: Column, article: Column, file: Column) -> Column:
    """``<root>/<domain>/<article>_<file>``."""
    return F.concat_ws("/", root, domain, F.concat(article, F.lit("_"), file))
