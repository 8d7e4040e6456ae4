"""SQL fragments shared by the checks (DuckDB dialect)."""

from __future__ import annotations


def cascade(url: str, patterns: list[str]) -> str:
    tries = ", ".join(f"nullif(regexp_extract({url}, '{p}', 1), '')" for p in patterns)
    return f"coalesce({tries}, substr(md5({url}), 1, 16))"


def thread_id(url: str) -> str:
    return cascade(url, ["/thread[/-]([0-9]+)", "/t[/-]([0-9]+)", "tid=([0-9]+)", "id=([0-9]+)",
                         r"/([0-9]+)\.html", "/([0-9]+)/?$", "/([0-9]+)[?&#]"])


def article_id(url: str) -> str:
    return cascade(url, ["/([0-9]+)/?$", "/([0-9]+)[?&#]", "[?&]id=([0-9]+)", "[?&]article_id=([0-9]+)",
                         "/article/([0-9]+)", "/news/([0-9]+)"])


def host(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"


def base(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://[^/?#]*')"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def file_name(url: str) -> str:
    name = f"regexp_replace(regexp_extract({path(url)}, '([^/]*)$', 1), '-[0-9]+x[0-9]+', '', 'g')"
    return f"CASE WHEN contains({name}, '.') THEN {name} ELSE substr(md5({url}), 1, 12) || '.jpg' END"


def unescape(text: str) -> str:
    out = text
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·")):
        out = f"replace({out}, '&{entity};', '{char}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def texts(html: str) -> str:
    """List of the stripped, non-empty texts between the tags."""
    bare = f"regexp_replace({html}, '(?s)<!--.*?-->|<[^>]*$', '<x>', 'g')"
    return (
        f"list_filter(list_transform(string_split_regex({bare}, '<[^>]*>'), "
        f"lambda x: {strip(unescape('x'))}), lambda x: x <> '')"
    )


def text(html: str, separator: str = "''") -> str:
    return f"array_to_string({texts(html)}, {separator})"


LINK = r'<a\s[^>]*?href="([^"]*)"'
LINKS = f"""links AS (
  SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '{LINK}', 1) AS l FROM pages))"""


def resolved(href: str = "href", url: str = "url") -> str:
    """Links of the page table all have the form /path."""
    return f"{base(url)} || {href}"
