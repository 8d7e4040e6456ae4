"""P8 and selector text: short strings that name elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import blank_to_null


def selector_steps(text: Column) -> Column:
    """Selector text of a site's settings as the structured steps the extractors use.

    Understands tag, ``.class``, ``#id`` and ``[name op 'value']`` (op ``= ^= $= *= ~=``),
    a blank for "inside" and a comma for "or"; values hold neither blanks nor commas.
    ``unsupported_selector`` tells of anything else.
    """

    def one_attr(a: Column) -> Column:
        pattern = r"^\s*([^\s=^*$~]+)\s*(\^=|\*=|\$=|~=|=)?\s*['\"]?(.*?)['\"]?\s*$"
        op = blank_to_null(F.regexp_extract(a, pattern, 2))
        return F.struct(
            F.regexp_extract(a, pattern, 1).alias("name"),
            F.coalesce(op, F.lit("has")).alias("op"),
            F.regexp_extract(a, pattern, 3).alias("value"),
        )

    def one_step(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\[[^\]]*\]", "")
        ids = F.transform(
            F.regexp_extract_all(bare, F.lit(r"#([^.#]+)"), F.lit(1)),
            lambda i: F.struct(F.lit("id").alias("name"), F.lit("=").alias("op"), i.alias("value")),
        )
        return F.struct(
            blank_to_null(F.lower(F.regexp_extract(bare, r"^([^.#*]+)", 1))).alias("tag"),
            F.regexp_extract_all(bare, F.lit(r"\.([^.#]+)"), F.lit(1)).alias("classes"),
            F.concat(
                ids, F.transform(F.regexp_extract_all(s, F.lit(r"\[([^\]]*)\]"), F.lit(1)), one_attr)
            ).alias("attrs"),
        )

    alternatives = F.filter(F.transform(F.split(text, ","), lambda a: F.trim(a)), lambda a: a != "")
    return F.transform(alternatives, lambda a: F.transform(F.split(a, r"\s+"), one_step))


def unsupported_selector(text: Column) -> Column:
    """Why ``selector_steps`` cannot stand for a selector, NULL if it can."""
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")
    attrs = F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    bad_attr = F.exists(attrs, lambda a: ~F.rlike(a, F.lit(r"""^\s*[\w:-]+\s*([~^$*]?=\s*("[^"\s,]*"|'[^'\s,]*'|[^"'\s,]+)\s*)?$""")))
    return (
        F.when(F.rlike(bare, F.lit(r"[>+~]")), "combinator")
        .when(F.contains(bare, F.lit(":")), "pseudo-class")
        .when(F.rlike(bare, F.lit(r"[\[\]()\"'=]")) | bad_attr, "attribute test")
    )


def class_selector(e: Column) -> Column:
    """``tag.firstclass``, or the tag."""
    return F.concat_ws(".", e["tag"], F.get(e["classes"], F.lit(0)))


def id_selector(tag: Column, element_id: Column) -> Column:
    """``tag[id^='prefix']`` with the leading letters of the id, or the tag."""
    prefix = F.regexp_extract(element_id, r"^([a-zA-Z_-]+)", 1)
    return F.when(prefix != "", F.concat(tag, F.lit("[id^='"), prefix, F.lit("']"))).otherwise(tag)


def link_selector(link_classes: Column, parent_classes: Column | None = None) -> Column:
    """By the link's classes, else by the parent's first class, else any link."""
    own = F.when(F.size(link_classes) > 0, F.concat(F.lit("a."), F.array_join(link_classes, ".")))
    if parent_classes is None:
        return F.coalesce(own, F.lit("a"))
    by_parent = F.concat(F.lit("."), F.get(parent_classes, F.lit(0)), F.lit(" a"))
    return F.coalesce(own, by_parent, F.lit("a"))
