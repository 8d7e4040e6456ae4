"""Fill-in-the-middle by one match of a regular expression with counted quantifiers.

A text is a row of n units, ``[A-Za-z]+`` or one other code point, and n is their
``regexp_count``. Two places from a hash of the id cut the units; the row's own
pattern ``(unit{a})(unit{b - a})(rest)`` captures prefix, middle and suffix in one
match, whose replacement puts them in the order of the row's form. The counted
groups and the unit inside them are possessive, so the match is a loop over the
text that neither goes back nor nests.

The forms are ``plain`` (the text), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle), each part behind its mark. A text that holds a mark
stays plain, so every mark stands once in an output and the text can be told
from output and form.

Defined results: a NULL text is empty, and an empty text is plain; a NULL id
counts as the empty text in the hash; repeated rows and repeated ids are each
transformed, equal ids and texts alike; an empty table gives an empty table; the
row's own columns are kept in the struct ``row`` where ``with_row`` is set, so no
name can clash. Very long texts are counted in chunks and matched whole, with
memory in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import carried

# Units and marks.
UNIT = "[A-Za-z]+|[^A-Za-z]"
POSSESSIVE = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Code points whose units are counted at once.
COUNTED = 1 << 20


def unit_count(text: Column, chunk: int = COUNTED) -> Column:
    """Units of a text; a run of letters across two chunks is counted once."""
    def more(total: Column, i: Column) -> Column:
        joined = (i > 0) & F.substr(text, i * chunk, F.lit(2)).rlike("^[A-Za-z]{2}")
        return total + F.regexp_count(F.substr(text, i * chunk + 1, F.lit(chunk)), F.lit(UNIT)) - F.when(joined, 1).otherwise(0)

    chunks = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int"))
    long = F.aggregate(chunks, F.lit(0), more)
    return F.when(F.length(text) <= chunk, F.regexp_count(text, F.lit(UNIT))).otherwise(long).cast("long")


def _number(digest: Column, k: int) -> Column:
    """The k-th group (from 0) of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, doc_id: str = "doc_id", text: str = "text",
    with_row: bool = False,
) -> DataFrame:
    """(doc_id or row, text, n, form, output): every text in the form its id's hash chooses.

    ``rate`` percent of the ids are transformed, ``spm`` percent of those with the suffix first.
    """
    rows, _ = carried(docs, doc_id, text, with_row)
    own = F.col(f"row.`{doc_id}`" if with_row else "row.doc_id")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    counted = rows.select(
        "row", F.coalesce("text", F.lit("")).alias("text"), *[_number(digest, k).alias(f"h{k + 1}") for k in range(4)],
    ).withColumn("n", unit_count(F.col("text")))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    one, two = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    placed = counted.select(
        "row", "text", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"),
        F.when((F.col("text") == "") | marked | (F.pmod("h3", F.lit(100)) >= rate), "plain")
        .when(F.pmod("h4", F.lit(100)) < spm, "spm").otherwise("psm").alias("form"),
    )

    def counts(times: Column) -> Column:
        return F.concat(F.lit(f"({POSSESSIVE}{{"), times, F.lit("}+)"))

    pattern = F.concat(F.lit("(?s)\\A"), counts(F.col("a")), counts(F.col("b") - F.col("a")), F.lit("(.*)\\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    id_or_row = F.col("row") if with_row else F.col("row.doc_id").alias("doc_id")
    return placed.select(id_or_row, "text", "n", "form", made.alias("output"))


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix, read back from an output that is not plain."""
    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return F.substring_index(rest, right, 1) if right else rest

    first = F.when(form == "spm", between(PREFIX, MIDDLE)).otherwise(between(PREFIX, SUFFIX))
    last = F.when(form == "spm", between(SUFFIX, PREFIX)).otherwise(between(SUFFIX, MIDDLE))
    return first, between(MIDDLE, None), last


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form)))


def part_chars(output: Column, form: Column) -> tuple[Column, Column]:
    """Code points of prefix and middle; NULL in the plain form."""
    prefix, middle, _ = parts(output, form)
    return tuple(F.when(form != "plain", F.length(p)).cast("long") for p in (prefix, middle))
