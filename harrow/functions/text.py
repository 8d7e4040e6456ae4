"""Text, number and JSON helpers as ``Column -> Column`` functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Without it a value used in a lambda is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, else NULL."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(c, p, 1)) for p in patterns])


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# Every decimal digit of any script beyond ASCII, and the ASCII digit of the same value.
_DIGITS = [chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def number_from_text(c: Column) -> Column:
    """first run of decimal digits of any script after dropping commas, 0 when there is none.

    A number beyond a bigint counts as 0.
    """
    plain = F.replace(c, F.lit(","), F.lit(""))
    digits = blank_to_null(F.translate(F.regexp_extract(plain, r"\p{Nd}+", 0), "".join(_DIGITS), _VALUES))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def integer_key(c: Column) -> Column:
    """A value that orders whole numbers of any length as numbers; NULL for other texts.

    The number of digits, negative below zero, then the digits, which a negative number has complemented.
    """
    text = strip(c)
    digits = F.regexp_extract(text, r"^[+-]?0*([0-9]*)$", 1)
    below = F.startswith(text, F.lit("-"))
    size = F.when(below, -F.length(digits)).otherwise(F.length(digits))
    key = F.struct(size.alias("size"), F.when(below, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"))
    return F.when(text.rlike("^[+-]?[0-9]+$"), key)


def integer_text(key: Column) -> Column:
    """The number of an ``integer_key`` in plain digits."""
    digits = key["digits"]
    return F.when(key["size"] == 0, "0").when(key["size"] < 0, F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210"))).otherwise(digits)


def encode_json(c: Column, dtype: T.DataType) -> Column:
    """NULL -> ``null``, nested values -> JSON, anything else -> its text."""
    nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
    text = F.to_json(c, {"ignoreNullFields": "false"}) if nested else c.cast("string")
    return F.coalesce(text, F.lit("null"))


def decode_json(c: Column, schema: T.DataType | str) -> Column:
    """JSON text to a typed value; NULL, ``null`` and bad JSON give NULL."""
    good = F.try_parse_json(c).isNotNull() & (F.trim(c) != "null")
    return F.when(good, F.from_json(c, schema))
