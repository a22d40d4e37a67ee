"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """Double where the text is a plain decimal number, else null; NaN and infinities written out are null too."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), F.trim(s).try_cast("double"))


def valid_utf8(content: Column) -> Column:
    """Text of bytes, those that are not UTF-8 dropped."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "�", "")


# White space as Unicode has it.
SPACES = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(text.rlike(f"[^{SPACES}]"), F.lit(False))


def recode(c: Column, level: str) -> Column:
    """1 where c is the level, 0 elsewhere, for null as well."""
    return F.when(c == level, 1).otherwise(0)


def scale_pixels(c: Column, by: float = 255.0) -> Column:
    return F.transform(c, lambda x: x.cast("double") / F.lit(by))


def flatten_pixels(c: Column) -> Column:
    """The rows of an image (array of arrays) end to end."""
    return F.flatten(c)


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences, added in the order of the columns."""
    out = (a[0] - b[0]) * (a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + (x - y) * (x - y)
    return out


def round_fast(c: Column, to: int) -> Column:
    """F.round() of a double, whose decimals cost more than a comparison of rows: only near a half, or past 2^40, are they made."""
    x = c * F.lit(10.0**to)
    plain = (F.abs(x - F.floor(x) - F.lit(0.5)) > F.lit(0.001)) & (F.abs(x) < F.lit(2.0**40))
    return F.when(plain, F.rint(x) / F.lit(10.0**to)).otherwise(F.round(c, to))


def argmax(p: Column) -> Column:
    """0-based place of the first maximum of an array."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
