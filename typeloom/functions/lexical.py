"""Lexical rules for text that stands for a number, a boolean or a blank.

Spark's own casts are laxer than the rules here: they trim, take ``y`` as a boolean and ``1.0d`` as a
double.  Every cast below is therefore guarded by a pattern on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as booleans, in any letter case.
TRUE_WORDS = ("1", "true", "t", "yes")
FALSE_WORDS = ("0", "false", "f", "no")

# Code points with the Unicode White_Space property.
BLANK_CODE_POINTS = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
BLANKS = "".join(map(chr, BLANK_CODE_POINTS))

# Whole-text patterns.  \z rather than $, which would allow a trailing newline.
UNSIGNED_PATTERN = r"\A\+?[0-9]+\z"
INTEGER_PATTERN = r"\A[+-]?[0-9]+\z"
DECIMAL_PATTERN = r"(?i)\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z"
FLOAT_PATTERN = r"(?i)\A[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


def named(name: str) -> Column:
    """The column of that exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def folded(text: Column) -> Column:
    """Lower case, for comparison with words in any letter case.

    No letter outside A-Z has a lower case within the words this library compares with (only the Kelvin sign
    has one in a-z at all), so this is as good as folding A-Z alone.  ``upper`` would not be: of the long s.
    """
    return F.lower(text)


def is_word(text: Column, *words: str) -> Column:
    """Whether the text is one of ``words`` in any letter case."""
    return folded(text).isin(*[word.lower() for word in words])


def trim_blanks(text: Column) -> Column:
    """Trim every Unicode blank; Spark's one-argument ``trim`` strips U+0020 only.

    Most texts start and end with a printable ASCII character and are not searched for blanks at all.
    """
    printed = [end(text, F.lit(1)).between("!", "~") for end in (F.left, F.right)]
    return F.when(printed[0] & printed[1], text).otherwise(F.btrim(text, F.lit(BLANKS)))


def parse_integer(text: Column) -> Column:
    """The 64-bit integer spelled by the whole text, else NULL."""
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))


def parse_double(text: Column) -> Column:
    """The double spelled by the whole text, else NULL."""
    signed_nan = is_word(text, "+nan", "-nan")
    return F.when(
        text.rlike(FLOAT_PATTERN),
        F.when(signed_nan, F.lit(float("nan"))).otherwise(text.try_cast("double")),
    )


def parse_boolean(text: Column) -> Column:
    """The boolean spelled by the whole text, else NULL."""
    return F.when(is_word(text, *TRUE_WORDS), F.lit(True)).when(is_word(text, *FALSE_WORDS), F.lit(False))


def quote_text(text: Column) -> Column:
    """A single-quoted SQL string."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_identifier(name: Column) -> Column:
    """A double-quoted SQL identifier."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def quoted(name: str) -> str:
    """``quote_identifier`` for a name known on the driver."""
    return '"' + name.replace('"', '""') + '"'
