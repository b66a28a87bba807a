"""String expressions with the semantics of Python's str and re.

Patterns here and beside must take hostile texts in linear time: runs are possessive (`++`), start behind a look-behind
or are cut by sets of characters, and no group is repeated without a bound (Java's matcher recurses for each repetition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it: Unicode's, and the four separators that Java leaves out.
S = r"[\s\x1c-\x1f]"
#: The same, character by character.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def any_of(words: list[str]) -> str:
    """A regex alternation of literal words."""
    return "|".join(rf"\Q{w}\E" for w in words)


def strip(c: Column) -> Column:
    """Without white space at both ends; in time linear in the text, whatever its inner white space."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches. The group must not match empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def replaced(c: Column, pairs: list[tuple[str, Column]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), p[1]), pairs, c)


def shortened(c: Column, n: int) -> Column:
    """The first n characters and '...' where there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
