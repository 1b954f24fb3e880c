"""Column -> Column text functions. Everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config as C


def cap_chars(text: Column, limit: int | None) -> Column:
    """First ``limit`` code points; ``None`` keeps everything."""
    return text if limit is None else F.substring(text, 1, limit)


def char_cap(name: str | None, allowed=tuple(C.CHAR_CAPS), required: bool = False) -> int | None:
    """Turn a cap name such as ``128k`` into a number of code points."""
    if name is None and not required:
        return None
    if name not in allowed:
        raise ValueError(f"character cap {name!r} is not one of {sorted(allowed)}")
    return C.CHAR_CAPS[name]


def has_meta_key(meta: Column, key: str, is_map: bool = False) -> Column:
    """Whether the metadata mentions ``key`` (JSON string or map)."""
    return F.map_contains_key(meta, key) if is_map else meta.contains(key)


def longer_than(text: Column, chars: int = C.MIN_ARTICLE_CHARS) -> Column:
    return F.length(text) > chars


def squeeze_symbols(text: Column) -> Column:
    """Runs of five or more of one non-alphanumeric character become four."""
    return F.regexp_replace(text, C.SYMBOL_RUN, "$1$1$1$1")


def collapse_repeats(text: Column) -> Column:
    """An alphanumeric unit of three or more repeated at once is kept once."""
    return F.regexp_replace(text, C.REPEATED_UNIT, "$1")


def clean_then_cap(text: Column, limit: int | None = None) -> Column:
    """Squeeze, then collapse, then cap: the cap counts cleaned characters."""
    return cap_chars(collapse_repeats(squeeze_symbols(text)), limit)


def strip(text: Column) -> Column:
    """Python's ``str.strip()``: every Unicode blank, both ends."""
    return F.btrim(text, F.lit(C.BLANKS))


def normalize_text(
    text: Column,
    ignore_case: bool = True,
    ignore_punctuation: bool = True,
    ignore_space: bool = True,
    ignore_number: bool = False,
) -> Column:
    out = text
    if ignore_case:
        out = F.lower(out)
    if ignore_punctuation:
        out = F.translate(out, C.PUNCTUATION, "")
    if ignore_number:
        out = F.translate(out, C.DIGITS, "")
    if ignore_space:
        out = F.btrim(F.regexp_replace(out, C.BLANK_CLASS + "+", " "))
    return out


def middle_truncate_chars(text: Column, limit: int) -> Column:
    """Text above ``limit`` code points keeps its first half and last half.

    An odd limit gives the extra character to the tail.
    """
    first = limit // 2
    cut = F.concat(F.substring(text, 1, first), F.right(text, F.lit(limit - first)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def question_text(question: Column, lead: str = "") -> Column:
    return F.concat(F.lit(lead + C.QUESTION_LEAD), question)


def answer_text(answer: Column, lead: str = "") -> Column:
    return F.concat(F.lit(lead + C.ANSWER_LEAD), answer)


def news_context(context: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), context)
