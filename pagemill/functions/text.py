"""Small string building blocks shared by every operator. All are plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters with Unicode meaning (the JVM's \s and \w are ASCII only).
WS = r"\p{IsWhite_Space}\x1c-\x1f"
_WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; keeps long expressions from being repeated in a plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL (not '') when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))



def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WS_CHARS))


def is_filled(text: Column) -> Column:
    """True when there is anything but white space."""
    return text.rlike(rf"[^{WS}]")


def squeeze(text: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return strip(F.regexp_replace(text, rf"[{WS}]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def any_contains(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def any_equal(value: Column, names: list[str]) -> Column:
    return value.isin(*names)


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, applied in order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def splice(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Rewrite every match of ``pattern`` with an expression, leaving the text between matches as it is.

    The text is cut into matches and single gaps by one regular expression, so the pieces concatenate back
    to the input. ``pattern`` must start with a literal that can be refused by a look-ahead.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){pattern}|(?:(?!{pattern}).)++"), F.lit(0))
    rewritten = F.transform(pieces, lambda p: F.when(p.rlike(rf"(?s)\A(?:{pattern})\z"), rewrite(p)).otherwise(p))
    return F.when(text.rlike(rf"(?s){pattern}"), F.array_join(rewritten, "")).otherwise(text)


# --- escapes used when Markdown and front matter are written ------------------------------------------------

def html_escape(text: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    return replace_all(text, pairs)


def yaml_string(text: Column) -> Column:
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", " "), ("\r", " "), ("\t", " ")]
    return strip(replace_all(F.coalesce(text, F.lit("")), pairs))


def link_label(text: Column) -> Column:
    return replace_all(text, [("[", "\\["), ("]", "\\]")])


def script_unescape(text: Column) -> Column:
    r"""Undo the ``\xNN`` escapes of inline page scripts, one literal at a time in this order."""
    # The eight escapes and their order.
    escapes = [("5c", "\\"), ("0d", "\r"), ("22", '"'), ("26", "&"), ("27", "'"), ("3c", "<"), ("3e", ">"), ("0a", "\n")]
    return replace_all(text, [(f"\\x{code}", char) for code, char in escapes])
