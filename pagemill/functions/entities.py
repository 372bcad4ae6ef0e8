"""HTML character references as a column expression, by the rules of the HTML standard for text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind

#: Names that hold most references of real pages; they are looked at before the full table.
_COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "ndash", "mdash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo")
#: Names that count without a semicolon, longest first, so that the first that fits is the longest.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def entity_text() -> dict[str, str]:
    """Characters of every named reference; names keep their semicolon, if they need one."""
    return dict(html5)


def _windows(code: int) -> str:
    """What the codes 128 to 159 stand for in pages."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _code_point(number: Column) -> Column:
    """The character of a number; NULL stands for one that is too large."""
    utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
    windows = F.lit("".join(_windows(c) for c in range(128, 160)))
    control = number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127)
    nowhere = number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    return (F.when(number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("�"))
            .when(number == 13, F.lit("\r"))
            .when(number.between(128, 159), F.substring(windows, (number - 127).cast("int"), F.lit(1)))
            .when(control | nowhere, F.lit(""))
            .otherwise(F.decode(utf32, "UTF-32")))


def _resolve(ref: Column, names: Column) -> Column:
    digits = F.regexp_replace(ref, r"^&#0*|;$", "")
    hexadecimal = F.regexp_replace(ref, r"^&#[xX]0*|;$", "")
    decimal = F.when(F.length(digits) <= 7, F.coalesce(digits.try_cast("bigint"), F.lit(0)))
    sixteen = F.when(F.length(hexadecimal) <= 6, F.coalesce(F.conv(hexadecimal, 16, 10).try_cast("bigint"), F.lit(0)))
    name = F.substring(ref, 2, 40)
    bare = F.regexp_extract(name, f"^(?:{'|'.join(_BARE)})", 0)
    named = F.when(ref == "&", ref)
    for common in _COMMON:
        named = named.when(name == common + ";", F.lit(html5[common + ";"]))
    return (F.when(ref.rlike("^&#[0-9]"), _code_point(decimal))
            .when(ref.rlike("^&#[xX][0-9a-fA-F]"), _code_point(sixteen))
            .otherwise(named.otherwise(F.coalesce(
                F.try_element_at(names, name),
                F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substring(ref, F.length(bare) + 2, F.lit(40)))), ref))))


def unescape(text: Column) -> Column:
    """Replace character references: every name of the standard, the old names also without a semicolon and in front of
    other letters, and numbers of any length. Text without an ampersand takes the short way."""
    # One literal that is folded to a map once.
    names = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in html5.items())), F.lit("\x02"), F.lit("\x01"))
    reference = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32}+;?)|&|[^&]+"

    def resolved(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(reference), F.lit(0))
        return F.array_join(
            F.transform(pieces, lambda p: F.when(p.startswith("&"), _resolve(p, names)).otherwise(p)), "")

    return bind(text, lambda t: F.when(F.contains(t, F.lit("&")), resolved(t)).otherwise(t))
