"""Decoding of saved pages in legacy character sets, as column expressions.

The tables are made from the standard library's codecs when an expression is built. All work starts from the ISO-8859-1 reading of the
bytes, in which every byte is a character: sets of one byte per character are a ``translate`` of it, sets of several bytes are cut into
units by a regular expression that knows which second bytes each first byte may have, and a unit's character is an element of a constant
array. Results equal ``bytes.decode(codec, "replace")``, malformed bytes included; in the four sets of JIS X 0213 malformed
bytes may be cut otherwise. Sets that switch by escape sequences (ISO-2022, HZ, UTF-7) count as unknown.
"""

from __future__ import annotations

import codecs
import encodings
import importlib
import pkgutil
from encodings.aliases import aliases
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind

UNKNOWN = "�"
#: Sets with units of several bytes.
WIDE = ("big5", "big5hkscs", "cp932", "cp949", "cp950", "euc_jis_2004", "euc_jisx0213", "euc_jp", "euc_kr", "gb18030", "gb2312", "gbk", "johab",
        "shift_jis", "shift_jis_2004", "shift_jisx0213")
#: The BMP part of the four-byte units of GB18030 and the first number beyond it.
_FOUR_BMP, _FOUR_FIRST = 39_420, 189_000


def _decodes(codec: str, raw: bytes) -> str:
    """The characters of one whole unit, '' for anything else."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return ""


@lru_cache
def narrow_codecs() -> dict[str, str]:
    """Codecs of one byte per character, with the 255 characters of the bytes from 1 on."""
    found = {}
    for module in pkgutil.iter_modules(encodings.__path__):
        charmap = module.name in ("ascii", "latin_1") or module.name.startswith(("cp", "iso8859", "koi8", "mac", "kz", "ptcp", "tis", "hp_"))
        if charmap and hasattr(importlib.import_module(f"encodings.{module.name}"), "Codec"):
            name = codecs.lookup(module.name).name
            table = "".join(bytes([b]).decode(name, "replace") for b in range(1, 256))
            if name not in WIDE and len(table) == 255:
                found[name] = table
    return found


@lru_cache
def codec_names() -> dict[str, str]:
    """Codec by normalised declared name, for every set that can be decoded."""
    known = {*narrow_codecs(), *WIDE, "utf-8", "utf-16", "utf-16-le", "utf-16-be"}
    names = {}
    for name in {*aliases, *aliases.values(), *(m.name for m in pkgutil.iter_modules(encodings.__path__))}:
        try:
            codec = codecs.lookup(name).name
        except LookupError:
            continue
        if codec in known:
            names[name] = codec
    return names


def codec_of(declared: Column) -> Column:
    """The codec of a declared name, NULL for an unknown one. Case and punctuation do not count."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(declared), "[^a-z0-9.]+", "_"), "^_|_$", "")
    table = lambda names: F.str_to_map(F.lit(",".join(f"{a}={b}" for a, b in names)), F.lit(","), F.lit("="))
    undotted = [(a, b) for a, b in codec_names().items() if a in aliases]
    return F.coalesce(F.try_element_at(table(codec_names().items()), plain), F.try_element_at(table(undotted), F.replace(plain, F.lit("."), F.lit("_"))))


def _char_class(codes: list[int]) -> str:
    """A character class of the given codes."""
    spans: list[list[int]] = []
    for c in sorted(codes):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{a:02x}" if a == b else f"\\x{a:02x}-\\x{b:02x}" for a, b in spans) + "]"


def _pairs_pattern(valid: dict[int, list[int]], head: str = "") -> list[str]:
    """Alternatives for pairs of bytes; first bytes with the same second bytes are taken together."""
    by_second: dict[tuple[int, ...], list[int]] = {}
    for first, seconds in valid.items():
        by_second.setdefault(tuple(seconds), []).append(first)
    return [head + _char_class(firsts) + _char_class(list(seconds)) for seconds, firsts in by_second.items()]


def _spelled(a: int, b: int, c: int) -> str:
    return _decodes("euc_kr", bytes([0xA4, 0xD4, 0xA4, a, 0xA4, b, 0xA4, c]))


@lru_cache
def _spelled_letters() -> tuple[list[int], list[int]]:
    """Codes that may begin and end a spelled syllable."""
    every = range(0xA1, 0xD5)
    return [a for a in every if _spelled(a, 0xBF, 0xD4)], [c for c in every if _spelled(0xA1, 0xBF, c)]


@lru_cache
def _spelled_table() -> list[str]:
    """Syllables by first letter, vowel and last letter, all counted from 0xA1, 0xBF and 0xA1."""
    return [_spelled(a, b, c) for a in range(0xA1, 0xBF) for b in range(0xBF, 0xD4) for c in range(0xA1, 0xD5)]


@lru_cache
def wide_tables(codec: str) -> tuple[str, str, list[str], list[str], list[str]]:
    """Pattern of units; the 128 ASCII characters; characters of single bytes from 128 on, of pairs, and of what follows 0x8F in threes."""
    ascii_ = bytes(range(128)).decode(codec, "replace")
    singles = [_decodes(codec, bytes([a])) for a in range(128, 256)]
    pairs = [_decodes(codec, bytes([a, b])) if not singles[a - 128] else "" for a in range(128, 256) for b in range(256)]
    valid = {a: [b for b in range(256) if pairs[(a - 128) * 256 + b]] for a in range(128, 256)}
    pattern, threes = [], []
    if codec == "gb18030":
        digit, third = r"[\x30-\x39]", r"[\x81-\xfe]"
        pattern.append(rf"(?:[\x81-\x83\x90-\xe2]{digit}|\x84\x30|\xe3[\x30\x31]){third}{digit}|\x84\x31[\x81-\xa4]{digit}|\xe3\x32(?:[\x81-\x99]{digit}|\x9a[\x30-\x35])")
        pattern.append(r"[\x80-\xff][\x30-\x39][\x00-\xff]?\z")
    if codec == "euc_kr":  # a syllable spelled letter by letter; one that is cut off at the end is one error
        first, last = _spelled_letters()
        pattern.append(rf"\xa4\xd4\xa4{_char_class(first)}\xa4[\xbf-\xd3]\xa4{_char_class(last)}|\xa4\xd4[\x00-\xff]{{0,5}}\z")
    if codec.startswith("euc_j"):
        threes = [_decodes(codec, bytes([0x8F, b, c])) for b in range(128, 256) for c in range(128, 256)]
        pattern += _pairs_pattern({b: cs for b in range(128, 256) if (cs := [c for c in range(128, 256) if threes[(b - 128) * 128 + c - 128]])}, r"\x8f")
        pattern.append(r"\x8f[\x00-\xff]?\z")
    pattern += _pairs_pattern({a: b for a, b in valid.items() if b})
    return "(?s)" + "|".join([*pattern, r"[\x00-\x7f]++", "."]), ascii_, singles, pairs, threes


@lru_cache
def _four_table() -> list[str]:
    def unit(n: int) -> bytes:
        n, d = divmod(n, 10)
        n, c = divmod(n, 126)
        a, b = divmod(n, 10)
        return bytes([a + 0x81, b + 0x30, c + 0x81, d + 0x30])
    return [_decodes("gb18030", unit(n)) for n in range(_FOUR_BMP)]


def _constant(strings: list[str]) -> Column:
    """An array literal, folded from one string; '' stands for no character."""
    return F.split(F.lit("\x00".join(strings)), "\x00")


def _wide(latin: Column, codec: str) -> Column:
    pattern, ascii_, singles, pairs, threes = wide_tables(codec)
    byte = lambda p, k: F.ascii(F.substring(p, k, 1))
    odd = "".join(chr(a) for a in range(1, 128) if ascii_[a] != chr(a))

    def unit(p: Column) -> Column:
        plain = F.translate(p, odd, "".join(ascii_[ord(c)] for c in odd)) if odd else p
        n, a = F.length(p), F.ascii(p)
        found = F.when(n == 1, F.get(_constant(singles), a - 128)).when(n == 2, F.get(_constant(pairs), (a - 128) * 256 + byte(p, 2)))
        if threes:
            found = found.when(n == 3, F.get(_constant(threes), (byte(p, 2) - 128) * 128 + byte(p, 3) - 128))
        if codec == "gb18030":
            number = (((a - 0x81) * 10 + byte(p, 2) - 0x30) * 126 + byte(p, 3) - 0x81) * 10 + byte(p, 4) - 0x30
            beyond = F.decode(F.unhex(F.lpad(F.hex(number - _FOUR_FIRST + 0x10000), 8, "0")), "UTF-32")
            found = found.when(n == 4, F.when(number < _FOUR_BMP, F.get(_constant(_four_table()), number)).when(
                number.between(_FOUR_FIRST, _FOUR_FIRST + 0xFFFFF), beyond))
        if codec == "euc_kr":
            found = found.when(n == 8, F.get(_constant(_spelled_table()), ((byte(p, 4) - 0xA1) * 21 + byte(p, 6) - 0xBF) * 52 + byte(p, 8) - 0xA1))
        return F.when(a < 128, plain).otherwise(F.coalesce(F.nullif(found, F.lit("")), F.lit(UNKNOWN)))

    return F.array_join(F.transform(F.regexp_extract_all(latin, F.lit(pattern), F.lit(0)), unit), "")


def _utf16(latin: Column, big: bool) -> Column:
    """Units of two bytes; halves of pairs that stand alone and a last odd byte become unknown characters."""
    low, high, rest = r"[\xd8-\xdb]", r"[\xdc-\xdf]", r"[^\xd8-\xdf]"
    good = rf"{rest}.|{low}.{high}." if big else rf".{rest}|.{low}.{high}"
    cut = f"{low}.." if big else f".{low}."  # half a pair and an odd byte at the end are one error
    fixed = F.regexp_replace(latin, rf"(?s)\G((?:{good})*+)(?:{cut}\z|..?)", "$1\xff\xfd" if big else "$1\xfd\xff")
    return F.decode(F.encode(fixed, "ISO-8859-1"), "UTF-16BE" if big else "UTF-16LE")


def decode(content: Column, codec: Column, only: list[str] | None = None) -> Column:
    """Text of ``content`` by the Python codec that ``codec`` names, UTF-8 for NULL and names that :func:`codec_names` does not have.

    ``only``: the codecs that can occur, so that tables of others are left out of the plan.
    """
    table = F.str_to_map(F.lit("\x00".join(f"{name}={chars}" for name, chars in _safe_tables().items())), F.lit("\x00"), F.lit("="))

    def of(latin: Column) -> Column:
        every = F.lit("".join(map(chr, range(1, 256))))
        text = F.when(codec.isin(*_safe_tables()), F.call_function("translate", latin, every, F.translate(F.try_element_at(table, codec), _HELD, "\x00=")))
        for name in WIDE if only is None else [w for w in WIDE if w in only]:
            text = text.when(codec == name, _wide(latin, name))
        marked = F.substring(latin, 1, 2)
        text = text.when((codec == "utf-16-be") | ((codec == "utf-16") & (marked == "\xfe\xff")), _utf16(F.when(codec == "utf-16", F.substring(latin, F.lit(3), F.length(latin))).otherwise(latin), True))
        return text.when(codec.isin("utf-16", "utf-16-le"), _utf16(F.when((codec == "utf-16") & (marked == "\xff\xfe"), F.substring(latin, F.lit(3), F.length(latin))).otherwise(latin), False))

    return F.when(codec.isNull() | (codec == "utf-8"), F.make_valid_utf8(content.cast("string"))).otherwise(
        F.coalesce(bind(F.decode(content, "ISO-8859-1"), of), F.make_valid_utf8(content.cast("string"))))


#: Stand-ins for the separators of the table of narrow sets.
_HELD = ""


@lru_cache
def _safe_tables() -> dict[str, str]:
    return {name: chars.replace("\x00", _HELD[0]).replace("=", _HELD[1]) for name, chars in narrow_codecs().items()}
