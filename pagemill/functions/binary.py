"""Expressions over raw bytes: character sets and file types."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import charsets
from pagemill.functions.text import any_contains, bind, first_match

#: Names of codecs that have a better known one.
SHOWN = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1", "iso8859-2": "ISO-8859-2", "iso8859-15": "ISO-8859-15", "cp1250": "windows-1250",
         "cp1251": "windows-1251", "cp1252": "windows-1252", "koi8-r": "KOI8-R", "shift_jis": "Shift_JIS", "euc_jp": "EUC-JP", "gb2312": "GB2312", "gbk": "GBK",
         "gb18030": "GB18030", "big5": "Big5", "euc_kr": "EUC-KR", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def declared_codec(content: Column, limit: int = 0) -> Column:
    """Codec of the first <meta charset>, NULL when absent or unknown. ``limit``: look at the first bytes only (0: at all)."""
    head = F.decode(F.substring(content, 1, limit) if limit > 0 else content, "ISO-8859-1")
    return charsets.codec_of(first_match(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:\-]+)"""))


def declared_charset(content: Column, limit: int = 0) -> Column:
    """Name of the declared character set, NULL when absent or unknown."""
    table = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    return bind(declared_codec(content, limit), lambda c: F.coalesce(F.try_element_at(table, c), c))


def decode_page(content: Column, sets: list[str] | None = None) -> Column:
    """Text of a saved page: the declared character set, else UTF-8; malformed bytes become unknown characters.

    With ``sets``, only these declared sets count; a plan with few of them is smaller.
    """
    wanted = None if sets is None else [codecs.lookup(name).name for name in sets]
    known = lambda c: c if wanted is None else F.when(c.isin(*wanted), c)
    return bind(known(declared_codec(content)), lambda codec: charsets.decode(content, codec, wanted))


def extension_from_type(content_type: Column) -> Column:
    # Media type -> extension.
    table = {
        "image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/webp": ".webp",
        "image/svg+xml": ".svg", "image/bmp": ".bmp", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico",
        "image/avif": ".avif",
    }
    key = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extension_from_bytes(content: Column) -> Column:
    """File extension from leading bytes; an SVG is one only if nothing marks the bytes as an HTML page."""
    magic = F.hex(F.substring(content, 1, 12))
    size = F.octet_length(content)
    head = F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^\s+", "")
    page = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    svg = head.startswith("<svg") | (head.startswith("<?xml") & F.contains(F.substring(head, 1, 256), F.lit("<svg")))
    # Magic numbers (hexadecimal).
    return (
        F.when((size >= 12) & magic.startswith("89504E470D0A1A0A"), ".png")
        .when(magic.startswith("FFD8FF"), ".jpg")
        .when(magic.rlike("^474946383[79]61"), ".gif")
        .when(magic.rlike("^52494646.{8}57454250"), ".webp")
        .when(magic.startswith("25504446"), ".pdf")
        .when(magic.rlike("^.{8}66747970(61766966|61766973)"), ".avif")
        .when(svg & ~any_contains(page, ["<html", "<body", "<head", "<!doctype html"]), ".svg")
    )
