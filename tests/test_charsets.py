"""Character sets against the standard library, on text and on malformed bytes."""

import codecs
import random

from pyspark.sql import functions as F

from pagemill.functions import binary, charsets
from pagemill.functions.charsets import WIDE, codec_names, narrow_codecs


def samples(codec, rng):
    """Whole texts of a set, cut off texts, and bytes that lean towards its units."""
    chars = [c for c in map(chr, [*range(1, 0x250), *range(0x400, 0x460), *range(0x2010, 0x2040), *rng.sample(range(0x3000, 0xD7FF), 4000), 0x20AC, 0x1F600, 0x10FFFF]) if encoded(c, codec)]
    out = ["".join(rng.choices(chars, k=300)).encode(codec, "ignore") for _ in range(6)]
    if "0213" in codec or "2004" in codec:
        return out
    out += [t[:rng.randrange(len(t))] for t in out] + [bytes(rng.choices(range(256), k=200)) for _ in range(6)]
    out += [bytes(rng.choices([0x20, 0x30, 0x39, 0x41, 0x7E, 0x80, 0x81, 0x8E, 0x8F, 0xA1, 0xA2, 0xD8, 0xDC, 0xFE, 0xFF], k=k)) for k in range(1, 40)]
    return [*out, b"", b"plain <b>"]


def encoded(c, codec):
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        return b""


def test_every_set_decodes_like_the_standard_library(spark):
    rng = random.Random(7)
    rows = [(c, raw) for c in [*sorted(narrow_codecs()), *WIDE, "utf-16-le", "utf-16-be", "utf-16"] for raw in samples(c, rng)]
    df = spark.createDataFrame(rows, "codec string, content binary").repartition(8)
    wrong = [(r.codec, bytes(r.content).hex(), r.text) for r in df.select("codec", "content", charsets.decode(F.col("content"), F.col("codec")).alias("text")).collect()
             if r.text != bytes(r.content).decode(r.codec, "replace")]
    assert not wrong, (len(wrong), min(wrong, key=lambda w: len(w[1])))


def test_declared_names(spark):
    names = ["Shift-JIS", "SJIS", "x-sjis", "windows-1252", "Latin1", "ISO_8859-15", "KOI8-R", "euc-kr", "ks_c_5601-1987", "GB2312", "utf8", "UTF-8", "no-such", "cp1251", "Big5", "iso-2022-jp", "hex", "mac-roman", "iso8859.5"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", charsets.codec_of(F.col("n")).alias("c"))

    def expected(name):
        try:
            found = codecs.lookup(name)
        except LookupError:
            return None
        return found.name if found.name in codec_names().values() else None
    assert {r.n: r.c for r in df.collect()} == {n: expected(n) for n in names}
    assert len(narrow_codecs()) > 40 and "cp1252" in narrow_codecs()


def test_page(value, spark):
    text = "<META http-equiv=x content='text/html; charset=Windows-1252'><p>“naïve” €5"
    df = spark.createDataFrame([(text.encode("cp1252"),), (b"<meta charset=what>\xff\xc3\xa9",), (None,)], "b binary")
    assert [r[0] for r in df.select(binary.decode_page(F.col("b"))).collect()] == [text, "<meta charset=what>�é", None]
