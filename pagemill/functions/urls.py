"""URL arithmetic as column expressions: split, join, redact, alias, name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import WORD, WS as _WS, any_contains, bind, first_match, replace_all, strip

# scheme, authority, path, query, fragment of the generic URI syntax (RFC 3986, appendix B)
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port, '' when there is none."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":[^:\]]*$", ""), r"^\[|\]$", ""))


def port(url: Column) -> Column:
    """Port number, NULL when absent or not a valid number."""
    text = first_match(authority(url), r":([0-9]{1,9})$")
    return F.when(text.cast("int").between(1, 65535), text.cast("int"))


def _port_is_bad(url: Column) -> Column:
    text = F.regexp_extract(F.regexp_replace(authority(url), r"^.*@", ""), r":([^:\]]*)$", 1)
    return (text != "") & ~(text.rlike("^[0-9]{1,9}$") & (F.coalesce(text.try_cast("int"), F.lit(99999)) <= 65535))


def same_host(a: Column, b: Column) -> Column:
    return (host(a) != "") & (host(a) == host(b))


def defragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _with_prefix(prefix: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(prefix), text)).otherwise(F.lit(""))


def _normal_path(raw: Column, whole: Column) -> Column:
    """Drop '.' segments and let '..' remove its parent; only paths that need it are taken apart.

    Empty segments go too unless the reference gives the ``whole`` path.
    """
    parts = F.split(raw, "/")
    size = F.size(parts)
    inner = F.filter(parts, lambda s, i: whole | (i == 0) | (i == size - 1) | (s != ""))
    folded = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(parts, -1)
    ended = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(raw.rlike(r"//|(?:^|/)\.{1,2}(?:/|$)"),
                  F.coalesce(F.nullif(F.array_join(ended, "/"), F.lit("")), F.lit("/"))).otherwise(raw)


def parts(url: Column) -> Column:
    return F.struct(*[_part(url, i).alias(n) for i, n in enumerate(["scheme", "host", "path", "query", "fragment"], 1)])


def join_url(base: Column, ref: Column, base_parts: Column | None = None) -> Column:
    """Absolute form of ``ref`` as seen from ``base``; many references can share the ``parts`` of their base."""
    def joined(b: Column, r: Column) -> Column:
        own_scheme, base_scheme = F.lower(r["scheme"]), F.lower(b["scheme"])
        root = F.concat(base_scheme, F.lit("://"), b["host"])
        tail = F.concat(_with_prefix("?", r["query"]), _with_prefix("#", r["fragment"]))
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(
            F.concat(F.when((folder == "") & (b["host"] != ""), F.lit("/")).otherwise(folder), r["path"]))
        kept_query = F.when(r["query"] != "", r["query"]).otherwise(b["query"])
        return (
            F.when((own_scheme != "") & (own_scheme != base_scheme), ref)
            .when(r["host"] != "", F.concat(base_scheme, F.lit("://"), r["host"], r["path"], tail))
            .when(r["path"] == "", F.concat(root, b["path"], _with_prefix("?", kept_query),
                                            _with_prefix("#", r["fragment"])))
            .otherwise(F.concat(root, bind(merged, lambda m: _normal_path(m, r["path"].startswith("/"))), tail))
        )

    def seen_from(b: Column) -> Column:
        # A path from the root and nothing else is not taken apart.
        only_path = ref.rlike(r"\A/(?!/)[^?#]*\z")
        return F.when(only_path, F.concat(F.lower(b["scheme"]), F.lit("://"), b["host"], _normal_path(ref, F.lit(True)))).otherwise(
            bind(parts(ref), lambda r: joined(b, r)))

    return (
        F.when(F.coalesce(base, F.lit("")) == "", ref)
        .when(ref == "", base)
        .otherwise(bind(parts(base), seen_from) if base_parts is None else seen_from(base_parts))
    )


def redact(url: Column) -> Column:
    """Keep scheme, host, port and path of an http(s) URL; leave anything else as it is."""
    clean_port = port(url)
    kept = F.concat(
        scheme(url), F.lit("://"), host(url),
        F.when(clean_port.isNotNull(), F.concat(F.lit(":"), clean_port.cast("string"))).otherwise(F.lit("")),
        path(url))
    usable = scheme(url).isin("http", "https") & (authority(url) != "") & ~_port_is_bad(url)
    return F.when(usable, kept).otherwise(url)


def port_aliases(url: Column) -> Column:
    """The URL itself plus its spelling without an explicit port or with the scheme's default port."""
    rest = F.concat(path(url), _with_prefix("?", query(url)))
    has_port = port(url).isNotNull()
    front = F.concat(scheme(url), F.lit("://"), host(url))
    other = (
        F.when(has_port, F.concat(front, rest))
        .when(scheme(url) == "https", F.concat(front, F.lit(":443"), rest))
        .when(scheme(url) == "http", F.concat(front, F.lit(":80"), rest))
    )
    return F.array_distinct(F.array_compact(F.array(url, other)))


def percent_decode(text: Column) -> Column:
    """Percent-decode, keeping '+' and leaving malformed input alone."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(decoded, text)).otherwise(text)


def percent_encode(text: Column, safe: str = "") -> Column:
    """Percent-encode everything but letters, digits, '_.-~' and the characters in ``safe``."""
    pairs = [("+", "%20"), ("*", "%2A"), ("%7E", "~")]
    return replace_all(F.url_encode(text), pairs + [(f"%{ord(c):02X}", c) for c in safe])


def link_destination(url: Column) -> Column:
    """Encode the three characters that break a Markdown link destination."""
    return replace_all(url, [(" ", "%20"), ("(", "%28"), (")", "%29")])


def is_icon(url: Column) -> Column:
    low = F.lower(url)
    # Substrings that mark an icon.
    return any_contains(low, ["favicon", "/icon/", "pinned-octocat", "/apple-touch-icon"]) | low.endswith(".ico")


def is_unsafe_link(url: Column) -> Column:
    # Schemes refused in links.
    return F.regexp_replace(url, r"[\x00-\x20]+", "").rlike(r"(?i)^(?:javascript|vbscript|file|data):")


# --- names derived from URLs and titles ---------------------------------------------------------------------

def file_stem(text: Column) -> Column:
    """A portable file name; device names reserved on some systems get an underscore in front."""
    dashed = F.regexp_replace(F.regexp_replace(strip(text), rf"[^{WORD}.\-]+", "-"), "-{2,}", "-")
    name = F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))
    root = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    # Reserved device names.
    reserved = F.upper(root).rlike(r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(reserved, F.concat(F.lit("_"), name)).otherwise(name)


def plain_stem(text: Column) -> Column:
    """The file name rule used for assets: as :func:`file_stem`, without the reserved names."""
    dashed = F.regexp_replace(F.regexp_replace(strip(text), rf"[^{WORD}.\-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def page_stem(url: Column, limit: int = 80) -> Column:
    """File stem from host and path; long ones are cut and get a hash of the URL."""
    site = F.regexp_replace(F.lower(authority(url)), r"^www\.", "")
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    stem = file_stem(F.array_join(F.concat(F.array(site), parts), "_"))
    cut = F.concat(F.substring(stem, 1, limit - 9), F.lit("-"), F.substring(F.sha1(url), 1, 8))
    return F.when(F.length(stem) <= limit, stem).otherwise(F.regexp_replace(cut, "-+$", ""))


def fit_path(folder: str, name: Column, limit: int = 250) -> Column:
    """Shorten ``name`` so that ``folder/name`` stays within ``limit`` characters."""
    total = F.length(name) + len(folder.rstrip("/")) + 1
    ext = F.regexp_extract(name, r"(?<=[^.])(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    keep = F.greatest(F.lit(10), F.length(stem) - (total - limit) - 8)
    short = F.concat(F.substring(stem, F.lit(1), keep), F.lit("-"), F.substring(F.sha1(name), 1, 6), ext)
    return F.when(total <= limit, name).otherwise(short)


def anchor_slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), rf"[^{WORD}{_WS}一-鿿\-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, rf"[{_WS}]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("section"))


def title_key(title: Column) -> Column:
    """Form in which two titles are compared."""
    low = F.lower(F.regexp_replace(strip(F.coalesce(title, F.lit(""))), rf"[{_WS}]+", " "))
    return F.regexp_replace(low, rf"[^{WORD}一-鿿 ]+", "")
