"""Markdown rewrites that look only at one document's text.

Everything here is a map-side column expression. Code fences are respected by cutting the text once into
fence and non-fence segments; a fence closes on a line that starts with the same fence character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import WORD, WS, any_contains, bind, splice, strip
from pagemill.functions import urls

_OPEN = r"[ \t]*+(?:```|~~~)"
_SEGMENT = (
    rf"(?s)(?<![^\n])[ \t]*+(```|~~~)[^\n]*+(?:\n|\z)(?:.*?(?<=\n)[ \t]*+\1[^\n]*+(?:\n|\z)|.*+)"
    rf"|(?:(?<![^\n])(?!{_OPEN})[^\n]*+(?:\n|\z))++"
)

LINK = r"\[[^\]]+\]\([^)]+\)"
LINK_LINE = rf"[ \t]*[-*][{WS}]*\[[^\]\n]+\]\([^)\n]+\)[ \t]*\n"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"


def segments(md: Column) -> Column:
    """Fence and non-fence pieces in order; they concatenate back to the text."""
    return F.regexp_extract_all(md, F.lit(_SEGMENT), F.lit(0))


def is_fence(segment: Column) -> Column:
    return segment.rlike(rf"\A{_OPEN}")


def outside_fences(md: Column, rewrite: Callable[[Column], Column]) -> Column:
    """Apply ``rewrite`` to everything but fenced code. Text without a fence is rewritten in one go."""
    pieces = F.transform(segments(md), lambda s: F.when(is_fence(s), s).otherwise(rewrite(s)))
    has_fence = F.contains(md, F.lit("```")) | F.contains(md, F.lit("~~~"))
    return F.when(has_fence, F.array_join(pieces, "")).otherwise(rewrite(md))


def squeeze_blank_lines(md: Column) -> Column:
    """At most two blank lines in a row; blank lines lose their white space."""
    # Looking for a literal costs far less than a replacement that finds nothing.
    def run(s: Column) -> Column:
        blank = any_contains(s, ["\n ", "\n\t", "\r", "\x0b", "\f", "\x85", "\u2028", "\u2029"]) | s.startswith(" ") | s.startswith("\t")
        tidy = F.when(blank, F.regexp_replace(s, r"(?m)^[ \t\x0b\f\r]+$", "")).otherwise(s)
        return bind(tidy, lambda t: F.when(any_contains(t, ["\n\n\n"]), F.regexp_replace(
            F.regexp_replace(t, r"\n{4,}", "\n\n\n"), r"\A\n{3,}", "\n\n")).otherwise(t))
    return outside_fences(md, run)


def demote_headings(md: Column, by: int) -> Column:
    """Move headings ``by`` levels down, at most to level six."""
    def run(s: Column) -> Column:
        for level in range(6, 0, -1):
            s = F.regexp_replace(s, rf"(?m)^#{{{level}}}(?=[ \t])", "\x02" * min(6, level + by))
        return F.replace(s, F.lit("\x02"), F.lit("#"))
    return outside_fences(md, run)


def drop_empty_headings(md: Column) -> Column:
    def run(s: Column) -> Column:
        bare = any_contains(s, ["#\n", "# \n", "#\t", "#  ", "# \t"]) | s.endswith("#") | s.endswith("# ")
        return F.when(F.contains(s, F.lit("#")) & bare, F.regexp_replace(s, r"(?m)^[ \t]*#{1,6}[ \t]*(?:\n|\z)", "")).otherwise(s)
    return outside_fences(md, run)


def drop_heading_permalinks(md: Column) -> Column:
    pattern = r"(?m)^(#{1,6}[ \t]+.*?)(?:[ \t]*\[[ \t]*[#¶§][ \t]*\]\([^)]+\))+[ \t]*$"
    return outside_fences(md, lambda s: F.when(
        F.contains(s, F.lit("](")) & F.contains(s, F.lit("#")), F.regexp_replace(s, pattern, "$1")).otherwise(s))


def latex_delimiters(md: Column) -> Column:
    r"""Turn \[ \] \( \) into dollar signs outside fences and inline code."""
    code = r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"

    def dollars(s: Column) -> Column:
        s = F.regexp_replace(s, r"\\[\[\]]", r"\$\$")
        return F.regexp_replace(s, r"\\[()]", r"\$")

    def run(s: Column) -> Column:
        pieces = F.regexp_extract_all(s, F.lit(rf"(?s){code}|[^`]++|`"), F.lit(0))
        mapped = F.transform(pieces, lambda p: F.when(p.startswith("`"), p).otherwise(dollars(p)))
        return F.when(F.contains(s, F.lit("`")), F.array_join(mapped, "")).otherwise(dollars(s))
    return F.when(F.contains(md, F.lit("\\")), outside_fences(md, run)).otherwise(md)


def drop_duplicate_title(md: Column, title: Column, scan: int = 0) -> Column:
    """Remove the first bare-hash line or level-one heading that repeats the title (with the blanks after it).

    ``scan``: look at the first lines only (0: at all).
    """
    lines = F.split(md, "\n")
    key = urls.title_key(title)

    def hit(line: Column) -> Column:
        bare = strip(line)
        heading = bare.startswith("# ") & (urls.title_key(F.substring(bare, F.lit(3), F.length(bare))) == key)
        return bare.rlike(r"^#{1,6}$") | heading

    head = F.slice(lines, 1, scan) if scan > 0 else lines
    at = F.array_min(F.filter(F.transform(head, lambda l, i: F.when(hit(l), i)), lambda i: i.isNotNull()))
    is_bare = strip(F.get(lines, at)).rlike(r"^#{1,6}$")
    rest = F.slice(lines, at + 2, F.greatest(F.size(lines), F.lit(1)))
    filled = F.array_min(F.filter(F.transform(rest, lambda l, i: F.when(strip(l) != "", i)), lambda i: i.isNotNull()))
    tail = F.when(is_bare, rest).when(filled.isNull(), F.array().cast("array<string>")).otherwise(
        F.slice(rest, filled + 1, F.greatest(F.size(rest), F.lit(1))))
    cut = F.array_join(F.concat(F.slice(lines, F.lit(1), F.coalesce(at, F.lit(0))), tail), "\n")
    body = F.when(at.isNull() | (key == ""), md).otherwise(cut)
    trimmed = F.concat(F.regexp_replace(F.regexp_replace(body, r"\A\n+", ""), rf"[{WS}]+\z", ""), F.lit("\n"))
    return F.when((key == "") | (md == ""), md).otherwise(trimmed)


# --- noise ----------------------------------------------------------------------------------------------------

def _tidy_gaps(md: Column) -> Column:
    """One empty line where there were several; lines of blanks are empty."""
    def tidy(lines: Column) -> Column:
        kept = F.filter(lines, lambda l, i: (l != "") | (i == 0) | (F.get(lines, i - 1) != ""))
        return F.array_join(F.transform(kept, lambda l: F.when(F.translate(l, " \t", "") == "", "").otherwise(l)), "\n")
    return strip(bind(F.split(md, "\n"), tidy))


#: Labels of the buttons that a messenger article ends with; several may share a line.
BUTTONS = ("video", "mini program", "like", "wow", "share", "comment", "favorite", "听过")
#: Labels that make a line, alone or as a link.
BUTTON_LINES = ("轻点两下取消赞", "轻点两下取消在看", "scan to follow", "cancel", "allow", "取消", "允许", "阅读原文", "read more", "read original")
BUTTON_LINKS = ("cancel", "allow", "取消", "允许", "阅读原文", "read more", "read original")
#: The notice about a mini program, in one line or two, and the frame of the other notice.
PROGRAM_NOTICE = ("scan with weixin to", "use this mini program")
SCAN_NOTICE = ("微信扫一扫可打开此内容", "使用完整服务")


def drop_messenger_noise(md: Column) -> Column:
    """Empty the lines made only of the buttons a messenger article page ends with."""
    def plain(line: Column) -> Column:
        return F.lower(F.btrim(line, F.lit(" \t,，")))

    def only_buttons(text: Column) -> Column:
        # Labels become marks; a line of nothing but marks and separators is one of buttons.
        marked = text
        for label in BUTTONS:
            marked = F.replace(marked, F.lit(label), F.lit("\x01"))
        return F.contains(marked, F.lit("\x01")) & (F.translate(marked, "\x01 \t,，", "") == "")

    def is_noise(texts: Column, i: Column) -> Column:
        text = F.get(texts, i)
        label = F.translate(F.substring_index(text, "](", 1), "[]", "")
        link = text.endswith(")") & F.contains(text, F.lit("](")) & (F.locate(")", text) == F.length(text)) & label.isin(*BUTTON_LINKS)
        first, second = PROGRAM_NOTICE
        notice = text.startswith(first) & (strip(F.substring(text, F.lit(len(first) + 1), F.length(text))) == second)
        halves = ((text == first) & (F.get(texts, i + 1) == second)) | ((text == second) & (i > 0) & (F.get(texts, i - 1) == first))
        scan = text.startswith(SCAN_NOTICE[0]) & text.endswith(SCAN_NOTICE[1])
        return F.coalesce(only_buttons(text) | text.isin(*BUTTON_LINES) | link | notice | halves | scan, F.lit(False))

    def emptied(lines: Column) -> Column:
        return bind(F.transform(lines, plain), lambda texts: F.array_join(
            F.transform(lines, lambda line, i: F.when(is_noise(texts, i), "").otherwise(line)), "\n"))
    return _tidy_gaps(bind(F.split(md, "\n"), emptied))


#: Labels of wiki links for editing, for tools and for jumps, in lower case.
EDIT_LABELS = ("edit", "编辑", "修改", "更新")
TOOL_LABELS = (*EDIT_LABELS, "history", "历史", "diff", "差分", "raw", "源代码", "附件", "attach", "新建")
JUMP_LABELS = ("↑", "↓", "↖", "↗", "↙", "↘", "top", "顶部", "返回顶部", "^")
_EDIT_COMMANDS = ("cmd=edit", "action=edit")


def drop_wiki_noise(md: Column) -> Column:
    """Remove edit, history, footnote and back-to-top links of wiki pages, and links in brackets of their own."""
    link = r"\[(?:\s*\[[^\]]+\]\([^)]+\)\s*\]\s*|[^\[\]]*\]\([^)]*\))"

    def judged(piece: Column) -> Column:
        bracketed = piece.rlike(r"\A\[\s*\[")
        label = F.lower(F.regexp_extract(piece, r"\[([^\[\]]*)\]\(", 1))
        target = F.lower(F.substring_index(piece, "](", -1))
        gone = label.isin(*TOOL_LABELS, *JUMP_LABELS) | ((label == "?") & any_contains(target, list(_EDIT_COMMANDS)))
        after = F.regexp_extract(piece, r"(\s*)\z", 1)
        return F.when(bracketed & label.isin(*EDIT_LABELS), after).when(bracketed | gone, "").otherwise(piece)
    return _tidy_gaps(splice(md, link, judged))


def drop_anchor_lists(md: Column, threshold: int = 20) -> Column:
    """Struct(md, lists, lines): the text without long link lists, and what was removed."""
    if threshold <= 0:
        return F.struct(md.alias("md"), F.lit(0).alias("lists"), F.lit(0).alias("lines"))
    under_heading = rf"(?m)#{{3,6}}[{WS}]+[^\n]+\n\n?(?:[ \t]*[-*][{WS}]*{LINK}[{WS}]*\n){{{max(3, threshold - 1)},}}+"
    bare = rf"(?:(?:(?<=\n)|\A)[ \t]*(?:[-*]|\d+\.)[{WS}]*{LINK}[{WS}]*\n){{{threshold},}}+"

    def blanks(text: Column) -> Column:
        return outside_fences(text, lambda s: F.regexp_replace(s, r"\n{4,}", "\n\n\n"))

    def hits(text: Column, pattern: str) -> Column:
        free = F.array_join(F.filter(segments(text), lambda s: ~is_fence(s)), "\x00\n")
        has_fence = F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))
        return F.regexp_extract_all(F.when(has_fence, free).otherwise(text), F.lit(pattern), F.lit(0))

    def newlines(found: Column) -> Column:
        return F.aggregate(found, F.lit(0), lambda n, b: n + F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))))

    def result(text: Column, lists: Column, lines: Column) -> Column:
        return F.struct(text.alias("md"), lists.alias("lists"), lines.alias("lines"))

    def second_step(step1: Column, first: Column) -> Column:
        second = hits(step1, bare)
        lists = F.size(first) + F.size(second)
        step2 = outside_fences(step1, lambda s: F.regexp_replace(s, bare, ""))
        orphan = r"(?m)^[ \t]*#{3,6}[ \t]+[^\n]+\n(?:[ \t]*\n)*\z"
        step3 = F.when(lists > 0, F.regexp_replace(step2, orphan, "")).otherwise(step2)
        return result(blanks(step3), lists, newlines(first) + newlines(second))

    def strip_lists(text: Column) -> Column:
        step1 = outside_fences(text, lambda s: F.regexp_replace(s, under_heading, ""))
        return bind(hits(text, under_heading), lambda first: bind(step1, lambda s: second_step(s, first)))

    # Either kind of list needs that many links, so most texts are done after one cheap count.
    links = F.size(F.split(md, r"\]\(")) - 1
    return F.when(links >= max(3, threshold - 1), strip_lists(md)).otherwise(result(blanks(md), F.lit(0), F.lit(0)))


def clean_embedded_markdown(md: Column) -> Column:
    """Tidy Markdown that a page carried in its data: template tail, admonitions, anchors, size hints."""
    closing = "</RenderMd>"  # fixed value: the template's end tag
    head = F.substring_index(md, closing, 1)
    tail = r"\n[\s`}]*>\s*\z"
    body = F.when(F.contains(md, F.lit(closing)) & head.rlike(tail), F.regexp_replace(head, tail, "")).otherwise(md)

    def admonition(line: Column) -> Column:
        name = F.rtrim(F.translate(F.substring(line, F.lit(4), F.length(line)), "\t", " "))
        return (F.when(~line.startswith(":::"), line).when(name == "", "")
                .when(name.rlike(rf"\A[{WORD}]+\z"), F.concat(F.lit("> **"), name, F.lit("**:"))).otherwise(line))

    def anchor(span: Column) -> Column:
        inside = strip(F.substring_index(F.substring(span, F.lit(6), F.length(span)), ">", 1))
        return F.when(inside.startswith('id="') & (F.locate('"', inside, 5) == F.length(inside)), "").otherwise(span)

    lines = F.array_join(F.transform(F.split(body, "\n"), admonition), "\n")
    spans = splice(lines, r"<span\b[^>]*>\s*</span>", anchor)
    return strip(splice(spans, r"!\[[^\]]*\]\([^)]+\)", lambda image: F.regexp_replace(image, r"\s+=\d+x\d*\s*\)\z", ")")))


# --- link and image destinations ------------------------------------------------------------------------------

def redact_destinations(md: Column) -> Column:
    """Redact http(s) link destinations and src/href attributes; bare URLs in the text stay."""
    dest = r"""\]\(\s*<?https?://[^)\s>]+>?(?:\s+"[^"]*")?\s*\)"""
    attr = r"""\b(?:src|href)=['"]https?://[^'"]+['"]"""

    def link(p: Column) -> Column:
        url = F.regexp_extract(p, r"(https?://[^)\s>]+)", 1)
        title = F.regexp_extract(p, r"""(\s+"[^"]*")\s*\)\z""", 1)
        left = F.when(p.rlike(r"\A\]\(\s*<"), F.lit("<")).otherwise(F.lit(""))
        right = F.when(p.rlike(r"""\A\]\(\s*<?https?://[^)\s>]+>"""), F.lit(">")).otherwise(F.lit(""))
        return F.concat(F.lit("]("), left, urls.redact(url), right, title, F.lit(")"))

    def attribute(p: Column) -> Column:
        return F.concat(F.regexp_extract(p, r"""\A([a-z]+=['"])""", 1),
                        urls.redact(F.regexp_extract(p, r"""(https?://[^'"]+)""", 1)), F.right(p, F.lit(1)))

    return splice(splice(md, dest, link), attr, attribute)


def bare_destination(inner: Column) -> Column:
    """Destination inside the parentheses of an image, without size hint and title."""
    sized = F.regexp_replace(F.trim(inner), r"\s+=\d+x\d*\s*$", "")
    return strip(F.regexp_replace(strip(sized), r"""\s+["'][^"']*["']\s*$""", ""))


def image_urls(md: Column, base: Column) -> Column:
    """Absolute image URLs in order; relative ones need a base, data URIs are dropped."""
    def absolute(raw: Column) -> Column:
        url = bare_destination(raw)
        joined = urls.join_url(base, url)
        return F.when(url.rlike("^https?://"), url).when(
            (url != "") & (F.coalesce(base, F.lit("")) != "") & ~url.startswith("data:") & joined.rlike("^https?://"),
            joined)
    found = F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.array_compact(F.transform(found, absolute))


def absolute_images(md: Column, base: Column) -> Column:
    """Rewrite relative image destinations against the page URL; the title stays, the size hint goes."""
    def run(p: Column) -> Column:
        inner = F.regexp_extract(p, r"(?s)\A!\[[^\]]*\]\(([^)]+)\)\z", 1)
        sized = strip(F.regexp_replace(strip(inner), r"\s+=\d+x\d*\s*$", ""))
        title = F.regexp_extract(sized, r"""(\s+["'][^"']*["']\s*)$""", 1)
        url = bare_destination(inner)
        joined = urls.join_url(base, url)
        front = F.regexp_extract(p, r"(?s)\A(!\[[^\]]*\]\()", 1)
        return F.when(url.rlike("^(?:https?://|data:)") | ~joined.rlike("^https?://"), p).otherwise(
            F.concat(front, joined, title, F.lit(")")))
    return F.when(F.coalesce(base, F.lit("")) != "", splice(md, IMAGE, run)).otherwise(md)


def shared_asset_paths(md: Column, folder: str) -> Column:
    """Point ``x.assets/`` references at one shared folder, in Markdown and in HTML images."""
    safe = folder.replace("\\", "/")

    def moved(target: Column) -> Column:
        first = F.substring_index(target, "/", 1)
        own = first.endswith(".assets") & (F.length(first) > len(".assets")) & (F.length(target) > F.length(first) + 1)
        return F.when(own, F.concat(F.lit(safe), F.substring(target, F.length(first) + 1, F.length(target)))).otherwise(target)

    def image(piece: Column) -> Column:
        target = F.regexp_extract(piece, r"(?s)\]\((.*)\)\z", 1)
        return F.concat(F.substring(piece, F.lit(1), F.length(piece) - F.length(target) - 1), moved(target), F.lit(")"))

    def tag(piece: Column) -> Column:
        found = F.regexp_extract(piece, r"""src=["']([^"']*)""", 1)
        return F.when(found != "", F.replace(piece, found, moved(found))).otherwise(piece)
    return splice(splice(md, r"!\[[^\]]*\]\([^)]+\)", image), r"<img\b[^>]*>", tag)


# --- quality signals ------------------------------------------------------------------------------------------

def link_density(md: Column) -> Column:
    """Struct(density, links, chars)."""
    found = F.regexp_extract_all(md, F.lit(LINK), F.lit(0))
    chars = F.length(md)
    in_links = F.length(F.array_join(found, ""))
    density = F.when(chars > 0, in_links / chars).otherwise(F.lit(0.0))
    return F.struct(density.alias("density"), F.size(found).alias("links"), chars.alias("chars"))


def quality_warnings(md: Column, limit: float = 0.5, run: int = 10) -> Column:
    blocks = F.size(F.regexp_extract_all(md, F.lit(rf"(?m)(?:^[ \t]*[-*][{WS}]*{LINK}[{WS}]*\n){{{run},}}+"), F.lit(0)))
    return F.array_compact(F.array(
        F.when(link_density(md)["density"] > limit, F.lit("link_density")),
        F.when(blocks > 0, F.concat(F.lit("link_list_blocks:"), blocks.cast("string")))))
