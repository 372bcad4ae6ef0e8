"""Page classification: challenge pages, messenger and workspace pages, documentation frameworks, thin content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import any_contains, bind, squeeze, strip
from pagemill.operators import titles

# --- challenge pages ------------------------------------------------------------------------------------------

# Signal name -> what raises it, in reporting order.
CHALLENGE_TITLES = [("just a moment", "title: just a moment"), ("checking your browser", "title: checking your browser"),
                    ("attention required", "title: attention required"), ("ddos protection", "title: ddos protection")]
SCRIPT_REQUIRED = [(r"javascript\s+is\s+(disabled|required)", "script required"),
                   (r"please\s+(enable|turn\s+on)\s+javascript", "please enable script"),
                   (r"browser.*does\s+not\s+support.*javascript", "script unsupported")]
SHORT_TEXT_WORDS = ["browser", "javascript", "enable", "loading", "redirect", "verify"]
STRONG_SIGNAL = r"cloudflare|akamai|perimeterx|just a moment|attention required|ddos"
WEAK_HINTS = ["just a moment", "checking your browser", "cf-browser-verification", "cf_chl_opt", "__cf_chl",
              "cloudflare", "安全验证", "正在进行安全", "请稍候", "please wait"]


def visible_text(html: Column) -> Column:
    """Rough page text: scripts, styles, comments and tags removed, white space collapsed."""
    for pattern, new in [(r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
                         (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", " ")]:
        html = F.regexp_replace(html, pattern, new)
    return squeeze(html)


def challenge(html: Column, title: Column | None = None) -> Column:
    """STRUCT<is_challenge, confidence, signals>."""
    return bind(F.lower(html), lambda low: _challenge(html, low, title))


def _challenge(html: Column, low_html: Column, title: Column | None) -> Column:
    low_title = F.lower(F.coalesce(title if title is not None else titles.title_tag(html), F.lit("")))

    def first_of(options, hit):
        return F.coalesce(*[F.when(hit(what), F.lit(label)) for what, label in options], F.lit(None).cast("string"))

    def short(text: Column) -> Column:
        words = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in SHORT_TEXT_WORDS]))
        return F.when((F.length(text) < 200) & (F.size(words) > 0), F.concat(
            F.lit("short text ("), F.length(text).cast("string"), F.lit("): "), F.array_join(words, ", ")))

    noscript = F.lower(F.regexp_extract(html, r"(?is)<noscript[^>]*>(.*?)</noscript>", 1))
    signals = F.array_compact(F.array(
        F.when(any_contains(html, ["__cf_chl_opt", "cf-browser-verification"]), "cloudflare marker"),
        F.when(F.contains(html, F.lit("challenges.cloudflare.com")), "cloudflare domain"),
        first_of(CHALLENGE_TITLES, lambda w: F.contains(low_title, F.lit(w))),
        first_of(SCRIPT_REQUIRED, lambda p: low_html.rlike(p)),
        F.when(F.contains(low_html, F.lit("akamai")) & any_contains(low_html, ["bot", "challenge"]), "akamai"),
        F.when(F.contains(html, F.lit("_pxhd")) | F.contains(low_html, F.lit("perimeterx")), "perimeterx"),
        bind(visible_text(html), short),
        F.when(any_contains(noscript, ["javascript", "enable"]), "noscript warning"),
    ))

    def verdict(found: Column) -> Column:
        strong = F.exists(found, lambda s: s.rlike(STRONG_SIGNAL)) | (F.size(found) >= 2)
        level = F.when(F.size(found) == 0, "none").when(strong, "high").otherwise("medium")
        return F.struct((F.size(found) > 0).alias("is_challenge"), level.alias("confidence"), found.alias("signals"))

    return bind(signals, verdict)


def weak_challenge(html: Column, head: int = 0, below: int = 0) -> Column:
    """Hints of a challenge page. ``head``: look at the first characters only; ``below``: longer pages are none (0: no bound)."""
    hit = any_contains(F.lower(F.substring(html, 1, head) if head > 0 else html), WEAK_HINTS)
    return hit & (F.length(html) < below) if below > 0 else hit


def gate_error(verdict: Column, has_embedded_article: Column, force: bool = False) -> Column:
    """Error text for a page that must not be used, NULL for a usable one."""
    if force:
        return F.lit(None).cast("string")
    return F.when(verdict["is_challenge"] & ~has_embedded_article,
                  F.concat(F.lit("challenge page, confidence "), verdict["confidence"]))


# --- sites with their own rules -------------------------------------------------------------------------------

def is_messenger_url(url: Column) -> Column:
    # Article hosts.
    return urls.authority(url).isin("mp.weixin.qq.com", "weixin.qq.com")


def is_messenger_html(html: Column) -> Column:
    # Markers, compared in lower case.
    return any_contains(F.lower(html), ['class="rich_media_content"', "class='rich_media_content'", 'id="js_article"',
                                        'data-mptype="article"', "var biz =", "__biz", "mp.weixin.qq.com"])


def is_async_article(html: Column) -> Column:
    flag = F.regexp_extract(html, r"""is_async\s*:\s*['"]?(\d+)['"]?""", 1)
    return (F.contains(html, F.lit("window.cgiDataNew"))
            & ~any_contains(html, ['class="rich_media_content', 'id="js_content"']) & (flag == "1"))


def workspace_page_id(url: Column) -> Column:
    """Dashed id from the last 32 hexadecimal digits of the path, NULL when there is none."""
    bare = F.replace(F.regexp_replace(urls.path(url), "/+$", ""), F.lit("-"), F.lit(""))
    raw = F.nullif(F.regexp_extract(bare, r"([0-9a-f]{32})$", 1), F.lit(""))
    return bind(raw, lambda r: F.when(r.isNotNull(), F.concat_ws(
        "-", *[F.substring(r, a, n) for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])))


def is_workspace_url(url: Column) -> Column:
    # Workspace hosts.
    hosts = r"^(?:(?:www\.)?notion\.so|[\p{L}\p{N}_\-]+\.notion\.site)$"
    return (urls.scheme(url).isin("http", "https") & urls.host(url).rlike(hosts)
            & ~urls.path(url).isin("", "/") & workspace_page_id(url).isNotNull())


# --- documentation frameworks ---------------------------------------------------------------------------------

# The framework presets, in the order that breaks ties.
PRESETS = [
    {"name": "docusaurus", "description": "Docusaurus (Meta/Facebook)",
     "patterns": ["docusaurus", "__docusaurus"], "classes": ["docusaurus-wrapper", "theme-doc-markdown"],
     "meta": ["generator.*docusaurus"], "target_ids": ["__docusaurus_skipToContent_fallback"],
     "target_classes": ["theme-doc-markdown", "markdown", "docMainContainer"],
     "exclude": [".theme-doc-sidebar-container", ".pagination-nav", ".theme-doc-toc-mobile", ".theme-doc-toc-desktop",
                 ".theme-doc-breadcrumbs", "nav", "aside", ".table-of-contents"]},
    {"name": "mintlify", "description": "Mintlify",
     "patterns": ["mintlify", "mintcdn.com"], "classes": ["mintlify"], "meta": [], "target_ids": ["content-area"],
     "target_classes": ["prose", "article-content", "markdown-body"],
     "exclude": ["nav", "aside", ".sidebar", ".on-this-page", ".page-navigation", "[data-testid='sidebar']"]},
    {"name": "gitbook", "description": "GitBook",
     "patterns": ["gitbook", "app.gitbook.com"], "classes": ["gb-root", "gitbook-root"], "meta": ["generator.*gitbook"],
     "target_ids": [], "target_classes": ["markdown-section", "page-inner", "book-body"],
     "exclude": [".book-summary", ".navigation", "nav", ".page-toc"]},
    {"name": "vuepress", "description": "VuePress",
     "patterns": ["vuepress", "VuePress"], "classes": ["theme-default-content", "vuepress"],
     "meta": ["generator.*vuepress"], "target_ids": [],
     "target_classes": ["theme-default-content", "page", "content__default"],
     "exclude": [".sidebar", ".page-nav", ".page-edit", "nav", ".table-of-contents"]},
    {"name": "mkdocs", "description": "MkDocs / Material for MkDocs",
     "patterns": ["mkdocs", "MkDocs"], "classes": ["md-content", "md-main"], "meta": ["generator.*mkdocs"],
     "target_ids": ["content"], "target_classes": ["md-content__inner", "md-typeset", "rst-content"],
     "exclude": [".md-sidebar", ".md-nav", ".md-footer", ".md-header", "nav"]},
    {"name": "readthedocs", "description": "Read the Docs / Sphinx",
     "patterns": ["readthedocs", "sphinx", "Read the Docs"], "classes": ["rst-content", "wy-nav-content"],
     "meta": ["generator.*sphinx"], "target_ids": [], "target_classes": ["rst-content", "document", "body"],
     "exclude": [".wy-nav-side", ".wy-side-nav-search", ".rst-versions", "nav", ".toctree-wrapper"]},
    {"name": "notion", "description": "Notion (exported or public pages)",
     "patterns": ["notion.so", "notion-static"], "classes": ["notion-page-content", "notion-app"], "meta": [],
     "target_ids": [], "target_classes": ["notion-page-content", "notion-scroller"],
     "exclude": [".notion-sidebar", ".notion-topbar", "nav"]},
    {"name": "confluence", "description": "Atlassian Confluence",
     "patterns": ["confluence", "atlassian"], "classes": ["wiki-content", "confluence-content"], "meta": [],
     "target_ids": ["main-content", "content"], "target_classes": ["wiki-content", "confluence-content-body"],
     "exclude": ["#navigation", ".aui-sidebar", ".page-metadata", "nav"]},
    {"name": "sphinx", "description": "Sphinx documentation",
     "patterns": ["sphinx", "Sphinx"], "classes": ["sphinxsidebar", "document"], "meta": ["generator.*sphinx"],
     "target_ids": ["content", "main-content"], "target_classes": ["document", "body", "rst-content"],
     "exclude": [".sphinxsidebar", ".sphinxsidebarwrapper", ".related", "nav", ".toctree-wrapper"]},
    {"name": "generic", "description": "Generic documentation site",
     "patterns": [], "classes": [], "meta": [], "target_ids": ["content", "main-content", "main"],
     "target_classes": ["content", "main-content", "article-content", "markdown-body"],
     "exclude": ["nav", "aside", ".sidebar", ".navigation", ".toc", ".table-of-contents"]},
]
# Weights and thresholds of the framework score.
PATTERN_WEIGHT, CLASS_WEIGHT, META_WEIGHT = 30, 25, 35
KEEP_SCORE, APPLY_SCORE = 20, 60


def framework(html: Column) -> Column:
    """STRUCT<name, score, signals> of the best preset; the name is NULL below the keep score.

    The presets are a fixed list of options, so each page is scored in place: no join and no shuffle. Scores are
    counted in hundredths to keep ties exact.
    """
    return bind(F.lower(html), lambda low: _framework(html, low))


def _framework(html: Column, low: Column) -> Column:
    candidates = []
    for rank, preset in enumerate(PRESETS):
        signals = [(F.contains(low, F.lit(p.lower())), PATTERN_WEIGHT, f"pattern:{p}") for p in preset["patterns"]]
        signals += [(any_contains(html, [f'class="{c}"', f"class='{c}'", f" {c}"]), CLASS_WEIGHT, f"class:{c}")
                    for c in preset["classes"]]
        signals += [(html.rlike(f"(?i){m}"), META_WEIGHT, f"meta:{m}") for m in preset["meta"]]
        if not signals:
            continue
        found = F.array_compact(F.array(*[
            F.when(hit, F.struct(F.lit(weight).alias("weight"), F.lit(label).alias("label"))) for hit, weight, label in signals]))
        total = F.least(F.lit(100), F.aggregate(found, F.lit(0), lambda acc, s: acc + s["weight"]))
        candidates.append(F.struct(total.alias("score"), F.lit(-rank).alias("rank"), F.lit(preset["name"]).alias("name"),
                                   F.transform(found, lambda s: s["label"]).alias("signals")))
    best = F.array_max(F.array(*candidates))
    return bind(best, lambda b: F.when(b["score"] >= KEEP_SCORE, F.struct(
        b["name"].alias("name"), (b["score"] / 100).alias("score"), b["signals"].alias("signals"))).otherwise(F.struct(
            F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("score"),
            F.array().cast("array<string>").alias("signals"))))


def applied_preset(found: Column) -> Column:
    """Preset name to apply automatically, NULL when the score is too low."""
    return F.when(F.round(found["score"] * 100) >= APPLY_SCORE, found["name"])


def preset_table(spark) -> DataFrame:
    """The presets as a small dimension table (ten rows)."""
    rows = [(i, p["name"], p["description"], p["target_ids"], p["target_classes"], p["exclude"]) for i, p in enumerate(PRESETS)]
    return spark.createDataFrame(rows, "ord int, preset string, description string, target_ids array<string>, "
                                       "target_classes array<string>, exclude array<string>")


def with_preset_options(pages: DataFrame, name: str = "preset") -> DataFrame:
    """Left join to the ten-row preset table; names are compared in lower case."""
    table = F.broadcast(preset_table(pages.sparkSession).withColumnRenamed("preset", "_preset"))
    return pages.join(table, F.lower(F.col(name)) == F.col("_preset"), "left").drop("_preset", "ord")


# --- body gates -----------------------------------------------------------------------------------------------

def body_gate(md: Column) -> Column:
    """'empty' (a failure), 'short' (a warning below 50 characters) or NULL."""
    size = F.length(strip(F.coalesce(md, F.lit(""))))
    return F.when(size == 0, "empty").when(size < 50, "short")


def client_rendered(text_len: Column) -> Column:
    """Pages with hardly any text are probably drawn by scripts."""
    return text_len < 500
