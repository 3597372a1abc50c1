"""URLs as columns: identity, registrable domain, locale and kind of page.

All of them are built-in expressions, so they stay in generated code. A URL
that cannot be parsed, and a null one, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under a country's domain that are public suffixes (fixed values).
PUBLIC_SECOND = ("co", "com", "org", "net", "ac")
#: First labels of hosts that hold documentation (fixed values).
DOC_LABELS = ("docs", "doc", "help", "support", "developer", "developers", "dev", "api", "kb", "knowledge", "learn", "academy", "guide", "guides", "trust", "security", "status-docs")
#: Languages whose code as a path segment marks a translated page (fixed values).
LOCALES = ("de", "fr", "es", "it", "pt", "nl", "ja", "ko", "zh", "sv", "da", "no", "fi", "pl", "tr", "ru", "ar", "he", "id", "th", "vi", "cs", "hu", "ro", "br")
#: File endings of what is no page (fixed values).
ASSETS = r"\.(pdf|png|jpe?g|svg|css|js|webp|gif|zip|xml|ico|mp4|mp3|woff2?|json|txt)$"
#: Which path segments name which kind of page, the kinds in the order of precedence; * stands for any letters (fixed values).
PAGE_KINDS = {
    "excluded": "careers career jobs legal privacy privacy-policy terms* cookie* login log-in signin sign-in signup sign-up register app demo get-demo book-a-demo request-demo schedule-demo watch-product-tour contact* lp thank-you* search tag tags category categories author authors page feed rss cdn-cgi wp-* *-tos *terms-and-conditions* master-agreement anti-slavery unsubscribe status *sitemap* blog-author blog-category blog-tag",
    "editorial": "blog blogs blog-* news press press-releases newsroom events event webinar* podcast* video videos community champions-of-change churnfm *-conference*",
    "docs": "docs doc documentation api api-reference developers developer reference hc help support knowledge-base kb changelog release-notes",
    "customers": "customers customer customer-stories case-studies case-study success-stories testimonials",
    "comparison": "compare comparison compare-competitors vs alternatives alternative *-vs-* *-alternative *-alternatives",
    "pricing": "pricing plans price",
    "security": "security trust trust-center compliance gdpr soc-2 soc2",
    "integrations": "integrations integration connectors connector apps marketplace app-marketplace",
    "resources": "resources resource guides guide glossary glossaries white-papers whitepapers white-paper ebook ebooks research reports report faq faqs buyers-guide infographics tools templates saas-metrics-hub learn academy",
    "company": "about about-us company partners partner leadership team investors",
    "product": "products product platform features feature capabilities modules solutions solution use-cases usecases use-case usecase industries industry roles role why-* how-it-works product-tour overview",
}
#: Segments whose kind only counts where no later segment names one (fixed values).
CONTAINERS = ("resources", "resource", "products", "product", "platform", "learn")


def host(url: Column) -> Column:
    """The host in lower case without port; the empty host is null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def bare_host(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), "^www\\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    """The path's segments in lower case."""
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def _english(segment: Column) -> Column:
    return segment.rlike("^en(?:[-_][a-z]{2})?$")


def page_key(url: Column) -> Column:
    """What makes a page one: host without www and path, without one English locale among the first two segments, query and fragment."""
    parts = segments(url)
    at = F.when(_english(F.get(parts, F.lit(0))), 0).when(_english(F.get(parts, F.lit(1))), 1).otherwise(-1)
    kept = F.filter(parts, lambda s, i: i != at)
    return F.concat(bare_host(host(url)), F.lit("/"), F.array_join(kept, "/"))


def clean(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def locale_rank(url: Column) -> Column:
    """Which copy of a page to keep: 0 without locale, 1 plain or US English, 2 another English."""
    first = F.get(F.filter(F.slice(segments(url), 1, 2), _english), F.lit(0))
    return F.when(first.isNull(), 0).when(first.isin("en", "en-us", "en_us"), 1).otherwise(2)


def registrable(h: Column) -> Column:
    """The registrable part of a host: two labels, three under a country's public second level."""
    labels = F.split(F.regexp_replace(F.lower(h), ":.*$", ""), "\\.")
    n = F.size(labels)
    three = (n >= 3) & F.get(labels, n - 2).isin(*PUBLIC_SECOND) & (F.length(F.get(labels, n - 1)) == 2)
    keep = F.when(three, 3).otherwise(F.least(n, F.lit(2)))
    return F.array_join(F.slice(labels, n - keep + 1, keep), ".")


def host_role(h: Column, site: Column) -> Column:
    """``site`` for the site's own host, ``docs`` for a documentation host of it, else null."""
    first = F.element_at(F.split(bare_host(h), "\\."), 1)
    docs = first.isin(*DOC_LABELS) | first.contains("docs") | first.startswith("help") | first.startswith("support")
    return F.when(bare_host(h) == bare_host(site), "site").when((registrable(h) == registrable(site)) & docs, "docs")


def is_translation(url: Column) -> Column:
    """Whether one of the first two segments is a locale that is not English."""
    return F.exists(F.slice(segments(url), 1, 2), lambda s: s.rlike("^[a-z]{2}(?:[-_][a-z]{2})?$") & ~s.isin("en", "en-us", "en-gb", "en_us", "en_gb") & F.substring(s, 1, 2).isin(*LOCALES))


def _pattern(hints: str) -> str:
    return "^(?:" + "|".join(h.replace("*", ".*") for h in hints.split()) + ")$"


def segment_kind(segment: Column) -> Column:
    """The first kind of PAGE_KINDS that names the segment, null for none."""
    out = None
    for kind, hints in PAGE_KINDS.items():
        out = F.when(segment.rlike(_pattern(hints)), kind) if out is None else out.when(segment.rlike(_pattern(hints)), kind)
    return out


def page_kind(url: Column, site: Column) -> Column:
    """The kind of a page of a site, null where it should not be read.

    Segments are read from left to right, and the first that names a kind
    decides; containers only where no other does. An excluded segment anywhere, an asset, a translation or
    another company's host gives null.
    """
    parts = segments(url)
    kinds = F.filter(F.transform(parts, lambda s: F.struct(s.alias("s"), segment_kind(s).alias("k"))), lambda x: x["k"].isNotNull())
    role = host_role(host(url), site)
    unread = ~F.lower(url).rlike("^https?://") | role.isNull() | F.lower(path(url)).rlike(ASSETS) | is_translation(url) | F.exists(kinds, lambda x: x["k"] == "excluded")
    first = F.get(F.filter(kinds, lambda x: ~x["s"].isin(*CONTAINERS)), F.lit(0))["k"]
    named = F.coalesce(first, F.get(kinds, F.lit(0))["k"], F.lit("other"))
    return F.when(unread, F.lit(None)).when((role == "site") & (F.size(parts) == 0), "home").when(role == "docs", "docs").otherwise(named)


def suffixes(h: Column) -> Column:
    """All dotted endings of a host with two labels or more, the longest first."""
    labels = F.split(bare_host(h), "\\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def label(h: Column) -> Column:
    """The first label of a host without www."""
    return F.element_at(F.split(bare_host(h), "\\."), 1)
