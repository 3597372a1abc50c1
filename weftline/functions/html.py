"""HTML parsed once per page with the standard library, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = frozenset("script style svg noscript template iframe video audio canvas".split())
_CHROME = frozenset("header nav footer".split())
#: What furniture is called: a part of a class or id, or all of it; roles and elements that are furniture; and the share of a page's text that makes an element no furniture (fixed values).
NOISE_PARTS = frozenset("skip search modal popup cookie cookies consent newsletter subscribe share sharing breadcrumb breadcrumbs comment comments related offcanvas".split())
NOISE_NAMES = frozenset("screen-reader-text sr-only visually-hidden off-canvas".split())
NOISE_ROLES = frozenset("dialog alertdialog search complementary".split())
NOISE_TAGS = frozenset("form dialog aside".split())
MOST_NOISE = 0.4
_NAME_PARTS = re.compile(r"[-_\s]+")
_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt figcaption".split())
_VOID = frozenset("br img input meta link hr source area base col embed wbr track".split())
#: Marks of pages that ask for proof of a human instead of showing content, with their makers (fixed values).
CHALLENGES = {"cloudflare": ("cf-challenge", "just a moment...", "cf_chl_"), "datadome": ("datadome",), "perimeterx": ("px-captcha",), "akamai": ("ak_bmsc challenge", "/_sec/cp_challenge"), "imperva": ("_incapsula_resource",)}
_ASSET = re.compile(r"\.(pdf|png|jpe?g|svg|css|js|webp|gif|zip|xml|ico|mp4|mp3|woff2?|json|txt)$", re.I)


def _is_noise(tag: str, a: dict[str, str | None]) -> bool:
    """Whether an element is furniture by its name, role, classes or id."""
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in NOISE_TAGS or (a.get("role") or "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-modal") == "true":
        return True
    names = [*(a.get("class") or "").lower().split(), (a.get("id") or "").lower()]
    return any(n in NOISE_NAMES or NOISE_PARTS.intersection(_NAME_PARTS.split(n)) for n in names if n)


class Page(HTMLParser):
    """Title, meta description, blocks of prose outside the page chrome and furniture, links and embedded data of one page.

    Whether an element is furniture shows only at its end: one that holds the
    main part, or more than MOST_NOISE of the text, is none. So blocks note the
    open elements that may be, and those that were are taken out at the end.
    """

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.title = self.og = self.description = ""
        self.blocks: list[tuple[str, str]] = []
        #: per block the elements around it that may be furniture; per such element its text's length, and whether it holds the main part
        self.around: list[tuple[int, ...]] = []
        self.noise: list[list] = []
        self.inside: list[int] = []
        self.letters = 0
        self.links: list[tuple[str, str]] = []
        self.data: list[str] = []
        self.items: list[str] = []
        self.open: list[str] = []
        self.skip = self.chrome = 0
        self.words: list[str] = []
        self.link: list | None = None
        self.json: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if a.get("itemtype"):
            self.items.append(re.split(r"[/:]", a["itemtype"].rstrip("/"))[-1])
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name == "og:title":
                self.og = a.get("content") or ""
            elif name == "description":
                self.description = a.get("content") or ""
        if tag == "a" and a.get("href"):
            self.link = [a["href"], []]
        if tag in _VOID:
            if tag == "br":
                self.words.append("\n")
            return
        if tag == "script" and "ld+json" in (a.get("type") or ""):
            self.json = []
        self.skip += tag in _SKIP
        self.chrome += tag in _CHROME
        if tag in _BLOCKS or tag in ("div", "section", "table", "ul", "ol", "tr"):
            self.flush()
        if tag in ("main", "article") or (a.get("role") or "").lower() == "main":
            for i in self.inside:
                if i >= 0:
                    self.noise[i][1] = True
        self.inside.append(-1)
        if _is_noise(tag, a):
            self.flush()
            self.inside[-1] = len(self.noise)
            self.noise.append([0, False])
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())[:120]))
            self.link = None
        if tag == "script" and self.json is not None:
            self.data.append("".join(self.json))
            self.json = None
        if tag in _BLOCKS or tag in ("div", "section", "table", "ul", "ol", "tr", "body"):
            self.flush(tag)
        elif self.inside[-1] >= 0:
            self.flush()
        while self.open:
            top = self.open.pop()
            if self.inside[-1] >= 0:
                self.flush()
            self.inside.pop()
            self.skip -= top in _SKIP
            self.chrome -= top in _CHROME
            if top == tag:
                break

    def handle_data(self, data):
        if self.json is not None:
            self.json.append(data)
        elif self.open and self.open[-1] == "title":
            self.title += data
        elif not self.skip:
            if self.link is not None:
                self.link[1].append(data)
            if not self.chrome:
                self.words.append(data)

    def flush(self, tag: str = ""):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.blocks.append((tag or (self.open[-1] if self.open else ""), text))
            around = tuple(i for i in self.inside if i >= 0)
            self.around.append(around)
            self.letters += len(text)
            for i in around:
                self.noise[i][0] += len(text)

    def kept(self) -> list[tuple[str, str]]:
        """The blocks that stand in no furniture."""
        gone = {i for i, (held, main) in enumerate(self.noise) if not main and held <= MOST_NOISE * self.letters}
        return [b for b, around in zip(self.blocks, self.around) if gone.isdisjoint(around)]

    def schema_types(self) -> list[str]:
        out = list(self.items)

        def walk(x):
            if isinstance(x, dict):
                kinds = x.get("@type") or []
                out.extend(re.split(r"[/:]", str(k).rstrip("/"))[-1] for k in (kinds if isinstance(kinds, list) else [kinds]))
                for v in x.values():
                    walk(v)
            elif isinstance(x, list):
                for v in x:
                    walk(v)

        for raw in self.data:
            try:
                walk(json.loads(raw))
            except ValueError:
                continue
        return list(dict.fromkeys(out))

    def internal_links(self) -> list[tuple[str, str]]:
        """Links to pages of the same host, each once, in order, without fragment, mail, script and asset links."""
        here = urlparse(self.url or "").netloc.lower().removeprefix("www.")
        seen: dict[str, str] = {}
        for href, text in self.links:
            href = href.strip()
            if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
                continue
            try:
                full = urldefrag(urljoin(self.url or "", href))[0]
                at = urlparse(full)
            except ValueError:
                continue
            if at.scheme in ("http", "https") and at.netloc.lower().removeprefix("www.") == here and not _ASSET.search(at.path):
                seen.setdefault(full, text)
        return list(seen.items())


def parse(html: str | None, url: str | None = None) -> Page:
    page = Page(url or "")
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    page.flush()
    return page


def challenge(html: str | None, status: int | None = None) -> str | None:
    """Whose challenge page it is, null for content: a short body with a maker's mark, or ``unknown`` for a refusing status."""
    low = (html or "").lower()
    if len(low) <= 64_000:
        for maker, marks in CHALLENGES.items():
            if any(m in low for m in marks):
                return maker
    return "unknown" if status in (403, 429, 503) else None


_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor", T.StringType())])
_OUT = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("schema_types", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(_LINK)), T.StructField("challenge", T.StringType())])
_ARROW = pa.schema([("url", pa.string()), ("title", pa.string()), ("description", pa.string()), ("headings", pa.list_(pa.string())), ("text", pa.string()), ("blocks", pa.list_(pa.string())), ("schema_types", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.string())]))), ("challenge", pa.string())])


def pages(rows: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, title, description, headings, text, blocks, schema_types, links, challenge) of every page.

    text is what stands outside navigation, header, footer, scripts and page
    furniture (overlays, forms, notices, related posts, by role, class or id),
    a line per block; headings are the first eight of level one and two. A null page gives an empty one; broken markup is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = parse(h, u)
                blocks = p.kept()
                texts = [t for _, t in blocks]
                heads = [t for k, t in blocks if k in ("h1", "h2") and len(t) > 3][:8]
                out.append({"url": u, "title": " ".join((p.title or p.og).split()), "description": p.description, "headings": heads, "text": "\n".join(texts), "blocks": texts, "schema_types": p.schema_types(), "links": [{"url": x, "anchor": y} for x, y in p.internal_links()], "challenge": challenge(h)})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(run, _OUT)
