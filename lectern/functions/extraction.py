"""Text and links out of HTML: regular expressions where they do, a tag parser in Arrow batches where selectors are needed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dom import Node, parsed
from lectern.functions.shipping import map_arrow
from lectern.functions.text import collapsed, stripped
from lectern.functions.values import clean_speaker, none_if_blank, parsed_date, speaker_from_url, url_date

# Tags whose content isn't text; selectors tried in order and those of junk; titles, places and people; patterns of lines to drop; topic keywords.
SKIPPED = ("script", "style", "nav", "header", "footer", ".navigation", "noscript")
DROPPED_LINES = [r"(?i)^(home|about|contact|search|menu|navigation|skip to.*)$", r"(?i)^(copyright|©).*", r"^\d+$", r"^[^\p{L}\p{N}]+$"]
BOILERPLATE = [r"Board of Governors of the Federal Reserve System.*?", r"Federal Reserve Bank of.*?", r"Last update:.*?"]
LONGEST_SELECTORS = ("div#article", ".article-content", ".speech-content", '[role="main"]', "main", "article", ".col-md-8", ".content-area", "#main-content")
PREFERRED_SELECTORS = (
    "div.main-content", ".speech-content", ".article-content", '[role="main"]', "main", "article", ".content-area", "#main-content", ".page-content", ".speech-text", ".text-content",
    ".body-content", "#content", ".entry-content", ".post-content",
)
FIRST_SELECTORS = ("main", "article", ".content", "#content", ".speech-content", ".text-content", ".body-content")
LEGACY_SELECTORS = (
    "div.rich-text", "div.content-section", "article.article-content", "div.main-content", "div#main-content", "div.page-body", "div.body-text", 'div[itemprop="articleBody"]', "main",
    "div.col-md-9", "div.col-lg-8", "div.page-row--content",
)
JUNK = (
    "nav", "footer", "header", "aside", ".cookie-banner", ".related-content", ".share-buttons", ".back-to-top", ".print-button", ".hidden-print", ".page-tools", ".page-meta", "form", "script",
    "style", "noscript", "img", "svg", "iframe", "sup", 'a[href="#main-content"]', ".site-search", ".site-header", ".site-footer", ".social-media-links", ".search-container", ".breadcrumb", ".hero-banner",
)
UNWANTED = ("cookie", "javascript", "skip to", "navigation")
TITLE_SELECTORS = ("h1.article-title", "h1.speech-title", "h1", ".speech-title", ".article-header h1", "h2.title", ".page-header h1", ".main-title", '[class*="title"]', ".entry-title", ".post-title")
META_TITLES = ("og:title", "twitter:title", "title")
SITE_NAME, NO_TITLE, HOME = "Bank of England", "Untitled Speech", "London, UK"
LOCATION_SELECTORS = (".speech-location", ".event-location", ".venue", ".location")
VENUES = "(?:University|College|Institute|Center|Centre|Hotel|Club|Conference|School|Hall|House)"
LOCATION_PATTERNS = (
    rf"(?:delivered at|speaking at|remarks at|given at)\s+([A-Z][a-zA-Z\s,&]+{VENUES})",
    r"(?:London|Birmingham|Manchester|Edinburgh|Cardiff|Belfast),?\s*(?:UK|England|Scotland|Wales)",
)
LINE_LOCATIONS = (
    (rf"(?:at|in)\s+([A-Z][a-zA-Z\s,&]+{VENUES})", True), (r"(?:delivered at|speaking at|remarks at|given at)\s+([A-Z][a-zA-Z\s,&]{5,50})", True),
    (r"(?:London|Birmingham|Manchester|Edinburgh|Cardiff|Belfast|Liverpool|Bristol|Leeds|Sheffield),?\s*(?:UK|England|Scotland|Wales)", False),
)
CONTEXT_SPEAKERS = (
    r"\b(?:Chair|Governor|President|Vice Chair)\s+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*[A-Z][a-z]*)*)", r"\b(?:By|Remarks by|Speech by)\s+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*[A-Z][a-z]*)*)",
    r"([A-Z][a-z]+(?:\s+[A-Z]\.?\s*[A-Z][a-z]*)*),?\s+(?:Chair|Governor|President|Vice Chair)",
)
CONTEXT_DATE = r"\b(\w+\s+\d{1,2},\s+\d{4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"


def title(html: Column) -> Column:
    """The first heading, else the title."""
    head = collapsed(F.regexp_replace(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    return F.coalesce(none_if_blank(head), none_if_blank(collapsed(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def absolute(link: Column, base: Column) -> Column:
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), link))


def paragraphs(html: Column, longer_than: int = 0) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), lambda p: collapsed(F.regexp_replace(p, "<[^>]+>", "")))
    return F.filter(found, lambda p: F.length(p) > longer_than)


def clean_lines(text: Column, shortest: int = 3, patterns: list[str] | None = None) -> Column:
    """Lines trimmed, short ones and those that match a pattern dropped, blanks collapsed."""
    lines = F.transform(F.split(text, "\n"), stripped)
    def good(x: Column) -> Column:
        ok = F.length(x) >= shortest
        for p in patterns or DROPPED_LINES:
            ok = ok & ~x.rlike(p)
        return ok
    return F.array_join(F.transform(F.filter(lines, good), lambda x: F.regexp_replace(x, "[ \t]+", " ")), "\n")


def clean_statement(text: Column, linewise: bool = False) -> Column:
    """White space collapsed and boilerplate cut.

    As collapsing comes first there is one line, and boilerplate takes all that follows it; with ``linewise`` it goes first
    and takes the rest of its line.
    """
    if not linewise:
        out = collapsed(text)
        for p in BOILERPLATE[:2]:
            out = F.regexp_replace(out, p.replace(".*?", ".*$"), "")
        return F.trim(out)
    out = text
    for p in BOILERPLATE:
        out = F.regexp_replace(out, p.replace(".*?", r"[^\n]*(\n|$)"), "\n")
    return collapsed(out)


def tags(text: Column, groups: dict[str, list[str]]) -> Column:
    low = F.lower(text)
    def some(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out
    return F.filter(F.array(*(F.when(some(w), F.lit(k)) for k, w in groups.items())), lambda k: k.isNotNull())


@dataclass(frozen=True)
class Profile:
    """How pages of one kind of site are read.

    ``choice``: longest (of selectors and paragraphs, else the body), preferred (a selector before paragraphs, the longest of
    them, nothing without either), first (the first selector there is, else the body; white space collapsed),
    legacy (the same with junk taken out inside, runs of white space made one).
    """

    choice: str
    selectors: tuple[str, ...]
    dropped: tuple[str, ...] = SKIPPED
    least: int = 500
    least_paragraphs: int = 500
    least_paragraph: int = 0
    unwanted: tuple[str, ...] = ()


PROFILES = {
    "longest": Profile("longest", LONGEST_SELECTORS),
    "preferred": Profile("preferred", PREFERRED_SELECTORS, (*SKIPPED, "aside"), least=300, least_paragraph=20, unwanted=UNWANTED),
    "first": Profile("first", FIRST_SELECTORS, ("script", "style")),
    "legacy": Profile("legacy", LEGACY_SELECTORS, JUNK),
}


def page_text(page: Node, profile: Profile) -> tuple[str, float]:
    """The text that ``profile`` finds in a page, and the confidence in it: 0.9 where a candidate was found, else 0.6. Drops elements."""
    if profile.choice != "legacy":
        page.drop(list(profile.dropped))
    body = page.first("body")
    if profile.choice in ("first", "legacy"):
        main = next((n for s in profile.selectors if (n := page.first(s)) is not None), None)
        found = main or body or (page if profile.choice == "first" else None)
        if found is None:
            return "", 0.6
        if profile.choice == "first":
            return " ".join(found.text(strip=False).split()), 0.9 if main else 0.6
        found.drop(list(profile.dropped))
        return re.sub(r"\s{2,}", " ", re.sub(r"\n\s*\n", "\n\n", found.text("\n"))).strip(), 0.9 if main else 0.6
    by_selector = [t for s in profile.selectors if (n := page.first(s)) is not None and len(t := n.text("\n")) > profile.least]
    texts = [p.text() for p in page.all("p")]
    good = [t for t in texts if len(t) > profile.least_paragraph and not any(u in t.lower() for u in profile.unwanted)]
    paragraphs = ["\n\n".join(good)] if len("\n\n".join(good)) > profile.least_paragraphs else []
    found = by_selector or paragraphs if profile.choice == "preferred" else by_selector + paragraphs
    if found:
        return max(found, key=len), 0.9
    return (body.text("\n") if body and profile.choice == "longest" else "", 0.6)


def page_title(page: Node, fallback: str = "") -> str:
    """The first likely heading, else a likely title in a meta tag, else ``fallback`` or a fixed name."""
    for s in TITLE_SELECTORS:
        if (n := page.first(s)) is not None:
            t = n.text()
            if 10 < len(t) < 300 and SITE_NAME not in t and not t.lower().startswith("speeches"):
                return t
    for name in META_TITLES:
        meta = page.first(f'meta[property="{name}"]') or page.first(f'meta[name="{name}"]')
        t = meta.attrs.get("content", "") if meta is not None else ""
        if 10 < len(t) < 300 and SITE_NAME not in t:
            return t
    return fallback or NO_TITLE


def page_location(page: Node) -> str:
    """Where a speech was given: a selector, then a phrase in the main part, the article or the page, else a fixed place."""
    for s in LOCATION_SELECTORS:
        if (n := page.first(s)) is not None and 5 < len(t := n.text()) < 100:
            return t
    for area in (page.first("main"), page.first("article"), page):
        text = area.text(strip=False) if area is not None else ""
        for p in LOCATION_PATTERNS:
            m = re.search(p, text)
            if m and len(t := m[1] if m.re.groups else m[0]) < 100:
                return t.strip()
    return HOME


def listed_links(page: Node) -> list[tuple[str, str, str, str]]:
    """(href, title, speaker, date) of the links of a listing with a title of five characters or more.

    Speaker and date are sought in the text of the three elements around a link, the inmost first for a speaker and the outmost
    for a date; empty if not found.
    """
    out = []
    for a in page.all("a"):
        title, href = a.text(), a.attrs.get("href", "")
        if len(title) < 5 or not href:
            continue
        speaker, date, around = "", "", a.parent
        for _ in range(3):
            if around is None:
                break
            text = around.text(strip=False)
            if not speaker:
                speaker = next((m[1] for p in CONTEXT_SPEAKERS if (m := re.search(p, text))), "")
            if m := re.search(CONTEXT_DATE, text):
                date = m[1]
            around = around.parent
        out.append((href, title, speaker, date))
    return out


def extracted(pages: DataFrame, profile: str | Profile = "longest") -> DataFrame:
    """(page_id, url, text, confidence, title, location) of pages(page_id, url, html)."""
    chosen = PROFILES[profile] if isinstance(profile, str) else profile
    names = ["page_id", "url", "text", "confidence", "title", "location"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h in b.column("html").to_pylist():
                page = parsed(h)
                title, location = page_title(page), page_location(page)
                rows.append((*page_text(page, chosen), title, location))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *columns], names)

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, confidence double, title string, location string")


def listing(pages: DataFrame) -> DataFrame:
    """(page_id, link, title, speaker, speech_date) of the links in pages(page_id, url, html) for which a date is known.

    The date is the one in the link, else the one beside it; the speaker the one beside it, else the one in the link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, u, *x) for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for x in listed_links(parsed(h))]
            if rows:
                kinds = (pa.int64(), *[pa.string()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "href", "title", "beside", "day"])

    found = map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, href string, title string, beside string, day string")
    link = absolute(F.col("href"), F.col("url"))
    rows = found.select("page_id", link.alias("link"), "title", clean_speaker(F.col("beside")).alias("beside"), "day").withColumns({"at": url_date(F.col("link")), "then": parsed_date(F.col("day"))})
    rows = rows.select("page_id", "link", "title", F.coalesce(none_if_blank(F.col("beside")), speaker_from_url(F.col("link")), F.lit("")).alias("speaker"), F.coalesce("at", "then").alias("speech_date"))
    return rows.where("speech_date IS NOT NULL")


def lines_title(text: Column, fallback: str = "") -> Column:
    """The title of a text without markup: the first likely one of its first fifteen lines."""
    def likely(x: Column) -> Column:
        low, words = F.lower(x), F.split(x, r"\s+")
        return (
            F.length(x).between(16, 199) & ~x.rlike(r"^\d") & ~x.rlike("^(?:Governor|Deputy Governor|Chair|President)") & ~low.startswith(SITE_NAME.lower()) & ~low.startswith("speech by")
            & ~F.substring(x, 1, 20).contains(":") & (F.size(words) >= 3) & ~F.forall(words, lambda w: w.rlike(r"\p{Lu}") & (F.upper(w) == w))
        )
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 15), stripped)
    return F.coalesce(F.get(F.filter(lines, likely), F.lit(0)), F.lit(fallback or NO_TITLE))


def lines_location(text: Column) -> Column:
    """The place named in a text without markup, else a fixed one."""
    found = [F.regexp_extract(text, p, 1 if g else 0) for p, g in LINE_LOCATIONS]
    return F.coalesce(*(F.when((x != "") & (F.length(x) < 100), F.trim(x)) for x in found), F.lit(HOME))


def lines_metadata(text: Column) -> dict[str, Column]:
    """speaker and date of a listing's text: after the first "by", and the first day with a short month."""
    speaker = F.regexp_extract(text, r"(?i)by\s+([^,\n]+)", 1)
    date = F.regexp_extract(text, r"(?i)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4})\b", 1)
    return {"speaker": none_if_blank(collapsed(speaker)), "date": none_if_blank(F.regexp_replace(date, r"\s+", " "))}
