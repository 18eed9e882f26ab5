"""Validators as Column expressions. A check gives a struct (status, confidence, message)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bound, occurrences, space_words, stripped, tokens

# Words three of which mark a text as English; lines that betray an error page.
ENGLISH = ["the", "and", "of", "to", "in", "that", "for", "is", "on", "with"]
ERROR_PAGES = ["page not found", "404 error", "access denied", "internal server error"]
#: Least and most bytes of a page; pages shorter than the last are searched for errors.
PAGE_LEAST, PAGE_MOST, PAGE_SHORT = 200, 10_000_000, 1_000


def check(fails: Column, status: str, confidence: float, message: str) -> Column:
    bad = F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(message).alias("message"))
    good = F.struct(F.lit("valid").alias("status"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("message"))
    return F.when(F.coalesce(fails, F.lit(True)), bad).otherwise(good)


def length_check(text: Column, least: int = 200) -> Column:
    return check(F.length(F.trim(text)) < least, "invalid", 0.1, "length")


def language_check(declared: Column, expected: str) -> Column:
    return check(declared != expected, "invalid", 0.3, "language")


def structure_check(text: Column, least: int = 2) -> Column:
    return check(occurrences(text, "\n\n") < least, "questionable", 0.4, "structure")


def boilerplate_check(text: Column, phrases: list[str]) -> Column:
    low, hit = F.lower(text), F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p)
    return check(hit, "invalid", 0.0, "boilerplate")


def known_check(known: Column) -> Column:
    """``known``: whether the url or hash was seen before, from a join."""
    return check(known, "invalid", 0.0, "duplicate")


def speaker_check(speaker: Column, role: Column) -> list[Column]:
    return [check(F.coalesce(F.trim(speaker), F.lit("")) == "", "invalid", 0.0, "speaker"), check(role.isNull(), "questionable", 0.3, "role")]


def date_check(date: Column, founded: Column, as_of: str) -> Column:
    missing = check(F.lit(True), "questionable", 0.2, "date missing")
    return F.when(date.isNull(), missing).otherwise(check((date < founded) | (date > F.lit(as_of).cast("date")), "invalid", 0.0, "date"))


def institution_check(own: Column, expected: Column) -> Column:
    return check(~own.eqNullSafe(expected), "invalid", 0.0, "institution")


def chained(checks: list[Column]) -> Column:
    """The worst status, the product of confidences, and the messages in order."""
    every = F.array(*checks)
    bad = F.filter(every, lambda c: c["status"] != "valid")
    status = F.when(F.exists(bad, lambda c: c["status"] == "invalid"), "invalid").when(F.size(bad) > 0, "questionable").otherwise("valid")
    product = F.aggregate(bad, F.lit(1.0), lambda a, c: a * c["confidence"])
    return F.struct(status.alias("status"), product.alias("confidence"), F.transform(bad, lambda c: c["message"]).alias("issues"))


def repetitive(text: Column, least_unique: float = 0.7) -> Column:
    """Whether, of ten words or more, fewer than that share of 3-word runs are different."""
    def few(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 10, bound(runs, lambda r: F.size(F.array_distinct(r)) / F.size(r) < least_unique)).otherwise(F.lit(False))

    return bound(space_words(F.lower(text)), few)


def issue(fails: Column, severity: str, message: str) -> Column:
    return F.when(fails, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def content_issues(text: Column) -> Column:
    """Array of (severity, message) of what is wrong with a text."""
    toks = tokens(text)
    stop = F.size(F.array_intersect(toks, F.array(*(F.lit(w) for w in ENGLISH))))
    found = F.array(
        issue(F.length(text) < 100, "ERROR", "short"), issue(F.length(text) > 1_000_000, "WARNING", "long"), issue(F.size(space_words(text)) < 20, "ERROR", "few words"),
        issue(occurrences(text, "\n") * 10 > F.length(text), "WARNING", "newlines"), issue(repetitive(text), "WARNING", "repetitive"), issue(stop < 3, "WARNING", "language"),
    )
    return F.filter(found, lambda i: i.isNotNull())


def metadata_issues(title: Column, speaker: Column, date: Column, url: Column, institution_known: Column, as_of: str) -> Column:
    blank = lambda c: F.coalesce(stripped(c), F.lit("")) == ""
    found = F.array(
        issue(blank(title), "ERROR", "title missing"), issue(blank(speaker), "ERROR", "speaker missing"), issue(date.isNull(), "ERROR", "date missing"), issue(blank(url), "ERROR", "url missing"),
        issue(F.year(date) < 1900, "ERROR", "date too early"), issue(date > F.lit(as_of).cast("date"), "WARNING", "date in the future"), issue(~F.coalesce(institution_known, F.lit(False)), "WARNING", "institution unknown"),
    )
    return F.filter(found, lambda i: i.isNotNull())


def is_valid(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"].isin("ERROR", "CRITICAL"))


def title_overlap(title: Column, content: Column) -> Column:
    """Whether enough of the title's longer words are in the content."""
    words = F.array_distinct(F.filter(tokens(title), lambda w: F.length(w) > 3))
    return F.size(F.array_intersect(words, tokens(content))) >= F.least(F.lit(2.0), F.size(words) * 0.5)


def hits_of(text: Column, phrases: list[str]) -> Column:
    low, n = F.lower(text), F.lit(0)
    for p in phrases:
        n = n + F.when(low.contains(p), 1).otherwise(0)
    return n


def speech_like(text: Column, signs: list[str], noise: list[str], least: int = 3, most: int = 2) -> Column:
    return (F.length(text) >= 200) & (hits_of(text, signs) >= least) & (hits_of(text, noise) <= most)


def penalties(rules: list[tuple[Column, float]]) -> Column:
    """One less the penalties of the rules that hold, subtracted in order."""
    score = F.lit(1.0)
    for holds, by in rules:
        score = score - F.when(holds, F.lit(by)).otherwise(F.lit(0.0))
    return score


def graded(score: Column) -> Column:
    return F.when(score >= 0.7, "valid").when(score >= 0.4, "questionable").otherwise("invalid")


def page_ok(html: Column) -> Column:
    """Whether a fetched page is of a likely size and no error page."""
    return F.length(html).between(PAGE_LEAST, PAGE_MOST) & ~((F.length(html) < PAGE_SHORT) & (hits_of(html, ERROR_PAGES) > 0))


def result_confidence(score: Column, confidence: Column, uncertainty: Column, stance: Column) -> Column:
    """What remains of one after the checks of an analysis: ranges, a neutral label beside a strong score, low confidence."""
    c = F.when(score.between(-1, 1) & confidence.between(0, 1) & uncertainty.between(0, 1), F.lit(1.0)).otherwise(F.lit(0.5))
    c = F.when((stance == "neutral") & (F.abs(score) > 0.3), c * 0.8).otherwise(c)
    return F.when(confidence < 0.3, c * 0.7).otherwise(c)


def pipeline_confidence(confidence: Column, seconds: Column, succeeded: Column, required: Column) -> Column:
    c = F.when(confidence < 0.2, F.lit(0.6)).otherwise(F.lit(1.0))
    c = F.when(seconds > 120, c * 0.9).otherwise(c)
    c = F.when(succeeded < 0.5, c * 0.4).otherwise(c)
    return F.when(required, c).otherwise(c * 0.5)


# Phrases of pages that stand for a missing text.
PLACEHOLDERS = ["lorem ipsum", "placeholder", "test content", "coming soon", "under construction", "page not found", "error 404", "404 not found", "no content available", "content not available"]


def record_ok(text: Column, title: Column, speaker: Column, date: Column, url: Column) -> Column:
    """Whether a collected record may be stored: a text of 100 characters or more that is no placeholder, all fields, and a title of five."""
    full = F.lit(True)
    for c in (title, speaker, date, url):
        full = full & (F.coalesce(c.cast("string"), F.lit("")) != "")
    return F.coalesce((F.length(stripped(text)) >= 100) & (hits_of(text, PLACEHOLDERS) == 0), F.lit(False)) & full & (F.length(title) >= 5)
