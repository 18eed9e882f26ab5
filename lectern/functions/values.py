"""Dates, urls, names, identifiers, versions and money as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapsed

# Date formats tried in order; titles before names; English months.
DATE_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "MMMM d yyyy", "MMM d yyyy", "yyyyMMdd", "d MMMM yyyy", "d MMM yyyy"]
TITLES = ["Vice Chairman", "Vice Chair", "Chairman", "Chair", "Governor", "President", "Dr.", "Mr.", "Ms.", "Mrs."]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def none_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def within_years(d: Column, low: int, high: int) -> Column:
    return F.when(F.year(d).between(low, high), d)


def parsed_date(text: Column, low: int = 1990, high: int = 2030) -> Column:
    """The first format that fits; null outside the years."""
    def first(bare: Column) -> Column:
        return F.get(F.filter(F.array(*(F.try_to_date(bare, f) for f in DATE_FORMATS)), lambda d: F.year(d).between(low, high)), F.lit(0))

    return F.get(F.transform(F.array(collapsed(text)), first), F.lit(0))


def content_date(text: Column) -> Column:
    """The first date a text names, of the first form it has: day month year, month day year, year-month-day."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    forms = ((rf"\b(\d{{1,2}}\s+{month}\s+\d{{4}})\b", "d MMMM yyyy"), (rf"\b({month}\s+\d{{1,2}},\s+\d{{4}})\b", "MMMM d, yyyy"), (r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd"))
    return F.coalesce(*(F.try_to_date(none_if_blank(F.regexp_replace(F.regexp_extract(text, p, 1), r"\s+", " ")), f) for p, f in forms))


def from_year(date_text: Column, year: int) -> Column:
    """Whether the year a date begins with is ``year`` or later; dates that don't begin with one count."""
    return F.coalesce(F.substring(date_text, 1, 4).try_cast("int") >= year, F.lit(True))


def basename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def url_date(url: Column) -> Column:
    """The date in a file name: eight digits, after a name or alone, or six digits, 31 to 99 being of the last century."""
    name = basename(url)
    eight = F.try_to_date(none_if_blank(F.regexp_extract(name, r"(?:^|[A-Za-z_\-])(\d{8})[a-z]?(?:\.|$)", 1)), "yyyyMMdd")
    six = none_if_blank(F.regexp_extract(name, r"^[A-Za-z]+(\d{6})[a-z]?(?:\.|$)", 1))
    century = F.when(F.substring(six, 1, 2).cast("int") <= 30, "20").otherwise("19")
    return F.coalesce(within_years(eight, 1990, 2030), within_years(F.try_to_date(F.concat(century, six), "yyyyMMdd"), 1990, 2030))


def path_date(url: Column) -> Column:
    """The date in a path: /speech/YYYY/month/, /YYYY/MM/, eight digits, /YYYY/."""
    year, month = (F.regexp_extract(url, r"/speech/(\d{4})/([a-z]+)/", i) for i in (1, 2))
    number = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), month)
    by_name = F.when(number > 0, F.try_to_date(F.concat_ws("-", none_if_blank(year), number.cast("string"), F.lit("1")), "yyyy-M-d"))
    y2, m2 = (none_if_blank(F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/", i)) for i in (1, 2))
    by_number = F.when(m2.isNotNull(), F.try_to_date(F.concat_ws("-", y2, m2, F.lit("1")), "yyyy-M-d"))
    digits = F.try_to_date(none_if_blank(F.regexp_extract(url, r"(\d{8})", 1)), "yyyyMMdd")
    alone = none_if_blank(F.regexp_extract(url, r"/(\d{4})/", 1))
    by_year = F.when(alone.isNotNull(), F.try_to_date(F.concat(alone, F.lit("-1-1")), "yyyy-M-d"))
    return F.coalesce(*(within_years(d, 1960, 2030) for d in (by_name, by_number, digits, by_year)))


def listed_date(text: Column) -> Column:
    return F.try_to_date(none_if_blank(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)), "d MMM yyyy")


def url_parts(url: Column) -> dict[str, Column]:
    return {
        "domain": none_if_blank(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), "path": F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1),
        "is_https": url.startswith("https://"), "is_pdf": F.lower(url).endswith(".pdf"), "is_valid": url.rlike("^https?://[^/?#]+"),
    }


def speaker_from_url(url: Column) -> Column:
    """The letters a file name begins with, lower case; null if none."""
    return none_if_blank(F.lower(F.regexp_extract(basename(url), "^([A-Za-z]+)", 1)))


def path_names(url: Column) -> Column:
    """The names a url's path may mean, likeliest first: of the first to the last pattern the whole, then its last word."""
    path = F.lower(F.regexp_extract(url, r"^(?:https?://[^/?#]+)?([^?#]*)", 1))
    skip = F.array(*(F.lit(w) for w in ("speech", "remarks", "address", "pdf", "html", "htm", "")))
    patterns = (
        (r"speech-by-([a-z-]+)-([a-z-]+)", 2), (r"([a-z-]+)-(speech|remarks|address)", 2), (r"([a-z-]+)-([a-z-]+)-(speech|remarks|address)", 3), (r"/([a-z-]+)/", 1), (r"([a-z-]+)\.(pdf|html?)", 2),
    )
    found = []
    for p, n in patterns:
        groups = F.filter(F.array(*(F.regexp_extract(path, p, i + 1) for i in range(n))), lambda g: ~F.array_contains(skip, g))
        whole = F.trim(F.array_join(F.transform(groups, lambda g: F.replace(g, F.lit("-"), F.lit(" "))), " "))
        found += [whole, F.element_at(F.split(whole, r"\s+"), -1)]
    return F.filter(F.array(*found), lambda x: x != "")


def speaker_from_text(text: Column) -> Column:
    titled = F.regexp_extract(text, r"(?:Governor|Chairman|Chair|President|Dr\.|Mr\.|Ms\.)\s+([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)", 1)
    by = F.regexp_extract(text, r"[Bb]y\s+([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)", 1)
    return F.coalesce(none_if_blank(titled), none_if_blank(by))


def clean_speaker(name: Column) -> Column:
    """A name without titles, cut at a comma and at by, remarks or speech (no word boundary), of two characters at least, or empty."""
    bare = collapsed(name)
    for t in TITLES:
        bare = F.regexp_replace(bare, "(?i)^" + t.replace(".", r"\.") + r"\s+", "")
    bare = F.trim(F.split(bare, "(?i),|by|remarks|speech")[0])
    return F.when(F.length(bare) >= 2, bare).otherwise(F.lit(""))


def name_tokens(name: Column) -> Column:
    """The parts of a name but initials."""
    return F.array_distinct(F.filter(F.split(collapsed(name), " "), lambda t: F.length(F.replace(t, F.lit("."), F.lit(""))) > 1))


def names_match(a: Column, b: Column) -> Column:
    """Whether as many parts agree as the shorter name has, or two if a name has more than two; case counts."""
    x, y = name_tokens(a), name_tokens(b)
    least = F.when((F.size(x) <= 2) & (F.size(y) <= 2), F.least(F.size(x), F.size(y))).otherwise(F.lit(2))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= least), F.lit(False))


def names_matched(df: DataFrame, key: str, name: str) -> DataFrame:
    """All rows of ``df`` whose names match, each against each, as (a_id, b_id, same).

    Names of equal parts match the same names, so they are one group that its least key stands for. Where ``same``
    holds, b_id stands for a_id, once for every row whose name has parts; elsewhere a_id < b_id stand for groups that match.
    Two rows match if one key stands for both or if those that stand for them are a pair.
    Different groups match if a single part is one of two, or if they share two parts and one has more than two; they
    meet on just that, so no pair is made that doesn't match. Null keys are left out.
    """
    parts = F.array_sort(name_tokens(F.col(name)))
    rows = df.select(F.col(key).alias("a_id"), parts.alias("parts")).where(F.col("a_id").isNotNull() & (F.size("parts") > 0))
    groups = rows.groupBy("parts").agg(F.min("a_id").alias("b_id"))
    members = rows.join(groups, "parts").select("a_id", "b_id", F.lit(True).alias("same")).distinct()

    def met(side: str, some: Column, keys: Column) -> DataFrame:
        return groups.where(some).select(F.col("b_id").alias(side), F.size("parts").alias(f"n_{side}"), F.explode(keys).alias("meet"))

    n, one = F.size("parts"), F.col("parts")
    two = F.flatten(F.transform(one, lambda x, i: F.transform(F.slice(one, i + 2, F.size(one)), lambda y: F.array(x, y))))
    single = met("x", n == 1, one).join(met("y", n == 2, one), "meet")
    double = met("x", n > 2, two).join(met("y", n > 1, two), "meet").where("n_y = 2 OR x < y")
    pairs = single.select("x", "y").unionByName(double.select("x", "y").distinct())
    return members.unionByName(pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), F.lit(False).alias("same")))


def last_name(name: Column) -> Column:
    return F.lower(F.element_at(F.split(collapsed(name), " "), -1))


def longest_capitals(text: Column) -> Column:
    """The longest run of capitalised words, the first of equals."""
    runs = F.regexp_extract_all(text, F.lit(r"(?:\p{Lu}\S*[ \t]*)+"), F.lit(0))
    ranked = F.transform(runs, lambda r, i: F.struct((-F.size(F.split(F.trim(r), r"[ \t]+"))).alias("n"), i.alias("i"), F.trim(r).alias("run")))
    return F.get(F.array_sort(ranked), F.lit(0))["run"]


def speaker_cascade(found: DataFrame, roles: DataFrame, name: str = "name") -> DataFrame:
    """found(name, ...) with role and source from roles(known, role, ord): by exact name, by agreeing parts, by last name.

    Matching by parts meets through shared parts, not by comparing all; the first known name by ``ord`` wins.
    """
    first = lambda df, key: df.groupBy(key).agg(F.min_by(F.struct("known", "role"), "ord").alias("hit"))
    exact = first(roles.withColumn("k", F.lower("known")), "k").withColumnRenamed("hit", "exact")
    last = first(roles.withColumn("last", last_name(F.col("known"))), "last").withColumnRenamed("hit", "by_last")
    names = found.select(name).distinct()
    parts = names.select(name, F.explode(name_tokens(F.col(name))).alias("part"))
    met = parts.join(roles.select("known", "role", "ord", F.explode(name_tokens(F.col("known"))).alias("part")), "part").select(name, "known", "role", "ord").distinct()
    tokens = met.where(names_match(F.col(name), F.col("known"))).groupBy(name).agg(F.min_by(F.struct("known", "role"), "ord").alias("by_parts"))
    out = found.withColumns({"k": F.lower(name), "last": last_name(F.col(name))}).join(exact, "k", "left").join(tokens, name, "left").join(last, "last", "left")
    source = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_parts").isNotNull(), "parts").when(F.col("by_last").isNotNull(), "last_name")
    best = F.coalesce("exact", "by_parts", "by_last")
    return out.select(*found.columns, best["known"].alias("known"), best["role"].alias("role"), source.alias("source"))


def semver(text: Column) -> Column:
    """A version that sorts: major, minor, patch, then a release above its pre-releases."""
    part = lambda i: F.regexp_extract(text, r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.\-]+))?", i)
    return F.struct(*(part(i).try_cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))), F.coalesce(none_if_blank(part(4)), F.lit("~")).alias("pre"))


def money_add(amount: Column, other: Column, currency: Column, other_currency: Column) -> Column:
    """The exact sum; null unless the currencies agree."""
    return F.when(currency == other_currency, (amount.cast("decimal(28,10)") + other.cast("decimal(28,10)")).cast("decimal(38,10)"))


def money_subtract(amount: Column, other: Column, currency: Column, other_currency: Column) -> Column:
    """The exact difference; null unless the currencies agree."""
    return F.when(currency == other_currency, (amount.cast("decimal(28,10)") - other.cast("decimal(28,10)")).cast("decimal(38,10)"))


def money_times(amount: Column, factor: Column) -> Column:
    return (amount.cast("decimal(19,8)") * factor.cast("decimal(18,8)")).cast("decimal(38,10)")


def money_divided(amount: Column, by: Column) -> Column:
    """Null when ``by`` is 0."""
    return (amount.cast("decimal(19,8)") / F.nullif(by.cast("decimal(18,8)"), F.lit(0).cast("decimal(18,8)"))).cast("decimal(38,10)")


def parsed_id(text: Column) -> Column:
    """(code, uid) of an id, split at the first colon; null unless both are as ``speech_id`` wants them."""
    code, uid = F.regexp_extract(text, "(?s)^([^:]*):(.*)$", 1), F.regexp_extract(text, "(?s)^([^:]*):(.*)$", 2)
    return F.when(code.rlike("^[A-Z0-9_]{2,}$") & (F.length(uid) >= 8), F.struct(code.alias("code"), uid.alias("uid")))


def scaled(value: Column, low: float = -1.0, high: float = 1.0) -> dict[str, Column]:
    """A score within its scale: from 0 to 1, how far it is from the middle, and on which side (neutral within .01 of it)."""
    middle, half = (low + high) / 2, (high - low) / 2
    return {
        "normalized": (value - low) / (high - low), "strength": F.abs(value - middle) / half, "is_neutral": F.abs(value - middle) < 0.01,
        "is_positive": value > middle, "is_negative": value < middle,
    }


def speech_id(code: Column, uid: Column) -> Column:
    """CODE:uid; null unless the code is of capitals, digits and underscores, two or more, and the uid has eight characters."""
    return F.when(code.rlike("^[A-Z0-9_]{2,}$") & (F.length(uid) >= 8), F.concat_ws(":", code, uid))


def confidence_level(x: Column) -> Column:
    return F.when(x >= 0.9, "very_high").when(x >= 0.7, "high").when(x >= 0.5, "medium").when(x >= 0.3, "low").otherwise("very_low")


def file_key(date: Column, speaker: Column, url: Column, longest: int = 100) -> Column:
    """date_speaker_hash, only letters, digits, - and _."""
    return F.substring(F.regexp_replace(F.concat_ws("_", date.cast("string"), F.lower(speaker), F.left(F.sha2(url, 256), F.lit(12))), r"[^A-Za-z0-9_\-]+", "_"), 1, longest)


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def month_range(day: Column) -> Column:
    first = F.trunc(day, "month")
    return F.struct(first.alias("start"), F.last_day(day).alias("end"), (F.datediff(F.last_day(day), first) + 1).alias("days"))


def year_range(day: Column) -> Column:
    start, end = F.trunc(day, "year"), F.last_day(F.add_months(F.trunc(day, "year"), 11))
    return F.struct(start.alias("start"), end.alias("end"), (F.datediff(end, start) + 1).alias("days"))


def range_lengths(start: Column, end: Column) -> dict[str, Column]:
    """Days of a range, both ends included, as days, weeks, months and years of mean length."""
    days = F.datediff(end, start) + 1
    return {"days": days, "weeks": days / 7, "months": days / 30.44, "years": days / 365.25}


def next_status(status: Column, has_text: Column, valid: Column, analysed: Column) -> Column:
    """discovered, extracted, validated or failed, analyzed, by what is there."""
    return F.when(analysed, "analyzed").when(valid, "validated").when(~valid, "failed").when(has_text, "extracted").otherwise(F.coalesce(status, F.lit("discovered")))


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t))))
