"""Literal cases, and Python restatements of what the functions say."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import dom, extraction, lexicons, scoring, text, validation, values
from lectern.operators import dedup, finders, people, runs, specs, state
from lectern.plans import catalogue


def one(spark, column, **row):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).head()[0]


DAY = datetime.date(2024, 1, 15)


@pytest.mark.parametrize("url,date", [
    ("https://x.example/powell20240115a.htm", DAY), ("https://x.example/yellen20141201.htm", datetime.date(2014, 12, 1)), ("https://x.example/test20000229.htm", datetime.date(2000, 2, 29)),
    ("https://x.example/name-20240115.htm", DAY), ("https://x.example/name240115.htm", DAY), ("https://x.example/name990115.htm", datetime.date(1999, 1, 15)), ("https://x.example/20240231.htm", None), ("invalid.htm", None), ("", None), (None, None),
])
def test_url_date(spark, url, date):
    assert one(spark, values.url_date(F.col("u")), u=url) == date


@pytest.mark.parametrize("url,date", [
    ("https://x.example/speech/2023/march/title", datetime.date(2023, 3, 1)), ("https://x.example/2023/05/title", datetime.date(2023, 5, 1)), ("https://x.example/a/20230506", datetime.date(2023, 5, 6)),
    ("https://x.example/2021/title", datetime.date(2021, 1, 1)), ("https://x.example/1900/title", None), ("x", None),
])
def test_path_date(spark, url, date):
    assert one(spark, values.path_date(F.col("u")), u=url) == date


@pytest.mark.parametrize("words,date", [(x, DAY) for x in ("January 15, 2024", "Jan 15, 2024", "01/15/2024", "01-15-2024", "2024-01-15", "20240115", " 15 January 2024 ")] + [("invalid date", None), ("", None)])
def test_date_formats(spark, words, date):
    assert one(spark, values.parsed_date(F.col("s")), s=words) == date


@pytest.mark.parametrize("name,clean", [("Governor Jerome Powell", "Jerome Powell"), ("Dr. Ben Bernanke", "Ben Bernanke"), ("  ", ""), ("Libby Smith", "Lib"), ("Chair Janet Yellen, remarks", "Janet Yellen")])
def test_clean_speaker(spark, name, clean):
    assert one(spark, values.clean_speaker(F.col("s")), s=name) == clean


@pytest.mark.parametrize("a,b,same", [("Jerome Powell", "Jerome H. Powell", True), ("Jerome Powell", "Janet Yellen", False), ("", "A B", False), (None, "Jerome", False), ("Ann Mary Lee", "Ann Lee Roe", True)])
def test_names_match(spark, a, b, same):
    assert one(spark, values.names_match(F.col("a"), F.col("b")), a=a, b=b) is same


def matching_pairs(found):
    """All pairs of keys that groups and pairs of groups stand for, both ways and with themselves."""
    stands, met = {}, set()
    for r in found.collect():
        if r.same:
            assert r.a_id not in stands
            stands[r.a_id] = r.b_id
        else:
            assert r.a_id < r.b_id and (r.a_id, r.b_id) not in met
            met.add((r.a_id, r.b_id))
    return {(a, b) for a, x in stands.items() for b, y in stands.items() if x == y or (min(x, y), max(x, y)) in met}


def test_names_matched_is_brute_force(spark):
    rng = random.Random(9)
    names = [" ".join(rng.choice(["Ann", "Bo", "Cy", "Di", "Ed", "F.", "Gus", "ann"]) for _ in range(rng.randrange(6))) for _ in range(150)] + [None, "", " ", "A.", "Ann  Bo"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    a, b = (df.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(x)) for x in "ab")
    expected = {(r.a_id, r.b_id) for r in a.crossJoin(b).where(values.names_match(F.col("a"), F.col("b"))).collect()}
    assert matching_pairs(values.names_matched(df, "id", "name")) == expected
    assert values.names_matched(df.limit(0), "id", "name").count() == 0


def test_names_match_all_covers_every_part(spark, sf_dir):
    parts = {r.p_partkey: set(r.p_name.split()) for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect()}
    expected = {(a, b) for a, x in parts.items() for b, y in parts.items() if len(x & y) >= min(2, len(x), len(y))}
    assert matching_pairs(catalogue.queries()["names_match_all"](spark, sf_dir)) == expected


def test_overlapping_is_brute_force(spark):
    rng = random.Random(4)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), day(x := rng.randrange(30)), day(x + rng.randrange(9)) if i % 11 else None) for i in range(90)]
    a = spark.createDataFrame(rows, "a_id long, k long, s date, e date")
    b = spark.createDataFrame(rows[::-1], "b_id long, k long, s2 date, e2 date")
    expected = [(i, j) for i, k, s, e in rows for j, m, s2, e2 in rows if k is not None and k == m and None not in (e, e2) and s <= e2 and e >= s2]
    for salts in (1, 16):
        assert sorted((r.a_id, r.b_id) for r in finders.overlapping(a, b, "k", salts).collect()) == sorted(expected)


def test_overlapping_of_a_large_side_and_of_several_blocks(spark):
    rng = random.Random(5)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), day(x := rng.randrange(90)), day(x + rng.randrange(9)) if i % 11 else None) for i in range(900)]
    a = spark.createDataFrame([r for r in rows if r[1] != 3], "a_id long, k long, s date, e date")
    b = spark.createDataFrame([r for r in rows[::-1] if r[1] != 2], "b_id long, k long, s2 date, e2 date")
    expected = sorted((i, j) for i, k, s, e in rows for j, m, s2, e2 in rows if k == m == 1 and None not in (e, e2) and s <= e2 and e >= s2)
    for most in (finders.BROADCAST_ROWS, 0):
        found = finders.overlapping(a, b, "k", broadcast_rows=most)
        assert set(found.columns) == {"k", "a_id", "s", "e", "b_id", "s2", "e2"}
        assert sorted((r.a_id, r.b_id) for r in found.collect()) == expected


def test_overlapping_is_small_on_disk(spark, tmp_path):
    day = F.lit("2020-01-01").cast("date")
    a = spark.range(300).select(F.col("id").alias("a_id"), F.lit(1).alias("k"), day.alias("s"), day.alias("e"))
    b = spark.range(40_000).select(F.col("id").alias("b_id"), F.lit(1).alias("k"), day.alias("s2"), day.alias("e2"))
    finders.overlapping(a, b, "k").select("a_id", "b_id").write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == 12_000_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n / 2


def test_date_range_overlap_all_covers_every_speaker(spark, sf_dir):
    rows, first = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey").collect(), datetime.date(1996, 1, 1)
    day = lambda n: first + datetime.timedelta(n)
    a = [(k, n, day(60) if k % 3 == 0 else day(k % 2000)) for k, n in rows]
    b = [(k, n, day(k % 60), day(19 + k % 60)) for k, n in rows]
    expected = [(i, j) for i, m, e in a for j, n, s2, e2 in b if m == n and first <= e2 and e >= s2]
    found = [(r.a_id, r.b_id) for r in catalogue.queries()["date_range_overlap_all"](spark, sf_dir).collect()]
    assert sorted(found) == sorted(expected) and max(found)[0] > 40


def test_trigram_similarity(spark):
    assert one(spark, F.round(finders.trigram_similarity(F.lit("word"), F.col("b")), 6), b="two words") == 0.363636


def test_tokens_follow_python(spark):
    rng = random.Random(1)
    for _ in range(20):
        s = "".join(rng.choice("aÄé_9漢 .!?'-\n") for _ in range(60))
        assert one(spark, text.tokens(F.col("s")), s=s) == re.findall(r"\b\w+\b", s.lower())
        assert one(spark, F.size(text.space_words(F.col("s"))), s=s) == len(s.split())
        assert one(spark, text.sentences(F.col("s")), s=s) == [p.strip() for p in re.split("[.!?]+", s) if p.strip()]
        assert one(spark, text.occurrences(F.col("s"), "aa"), s=s) == s.count("aa")


def test_default_lexicon_score(spark):
    s = "We will tighten policy to curb inflation."
    toks = re.findall(r"\w+", s.lower())
    w = {k: p * q for k, (p, q) in lexicons.POLICY_LEXICON.items()}
    expected = max(-1, min(1, sum(w.get(t, 0) for t in toks) / len(toks) ** 0.5))
    t = text.tokens(F.col("s"))
    got = one(spark, scoring.clipped(scoring.raw_lexicon_score(scoring.hits(t, lexicons.weight_map(lexicons.POLICY_LEXICON)), F.size(t))), s=s)
    assert abs(got - expected) < 1e-9 and len(w) == 75


def test_lexicon_file_last_row_wins(spark, tmp_path):
    (tmp_path / "l.csv").write_text("word,polarity,weight\nHike,-0.9,1.0\nease,0.8,0.9\nhike,-0.1,0.5\n")
    assert {r["word"]: r["polarity"] for r in lexicons.read_lexicon(spark, str(tmp_path / "l.csv")).collect()} == {"hike": -0.1, "ease": 0.8}


def test_validators(spark):
    checks = validation.chained([validation.length_check(F.col("t")), validation.structure_check(F.col("t"))])
    got = one(spark, checks, t="short")
    assert (got.status, round(got.confidence, 6), got.issues) == ("invalid", 0.04, ["length", "structure"])
    assert one(spark, validation.graded(validation.penalties([(F.lit(True), 0.3)])), t="x") == "valid"
    assert one(spark, validation.page_ok(F.col("t")), t="404 error " * 30) is False
    issues = validation.metadata_issues(F.col("t"), F.col("t"), F.lit("1890-01-01").cast("date"), F.col("t"), F.lit(True), "2024-01-01")
    assert [i.message for i in one(spark, issues, t="Title")] == ["date too early"]


def test_statement_cleaning_modes(spark):
    s = "Body text.\nLast update: January 1\nMore body. Federal Reserve Bank of X\nEnd"
    assert one(spark, extraction.clean_statement(F.col("s")), s=s) == "Body text. Last update: January 1 More body."
    assert one(spark, extraction.clean_statement(F.col("s"), linewise=True), s=s) == "Body text. More body. End"


def page(html, profile):
    return extraction.page_text(dom.parsed(html), extraction.PROFILES[profile])


def test_page_text():
    body = "word " * 150
    html = f"<html><head><title>x</title><script>var a;</script></head><body><nav>menu</nav><div id='article'><h1>T</h1><p>{body}<br>more</p></div><footer>f</footer></body></html>"
    got, sure = page(html, "longest")
    assert sure == 0.9 and got.startswith("T") and "menu" not in got and "var a" not in got and "more" in got
    assert page("<body><p>short</p></body>", "longest") == ("short", 0.6) and page("<p>short</p>", "longest") == ("", 0.6)
    for name in extraction.PROFILES:
        assert page("", name) == page(None, name) == ("", 0.6)


def test_page_profiles():
    long = "Inflation remained above target. " * 20
    html = f'<body><div role="main"><p>{long}</p><sup>1</sup></div><p>We use a cookie here, please accept it now.</p><p>{long}{long}</p></body>'
    assert page(html, "longest")[0].count("Inflation") == 60 and "cookie" in page(html, "longest")[0]  # all paragraphs are longer
    assert page(html, "preferred")[0] == f"{long.strip()}\n1"  # a selector before paragraphs
    assert page(f"<body><p>We use a cookie here, please accept it now.</p><p>{long}</p></body>", "preferred") == (long.strip(), 0.9)
    assert page("<body><p>short</p></body>", "preferred") == ("", 0.6)
    assert page("<body><div class='a content'> a \n b<script>x</script></div><p>c</p></body>", "first") == ("a b", 0.9)
    assert page("<body><main>a<nav>n</nav> <b>b</b><form>f</form></main></body>", "legacy") == ("a\nb", 0.9)


def test_selectors():
    root = dom.parsed('<div class="page-header x"><h1 class="big-title">A</h1><br><p>b<p>c</div><meta property="og:title" content="M">')
    assert root.first(".page-header h1").text() == root.first('[class*="title"]').text() == "A"
    assert root.first("div.page-header.x") is not None and root.first("h1.page-header") is None and root.first("#x") is None
    assert root.first('meta[property="og:title"]').attrs["content"] == "M" and [n.tag for n in root.walk()] == ["div", "h1", "br", "p", "p", "meta"]


def test_titles_and_places():
    title, place = (lambda h, f="": extraction.page_title(dom.parsed(h), f)), (lambda h: extraction.page_location(dom.parsed(h)))
    assert title("<h1>The outlook for inflation</h1>") == "The outlook for inflation"
    assert title('<h1>Bank of England news</h1><meta name="twitter:title" content="Money and prices">') == "Money and prices"
    assert title("<h1>Short</h1>", "kept") == "kept" and title("") == "Untitled Speech"
    assert place('<p class="venue">Guildhall, York</p>') == "Guildhall, York" and place("<p>remarks at Harvard University today</p>") == "Harvard University"
    assert place("<main>in Cardiff, Wales</main>") == "Cardiff, Wales" and place("") == "London, UK"


def test_texts_without_markup(spark):
    text = "Governor Smith\n12 May\nSPEECH BY HAND NOW\nThe outlook for the economy\nheld at Leeds, England"
    assert one(spark, extraction.lines_title(F.col("s")), s=text) == "The outlook for the economy"
    assert one(spark, extraction.lines_title(F.col("s"), "f"), s="x") == "f"
    assert one(spark, extraction.lines_location(F.col("s")), s=text) == "Leeds, England" and one(spark, extraction.lines_location(F.col("s")), s="") == "London, UK"
    got = extraction.lines_metadata(F.col("s"))
    assert one(spark, got["speaker"], s="Speech by Jane  Doe, Governor, 3 Mar 2020") == "Jane Doe" and one(spark, got["date"], s="on 3  Mar 2020") == "3 Mar 2020"


def test_links_of_a_listing(spark):
    html = '<ul><li><a href="/a20240102a.htm">Long title</a> by nobody</li><li>Governor Jane Doe, <a href="b.htm">Another one</a> March 5, 2021</li><li><a href="c.htm">Undated text</a></li><li><a href="d">abc</a></li></ul>'
    rows = spark.createDataFrame([(1, "https://x.example/l/i.htm", f"<table><tr><td>{html}</td></tr></table>"), (2, "https://x.example/", None)], "page_id long, url string, html string")
    got = {r.link: (r.title, r.speaker, str(r.speech_date)) for r in extraction.listing(rows).collect()}
    assert got["https://x.example/a20240102a.htm"] == ("Long title", "a", "2024-01-02")  # nobody is named beside it
    assert got["https://x.example/l/b.htm"] == ("Another one", "Jane", "2021-03-05")
    assert len(got) == 2  # no date stands alone beside the third


def test_known_names_by_shards(spark):
    texts = spark.createDataFrame([(1, "Joann Leeson spoke"), (2, None), (3, "nobody"), (4, "ANN LEE and Bo")], "id long, t string")
    known = spark.createDataFrame([("Ann Lee",), ("Bo",), ("",), (None,), ("ann",)], "name string")
    for shard in (100, 1):
        assert sorted(tuple(r) for r in people.contained(texts, "id", "t", known, "name", shard=shard).collect()) == [(1, "ann"), (1, "ann lee"), (3, "bo"), (4, "ann"), (4, "ann lee"), (4, "bo")]
        assert sorted(tuple(r) for r in people.contained(texts, "id", "t", known, "name", longest=True, shard=shard).collect()) == [(1, "ann lee"), (3, "bo"), (4, "ann lee")]
    assert people.contained(texts, "id", "t", known.where("name = 'x'"), "name").count() == 0


def test_get_or_create(spark):
    found = spark.createDataFrame([(1, "ANN LEE"), (2, "bo"), (3, "nobody"), (4, "Cy"), (5, None)], "i long, name string")
    own = spark.createDataFrame([("Ann Lee", "r"), ("Bo", "s"), ("Cy", "t"), ("Dee", "u")], "name string, role string")
    stored = spark.createDataFrame([(4, "Sir Ann Leeson", "x"), (9, "Ann Lee", "y")], "speaker_id long, name string, role string")
    rows, made = people.get_or_create(found, own, stored)
    assert {r.i: r.speaker_id for r in rows.collect()} == {1: 9, 2: 10, 3: None, 4: 11, 5: None}
    assert sorted(tuple(r) for r in made.collect()) == [(10, "Bo", "s"), (11, "Cy", "t")]


def test_numbers_in_order(spark):
    rows = spark.range(500).select(F.format_string("%03d", (F.col("id") * 7) % 500).alias("name")).repartition(7)
    assert [r.n for r in people.numbered(rows, "name").orderBy("name").collect()] == list(range(1, 501))


def test_runs_go_on(spark):
    work, stored = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, b int"), []

    def save(df):
        rows = [r.id for r in df.collect()]
        if len(stored) == 1 and not done:
            raise RuntimeError("lost")
        stored.append(rows)

    done = []
    with pytest.raises(RuntimeError):
        runs.done_in_batches(work, None, ["id"], F.col("b"), [0, 1, 2], lambda d: d, save)
    done = [(i,) for rows in stored for i in rows]
    assert runs.done_in_batches(work, spark.createDataFrame(done, "id long"), ["id"], F.col("b"), [0, 1, 2], lambda d: d, save) == [1, 2]
    assert sorted(i for rows in stored for i in rows) == list(range(9))


def test_burst_window_and_delay(spark):
    rng, rows = random.Random(3), []
    for k in range(4):
        t = 0.0
        for i in range(40):
            t += rng.choice([0, 0.1, 0.5, 3])
            rows.append((k, i, t, rng.choice([200, 200, 429, 503])))
    got = {(r.k, r.i): (round(r.sent_at, 6), round(r.delay, 6)) for r in state.limited(spark.createDataFrame(rows, "k int, i int, t double, c int"), ["k"], "i", "t", "c", rate=2.0, burst=3).collect()}
    for k in range(4):
        sent, delay = [], 0.5
        for _, i, t, c in [r for r in rows if r[0] == k]:
            now = max([t, *sent[-1:]])
            recent = [s for s in sent if now - s < 1.5]
            at = now + (max(0, recent[0] + 1.5 - now) if len(recent) >= 3 else 0) + (max(0, delay - (now - sent[-1])) if sent else 0)
            delay = max(0.5, min(300, delay * {429: 1.5, 503: 1.2, 200: 0.95}[c]))
            sent.append(at)
            assert got[(k, i)] == (round(at, 6), round(delay, 6))


def test_history_across_documents(spark):
    rows = [(d, i, x) for d, xs in ((1, [0.5, None, 1.0]), (2, [-1.0])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "doc int, i int, x double").withColumn("all", F.lit(1)).withColumn("at", F.col("doc") * 100 + F.col("i"))
    by_doc = {(r.doc, r.i): r.y for r in state.smoothed(df, ["doc"], "i", "x").collect()}
    assert by_doc == {(1, 0): 0.5, (1, 1): None, (1, 2): 0.8, (2, 0): -1.0}
    assert [round(r.y, 6) for r in state.smoothed(df.where("x IS NOT NULL"), ["all"], "at", "x").orderBy("at").collect()] == [0.5, 0.8, -0.34]


def test_longest_capitals_and_ids(spark):
    assert one(spark, values.longest_capitals(F.col("s")), s="the Bank said John Paul Smith and Ann Lee") == "John Paul Smith"
    assert one(spark, values.speech_id(F.lit("FED"), F.col("s")), s="12345678") == "FED:12345678"
    assert one(spark, values.speech_id(F.lit("fed"), F.col("s")), s="12345678") is None
    assert one(spark, values.semver(F.col("s")) < values.semver(F.lit("1.2.0")), s="1.2.0-rc.1") is True


def test_specs_are_two_valued(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.9)], "id long, score double")
    s = specs.score_range(0.4, 0.6)
    assert [r.id for r in df.where((~s).column).collect()] == [1, 3]
    assert [r.id for r in df.where((s | specs.score_range(0.8, 1)).column).collect()] == [2, 3]


def test_first_per_and_title_dedup(spark):
    df = spark.createDataFrame([(1, "u", "A", "d"), (2, "u", "B", "d"), (3, "v", "a", "d"), (4, "w", "C", "d")], "ord long, url string, title string, date string")
    assert sorted(r.ord for r in dedup.first_per(df, ["url"], ["ord"]).collect()) == [1, 3, 4]
    assert sorted(r.ord for r in dedup.title_date_url_dedup(df, ["ord"]).collect()) == [1, 4]


def kept_in_order(rows):
    urls, titles, out = set(), set(), []
    for i, url, title, date in sorted(rows, key=lambda r: r[0]):
        both = ((title or "").strip().lower(), date or "")
        if url and url not in urls and both not in titles:
            urls.add(url)
            titles.add(both)
            out.append(i)
    return out


@pytest.mark.parametrize("few", [0, 3, 100_000])
def test_mixed_duplicates_follow_the_sequential_rule(spark, few):
    rng = random.Random(12)
    literal = [(1, "A", "T", "d"), (2, "A", "S", "d"), (3, "B", "S", "d")]
    chain = [(i, f"u{i // 2}", f"t{(i + 1) // 2}", "d") for i in range(12)]
    mixed = [(i, rng.choice(["u", "v", "w", "x", "y", "z", "", None]), rng.choice(["a", "A ", "b", "c", " c", "e", "f", None]), rng.choice(["d", "e", None])) for i in range(120)]
    assert kept_in_order(literal) == [1, 3]
    for rows in (literal, chain, mixed, []):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "ord long, url string, title string, date string")
        got = dedup.title_date_url_dedup(df, ["ord"], few=few)
        assert got.columns == df.columns and sorted(r.ord for r in got.collect()) == kept_in_order(rows)


def test_smoothing_and_breaker(spark):
    xs = [0.5, -1.0, 2.0, 0.1, 0.3, 0.7, -0.2]
    past = []
    for x in xs:
        past.append(max(-1.0, min(1.0, 0.6 * x + 0.4 * sum(past[-5:]) / len(past[-5:]) if past else x)))
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "key string, i long, x double")
    got = [r.y for r in state.smoothed(df, ["key"], "i", "x").orderBy("i").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, past, strict=True))
    calls = [(i, False, float(i)) for i in range(5)] + [(5, True, 10.0), (6, True, 70.0), (7, True, 71.0), (8, True, 72.0), (9, True, 73.0)]
    df = spark.createDataFrame([("k", *c) for c in calls], "key string, i long, ok boolean, t double")
    got = [(r.state, r.passed) for r in state.breaker(df, ["key"], "i", "ok", "t").orderBy("i").collect()]
    assert got == [("closed", True)] * 4 + [("open", True), ("open", False), ("half_open", True), ("half_open", True), ("closed", True), ("closed", True)]
