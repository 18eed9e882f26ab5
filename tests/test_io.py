"""Sources, sinks and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import bulk, plugin, sinks
from lectern.streaming import events

LONG = "word " * 40


def test_bulk_csv_texts_and_pairs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.csv").write_text(f"Title,Author,speech_date,Content\nOne,Ann,2024-01-01,{LONG}\nTwo,Bob,2024-01-02,short\n")
    (tmp_path / "t.txt").write_text(LONG)
    got = bulk.read_csv(spark, str(tmp_path)).collect()
    assert [(r.title, r.speaker, r.date, r.url) for r in got] == [("One", "Ann", "2024-01-01", None)]
    assert [r.title for r in bulk.read_texts(spark, str(tmp_path)).collect()] == ["t"]
    assert bulk.totals(bulk.read_csv(spark, str(tmp_path))).head().n_documents == 1
    for i, text in enumerate((LONG, "", LONG)):
        d = tmp_path / "pairs" / f"d{i}"
        d.mkdir(parents=True)
        (d / "m.json").write_text(json.dumps({"speaker": f"S{i}", "date": "2024"}) if i < 2 else "{broken")
        (d / "t.txt").write_text(text)
    assert bulk.read_pairs(spark, str(tmp_path / "pairs")).head().speaker == "S0"


def test_bulk_csv_headers_and_encodings(spark, tmp_path):
    """Each file by its own header, in the encoding its bytes fit."""
    (tmp_path / "a.csv").write_text(f"title,text\nOne é,{LONG}\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(f'Content,Author,Title\n{LONG},Ann,"Two\né"\n', encoding="latin-1")
    (tmp_path / "c.csv").write_text(f"url,speech_text\nu,{LONG}\n")
    (tmp_path / "d.csv").write_text("")
    got = sorted((r.title or "", r.speaker, r.url, len(r.text.strip())) for r in bulk.read_csv(spark, str(tmp_path)).collect())
    n = len(LONG.strip())
    assert got == [("", None, "u", n), ("One é", None, None, n), ("Two\né", "Ann", None, n)]


@pytest.mark.parametrize("content,titles", [
    ([{"title": "A", "text": LONG}, {"title": "B", "content": LONG}], ["A", "B"]), ({"speeches": [{"title": "A", "text": LONG}]}, ["A"]), ({"data": [{"title": "A", "text": LONG}]}, ["A"]),
    ({"title": "A", "text": LONG}, ["A"]), ([LONG], [None]),
])
def test_bulk_json(spark, tmp_path, content, titles):
    (tmp_path / "x.json").write_text(json.dumps(content))
    assert sorted((r.title for r in bulk.read_json(spark, str(tmp_path)).collect()), key=str) == titles


def test_source_contract(spark):
    def produce(options, part, parts):
        for i in range(part, 4, parts):
            yield options["code"], f"u{i}", f"t{i}", None, datetime.date(2024, 1, 1), "text"

    plugin.register(spark, "institution_documents", produce)
    got = spark.read.format("institution_documents").option("code", "X").option("parts", "2").load()
    assert sorted(r.url for r in got.collect()) == ["u0", "u1", "u2", "u3"]


def test_upsert_insert_delete(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id long, v string, w string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["id"], ["v"]).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    with pytest.raises(ValueError):
        sinks.checked_insert(old, new, ["id"])
    with pytest.raises(KeyError):
        sinks.deleted(old, new.select("id"), ["id"])
    assert sinks.deleted(old, old.where("id = 1").select("id"), ["id"]).count() == 1
    child = spark.createDataFrame([(10, 1), (11, 2)], "c long, id long")
    assert [r.id for r in sinks.cascaded(child, old.where("id = 1"), "id", set_null=True).orderBy("c").collect()] == [None, 2]
    assert sinks.cascaded(child, old.where("id = 1"), "id").count() == 1
    docs = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "i long, text string")
    assert sorted(r.i for r in sinks.content_addressed(docs, "i").collect()) == [2, 3]
    sinks.write_csv(docs, str(tmp_path / "o"), ["i", "missing", "text"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["i", "missing", "text"]
    assert spark.sql("SELECT :n + 1 AS x", args={"n": 1}).head().x == bulk.run_sql(spark, "SELECT :n + 1 AS x", {"n": 1}).head().x


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_windows_of_a_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10)
    rows = [(i, t + datetime.timedelta(minutes=20 * i), 1, "click", 1.0) for i in range(6)]
    stream = stream_of(spark, tmp_path, rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    q = events.tumbling(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("hours").collect()) == [3, 3]


def test_smoothing_of_a_stream(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [("k", 0, 0.5), ("k", 1, 1.0)], "key string, i long, x double")
    q = events.smoothed_stream(stream, "key", "i", "x").writeStream.format("memory").queryName("smooth").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(round(r.y, 6) for r in spark.table("smooth").collect()) == [0.5, 0.8]


def test_analysis_of_a_stream(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [(1, "abc")], "id long, text string")
    got = []
    q = events.analysed_stream(stream, {"n": F.length("text")}, lambda df, _: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [(r.id, r.n) for r in got] == [(1, 3)]
