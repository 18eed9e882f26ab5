"""Bulk files of documents: CSV, text, JSON, pairs of metadata and text; parents by key; raw SQL.

Paths are read by Spark, so they may be in any store it knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import stripped

# Column names a field may have, in the order they are tried.
NAMES = {
    "title": ["title", "Title", "speech_title"], "speaker": ["speaker", "Speaker", "author", "Author"], "date": ["date", "Date", "speech_date"],
    "text": ["text", "content", "Text", "Content", "speech_text"], "url": ["url", "source_url", "URL"],
}
FIELDS = list(NAMES)


def _first(df: DataFrame, names: list[str]) -> Column:
    have = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _kept(df: DataFrame, longer_than: int) -> DataFrame:
    rows = df.select(*(_first(df, NAMES[f]).alias(f) for f in FIELDS), *(c for c in ("file",) if c in df.columns))
    return rows.where(F.length(stripped(F.col("text"))) > longer_than)


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1", "windows-1252"), longer_than: int = 100) -> DataFrame:
    """(title, speaker, date, text, url, file) of CSV files below ``path``, whatever their columns are called; names count by case.

    Each file has a header of its own and is read in the first of ``encodings`` that its bytes are valid in. Files of one header
    and encoding are read together; only names, first lines and encodings come to the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    # A decoding that gives other bytes back wasn't that of the file.
    fits = F.lit(encodings[-1])
    for e in reversed(encodings[:-1]):
        fits = F.when(F.try_validate_utf8(F.col("content")).isNotNull() if e == "UTF-8" else F.lit(True), e).otherwise(fits)
    kinds = files.select("path", F.split(F.decode(F.col("content"), "ISO-8859-1"), r"\r?\n")[0].alias("header"), fits.alias("encoding"))
    out = None
    for kind in kinds.groupBy("header", "encoding").agg(F.collect_list("path").alias("paths")).collect():
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", kind["encoding"]).csv(kind["paths"])
        part = _kept(rows.withColumn("file", F.input_file_name()), longer_than)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{f} string" for f in (*FIELDS, "file")))


def read_texts(spark: SparkSession, path: str, longer_than: int = 100) -> DataFrame:
    """One row per text file below ``path``; its name is the title."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    return _kept(rows.select(F.col("value").alias("text"), name.alias("title"), F.input_file_name().alias("file")), longer_than)


def read_json(spark: SparkSession, path: str, longer_than: int = 100) -> DataFrame:
    """Files below ``path`` that are a list, an object with speeches or data, one object, or a list of bare strings."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).withColumn("file", F.input_file_name())
    options = {"mode": "PERMISSIVE"}
    v = F.col("value")
    as_list = F.from_json(v, T.ArrayType(T.StringType()), options)
    inner = F.coalesce(F.get_json_object(v, "$.speeches"), F.get_json_object(v, "$.data"))
    items = F.when(F.trim(v).startswith("["), as_list).when(inner.isNotNull(), F.from_json(inner, T.ArrayType(T.StringType()), options)).otherwise(F.array(v))
    rows = raw.select("file", F.explode(items).alias("item"))
    field = lambda names: F.coalesce(*(F.col("m")[n] for n in names))
    rows = rows.withColumn("m", F.when(F.trim("item").startswith("{"), F.from_json("item", T.MapType(T.StringType(), T.StringType()), options)))
    whole = {f: field(NAMES[f]) for f in FIELDS if f != "text"} | {"text": F.when(F.col("m").isNull(), F.col("item")).otherwise(field(NAMES["text"]))}
    return _kept(rows.select("file", *(c.alias(f) for f, c in whole.items())), longer_than)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Folders that hold a metadata file (*.json) and a text (*.txt): metadata beside text, in the order of folders; folders without either are left out."""
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
    read = lambda glob: spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).withColumn("folder", folder)
    names = ["speaker", "date", "role", "institution", "title", "location", "source_url"]
    meta = read("*.json").select("folder", F.from_json("value", T.StructType([T.StructField(n, T.StringType()) for n in names]), {"mode": "PERMISSIVE"}).alias("m"))
    text = read("*.txt").select("folder", F.col("value").alias("text")).where(F.length(stripped(F.col("text"))) > 0)
    return meta.where("m IS NOT NULL").join(text, "folder").select("folder", "m.*", "text").orderBy("folder")


def totals(rows: DataFrame) -> DataFrame:
    """Documents and characters by file."""
    return rows.groupBy("file").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


def with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with their parents' columns, those without a parent too."""
    return children.join(parents, key, "left")


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """A statement with named parameters."""
    return spark.sql(text, args=args or {})
