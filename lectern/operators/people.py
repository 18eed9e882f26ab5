"""Names against a dimension of people: containment in texts, aliases, and rows made where a name is new."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.shipping import map_arrow
from lectern.functions.text import collapsed
from lectern.operators.scratch import written

#: Names that one automaton holds; beyond, texts are read once for each shard of names.
SHARD = 500_000


def contained(texts: DataFrame, key: str, text: str, known: DataFrame, name: str, longest: bool = False, shard: int = SHARD) -> DataFrame:
    """(key, found): the names of known(name), lower case, that a text contains, case ignored; with ``longest`` a text's longest, of equals the last in order.

    Each shard of names is compiled into one Aho-Corasick automaton in the workers, so a text is read once a shard whatever the names.
    """
    names = known.select(F.lower(name).alias("name")).where("name <> ''").distinct()
    shards = max(1, -(-names.count() // shard))
    rows, out = texts.select(key, F.lower(text).alias("text")).where("text IS NOT NULL"), []
    for i in range(shards):
        own = [r["name"] for r in names.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == i).collect()]

        def run(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n in own:
                automaton.add_word(n, (len(n), n))
            automaton.make_automaton()
            for b in batches:
                at, hits = [], []
                for k, t in enumerate(b.column("text").to_pylist()):
                    met = {v for _, v in automaton.iter(t)}
                    for _, n in [max(met)] if met and longest else met:
                        at.append(k)
                        hits.append(n)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], [key, "found"])

        if own:
            out.append(map_arrow(rows, run, f"{key} {texts.schema[key].dataType.simpleString()}, found string"))
    if not out:
        return rows.select(key, F.lit(None).cast("string").alias("found")).limit(0)
    found = reduce(DataFrame.unionByName, out)
    if longest and shards > 1:
        found = found.groupBy(key).agg(F.max(F.struct(F.length("found").alias("n"), "found")).alias("x")).select(key, "x.found")
    return found


def alias_map(people: DataFrame, name: str, order: str) -> DataFrame:
    """(alias, names): full names by last name and by the whole name without gaps and dots, both lower case, in ``order``."""
    low = F.lower(collapsed(F.col(name)))
    aliases = F.array_distinct(F.array(F.element_at(F.split(low, " "), -1), F.regexp_replace(low, "[ .]", "")))
    rows = people.select(F.explode(F.when(low.contains(" "), aliases).otherwise(F.slice(aliases, -1, 1))).alias("alias"), F.col(order).alias("o"), F.col(name).alias("n"))
    return rows.groupBy("alias").agg(F.transform(F.sort_array(F.collect_set(F.struct("o", "n"))), lambda x: x["n"]).alias("names"))


def get_or_create(found: DataFrame, people: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speakers of found(name, ...): (``found`` with speaker_id, the new rows of ``stored``).

    A name is looked up in people(name, role) without regard to case; unknown ones stay without a speaker. Of stored(speaker_id, name, role)
    the first by name, then id, whose name contains the person's is taken, case ignored; where there is none a row is made, with ids
    from the largest on in the order of names.
    """
    person = people.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("name", "role")).alias("p"))
    wanted = found.select(F.lower("name").alias("k")).distinct().join(person, "k").select("p.name", "p.role").distinct()
    met = contained(stored.select("speaker_id", "name"), "speaker_id", "name", wanted, "name").join(stored.select("speaker_id", F.col("name").alias("has")), "speaker_id")
    old = wanted.join(met.withColumnRenamed("found", "k"), F.lower("name") == F.col("k")).groupBy("name").agg(F.min(F.struct("has", "speaker_id")).alias("x"))
    old = old.select("name", F.col("x.speaker_id").alias("speaker_id"))
    top = stored.agg(F.coalesce(F.max("speaker_id"), F.lit(0)).alias("top")).first()["top"]
    made = numbered(wanted.join(old, "name", "left_anti"), "name").select((F.lit(top) + F.col("n")).cast("long").alias("speaker_id"), "name", "role")
    all_ = old.unionByName(made.select("name", "speaker_id"))
    ids = person.select("k", F.col("p.name").alias("full")).join(all_.withColumnRenamed("name", "full"), "full").select("k", "speaker_id")
    return found.withColumn("k", F.lower("name")).join(ids, "k", "left").drop("k"), made


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with n, 1 for the first in the order of ``by``, which is unique; counted by range, so no task has all rows."""
    dealt = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    dealt = written(dealt)
    sizes = dealt.groupBy("p").agg(F.count("*").alias("size"), F.min("i").alias("first"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.p") < F.col("a.p"), "left").groupBy("a.p", "a.first").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), "p").withColumn("n", F.col("i") - F.col("first") + F.col("before") + 1).drop("p", "i", "first", "before")
