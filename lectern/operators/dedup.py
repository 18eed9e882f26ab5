"""Ordered duplicate removal and set differences over small keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.scratch import written


def first_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; partial aggregation keeps one row a key and task."""
    rest = [c for c in df.columns if c not in key]
    lead = [F.col(c) for c in order]
    got = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*lead)).alias("x"))
    return got.select(*(F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in df.columns))


def title_date_url_dedup(df: DataFrame, order: list[str], url: str = "url", title: str = "title", date: str = "date", few: int = 100_000) -> DataFrame:
    """Rows in ``order`` whose url, and whose lower-case title and date, no row kept before has; exact.

    A refused row uses up neither its url nor its title; rows without a url are refused. Each round keeps the rows that are first
    both of their url and of their title and date among those undecided, and refuses the rest of either; rounds
    go on until none is left. Once at most ``few`` are, their keys are decided one by one on the driver, so a long chain
    takes no round for each link. Ties of ``order`` go by url, title and date.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", ""))
    keys = {"_u": F.col(url), "_t": plain, "_d": F.coalesce(F.col(date).cast("string"), F.lit(""))}
    # The later of two rows that agree in everything is refused whatever becomes of the first.
    once = written(first_per(df.withColumns(keys).where("_u <> ''"), [*keys], order))
    left, kept = once.select(F.struct(*order, *keys).alias("_o"), *keys), []
    while left.count() > few:
        first_u = left.groupBy("_u").agg(F.min("_o").alias("_fu"))
        first_t = left.groupBy("_t", "_d").agg(F.min("_o").alias("_ft"))
        won = written(left.join(first_u, "_u").join(first_t, ["_t", "_d"]).where("_o <=> _fu AND _o <=> _ft").select(*keys))
        kept.append(won)
        left = written(left.join(won.select("_u"), "_u", "left_anti").join(won.select("_t", "_d"), ["_t", "_d"], "left_anti"))
    urls, titles, rest = set(), set(), []
    for r in left.orderBy("_o").select(*keys).collect():
        if r["_u"] not in urls and (r["_t"], r["_d"]) not in titles:
            urls.add(r["_u"])
            titles.add((r["_t"], r["_d"]))
            rest.append(tuple(r))
    kept.append(df.sparkSession.createDataFrame(rest, once.select(*keys).schema))
    return once.join(reduce(DataFrame.unionByName, kept), [*keys], "left_semi").select(*df.columns)


def gathered(sources: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """The rows of all sources by column name, missing columns null, and of each key the first in ``order``."""
    return first_per(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources), key, order)


def new_only(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return found.join(stored.select(key), key, "left_anti")
