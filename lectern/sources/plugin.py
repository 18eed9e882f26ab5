"""A Python data source over any producer of documents: one instance of the same contract for each institution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "institution string, url string, title string, speaker string, date date, text string"


class Part(InputPartition):
    def __init__(self, part: int, parts: int):
        self.part, self.parts = part, parts


def register(spark: SparkSession, name: str, produce: Callable[[dict, int, int], Iterator[tuple]]) -> None:
    """Makes ``spark.read.format(name)`` read what ``produce(options, part, parts)`` yields, in option ``parts`` tasks."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            n = int(self.options.get("parts", "1"))
            return [Part(i, n) for i in range(n)]

        def read(self, partition: Part) -> Iterator[tuple]:
            yield from produce(self.options, partition.part, partition.parts)

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> DataSourceReader:
            return Reader(dict(self.options))

    spark.dataSource.register(Documents)
