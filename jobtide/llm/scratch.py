"""Intermediate tables of one operator call, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtide.session import remove, scratch


class Scratch:
    """Writes DataFrames once and reads them back: cuts their lineage, and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch(self._spark, "llm")
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for table in tables:
            if path := self._paths.pop(id(table), None):
                remove(self._spark, path)
