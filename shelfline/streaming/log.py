"""Rows that micro-batches write, a folder per batch.

A batch owns ``<table>/source=<stream>/batch=<id>`` and overwrites it when it runs
again, so a batch that died half way leaves nothing double. Nothing written is
rewritten later: what a table holds now is its base and all rows logged, and a
sum over logged changes gives the present stock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.schema import conform


class BatchLog:
    """One stream's view of the log; ``tables`` maps names to their base rows."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, DataFrame], source: str = "orders"):
        self.spark, self.root, self.tables, self.source = spark, root.rstrip("/"), tables, source

    def create(self) -> BatchLog:
        """Make the folders, each with an empty batch that carries the schema."""
        for name, base in self.tables.items():
            base.limit(0).write.mode("overwrite").parquet(self._folder(name, -1))
        return self

    def stream(self, source: str) -> BatchLog:
        """The same tables for another stream; its batches do not overwrite this one's."""
        return BatchLog(self.spark, self.root, self.tables, source)

    def write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        schema = self.tables[name].schema
        rows = rows.withColumns({f.name: F.lit(None) for f in schema.fields if f.name not in rows.columns})
        conform(rows, schema).write.mode("overwrite").parquet(self._folder(name, batch_id))

    def logged(self, name: str, batch_id: int | None = None) -> DataFrame:
        """Rows written so far; with ``batch_id`` without those of that batch and later ones."""
        schema = T.StructType(self.tables[name].schema.fields + [T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        if batch_id is not None:
            rows = rows.filter((F.col("source") != self.source) | (F.col("batch") < batch_id))
        return rows.select(*self.tables[name].columns)

    def rows(self, name: str, batch_id: int | None = None) -> DataFrame:
        """Base and logged rows."""
        return self.tables[name].unionByName(self.logged(name, batch_id))

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/source={self.source}/batch={batch_id}"

