"""Tables at a path whose files are bucketed by a key, so that joins and windows on it need no exchange."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class BucketedTable:
    """Parquet files under ``path``; the catalogue's entry is only how this session knows of their buckets."""

    spark: SparkSession
    path: str
    columns: dict[str, str]
    key: str
    buckets: int

    @property
    def name(self) -> str:
        return "bucketed_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self.columns.items())

    @classmethod
    def open(cls, spark: SparkSession, path: str, columns: dict[str, str], key: str, buckets: int) -> BucketedTable:
        """The table at ``path`` (column name -> type), whether there are files or not. ``buckets`` must stay what it was."""
        table = cls(spark, path.rstrip("/"), columns, key, int(buckets))
        place = table.path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table.name} ({table.ddl}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {table.buckets} BUCKETS LOCATION '{place}'"
        )
        spark.catalog.refreshTable(table.name)  # others may have written meanwhile
        return table

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows; those hashed by the key into as many partitions as there are buckets give a file each."""
        rows.select(*self.columns).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forget the catalogue's entry; the files stay, and so do frames already read."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
