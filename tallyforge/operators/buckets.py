"""Tables bucketed by one key: a join on the key reads them where they lie and moves only the other side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.session import drop_path, new_path


class Buckets:
    """A table of parquet files, one for each bucket and append, in the shared folder or at a path of its own.

    The bucket of a row lies in the file's name, so a later session that opens the same path with the same key and
    number of buckets reads them alike.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str, key: str, n: int | None = None, path: str | None = None):
        self.spark, self.key = spark, key
        self.n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or new_path(spark, name)
        self.table = f"{name}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({schema}) USING parquet CLUSTERED BY (`{key}`) INTO {self.n} BUCKETS LOCATION '{self.path}'")
        self.columns = spark.table(self.table).columns

    def append(self, df: DataFrame, placed: bool = False) -> None:
        """Add rows; ``placed``: each key's rows lie in one partition of ``df`` already."""
        rows = df.select(*self.columns)
        (rows if placed else rows.repartition(self.n, self.key)).write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def plain(self) -> DataFrame:
        """The rows without the catalogue's entry."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def close(self, files: bool = False) -> None:
        """Forget the table; with ``files`` remove what it wrote."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if files:
            drop_path(self.spark, self.path)
