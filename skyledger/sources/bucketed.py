"""Tables stored for joins on the hour: bucketed and sorted by the hour's keys, one folder per year.

Two such tables with as many buckets join bucket by bucket: the shuffle was paid
for when they were written. A year that was computed again replaces its folder
and nothing else. Bucketed tables live in the session's catalog; their data and
its layout stay in the folder, so another session opens it again by its path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schema import HOUR_KEYS

_FOLDER = "part_year"
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class BucketedTable:
    """Where a table lies and how it is laid out. Tables to be joined need equal ``buckets`` and ``keys``."""

    path: str
    schema: str
    buckets: int
    keys: tuple[str, ...] = tuple(HOUR_KEYS)

    def _name(self, spark: SparkSession, fresh: bool = False) -> str:
        """The table's name in this session's catalog, where it is entered if it isn't yet, with the years it has unless it is ``fresh``."""
        name = "hours_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        if not spark.catalog.tableExists(name):
            keys = ", ".join(f"`{k}`" for k in self.keys)
            spark.sql(
                f"CREATE TABLE {name} ({self.schema}, {_FOLDER} INT) USING parquet PARTITIONED BY ({_FOLDER}) "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            if not fresh:
                spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def read(self, spark: SparkSession, years: Sequence[int] | None = None) -> DataFrame:
        """A3. The rows, of some ``years`` if named: only their folders are read."""
        rows = spark.table(self._name(spark))
        if years is not None:
            rows = rows.where(F.col(_FOLDER).isin(*map(int, years)))
        return rows.drop(_FOLDER)

    def replace_years(self, df: DataFrame, fresh: bool = False) -> None:
        """A6. Stores ``df`` in place of all rows of the years it holds; other years' files stay as they are.

        Rows are dealt to tasks as to buckets, so each task writes one file per
        bucket and year and a reader finds its bucket sorted. ``fresh`` says that
        the table has no rows yet.
        """
        spark = df.sparkSession
        columns = [f.name for f in StructType.fromDDL(self.schema)]
        rows = df.select(*columns, F.col("year").cast("int").alias(_FOLDER)).repartition(self.buckets, *self.keys)
        name = self._name(spark, fresh)
        before = spark.conf.get(_DYNAMIC)
        spark.conf.set(_DYNAMIC, "dynamic")
        try:
            rows.sortWithinPartitions(_FOLDER, *self.keys).write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set(_DYNAMIC, before)


def store_bucketed(df: DataFrame, path: str, buckets: int, keys: Sequence[str] = tuple(HOUR_KEYS)) -> BucketedTable:
    """A6. A new table at ``path`` with the rows of ``df``, which need a ``year``.

    ``buckets`` is chosen once for the tables that will be joined: a bucket of
    all years is what one task reads, so a table of 10 TB wants some 50,000.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = BucketedTable(path.rstrip("/"), schema, buckets, tuple(keys))
    table.replace_years(df, fresh=True)
    return table


def join_stored(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(HOUR_KEYS), suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """D1/D2. Left join of two tables read from equal buckets: a merge of sorted buckets, without any exchange.

    Columns that both sides have are kept apart by ``suffixes``. An hour with a
    missing key part matches nothing here.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    named = [side.withColumnsRenamed({c: c + end for c in clash}) for side, end in zip((left, right), suffixes)]
    return named[0].join(named[1].hint("merge"), list(keys), "left")
