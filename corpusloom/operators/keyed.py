"""Tables with a key, of which a batch of changes reads and rewrites only the parts that it touches.

Rows lie partitioned by a hash of their key and, within a part, bucketed and sorted
by the key itself. A batch names the parts of its own keys, at most as many numbers
as the table has parts; the scan is narrowed to those, and as its rows are bucketed
they meet the batch without being shuffled. The parts are then overwritten, all
others are left as they lie. The old files stay until the new ones are committed,
so that a batch which fails may be applied again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ingest import latest
from corpusloom.session import new_folder, stored

PARTS = 16
BUCKETS = 8
PART = "_part"


@dataclass(frozen=True)
class KeyedTable:
    """A table of the session's catalog; keys are its key columns."""

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    parts: int
    buckets: int

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def read(self) -> DataFrame:
        """All rows."""
        return self.spark.table(self.name).drop(PART)

    def touched(self, batch: DataFrame) -> DataFrame:
        """The rows of all parts that hold a key of the batch, with their part."""
        numbers = self._placed(batch.select(*self.keys)).select(PART).distinct().collect()
        return self.spark.table(self.name).where(F.col(PART).isin(sorted(r[0] for r in numbers)))

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched parts by merge(old rows, batch), whose keys must lie in those parts."""
        batch = stored(batch, "keyed-batch")
        old = self.touched(batch)
        rows = self._placed(merge(old.drop(PART), batch).select(*old.drop(PART).columns))
        # Spark does not overwrite what a query reads, so the new parts are written aside first.
        rows = stored(rows.select(*old.columns), "keyed-parts")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.repartition(self.buckets, *self.keys).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)

    def upsert(self, fresh: DataFrame, *order) -> None:
        """Fresh rows take the place of those of their key; of several fresh ones the first in order stays."""
        self.apply(latest(fresh, list(self.keys), *order), lambda old, new: untouched(old, new, self.keys).unionByName(new))

    def delete(self, gone: DataFrame) -> None:
        """Rows of the named keys go."""
        self.apply(gone.select(*self.keys).distinct(), lambda old, new: untouched(old, new, self.keys))


def untouched(old: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without a key of the batch. The batch is sent to the buckets of the old rows."""
    return old.join(batch.select(*keys).hint("merge"), list(keys), "left_anti")


def create(rows: DataFrame, name: str, keys: Sequence[str], *, parts: int = PARTS, buckets: int = BUCKETS, path: str | None = None) -> KeyedTable:
    """Write rows as a keyed table of the catalog, in a folder, by default a new shared one."""
    spark = rows.sparkSession
    table = KeyedTable(spark, name, tuple(keys), parts, buckets)
    placed = table._placed(rows).repartition(buckets, *keys)
    placed.write.partitionBy(PART).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path or new_folder(spark, "keyed")).saveAsTable(name)
    return table
