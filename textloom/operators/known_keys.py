"""Keys of stored rows in buckets: a batch finds what is known while the stored side stays where it lies.

A plain join of a batch with all stored keys shuffles the stored side each time. Here the keys (by default tenant and URL hash)
are an external Parquet table in buckets of their hash, and a batch is dealt into as many partitions by the same hash, so that
only the batch moves. A bucket's rows are read by one task: choose `buckets` so that a bucket fits one (a key takes about
100 bytes; 10,000 buckets hold 1e10 keys of 100 MB a bucket), and go on with `rewritten` when they have grown or hold many files.

The table is an index of contents, not their store: add keys after the contents are committed. `add` takes only unknown keys,
so a call that is repeated, or given all contents after a crash, mends it. One writer at a time.

Defined cases: a null key is never known and never added; of rows with the same key that are added together the smallest id
stays; a table without rows knows nothing.
"""

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KnownKeys:
    spark: SparkSession
    path: str
    buckets: int = 200
    keys: tuple[str, ...] = ("workspace_id", "url_hash")
    id_type: str = "long"

    def __post_init__(self):
        if self.buckets < 1:
            raise ValueError("buckets must be 1 or more")

    @property
    def name(self) -> str:
        """The table's name in the session's catalog: the same for the same folder, keys and buckets."""
        return "known_keys_" + hashlib.sha256(repr((self.path, self.buckets, self.keys)).encode()).hexdigest()[:16]

    def read(self) -> DataFrame:
        """The keys and id. A session that does not know the table yet takes it from its folder."""
        columns, by = ", ".join([*[f"`{k}` string" for k in self.keys], f"id {self.id_type}"]), ", ".join(f"`{k}`" for k in self.keys)
        place = self.path.replace("'", "\\'")
        self.spark.sql(f"create table if not exists {self.name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{place}'")
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows where their buckets are. Reduce rows of the same key first, as one task gets them all."""
        return rows.repartition(self.buckets, *self.keys)

    def without(self, rows: DataFrame) -> DataFrame:
        """Rows whose keys are not known."""
        return self.dealt(rows).join(self.read().select(*self.keys), list(self.keys), "left_anti")

    def found(self, rows: DataFrame, id_name: str = "content_id") -> DataFrame:
        """Rows whose keys are known, with the stored id."""
        return self.dealt(rows).join(self.read().withColumnRenamed("id", id_name), list(self.keys))

    def add(self, rows: DataFrame) -> None:
        """Keys that are not known yet, with their ids."""
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        once = rows.where(present).groupBy(*self.keys).agg(F.min("id").cast(self.id_type).alias("id"))
        self.without(once).select(*self.keys, "id").write.insertInto(self.name)

    def rewritten(self, path: str, buckets: int) -> "KnownKeys":
        """The same keys in another folder, one file to a bucket."""
        new = KnownKeys(self.spark, path, buckets, self.keys, self.id_type)
        new.read()
        new.dealt(self.read()).write.insertInto(new.name)
        return new
