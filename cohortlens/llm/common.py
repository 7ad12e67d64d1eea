"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir, materialize

__all__ = ["Scratch", "arrow_map", "held_out", "materialize", "read", "smallest", "texts"]

ROWS_AT_ONCE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of every fit: crc32 of the id's text divisible by 5 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def smallest(rows: DataFrame, hashed: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows with the smallest 64-bit hash.

    Hashes are even, so rows above a bound that leaves about four times as many are
    dropped first: what a task sends on does not grow with the number of tasks.
    """
    n = rows.count()
    if n > 8 * most:
        rows = rows.filter(F.col(hashed) <= F.lit(-(1 << 63) + int(4 * most / n * (1 << 64))))
    return rows.orderBy(hashed, *ties).limit(most)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a per-task object: ``make()`` runs once in each task, its result on slices of each batch.

    Slices of ROWS_AT_ONCE rows bound what one call holds, however many rows Arrow puts into a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield step(batch.slice(at, ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)


class Scratch:
    """Tables in a folder of their own under the shared checkpoint folder, deleted when the block ends.

    Only for tables that no lazy result reads after the block. While it runs, the shuffle files of a finished
    write are removed at once (the tables are complete by then), instead of when the driver collects garbage.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(self._CLEAN, None)
        self.spark.conf.set(self._CLEAN, "true")
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read; hashes and numbers do not repeat, so without dictionaries."""
        df.write.option("parquet.enable.dictionary", "false").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self._CLEAN)
        else:
            self.spark.conf.set(self._CLEAN, self.before)
        self._delete(self.folder)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.folder}/{name}")

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
