"""Stage tables in patient blocks.

A block is a bucket of patients: the digest of the patient id picks one of `buckets`
files (per split, where the table is parted by split), and a file is sorted by patient
and time. Spark knows this layout, so

* windows, aggregates and scans by patient read a table without a shuffle,
* joins by patient move only the side that is not in blocks, and neither side where
  both are (bucket numbers are powers of two, so blocks of one table are unions of
  those of another),
* the rows of one patient are read from one bucket.

Whole-patient windows need patients of bounded size. The writer counts the rows of each
patient: a patient with more than `most_rows` is dealt to several files of its bucket by
pieces of time, and `segment_minutes` of the opened table tells scans to go on cutting
patients into pieces. Otherwise it is None.

A row of counts and layout beside the table lets another session open it again. Null
patients share a bucket. An empty table has a layout as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.functions import ordered as o

# The stages of one store share the buckets of its first table and have several times its rows.
ROWS_PER_BUCKET, MOST_ROWS = 50_000, 500_000
PIECE_MINUTES = 7 * 1440


@dataclass(frozen=True)
class PatientBlocks:
    """An opened table: `frame` to read it, and how to scan it by patient."""

    frame: DataFrame
    key: str
    buckets: int
    n_rows: int
    largest: int
    most_rows: int

    @property
    def segment_minutes(self) -> int | None:
        return None if self.largest <= self.most_rows else PIECE_MINUTES


def _table_name(path: str) -> str:
    return "blocks_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _note_path(path: str) -> str:
    return path.rstrip("/") + "_layout"


def buckets_for(spark: SparkSession, n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two: blocks of at most about `rows_per_bucket` rows, and one for each core."""
    wanted = max(spark.sparkContext.defaultParallelism, -(-n_rows // rows_per_bucket))
    return 1 << max(0, wanted - 1).bit_length()


def write_blocks(df: DataFrame, path: str, order: Sequence[str] = (), key: str = "patient_id",
                 split: str | None = None, buckets: int | None = None, most_rows: int = MOST_ROWS,
                 piece_minutes: int = PIECE_MINUTES, bounded: bool = False) -> PatientBlocks:
    """Write `df` in blocks of `key`, sorted by `key` and `order`, and open it.

    The leading order column must be a number of minutes where a patient exceeds
    `most_rows`. `df` is read twice, the first time for its keys alone. Where it is `bounded`
    (derived from blocks without oversized patients) it is read once: it is written whole, and
    the rows of the patients are counted in the table written.
    """
    if bounded and buckets:
        _write(df.repartition(buckets, key), path, order, key, split, buckets)
        n_rows, largest = _extent(_sizes(df.sparkSession.table(_table_name(path)), key))
        if largest <= most_rows or not order:
            return _noted(df.sparkSession, path, order, key, split, buckets, n_rows, largest, most_rows)
        # A patient has grown too large on the way: dealt again, as a table of unknown sizes.
    spark = df.sparkSession
    sizes = _sizes(df, key)
    oversized = sizes.filter(F.col("__n") > most_rows).select(F.col(key).alias("__key"))
    n_rows, largest = _extent(sizes)
    buckets = buckets or buckets_for(spark, n_rows)
    if largest > most_rows and order:
        # Only the few oversized patients are spread over the tasks of the write.
        spread = df.join(oversized, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(
            "__piece", F.when(F.col("__key").isNotNull(), o.time_segment(order[0], piece_minutes)).otherwise(F.lit(0)))
        dealt = spread.repartition(buckets, key, "__piece").drop("__key", "__piece")
    else:
        dealt = df.repartition(buckets, key)
    _write(dealt, path, order, key, split, buckets)
    return _noted(spark, path, order, key, split, buckets, n_rows, largest, most_rows)


def _sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))


def _extent(sizes: DataFrame) -> tuple[int, int]:
    """Rows of the table and of its largest patient."""
    return tuple(sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first())


def _write(dealt: DataFrame, path: str, order: Sequence[str], key: str, split: str | None, buckets: int) -> None:
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *order)
    if split:
        writer = writer.partitionBy(split)
    writer.saveAsTable(_table_name(path))


def _noted(spark: SparkSession, path: str, order: Sequence[str], key: str, split: str | None, buckets: int,
           n_rows: int, largest: int, most_rows: int) -> PatientBlocks:
    """Write the row of counts and layout, and open the table."""
    note = spark.range(1).select(
        F.lit(key).alias("key"), F.lit(",".join(order)).alias("sorted_by"), F.lit(split).cast("string").alias("split"),
        F.lit(buckets).alias("buckets"), F.lit(n_rows).cast("long").alias("n_rows"), F.lit(largest).cast("long").alias("largest"),
        F.lit(most_rows).cast("long").alias("most_rows"), F.lit(spark.table(_table_name(path)).schema.toDDL()).alias("columns"))
    note.write.mode("overwrite").parquet(_note_path(path))
    return PatientBlocks(spark.table(_table_name(path)), key, buckets, n_rows, largest, most_rows)


def open_blocks(spark: SparkSession, path: str) -> PatientBlocks:
    """Open a table that this or another session wrote in blocks."""
    note, name = spark.read.parquet(_note_path(path)).first(), _table_name(path)
    if not spark.catalog.tableExists(name):
        sort = ", ".join(f"`{c}`" for c in [note["key"], *filter(None, note["sorted_by"].split(","))])
        parted = f"PARTITIONED BY (`{note['split']}`)" if note["split"] else ""
        spark.sql(f"CREATE TABLE {name} ({note['columns']}) USING parquet {parted} CLUSTERED BY (`{note['key']}`) "
                  f"SORTED BY ({sort}) INTO {note['buckets']} BUCKETS LOCATION '{path}'")
        if note["split"]:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return PatientBlocks(spark.table(name), note["key"], note["buckets"], note["n_rows"], note["largest"], note["most_rows"])
