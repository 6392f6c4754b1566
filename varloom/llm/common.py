"""What the operators of this subpackage share: reading, checkpoints, key ranges."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken at least, in hash order, to place range boundaries. They only decide how rows are dealt, never a result.
BOUNDARY_SAMPLE = 5000
HASH_SPAN = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. One of few files, whose row groups few tasks would read, is dealt out, needed columns only."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= cores and len(df.inputFiles()) < min(cores, 4)
    return df.repartition(cores) if few else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder that spark.checkpoint.dir names.

    Where the setting is missing (local tests) a folder of this machine is used; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="varloom-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """As checkpointed, but as a table in that folder: for loops, whose plans would carry size estimates that multiply.

    The table that it replaces is deleted.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if replaces is not None and hasattr(replaces, "written_to"):
        at = spark._jvm.org.apache.hadoop.fs.Path(replaces.written_to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_hash(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(HASH_SPAN))


def below(rows: int, of: int) -> int:
    """A hash under which about twice `rows` of `of` rows lie, and all where they are few."""
    return HASH_SPAN if of <= 2 * rows + 1000 else int(HASH_SPAN * (2 * rows + 1000) / of)


def first_by_hash(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The first rows in hash order. A filter goes before the sort, so tasks send a few rows each, however many they are."""
    order = by_hash(columns)
    return df.where(order < below(rows, df.count())).orderBy(order, *columns).limit(rows)


def boundaries(df: DataFrame, key: str, buckets: int, by: str | None = None) -> list:
    """At most buckets - 1 ascending values that divide the key's range about evenly.

    They come from a bounded sample in hash order (of the column `by`), so the same table always gives the same boundaries.
    """
    if buckets < 2:
        return []
    known = df.where(F.col(key).isNotNull())
    keys = sorted(row[key] for row in first_by_hash(known, [by or key], max(BOUNDARY_SAMPLE, 20 * buckets)).select(key).collect())
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def by_bucket(df: DataFrame, bucket: str, buckets: int) -> DataFrame:
    """One partition for each bucket number: no two buckets meet, as hashing them would let them."""
    return df.repartitionById(max(1, buckets), F.col(bucket).cast("int"))


def text_values(column) -> list[str]:
    """An Arrow text column as Python strings; nulls are empty texts."""
    return [t if t is not None else "" for t in column.to_pylist()]


def as_u64(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)
