"""Table layouts: variants by chromosome, genotypes by id partition, and joins that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.ids import add_id_part, id_part, id_range
from varloom.operators.variants import VARIANT, new_variants, unique_variants

RECORDS_PER_FILE = 5_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_variants(spark: SparkSession, prefix: str) -> DataFrame:
    """chr stays text, whatever partition names look like."""
    return spark.read.schema("id long, pos long, ref string, alt string, chr string").parquet(prefix).select(*VARIANT)


def merge_variants(spark: SparkSession, paths: list[str], prefix: str, append: bool = False) -> None:
    """De-duplicate the variants of all files into prefix/chr=.../; append adds only those that aren't there.

    Without append the whole table is replaced, whatever the session's overwrite mode is. One exchange for the key; a rebalance by chromosome splits large ones into several files.
    """
    found = unique_variants(spark.read.parquet(*paths))
    there = append and _exists(spark, prefix)
    if there:
        found = new_variants(read_variants(spark, prefix), found)
    dealt = found.hint("rebalance", F.col("chr"))
    writer = dealt.write.mode("append" if there else "overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("partitionOverwriteMode", "static").partitionBy("chr").parquet(prefix)


def hive_genotypes(spark: SparkSession, paths: list[str], prefix: str, append: bool = False, number_of_bits: int = 8) -> None:
    """Genotypes of all files into prefix/id_part=.../.

    Without append the touched partitions are replaced and others stay; append adds and never de-duplicates. Long variants
    share the last partition, so a rebalance may split any partition over tasks and files.
    """
    frame = add_id_part(spark.read.parquet(*paths), number_of_bits)
    dealt = frame.hint("rebalance", F.col("id_part"))
    writer = dealt.write.mode("append" if append else "overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("id_part").parquet(prefix)


def read_genotypes(spark: SparkSession, prefix: str) -> DataFrame:
    return spark.read.parquet(prefix).withColumn("id_part", F.col("id_part").cast("long"))


def join_genotypes(variants: DataFrame, genotypes: DataFrame, number_of_bits: int = 8, how: str = "inner") -> DataFrame:
    """Join on (id_part, id), so that only the partitions of the variants are read (dynamic pruning)."""
    return variants.withColumn("id_part", id_part(F.col("id"), number_of_bits)).join(genotypes, ["id_part", "id"], how)


def lookup_genotypes(genotypes: DataFrame, ids: list[int], number_of_bits: int = 8) -> DataFrame:
    """A few known ids: literal partitions prune statically, ids reach the scan."""
    parts = {2**number_of_bits - 1 if i < 0 else (i << 1 & (2**64 - 1)) >> (64 - number_of_bits) for i in ids}
    return genotypes.where(F.col("id_part").isin(sorted(parts)) & F.col("id").isin(ids))


def region(variants: DataFrame, contigs: list[tuple[str, int, int]], genome_length: int, chromosome: str, first: int, last: int) -> DataFrame:
    """Variants of a genomic region: short ones by an id range that the scan can prune by, long ones by position."""
    low, high = id_range(contigs, genome_length, chromosome, first, last)
    near = F.col("id").between(low, high) | (F.col("id") < 0) | F.col("id").isNull()
    return variants.where(near & (F.col("chr") == chromosome) & F.col("pos").between(first, last))


def register_views(spark: SparkSession, **paths: str) -> None:
    """Parquet tables as views for SQL: variants, genotypes, annotations, pedigree, metadata."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
