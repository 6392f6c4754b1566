"""Incremental ingest of VCF files: the append mode of the batch layouts, as a stream over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varloom.functions.ids import add_variant_id
from varloom.operators.variants import new_variants, unique_variants, variants
from varloom.plans.layout import _exists, read_variants
from varloom.sources.contigs import ContigsLength
from varloom.sources.header import FIXED, VcfHeader


def stream_vcf(spark: SparkSession, folder: str, contigs: ContigsLength, samples: list[str] | None = None, files_per_trigger: int = 1000, header: VcfHeader | None = None) -> DataFrame:
    """A stream of the records of all VCF files that appear in the folder, with ids. Files must share their columns.

    header: what the files declare; with SVTYPE and SVLEN structural alleles are rewritten as in a batch scan.
    """
    names = [*FIXED, *(["format", *samples] if samples else [])]
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"sep": "\t", "comment": "#", "quote": "", "escape": "", "maxFilesPerTrigger": files_per_trigger}
    frame = spark.readStream.schema(schema).options(**options).csv(folder)
    frame = frame.withColumn("pos", F.col("pos").cast("long"))
    extra = header.info_parser({"SVTYPE", "SVLEN"}) if header else []
    frame = add_variant_id(frame.select("*", *extra), contigs.frame(spark), contigs.genome_length)
    return frame.select(*[f"`{n}`" for n in names], "id")


def _near(there: DataFrame, found: DataFrame) -> DataFrame:
    """What is there of the batch's chromosomes between its positions: partitions and row groups that are pruned are not read."""
    spans = found.groupBy("chr").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).collect()  # one row for each chromosome
    near = F.lit(False)
    for chr_, low, high in spans:
        near = near | F.col("chr").eqNullSafe(F.lit(chr_)) & (F.col("pos").between(low, high) | F.col("pos").isNull())
    return there.where(near)


def ingest_variants(stream: DataFrame, prefix: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch's new variants into prefix/chr=.../.

    The anti-join with what is there makes a repeated batch harmless, so a restart after a failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        own = unique_variants(variants(batch)).persist()
        new = new_variants(_near(read_variants(spark, prefix), own), own) if _exists(spark, prefix) else own
        new.write.mode("append").partitionBy("chr").parquet(prefix)
        own.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def variant_counts(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Records for each chromosome and arrival window; records later than the watermark are dropped by Spark."""
    timed = stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", late)
    return timed.groupBy(F.window("arrived", window), "chr").agg(F.count(F.lit(1)).alias("n_records"))
