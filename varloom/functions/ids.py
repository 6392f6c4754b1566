"""The 64-bit variant id, its partition, and allele rewrites, as built-in expressions.

A short variant packs its absolute position, the length of ref and two bits for each base of alt, so ids sort by genome
position. A long one has bit 63 set (a negative long) and a hash below. `as_unsigned` shows ids as other tools write them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_DIGITS = 15


def bits(value: int) -> int:
    return max(0, int(value)).bit_length()


def position_shift(genome_length: int) -> int:
    """Bits left for alleles beside the largest absolute position and the sign."""
    return 63 - bits(genome_length)


def pad_length(genome_length: int) -> int:
    """The fewest bases of alt that no longer fit a short id."""
    return (64 - bits(genome_length) - 2) // 2 + 1


def sequence_bits(seq: Column) -> Column:
    """Two bits for each base (A 0, C 1, T 2, G 3; N as G), as a base-4 number; empty is 0."""
    digits = F.translate(seq, "ACTGNactgn", "0123301233")
    return F.when(F.length(seq) == 0, F.lit(0)).otherwise(F.conv(digits, 4, 10).cast("decimal(20,0)")).cast("long")


def _odd_bases(seq: Column) -> Column:
    """Two bits of any character by the same rule, for alleles beyond the usual letters."""
    return F.aggregate(
        F.filter(F.split(seq, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda done, c: F.shiftleft(done, 2).bitwiseOR(F.shiftright(F.ascii(c), 1).bitwiseAND(F.lit(3)).cast("long")),
    )


def long_id(real_pos: Column, ref: Column, alt: Column) -> Column:
    text = F.concat_ws("|", real_pos.cast("string"), ref, alt)
    digest = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")
    return digest.bitwiseOR(F.lit(-(2**63)).cast("long"))


def variant_id(real_pos: Column, ref: Column, alt: Column, genome_length: int) -> Column:
    """Null if any part is null."""
    shift = position_shift(genome_length)
    ref_len, alt_bits = F.length(ref), F.length(alt) * 2
    used = F.when(ref_len > 0, F.length(F.bin(ref_len.cast("long")))).otherwise(0) + alt_bits
    coded = F.when(alt.rlike("^[ACTGNactgn]*$"), sequence_bits(alt)).otherwise(_odd_bases(alt))
    length = F.call_function("shiftleft", ref_len.cast("long"), alt_bits)
    short = F.shiftleft(real_pos.cast("long"), shift).bitwiseOR(length).bitwiseOR(coded)
    known = real_pos.isNotNull() & ref.isNotNull() & alt.isNotNull()
    return F.when(known & (used <= shift), short).when(known, long_id(real_pos, ref, alt))


def id_part(id_: Column, number_of_bits: int = 8) -> Column:
    """The top bits below the sign; long variants share the last partition. No bits: partition 0."""
    if not 0 <= number_of_bits <= 63:
        raise ValueError("number_of_bits must lie between 0 and 63")
    if number_of_bits == 0:
        return F.when(id_.isNotNull(), F.lit(0).cast("long"))
    top = F.shiftrightunsigned(F.shiftleft(id_, 1), 64 - number_of_bits)
    return F.when(id_ < 0, F.lit(2**number_of_bits - 1).cast("long")).otherwise(top)


def as_unsigned(id_: Column) -> Column:
    return F.when(id_ < 0, id_.cast("decimal(20,0)") + F.lit(Decimal(2**64))).otherwise(id_).cast("decimal(20,0)")


def from_unsigned(id_: Column) -> Column:
    """Ids that another tool wrote as UINT_64, which Spark reads as decimal(20,0)."""
    wide = id_.cast("decimal(20,0)")
    return F.when(wide >= F.lit(Decimal(2**63)), wide - F.lit(Decimal(2**64))).otherwise(wide).cast("long")


def expand_star(alt: Column, genome_length: int) -> Column:
    """The first `*` becomes a run too long for a short id."""
    return F.regexp_replace(alt, r"^([^*]*)[*]", "$1" + "*" * pad_length(genome_length))


def rewrite_sv(alt: Column, svtype: Column, svlen: Column, genome_length: int) -> Column:
    """A symbolic allele of the declared type becomes TYPE-LENGTH, padded with `-` to a long variant; others stay."""
    bare = F.regexp_replace(alt, "<([^:>]+).*>", "$1")
    name = F.concat_ws("-", svtype, svlen.cast("string"))
    padded = F.rpad(name, F.greatest(F.length(name), F.lit(pad_length(genome_length))), "-")
    return F.when((bare == svtype) & (bare != alt), padded).otherwise(alt)


def add_variant_id(variants: DataFrame, contigs: DataFrame, genome_length: int) -> DataFrame:
    """Adds id. Structural alleles are rewritten if SVTYPE and SVLEN are present, stars expanded; unknown contigs give null.

    contigs (contig, offset) is built on the driver from a header, a few thousand rows at most, and broadcast.
    """
    kinds = dict(variants.dtypes)
    if {"SVTYPE", "SVLEN"} <= set(kinds):
        length = F.get("SVLEN", F.lit(0)) if kinds["SVLEN"].startswith("array") else F.col("SVLEN")
        variants = variants.withColumn("alt", rewrite_sv(F.col("alt"), F.col("SVTYPE"), length, genome_length))
    variants = variants.withColumn("alt", expand_star(F.col("alt"), genome_length))
    offsets = F.broadcast(contigs.select(F.col("contig").alias("_contig"), F.col("offset").alias("_offset")))
    joined = variants.join(offsets, F.col("chr") == F.col("_contig"), "left")
    id_ = variant_id(F.col("pos") + F.col("_offset"), F.col("ref"), F.col("alt"), genome_length)
    return joined.withColumn("id", id_).drop("_contig", "_offset")


def add_id_part(frame: DataFrame, number_of_bits: int = 8) -> DataFrame:
    return frame.withColumn("id_part", id_part(F.col("id"), number_of_bits))


def id_range(contigs: list[tuple[str, int, int]], genome_length: int, chromosome: str, first: int, last: int) -> tuple[int, int]:
    """Bounds of the short ids of a region, for a pushed-down filter; long variants (id < 0) must be looked at besides."""
    offset = {name: off for name, _, off in contigs}[chromosome]
    shift = position_shift(genome_length)
    return (first + offset) << shift, ((last + offset + 1) << shift) - 1


def register_sql(spark: SparkSession) -> None:
    """variant_id(pos, ref, alt, genome_length) and variant_id_part(id, bits) for SQL."""
    shift = "(63 - length(bin(g)))"
    short = (
        f"shiftleft(p, {shift}) | shiftleft(cast(length(r) as bigint), 2 * length(a)) | aggregate(filter(split(a, ''), c -> c <> ''), 0L, "
        "(done, c) -> shiftleft(done, 2) | cast(shiftright(ascii(c), 1) & 3 as bigint))"
    )
    long_ = f"(-9223372036854775807L - 1L) | cast(conv(substring(md5(concat_ws('|', cast(p as string), r, a)), 1, {HASH_DIGITS}), 16, 10) as bigint)"
    used = "(CASE WHEN length(r) > 0 THEN length(bin(cast(length(r) as bigint))) ELSE 0 END + 2 * length(a))"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION variant_id(p BIGINT, r STRING, a STRING, g BIGINT) RETURNS BIGINT RETURN "
        f"CASE WHEN p IS NULL OR r IS NULL OR a IS NULL THEN NULL WHEN {used} <= {shift} THEN {short} ELSE {long_} END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION variant_id_part(i BIGINT, n INT) RETURNS BIGINT RETURN "
        "CASE WHEN i < 0 THEN shiftleft(1L, n) - 1 WHEN n = 0 THEN 0L ELSE shiftrightunsigned(shiftleft(i, 1), 64 - n) END"
    )
