"""Scans: VCF, variant CSV, pedigree, metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.errors import NoContigsLengthInformationError, NotAVariantCsvError, NotAVCFError, NotVcfHeaderError
from varloom.functions.ids import add_variant_id
from varloom.operators.genotypes import LISTED, WIDE
from varloom.sources.contigs import ContigsLength
from varloom.sources.header import FIXED, VcfHeader, head_lines

PED = "family_id string, personal_id string, father_id string, mother_id string, sex string, affected string"


@dataclass
class Vcf:
    """A scanned VCF: the frame has chr, pos, vid, ref, alt, qual, filter, info[, format, samples...], id."""

    frame: DataFrame
    header: VcfHeader
    contigs: ContigsLength


def read_vcf(spark: SparkSession, path: str, contigs_path: str | None = None, drop_star: bool = False, manage_sv: bool = True, wide: int = WIDE) -> Vcf:
    """Tab-separated body without quoting; short rows are padded with nulls. Lengths of the file win over the header's.

    Files of more than `wide` samples get one list column `_samples` instead of a column for each.
    """
    try:
        header = VcfHeader.from_path(spark, path)
        samples = header.samples_index
    except NotVcfHeaderError as error:
        raise NotAVCFError(path) from error
    contigs = ContigsLength.from_path(spark, contigs_path) if contigs_path else ContigsLength.of([])
    if not contigs.rows:
        contigs = ContigsLength.from_vcf_header(header)
    if not contigs.rows:
        raise NoContigsLengthInformationError
    many = len(samples or ())
    names = [*FIXED, *(["format", *([LISTED] if many > wide else samples)] if many else [])]
    if many > wide:
        parts = F.split("value", "\t")
        body = spark.read.text(path).where(~F.col("value").startswith("#"))
        fixed = [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names[:-1])]
        frame = body.select(*fixed, F.slice(parts, len(names), many).alias(LISTED))
    else:
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        frame = spark.read.csv(path, schema=schema, sep="\t", comment="#", header=False, quote="", escape="", ignoreLeadingWhiteSpace=False)
    frame = frame.withColumn("pos", F.col("pos").cast("long"))
    if drop_star:
        frame = frame.where("alt <> '*'")
    extra = []
    if manage_sv:
        extra = header.info_parser({"SVTYPE", "SVLEN"})
        frame = frame.select("*", *extra)
    frame = add_variant_id(frame, contigs.frame(spark), contigs.genome_length)
    return Vcf(frame.select(*[f"`{n}`" for n in names], "id"), header, contigs)


@dataclass
class ColRename:
    """Names that a variant CSV uses; others maps further columns."""

    chromosome: str = "chr"
    pos: str = "pos"
    ref: str = "ref"
    alt: str = "alt"
    others: dict[str, str] = field(default_factory=dict)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, **({"header": True} | options))


def read_variant_csv(spark: SparkSession, path: str, rename: ColRename | None = None, **options) -> DataFrame:
    rename = rename or ColRename()
    to = {rename.chromosome: "chr", rename.pos: "pos", rename.ref: "ref", rename.alt: "alt"} | rename.others
    frame = read_csv(spark, path, **options).withColumnsRenamed(to)
    if not {"chr", "pos", "ref", "alt"} <= set(frame.columns):
        raise NotAVariantCsvError(path)
    return frame.withColumn("pos", F.col("pos").cast("long"))


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """Six tab-separated columns; `None` and `unknown` are null."""
    frame = spark.read.csv(path, schema=PED, sep="\t", header=False)
    known = {c: F.when(F.col(c).isin("None", "unknown"), None).otherwise(F.col(c)) for c in frame.columns}
    known["affected"] = known["affected"].try_cast("boolean")
    return frame.withColumns(known)


def read_metadata(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """csv, tsv, ljson (a JSON object for each line) or json (one array); columns as the source orders them."""
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == "csv" else "\t")
    if kind not in ("ljson", "json"):
        raise ValueError(f"unknown metadata type {kind}")
    frame = spark.read.json(path, multiLine=kind == "json")
    return frame.select([f"`{c}`" for c in _source_order(spark, path, frame.columns)])


def _source_order(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """Spark sorts JSON columns by name; the first object tells the source's order."""
    text, order = "", {}
    for line in head_lines(spark, path, ""):
        text += line + "\n"
        try:
            order, _ = json.JSONDecoder(object_pairs_hook=lambda pairs: dict(pairs)).raw_decode(text.lstrip().lstrip("[").lstrip())
            break
        except ValueError:
            continue
    return [*(c for c in order if c in columns), *(c for c in columns if c not in order)]
