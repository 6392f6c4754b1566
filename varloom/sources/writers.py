"""Sinks: VCF text, headers, pedigrees, Parquet."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType

from varloom.functions.ids import as_unsigned
from varloom.operators.genotypes import LISTED
from varloom.sources.header import VcfHeader


@dataclass
class RowNames:
    """Which columns make which VCF fields. sample: name -> {FORMAT key: column}."""

    chromosome: str = "chr"
    pos: str = "pos"
    id: str = "id"
    ref: str = "ref"
    alt: str = "alt"
    qual: str | None = None
    filter: str | None = None
    info: list[tuple[str, str]] = field(default_factory=list)
    format: str = ""
    sample: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Names in the order of the list column `_samples`, and its key for each FORMAT key, instead of columns for each sample.
    listed: list[str] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.qual = None if self.qual == "." else self.qual
        self.filter = None if self.filter == "." else self.filter


def _name(column: str) -> Column:
    return F.col(f"`{column.replace('`', '``')}`")


def _declaration(section: str, name: str, kind: DataType) -> str:
    number = "." if isinstance(kind, ArrayType) else "1"
    item = kind.elementType if isinstance(kind, ArrayType) else kind
    what = "Integer" if isinstance(item, LongType) else "Float" if isinstance(item, DoubleType) else "String"
    return f'##{section}=<ID={name},Number={number},Type={what},Description="Column of the source table">'


def header_lines(frame: DataFrame, names: RowNames, source: str = "varloom") -> list[str]:
    """INFO lines typed from the schema, FORMAT lines as text, as the values were rebuilt."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    lines = ["##fileformat=VCFv4.3", f"##source={source}"]
    lines += [_declaration("INFO", name, kinds[column]) for column, name in names.info]
    for key in [k for k in names.format.split(":") if k]:
        if names.listed:
            held = {f.name: f.dataType for f in kinds[LISTED].elementType.fields}.get(names.keys.get(key, ""))
        else:
            held = kinds.get(next((s[key] for s in names.sample.values() if key in s), ""))
        listed = isinstance(held, ArrayType)
        lines.append(f'##FORMAT=<ID={key},Number={"." if listed else "1"},Type=String,Description="Column of the source table">')
    return lines


def column_line(names: RowNames) -> str:
    return "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *(names.listed or names.sample)] if names.format else [])])


def _text(column: Column, kind: DataType, empty: str = ".") -> Column:
    """A value or the comma-joined items; null is a dot."""
    if isinstance(kind, ArrayType):
        column = F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
    return F.coalesce(column.cast("string"), F.lit(empty))


def info_column(frame: DataFrame, info: list[tuple[str, str]]) -> Column:
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    parts = [F.concat(F.lit(f"{name}="), _text(_name(column), kinds[column])) for column, name in info]
    return F.concat_ws(";", *parts) if parts else F.lit(".")


def _sample_text(keys: list[str], columns: dict[str, tuple[Column, DataType]]) -> Column:
    parts = []
    for key in keys:
        if key not in columns:
            parts.append(F.lit("."))
        elif key == "GT":
            gt = columns[key][0]
            parts.append(F.when(gt == 1, "0/1").when(gt == 2, "1/1").otherwise(F.coalesce(gt.cast("string"), F.lit("./."))))
        else:
            parts.append(_text(*columns[key]))
    return F.concat_ws(":", *parts)


def sample_columns(frame: DataFrame, names: RowNames) -> list[Column]:
    """The samples' fields: a column for each, or all of a list in one, joined by tabs."""
    keys, kinds = names.format.split(":"), {f.name: f.dataType for f in frame.schema.fields}
    if names.listed:
        item = {f.name: f.dataType for f in kinds[LISTED].elementType.fields}
        empty = F.array_repeat(F.lit(None).cast(kinds[LISTED].elementType), F.lit(len(names.listed)))
        told = F.transform(F.coalesce(LISTED, empty), lambda x: _sample_text(keys, {k: (x[c], item[c]) for k, c in names.keys.items()}))
        return [F.array_join(told, "\t")]
    return [_sample_text(keys, {k: (_name(c), kinds[c]) for k, c in own.items()}) for own in names.sample.values()]


def vcf_lines(frame: DataFrame, names: RowNames) -> DataFrame:
    """One text column with the lines of the body, no order implied."""
    kinds = dict(frame.dtypes)
    id_ = _name(names.id)
    fixed = [
        F.coalesce(_name(names.chromosome).cast("string"), F.lit("")), F.coalesce(_name(names.pos).cast("string"), F.lit("")),
        F.coalesce((as_unsigned(id_) if kinds[names.id] == "bigint" else id_).cast("string"), F.lit(".")),
        F.coalesce(_name(names.ref), F.lit("")), F.coalesce(_name(names.alt), F.lit("")),
        F.coalesce(_name(names.qual).cast("string"), F.lit(".")) if names.qual else F.lit("."),
        F.coalesce(_name(names.filter).cast("string"), F.lit(".")) if names.filter else F.lit("."),
        info_column(frame, names.info),
    ]
    if names.format:
        fixed += [F.lit(names.format), *sample_columns(frame, names)]
    return frame.select(F.concat_ws("\t", *fixed).alias("value"))


def in_order(frame: DataFrame, names: RowNames, contigs: list[str]) -> DataFrame:
    """By chromosome, position and alleles. Chromosomes of the header come in its order, others by number, then by name."""
    chromosome = _name(names.chromosome).cast("string")
    declared = F.array_position(F.array(*map(F.lit, contigs)), chromosome) if contigs else F.lit(0)
    first = F.when(declared > 0, declared)
    number = F.regexp_extract(chromosome, r"^(?:chr)?(\d+)$", 1).try_cast("long")
    return frame.orderBy(F.asc_nulls_last(first), F.asc_nulls_last(number), chromosome, _name(names.pos), _name(names.ref), _name(names.alt))


def write_vcf(frame: DataFrame, path: str, names: RowNames | None = None, header: VcfHeader | None = None, sharded: bool = False) -> None:
    """A VCF in (chromosome, position) order, written by the executors in sorted parts.

    sharded: a folder of the header and the parts, which `read_vcf` reads as one file; nothing passes through the driver. Else
    one file: the driver streams the parts' bytes behind the header, by Spark's file systems.
    """
    names = names or RowNames()
    lines = [line for line in header.lines if not line.startswith("#CHROM")] if header else header_lines(frame, names)
    contigs = [m[1] for line in lines if (m := re.match(r"##contig=<.*?ID=([^,>]+)", line))]
    head = "".join(f"{line}\n" for line in [*lines, column_line(names)])
    body = vcf_lines(in_order(frame, names, contigs), names)
    if sharded:
        write_sharded(body, path, head)
        return
    parts = f"{path}.parts"
    body.write.mode("overwrite").text(parts)
    jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    files = target.getFileSystem(conf)
    out = files.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(s.getPath().getName() for s in files.listStatus(folder)):
            if name.startswith("part-"):
                part = files.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
    finally:
        out.close()
    files.delete(folder, True)


def write_sharded(body: DataFrame, path: str, head: str, compression: str = "none") -> None:
    """Lines as a folder of text parts, and the header as the file that sorts first."""
    body.write.mode("overwrite").option("compression", compression).text(path)
    write_text(body, f"{path}/00-header.vcf", head)


def write_text(frame: DataFrame, path: str, text: str) -> None:
    """A small driver-side text as one file, by Spark's file systems."""
    spark = frame.sparkSession if isinstance(frame, DataFrame) else frame
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_headers(spark, path: str, header: VcfHeader) -> None:
    write_text(spark, path, "".join(f"{line}\n" for line in header.lines))


def write_pedigree(pedigree: DataFrame, path: str) -> None:
    """Tab-separated without header; a family's rows number a few. Null is `unknown`."""
    columns = ["family_id", "personal_id", "father_id", "mother_id", "sex", "affected"]
    rows = pedigree.select(columns).toLocalIterator()
    told = {None: "unknown", True: "true", False: "false"}
    text = "".join("\t".join(told.get(v, v) for v in row) + "\n" for row in rows)
    write_text(pedigree, path, text)


def write_parquet(frame: DataFrame, path: str, append: bool = False) -> None:
    """Append checks that what is there has the same columns and types; a missing table is written anew."""
    spark = frame.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if append and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = [(f.name, f.dataType) for f in spark.read.parquet(path).schema.fields]
        if there != [(f.name, f.dataType) for f in frame.schema.fields]:
            raise ValueError(f"{path} has other columns: {there}")
        frame.write.mode("append").parquet(path)
    else:
        frame.write.mode("overwrite").parquet(path)
