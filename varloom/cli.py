"""Command line: vcf2parquet, parquet2vcf, struct, transmission, metadata. Subcommands of a group may be chained."""

from __future__ import annotations

import argparse
import importlib.util
import math
import os
import platform
import sys
from importlib import metadata as metadata_of

from pyspark.sql import functions as F

from varloom import session
from varloom.errors import NoContigsLengthInformationError, NoGenotypeError, NotAVCFError, NotVcfHeaderError
from varloom.operators.genotypes import LISTED, add_genotypes, genotypes
from varloom.operators.transmission import transmission, transmission_ped
from varloom.operators.variants import annotations, variants
from varloom.plans.layout import hive_genotypes, merge_variants
from varloom.sources.header import VcfHeader
from varloom.sources.readers import read_metadata, read_pedigree, read_vcf
from varloom.sources.writers import RowNames, write_headers, write_parquet, write_vcf

PACKAGES = ("pyspark", "py4j", "pyarrow", "pandas", "numpy")
BAD_HEADER, NOT_A_VCF, NO_CONTIGS, NO_FAMILY = 11, 12, 13, 31
GROUPS = {"vcf2parquet": ("variants", "genotypes", "annotations", "headers"), "struct": ("variants", "genotypes")}


def _bool(text: str) -> bool:
    if text.lower() in ("true", "1", "yes", "on", "t", "y"):
        return True
    if text.lower() in ("false", "0", "no", "off", "f", "n"):
        return False
    raise argparse.ArgumentTypeError(f"{text} is neither true nor false")


def _root() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("varloom", description="Genomic variants in Parquet tables.")
    p.add_argument("-t", "--threads", type=int, default=1)
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--debug-info", action="store_true")
    p.add_argument("command", nargs="?", choices=("metadata", "parquet2vcf", "struct", "transmission", "vcf2parquet"))
    p.add_argument("rest", nargs=argparse.REMAINDER)
    return p


def _parser(name: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(f"varloom {name}")
    add = p.add_argument
    if name == "vcf2parquet":
        add("-i", "--input-path", required=True)
        add("-c", "--chrom2length-path")
        add("-a", "--append", action="store_true")
        add("-s", "--drop-star", "--keep-star", type=_bool, default=False, dest="drop_star", help="drop star alleles")
    elif name == "vcf2parquet variants" or name == "vcf2parquet headers":
        add("-o", "--output-path", required=True)
    elif name == "vcf2parquet genotypes":
        add("-o", "--output-path", required=True)
        add("-f", "--format-string", default="GT:AD:DP:GQ")
    elif name == "vcf2parquet annotations":
        add("-o", "--output-path", required=True)
        add("-i", "--info", nargs="+", default=[])
        add("-r", "--rename-id")
    elif name == "parquet2vcf":
        add("-v", "--variants-path", required=True)
        add("-o", "--output-path", required=True)
        add("-g", "--genotypes-path")
        add("-H", "--headers-path")
        add("-s", "--select-chromosome")
        for short, long, default in (("-c", "chromosome", "chr"), ("-p", "position", "pos"), ("-I", "identifier", "id"), ("-r", "reference", "ref"), ("-a", "alternative", "alt"), ("-q", "quality", None), ("-f", "filter", None)):
            add(short, f"--{long}", default=default)
        add("-F", "--format-string", default="GT:AD:DP:GQ")
        add("--sharded", action="store_true", help="a folder of parts instead of one file")
    elif name == "struct":
        add("-i", "--input-paths", nargs="+", required=True)
        add("-a", "--append", action="store_true")
    elif name == "struct variants":
        add("-o", "--output-prefix", required=True)
        add("-c", "--chunk-size", type=int, default=1_000_000, help="accepted; Spark sizes its own tasks")
        add("-p", "--threads", "--polars-threads", type=int, default=4, help="accepted; Spark sizes its own tasks")
    elif name == "struct genotypes":
        add("-p", "--prefix-path", required=True)
        add("-m", "--partition-mode", choices=("random", "position"), default="position", help="accepted; partitions follow the id")
        add("-n", "--number-of-partitions", type=int, default=256)
        add("-f", "--file-per-thread", type=int, default=15, help="accepted; Spark sizes its own tasks")
        add("-P", "--threads", "--polars-threads", type=int, default=4, help="accepted; Spark sizes its own tasks")
    elif name == "transmission":
        add("-g", "--genotypes-path", required=True)
        add("-p", "--pedigree-path")
        add("-i", "--index")
        add("-m", "--mother")
        add("-f", "--father")
        add("-o", "--output-path", required=True)
    elif name == "metadata":
        add("-i", "--input-path", required=True)
        add("-o", "--output-path", required=True)
        add("-t", "--input-type", choices=("csv", "tsv", "ljson", "json"), required=True)
    return p


def _chain(command: str, rest: list[str]) -> tuple[argparse.Namespace, list[tuple[str, argparse.Namespace]]]:
    """The group's options, then each subcommand with its own."""
    marks = [k for k, word in enumerate(rest) if word in GROUPS[command] and (k == 0 or rest[k - 1] not in ("-o", "-i", "-p"))]
    group = _parser(command).parse_args(rest[: marks[0]] if marks else rest)
    ends = [*marks[1:], len(rest)]
    return group, [(rest[b], _parser(f"{command} {rest[b]}").parse_args(rest[b + 1 : e])) for b, e in zip(marks, ends, strict=True)]


def vcf2parquet(spark, rest: list[str]) -> int:
    options, steps = _chain("vcf2parquet", rest)
    try:
        vcf = read_vcf(spark, options.input_path, options.chrom2length_path, options.drop_star)
    except NotVcfHeaderError:
        return BAD_HEADER
    except NotAVCFError as error:
        print(error, file=sys.stderr)
        return NOT_A_VCF
    except NoContigsLengthInformationError as error:
        print(error, file=sys.stderr)
        return NO_CONTIGS
    frame = vcf.frame.persist() if len(steps) > 1 else vcf.frame  # one scan for all outputs
    try:
        for step, own in steps:
            if step == "headers":
                write_headers(spark, own.output_path, vcf.header)
                continue
            if step == "variants":
                out = variants(frame)
            elif step == "genotypes":
                out = genotypes(frame, vcf.header.format_parser(), own.format_string, list(vcf.header.samples_index or {}))
            else:
                out = annotations(frame, vcf.header, own.info, own.rename_id)
            write_parquet(out, own.output_path, options.append)
    except NoGenotypeError as error:
        print(error, file=sys.stderr)
        return NOT_A_VCF
    finally:
        frame.unpersist()
    return 0


def parquet2vcf(spark, rest: list[str]) -> int:
    o = _parser("parquet2vcf").parse_args(rest)
    frame = spark.read.parquet(o.variants_path)
    if o.select_chromosome:
        frame = frame.where(F.col(o.chromosome) == o.select_chromosome)
    header = VcfHeader.from_files(spark, o.headers_path) if o.headers_path else None
    names = RowNames(o.chromosome, o.position, o.identifier, o.reference, o.alternative, o.quality, o.filter)
    if o.genotypes_path:
        long = spark.read.parquet(o.genotypes_path)
        samples = sorted(r[0] for r in long.select("sample").distinct().collect())  # as many as a VCF has columns
        frame = add_genotypes(frame, long.drop("id_part"), samples)
        keys = [k for k in o.format_string.split(":") if k.lower() in long.columns]
        names.format = o.format_string
        if LISTED in frame.columns:
            names.listed, names.keys = samples, {k: k.lower() for k in keys}
        else:
            names.sample = {s: {k: f"{s}_{k.lower()}" for k in keys} for s in samples}
    write_vcf(frame, o.output_path, names, header, o.sharded)
    return 0


def struct(spark, rest: list[str]) -> int:
    options, steps = _chain("struct", rest)
    for step, own in steps:
        if step == "variants":
            merge_variants(spark, options.input_paths, own.output_prefix, options.append)
        else:
            bits = math.ceil(math.log2(max(1, own.number_of_partitions)))
            hive_genotypes(spark, options.input_paths, own.prefix_path, options.append, bits)
    return 0


def transmit(spark, rest: list[str]) -> int:
    o = _parser("transmission").parse_args(rest)
    found = spark.read.parquet(o.genotypes_path)
    if o.pedigree_path:
        out = transmission_ped(found, read_pedigree(spark, o.pedigree_path))
    elif o.index:
        out = transmission(found, o.index, o.mother, o.father)
    else:
        print("a pedigree or an index sample is needed", file=sys.stderr)
        return NO_FAMILY
    write_parquet(out, o.output_path)
    return 0


def metadata(spark, rest: list[str]) -> int:
    o = _parser("metadata").parse_args(rest)
    write_parquet(read_metadata(spark, o.input_path, o.input_type).coalesce(1), o.output_path)
    return 0


COMMANDS = {"vcf2parquet": vcf2parquet, "parquet2vcf": parquet2vcf, "struct": struct, "transmission": transmit, "metadata": metadata}


def debug_info() -> list[str]:
    """Versions of this machine's Python, system and packages, and the settings in its environment that Spark reads."""
    packages = {name: metadata_of.version(name) for name in PACKAGES if importlib.util.find_spec(name) is not None}
    known = {k: v for k, v in sorted(os.environ.items()) if k.startswith(("SPARK_", "PYSPARK_", "JAVA_HOME", "HADOOP_"))}
    return [
        f"python: {platform.python_version()} ({sys.executable})", f"system: {platform.platform()}",
        *(f"{name}: {version}" for name, version in packages.items()), *(f"{k}={v}" for k, v in known.items()),
    ]


def main(args: list[str] | None = None, spark=None) -> int:
    options = _root().parse_args(args)
    if options.debug_info:
        print("\n".join(debug_info()))
        return 0
    if options.command is None:
        _root().print_help()
        return 0
    spark = spark or session.build(options.threads)
    spark.sparkContext.setLogLevel(("ERROR", "WARN", "INFO", "DEBUG", "TRACE")[min(options.verbose, 4)])
    return COMMANDS[options.command](spark, options.rest)


if __name__ == "__main__":
    sys.exit(main())
