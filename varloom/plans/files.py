"""Registered queries through files: adapters written in each format, read back, laid out, appended and run by the command line.

Each query writes into a folder of its own below the shared folder and returns what a scan of the written files finds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom import cli
from varloom.functions.ids import add_id_part
from varloom.operators.genotypes import genotypes, sample_names
from varloom.operators.variants import variants
from varloom.plans import adapters, layout
from varloom.plans.adapters import SAMPLES
from varloom.plans.queries import HEADER, annotation_ids, contigs, joined, long_genotypes, vcf, with_ids
from varloom.session import shared_folder
from varloom.sources.contigs import ContigsLength
from varloom.sources.header import VcfHeader
from varloom.sources.readers import ColRename, read_csv, read_metadata, read_pedigree, read_variant_csv, read_vcf
from varloom.sources.writers import write_headers, write_parquet, write_pedigree, write_sharded, write_text
from varloom.streaming.ingest import ingest_variants, stream_vcf

FILE_LINES = ["##fileformat=VCFv4.3", *HEADER.lines[:-1]]


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/varloom-{uuid.uuid4().hex}"


def _file_header(spark, sf_dir) -> list[str]:
    lengths = [f"##contig=<ID={r['contig']},length={r['length']}>" for r in contigs(spark, sf_dir).orderBy("offset").collect()]
    return [*FILE_LINES, *lengths, HEADER.lines[-1]]


def vcf_path(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """The records as a VCF, a folder of parts behind a header."""
    at = f"{folder(spark)}/records.vcf"
    columns = ["chr", F.col("pos").cast("string"), "vid", "ref", "alt", F.lit("."), F.lit("PASS"), "info", "format", *SAMPLES]
    body = vcf(spark, sf_dir).select(F.concat_ws("\t", *columns).alias("value"))
    write_sharded(body, at, "".join(f"{line}\n" for line in _file_header(spark, sf_dir)), compression)
    return at


def numbered(spark: SparkSession, lines: list[str], name: str = "line") -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), f"place long, {name} string")


def scan_vcf(spark, sf_dir):
    return read_vcf(spark, vcf_path(spark, sf_dir)).frame.select("chr", "pos", "vid", "ref", "alt", "qual", "filter", "info", "id")


def scan_vcf_compressed(spark, sf_dir):
    return read_vcf(spark, vcf_path(spark, sf_dir, "gzip")).frame.select("id", "chr", "pos", "format", *SAMPLES)


def drop_star(spark, sf_dir):
    return read_vcf(spark, vcf_path(spark, sf_dir), drop_star=True).frame.select("chr", "pos", "alt")


def keep_structural(spark, sf_dir):
    return read_vcf(spark, vcf_path(spark, sf_dir), manage_sv=False).frame.select("chr", "pos", "alt")


def scan_header(spark, sf_dir):
    return numbered(spark, VcfHeader.from_path(spark, vcf_path(spark, sf_dir)).lines)


def scan_header_loose(spark, sf_dir):
    """Every line of a header file, whatever stands in it."""
    at = f"{folder(spark)}/header.txt"
    write_text(spark, at, "".join(f"{line}\n" for line in [*FILE_LINES, "not a header line"]))
    return numbered(spark, VcfHeader.from_files(spark, at).lines)


def header_dump(spark, sf_dir):
    at = f"{folder(spark)}/header.txt"
    write_headers(spark, at, VcfHeader.from_path(spark, vcf_path(spark, sf_dir)))
    return numbered(spark, VcfHeader.from_files(spark, at).lines)


def header_fields(spark, sf_dir):
    """What the header declares, attributes in any order."""
    lines = [*HEADER.lines[:-1], '##INFO=<Type=Float,Description="a, b",Number=A,ID=MIXED>', '##INFO=<ID=FLAG,Number=0,Type=Flag,Description="">', HEADER.lines[-1]]
    found = [(s, *d) for s in ("INFO", "FORMAT") for d in VcfHeader(lines).declared(s)]
    return spark.createDataFrame(found, "section string, name string, number string, kind string")


def samples_index(spark, sf_dir):
    found = VcfHeader.from_path(spark, vcf_path(spark, sf_dir)).samples_index
    return spark.createDataFrame([(s, k) for s, k in found.items()], "sample string, place long")


def contigs_from_header(spark, sf_dir):
    found = ContigsLength.from_vcf_header(VcfHeader.from_path(spark, vcf_path(spark, sf_dir)))
    return found.frame(spark).withColumnRenamed("offset", "contig_offset").withColumn("seen", F.lit(found.seen).cast("long"))


def contigs_from_csv(spark, sf_dir):
    at = f"{folder(spark)}/lengths.csv"
    rows = contigs(spark, sf_dir).orderBy("offset").collect()  # as many as a genome has chromosomes
    write_text(spark, at, "contig,length\n" + "".join(f"{r['contig']},{r['length']}\n" for r in rows))
    return ContigsLength.from_path(spark, at).frame(spark).withColumnRenamed("offset", "contig_offset")


def scan_csv(spark, sf_dir):
    at = f"{folder(spark)}/customers"
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").write.csv(at, header=True)
    return read_csv(spark, at)


def scan_variant_csv(spark, sf_dir):
    at = f"{folder(spark)}/variants"
    vcf(spark, sf_dir).selectExpr("chr AS chromosome", "pos AS position", "ref AS reference", "alt AS alternate", "vid AS rs").write.csv(at, header=True)
    return read_variant_csv(spark, at, ColRename("chromosome", "position", "reference", "alternate", {"rs": "vid"}))


def pedigree_file(spark, sf_dir):
    at = f"{folder(spark)}/family.ped"
    write_pedigree(adapters.frame(spark, sf_dir, "a_pedigree"), at)
    return read_pedigree(spark, at)


def _metadata(kind: str) -> Callable:
    def query(spark, sf_dir):
        found = adapters.frame(spark, sf_dir, "a_metadata").select("sample", "type_analyse", "affected").distinct()
        at = f"{folder(spark)}/metadata"
        if kind in ("csv", "tsv"):
            found.write.csv(at, header=True, sep="," if kind == "csv" else "\t")
        elif kind == "ljson":
            found.write.json(at)
        else:  # one array: a handful of samples and kinds
            at = f"{at}.json"
            write_text(spark, at, "[" + ",\n".join(found.toJSON().collect()) + "]")
        return read_metadata(spark, at, kind)

    return query


def parquet_append(spark, sf_dir):
    at = f"{folder(spark)}/variants"
    found = variants(with_ids(spark, sf_dir))
    write_parquet(found, at)
    write_parquet(found, at, append=True)
    return spark.read.parquet(at).groupBy("id", "chr", "pos").agg(F.count(F.lit(1)).alias("n"))


def _variant_files(spark, sf_dir) -> list[str]:
    at = folder(spark)
    write_parquet(variants(with_ids(spark, sf_dir)), f"{at}/a")
    write_parquet(variants(annotation_ids(spark, sf_dir)), f"{at}/b")
    return [f"{at}/a", f"{at}/b"]


def layout_variants(spark, sf_dir):
    """Merged by chromosome, the second file appended, then appended again to no effect."""
    a, b = _variant_files(spark, sf_dir)
    at = f"{folder(spark)}/merged"
    layout.merge_variants(spark, [a], at)
    for more in (b, b):
        layout.merge_variants(spark, [more], at, append=True)
    return layout.read_variants(spark, at)


def layout_genotypes(spark, sf_dir):
    """By id partition; without append touched partitions are replaced, with append rows are added."""
    at = folder(spark)
    write_parquet(long_genotypes(spark, sf_dir).select("id", "sample", F.col("gt").cast("int").alias("gt")).where("id IS NOT NULL"), f"{at}/g")
    for append in (False, False, True):
        layout.hive_genotypes(spark, [f"{at}/g"], f"{at}/hive", append)
    return layout.read_genotypes(spark, f"{at}/hive").groupBy("id_part", "sample").agg(F.count(F.lit(1)).alias("n"))


def lookup_ids(spark, sf_dir):
    """The genotypes of one known variant, by literal partitions of the hive layout."""
    at = folder(spark)
    found = add_id_part(long_genotypes(spark, sf_dir).select("id", "sample", "dp"))
    write_parquet(found.where("id IS NOT NULL"), f"{at}/g")
    layout.hive_genotypes(spark, [f"{at}/g"], f"{at}/hive")
    first = spark.read.parquet(f"{at}/g").agg(F.min("id")).first()[0]
    return layout.lookup_genotypes(layout.read_genotypes(spark, f"{at}/hive"), [first]).select("id", "sample", "dp")


def distinct_samples(spark, sf_dir):
    return sample_names(long_genotypes(spark, sf_dir))


def format_texts(spark, sf_dir):
    """FORMAT keys declared as text: one value as it is, lists split."""
    declared = VcfHeader([*HEADER.lines[:10], '##FORMAT=<ID=GT,Number=1,Type=String,Description="">', '##FORMAT=<ID=AD,Number=.,Type=String,Description="">', '##FORMAT=<ID=DP,Number=1,Type=Float,Description="">', HEADER.lines[-1]])
    found = genotypes(with_ids(spark, sf_dir), declared.format_parser(), "GT:AD:DP", SAMPLES)
    return found.select("id", "sample", joined(F.col("ad")).alias("ad"), F.get("ad", F.lit(0)).alias("ad_first"), "dp")


def _cli(spark, *words: str) -> None:
    if (code := cli.main(list(words), spark)) != 0:
        raise RuntimeError(f"{' '.join(words)} ended with {code}")


def cli_vcf2parquet(spark, sf_dir):
    """Variants, genotypes, annotations and headers by one call; their rows, counted by kind and chromosome or sample."""
    at, source = folder(spark), vcf_path(spark, sf_dir)
    _cli(spark, "vcf2parquet", "-i", source, "variants", "-o", f"{at}/v", "genotypes", "-o", f"{at}/g", "annotations", "-o", f"{at}/a", "-i", "AF", "GENE", "headers", "-o", f"{at}/h")
    v, g, a, h = (spark.read.parquet(f"{at}/{x}") if x != "h" else spark.read.text(f"{at}/h") for x in "vgah")
    count = F.count(F.lit(1)).alias("n")
    return (
        v.groupBy(F.concat(F.lit("variants "), "chr").alias("what")).agg(count)
        .union(g.groupBy(F.concat(F.lit("genotypes "), "sample")).agg(count))
        .union(a.groupBy(F.concat(F.lit("annotations "), "GENE")).agg(count))
        .union(h.groupBy(F.lit("headers")).agg(count))
    )


def cli_parquet2vcf(spark, sf_dir):
    """A VCF of variants and genotypes, written as one file and scanned as text."""
    at = folder(spark)
    write_parquet(variants(with_ids(spark, sf_dir)), f"{at}/v")
    write_parquet(long_genotypes(spark, sf_dir).select("id", "sample", "gt", "dp"), f"{at}/g")
    _cli(spark, "parquet2vcf", "-v", f"{at}/v", "-g", f"{at}/g", "-F", "GT:DP", "-o", f"{at}/out.vcf")
    return spark.read.text(f"{at}/out.vcf").where("NOT startswith(value, '#')").withColumnRenamed("value", "line")


def vcf_order(spark, sf_dir):
    """The first place of each chromosome in a written file: contigs stand in genome order, positions ascend."""
    at = folder(spark)
    write_parquet(variants(with_ids(spark, sf_dir)), f"{at}/v")
    _cli(spark, "parquet2vcf", "-v", f"{at}/v", "-o", f"{at}/out.vcf")
    lines = spark.read.schema("value string").option("wholetext", False).text(f"{at}/out.vcf").where("NOT startswith(value, '#')")
    parts = F.split("value", "\t")
    # A place is a block's start and a row of the task that reads this block; both in one long would end at 1 GB.
    rows = lines.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), parts[0].alias("chr"), parts[1].cast("long").alias("pos"))
    blocks = rows.groupBy("chr", "block").agg(F.min("row").alias("row"), F.min_by("pos", "row").alias("first_pos"), F.max_by("pos", "row").alias("last_pos"))
    firsts = blocks.groupBy("chr").agg(F.min(F.struct("block", "row")).alias("at"), F.min_by("first_pos", "block").alias("first_pos"), F.max_by("last_pos", "block").alias("last_pos"))
    place = F.row_number().over(Window.orderBy("at")).cast("long")  # a row for each chromosome
    return firsts.select("chr", "first_pos", "last_pos", place.alias("place"))


def cli_struct(spark, sf_dir):
    at, (a, b) = folder(spark), _variant_files(spark, sf_dir)
    write_parquet(long_genotypes(spark, sf_dir).select("id", "sample").where("id IS NOT NULL"), f"{at}/g")
    _cli(spark, "struct", "-i", a, b, "variants", "-o", f"{at}/merged")
    _cli(spark, "struct", "-i", f"{at}/g", "genotypes", "-p", f"{at}/hive", "-n", "256")
    v, g = layout.read_variants(spark, f"{at}/merged"), layout.read_genotypes(spark, f"{at}/hive")
    count = F.count(F.lit(1)).alias("n")
    return v.groupBy(F.concat(F.lit("chr="), "chr").alias("what")).agg(count).union(g.groupBy(F.concat(F.lit("id_part="), F.col("id_part").cast("string"))).agg(count))


def cli_transmission(spark, sf_dir):
    at = folder(spark)
    write_parquet(long_genotypes(spark, sf_dir).select("id", "sample", F.col("gt").cast("int").alias("gt"), "dp"), f"{at}/g")
    write_pedigree(adapters.frame(spark, sf_dir, "a_pedigree"), f"{at}/family.ped")
    _cli(spark, "transmission", "-g", f"{at}/g", "-p", f"{at}/family.ped", "-o", f"{at}/t")
    return spark.read.parquet(f"{at}/t")


def cli_metadata(spark, sf_dir):
    at = folder(spark)
    adapters.frame(spark, sf_dir, "a_metadata").select("sample", "link", "pid").write.csv(f"{at}/m", header=True)
    _cli(spark, "metadata", "-i", f"{at}/m", "-o", f"{at}/out", "-t", "csv")
    return spark.read.parquet(f"{at}/out").select("sample", "link", F.col("pid").cast("long").alias("pid"))


def incremental_ingest(spark, sf_dir):
    """A folder of VCF files ingested as a stream, in two micro-batches, then once more after a restart."""
    at, source = folder(spark), vcf_path(spark, sf_dir)
    lengths = ContigsLength.of([(r["contig"], r["length"]) for r in contigs(spark, sf_dir).orderBy("offset").collect()])
    for checkpoint in ("a", "b"):
        stream = stream_vcf(spark, source, lengths, SAMPLES, files_per_trigger=4, header=HEADER)
        ingest_variants(stream, f"{at}/variants", f"{at}/checkpoint-{checkpoint}").awaitTermination()
    return layout.read_variants(spark, f"{at}/variants")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        scan_vcf, scan_vcf_compressed, drop_star, keep_structural, scan_header, scan_header_loose, header_dump, header_fields, samples_index,
        contigs_from_header, contigs_from_csv, scan_csv, scan_variant_csv, pedigree_file, parquet_append, layout_variants, layout_genotypes,
        lookup_ids, distinct_samples, format_texts, cli_vcf2parquet, cli_parquet2vcf, vcf_order, cli_struct, cli_transmission, cli_metadata,
        incremental_ingest,
    )
    return {f.__name__: f for f in own} | {f"metadata_{kind}": _metadata(kind) for kind in ("csv", "tsv", "ljson", "json")}


def _values(lines: list[str]) -> str:
    return ", ".join(f"({k}, '{line.replace(chr(39), chr(39) * 2)}')" for k, line in enumerate(lines))


def oracle_sql(body: str, trio: str, part8: str) -> dict[str, str]:
    """SELECTs over the adapters and v, g, a, w. body: the lines of a VCF; trio: transmission; part8: an id's partition."""
    n = len(FILE_LINES)
    head = (
        f"SELECT CAST(place AS BIGINT) AS place, line FROM (VALUES {_values(FILE_LINES)}) t(place, line) UNION ALL "
        f"SELECT {n} + row_number() OVER (ORDER BY contig_offset) - 1, concat('##contig=<ID=', contig, ',length=', length, '>') FROM a_contigs UNION ALL "
        f"SELECT {n} + count(*), '{HEADER.lines[-1]}' FROM a_contigs"
    )
    declared = [("INFO", "SVTYPE", "1", "String"), ("INFO", "SVLEN", ".", "Integer"), ("INFO", "AF", "1", "Float"), ("INFO", "EAF", "1", "Integer"), ("INFO", "AC", "A", "Integer"), ("INFO", "GENE", "1", "String"), ("INFO", "ALLELEID", "1", "Integer"), ("INFO", "AF_ESP", "1", "Float"), ("INFO", "CLNSIG", ".", "String"), ("INFO", "GENEINFO", "1", "String"), ("INFO", "MIXED", "A", "Float"), ("FORMAT", "GT", "1", "String"), ("FORMAT", "AD", "R", "Integer"), ("FORMAT", "DP", "1", "Integer"), ("FORMAT", "GQ", "1", "Integer")]
    both = "SELECT DISTINCT id, chr, pos, ref, alt FROM v UNION SELECT id, chr, pos, ref, alt FROM w"
    metadata = "SELECT DISTINCT sample, type_analyse, affected FROM a_metadata"
    dosage = "length(split_part({0}, ':', 1)) - length(replace(split_part({0}, ':', 1), '1', ''))"
    texts = " UNION ALL ".join(
        f"SELECT id, '{s}' AS sample, string_split({s}, ':')[2] AS ad, string_split(string_split({s}, ':')[2], ',')[1] AS ad_first, string_split({s}, ':')[3] AS dp "
        f"FROM v WHERE format LIKE 'GT:AD:DP%' AND {dosage.format(s)} <> 0" for s in SAMPLES
    )
    return {
        "scan_vcf": "SELECT chr, pos, vid, ref, alt, '.' AS qual, 'PASS' AS filter, info, id FROM v",
        "scan_vcf_compressed": f"SELECT id, chr, pos, format, {', '.join(SAMPLES)} FROM v",
        "drop_star": "SELECT chr, pos, alt FROM v WHERE alt NOT LIKE '*%'",
        "keep_structural": "SELECT chr, pos, CASE WHEN alt = '*' THEN (SELECT any_value(alt) FROM v WHERE alt LIKE '*%') ELSE alt END AS alt FROM a_vcf",
        "scan_header": head,
        "scan_header_loose": f"SELECT CAST(place AS BIGINT) AS place, line FROM (VALUES {_values([*FILE_LINES, 'not a header line'])}) t(place, line)",
        "header_dump": head,
        "header_fields": "SELECT * FROM (VALUES " + ", ".join(map(repr, declared)) + ") t(section, name, number, kind)",
        "samples_index": "SELECT sample, CAST(place AS BIGINT) AS place FROM (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(SAMPLES)) + ") t(sample, place)",
        "contigs_from_header": "SELECT contig, length, contig_offset, count(*) OVER () AS seen FROM a_contigs",
        "contigs_from_csv": "SELECT contig, length, contig_offset FROM a_contigs",
        "scan_csv": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer",
        "scan_variant_csv": "SELECT chr, pos, ref, alt, vid FROM a_vcf",
        "pedigree_file": "SELECT family_id, personal_id, father_id, mother_id, sex, affected FROM a_pedigree",
        "metadata_csv": metadata, "metadata_tsv": metadata, "metadata_ljson": metadata, "metadata_json": metadata,
        "parquet_append": "SELECT id, chr, pos, 2 * count(*) AS n FROM v GROUP BY id, chr, pos",
        "layout_variants": both,
        "layout_genotypes": f"SELECT {part8} AS id_part, sample, 2 * count(*) AS n FROM g WHERE id IS NOT NULL GROUP BY 1, 2",
        "lookup_ids": "SELECT id, sample, dp FROM g WHERE id = (SELECT min(id) FROM g)",
        "distinct_samples": "SELECT DISTINCT sample FROM g",
        "format_texts": texts,
        "cli_vcf2parquet": "SELECT concat('variants ', chr) AS what, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT concat('genotypes ', sample), count(*) FROM g GROUP BY 1 "
        "UNION ALL SELECT concat('annotations ', regexp_extract(info, '(?:^|;)GENE=([^;]+)', 1)), count(*) FROM v GROUP BY 1 "
        f"UNION ALL SELECT 'headers', {n} + 1 + count(*) FROM a_contigs",
        "cli_parquet2vcf": body,
        "vcf_order": "SELECT chr, min(pos) AS first_pos, max(pos) AS last_pos, row_number() OVER (ORDER BY CAST(substr(chr, 4) AS BIGINT)) AS place FROM v GROUP BY chr",
        "cli_struct": f"SELECT concat('chr=', chr) AS what, count(*) AS n FROM ({both}) u GROUP BY 1 UNION ALL "
        f"SELECT concat('id_part=', {part8}), count(*) FROM g WHERE id IS NOT NULL GROUP BY 1",
        "cli_transmission": trio,
        "cli_metadata": "SELECT sample, link, CAST(pid AS BIGINT) AS pid FROM a_metadata",
        "incremental_ingest": "SELECT DISTINCT id, chr, pos, ref, alt FROM v",
    }
