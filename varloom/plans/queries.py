"""The registered queries over the adapter relations, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import fields, ids
from varloom.operators.genotypes import add_genotypes, genotypes
from varloom.operators.transmission import family, transmission, transmission_ped
from varloom.operators.variants import annotations, new_variants, select_chromosome, unique_variants, variants, with_effects
from varloom.plans import adapters, layout
from varloom.plans.adapters import GENOME_LENGTH, SAMPLES
from varloom.sources.contigs import with_offset
from varloom.sources.header import VcfHeader
from varloom.sources.writers import RowNames, column_line, header_lines, vcf_lines

Query = Callable[[SparkSession, str], DataFrame]

HEADER = VcfHeader([
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="">', '##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="">',
    '##INFO=<ID=AF,Number=1,Type=Float,Description="">', '##INFO=<ID=EAF,Number=1,Type=Integer,Description="">',
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="">', '##INFO=<ID=GENE,Number=1,Type=String,Description="">',
    '##INFO=<ID=ALLELEID,Number=1,Type=Integer,Description="">', '##INFO=<ID=AF_ESP,Number=1,Type=Float,Description="">',
    '##INFO=<ID=CLNSIG,Number=.,Type=String,Description="">', '##INFO=<ID=GENEINFO,Number=1,Type=String,Description="">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\ts2",
])


def vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.frame(spark, sf_dir, "a_vcf")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.frame(spark, sf_dir, "a_contigs").withColumnRenamed("contig_offset", "offset")


def with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = vcf(spark, sf_dir).select("*", *HEADER.info_parser({"SVTYPE", "SVLEN"}))
    return ids.add_variant_id(frame, contigs(spark, sf_dir), GENOME_LENGTH).drop("SVTYPE", "SVLEN")


def long_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes(with_ids(spark, sf_dir), HEADER.format_parser(), samples=SAMPLES)


def annotation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.add_variant_id(adapters.frame(spark, sf_dir, "a_annotations"), contigs(spark, sf_dir), GENOME_LENGTH)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations(annotation_ids(spark, sf_dir), HEADER, {"ALLELEID", "AF_ESP", "CLNSIG", "GENEINFO"})


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",", "null")


def variant_id(spark, sf_dir):
    return variants(with_ids(spark, sf_dir))


def variant_id_sql(spark, sf_dir):
    ids.register_sql(spark)
    frame = with_ids(spark, sf_dir).join(F.broadcast(contigs(spark, sf_dir)), F.col("chr") == F.col("contig"), "left")
    found = frame.selectExpr("pos", "chr", f"variant_id(pos + offset, ref, alt, {GENOME_LENGTH}) AS id")
    return found.selectExpr("*", "variant_id_part(id, 8) AS id_part")


def unsigned_ids(spark, sf_dir):
    return with_ids(spark, sf_dir).select("chr", "pos", ids.as_unsigned(F.col("id")).cast("string").alias("id_text"))


def id_partition_8(spark, sf_dir):
    return ids.add_id_part(with_ids(spark, sf_dir).select("id"), 8)


def id_partition_9(spark, sf_dir):
    return ids.add_id_part(with_ids(spark, sf_dir).select("id"), 9)


def contig_offsets(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    length = (F.col("n_nationkey") + 1).cast("long") * 10_000_000
    frame = nation.select("n_nationkey", F.concat(F.lit("chr"), (F.col("n_nationkey") + 1).cast("string")).alias("contig"), length.alias("length"))
    return with_offset(frame, "n_nationkey").select("contig", "length", F.col("offset").alias("contig_offset"))


def genome_length(spark, sf_dir):
    return contigs(spark, sf_dir).agg(F.sum("length").cast("long").alias("genome_length"), F.count(F.lit(1)).alias("n_contigs"))


def unique_variants_query(spark, sf_dir):
    """The variants of two files, most of the second's in the first too."""
    return unique_variants(with_ids(spark, sf_dir), annotation_ids(spark, sf_dir))


def merge_append(spark, sf_dir):
    """The variants of the larger file added to those of the smaller."""
    there = unique_variants(annotation_ids(spark, sf_dir))
    return there.unionByName(new_variants(there, with_ids(spark, sf_dir)))


def variants_by_chr_count(spark, sf_dir):
    frame = vcf(spark, sf_dir)
    return frame.groupBy("chr").agg(F.count(F.lit(1)).alias("n_variants"))


def select_chromosome_query(spark, sf_dir):
    return select_chromosome(variants(with_ids(spark, sf_dir)), "chr7")


def null_ids(spark, sf_dir):
    return with_ids(spark, sf_dir).agg(F.count_if(F.col("id").isNull()).alias("n_null"), F.count_if(F.col("id") < 0).alias("n_long"))


def star_expand(spark, sf_dir):
    return vcf(spark, sf_dir).where("alt = '*'").select("chr", "pos", ids.expand_star(F.col("alt"), GENOME_LENGTH).alias("alt"))


def sv_alt_rewrite(spark, sf_dir):
    svtype, svlen = HEADER.info_parser({"SVTYPE", "SVLEN"})
    frame = vcf(spark, sf_dir).select("chr", "pos", "alt", svtype, svlen).where("SVTYPE IS NOT NULL")
    return frame.select("chr", "pos", ids.rewrite_sv(F.col("alt"), F.col("SVTYPE"), F.get("SVLEN", F.lit(0)), GENOME_LENGTH).alias("alt"))


def info_typed(spark, sf_dir):
    return vcf(spark, sf_dir).select("chr", "pos", *HEADER.info_parser({"AF", "EAF", "GENE"}))


def info_lists(spark, sf_dir):
    frame = vcf(spark, sf_dir).select("chr", "pos", *HEADER.info_parser({"AC", "SVLEN"}))
    return frame.select("chr", "pos", joined(F.col("AC")).alias("ac"), joined(F.col("SVLEN")).alias("svlen"))


def info_select(spark, sf_dir):
    return vcf(spark, sf_dir).select("vid", *HEADER.info_parser("GENE")).groupBy("GENE").agg(F.count(F.lit(1)).alias("n"))


def annotation_columns(spark, sf_dir):
    found = annotated(spark, sf_dir)
    return found.select("id", "ALLELEID", "AF_ESP", joined(F.col("CLNSIG")).alias("CLNSIG"), "GENEINFO")


def genotypes_long(spark, sf_dir):
    found = long_genotypes(spark, sf_dir)
    return found.select("id", "sample", F.col("gt").cast("int").alias("gt"), joined(F.col("ad")).alias("ad"), "dp", "gq")


def genotypes_wide(spark, sf_dir):
    found = add_genotypes(variants(with_ids(spark, sf_dir)), long_genotypes(spark, sf_dir).select("id", "sample", F.col("gt").cast("int").alias("gt"), "dp"), SAMPLES)
    return found.select("id", "chr", "pos", *[f"{s}_{k}" for s in SAMPLES for k in ("gt", "dp")])


def sample_counts(spark, sf_dir):
    return long_genotypes(spark, sf_dir).groupBy("sample", F.col("gt").cast("int").alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def _transmission(found: DataFrame) -> DataFrame:
    return found.select("id", *[F.col(f"{p}_{k}").cast(t).alias(f"{p}_{k}") for p in ("index", "mother", "father") for k, t in (("gt", "int"), ("dp", "long"))], "origin")


def _trio(mother: str | None, father: str | None) -> Query:
    def query(spark, sf_dir):
        found = long_genotypes(spark, sf_dir).select("id", "sample", "gt", "dp")
        return _transmission(transmission(found, "s0", mother, father))

    return query


def transmission_from_ped(spark, sf_dir):
    found = long_genotypes(spark, sf_dir).select("id", "sample", "gt", "dp")
    return _transmission(transmission_ped(found, adapters.frame(spark, sf_dir, "a_pedigree")))


def pedigree_family(spark, sf_dir):
    index, mother, father = family(adapters.frame(spark, sf_dir, "a_pedigree"))
    return spark.createDataFrame([(index, mother, father)], "index_sample string, mother_sample string, father_sample string")


def annotated_rare(spark, sf_dir):
    v, a = variants(with_ids(spark, sf_dir)), annotated(spark, sf_dir)
    return v.join(a, "id", "left").where("AF_ESP > 0.9").select("chr", "pos", "ref", "alt", "AF_ESP")


def samples_with_gene(spark, sf_dir):
    v, a, g = variants(with_ids(spark, sf_dir)), annotated(spark, sf_dir), long_genotypes(spark, sf_dir)
    found = v.join(g.select("id", "sample"), "id", "left").join(a.select("id", "GENEINFO"), "id", "left")
    return found.where("GENEINFO = 'G3:3'").select("chr", "pos", "ref", "alt", "sample").distinct()


def pathogenic_homozygous(spark, sf_dir):
    v, a = variants(with_ids(spark, sf_dir)), annotated(spark, sf_dir)
    chosen = v.join(a.where(F.exists("CLNSIG", lambda x: x.like("%Patho%"))).select("id"), "id")
    g = ids.add_id_part(long_genotypes(spark, sf_dir)).where("gt = 2")
    return layout.join_genotypes(chosen, g).select("id", "chr", "pos", "id_part", "sample")


def partition_counts(spark, sf_dir):
    return ids.add_id_part(long_genotypes(spark, sf_dir).select("id")).groupBy("id_part").agg(F.count(F.lit(1)).alias("n"))


def region_lookup(spark, sf_dir):
    rows = [(f"chr{k + 1}", (k + 1) * 10_000_000, sum(range(1, k + 1)) * 10_000_000) for k in range(25)]
    return layout.region(variants(with_ids(spark, sf_dir)), rows, GENOME_LENGTH, "chr5", 1000, 90_000)


def vcf_names() -> RowNames:
    return RowNames(info=[("AF", "AF"), ("AC", "AC"), ("GENE", "GENE")], format="GT:DP", sample={s: {"GT": f"{s}_gt", "DP": f"{s}_dp"} for s in SAMPLES})


def _for_vcf(spark, sf_dir):
    info = HEADER.info_parser({"AC", "GENE"})
    af = fields.info_field(F.col("info"), "AF", "1", "Integer").alias("AF")
    frame = with_ids(spark, sf_dir).select("id", "chr", "pos", "ref", "alt", af, *info)
    return add_genotypes(frame, long_genotypes(spark, sf_dir).select("id", "sample", "gt", "dp"), SAMPLES)


def vcf_body(spark, sf_dir):
    return vcf_lines(_for_vcf(spark, sf_dir), vcf_names()).withColumnRenamed("value", "line")


_TOLD = 'Description="Column of the source table">'
#: What the header of `vcf_body` has to be.
VCF_HEADER = [
    "##fileformat=VCFv4.3", "##source=varloom", f"##INFO=<ID=AF,Number=1,Type=Integer,{_TOLD}", f"##INFO=<ID=AC,Number=.,Type=Integer,{_TOLD}",
    f"##INFO=<ID=GENE,Number=1,Type=String,{_TOLD}", f"##FORMAT=<ID=GT,Number=1,Type=String,{_TOLD}", f"##FORMAT=<ID=DP,Number=1,Type=String,{_TOLD}",
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\ts2",
]


def vcf_header(spark, sf_dir):
    lines = [*header_lines(_for_vcf(spark, sf_dir), vcf_names()), column_line(vcf_names())]
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


def ann_split(spark, sf_dir):
    parts = [F.concat(F.lit(n[:3]), (F.col("pos") % (k + 2)).cast("string")) for k, n in enumerate(fields.ANN_FIELDS[:-1])]
    ann = F.array(F.concat_ws("|", "alt", *parts), F.lit("second|entry"))
    return with_effects(vcf(spark, sf_dir).select("chr", "pos", ann.alias("ANN")))


def metadata_scan(spark, sf_dir):
    return adapters.frame(spark, sf_dir, "a_metadata").groupBy("sample", "type_analyse", "affected").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    from varloom.plans import files

    own = (
        variant_id, variant_id_sql, unsigned_ids, id_partition_8, id_partition_9, contig_offsets, genome_length, merge_append,
        variants_by_chr_count, null_ids, star_expand, sv_alt_rewrite, info_typed, info_lists, info_select, annotation_columns,
        genotypes_long, genotypes_wide, sample_counts, pedigree_family, annotated_rare, samples_with_gene, pathogenic_homozygous,
        partition_counts, region_lookup, vcf_body, vcf_header, ann_split, metadata_scan,
    )
    named = {f.__name__: f for f in own}
    return named | {
        "unique_variants": unique_variants_query, "select_chromosome": select_chromosome_query,
        "transmission_trio": _trio("s1", "s2"), "transmission_no_father": _trio("s1", None), "transmission_no_mother": _trio(None, "s2"),
        "transmission_index_only": _trio(None, None), "transmission_ped": transmission_from_ped,
    } | files.queries()


def _info(name: str, of: str = "info") -> str:
    return f"nullif(regexp_extract({of}, '(?:^|;){name}=([^;]+)', 1), '')"


_PAD = ids.pad_length(GENOME_LENGTH)
_SHIFT = ids.position_shift(GENOME_LENGTH)


def _id_sql(source: str) -> str:
    """SQL of real_pos, ref, alt (as `source` has them) to id."""
    bases = "list_reduce(list_transform(string_split(alt, ''), lambda c: CAST((ascii(c) >> 1) & 3 AS BIGINT)), lambda x, y: x * 4 + y)"
    return f"""
SELECT *, CASE WHEN real_pos IS NULL THEN NULL
  WHEN length(bin(length(ref))) + 2 * length(alt) <= {_SHIFT}
  THEN (real_pos << {_SHIFT}) | (CAST(length(ref) AS BIGINT) << (2 * length(alt))) | {bases}
  ELSE CAST(-9223372036854775808 AS BIGINT) + CAST(concat('0x', substr(md5(concat_ws('|', CAST(real_pos AS VARCHAR), ref, alt)), 1, 15)) AS BIGINT) END AS id
FROM ({source}) src"""


_ALT = f"""CASE WHEN {_info("SVTYPE")} = regexp_replace(alt, '<([^:>]+).*>', '\\1')
  THEN rpad(concat_ws('-', {_info("SVTYPE")}, CAST(CAST(string_split({_info("SVLEN")}, ',')[1] AS BIGINT) AS VARCHAR)),
            CAST(greatest({_PAD}, length(concat_ws('-', {_info("SVTYPE")}, CAST(CAST(string_split({_info("SVLEN")}, ',')[1] AS BIGINT) AS VARCHAR)))) AS INT), '-')
  ELSE alt END"""
_STAR = "regexp_replace({}, '^([^*]*)[*]', concat('\\1', repeat('*', " + str(_PAD) + ")))"
_GT = "CAST(length(g) - length(replace(g, '1', '')) AS INT)"


def _base() -> str:
    """Adapters, and v (variants with ids), g (long genotypes), a (annotations)."""
    v = _id_sql(f"SELECT chr, pos, vid, ref, {_STAR.format(_ALT)} AS alt, info, format, s0, s1, s2, pos + contig_offset AS real_pos FROM a_vcf LEFT JOIN a_contigs ON chr = contig")
    a = _id_sql(f"SELECT chr, pos, ref, {_STAR.format('alt')} AS alt, info, pos + contig_offset AS real_pos FROM a_annotations LEFT JOIN a_contigs ON chr = contig")
    parts = ", ".join(f"string_split(value, ':')[{k}] AS {n}" for k, n in ((1, "g"), (2, "ad"), (3, "dp"), (4, "gq")))
    unions = " UNION ALL ".join(f"SELECT id, '{s}' AS sample, {s} AS value FROM v WHERE format LIKE 'GT:AD:DP:GQ%'" for s in SAMPLES)
    g = f"SELECT id, sample, {_GT} AS gt, ad, TRY_CAST(dp AS BIGINT) AS dp, TRY_CAST(gq AS BIGINT) AS gq FROM (SELECT id, sample, {parts} FROM ({unions}) u) w WHERE {_GT} <> 0"
    typed = f"SELECT id, CAST({_info('ALLELEID')} AS BIGINT) AS ALLELEID, CAST({_info('AF_ESP')} AS DOUBLE) AS AF_ESP, {_info('CLNSIG')} AS CLNSIG, {_info('GENEINFO')} AS GENEINFO FROM w"
    # computed once each: they are joined with themselves
    return adapters.with_clause(f"v AS MATERIALIZED ({v})", f"g AS MATERIALIZED ({g})", f"w AS MATERIALIZED ({a})", f"a AS MATERIALIZED ({typed})")


def _trio_sql(mother: str | None, father: str | None) -> str:
    def own(s: str | None) -> str:
        return f"(SELECT id, gt, dp FROM g WHERE sample = '{s}')" if s else "(SELECT id, gt, dp FROM g WHERE false)"

    def gt(p: str, named: str | None) -> str:
        return f"coalesce({p}.gt, 0)" if named else "CAST(NULL AS INT)"

    def char(x: str) -> str:
        return f"CASE WHEN {x} BETWEEN 0 AND 93 THEN chr(CAST({x} + 33 AS INT)) ELSE '~' END"

    m, f = gt("m", mother), gt("f", father)
    return (
        f"SELECT i.id, i.gt AS index_gt, i.dp AS index_dp, {m} AS mother_gt, m.dp AS mother_dp, {f} AS father_gt, f.dp AS father_dp, "
        f"concat({char('i.gt')}, {char(m)}, {char(f)}) AS origin FROM {own('s0')} i LEFT JOIN {own(mother)} m ON i.id = m.id LEFT JOIN {own(father)} f ON i.id = f.id"
    )


def oracle_sql() -> dict[str, str]:
    from varloom.plans import files

    part = "CASE WHEN id < 0 THEN {} ELSE id >> {} END"
    part8 = part.format(255, 55)
    unsigned = "CASE WHEN id < 0 THEN CAST(CAST(id AS HUGEINT) + 18446744073709551616 AS VARCHAR) ELSE CAST(id AS VARCHAR) END"
    sample = {s: f"concat_ws(':', CASE {s}_gt WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE coalesce(CAST({s}_gt AS VARCHAR), './.') END, coalesce(CAST({s}_dp AS VARCHAR), '.'))" for s in SAMPLES}
    wide = ", ".join(f"max({k}) FILTER (WHERE sample = '{s}') AS {s}_{k}" for s in SAMPLES for k in ("gt", "dp"))
    # of repeated rows of a variant and sample the one with the largest gt, then dp, whole
    once = "(SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id, sample ORDER BY gt DESC NULLS LAST, dp DESC NULLS LAST) = 1)"
    wides = ", ".join(f"{s}_{k}" for s in SAMPLES for k in ("gt", "dp"))
    body = (
        f"SELECT concat_ws(chr(9), chr_, CAST(pos AS VARCHAR), coalesce({unsigned}, '.'), ref, alt, '.', '.', "
        f"concat_ws(';', concat('AF=', coalesce({_info('AF')}, '.')), concat('AC=', coalesce({_info('AC')}, '.')), concat('GENE=', coalesce({_info('GENE')}, '.'))), "
        f"'GT:DP', {', '.join(sample.values())}) AS line FROM (SELECT v.id, v.chr AS chr_, pos, ref, alt, info, {wides} FROM v "
        f"LEFT JOIN (SELECT id, {wide} FROM {once} o GROUP BY id) x ON v.id = x.id) z"
    )
    ann = ", ".join(
        f"concat('{n[:3]}', CAST(pos % {k + 2} AS VARCHAR)) AS {n}" if k < len(fields.ANN_FIELDS) - 1 else f"CAST(NULL AS VARCHAR) AS {n}"
        for k, n in enumerate(fields.ANN_FIELDS)
    )
    distinct = "SELECT DISTINCT id, chr, pos, ref, alt FROM v"
    own = {
        "variant_id": "SELECT id, chr, pos, ref, alt FROM v",
        "variant_id_sql": f"SELECT pos, chr, id, {part8} AS id_part FROM v",
        "unsigned_ids": f"SELECT chr, pos, {unsigned} AS id_text FROM v",
        "id_partition_8": f"SELECT id, {part8} AS id_part FROM v",
        "id_partition_9": f"SELECT id, {part.format(511, 54)} AS id_part FROM v",
        "contig_offsets": "SELECT contig, length, contig_offset FROM a_contigs",
        "genome_length": "SELECT CAST(sum(length) AS BIGINT) AS genome_length, count(*) AS n_contigs FROM a_contigs",
        "unique_variants": f"{distinct} UNION SELECT id, chr, pos, ref, alt FROM w",
        "merge_append": f"{distinct} UNION SELECT id, chr, pos, ref, alt FROM w",
        "variants_by_chr_count": "SELECT chr, count(*) AS n_variants FROM a_vcf GROUP BY chr",
        "select_chromosome": "SELECT id, chr, pos, ref, alt FROM v WHERE chr = 'chr7'",
        "null_ids": "SELECT count(*) FILTER (WHERE id IS NULL) AS n_null, count(*) FILTER (WHERE id < 0) AS n_long FROM v",
        "star_expand": f"SELECT chr, pos, {_STAR.format('alt')} AS alt FROM a_vcf WHERE alt = '*'",
        "sv_alt_rewrite": f"SELECT chr, pos, {_ALT} AS alt FROM a_vcf WHERE {_info('SVTYPE')} IS NOT NULL",
        "info_typed": f"SELECT chr, pos, CAST({_info('AF')} AS DOUBLE) AS AF, CAST({_info('EAF')} AS BIGINT) AS EAF, {_info('GENE')} AS GENE FROM a_vcf",
        "info_lists": f"SELECT chr, pos, {_info('AC')} AS ac, CAST(CAST({_info('SVLEN')} AS BIGINT) AS VARCHAR) AS svlen FROM a_vcf",
        "info_select": f"SELECT {_info('GENE')} AS GENE, count(*) AS n FROM a_vcf GROUP BY 1",
        "annotation_columns": "SELECT id, ALLELEID, AF_ESP, CLNSIG, GENEINFO FROM a",
        "genotypes_long": "SELECT id, sample, gt, ad, dp, gq FROM g",
        "genotypes_wide": f"SELECT v.id, chr, pos, {wides} FROM v LEFT JOIN (SELECT id, {wide} FROM {once} o GROUP BY id) x ON v.id = x.id",
        "sample_counts": "SELECT sample, gt, count(*) AS n FROM g GROUP BY sample, gt",
        "transmission_trio": _trio_sql("s1", "s2"),
        "transmission_no_father": _trio_sql("s1", None),
        "transmission_no_mother": _trio_sql(None, "s2"),
        "transmission_index_only": _trio_sql(None, None),
        "transmission_ped": _trio_sql("s1", "s2"),
        "pedigree_family": "SELECT personal_id AS index_sample, mother_id AS mother_sample, father_id AS father_sample FROM a_pedigree WHERE father_id IS NOT NULL",
        "annotated_rare": "SELECT chr, pos, ref, alt, AF_ESP FROM v LEFT JOIN a ON v.id = a.id WHERE AF_ESP > 0.9",
        "samples_with_gene": "SELECT DISTINCT chr, pos, ref, alt, sample FROM v LEFT JOIN g ON v.id = g.id LEFT JOIN a ON v.id = a.id WHERE GENEINFO = 'G3:3'",
        "pathogenic_homozygous": f"SELECT v.id, chr, pos, {part8.replace('id', 'v.id')} AS id_part, sample FROM v JOIN a ON v.id = a.id JOIN g ON v.id = g.id WHERE CLNSIG LIKE '%Patho%' AND gt = 2",
        "partition_counts": f"SELECT {part8} AS id_part, count(*) AS n FROM g GROUP BY 1",
        "region_lookup": "SELECT id, chr, pos, ref, alt FROM v WHERE chr = 'chr5' AND pos BETWEEN 1000 AND 90000",
        "vcf_body": body,
        "vcf_header": "SELECT CAST(place AS BIGINT) AS place, line FROM (VALUES "
        + ", ".join(f"({k}, '{line}')" for k, line in enumerate(VCF_HEADER)) + ") t(place, line)",
        "ann_split": f"SELECT chr, pos, {ann} FROM a_vcf",
        "metadata_scan": "SELECT sample, type_analyse, affected, count(*) AS n FROM a_metadata GROUP BY ALL",
    }
    lines = f"SELECT concat_ws(chr(9), chr_, CAST(pos AS VARCHAR), coalesce({unsigned}, '.'), ref, alt, '.', '.', '.', 'GT:DP', {', '.join(sample.values())}) AS line FROM " + body.split(" AS line FROM ", 1)[1]
    own |= files.oracle_sql(lines, _trio_sql("s1", "s2"), part8)
    return {name: f"{_base()}\n{sql}" for name, sql in own.items()}
