"""Variant relations derived from the driver tables; each SELECT runs on Spark and DuckDB with equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENOME_LENGTH = 3_250_000_000
SAMPLES = ["s0", "s1", "s2"]

SQL = {
    "a_contigs": """
SELECT concat('chr', cast(n_nationkey + 1 AS string)) AS contig,
       cast(n_nationkey + 1 AS bigint) * 10000000 AS length,
       coalesce(cast(sum(cast(n_nationkey + 1 AS bigint) * 10000000) OVER (
         ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS contig_offset
FROM nation""",
    "a_vcf": """
SELECT concat('chr', cast(l_partkey % 26 + 1 AS string)) AS chr,
       l_orderkey * 7 + l_linenumber AS pos,
       concat('rs', cast(l_partkey AS string)) AS vid,
       substr('ACTG', cast(l_partkey % 4 AS int) + 1, 1) AS ref,
       CASE WHEN l_partkey % 97 = 0 THEN '*'
            WHEN l_partkey % 89 = 0 THEN '<DEL:ME:ALU>'
            ELSE substr('ACTGGTCAACTGGTCAACTGGTCA', cast(l_suppkey % 4 AS int) + 1, cast(l_suppkey % 20 AS int) + 1) END AS alt,
       concat(CASE WHEN l_partkey % 89 = 0 THEN concat('SVTYPE=DEL;SVLEN=-', cast(l_suppkey AS string), ';') ELSE '' END,
              'EAF=9;AF=', cast(l_linenumber AS string),
              CASE WHEN l_linenumber % 2 = 0 THEN concat(';AC=', cast(l_suppkey % 5 AS string), ',', cast(l_partkey % 7 AS string)) ELSE '' END,
              ';GENE=G', cast(l_partkey % 50 AS string)) AS info,
       CASE WHEN l_suppkey % 11 = 0 THEN 'DP:GT' ELSE 'GT:AD:DP:GQ' END AS format,
       concat(CASE l_partkey % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' ELSE './.' END, ':', cast(l_suppkey % 9 AS string), ',4:13:.') AS s0,
       concat(CASE l_suppkey % 3 WHEN 0 THEN '0|1' WHEN 1 THEN '1|1' ELSE '0/0' END, ':2,3:', cast(l_linenumber AS string), ':99') AS s1,
       CASE l_orderkey % 3 WHEN 0 THEN './.' WHEN 1 THEN '1/1:0,8:8:60' ELSE './1:5,6:11:70' END AS s2
FROM lineitem""",
    "a_pedigree": """
SELECT 'fam' AS family_id, 's1' AS personal_id, cast(NULL AS string) AS father_id, cast(NULL AS string) AS mother_id, 'F' AS sex, false AS affected
UNION ALL SELECT 'fam', 's2', NULL, NULL, 'M', false
UNION ALL SELECT 'fam', 's0', 's2', 's1', 'F', true""",
    "a_annotations": """
SELECT DISTINCT chr, pos, ref, alt,
       concat('ALLELEID=', cast(pos AS string), ';AF_ESP=0.', cast(pos % 1000 AS string),
              CASE cast(pos % 4 AS int) WHEN 0 THEN ';CLNSIG=Pathogenic' WHEN 1 THEN ';CLNSIG=Benign'
                   WHEN 2 THEN ';CLNSIG=Likely_pathogenic,other' ELSE '' END,
              ';GENEINFO=G', cast(pos % 50 AS string), ':', cast(pos % 9 AS string)) AS info
FROM a_vcf
WHERE pos % 3 = 0""",
    "a_metadata": """
SELECT concat('s', cast(c_custkey % 3 AS string)) AS sample, c_name AS link, c_mktsegment AS type_analyse,
       c_acctbal > 0 AS affected, c_nationkey AS pid
FROM customer""",
}
NEEDS = {"a_contigs": "nation", "a_vcf": "lineitem", "a_pedigree": "", "a_annotations": "a_vcf", "a_metadata": "customer"}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    need = NEEDS[name]
    if not need:
        return spark.sql(SQL[name])
    source = frame(spark, sf_dir, need) if need in SQL else spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{need}.parquet"))
    return spark.sql(SQL[name].replace(f"FROM {need}", "FROM {source}"), source=source)


def spread(df: DataFrame) -> DataFrame:
    """A table of few files, whose row groups few tasks would read, is dealt out; any other stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= cores and len(df.inputFiles()) < min(cores, 4)
    return df.repartition(cores) if few else df


def with_clause(*more: str) -> str:
    """All adapters as common table expressions, and further ones."""
    return "WITH " + ",\n".join([*(f"{name} AS ({sql})" for name, sql in SQL.items()), *more])
