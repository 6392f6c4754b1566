"""How variants pass from parents to an index case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.errors import NoGTError
from varloom.functions.fields import origin_char


def transmission(genotypes: DataFrame, index: str, mother: str | None = None, father: str | None = None) -> DataFrame:
    """id, index_*, mother_*, father_* and origin: one character for each gt.

    A named parent without the variant has gt 0; columns of an unnamed one are null. Where a sample has several rows of a
    variant, every combination comes back; a null id matches nothing.

    One scan and one shuffle of the named samples' rows serve all three: they meet by id, each sample in a list of its own.
    """
    keys = [c for c in genotypes.columns if c not in ("id", "sample")]
    if "gt" not in keys:
        raise NoGTError("genotypes")
    kinds = {f.name: f.dataType for f in genotypes.schema.fields}
    named = {"index": index, "mother": mother, "father": father}
    rows = genotypes.where(F.col("sample").isin([s for s in named.values() if s is not None]))
    value = F.struct(*[F.col(f"`{k}`") for k in keys])
    lists = [F.collect_list(F.when(F.col("sample") == s, value)).alias(p) for p, s in named.items() if s is not None]
    alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())  # rows without id stay apart
    met = rows.groupBy("id", alone.alias("_alone")).agg(*lists).drop("_alone")
    out = met.withColumn("index", F.explode("index"))
    for p in ("mother", "father"):
        if named[p] is not None:
            out = out.withColumn(p, F.explode_outer(p))
    columns = [F.col("id")]
    for p, s in named.items():
        for k in keys:
            column = F.col(p)[k] if s is not None else F.lit(None).cast(kinds[k])
            if k == "gt" and p != "index" and s is not None:
                column = F.coalesce(column, F.lit(0).cast(kinds[k]))
            columns.append(column.alias(f"{p}_{k}"))
    out = out.select(*columns)
    return out.withColumn("origin", F.concat(*[origin_char(F.col(f"{p}_gt")) for p in named]))


def family(pedigree: DataFrame) -> tuple[str, str | None, str | None]:
    """(index, mother, father): the first row with a parent, else the first row. A pedigree is a file of few rows."""
    rows = pedigree.select("personal_id", "mother_id", "father_id").collect()
    if not rows:
        raise ValueError("the pedigree is empty")
    chosen = next((r for r in rows if r["mother_id"] is not None or r["father_id"] is not None), rows[0])
    return chosen["personal_id"], chosen["mother_id"], chosen["father_id"]


def transmission_ped(genotypes: DataFrame, pedigree: DataFrame) -> DataFrame:
    return transmission(genotypes, *family(pedigree))
