"""Operators on genotypes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.errors import NoGenotypeError, UnknownFormatError
from varloom.functions.fields import Parser, sub_field
from varloom.sources.header import FIXED

#: The list column of frames with very many samples.
LISTED = "_samples"
#: With more samples than this a frame has them in one list column, in header order: thousands of columns make plans slow.
WIDE = 200


def samples_of(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in (*FIXED, "format", "id")]


def genotypes(frame: DataFrame, parsers: Mapping[str, Parser], format_string: str = "GT:AD:DP:GQ", samples: list[str] | None = None) -> DataFrame:
    """id, sample and one column per FORMAT key, one row per variant and sample.

    Rows whose own format doesn't begin with the asked one are left out; so are no-calls and homozygous references, if GT is
    asked for. A trailing part that a row leaves out is null. samples names the samples of a list column, in its order.
    """
    if "format" not in frame.columns:
        raise NoGenotypeError
    keys = format_string.split(":")
    for key in keys:
        if key not in parsers:
            raise UnknownFormatError(key)
    samples = samples_of(frame) if samples is None else samples
    rows = frame.where(F.col("format").startswith(format_string))
    if LISTED in frame.columns:
        found = rows.select("id", F.posexplode(LISTED).alias("at", "value"))
        long = found.select("id", F.get(F.array(*map(F.lit, samples)), F.col("at")).alias("sample"), "value")
    else:
        pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").alias("value")) for s in samples]))
        long = rows.select("id", pairs.alias("p")).select("id", "p.sample", "p.value")
    out = long.select("id", "sample", *[parsers[key](sub_field(F.col("value"), k)).alias(key.lower()) for k, key in enumerate(keys)])
    return out.where("gt <> 0") if "GT" in keys else out


def sample_names(frame: DataFrame) -> DataFrame:
    return frame.select("sample").distinct()


def sample_lists(long: DataFrame, samples: list[str]) -> DataFrame:
    """id and one list with a place for each sample: a struct of the genotype's columns, null where there is none.

    Of repeated rows of a variant and sample the largest counts, by its columns in order, whole: a genotype that was measured.
    The plan has the same size for any number of samples, and tasks send known genotypes only.
    """
    spark = long.sparkSession
    keys = [F.col(f"`{c}`") for c in long.columns if c not in ("id", "sample")]
    # as many rows as a VCF has columns
    places = F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(samples)], "sample string, _at int"))
    rows = long.join(places, "sample").groupBy("id", "_at").agg(F.max(F.struct(*keys)).alias("g"))
    known = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_at", "g"))).alias("known"))
    none = F.lit(None).cast(rows.schema["g"].dataType)

    def placed(entry, k):
        before = F.when(k > 0, F.get("known", k - 1)["_at"]).otherwise(-1)
        return F.concat(F.array_repeat(none, entry["_at"] - before - 1), F.array(entry["g"]))

    last = F.element_at("known", -1)["_at"]
    dense = F.concat(F.flatten(F.transform("known", placed)), F.array_repeat(none, F.lit(len(samples) - 1) - last))
    return known.select("id", dense.alias(LISTED))


def add_genotypes(variants: DataFrame, long: DataFrame, samples: list[str], how: str = "left", wide: int = WIDE) -> DataFrame:
    """One row per variant with `{sample}_{key}` columns, by one join; more than `wide` samples stay one list column `_samples`.

    Of repeated rows of a variant and sample the largest counts whole, so the result doesn't depend on row order.
    how="full" also keeps genotypes of unknown variants, with empty variant columns.
    """
    names = list(dict.fromkeys(samples))
    keys = [c for c in long.columns if c not in ("id", "sample")]
    joined = variants.join(sample_lists(long, names), "id", how)
    if len(names) > wide:
        return joined
    each = [F.get(LISTED, F.lit(k))[key].alias(f"{s}_{key}") for k, s in enumerate(names) for key in keys]
    return joined.select(*[F.col(f"`{c}`") for c in joined.columns if c != LISTED], *each)
