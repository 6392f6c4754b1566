"""Operators on variants and annotations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.fields import ann_split
from varloom.sources.header import VcfHeader

VARIANT = ("id", "chr", "pos", "ref", "alt")
KEY = ("chr", "pos", "ref", "alt")
UNTYPED = ("chr", "pos", "ref", "alt", "filter", "qual", "info")


def variants(frame: DataFrame) -> DataFrame:
    return frame.select(*VARIANT)


def unique_variants(*frames: DataFrame) -> DataFrame:
    """One row for each (chr, pos, ref, alt): a partial aggregation before the only shuffle.

    The id is a function of the key, so its minimum makes the result deterministic.
    """
    union = frames[0].select(*VARIANT)
    for more in frames[1:]:
        union = union.unionByName(more.select(*VARIANT))
    return union.groupBy(*KEY).agg(F.min("id").alias("id")).select(*VARIANT)


def new_variants(existing: DataFrame, *frames: DataFrame) -> DataFrame:
    """Variants whose key isn't there yet; null parts of a key equal each other, as in `unique_variants`.

    What is there needs no distinct for an anti join.
    """
    found, there = unique_variants(*frames), existing.select(*[F.col(k).alias(f"_{k}") for k in KEY])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return found.join(there, same[0] & same[1] & same[2] & same[3], "left_anti").select(*VARIANT)


def select_chromosome(frame: DataFrame, chromosome: str) -> DataFrame:
    return frame.where(F.col("chr") == chromosome)


def annotations(frame: DataFrame, header: VcfHeader, select: Iterable[str] | None = None, rename_id: str | None = None) -> DataFrame:
    """vid, id, whatever else stands beside the fixed columns, and the typed INFO columns."""
    kept = [c for c in frame.columns if c not in UNTYPED]
    out = frame.select(*[F.col(f"`{c}`") for c in kept], *header.info_parser(select))
    return out.withColumnRenamed("vid", rename_id) if rename_id else out


def with_effects(frame: DataFrame, ann: str = "ANN") -> DataFrame:
    """The first effect annotation as named columns instead of the list."""
    rest = [F.col(f"`{c}`") for c in frame.columns if c != ann]
    return frame.select(*rest, *ann_split(F.col(ann)))
