"""Contig lengths and offsets. The order of rows is part of the data, so they are numbered on the driver."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.sources.header import VcfHeader, head_lines

SCHEMA = "contig string, length long, offset long"


@dataclass
class ContigsLength:
    rows: list[tuple[str, int, int]]
    seen: int

    @classmethod
    def of(cls, lengths: list[tuple[str, int]], seen: int | None = None) -> ContigsLength:
        rows, offset = [], 0
        for name, length in lengths:
            rows.append((name, length, offset))
            offset += length
        return cls(rows, len(rows) if seen is None else seen)

    @classmethod
    def from_vcf_header(cls, header: VcfHeader) -> ContigsLength:
        """seen counts the contig lines, with or without a length."""
        found = []
        for line in header.contigs:
            name, length = re.search(r"ID=([^,>]+)", line), re.search(r"length=(\d+)", line)
            if name and length:
                found.append((name[1], int(length[1])))
        return cls.of(found, len(header.contigs))

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, delimiter: str = ",") -> ContigsLength:
        rows = csv.DictReader(head_lines(spark, path, ""), delimiter=delimiter)
        return cls.of([(r["contig"], int(r["length"])) for r in rows])

    @property
    def genome_length(self) -> int:
        return sum(length for _, length, _ in self.rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def with_offset(contigs: DataFrame, order: str) -> DataFrame:
    """Exclusive prefix sum of lengths over an ordering column; for tables that are data already. Contigs are few."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
