"""Line dedup by distinct-site spread.

Every line gets a hash; per hash, HyperLogLog sketches of its sites, and of the texts that hold it, merge by aggregation. A
line whose estimates are well over the threshold is boilerplate, one of which either is well under it is not, and lines near
it get exact distinct counts. Boilerplate lines are then removed from every document, whatever they leave of it.

Texts count beside sites because a page that was copied to many sites spreads all its lines, yet is one text: its lines stay,
and near-duplicate removal decides which copy does. So boilerplate is a line on `sites` distinct sites, in as many distinct
whole texts.

Nulls and edges: a null text stays null, an empty one empty. A null site counts as no site. Lines are compared after trimming
spaces, blank ones stay; a line of one word counts like any other. A document of nothing but boilerplate keeps an empty text.
Repeated rows are cleaned alike, and ties cannot occur. Very long texts are cut into lines on the JVM, a row of one hash for
each. An empty table gives an empty result. Extra columns of the documents pass through; of two output columns with the name
of an input column the input's stays (n_lines and n_removed, by `counts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed, fresh

SITES = 8
SKETCH_ERROR = 0.1  # relative standard deviation of a sketch; 128 registers, about 100 bytes
#: Up to so many lines near the threshold are broadcast (a long and two flags each); beyond, pairs of all lines are joined.
OPEN = 200_000
#: Up to so many boilerplate lines the filter holds them itself; beyond, lines are joined with them.
INLINE = 4000


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def counted(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(line hash, site, hash of the whole text) of every line that counts."""
    # hashed before it is cut, or each line's row would hash the whole text anew
    rows = docs.select(F.col(site).cast("string").alias("site"), F.xxhash64("text").alias("text"), F.split("text", "\n").alias("lines"))
    rows = rows.select("site", "text", F.explode("lines").alias("line"))
    return rows.where(counted(F.col("line"))).select(line_key(F.col("line")).alias("key"), "site", "text")


def boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """key of the lines that stand on at least `sites` distinct sites and in as many distinct texts."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col(site).alias(site))
    low, high = F.lit(sites * (1 - 4 * SKETCH_ERROR)), F.lit(sites * (1 + 4 * SKETCH_ERROR))
    about = [F.approx_count_distinct(c, SKETCH_ERROR).alias(c) for c in ("site", "text")]
    spread = checkpointed(_lines(docs, site).groupBy("key").agg(*about).where((F.col("site") >= low) & (F.col("text") >= low)))
    sure = (F.col("site") > high) & (F.col("text") > high)
    # what a sketch left open
    undecided = spread.where(~sure).select("key", (F.col("site") <= high).alias("site_open"), (F.col("text") <= high).alias("text_open"))
    few = undecided.count() <= OPEN
    # a struct (kind, value) for each count that is open; without the flags, for both
    at = F.when(F.col("site").isNotNull() & (F.col("site_open") if few else F.lit(True)), F.struct(F.lit("site").alias("kind"), F.xxhash64("site").alias("v")))
    of = F.when(F.col("text_open") if few else F.lit(True), F.struct(F.lit("text").alias("kind"), F.col("text").alias("v")))
    rows = _lines(docs, site)
    rows = rows.join(F.broadcast(undecided), "key") if few else rows
    # distinct pairs: a line of a third of all documents has one row for each site or text, dealt by both
    pairs = rows.select("key", F.explode(F.array_compact(F.array(at, of))).alias("p")).select("key", "p.*").distinct()
    counts = pairs.groupBy("key").agg(F.count_if(F.col("kind") == "site").alias("sites"), F.count_if(F.col("kind") == "text").alias("texts"))
    exact = undecided.join(counts, "key").where((~F.col("site_open") | (F.col("sites") >= sites)) & (~F.col("text_open") | (F.col("texts") >= sites)))
    return spread.where(sure).select("key").union(exact.select("key"))


def _removed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """For each distinct text with boilerplate: its md5, and whether each line goes, up to the last that does."""
    texts = docs.select(F.md5(F.col("text")).alias("of"), F.split("text", "\n").alias("lines")).select("of", F.posexplode("lines").alias("at", "line"))
    lines = texts.where(counted(F.col("line"))).select("of", "at", line_key(F.col("line")).alias("key"))
    found = lines.join(keys.select("key"), "key").groupBy("of").agg(F.sort_array(F.collect_set("at")).alias("places"))

    def upto(place, k):
        before = F.when(k > 0, F.get("places", k - 1)).otherwise(-1)
        return F.concat(F.array_repeat(F.lit(False), place - before - 1), F.array(F.lit(True)))

    return found.select("of", F.flatten(F.transform("places", upto)).alias("gone"))


def remove(docs: DataFrame, keys: DataFrame, inline: int = INLINE, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The documents with text cleaned, and how many lines it had and lost, where no input column has that name.

    keys: a checkpointed table of boilerplate line hashes.
    """
    few = [r["key"] for r in keys.select("key").limit(inline + 1).collect()]
    text, lines = F.col("text").cast("string"), F.split(F.col("text").cast("string"), "\n")
    kept, of, gone = (fresh(docs, name) for name in ("kept", "of", "gone"))
    if len(few) <= inline:
        left = F.filter(lines, lambda x: ~(line_key(x).isin(few) & counted(x))) if few else lines
        rows = docs.withColumn(kept, left)
    else:
        found = _removed(docs.select(text.alias("text")), keys).withColumnsRenamed({"of": of, "gone": gone})
        rows = docs.withColumn(of, F.md5(text)).join(found, of, "left")
        left = F.filter(lines, lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
        rows = rows.withColumn(kept, left).drop(of, gone)
    size = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    lost = F.when(text.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    own = [(F.array_join(kept, "\n") if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    more = [c.alias(name) for c, name in zip((size, lost), counts, strict=True) if name not in docs.columns]
    return rows.select(*own, *more)


def dedup_lines(docs: DataFrame, sites: int = SITES, site: str = "source", inline: int = INLINE) -> DataFrame:
    return remove(docs, checkpointed(boilerplate(docs, sites, site)), inline)
