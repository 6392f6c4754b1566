"""SimHash near-duplicates by tiled exact comparison.

Every whole text gets a fingerprint of 64 bits (or a multiple) over its word shingles. Equal fingerprints collapse first;
distinct ones are compared exactly, tile against tile, by numpy exclusive-or and bit counts.

Which tiles meet is decided by cells that cannot lose a link. For a small radius the cell is the population count of each
quarter of the fingerprint: two fingerprints within radius r differ by at most r in the sum over these counts. For a
similarity threshold s the cell is the logarithm of the number of shingles: two sets that similar differ by at most 1/s in
size. Each fingerprint is compared in its own cell and sent to half of the neighbouring cells, so no pair is met twice. A
cell with many fingerprints is split into tiles of bounded size. A tile returns a spanning forest of its links, never all
pairs, and components are joined by alternating large and small stars, with a checkpoint each round.

With a similarity threshold fingerprints only find candidates, at a radius with a wide margin, over the distinct shingles of
each text. The candidates of one component are then linked by exact Jaccard of whole shingle sets.

Cost: cells by population count take about n copies of 21 cells and one hundredth or less of the pairs. Cells by length
leave a share of all pairs, so that mode grows with the square of the distinct fingerprints of a length.

Nulls and edges: a null text counts as empty. Texts without words have fingerprint zero and are linked like any other.
A null doc_id gets its group's smallest id, or null if the whole group has none. Repeated rows come back each. Of a group
the row with the smallest id stays; of rows that tie in that, one. An empty table gives an empty result. Extra columns
pass through `drop_near_duplicates`, and are not read elsewhere.
"""

from __future__ import annotations

import itertools
from math import acos, ceil, floor, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed, partitions, written

SEED = 42
RADIUS = 2
PARTS = 4
#: Distinct fingerprints of a tile: a 64th of the largest cell, within these bounds.
LEAST_TILE, MOST_TILE = 1 << 12, 1 << 19
FLUSH = 1 << 15  # visitors compared at a time
#: Standard deviations of the differing bits by which the candidates' radius exceeds what is expected at the threshold.
MARGIN = 7
#: Candidates, and shingles of candidates, of a tile in which sets are compared.
SET_ROWS, SET_SHINGLES = 1 << 11, 1 << 21
SET_JOIN_ROWS = 200_000  # up to so many candidates are broadcast to their texts
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z are lower-cased and words part at ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = (begin + sizes)[size - 1 :].tolist()
    return np.array([digest(line[b:e], SEED) for b, e in zip(begin.tolist(), end, strict=False)], np.uint64)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8) * 256)[None, :]


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BYTE_BITS).ravel() * 2 > hashes.size
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: str, size: int, words: int = 1) -> list[int]:
    """`words` numbers of 64 bits; the second and later ones mix the same hashes anew."""
    return mixed(shingle_hashes(text, size), words)


def mixed(hashes: np.ndarray, words: int) -> list[int]:
    out = []
    for k in range(words):
        if k:
            with np.errstate(over="ignore"):
                hashes = (hashes ^ (hashes >> np.uint64(29))) * _GOLDEN + np.uint64(k)
                hashes ^= hashes >> np.uint64(32)
        out.append(_majority(hashes) if hashes.size else 0)
    return out


def names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def fingerprints(texts: Column, size: int = 3, words: int = 1) -> Column:
    """A struct f0, f1, ..., n: the fingerprint of a text column and its number of shingles."""
    kind = ", ".join(f"{f} long" for f in names(words)) + ", n long"

    def measure(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            t = t or ""
            rows.append([*fingerprint(t, size, words), max(0, len(t.encode("utf-8", "replace").split()) - size + 1) or int(bool(t.strip()))])
        return pd.DataFrame(rows, columns=[*names(words), "n"], dtype="int64")

    return F.pandas_udf(measure, kind)(texts.cast("string"))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", size))


def set_fingerprints(texts: Column, size: int, words: int) -> Column:
    """A struct f0, f1, ..., n, id: fingerprint and number of the distinct shingles of a text column, and a hash of them all."""
    kind = ", ".join(f"{f} long" for f in names(words)) + ", n long, id long"

    def measure(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            own = shingle_set(t, size)
            rows.append([*mixed(own, words), own.size, xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)])
        return pd.DataFrame(rows, columns=[*names(words), "n", "id"], dtype="int64")

    return F.pandas_udf(measure, kind)(texts.cast("string"))


def count_cells(radius: int) -> tuple[Column, list[int]]:
    """Cell by population count of each quarter, and half of the steps to cells within the radius."""
    cell = F.lit(0)
    for k in range(PARTS):
        part = F.shiftrightunsigned("f0", 16 * k).bitwiseAND(F.lit(0xFFFF))
        cell = cell + F.bit_count(part) * F.lit(64**k)
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius and s > (0,) * PARTS]
    return cell.cast("long"), [sum(x * 64**k for k, x in enumerate(s)) for s in steps]


def size_cells(similarity: float) -> tuple[Column, list[int]]:
    """Cell by the logarithm of the number of shingles: similar sets lie in the same or neighbouring cells."""
    return F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-np.log(similarity)) + F.lit(1e-9)).cast("long"), [1]


def similarity_radius(similarity: float, words: int) -> int:
    """Expected differing bits of two sets with this Jaccard similarity, as cosine 2 s / (1 + s)."""
    return floor(64 * words * acos(2 * similarity / (1 + similarity)) / pi + 0.5)


def candidate_radius(similarity: float, words: int) -> int:
    """The expected bits and a margin above them, so that chance loses no pair of this similarity."""
    bits, apart = 64 * words, similarity_radius(similarity, words)
    return apart + ceil(MARGIN * sqrt(apart * (1 - apart / bits)))


class Trees:
    """A spanning forest of numbered rows that grows by links."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)
        self.left: list[int] = []
        self.right: list[int] = []

    def _root(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links between rows x and y; those that already join two rows of one tree say nothing new."""
        label = self.label
        while x.size:
            rx, ry = label[x], label[y]
            fresh = rx != ry
            x, y, rx, ry = x[fresh], y[fresh], rx[fresh], ry[fresh]
            if not x.size:
                return
            low, high = np.minimum(rx, ry), np.maximum(rx, ry)
            _, first = np.unique(high, return_index=True)
            for k in first.tolist():
                p, q = self._root(int(low[k])), self._root(int(high[k]))
                if p != q:
                    label[max(p, q)] = min(p, q)
                    self.left.append(x[k])
                    self.right.append(y[k])
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.left, np.int64), np.array(self.right, np.int64)


def _forest(home: np.ndarray, visitors: np.ndarray, radius: int, within: bool):
    """Links of a spanning forest between rows of home and visitors (or among home), as two arrays of numbers.

    Numbers count home first, then visitors. Rows are compared in tiles ordered by population count; a pair of tiles whose
    counts differ by more than the radius is skipped.
    """
    trees = Trees(len(home) if within else len(home) + len(visitors))

    def ordered(rows: np.ndarray, base: int):
        weight = np.bitwise_count(rows).sum(1, dtype=np.int64)
        order = np.argsort(weight, kind="stable")
        for at in range(0, len(rows), 1024):
            part = order[at : at + 1024]
            yield rows[part], part + base, int(weight[part[0]]), int(weight[part[-1]])

    # two words leave few pairs for the others, unless the radius is near the 64 bits that differ by chance
    dense = min(2 if radius < 48 else 3, home.shape[1])
    tiles = list(ordered(home, 0))
    others = tiles if within else list(ordered(visitors, len(home)))
    for i, (a, na, low_a, high_a) in enumerate(tiles):
        for b, nb, low_b, high_b in others[i if within else 0 :]:
            if low_b - high_a > radius or low_a - high_b > radius:
                continue
            apart = np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :])
            for k in range(1, dense):
                apart += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
            x, y = np.nonzero(apart <= radius)
            if a.shape[1] > dense:
                near = np.bitwise_count(a[x] ^ b[y]).sum(1, dtype=np.int64) <= radius
                x, y = x[near], y[near]
            if within and a is b:
                x, y = x[x < y], y[x < y]
            if x.size:
                trees.add(na[x], nb[y])
    return trees.links()


def links(distinct: DataFrame, cell: Column, steps: list[int], words: int, radius: int, tile: int | None = None) -> DataFrame:
    """Spanning links (a, b) between ids of distinct fingerprints within the radius. distinct: id, f0, ..., n; ids unique."""
    spark, f = distinct.sparkSession, names(words)
    rows = distinct.select("id", *f, cell.alias("cell"))
    many = checkpointed(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell")))
    if tile is None:
        largest = many.agg(F.max("in_cell")).first()[0] or 0
        tile = min(max(largest // 64, LEAST_TILE), MOST_TILE)
    many = many.select(F.col("cell").alias("to"), F.ceil(F.col("in_cell") / F.lit(tile)).cast("int").alias("tiles"))
    tiles = many.agg(F.sum("tiles")).first()[0] or 0
    # cells by population count number 17^4 at most, cells by length a few hundred
    many = F.broadcast(many)
    own = rows.join(many, F.col("cell") == F.col("to")).withColumn("tile", F.pmod(F.xxhash64(*f), F.col("tiles")).cast("int"))
    home = own.select("to", "tile", F.lit(0).alias("role"), "id", *f)
    inside = own.where("tile < tiles - 1").select("to", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("role"), "id", *f)
    calls = rows.select("id", *f, F.explode(F.array(*[(F.col("cell") + F.lit(s)).cast("long") for s in steps])).alias("at"))
    away = calls.join(many, F.col("at") == F.col("to")).select("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("role"), "id", *f)
    met = home.union(inside).union(away)

    def compare(batches):
        def flush(key, home, visits):
            if key is None or not home:
                return
            own = np.concatenate(home)
            pairs = [(own, *_forest(own[:, 1:], own[:0, 1:], radius, True))] if not visits else []
            if visits:
                guests = np.concatenate(visits)
                both = np.concatenate([own, guests])
                pairs = [(both, *_forest(own[:, 1:], guests[:, 1:], radius, False))]
            for both, left, right in pairs:
                if left.size:
                    yield pa.RecordBatch.from_arrays([pa.array(both[left, 0].view(np.int64)), pa.array(both[right, 0].view(np.int64))], ["a", "b"])

        key, home, visits, size, alone = None, [], [], 0, False
        for batch in batches:
            to, at, role = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            data = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(3, 4 + words)], 1)
            cut = np.flatnonzero((np.diff(to) != 0) | (np.diff(at) != 0) | (np.diff(role) != 0)) + 1
            for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(to)], strict=True):
                if begin == end:
                    continue
                now = (int(to[begin]), int(at[begin]))
                if now != key:
                    if visits:
                        yield from flush(key, home, visits)
                    elif not alone:
                        yield from flush(key, home, [])
                    key, home, visits, size, alone = now, [], [], 0, False
                if role[begin] == 0:
                    home.append(data[begin:end])
                else:
                    if not alone:  # all of home has come
                        yield from flush(key, home, [])
                        alone = True
                    visits.append(data[begin:end])
                    size += end - begin
                    if size >= FLUSH:
                        yield from flush(key, home, visits)
                        visits, size = [], 0
        if visits:
            yield from flush(key, home, visits)
        elif not alone:
            yield from flush(key, home, [])

    tasks = max(partitions(spark), min(2 * tiles, 4 * partitions(spark)))
    dealt = met.repartition(tasks, "to", "tile").sortWithinPartitions("to", "tile", "role")
    return dealt.mapInArrow(compare, "a long, b long")


def components(found: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links a, b; by alternating large and small stars."""
    edges = written(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        low = large.distinct()
        centre = low.groupBy("b").agg(F.min("a").alias("m"))
        small = low.join(centre, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = written(small, replaces=edges)
        # done when every node hangs on one root, and no root hangs on another
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def set_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest between sets (of distinct numbers) of at least this Jaccard similarity."""
    sizes = np.array([s.size for s in sets], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    alone = np.ones(len(sets), bool)  # not yet in a tree
    left, right = [], []

    def postings():
        keep = alone[owner]
        order = np.argsort(token[keep], kind="stable")
        return owner[keep][order], np.concatenate([[0], np.cumsum(np.bincount(token[keep], minlength=len(values)))])

    who, at = postings()
    held = rest = len(sets)
    for start in range(len(sets)):
        if not alone[start]:
            continue
        alone[start] = False
        rest -= 1
        reached = [start]
        while reached and rest:
            if rest * 2 < held:  # lists of those in trees only cost time
                (who, at), held = postings(), rest
            x = reached.pop()
            own = token[begin[x] : begin[x + 1]]
            many = at[own + 1] - at[own]
            places = np.arange(many.sum()) + np.repeat(at[own] - (np.cumsum(many) - many), many)
            common = np.bincount(who[places], minlength=len(sets))
            found = np.flatnonzero(alone & (common > 0))
            found = found[common[found] / (sizes[found] + sizes[x] - common[found]) >= similarity]
            alone[found] = False
            rest -= len(found)
            reached.extend(found.tolist())
            left.extend([x] * len(found))
            right.extend(found.tolist())
    return np.array(left, np.int64), np.array(right, np.int64)


def tiled(sets: DataFrame) -> DataFrame:
    """Adds tile and tiles to rows id, root, n: the sets of a candidate group in tiles of bounded size."""
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("rows") / F.lit(SET_ROWS)), F.ceil(F.col("shingles") / F.lit(SET_SHINGLES))).cast("int")
    return sets.join(sizes.select("root", tiles.alias("tiles")), "root").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))


def set_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Spanning links (a, b) between the similar sets of a candidate group. sets: id, root, n, checkpointed; shingles."""
    return tile_links(tiled(sets), similarity)


def tile_links(rows: DataFrame, similarity: float, kind: type = np.uint64) -> DataFrame:
    """The same for rows id, root, tile, tiles and shingles (numbers of that kind); a row that comes again is passed over."""
    # each two tiles of a group meet, and with them all rows of either
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: (k != F.col("tile")) | (F.col("tiles") == 1))
    met = rows.select("root", "id", "shingles", "tile", F.explode(others).alias("other"))
    met = met.select("root", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "id", "shingles")

    def compare(batches):
        def linked(held):
            ids = np.array([i for i, _ in held], np.int64)
            a, b = set_forest([s for _, s in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        key, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for k, (now, i) in enumerate(zip(keys, batch.column(3).to_pylist(), strict=True)):
                if now != key:
                    if len(held) > 1:
                        yield linked(held)
                    key, held = now, []
                if not held or held[-1][0] != i:
                    held.append((i, np.frombuffer(batch.column(4)[k].as_py(), kind)))
        if len(held) > 1:
            yield linked(held)

    dealt = met.repartition(2 * partitions(rows.sparkSession), "root", "x", "y").sortWithinPartitions("root", "x", "y", "id")
    return dealt.mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame, words: int, radius: int, tile: int | None = None) -> DataFrame:
    """prints: doc_id, f0, ..., n, checkpointed. Adds component_id, the smallest doc_id reachable by links."""
    same = names(words)
    distinct = prints.groupBy(*same).agg(F.min("doc_id").alias("least"))
    # the number of a distinct fingerprint: itself where it fits a long, else a 64-bit hash of it
    distinct = distinct.withColumn("id", F.xxhash64(*same) if len(same) > 1 else F.col("f0"))
    cell, steps = count_cells(radius)
    distinct = checkpointed(distinct)
    joined = components(links(distinct, cell, steps, words, radius, tile))
    roots = distinct.join(joined, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    linked = roots.where("node IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("id", "component_id")
    found = prints.withColumn("id", F.xxhash64(*same) if len(same) > 1 else F.col("f0"))
    by_id = distinct.select("id", "least").join(moved, "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id"))
    # read anew, so that the join has a shuffle on either side and a text of a third of all documents can be split
    return found.join(checkpointed(by_id), "id").drop("id")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, f0, n, component_id: fingerprints of 64 bits that differ in at most `radius` bits are linked."""
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text"), size).alias("p"))
    return groups(checkpointed(prints.select("doc_id", "p.*")), 1, radius)


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """One document of each group of similar texts: that of the smallest id. Whole rows as they came.

    Texts are linked whose sets of shingles have at least this Jaccard similarity; texts without words are alike.
    """
    f = names(words)
    row = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("i"), row.alias("h"))
    prints = docs.select(mine.alias("mine"), set_fingerprints(F.col("text"), size, words).alias("p"))
    prints = checkpointed(prints.select("mine", "p.*"))
    # of one set only the smallest row can stay
    same = prints.groupBy("id", *f, "n", "mine").agg(F.count(F.lit(1)).alias("rows"))
    light = same.groupBy("id", *f, "n").agg(F.min(F.struct("mine", "rows")).alias("m")).select("id", *f, "n", "m.mine", "m.rows")
    light = checkpointed(light)
    keyed = docs.withColumns({"_own_i": F.col("doc_id").cast("long"), "_own_h": row})
    cell, steps = size_cells(similarity)
    near = components(links(light, cell, steps, words, candidate_radius(similarity, words)))
    near = checkpointed(near.join(light, F.col("node") == F.col("id")).select("root", "id", "n", F.col("mine.i").alias("at_i"), F.col("mine.h").alias("at_h")))
    keys = F.broadcast(near) if near.count() <= SET_JOIN_ROWS else near
    shingles = F.pandas_udf(lambda text: text.map(lambda t: shingle_set(t, size).tobytes()), "binary")
    texts = keyed.select("_own_i", "_own_h", F.col("text").cast("string").alias("_own_text"))
    texts = texts.join(keys, F.col("_own_i").eqNullSafe(F.col("at_i")) & (F.col("_own_h") == F.col("at_h")))
    sets = texts.select("root", "id", "n", shingles("_own_text").alias("shingles")).dropDuplicates(["id"])
    joined = components(set_links(checkpointed(sets), similarity))
    grouped = light.join(joined, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "id"))
    kept = grouped.groupBy("component_id").agg(F.min(F.struct("mine", "rows")).alias("m"))
    kept = checkpointed(kept.select(F.col("m.mine.i").alias("_own_i"), F.col("m.mine.h").alias("_own_h"), F.col("m.rows").alias("_own_rows")))

    def staying(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, keyed["_own_i"].eqNullSafe(keys["_own_i"]) & (keyed["_own_h"] == keys["_own_h"]), "left_semi")

    out = staying(kept.where("_own_rows = 1")).drop("_own_i", "_own_h")
    if not kept.where("_own_rows > 1").isEmpty():  # rows that are equal in every column: one of them
        once = F.row_number().over(Window.partitionBy("_own_i", "_own_h").orderBy(F.lit(0)))
        out = out.union(staying(kept.where("_own_rows > 1")).withColumn("_own_once", once).where("_own_once = 1").drop("_own_i", "_own_h", "_own_once"))
    return out
