"""SpotSigs document fingerprints.

A signature is a common word (an anchor) with the chain of the next content words. The fingerprint of a text is the set of
its signatures, as sorted 32-bit hashes in base64; likeness is the Jaccard similarity of two sets.

Near-duplicate search brings sets together on the first signatures of each set in an order that all sets share: similar sets
must have one of these in common. Signatures that are frequent in a bounded sample come last in that order (it decides what
meets, never what is found). Whoever meets is ordered by length and compared with sets of a length that allows the threshold
only, pruned by bits: the signatures' parities over 64 to 512 places differ in no more places than the sets in signatures. What is
left joins candidate groups, by a spanning forest and not by pairs, and within these the Jaccard similarity of whole sets
decides. Equal sets are one class, and near_id names the group of classes that are linked by similarities at the threshold.

A text without any signature (no anchor, or nothing behind it) uses the chains behind every word; one without enough words
its words as one chain, and one without words its whole text.

Nulls and edges: a null text counts as empty; empty texts equal each other (likeness 1). A null doc_id comes last in the
order of documents. Rows that tie in doc_id follow each other by the hash of their text. Of a single document the next
document is itself. Documents are dealt by ranges of (doc_id, hash), so many rows without id are split; rows equal in both lie
in one range, and are read one after another. Very long texts are read whole, one at a time. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import HASH_SPAN, boundaries, by_bucket, by_hash, checkpointed
from varloom.llm.simhash import Trees, components, tile_links, tiled

CHAIN = 2
THRESHOLD = 0.8
#: Documents (about) that tell which signatures are frequent, and in how many of them a frequent one is.
ORDER_ROWS, ORDER_LEAST = 20_000, 3
#: Up to so many keys (16 bytes each) are broadcast.
FEW = 200_000
SMALL, LARGE = 128, 512  # signatures up to which 64 and 256 places are kept of a set, beyond 512
WINDOW = 1 << 15  # sets of one signature that are compared at a time
#: Documents of a range, and ranges at most (a range is streamed, so it may be long).
RANGE, RANGES = 1000, 10_000
#: Up to so many sets of one signature are compared together with those of other signatures.
SHORT = 64
WORD = re.compile(r"\w+")
#: Anchors: the commonest words of four languages (fixed values).
ANCHORS = frozenset(
    # English
    "the of and a to in is it that for was on are with as be by at this from or an "
    # French
    "le la les de des du et un une que qui est dans pour en au aux sur par pas "
    # German
    "der die das und den dem ein eine ist nicht von zu mit auf sich im für des "
    # Spanish
    "el los las y del se no por con una su para al lo como".split()
)
#: The same in bytes; what becomes of each byte (A-Z in lower case, what parts words a space, beyond ASCII as it is); and ASCII.
_ANCHORS = frozenset(w.encode() for w in ANCHORS)
_ASCII = bytes(range(128))
_PLAIN = bytes(c if c > 127 else ord(chr(c).lower()) if WORD.match(chr(c)) else 32 for c in range(256))
ODD = 32  # characters beyond ASCII that part words, up to which each is replaced in turn
PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def words_of(text: str) -> list[bytes]:
    """The words of WORD in the lower-cased text, in UTF-8. Bytes are translated and split, which takes a third of the time."""
    if text.isascii():
        return text.encode().translate(_PLAIN).split()
    low = text.lower()
    raw = low.encode("utf-8", "replace")
    rest = raw.translate(None, _ASCII).decode()
    if not rest.isalnum():
        odd = {c for c in rest if not c.isalnum()}
        if len(odd) > ODD:
            return [w.encode() for w in WORD.findall(low)]
        for c in odd:
            raw = raw.replace(c.encode(), b" ")
    return raw.translate(_PLAIN).split()


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct hashes of the signatures of one whole text."""
    words = words_of(text)
    content, anchors = [], []
    for w in words:
        if w in _ANCHORS:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    spots = {b" ".join((w, *content[k : k + chain])) for w, k in anchors if k <= last}
    if not spots and len(words) > chain:
        spots = {b" ".join(c) for c in zip(*(words[k:] for k in range(chain + 1)), strict=False)}
    if not spots:
        spots = {b" ".join(words) or text.encode("utf-8", "replace")}
    hashes = set(map(xxhash.xxh32_intdigest, spots))
    found = np.fromiter(hashes, "<u4", len(hashes))
    found.sort()
    return found


def encoded(spots: np.ndarray) -> str:
    return base64.b64encode(spots.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def class_of(spots: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(spots.tobytes()) - (1 << 63)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (both.size - shared)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def with_next(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, its edited text's, and the likeness to that and to the next document's.

    The next document is the one of the next smaller doc_id, after the last the first. Documents are dealt by ranges; the first
    of each range also visits the range before, so ranges need no common task. Texts travel compressed.
    """
    # ascending: known ids from the largest, then rows without
    place = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("down"), F.xxhash64("text").alias("h"))
    rows = _texts(docs).withColumn("place", place)
    many = min(-(-rows.count() // RANGE), RANGES)
    cuts = [tuple(c) for c in boundaries(rows.select("place"), "place", many)]

    @F.pandas_udf("int")
    def bucket(places: pd.DataFrame) -> pd.Series:
        found = zip(places["none"].tolist(), places["down"].tolist(), places["h"].tolist(), strict=True)
        return pd.Series([bisect_right(cuts, p) for p in found], dtype="int32")

    # the first place of each range, one row for each, and the range that it visits
    heads = rows.select("place", bucket("place").alias("b")).groupBy("b").agg(F.min("place").alias("p")).collect()
    heads.sort(key=lambda r: r["b"])
    visits = {tuple(r["p"]): heads[k - 1]["b"] for k, r in enumerate(heads)}
    schema = pa.schema([("bucket", pa.int32()), ("visit", pa.bool_()), ("none", pa.int32()), ("down", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])

    def deal(batches):
        pack = pa.Codec("zstd", 1)
        for batch in batches:
            out = []
            for doc, text, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, raw = tuple(place.values()), text.encode("utf-8", "replace")
                packed = pack.compress(raw, asbytes=True)
                out.append((bisect_right(cuts, at), False, *at, doc, len(raw), packed))
                if at in visits:
                    out.append((visits[at], True, *at, doc, len(raw), packed))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        pack = pa.Codec("zstd")
        held = None  # bucket, doc_id, text, spots of the document whose next has not come
        done = None  # the range whose visitor has come; further rows equal to it are passed over
        for batch in batches:
            out = []
            for own, visit, doc, size, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "visit", "doc_id", "size", "text")), strict=True):
                if done == own:
                    continue
                text = pack.decompress(packed, size, asbytes=True).decode()
                spots = held[3] if held is not None and held[2] == text else signatures(text)
                if held is not None:
                    if held[0] != own:
                        raise RuntimeError("a range ended without the first document of the next one")
                    out.append(told(held, text, spots))
                held = None if visit else (own, doc, text, spots)
                done = own if visit else None
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    def told(held, following, spots):
        _, doc, text, mine = held
        new = edited(text, following)
        other = signatures(new) if new != text else mine
        digest = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
        return doc, len(text), digest, encoded(mine), encoded(other), likeness(mine, other), likeness(mine, spots), class_of(mine)

    def as_rows(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, out_schema, preserve_index=False)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    out_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PAIRS.split(", ")])
    dealt = by_bucket(rows.select("doc_id", "text", "place").mapInArrow(deal, "bucket int, visit boolean, none int, down long, h long, doc_id long, size long, text binary"), "bucket", len(cuts) + 1)
    return dealt.sortWithinPartitions("bucket", "visit", "none", "down", "h").mapInArrow(as_rows, PAIRS)


def parity(spots: np.ndarray) -> bytes:
    """Of each of 64 places whether an odd number of signatures falls there; of 256 or 512 places for larger sets."""
    places = 64 if spots.size <= SMALL else 256 if spots.size <= LARGE else 512
    count = np.bincount(((spots * np.uint32(0x9E3779B1)) >> np.uint32(16)) & np.uint32(places - 1), minlength=places)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parities over 64, 256 and 512 places as 64-bit words; zero where a set has fewer places."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    words = np.frombuffer(column.buffers()[2], np.uint8)[: int(offsets[-1])]
    words = words[: words.size // 8 * 8].view(np.uint64)
    start, many = offsets[:-1] // 8, np.diff(offsets) // 8
    p64, p256, p512 = np.zeros(len(column), np.uint64), np.zeros((len(column), 4), np.uint64), np.zeros((len(column), 8), np.uint64)
    p64[many == 1] = words[start[many == 1]]
    p512[many == 8] = words[start[many == 8][:, None] + np.arange(8)]
    p256[many == 8] = p512[many == 8, :4] ^ p512[many == 8, 4:]
    p256[many == 4] = words[start[many == 4][:, None] + np.arange(4)]
    p64[many > 1] = np.bitwise_xor.reduce(p256[many > 1], axis=1)
    return p64, p256, p512


def _frequent(rows: DataFrame) -> np.ndarray:
    """Signatures in at least ORDER_LEAST documents of a bounded sample, the most frequent last."""

    def spots(batches):
        for batch in batches:
            yield pd.DataFrame({"spot": np.concatenate([signatures(t) for t in batch["text"]] or [np.empty(0, "<u4")]).astype(np.int64)})

    some = rows.where(by_hash(["text"]) < int(HASH_SPAN * min(1.0, ORDER_ROWS / max(1, rows.count()))))
    often = some.select("text").mapInPandas(spots, "spot long").groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_LEAST)
    return np.array([r["spot"] for r in sorted(often.collect(), key=lambda r: (r["n"], r["spot"]))], np.uint32)


def first_spots(spots: np.ndarray, frequent: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """As many signatures, in the common order, as a set this large must share one of with any similar set."""
    at = np.searchsorted(frequent, spots)
    known = (at < frequent.size) & (frequent[np.minimum(at, frequent.size - 1)] == spots) if frequent.size else np.zeros(spots.size, bool)
    mixed = (spots * np.uint32(2654435761)).astype(np.int64)  # not in the order of the values
    order = np.argsort(np.where(known, (1 << 32) + (place[np.minimum(at, frequent.size - 1)] if frequent.size else 0), mixed), kind="stable")
    return spots[order[: spots.size - ceil(threshold * spots.size - 1e-9) + 1]]


def _compared(threshold: float):
    """Over rows (spot, n, parities, class_id) in order of spot and n: links of a forest of the sets that may be similar."""

    most = (1 - threshold) / (1 + threshold)  # places in which parities may differ, of the signatures of both

    def fine(x, y, n, p256, p512) -> tuple[np.ndarray, np.ndarray]:
        for least, wide in ((SMALL, p256), (LARGE, p512)):  # more places, where both sets have them
            apart = np.bitwise_count(wide[x] ^ wide[y]).sum(1, dtype=np.int64)
            keep = (np.minimum(n[x], n[y]) <= least) | (apart <= most * (n[x] + n[y]) + 1e-9)
            x, y = x[keep], y[keep]
        return x, y

    def short(spot, n, ids, p64, p256, p512) -> tuple[np.ndarray, np.ndarray]:
        """Many short lists at once: each set with the next of its list, with the one after that, and so on."""
        at, left, right = np.arange(len(n)), [], []
        for step in range(1, len(n)):
            at = at[: np.searchsorted(at, len(n) - step)]
            at = at[(spot[at] == spot[at + step]) & (n[at] >= threshold * n[at + step] - 1e-9)]
            if not at.size:
                break
            x = at[np.bitwise_count(p64[at] ^ p64[at + step]) <= most * (n[at] + n[at + step]) + 1e-9]
            left.append(x)
            right.append(x + step)
        if not left:
            return ids[:0], ids[:0]
        x, y = fine(np.concatenate(left), np.concatenate(right), n, p256, p512)
        nodes, own = np.unique(ids, return_inverse=True)  # a set that lies in several lists is one node
        trees = Trees(len(nodes))
        trees.add(own[x], own[y])
        a, b = trees.links()
        return nodes[a], nodes[b]

    def near(n, ids, p64, p256, p512, done: int) -> tuple[np.ndarray, np.ndarray]:
        trees = Trees(len(n))
        for begin in range(done, len(n), 512):
            end = min(begin + 512, len(n))
            low = int(np.searchsorted(n, ceil(threshold * int(n[begin]) - 1e-9)))
            apart = np.bitwise_count(p64[begin:end, None] ^ p64[None, low:end])
            sizes = n[begin:end, None] + n[None, low:end]
            fits = (apart <= most * sizes + 1e-9) & (n[None, low:end] >= threshold * n[begin:end, None] - 1e-9)
            x, y = np.nonzero(fits)
            x, y = x + begin, y + low
            trees.add(*fine(x[x > y], y[x > y], n, p256, p512))
        a, b = trees.links()
        return ids[a], ids[b]

    def run(batches):
        spot, held, size, done = None, [], 0, 0

        def told():
            data = [np.concatenate(c) for c in zip(*held, strict=True)]
            return data, as_links(*near(data[0], *data[1:], done))

        def as_links(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            spots, n, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            rest = [n.astype(np.int64), ids, *folded(batch.column(2))]
            cut = np.flatnonzero(np.diff(spots)) + 1
            begins, ends = np.append(0, cut), np.append(cut, len(spots))
            met = ends - begins > 1  # what stands alone meets nothing, unless its signature goes on in another batch
            few = met & (ends - begins <= SHORT)
            few[[0, -1]], met[[0, -1]] = False, True
            rows = np.repeat(few, ends - begins)
            if rows.any():
                yield as_links(*short(spots[rows], *(c[rows] for c in rest)))
            met &= ~few
            for begin, end in zip(begins[met].tolist(), ends[met].tolist(), strict=True):
                if int(spots[begin]) != spot:
                    if size > done and size > 1:
                        yield told()[1]
                    spot, held, size, done = int(spots[begin]), [], 0, 0
                held.append([c[begin:end] for c in rest])
                size += end - begin
                if size - done >= WINDOW:  # keep what a longer set may still be similar to
                    data, found = told()
                    yield found
                    keep = data[0] >= threshold * int(data[0][-1]) - 1e-9
                    held = [[c[keep] for c in data]]
                    size = done = int(keep.sum())
        if size > done and size > 1:
            yield told()[1]

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """class_id and near_id (the smallest class of the group) of every class that has another one linked."""
    rows = _texts(docs).withColumn("h", F.xxhash64("text"))
    often = _frequent(rows)
    order = np.argsort(often)
    frequent, place = often[order], order.astype(np.int64)

    def sets(batches):
        for batch in batches:
            found = [signatures(t) for t in batch["text"]]
            first = [first_spots(s, frequent, place, threshold).astype(np.int32).tolist() for s in found]
            yield pd.DataFrame({"class_id": [class_of(s) for s in found], "n": [s.size for s in found], "odd": [parity(s) for s in found], "none": batch["none"], "i": batch["i"], "h": batch["h"], "first": first})

    # a row of each class stands for it, by id and hash
    one = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("i"), "h")
    classes = rows.select("text", one.alias("one")).select("text", "one.*").mapInPandas(sets, "class_id long, n int, odd binary, none int, i long, h long, first array<int>")
    classes = classes.groupBy("class_id").agg(F.min(F.struct("none", "i", "h", "n", "odd", "first")).alias("m")).select("class_id", "m.*")
    classes = checkpointed(classes)
    keys = classes.select(F.explode("first").alias("spot"), "n", "odd", "class_id").repartition("spot").sortWithinPartitions("spot", "n")
    candidates = components(keys.mapInArrow(_compared(threshold), "a long, b long"))
    near = candidates.withColumnsRenamed({"node": "id"}).join(classes.select(F.col("class_id").alias("id"), "n", "none", "i", "h"), "id")
    near = checkpointed(tiled(checkpointed(near)))
    wanted = F.broadcast(near) if near.count() <= FEW else near

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: signatures(t).tobytes())

    held = rows.select("text", one.alias("one")).select("text", "one.*").join(wanted, ["none", "i", "h"])
    held = held.select("id", "root", "tile", "tiles", whole("text").alias("shingles"))
    exact = components(tile_links(held, threshold, np.uint32))
    return exact.select(F.col("node").alias("class_id"), F.col("root").alias("near_id"))


def with_groups(found: DataFrame, near: DataFrame) -> DataFrame:
    """Adds near_id to a table with class_id: the group's smallest class, or the class itself."""
    near = checkpointed(near)
    near = F.broadcast(near) if near.count() <= FEW else near
    return found.join(near, "class_id", "left").withColumn("near_id", F.coalesce("near_id", "class_id"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (documents of equal fingerprints) and near_id (of classes linked at the threshold)."""

    def classes(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "class_id": [class_of(signatures(t)) for t in batch["text"]]})

    return with_groups(_texts(docs).mapInPandas(classes, "doc_id long, class_id long"), near_groups(docs, threshold))
