"""Best-fit packing with bound-certified repacking.

Documents are cut only where they exceed a sequence. Pieces are dealt to groups of about GROUP_ROWS and each group is packed
by best-fit decreasing. Dual-feasible-function bounds say how few bins a group could need; a group that reaches its bound
is certified: no exchange could improve it, and it stays. A group that needs more bins, or whose bound is its volume alone
and so leaves a remainder, gives up its bins with gaps; these pieces are dealt anew to fewer groups, so that gaps of
different groups meet, and packed again, until one group is left, all are certified or a round gave up as many as it got.

The number of groups follows from the rows, never from a session setting, so a table is always packed alike. Equal rows are
counted before they are dealt, and their copies spread evenly over the groups.

Nulls and edges: a null or empty text is a document of one id (the end id). A null doc_id is packed like any other.
Repeated rows are packed once each. Very long texts become pieces of one sequence each and a rest. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed, text_values
from varloom.llm.wordbpe import word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = f"{PIECES}, bin long, offset long, loose boolean"
GROUP_ROWS = 50_000
FEWER = 16
END_ID = 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Encode each whole text once, add the end id, and cut what is longer than a sequence."""

    def cut(batches):
        bpe = word_bpe(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode(text_values(batch.column(1))), strict=True):
                ids = np.append(ids, np.array([END_ID], "<u4"))
                for k, start in enumerate(range(0, ids.size, capacity)):
                    own = ids[start : start + capacity]
                    for to, x in zip(rows, (doc_id, k, start, own.size, zlib.crc32(own.tobytes())), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that a family of dual-feasible functions proves necessary.

    For a threshold t, items over capacity - t count as whole bins and items under t as nothing; for k, an item counts
    floor((k + 1) x / capacity) / k, or its share where that product is whole.
    """
    if not lengths.size:
        return 0
    size, count = np.unique(lengths, return_counts=True)
    best = -(-int((size * count).sum()) // capacity)
    for t in size[size <= capacity // 2].tolist():
        value = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int((value * count).sum()) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        top = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((top * count).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin.

    Items of one length are placed together: of the open bins with the least sufficient room, each takes as many as fit,
    which is what placing them one by one does. Bins are kept by their remaining room, so an item costs no search.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    bins, offsets = np.empty(sizes.size, np.int64), np.empty(sizes.size, np.int64)
    by_room: dict[int, list[int]] = {}
    has = np.zeros(capacity + 1, bool)
    fill: list[int] = []
    cuts = np.flatnonzero(np.diff(sizes, prepend=-1))
    for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), sizes.size][: cuts.size], strict=True):
        size, at = int(sizes[begin]), begin
        while at < end:
            room = size + int(has[size:].argmax())
            if has[room]:
                own = by_room[room].pop()
                if not by_room[room]:
                    has[room] = False
            else:
                own, room = len(fill), capacity
                fill.append(0)
            take = min(room // size, end - at)
            bins[at : at + take] = own
            offsets[at : at + take] = fill[own] + size * np.arange(take)
            fill[own] += size * take
            left = room - size * take
            if left:
                by_room.setdefault(left, []).append(own)
                has[left] = True
            at += take
    out_bins, out_offsets = np.empty_like(bins), np.empty_like(offsets)
    out_bins[order], out_offsets[order] = bins, offsets
    return out_bins, out_offsets, np.array(fill, np.int64)


def _packed(dealt: DataFrame, round_no: int, capacity: int, last: bool, gap: int) -> DataFrame:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        rows = rows.loc[rows.index.repeat(rows["copies"])].reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        needed = lower_bound(lengths, capacity)
        # a bound by volume alone leaves a remainder, and remainders of several groups share bins
        certified = last or fill.size <= needed and needed > -(-int(lengths.sum()) // capacity)
        rows["loose"] = False if certified else (capacity - fill[bins]) >= gap
        rows["bin"] = (np.int64(round_no) << 58) + (np.int64(key[0]) << 26) + bins
        rows["offset"] = offsets
        return rows.drop(columns=["dealt", "copies"])

    return dealt.groupBy("dealt").applyInPandas(pack, PACKED)


def _deal(rows: DataFrame, groups: int, round_no: int) -> DataFrame:
    """Distinct rows with the number of their copies in each group (dealt): an even share, from a group chosen by hash on."""
    many = rows.groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    first = F.pmod(F.xxhash64(*COLUMNS, F.lit(round_no)), F.lit(groups))
    each = many.select(*COLUMNS, "n", first.alias("first"), F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(groups)).cast("int") - 1)).alias("k"))
    copies = F.floor(F.col("n") / groups) + (F.col("k") < F.col("n") % groups).cast("long")
    return each.select(*COLUMNS, copies.alias("copies"), F.pmod(F.col("first") + F.col("k"), F.lit(groups)).cast("long").alias("dealt"))


def pack(cut: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS, gap: int | None = None) -> DataFrame:
    """sequence_id and offset for each piece. gap: a bin of an uncertified group with that much room is repacked."""
    gap = max(1, capacity // 100) if gap is None else gap
    loose, settled, k = checkpointed(cut), [], 0
    rows = loose.count()
    groups = max(1, -(-rows // group_rows))
    while True:
        done = checkpointed(_packed(_deal(loose, groups, k), k, capacity, groups == 1, gap))
        left = done.where("loose").count() if groups > 1 else 0
        if left == 0 or left >= rows:
            settled.append(done)
            break
        settled.append(done.where(~F.col("loose")))
        loose, rows, k = done.where("loose").select(*COLUMNS), left, k + 1
        groups = max(-(-rows // group_rows), groups // FEWER, 1)
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.select(*COLUMNS, F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)
