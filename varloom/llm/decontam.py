"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and white space becomes one space. For each benchmark item and each document, shared character
q-grams are counted in overlapping bands of diagonals. Within an item of m characters and k edits at most, a true match
shares m - q + 1 - q k q-grams within k diagonals, so bands with fewer are dropped; the rest is verified by alignment
within the band.

Long passages of an item count too: an item is searched in overlapping windows of `window` characters, so a document that
holds any whole window of an item, within the edit budget of that window, is contaminated.

The benchmark is the stated query set; it is taken in blocks of BLOCK_CHARS characters (under 100 MB in memory, tested), so it
may grow. Each block makes one pass over the documents, and its index is freed before the next one's.

Nulls and edges: null or empty texts match nothing, nor do items of fewer than min_chars characters. Repeated items, and
windows that several items share, report the smallest id once for each match. Repeated documents are reported each in
`decontaminate` and as one id in `matches`. Of a document's windows the one with the fewest edits counts, then the first. Very
long texts are searched whole; 200 texts are searched at a time. Empty tables give an empty result. Extra columns pass through
`decontaminate`, and are not read elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import checkpointed, written

Q = 8
WINDOW = 80
MIN_CHARS = 40
#: Edits allowed for each character of a window.
EDITS = 0.08
BLOCK_CHARS = 2_000_000
MATCHES = "doc_id long, item_id long, start long, length long, edits int"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each Q characters, by doubling; Q is a power of two."""
    h, base, width = points.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while width < Q:
            h = h[:-width] * base + h[width:]
            base, width = base * base, width * 2
        return h * _MIX


def banded_edits(a: np.ndarray, b: np.ndarray, shift: int, budget: int) -> tuple[int, int]:
    """Fewest edits of all of a against some part of b that begins near shift, within budget diagonals; where it ends.

    Returns budget + 1 if there are more.
    """
    if shift >= 0 and np.array_equal(b[shift : shift + len(a)], a):
        return 0, shift + len(a)
    width = 2 * budget + 1
    pad = np.full(len(a) + width, -1, np.int64)
    begin, lead = shift - budget, max(0, budget - shift)
    part = b[max(0, begin) : max(0, begin) + len(pad) - lead]
    pad[lead : lead + len(part)] = part
    slack = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, c in enumerate(a):
        step = row + (pad[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - slack) + slack
        if row.min() > budget:
            return budget + 1, 0
    best = int(row.argmin())
    return int(row[best]), begin + best + len(a)


class Block:
    """The windows of some benchmark items, with an index of the items' q-grams."""

    def __init__(self, items: list[tuple[int, str]], window: int, min_chars: int, edits: float):
        owner, begin, size, texts, at = [], [], [], [], 0
        seen: set[str] = set()
        for item, text in sorted(items):
            text = normal(text)
            if len(text) < min_chars:
                continue
            last = max(0, len(text) - window)
            new = False
            for k in sorted({*range(0, last, window // 4), last}):
                part = text[k : k + window]
                if part not in seen:
                    seen.add(part)
                    owner.append(item)
                    begin.append(at + k)
                    size.append(len(part))
                    new = True
            if new:
                texts.append(text)
                at += len(text) + 1
        self.points = _points("\n".join(texts))
        self.owner, self.begin, self.size = (np.array(x, np.int64) for x in (owner, begin, size))
        self.budget = (self.size * edits).astype(np.int64)
        self.least = np.maximum(self.size - Q + 1 - Q * self.budget, 1)
        #: For windows of about one size: the fewest shared q-grams, and the span of text that holds them.
        self.dense = sorted({(int(self.least[own].min()), int((self.size[own] + self.budget[own]).max())) for own in (self.size // 20 == k for k in set((self.size // 20).tolist()))})
        gram = grams(self.points) if self.points.size >= Q else np.empty(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        #: Places of the q-grams in the joined items, in the order of the q-grams; those over a joint are in no window.
        self.gram, self.at = gram[order], order.astype(np.int32)
        bits = min(26, max(16, int(self.gram.size * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        known = np.zeros(1 << bits, bool)
        known[(self.gram >> self.shift).astype(np.int64)] = True
        self.known = known

    def part(self, window: int) -> np.ndarray:
        at = int(self.begin[window])
        return self.points[at : at + int(self.size[window])].astype(np.int64)

    def _in_windows(self, hit: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each hit of a place of the items, for each window that holds the q-gram there: hit, window, place in the window."""
        first = np.searchsorted(self.begin, place - (int(self.size.max()) - Q), "left")
        many = np.searchsorted(self.begin, place, "right") - first
        of = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        hit, place = np.repeat(hit, many), np.repeat(place, many)
        inside = place + Q <= self.begin[of] + self.size[of]
        return hit[inside], of[inside], (place - self.begin[of])[inside]

    def _crowded(self, hits: np.ndarray) -> np.ndarray:
        """Places of the hits that lie in some span with as many as a match must have."""
        total = np.concatenate([[0], np.cumsum(hits, dtype=np.int32)])
        at = np.flatnonzero(hits)
        keep = np.zeros(at.size, bool)
        for least, span in self.dense:
            # a full span may be taken to begin at a hit
            full = total[np.minimum(at + span, hits.size)] - total[at] >= least
            begun = np.where(full, at, -span - 1)
            keep |= at - np.maximum.accumulate(begun) < span if at.size else False
        return at[keep]

    def matches(self, texts: list[str]):
        """(text number, window, start, edits) of each verified region, the best for each text and window."""
        clean = [normal(t) for t in texts]
        sizes = np.array([len(c) + 1 for c in clean], np.int64)
        begin = np.cumsum(sizes) - sizes
        points = _points("\n".join(clean) + "\n")
        if points.size < Q or not self.gram.size:
            return
        h = grams(points)
        hit = self._crowded(self.known[(h >> self.shift).astype(np.int64)])
        first = np.searchsorted(self.gram, h[hit], "left")
        many = np.searchsorted(self.gram, h[hit], "right") - first
        hit, first, many = hit[many > 0], first[many > 0], many[many > 0]
        if not hit.size:
            return
        which = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at, of, inner = self._in_windows(np.repeat(hit, many), self.at[which].astype(np.int64))
        if not at.size:
            return
        diagonal = at - inner
        width = 2 * np.maximum(self.budget[of], 1)
        text = np.searchsorted(begin, at, "right") - 1
        found: dict = {}
        for half in (0, 1):  # bands overlap by half, so any k + 1 neighbouring diagonals lie in one of them
            band = (diagonal + half * (width // 2)) // width
            order = np.lexsort((band, of, text))
            t, o, b = text[order], of[order], band[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(t) != 0) | (np.diff(o) != 0) | (np.diff(b) != 0)]))
            shared = np.diff(np.append(new, t.size))
            good = shared >= self.least[o[new]]
            for k, n in zip(new[good].tolist(), shared[good].tolist(), strict=True):
                centre = int(np.median(diagonal[order[k : k + n]]))
                key = (int(t[k]), int(o[k]))
                found.setdefault(key, set()).add(centre)
        for (t, o), centres in sorted(found.items()):
            own, budget = self.part(o), int(self.budget[o])
            body = points[begin[t] : begin[t] + sizes[t] - 1].astype(np.int64)
            tried = [(*banded_edits(own, body, c - int(begin[t]), 2 * budget), c - int(begin[t])) for c in sorted(centres)]
            edits, _, start = min(tried)
            if edits <= budget:
                yield t, o, max(0, start), edits


def blocks(benchmark: DataFrame, window: int, min_chars: int, edits: float):
    """Blocks of about BLOCK_CHARS characters (one item at least), read in id order without collecting the table.

    With each comes whether it is the only one.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).orderBy("item_id", "text")
    part, size, only = [], 0, True
    for item, text in rows.toLocalIterator():
        if size >= BLOCK_CHARS:
            only = False
            yield Block(part, window, min_chars, edits), only
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    if part:
        yield Block(part, window, min_chars, edits), only


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_chars: int = MIN_CHARS, edits: float = EDITS) -> DataFrame:
    """One row for each document and contained item: where in the normal text the best window begins, and its edits."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], MATCHES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block, only in blocks(benchmark, window, min_chars, edits):
        shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK_CHARS

        def search(batches, shared=shared):
            own = shared.value
            for batch in batches:
                ids, texts = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist(), batch["text"].tolist()
                out = []
                for k in range(0, len(texts), 200):
                    for t, o, start, n in own.matches(texts[k : k + 200]):
                        out.append((ids[k + t], int(own.owner[o]), start, int(own.size[o]), n))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "length", "edits"])

        part = rows.mapInPandas(search, MATCHES)
        if not only:  # keep its rows, free its index
            part = checkpointed(part)
            shared.destroy()
        found = found.union(part)
    best = F.min(F.struct("edits", "start", "length")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("n_windows")).select(
        "doc_id", "item_id", "best.start", "best.length", "best.edits", "n_windows"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_chars: int = MIN_CHARS, edits: float = EDITS) -> DataFrame:
    """The documents that hold no benchmark passage, as they are.

    Each document is tested where it lies: no join, so null and repeated ids are no concern.
    """
    kept, last = docs, None
    for block, only in blocks(benchmark, window, min_chars, edits):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rest = kept.where(_is_clean(shared)(F.col("text").cast("string")))
        if not only:
            rest = last = written(rest, replaces=last)
            shared.destroy()
        kept = rest
    return kept


def _is_clean(shared):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        out = np.ones(len(texts), bool)
        for k in range(0, len(texts), 200):
            for t, *_ in shared.value.matches(texts[k : k + 200]):
                out[k + t] = False
        return pd.Series(out)

    return clean
