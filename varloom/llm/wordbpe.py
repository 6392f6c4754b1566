"""Word-level BPE for whole batches, with the ids of the `tokenizers` library.

The library spends most of its time on words it has met before. Here a text is cut at plain spaces and line ends,
where this vocabulary never joins tokens; each distinct chunk is encoded once per worker, and all new chunks of a batch
are merged together in numpy. Chunks beyond plain printable Latin text, and very long ones, go to the library itself.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

NONE = np.int32(2**31 - 1)
WIDEST = 40  # bytes of a pre-token that numpy merges; longer ones go to the library
PASS_CHARS = 4_000_000
#: The vocabulary's own pre-token pattern (fixed value), with the line end that parts chunks here.
PRETOKEN = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Chunks(dict):
    """Chunk -> number; an unknown chunk gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.waiting.append(chunk)
        return number


class WordBpe:
    """max_chunks bounds the memory of a worker; beyond it the store starts anew."""

    def __init__(self, path: str, max_chunks: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.max_chunks = max_chunks
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = np.int64(max(vocab.values()) + 1)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._index(np.array([vocab[a] for a, _ in pairs], np.int64) * self.size + [vocab[b] for _, b in pairs])
        self._reset()

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing; of equal keys the first rank counts."""
        self.slot_key = np.full(1 << 18, -1, np.int64)
        self.slot_rank = np.full(1 << 18, NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.slot_key[at] not in (-1, key):
                at = (at + 1) & 0x3FFFF
            if self.slot_key[at] == -1:
                self.slot_key[at], self.slot_rank[at] = key, rank

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NONE where the vocabulary doesn't merge it or right is padding."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slots(keys)
        found = self.slot_key[at]
        rank = np.where(found == keys, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & 0x3FFFF
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        rank[(right < 0) | (left < 0)] = NONE
        return rank

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where in them each word starts and how many it has.

        Again and again the lowest-ranked pair of every row is merged at once, leftmost first.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin, count, flats, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for low, high in ((1, 4), (5, 8), (9, 14), (15, 22), (23, WIDEST)):
            rows = np.flatnonzero((sizes >= low) & (sizes <= high))
            if not rows.size:
                continue
            own = sizes[rows]
            ids = np.full((rows.size, int(own.max()) + 1), -1, np.int32)
            flat = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8)
            row = np.repeat(np.arange(rows.size), own)
            start = np.cumsum(own) - own
            ids[row, np.arange(flat.size) - start[row]] = self.inner[flat]
            ids[np.arange(rows.size), own - 1] = self.last[flat[start + own - 1]]
            self._rows(ids)
            real = ids >= 0
            count[rows] = real.sum(1)
            begin[rows] = used + np.cumsum(count[rows]) - count[rows]
            flats.append(ids[real].astype("<u4"))
            used += flats[-1].size
        return (np.concatenate(flats) if flats else np.empty(0, "<u4")), begin, count

    def _rows(self, ids: np.ndarray) -> None:
        n, width = ids.shape
        rank = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        work, cols = ids.copy(), np.arange(width)
        while live.size:
            best = rank.argmin(1)
            each = np.arange(live.size)
            low = rank[each, best]
            go = low != NONE
            if not go.all():
                ids[live[~go]] = work[~go]
                live, work, rank, best, low = live[go], work[go], rank[go], best[go], low[go]
                each = np.arange(live.size)
                if not live.size:
                    return
            new = self.made[low]
            work[each, best] = new
            shift = np.minimum(cols + (cols > best[:, None]), width - 1)
            work = np.take_along_axis(work, shift, 1)
            work[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], width - 2), 1)
            rank[:, -1] = NONE
            rank[each, best] = self._ranks(new, work[each, best + 1])
            before = best > 0
            rank[each[before], best[before] - 1] = self._ranks(work[each[before], best[before] - 1], new[before])

    def _reset(self) -> None:
        self.chunks = _Chunks()
        self.ids = np.empty(1 << 16, "<u4")
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.length = np.empty(1 << 14, np.int64)
        self.known = 0

    def _encode_waiting(self) -> None:
        waiting, self.chunks.waiting = self.chunks.waiting, []
        if not waiting:
            return
        easy = np.fromiter((c.isprintable() and len(c) <= WIDEST // 2 and (c.isascii() or max(c) < "ɐ") and "<|" not in c for c in waiting), bool, len(waiting))
        pre = _Chunks()
        end = pre["\n"]
        parts = PRETOKEN.findall("\n".join([c for c, e in zip(waiting, easy.tolist(), strict=True) if e] + [""]).lower())
        numbers = np.fromiter(map(pre.__getitem__, parts), np.int64, len(parts))
        flat, begin, count = self._merge([b"", *[p.encode() for p in pre.waiting[1:]]])
        sizes = np.zeros(len(waiting), np.int64)
        each = count[numbers]
        total = np.cumsum(each)
        sizes[easy] = np.diff(total[numbers == end], prepend=0)
        quick = flat[np.repeat(begin[numbers] - (total - each), each) + np.arange(int(each.sum()))]
        hard = {k: np.array(self.library.encode(waiting[k], add_special_tokens=False).ids, "<u4") for k in np.flatnonzero(~easy).tolist()}
        for k, ids in hard.items():
            sizes[k] = ids.size
        self._store(np.concatenate([quick, *hard.values()]), sizes, np.concatenate([np.flatnonzero(easy), np.array(list(hard), np.int64)]))

    def _store(self, ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> None:
        """order: the waiting chunks as their ids follow each other."""
        while self.used + ids.size > self.ids.size:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + sizes.size > self.start.size:
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        self.ids[self.used : self.used + ids.size] = ids
        self.length[self.known : self.known + sizes.size] = sizes
        self.start[self.known + order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.known += sizes.size
        self.used += ids.size

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts in a row, and how many each text has."""
        if len(self.chunks) > self.max_chunks:
            self._reset()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.chunks.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(many.sum()))
        self._encode_waiting()
        return numbers, many

    def _passes(self, texts: list[str]):
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= PASS_CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = [np.empty(0, np.int64)]
        for part in self._passes(texts):
            numbers, many = self._numbers(part)
            total = np.concatenate([[0], np.cumsum(self.length[numbers])])
            ends = np.cumsum(many)
            out.append(total[ends] - total[ends - many])
        return np.concatenate(out)

    def encode(self, texts: list[str]):
        """The ids of each text, as little-endian 32-bit arrays, one after the other."""
        for part in self._passes(texts):
            numbers, many = self._numbers(part)
            sizes = self.length[numbers]
            total = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.start[numbers] - (total - sizes), sizes) + np.arange(int(sizes.sum()))]
            ends = np.concatenate([[0], total])[np.cumsum(many)]
            begin = 0
            for end in ends.tolist():
                yield ids[begin:end]
                begin = end


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One for each worker process and vocabulary file."""
    return WordBpe(path)
