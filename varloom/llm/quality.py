"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed on the executors. The trees are fitted on the driver from a bounded sample of
labelled rows, then flattened into arrays; scoring walks all rows of a batch through all trees at once in numpy.

Nulls and edges: a null text is scored as an empty one. Labels other than 0 and 1, null ids and held-out ids teach nothing;
an id with several labels counts once, with the smallest; one with several texts teaches the one with the smallest hash.
Without labels of both kinds every score is the share of label 1 (0.5 without any). Repeated rows are scored each, ties in a
split go to the first statistic and the lowest bin. Very long texts are measured whole, one at a time. An empty table gives an
empty result. Extra columns of the documents pass through; `into` names the two columns that are added or replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import first_by_hash

#: At most so many labelled rows, in hash order, are used to fit.
FIT_ROWS = 8000
FEATURES = (
    "bytes", "words", "mean_word", "sd_word", "longest_word", "distinct_words", "top_word", "repeats", "letters", "high", "digits",
    "upper", "spaces", "pipes", "symbols", "stops", "symbols_per_word", "lines", "mean_line", "distinct_lines", "longest_line",
    "stopped_lines", "entropy", "short_words",
)


def _mask(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_LETTERS = _mask(bytes(range(65, 91)) + bytes(range(97, 123)))
_HIGH = np.arange(256) >= 128
_DIGITS, _UPPER, _SPACES = _mask(b"0123456789"), _mask(bytes(range(65, 91))), _mask(b" \t\n\r\x0b\x0c")
_PIPES, _SYMBOLS, _STOPS = _mask(b"|<>{}[]\\"), _mask(b"#$%&*+/=@^_~"), _mask(b".,;:!?")


def statistics(text: str | None) -> np.ndarray:
    """The FEATURES of one whole text; all zero for an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(words)
    sizes = np.fromiter(map(len, words), np.int64, k)
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    long_lines = np.fromiter(map(len, lines), np.int64, len(lines))
    share = count[count > 0] / n
    symbols = count[_SYMBOLS].sum()
    return np.array([
        np.log1p(n), np.log1p(k), sizes.mean(), sizes.std(), sizes.max(), len(often) / k, max(often.values()) / k,
        sum(map(eq, words, words[1:])) / k, count[_LETTERS].sum() / n, count[_HIGH].sum() / n, count[_DIGITS].sum() / n,
        count[_UPPER].sum() / n, count[_SPACES].sum() / n, count[_PIPES].sum() / n, symbols / n, count[_STOPS].sum() / n, symbols / k,
        np.log1p(len(lines)), long_lines.mean(), len(set(lines)) / len(lines), long_lines.max(),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), -(share * np.log2(share)).sum(), (sizes <= 2).mean(),
    ])


@dataclass
class Trees:
    """feature, threshold, left, right, value: one row per tree, one column per node; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, total = np.arange(self.feature.shape[0])[None, :], np.empty(len(x))
        for begin in range(0, len(x), 4096):
            rows = x[begin : begin + 4096]
            at, each = np.zeros((len(rows), self.feature.shape[0]), np.int64), np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                goes = rows[each, self.feature[trees, at]] <= self.threshold[trees, at]
                at = np.where(goes, self.left[trees, at], self.right[trees, at])
            total[begin : begin + 4096] = self.base + self.value[trees, at].sum(1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, split by gradient histograms over quantile bins."""
    nodes = 2 ** (depth + 1) - 1
    shape = (max(trees, 1), nodes)
    feature, value, threshold = np.zeros(shape, np.int64), np.zeros(shape), np.full(shape, np.inf)
    left = np.tile(np.arange(nodes), (shape[0], 1))
    right = left.copy()
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Trees(feature, threshold, left, right, value, depth, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    base = float(np.log(share / (1 - share)))
    margin, many = np.full(len(y), base), x.shape[1]
    offset = np.arange(many) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not rows.size:
                continue
            sg, sh = g[rows].sum(), h[rows].sum()
            value[t, node] = -rate * sg / (sh + l2)
            if 2 * node + 2 >= nodes or rows.size < 2 * least:
                continue
            flat = (code[rows] + offset).ravel()
            hist = [np.bincount(flat, np.repeat(w, many), many * bins).reshape(many, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(rows.size))]
            gl, hl, nl = hist
            gain = gl**2 / (hl + l2) + (sg - gl) ** 2 / (sh - hl + l2) - sg**2 / (sh + l2)
            gain[(nl < least) | (rows.size - nl < least)] = -1
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                continue
            feature[t, node], threshold[t, node] = f, edges[f][b]
            left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            at[rows] = np.where(code[rows, f] <= b, 2 * node + 1, 2 * node + 2)
        margin += value[t, at]
    return Trees(feature, threshold, left, right, value, depth, base)


def fit(docs: DataFrame, labels: DataFrame, teaches: Column | None = None, rows: int = FIT_ROWS, **how) -> Trees:
    """Fit on at most `rows` labelled documents. teaches: which labelled ids may be learned from."""
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    use = use.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    use = use.where(teaches) if teaches is not None else use
    use = first_by_hash(use.groupBy("doc_id").agg(F.min("quality").alias("quality")), ["doc_id"], rows)
    text = F.col("text").cast("string")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    chosen = chosen.join(F.broadcast(use), "doc_id")  # at most `rows` ids

    def measure(batches):
        for batch in batches:
            found = batch[["doc_id", "quality", "h"]].copy()
            found["x"] = [statistics(t).tolist() for t in batch["text"]]
            yield found

    found = chosen.mapInPandas(measure, "doc_id long, quality int, h long, x array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("m")).select("doc_id", "m.quality", "m.x").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist()).reshape(len(found), len(FEATURES))
    return fit_trees(x, found["quality"].to_numpy(float), **how)


def score(docs: DataFrame, trees: Trees, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The documents with the probability of label 1, and whether it is 0.5 or more (1 or 0)."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in text]).reshape(len(text), len(FEATURES))
        return pd.Series(trees.score(x))

    done = docs.withColumn(into[0], scored(F.col("text").cast("string")))
    return done.withColumn(into[1], F.when(F.col(f"`{into[0]}`") >= 0.5, 1).otherwise(0).cast("int"))
