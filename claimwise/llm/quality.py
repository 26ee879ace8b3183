"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the text alone, per document, within the scan's tasks.
Trees are fitted on at most ``MAX_TRAINING_ROWS`` labelled documents (those with the
smallest hash of doc_id; a documented bound), whose statistics, a few dozen numbers
each, come to the driver. Scoring flattens all trees into arrays (feature,
threshold, left, right, value) that numpy steps through for a batch of documents at
once.

Null and empty texts have zero statistics and are scored like any other row. Null
doc_ids are never learned from. Labels with several rows per doc_id count once each;
a doc_id with several texts is learned from once per text. Repeated rows have equal scores.
Other columns are not read, whatever their names; very long texts are read whole. An empty table
gives an empty result, and without usable labels every score is that of no trees.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, strings

MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA = 80, 4, 32, 0.15, 1.0
THRESHOLD = 0.7

STATISTICS = ("log_chars", "log_words", "mean_word", "max_word", "upper", "digits", "space", "symbols", "non_ascii", "ends_symbol", "caps_words",
              "distinct_words", "top_word", "adjacent_repeats", "distinct_pairs", "top_pair", "lines", "distinct_lines", "mean_line", "bars",
              "exclamations", "sentence_ends", "capital_sentences", "commas", "short_words", "one_char_share", "markup", "at_signs")
_UPPER = re.compile(r"[^\W\d_]")


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for one text."""
    text = text or ""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    raw = np.frombuffer(text.encode(), np.uint8)
    by = np.bincount(raw, minlength=256)
    size = len(raw)
    upper, digits = by[65:91].sum(), by[48:58].sum()
    lower = by[97:123].sum()
    space = by[32] + by[9:14].sum()
    symbols = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    lens = [len(x) for x in words] or [0]
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    ends = sum(not x[-1].isalnum() and x[-1] not in ".,;:?)\"'" for x in words)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(lens) / w, float(np.log1p(max(lens))), upper / max(1, upper + lower), digits / size,
        space / size, symbols / size, by[128:].sum() / size, ends / w, sum(x.isupper() and len(x) > 1 for x in words) / w,
        len(counts) / w, max(counts.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        len(pairs) / w, max(pairs.values(), default=0) / w, float(np.log1p(len(lines))), len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        by[124] / w, by[33] / w, (by[46] + by[63]) / w, sum(x[:1].isupper() for x in words) / w, by[44] / w, sum(x <= 2 for x in lens) / w,
        sum(x == 1 for x in lens) / w, (by[60] + by[62] + by[123] + by[125]) / w, by[64] / w,
    ]


def _statistics_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array([statistics(x.as_py()) for x in batch.column(name)], np.float64).reshape(batch.num_rows, len(STATISTICS))


class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold = np.asarray(feature, np.int32), np.asarray(threshold, np.float64)
        self.left, self.right = np.asarray(left, np.int32), np.asarray(right, np.int32)
        self.value, self.roots = np.asarray(value, np.float64), np.asarray(roots, np.int32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, reg: float = LAMBDA) -> Trees:
    """Second-order boosting of the log loss; splits are searched on per-feature histograms."""
    n, m = x.shape
    p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), np.int64)
    margin = np.full(n, base)

    def leaf(g: float, h: float) -> int:
        feature.append(0), threshold.append(np.inf), left.append(len(left)), right.append(len(right)), value.append(-rate * g / (h + reg))
        return len(value) - 1

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        node = leaf(g, h)
        if level == depth or len(rows) < 10:
            margin[rows] += value[node]
            return node
        flat = (binned[rows] + np.arange(m) * bins).reshape(-1)
        hist_g = np.bincount(flat, np.repeat(grad[rows], m), m * bins).reshape(m, bins).cumsum(axis=1)[:, :-1]
        hist_h = np.bincount(flat, np.repeat(hess[rows], m), m * bins).reshape(m, bins).cumsum(axis=1)[:, :-1]
        gain = hist_g ** 2 / (hist_h + reg) + (g - hist_g) ** 2 / (h - hist_h + reg) - g * g / (h + reg)
        gain[(hist_h < 1) | (h - hist_h < 1)] = -np.inf
        j, b = divmod(int(np.argmax(gain)), bins - 1)
        if not gain[j, b] > 1e-9 or b >= len(cuts[j]):
            margin[rows] += value[node]
            return node
        goes = binned[rows, j] <= b
        feature[node], threshold[node] = j, float(cuts[j][b])
        left[node] = grow(rows[goes], grad, hess, level + 1)
        right[node] = grow(rows[~goes], grad, hess, level + 1)
        return node

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0))
    if not roots:
        roots.append(leaf(0.0, 0.0))
    return Trees(base, feature, threshold, left, right, value, roots, depth)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_TRAINING_ROWS, usable=None) -> Trees:
    """Trees from the labelled documents; ``usable``: a condition on the id."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    if usable is not None:
        marked = marked.filter(usable(F.col("_id")))
    marked = marked.withColumn("_order", F.md5(F.col("_id").cast("string"))).orderBy("_order", "_y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), strings(docs, text_col).alias("text")).join(F.broadcast(marked), "_id").select("_order", "_y", "text")

    def run(batches):
        for batch in batches:
            x = _statistics_of(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["_order", "_y", "x"])

    got = rows.mapInArrow(run, "_order string, _y int, x array<double>").orderBy("_order", "_y", "x").limit(max_rows).collect()   # bounded by max_rows
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r["_y"] for r in got], np.float64))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per row."""
    source = docs.select(F.col(id_col), strings(docs, text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_statistics_of(batch, "_text")), pa.float64())], names=[id_col, "score"])

    return source.mapInArrow(run, T.StructType([source.schema[id_col], T.StructField("score", T.DoubleType())]))


def held_out(ident):
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(ident.cast("string").cast("binary")) % 4 == 2


def drop_poor(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            x = np.array([statistics(t.as_py()) for t in column], np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield batch.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(giving_back(run), schema)
