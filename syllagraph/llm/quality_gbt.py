"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and saved. Trees are fitted on at most TRAIN_ROWS labelled documents and
flattened into arrays, which tasks walk with numpy for a whole batch at a time.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled documents that the trees are fitted on, taken by a hash of the id.
TRAIN_ROWS = 20_000
#: Share of ids whose labels are held out: crc32(doc_id as text) mod FOLDS = HELD_OUT.
FOLDS, HELD_OUT = 3, 1

SYMBOLS = "#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
NAMES = ("log_chars", "log_words", "mean_word", "distinct_share", "stutter_share", "trigram_repeat_share", "symbols_per_word", "bars_per_word", "exclaims_per_word", "upper_share", "digit_share", "punctuation_share", "words_per_line", "dup_line_share", "short_word_share", "longest_word")
BLANK = re.compile(common.NOT_WORD)


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of NAMES; all zero for an empty one."""
    if not text:
        return [0.0] * len(NAMES)
    words = [w for w in BLANK.split(text) if w]
    n, chars, data = len(words), len(text), text.encode()
    some = max(n, 1)
    letters = max(len(data), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    sizes = list(map(len, words))
    return [
        math.log1p(chars),
        math.log1p(n),
        sum(sizes) / some,
        len(set(words)) / some,
        sum(map(eq, words, words[1:])) / some,
        1 - len(triples) / max(n - 2, 1) if n > 2 else 0.0,
        sum(map(text.count, SYMBOLS)) / some,
        text.count("|") / some,
        text.count("!") / some,
        1 - len(data.translate(None, UPPER)) / letters,
        1 - len(data.translate(None, DIGITS)) / letters,
        1 - len(data.translate(None, PUNCTUATION)) / letters,
        n / max(len(lines), 1),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        (sizes.count(1) + sizes.count(2)) / some,
        math.log1p(max(sizes, default=0)),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth, flattened: inner nodes of tree t stand in row t of feature and threshold, its leaves in row t of leaf. The children of node i are 2i+1 and 2i+2; a row goes right where its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_rows: int = 10) -> Forest:
    """Second-order boosting of the logistic loss. Features are cut into quantile bins once; a node's split is the best
    one of its histograms of gradients. A node without a worthwhile split sends all its rows left."""
    inner = (1 << depth) - 1
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    prior = math.log(mean / (1 - mean))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin > k: value > cut k
    flat = binned + np.arange(m) * bins
    raw = np.full(n, prior)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(node == k)
                node[own] = 2 * k + 1
                if len(own) < 2 * least_rows:
                    continue
                cells = flat[own].ravel()
                hist = [np.bincount(cells, np.repeat(v, m), m * bins).reshape(m, bins).cumsum(axis=1) for v in (g[own], h[own], np.ones(len(own)))]
                gl, hl, nl = (v[:, :-1] for v in hist)
                gt, ht = g[own].sum(), h[own].sum()
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least_rows) | (len(own) - nl < least_rows)] = -1
                for j, c in enumerate(cuts):
                    gain[j, len(c) :] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] <= 1e-6:
                    continue
                feature[k], threshold[k] = j, cuts[j][b]
                node[own] += binned[own, j] > b
        place = node - inner
        leaf = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + l2)
        raw += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), prior)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features of every row's whole text, saved in the shared folder."""

    def make():
        return lambda ids, values: {"doc_id": ids, "x": [statistics(t) for t in values]}

    return common.saved(common.map_texts(docs, make, "doc_id long, x array<float>", id_col, text_col), "quality-features")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT


def train(features: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fitted on labelled documents that aren't held out. Rows with a null label or id are left out; of several labels of
    one document the lowest counts."""
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out())
    sample = features.join(own, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("x", "quality").toArrow()
    x = np.array(sample.column("x").to_pylist(), dtype=np.float32).reshape(-1, len(NAMES)).astype(float)
    return fit_forest(x, np.array(sample.column("quality").to_pylist(), dtype=float))


def scored(features: DataFrame, forest: Forest) -> DataFrame:
    schema = "doc_id long, held_out boolean, score double, predicted int"
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(stream):
        for batch in stream:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            score = forest.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=arrow)

    return features.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "x").mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text; label, language, source and id never enter a score.

    A null text is an empty one and is scored as such. Without labels, or with one class only, every score is the same. A
    null doc_id isn't held out. Repeated rows give repeated results; an empty table gives no rows; other columns are
    ignored.
    """
    features = document_features(docs, id_col, text_col)
    return scored(features, train(features, labels, train_rows))


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of 0.5 or more, all their columns as they were. Fits on the labelled documents that
    the classifier's folds allow, then scores each row where it is read: nothing is joined back. A null text is scored as an
    empty one and stays null; repeated rows and those with a null id stay or go by their text. Without labels, or with
    labels of one class only, there is nothing to tell apart and all rows stay; an empty table stays empty."""
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct().filter(~held_out())
    some = common.sample_of(own, train_rows, "doc_id")
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id", "left_semi")
    forest = train(document_features(known), labels, train_rows)
    if not len(forest.leaf):
        return docs

    @F.pandas_udf("double")
    def score(values):
        if not len(values):
            return values.astype(float)
        x = np.array([statistics(t) for t in values], dtype=np.float32).astype(float)
        return pd.Series(forest.score(x))

    return docs.filter(score(F.coalesce(F.col(text_col), F.lit(""))) >= 0.5)
