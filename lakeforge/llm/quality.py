"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins. Training goes round the features again and again; each turn fits
a shallow tree of one feature to what is left to explain and adds a small part of it to that feature's table. Then the
pairs of features that explain most of the rest get two-dimensional tables in the same way. A score is the logistic
function of a sum of table entries, looked up for a whole batch at once.

Features are numbers of the text alone (letters, signs, repetition, lines, words), computed on Arrow buffers. Training
reads at most ``TRAIN_ROWS`` labelled rows, drawn by hash; the model has a fixed size and is broadcast. Scoring is one
pass without a shuffle.

Defined results
    * Null and empty texts have the features of no words, and get a score like any other text.
    * Without labels every score is 0.5; with labels of one class the scores are near that class.
    * Whole texts are read. Columns added replace columns of the same names; all others stay, repeated rows included.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table, text_session
from .labelled import fold, sample

TRAIN_ROWS = 8000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 120, 60, 0.15, 12

NAMES = (
    "log_bytes log_words word_length upper digits signs bars bangs marks beyond_ascii distinct_words repeated_words top_word "
    "short_words lines_per_word repeated_lines line_length ended_lines repeated_pairs longest_run"
).split()
_IS_WORD = common.byte_class(lambda b: b > 32)
_IS_LINE = common.byte_class(lambda b: b != 10)
_KINDS = np.stack(
    [
        common.byte_class(lambda b: 65 <= b <= 90),
        common.byte_class(lambda b: 97 <= b <= 122),
        common.byte_class(lambda b: 48 <= b <= 57),
        common.byte_class(lambda b: chr(b) in "#*%$&@^~_=+<>{}[]\\/"),
        common.byte_class(lambda b: b == ord("|")),
        common.byte_class(lambda b: b == ord("!")),
        common.byte_class(lambda b: chr(b) in ".,;:?"),
        common.byte_class(lambda b: b >= 192),
    ]
)


def _share_repeated(x: np.ndarray) -> tuple[float, float]:
    """Share of values that are not the first of their kind, and of the commonest value."""
    if not len(x):
        return 0.0, 0.0
    _, n = np.unique(x, return_counts=True)
    return 1 - len(n) / len(x), n.max() / len(x)


def measure(texts: pa.Array) -> np.ndarray:
    """One row of features per text, in the order of NAMES."""
    whole, all_offsets = common.utf8(texts)
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in common.slices(all_offsets):
        data, offsets = whole[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a]
        sizes = np.diff(offsets)
        kinds = np.stack([np.diff(np.concatenate(([0], np.cumsum(k[data])))[offsets]) for k in _KINDS]) if len(data) else np.zeros((len(_KINDS), b - a))
        upper, lower, digits, signs, bars, bangs, marks, beyond = kinds / np.maximum(sizes, 1)
        starts, stops, first = common.word_bounds(data, offsets, _IS_WORD)
        words, lengths = common.word_hashes(common.lowered(data), starts, stops), stops - starts
        line_starts, line_stops, line_first = common.word_bounds(data, offsets, _IS_LINE)
        lines = common.word_hashes(data, line_starts, line_stops)
        ended = np.isin(data[line_stops - 1], np.frombuffer(b".!?:\"')", np.uint8)) if len(line_stops) else np.zeros(0, bool)
        again = np.concatenate(([0], np.cumsum(np.append(words[1:] == words[:-1], False)))) if len(words) else np.zeros(1)
        run = np.zeros(len(words) + 1, np.int64)
        if len(words):
            opens = np.append(True, words[1:] != words[:-1])
            opens[first[:-1][first[:-1] < len(words)]] = True  # a run ends with its text
            sizes_of_runs = np.diff(np.append(np.flatnonzero(opens), len(words)))
            run[:-1] = np.repeat(sizes_of_runs, sizes_of_runs)
        for i in range(b - a):
            w, line = slice(first[i], first[i + 1]), slice(line_first[i], line_first[i + 1])
            n, m = int(first[i + 1] - first[i]), int(line_first[i + 1] - line_first[i])
            repeated, top = _share_repeated(words[w])
            pairs, _ = _share_repeated(words[w][1:] * np.uint64(3) + words[w][:-1])
            out[a + i] = (
                np.log1p(sizes[i]), np.log1p(n), lengths[w].mean() if n else 0, upper[i] / max(upper[i] + lower[i], 1e-9), digits[i], signs[i], bars[i], bangs[i], marks[i], beyond[i],
                1 - repeated, (again[max(first[i], first[i + 1] - 1)] - again[first[i]]) / max(n - 1, 1), top, (lengths[w] <= 3).mean() if n else 0, m / max(n, 1),
                _share_repeated(lines[line])[0], np.log1p((line_stops[line] - line_starts[line]).mean()) if m else 0, ended[line].mean() if m else 0, pairs, np.log1p(run[w].max()) if n else 0,
            )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with sums of gradients, curvatures and rows."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a tree that cuts each part of the bins at most ``depth`` times."""
    gain, at = _best_cut(g, h, n) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


class AdditiveModel:
    """Bin edges, one table per feature, tables for pairs, and an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        features = x.shape[1] if x.ndim == 2 and len(x) else len(NAMES)
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid)) if len(x) else np.zeros(0) for j in range(features)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.coarse = [np.minimum((np.arange(len(e) + 1) * PAIR_BINS) // (len(e) + 1), PAIR_BINS - 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.intercept = 0.0
        if len(x):
            share = (y.sum() + 0.5) / (len(y) + 1)
            self.intercept = float(np.log(share / (1 - share)))
            self._fit(x, y)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, total = self.bins(x), np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                if len(self.tables[j]) == 1:
                    continue
                p = _sigmoid(total)
                sums = [np.bincount(b, v, len(self.tables[j])) for v in (y - p, p * (1 - p), np.ones(len(y)))]
                step = RATE * _tree(*sums, depth=2)
                self.tables[j] += step
                total += step[b]
        coarse = [c[b] for c, b in zip(self.coarse, bins, strict=True)]
        p = _sigmoid(total)
        gains = []
        for i, j in itertools.combinations(range(len(bins)), 2):
            cell = coarse[i] * PAIR_BINS + coarse[j]
            g, h = (np.bincount(cell, v, PAIR_BINS**2) for v in (y - p, p * (1 - p)))
            gains.append((float((g**2 / (h + 1)).sum()), i, j))
        chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.pairs = {pair: np.zeros((PAIR_BINS, PAIR_BINS)) for pair in chosen}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                p = _sigmoid(total)
                cell = coarse[i] * PAIR_BINS + coarse[j]
                g, h, n = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p), np.ones(len(y))))
                # the cut of the first feature whose two parts gain most from a cut of the second
                gains = [sum(_best_cut(g[part].sum(0), h[part].sum(0), n[part].sum(0))[0] for part in (slice(0, c), slice(c, PAIR_BINS))) for c in range(1, PAIR_BINS)]
                at = 1 + int(np.argmax(gains))
                step = np.zeros_like(g)
                for part in (slice(0, at), slice(at, PAIR_BINS)):  # a tree of two levels, one for each feature
                    step[part] = RATE * _tree(g[part].sum(0), h[part].sum(0), n[part].sum(0), depth=1)
                self.pairs[i, j] += step
                total += step[coarse[i], coarse[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for t, b in zip(self.tables, bins, strict=True):
            total += t[b]
        for (i, j), t in self.pairs.items():
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return _sigmoid(total)


def _measured(text):
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        x = measure(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))

    return run(F.coalesce(text, F.lit("")))


def train(docs: DataFrame, train_labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled rows; only their features come to the driver."""
    got = sample(docs, train_labels, label, rows, id_col, text_col).select(F.col(id_col).alias("i"), F.col(label).alias("y"), _measured(F.col(text_col)).alias("x")).toPandas()
    got = got.sort_values("i", kind="stable")
    return AdditiveModel(np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES)), got["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    run = common.per_batch("double", lambda: lambda texts: pa.array(shared.value.score(measure(texts))))
    return docs.withColumn("score", run(F.coalesce(F.col(text_col), F.lit("")))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    return score(docs, train(docs, labels)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
