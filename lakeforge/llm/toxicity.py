"""Toxicity by noisy-channel deobfuscation.

1.  A character trigram model is counted over all documents (and, with extra weight, over the learned word list).
2.  Suspicious spans of a text (letters mixed with look-alike digits and signs, letters set apart, letters repeated)
    become lattices: each sign stands for the letters it may have replaced, each gap is kept or dropped, each run of a
    letter is one or two long. Viterbi decoding under the model and the channel's costs finds the likeliest word.
3.  The words of the text and the restored words are looked up in a list of words, word beginnings and beginnings of
    two or three words of a text; a logistic function of the number and density of hits is the score. A feature enters the
    list when its rows are nearly all toxic and a likelihood-ratio test, corrected for the number of features that could
    pass it at all, says that this is neither chance nor noise in the labels. Near copies share one weight.

Distribution: the model is a fixed-size table (its size is a power of the alphabet, not of the data), summed from one
row of counts per task; learning reads a sample of at most ``TRAIN_ROWS`` labelled rows; scoring is one pass.

Defined results
    * Null and empty texts have the score of a text without any hit.
    * Without labels, or with labels of one class only, no word is learned and every score is 0.
    * Whole texts are scored; a very long word is decoded in time in proportion to its length.
    * Nothing depends on the order of rows: sampled rows are those whose ids hash lowest, one row for a repeated id; equal
      texts share a weight even if their labels differ. Empty tables give no rows and, as labels, no words.
    * Columns added replace columns of the same names; all others stay.
"""

from __future__ import annotations

import copy
import functools
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table, text_session
from .labelled import fold, sample

TRAIN_ROWS = 8000
THRESHOLD = 0.7

# What a sign may stand for, in this and other writings of look-alike letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou", "#": "h", "(": "c"}

# -----------------------------------------------------------------------------------------------------------------
# Character model over 64 symbols: 0 for anything between words, a-z as 1 to 26, bytes beyond ASCII folded into the rest.
SYMBOLS = 64
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 37


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of three symbols in a row."""
    if len(data) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    s = _SYMBOL[data].astype(np.int32)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def corpus_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts over all whole texts; at most SYMBOLS ** 3 rows come back, whatever the input."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            for a, b in common.slices(offsets):
                total += trigram_counts(np.append(data[offsets[a] : offsets[b]], np.uint8(32)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])

    rows = docs.select(F.concat(F.col(text_col), F.lit(" ")).alias("t")).mapInArrow(count, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows["trigram"].to_numpy()] = rows["n"].to_numpy()
    return out


class CharModel:
    """Interpolated trigram log-probabilities."""

    def __init__(self, counts: np.ndarray, words: dict[str, float]):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        share = max(c.sum(), 1.0) * 1e-2 / max(1, len(words))  # the learned words make up a hundredth of the text
        for w in words:
            one = trigram_counts(np.frombuffer(f"  {w} ".encode(), np.uint8)).reshape(c.shape)
            c = c + one * share
        two, single = c.sum(0), c.sum((0, 1))
        uni = (single + 1) / (single.sum() + SYMBOLS)
        bi = (two + 5 * uni[None, :]) / (two.sum(1, keepdims=True) + 5)
        tri = (c + 5 * bi[None, :, :]) / (c.sum(2, keepdims=True) + 5)
        self.log = np.log(0.9 * tri + 0.08 * bi[None] + 0.02 * uni[None, None]).astype(np.float32)

    def opened(self) -> CharModel:
        """A copy with lists, which single look-ups are faster in; not to be sent."""
        out = copy.copy(self)
        out.log = self.log if isinstance(self.log, list) else self.log.tolist()
        return out

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading of a lattice: at each place one of some (letters, log cost)."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, back) in states.items():
                for letters, cost in options:
                    x, y, total = a, b, score + cost
                    for s in _symbols(letters):
                        total += log[x][y][s]
                        x, y = y, s
                    known = after.get((x, y))
                    if known is None or total > known[0]:
                        after[x, y] = (total, (letters, back))
            states = after
        _, back = max(states.values(), key=lambda v: v[0])
        out = []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out)).strip()


@functools.lru_cache(maxsize=4096)
def _symbols(letters: str) -> tuple[int, ...]:
    return tuple(_SYMBOL[np.frombuffer(letters.encode(), np.uint8)].tolist())


# -----------------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\W\d_]+")
#: A beginning of one word of a text, or of at least two or three, equal ones included, is marked by so many of these.
STAR = "*"
_MIXED = re.compile(r"[0-9@$!|+*€#(](?=[a-zà-ÿ])|(?<=[a-zà-ÿ])[0-9@$+€]")
_APART = re.compile(r"(?<!\w)[^\W_](?:[ ._*\-][^\W_](?!\w)){2,}")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_PIECE = re.compile(r"[a-zà-ÿ0-9@$!|+*€#(]+")


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of one character in a piece, with their channel log costs."""
    out = []
    for letter, run in itertools.groupby(piece):
        n = sum(1 for _ in run)
        if letter in " ._-" or letter == "*" and len(piece) > 1 and out and piece[1] == "*":
            out.append([("", -0.3), (" ", -3.0)])
            continue
        readings = [(x, -0.5) for x in LOOKALIKES.get(letter, "")] or [(letter, 0.0)]
        if letter in "!*(|+#":
            readings = [*readings, ("", -6.0)]  # it may also be no letter at all
        if n == 1:
            out.append(readings)
        elif n == 2:
            out.append([(x * 2, c) for x, c in readings] + [(x, c - 3.0) for x, c in readings if x])
        else:
            out.append([(x, c - 1.0) for x, c in readings] + [(x * 2, c - 1.5) for x, c in readings if x])
    return out


def suspicious(text: str) -> set[str]:
    """Spans of a lower-case text that may hide a word."""
    found: set[str] = set()
    if _MIXED.search(text) or _REPEATED.search(text):
        end = -1
        for m in itertools.chain(_MIXED.finditer(text), _REPEATED.finditer(text)):
            if m.start() < end and m.start() >= begin:
                continue
            begin, end = m.start(), m.end()
            while begin and not text[begin - 1].isspace():
                begin -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            for piece in _PIECE.findall(text[begin:end]):
                piece = piece.rstrip("!*|+#(")
                if any(x.isalpha() for x in piece) and (_MIXED.search(piece) or _REPEATED.search(piece)):
                    found.add(piece)
    for m in _APART.finditer(text):
        found.add(m[0].replace("*", "-"))
    return found


class Detector:
    """Everything that scoring needs; its size does not depend on the data."""

    def __init__(self, counts: np.ndarray, words: dict[str, float], weights: list[float]):
        self.words, self.weights = words, weights
        self.lengths = sorted({(stars(w), len(w) - stars(w)) for w in words if stars(w)})
        self.model = CharModel(counts, {w.rstrip("*"): x for w, x in words.items()}) if words else None
        self.decoded: dict[str, str] = {}

    def opened(self) -> Detector:
        """The copy that a task works with."""
        out = copy.copy(self)
        out.model, out.decoded = self.model and self.model.opened(), {}
        return out

    def restore(self, span: str) -> str:
        known = self.decoded.get(span)
        if known is None:
            if len(self.decoded) > 50_000:
                self.decoded.clear()
            known = self.decoded[span] = self.model.best(lattice(span))
        return known

    def hits(self, text: str) -> tuple[int, int]:
        """Distinct learned words in a text or what is restored of it, and the number of words."""
        text = text.lower()
        words = WORD.findall(text)
        distinct = set(words)
        if self.model:
            for span in suspicious(text):
                restored = self.restore(span)
                distinct.update(WORD.findall(restored))
                if _APART.fullmatch(span):  # letters set apart: neighbouring single-letter words may have joined them
                    joined = restored.replace(" ", "")
                    distinct.update(w.rstrip(STAR) for w in self.words if stars(w) < 2 and w.rstrip(STAR) in joined)
        found = distinct & self.words.keys()
        for k, n in self.lengths:
            begun = Counter(w[:n] for w in (distinct if k == 1 else words) if len(w) >= n)
            found |= {b + STAR * k for b, times in begun.items() if times >= k} & self.words.keys()
        return len(found), len(words)

    def score(self, text: str | None) -> float:
        if not self.words:
            return 0.0
        n, words = self.hits(text or "")
        return float(_sigmoid(np.dot(self.weights, measures(n, words))))


def measures(n: int, words: int) -> list[float]:
    return [1.0, min(n, 3), float(n > 0), min(5.0, 100 * n / (words + 20))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stars(feature: str) -> int:
    return len(feature) - len(feature.rstrip(STAR))


def features(text: str | None) -> list[str]:
    """Distinct words of a text and the beginnings of its words."""
    words = WORD.findall((text or "").lower())
    begun = Counter(w[:n] for w in words for n in (4, 5, 6, 7) if len(w) >= n)
    return sorted(set(words) | {b + STAR * k for b, times in begun.items() for k in (1, 2, 3) if times >= k and (k > 1 or len(b) < 7)})


def signature(text: str | None) -> int:
    """The same for most near copies: the smallest hash of five words in a row."""
    data, offsets = common.utf8(pa.array([text or ""], pa.string()))
    data = common.lowered(data)
    starts, stops, _ = common.word_bounds(data, offsets, common.byte_class(lambda b: b > 32))
    runs = common.run_hashes(common.word_hashes(data, starts, stops), min(5, max(1, len(starts))))
    return int(runs.min().astype(np.int64)) if len(runs) else 0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression of weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


#: Number of features of a kind that may be expected to enter the list by chance, and the least share of toxic rows.
ERROR, PURITY = 1.0, 0.9


def evidence(good: float, n: float, share: float) -> float:
    """Log-likelihood ratio of a feature in ``n`` rows, ``good`` of them toxic, against the share of toxic rows; a feature
    without a bearing on them has more than x with a probability of at most exp(-x)."""
    bad = n - good
    return (good * math.log(good / n / share) if good > 0 else 0.0) + (bad * math.log(bad / n / (1 - share)) if bad > 1e-9 else 0.0)


def least_evidence(sizes: dict[int, int], share: float) -> float:
    """The evidence to ask for. ``sizes``: number of features by (whole) number of rows. Only features in so many rows that
    they could reach it count as tested, so rare words do not make the test harder for others."""
    for k in range(1, max(sizes, default=0) + 1):
        most = math.log(max(1, sum(n for size, n in sizes.items() if size >= k)) / ERROR)
        if k * -math.log(share) >= most:
            return most
    return math.inf


def word_list(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """The features that stand in the list, with their log odds, from (toxic rows, rows) of each that passed the test.

    A beginning is only of use where no single word, and none that is asked for once only, has its rows to itself; then the
    shortest one stands for the words and the longer beginnings."""
    chosen: dict[str, float] = {}
    for f in sorted(counts, key=lambda f: ((2, 3, 1, 0).index(stars(f)), len(f), f)):
        stem, (good, n) = f.rstrip(STAR), counts[f]
        simpler = (w for w in counts if stars(w) < min(2, stars(f)) and w.startswith(stem))
        if any(counts[w][0] >= (0.9 if stars(f) == 1 else 1) * good for w in simpler) or any(stars(c) and f.startswith(c.rstrip(STAR)) for c in chosen):
            continue
        chosen[f] = math.log((good + 0.5) / (n - good + 0.5))
    return chosen


def train(docs: DataFrame, train_labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Detector:
    """Learn from at most ``rows`` labelled rows; the character model is counted over all documents."""
    spark = docs.sparkSession

    def prepared(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        return pa.StructArray.from_arrays(
            [pa.array([signature(t) for t in texts], pa.int64()), pa.array([len(WORD.findall((t or "").lower())) for t in texts], pa.int32()), common.string_list([features(t) for t in texts])],
            ["signature", "words", "features"],
        )

    prepare = common.per_batch("struct<signature:bigint,words:int,features:array<string>>", lambda: prepared)
    folder = common.shared_folder(spark)
    drawn = sample(docs, train_labels, label, rows, id_col, text_col).select(F.col(id_col).alias("row"), F.col(label).alias("toxic"), prepare(text_col).alias("p")).select("row", "toxic", "p.*")
    drawn = common.staged(drawn, folder, "drawn")
    alike = drawn.groupBy("signature").agg((1 / F.count("*")).alias("weight"))  # near copies count as one row
    drawn = common.staged(drawn.join(alike, "signature"), folder, "sample")
    total, toxic = drawn.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(F.col("weight") * F.col("toxic")), F.lit(0.0))).first()
    none = Detector(np.zeros(SYMBOLS**3, np.int64), {}, [0.0] * 4)
    if not 0 < toxic < total:
        return none
    weight = lambda x: F.round(F.sum(x), 6)  # noqa: E731  the order of a sum has no bearing
    per_word = common.staged(drawn.select("row", "toxic", "weight", F.explode("features").alias("f")).groupBy("f").agg(weight(F.col("weight") * F.col("toxic")).alias("good"), weight("weight").alias("n"), F.bit_xor(F.xxhash64("row")).alias("rows")), folder, "features")
    per_word = per_word.withColumn("stars", F.length("f") - F.length(F.rtrim(F.col("f"), F.lit(STAR))))
    share, sizes = toxic / total, {k: {} for k in range(4)}
    for r in per_word.groupBy("stars", F.floor("n").alias("size")).agg(F.count_distinct("n", "rows").alias("k")).collect():  # features of the same rows are tested once
        sizes[r["stars"]][int(r["size"])] = r["k"]
    least = F.array(*[F.lit(least_evidence(sizes[k], share)) for k in range(4)])  # each kind of feature is tested by itself
    good, n = F.col("good"), F.col("n")
    ratio = good * F.log(good / n / share) + F.when(n - good > 1e-9, (n - good) * F.log((n - good) / n / (1 - share))).otherwise(0.0)
    passed = per_word.filter((good > 0) & (good >= PURITY * n)).filter(ratio >= least[F.col("stars")])
    words = word_list({r["f"]: (r["good"], r["n"]) for r in passed.collect()})  # each has rows of the sample to itself or nearly so
    if not words:
        return none
    listed = spark.createDataFrame([(w,) for w in sorted(words)], "f string")
    found = drawn.select("row", F.explode("features").alias("f")).join(F.broadcast(listed), "f").groupBy("row").agg(F.count("*").alias("hits"))
    got = drawn.select("row", "toxic", "words", "weight").join(found, "row", "left").select("row", "toxic", "words", "weight", F.coalesce("hits", F.lit(0)).alias("hits")).toPandas().sort_values("row")
    x = np.array([measures(h, n) for h, n in zip(got["hits"].tolist(), got["words"].tolist(), strict=True)])
    weights = logistic(x, got["toxic"].to_numpy(float), got["weight"].to_numpy(float)).tolist()
    common.dropped(spark, folder)
    return Detector(corpus_counts(docs, text_col), words, weights)


def score(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def make():
        detector = shared.value.opened()
        return lambda texts: pa.array([detector.score(t.as_py()) for t in texts], pa.float64())

    run = common.per_batch("double", make)
    return docs.withColumn("score", run(F.coalesce(F.col(text_col), F.lit("")))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return score(docs, train(docs, labels)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
