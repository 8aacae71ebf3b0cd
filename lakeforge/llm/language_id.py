"""Language identification with a string kernel.

Two texts are compared by the byte n-grams (2, 3 and 4 bytes of the lower-cased text, hashed to ``BITS`` places) that are
present in both, divided by the geometric mean of their numbers: the blended-spectrum presence kernel. A Nyström map
over at most ``LANDMARKS`` training texts turns it into a finite feature space, in which one ridge regression per
language, one versus the rest, is solved. Texts are scored in batches: a presence matrix times the landmarks, times
the coefficients.

Training reads at most ``per_language`` documents of each language, those whose ids hash lowest, and brings only their bit
rows (2 KB each) to the driver; with so many languages that this would be more than ``most_rows``, each gives fewer, but at
least one, and none is left out. Of rows that repeat an id and language one is drawn, so the bounds hold for rows. The model
is broadcast; it grows with the number of languages only (one landmark each, where there are more than ``landmarks``).
Scoring is one pass without a shuffle.

Defined results
    * A text that is null or has no letter is ``und`` with score 0. Whole texts are read.
    * Rows with a null text, language or id teach nothing. An id that has several languages teaches each of them.
    * An empty table of documents gives an empty result.
    * Without training rows every text is ``und`` with score 0; with one language every text with a letter is that one.
    * Columns added replace columns of the same names; all others stay, repeated rows included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import table, text_session
from .labelled import fold

BITS, ORDERS = 1 << 14, (2, 3, 4)
RIDGE, SHARPNESS = 1e-3, 6.0
#: Rows of a presence matrix held at once.
BATCH = 256
_LETTER = common.byte_class(lambda b: chr(b).isalpha() and b < 128)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Places of the n-grams that start at each byte, for each order."""
    out, code = [], data.astype(np.uint32)
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(257) + data[n - 1 :] if len(code) else code
        if n in ORDERS:
            out.append(((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int32))
    return out


def presence(texts: pa.Array):
    """(first row, matrix of 0 and 1, whether each text has a letter) for consecutive batches of texts."""
    whole, all_offsets = common.utf8(texts)
    for a, b in common.slices(all_offsets):
        data = common.lowered(whole[all_offsets[a] : all_offsets[b]])
        offsets = all_offsets[a : b + 1] - all_offsets[a]
        places = grams(data)
        letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
        for lo in range(a, b, BATCH):
            hi = min(b, lo + BATCH)
            x, has = np.zeros((hi - lo, BITS), np.float32), np.zeros(hi - lo, bool)
            for i in range(lo, hi):
                s, e = offsets[i - a], offsets[i - a + 1]
                for n, p in zip(ORDERS, places, strict=True):
                    x[i - lo, p[s : max(s, e - n + 1)]] = 1
                has[i - lo] = letters[e] > letters[s] or any(c.isalpha() for c in data[s:e].tobytes().decode(errors="replace"))
            yield lo, x, has


class KernelModel:
    """Landmarks and the coefficients of each language."""

    def __init__(self, packed: np.ndarray, y: list[str], landmarks: int = 128):
        """``packed``: a row of bits for each training text; they are unpacked some at a time."""
        self.languages = sorted(set(y))
        if not self.languages:
            return
        index = {v: i for i, v in enumerate(self.languages)}
        target = np.array([index[v] for v in y])
        share = max(1, landmarks // len(self.languages))
        chosen = np.concatenate([np.flatnonzero(target == i)[:share] for i in range(len(self.languages))])
        x = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
        self.landmarks = np.ascontiguousarray((x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))).T)
        kernel = np.concatenate([self.kernel(np.unpackbits(packed[i : i + BATCH], axis=1).astype(np.float32)) for i in range(0, len(packed), BATCH)]).astype(float)
        values, vectors = np.linalg.eigh(kernel[chosen])
        kept = values > 1e-6 * values.max()
        to_space = vectors[:, kept] / np.sqrt(values[kept])  # Nyström: kernel columns to coordinates
        z = kernel @ to_space
        wanted = np.where(target[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        solved = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ wanted)
        self.coefficients = (to_space @ solved).astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for lo, x, has in presence(texts) if self.languages else ():
            f = SHARPNESS * (self.kernel(x) @ self.coefficients).astype(float)
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i in np.flatnonzero(has):
                names[lo + i] = self.languages[int(p[i].argmax())]
            scores[lo : lo + len(x)] = np.where(has, p.max(1), 0.0)
        return names, scores


def packed_grams(texts: pa.Array) -> pa.Array:
    return pa.array([np.packbits(row.astype(bool)).tobytes() for _, x, _ in presence(texts) for row in x], pa.binary())


def sample(docs: DataFrame, per_language: int = 600, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``h, y, x``: hash of the id, language and grams of the training rows: one row for each id and language chosen."""
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    keyed = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Ids are ranked as hashes with partial limits, so a language with a third of all rows is cut before it is shuffled.
    heads = keyed.select("id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = heads.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    languages = chosen.filter("rank = 1").count()
    share = max(1, min(per_language, most_rows // max(1, languages)))
    ids = chosen.filter(F.col("rank") <= share).select("id", "lang")  # at most most_rows, or one for each language
    met = keyed.join(F.broadcast(ids) if languages <= most_rows else ids.hint("merge"), ["id", "lang"])
    one = met.groupBy("id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    return one.select(F.xxhash64("id").alias("h"), F.col("lang").alias("y"), F.arrow_udf(packed_grams, "binary")("text").alias("x"))


def train(docs: DataFrame, per_language: int = 600, landmarks: int = 128, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel:
    """Learn from the rows given, within the bounds said above; see ``sample``."""
    got = sample(docs, per_language, most_rows, id_col, text_col, lang_col).toPandas().sort_values(["h", "y"], kind="stable")
    bits = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), BITS // 8)
    return KernelModel(bits, got["y"].tolist(), landmarks)


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def named(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    own, run = "__language", common.per_batch("struct<lang:string,score:double>", lambda: named)
    return docs.withColumn(own, run(F.coalesce(F.col(text_col), F.lit("")))).withColumns({"lang_pred": F.col(f"{own}.lang"), "score": F.col(f"{own}.score")}).drop(own)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(fold("doc_id", 5) != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
