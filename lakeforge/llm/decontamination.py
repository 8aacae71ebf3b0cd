"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of letters and digits; every non-ASCII character belongs to a word. The
hashes of all runs of K words are taken; in each stretch of W consecutive runs the smallest one is kept as a
fingerprint. A stretch spans K + W - 1 = 10 words, so two texts that share 10 words in a row share a fingerprint of
them. Fingerprints of documents are looked up among those of the benchmark, and each hit is extended to the windows of 10
words around it, whose words are compared themselves; windows that overlap are one hit run. A fingerprint that stands in
many places of the benchmark costs no more than one: its windows are held once each, with the items that have them.
Items of fewer than 10 words are one window each and are looked up by the hash of their whole length.

Distribution: documents are not shuffled at all. The benchmark is the query set; it is cut into blocks of at most
``BLOCK_BYTES``, and each block goes to the tasks as one broadcast; an item larger than that is a block of its own. Each
block is one pass
over the documents, staged before the next, so a larger benchmark costs more passes, not more memory.

Defined results
    * A null or empty text has no words and no hits; a null or empty item has no windows.
    * Items that repeat an item_id count once; an item whose id is null marks words but is not listed or counted.
    * The columns added replace columns of the same names; all others are kept as they are, clashing or not.
    * An empty benchmark marks nothing; empty documents give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import table, text_session

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Bytes of a block as it is sent, and how many of them a word takes besides its text.
BLOCK_BYTES, WORD_BYTES = 16 << 20, 48
IS_WORD = common.byte_class(lambda b: 48 <= b < 58 or 97 <= b < 123 or b >= 128)


_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def among(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Which of ``sought`` are in the sorted ``keys``."""
    return keys[np.minimum(np.searchsorted(keys, sought), len(keys) - 1)] == sought if len(keys) else np.zeros(len(sought), bool)


def winnow(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints. ``hashes[i]`` belongs to the K words from i on; ``first`` has each text's first word
    (and the end). Every position that is the minimum of some stretch of W runs inside its text is kept."""
    n = len(hashes)
    if n < W:
        return np.zeros(0, np.int64)
    low = hashes[: n - W + 1].copy()
    for i in range(1, W):
        np.minimum(low, hashes[i : n - W + 1 + i], out=low)
    inside = np.zeros(n - W + 1, bool)
    last = first[1:] - WINDOW
    text = np.searchsorted(first, np.arange(n - W + 1), "right") - 1
    inside[:] = np.arange(n - W + 1) <= last[np.minimum(text, len(last) - 1)]
    kept = np.zeros(n, bool)
    for i in range(W):
        kept[i : n - W + 1 + i] |= inside & (hashes[i : n - W + 1 + i] == low)
    return np.flatnonzero(kept)


class Windows:
    """The distinct windows of one size: by number, one place of each and the items that have it.

    Windows are told apart by the numbers of their words, not by hashes: a key that two of them shared would be drawn anew."""

    def __init__(self, size: int, words: np.ndarray, places: np.ndarray, item: np.ndarray):
        self.size, self.salt = size, 0
        while True:
            keys = self.keys(words[places[:, None] + np.arange(size)])
            order = np.argsort(keys, kind="stable")
            self.own, first, number = np.unique(keys[order], return_index=True, return_inverse=True)
            self.place = places[order][first]
            if (words[places[order][:, None] + np.arange(size)] == words[self.place[number][:, None] + np.arange(size)]).all():
                break
            self.salt += 1
        pairs = np.unique(np.stack((number, item[places[order]]), axis=1), axis=0)
        self.begin, self.items = np.searchsorted(pairs[:, 0], np.arange(len(self.own) + 1)), pairs[:, 1]

    def keys(self, rows: np.ndarray) -> np.ndarray:
        acc = np.full(len(rows), self.salt, np.uint64)
        for i in range(self.size):
            acc = common.mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, i].astype(np.uint64) + np.uint64(1))
        return acc

    def find(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Number of the window that each row of word numbers is; -1 for none."""
        if not len(self.own):
            return np.full(len(rows), -1)
        at = np.minimum(np.searchsorted(self.own, self.keys(rows)), len(self.own) - 1)
        same = (words[self.place[at][:, None] + np.arange(self.size)] == rows).all(axis=1)
        return np.where(same, at, -1)


class Block:
    """A bounded part of the benchmark: its words by number, its fingerprints, and its windows."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.ids = [i for i, _ in items]
        data, offsets = common.utf8(pa.array([t for _, t in items], pa.string()))
        data = common.lowered(data)
        starts, stops, first = common.word_bounds(data, offsets, IS_WORD)
        self.number: dict[bytes, int] = {}
        self.words = np.fromiter((self.number.setdefault(data[a:b].tobytes(), len(self.number)) for a, b in zip(starts, stops, strict=True)), np.int32, len(starts))
        hashes = common.word_hashes(data, starts, stops)
        item, lengths = np.repeat(np.arange(len(items)), np.diff(first)), np.diff(first)
        runs = common.run_hashes(hashes, K)
        self.prints = np.unique(runs[winnow(runs, first)])
        places = np.arange(len(self.words))
        self.long = Windows(WINDOW, self.words, places[places + WINDOW <= first[1:][item]], item)
        self.short: dict[int, tuple[np.ndarray, Windows]] = {}
        for m in range(1, WINDOW):
            at = first[:-1][lengths == m]
            if len(at):
                self.short[m] = np.unique(common.run_hashes(hashes, m)[at]), Windows(m, self.words, at, item)

    def hits(self, data, starts, stops, first, hashes):
        """(text, first word, end word, items that have the window) for every place of a window in the texts.

        A shared window holds a fingerprint that both sides keep, so the windows around the fingerprints that match are all
        there can be. Each of these places is looked at once, by the numbers of its words, however often the benchmark has
        the fingerprint."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ends = first[1:][text]
        sought = []
        runs = common.run_hashes(hashes, K)
        at = winnow(runs, first)
        at = at[among(self.prints, runs[at])]
        near = np.zeros(len(hashes), bool)
        for back in range(W):
            s = at - back
            near[s[(s >= first[:-1][text[at]]) & (s + WINDOW <= ends[at])]] = True
        sought.append((self.long, np.flatnonzero(near)))
        for m, (prints, windows) in self.short.items():
            p = np.flatnonzero(among(prints, common.run_hashes(hashes, m)))
            sought.append((windows, p[p + m <= ends[p]]))
        needed = np.zeros(len(hashes) + 1, np.int64)
        for windows, places in sought:
            np.add.at(needed, places, 1)
            np.add.at(needed, places + windows.size, -1)
        numbers = np.full(len(hashes), -1, np.int32)
        for i in np.flatnonzero(np.cumsum(needed[:-1]) > 0).tolist():
            numbers[i] = self.number.get(data[starts[i] : stops[i]].tobytes(), -1)
        for windows, places in sought:
            found = windows.find(numbers[places[:, None] + np.arange(windows.size)], self.words)
            places, found = places[found >= 0], found[found >= 0]
            named = set()
            for p, t, w in zip(places.tolist(), text[places].tolist(), found.tolist(), strict=True):
                new = (t, w) not in named  # the items of a window that a text repeats are named once
                named.add((t, w))
                yield t, p, p + windows.size, windows.items[windows.begin[w] : windows.begin[w + 1]].tolist() if new else ()


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark in parts of at most BLOCK_BYTES as sent (a longer item alone), fetched one partition at a time."""
    part, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        text = row[1].encode()
        size = 2 * len(text) + WORD_BYTES * len(_WORDS.findall(text))
        if part and held + size > BLOCK_BYTES:
            yield Block(part)
            part, held = [], 0
        part.append((row[0], row[1]))
        held += size
    if part:
        yield Block(part)


HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def searcher(shared):
    """The function that adds one block's hits to those of the blocks before it."""

    @F.arrow_udf(HIT)
    def search(texts: pa.Array, prior: pa.Array) -> pa.Array:
        counts, lows, highs, items = [], [], [], []
        whole, offsets = common.utf8(texts)
        block = shared.value
        old = prior.to_pylist() if prior.null_count < len(prior) else [None] * len(prior)
        for a, b in common.slices(offsets):
            data = common.lowered(whole[offsets[a] : offsets[b]])
            starts, stops, first = common.word_bounds(data, offsets[a : b + 1] - offsets[a], IS_WORD)
            hashes = common.word_hashes(data, starts, stops)
            spans = [list(zip(x["starts"], x["ends"], strict=True)) if x else [] for x in old[a:b]]
            named = [set(x["items"]) if x else set() for x in old[a:b]]
            for text, p, r, found in block.hits(data, starts, stops, first, hashes):
                spans[text].append((p - int(first[text]), r - int(first[text])))
                named[text].update(block.ids[item] for item in found if block.ids[item] is not None)
            counts += np.diff(first).tolist()
            for s, i in zip(spans, named, strict=True):
                joined: list[list[int]] = []
                for p, r in sorted(s):
                    if joined and p <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], r)
                    else:
                        joined.append([p, r])
                lows.append([p for p, _ in joined])
                highs.append([r for _, r in joined])
                items.append(sorted(i))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32())), common.string_list(items)],
            ["n_words", "starts", "ends", "items"],
        )

    return search


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Add ``n_words, n_hit, hit_spans (start and end word of each hit run), hit_items, contaminated`` to every row."""
    own = "__decontamination"
    found, folder = docs.withColumn(own, F.lit(None).cast(HIT)), None
    spark, previous = docs.sparkSession, None
    for number, block in enumerate(blocks(benchmark, item_col, item_text_col)):
        if previous is not None:
            folder = folder or common.shared_folder(spark)
            found = common.staged(found, folder, f"block{number}")
            previous.unpersist()
        previous = spark.sparkContext.broadcast(block)
        found = found.withColumn(own, searcher(previous)(F.col(text_col), F.col(own)))
    if previous is None:
        found = found.withColumn(own, searcher(spark.sparkContext.broadcast(Block([])))(F.col(text_col), F.col(own)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return found.withColumns(
        {
            "n_words": F.col(f"{own}.n_words"),
            "n_hit": total(F.col(f"{own}.ends")) - total(F.col(f"{own}.starts")),
            "hit_spans": F.arrays_zip(F.col(f"{own}.starts").alias("start"), F.col(f"{own}.ends").alias("end")),
            "hit_items": F.col(f"{own}.items"),
            "contaminated": F.size(F.col(f"{own}.items")) + F.size(F.col(f"{own}.starts")) > 0,
        }
    ).drop(own)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH item AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS m, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS w
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item WHERE len(words) > 0)
), doc AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents
), runs AS (
    SELECT doc_id, m, i, array_to_string(words[i : i + m - 1], ' ') AS w
    FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i
          FROM doc, (SELECT DISTINCT m FROM windows) WHERE len(words) >= m)
), hits AS (
    SELECT doc_id, item_id, i, runs.m FROM runs JOIN windows ON runs.m = windows.m AND runs.w = windows.w
), per_word AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), per_item AS (
    SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""
