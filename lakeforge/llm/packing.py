"""Packing by concatenation: all documents as one run of tokens, cut into windows of fixed size.

A document is its token ids followed by an end id. Two passes give every document its place in the whole run: the first
encodes each partition and numbers tokens inside it, the second adds what the partitions before it hold, a prefix sum
over the partitions' totals. The run is cut at every multiple of the window, so each window but the last is full and at
most one window less one token is padding, whatever the corpus. A document that crosses a cut is in several pieces.

``pieces`` says where each piece goes, in built-in functions over the encoded table. ``sequences`` builds the windows
themselves: a task emits each window that lies inside its own stretch of the run, and of the windows that it only begins
or ends it emits boundary records, of which there are two for each stretch; only these are shuffled.

Ids are those of the tokenizers library. White space is dropped by the tokenizer and no token crosses it, so a text's ids
are those of its stretches between white space, of which a task keeps a bounded table; new ones are merged in bulk.

Defined results
    * A null or empty text is the end id alone; every row, repeated ones included, has at least one piece.
    * Whole texts of any length are encoded and may span any number of windows.
    * The order of documents is that of the table's partitions; each run writes it down before it is used, so that the
      places are of one order even where a task is repeated.
    * An empty table has no piece and no sequence. Only id and text are read; other columns may have any name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import default_path
from .bulk_bpe import BulkEncoder
from .common import shared_folder, small_batches, staged, table, text_session

WINDOW, END = 2048, 1
#: Stretches whose ids a task keeps, and the bytes above which a stretch goes through the library.
KEPT, LONGEST = 600_000, 64
#: Bytes of text encoded at once.
SLICE = 1 << 21
#: Partitions whose offsets are sent to all tasks (16 bytes each); beyond it they are joined by shuffle.
MOST_SENT = 1 << 18
#: Partitions whose totals one task sums up.
BLOCK = 1 << 10


_WORD = common.byte_class(lambda b: b not in b" \t\n\r\x0b\x0c")
_OTHER_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


class StretchTable:
    """Ids of the stretches between white space met so far: hashes in order, and where the ids of each are in one array.

    A stretch is known by one 64-bit hash and checked by another; texts in which the two disagree are encoded by the
    library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bulk, self.tokenizer = BulkEncoder(path), Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = self.bulk.spec
        (pattern,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(f"\n|{pattern}")
        self.apart = regex.compile(b"|".join([b"\0", *(regex.escape(t["content"].encode()) for t in spec["added_tokens"])]))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.checks, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, checks: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        ids, sizes = self.ids(data, starts, stops)
        numbers = len(self.ends) - 1 + np.arange(len(starts))
        self.flat = np.concatenate((self.flat, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        merged = np.concatenate((self.hashes, hashes))
        order = np.argsort(merged, kind="stable")
        self.hashes, self.checks, self.number = merged[order], np.concatenate((self.checks, checks))[order], np.concatenate((self.number, numbers))[order]

    def ids(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row and how many each has. They are cut into words together and merged in bulk; long ones
        and those with a special token, which are rare, go through the library one by one."""
        lengths = stops - starts
        lines = np.full(int((lengths + 1).sum()), 10, np.uint8)  # each on a line
        at = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        lines[np.repeat(at[:-1], lengths) + inside] = data[np.repeat(starts, lengths) + inside]
        text = lines.tobytes()
        found = [m.start() for m in self.apart.finditer(text)]
        alone = lengths > LONGEST
        alone[np.searchsorted(at, found, "right") - 1] = True
        rest = np.flatnonzero(alone)
        if len(rest):
            text = lines[np.repeat(~alone, lengths + 1)].tobytes()
        ids, sizes = np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        line = text.decode()
        if not line.isascii():
            line = unicodedata.normalize("NFC", line).replace("Σ", "σ")
        words = np.frombuffer("\0".join(self.words.findall(line.lower())).encode() + b"\0", np.uint8)
        if len(words) > 1:
            ends = np.flatnonzero(words == 0)
            first = np.concatenate(([0], ends[:-1] + 1))
            between = words[first] == 10  # only the end of a line has one
            size = (ends - first)[~between]
            keep = np.repeat(~between, ends - first + 1)
            keep[ends] = False
            ids, counts = self.bulk.encode(words[keep], size)
            sizes[~alone] = np.bincount(np.cumsum(between)[~between], counts, len(starts) - len(rest)).astype(np.int64)
        if len(rest):
            own = [self.library(data[starts[i] : stops[i]].tobytes()) for i in rest.tolist()]
            sizes[rest] = [len(x) for x in own]
            out, many = np.empty(int(sizes.sum()), np.int32), np.repeat(alone, sizes)
            out[~many], out[many] = ids, np.array([i for x in own for i in x], np.int32)
            ids = out
        return ids, sizes

    def library(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end``, and where each text's begin (length texts + 1)."""
        starts, stops, first = common.word_bounds(data, offsets, _WORD)
        hashes, checks = common.word_hashes(data, starts, stops), common.word_hashes(data, starts, stops, _OTHER_CODE)
        own, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        for again in (False, True):
            place = np.searchsorted(self.hashes, own)
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == own if len(self.hashes) else np.zeros(len(own), bool)
            if known.all():
                break
            if not again and len(self.hashes) + np.count_nonzero(~known) > KEPT:
                self.clear()
                known[:] = False
            new = one[~known]
            self.learn(own[~known], checks[new], data, starts[new], stops[new])
        if len(own) and (self.checks[place][which] != checks).any():
            texts = [[*self.library(data[a:b].tobytes()), end] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([i for t in texts for i in t], np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        at = self.number[place][which] if len(own) else np.zeros(0, np.int64)
        lengths = self.ends[at + 1] - self.ends[at]
        before = np.concatenate(([0], np.cumsum(lengths)))
        text = before[first]  # where each text's ids begin without the end ids
        n = len(offsets) - 1
        out = np.full(before[-1] + n, end, np.uint32)
        kept = np.ones(len(out), bool)
        kept[text[1:] + np.arange(n)] = False
        out[kept] = self.flat[np.repeat(self.ends[at] - before[:-1], lengths) + np.arange(before[-1])]
        return out, text + np.arange(n + 1)


def encoder(path: str, end: int):
    """Encodes partitions: id, ids as little-endian 32-bit numbers, number of ids, and the place among those of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, total = StretchTable(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            whole, offsets = common.utf8(batch.column("text"))
            for a, b in common.slices(offsets, SLICE):
                base = offsets[a]
                ids, at = words.encode(whole[base : offsets[b]], offsets[a : b + 1] - base, end)
                n = np.diff(at)
                body = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(at * 4)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(at[:-1] + total), pa.array(n), body], names=["id", "part", "place", "tokens", "ids"])
                total += int(at[-1])
            common.release()

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """``id, position, tokens, ids``: every document with its ids and its place in the run of all, written."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([read.schema["id"], *T.StructType.fromDDL("part int, place bigint, tokens bigint, ids binary")])
    first = f"{folder}/encoded"
    with small_batches(spark):
        read.mapInArrow(encoder(path, end), schema).write.option("compression", "zstd").parquet(first)
    rows = spark.read.schema(schema).parquet(first)
    return placed(rows, starts(rows)).select("id", (F.col("start") + F.col("place")).alias("position"), "tokens", "ids")


def starts(rows: DataFrame) -> DataFrame:
    """``part, start``: tokens before each partition. Totals are summed by blocks of partitions, then inside each block."""
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    totals = staged(totals, shared_folder(rows.sparkSession), "totals")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).withColumn("ahead", before(Window.orderBy("block"))).drop("n")
    own = totals.withColumn("own", before(Window.partitionBy("block").orderBy("part")))
    return staged(own.join(blocks, "block").select("part", (F.col("ahead") + F.col("own")).alias("start")), shared_folder(rows.sparkSession), "starts")


def placed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    few = offsets.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(offsets) if few else offsets.hint("merge"), "part")


def pieces(run: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, start, length, ids, doc_tokens, sequence_id, offset, position``: a row for each piece of each document of ``encoded``."""
    size = F.lit(window).cast("bigint")
    first, stop = F.col("position"), F.col("position") + F.col("tokens")

    def piece(k):
        a, b = F.greatest(k * size, first), F.least((k + 1) * size, stop)
        ids = F.col("ids").substr(((a - first) * 4 + 1).cast("int"), ((b - a) * 4).cast("int"))
        return F.struct((a - first).alias("start"), (b - a).alias("length"), ids.alias("ids"), k.alias("sequence_id"), (a - k * size).alias("offset"))

    last = F.floor((stop - 1) / size)
    cut = F.transform(F.sequence(F.floor(first / size), last), piece)
    return run.select("id", "position", F.col("tokens").alias("doc_tokens"), F.inline(cut)).select("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "position")


WINDOWS = "sequence_id bigint, offset bigint, length bigint, ids binary, starts array<int>"


def windows(window: int):
    """Joins the pieces of consecutive rows into windows; a window that a stretch only begins or ends is a boundary record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        begun: list[int] = []
        where = stop = -1  # the window that is being filled, from and up to these places
        made: list[tuple] = []

        def close() -> None:
            if held:
                body = b"".join(held)
                made.append((where // window, where % window, len(body) // 4, body, [s - where // window * window for s in begun]))
                held.clear()
                begun.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * 5
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], names=["sequence_id", "offset", "length", "ids", "starts"])

        for batch in batches:
            for position, ids in zip(batch.column("position").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                at, end = position, position + len(ids) // 4
                if at != stop:
                    close()
                begun_here = True
                while at < end:
                    if not held:
                        where = at
                    if begun_here:
                        begun.append(at)
                        begun_here = False
                    to = min(end, (at // window + 1) * window)
                    held.append(ids[(at - position) * 4 : (to - position) * 4])
                    at = stop = to
                    if to % window == 0:
                        close()
                if len(made) >= 1000:
                    yield out()
            yield out()
        close()
        yield out()

    return run


def sequences(run: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequence_id, length, ids, starts``: the windows of ``encoded``, with the places in them where documents begin. The
    last one may be short; to be padded it needs ``window - length`` more ids."""
    spark = run.sparkSession
    made = staged(run.select("position", "ids").mapInArrow(windows(window), WINDOWS), shared_folder(spark), "windows")
    whole = made.filter(F.col("length") == window)
    # A window has at most as many boundary records as it has tokens, so a group is bounded by the window.
    ends = made.filter(F.col("length") < window).groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids", "starts"))).alias("p"))
    joined = ends.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.flatten(F.transform("p", lambda p: p["starts"])).alias("starts"))
    return whole.drop("offset").unionByName(joined)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    cut = pieces(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()))
    return cut.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "position")
