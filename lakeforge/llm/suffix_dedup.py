"""Removal of byte strings that an earlier document has, by hash-compared suffix sorting.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts in a document with a smaller id is removed.

Suffixes can only match where their first bytes do, so the suffixes to sort are brought together by content. Each window
of LENGTH bytes is owned by the smallest hash among its K-grams (its anchor, the leftmost of equal ones); equal windows
have equal anchors at equal places. Windows next to each other with one owner make a context.
    1.  Anchors are counted: each block of a task sends its distinct anchors, seven bytes each, to the bucket of their first
        bits. Those in several documents become bits of a filter; those with over ``many`` different contexts are listed.
    2.  Each block sends the contexts of kept anchors, with their bytes, to the same buckets. Of equal contexts in a block
        only those of its smallest id go; the others are covered by it. Contexts of listed anchors are split into their
        windows first, each under its own hash, so no anchor is one task's burden: what is left under a key is one text per
        block.
    3.  A bucket sorts. Contexts are sorted by hash and compared byte by byte, so each text stands once, with its smallest
        id; then the suffixes of different contexts under one anchor and place are merge-sorted. Two suffixes are compared
        by the hashes of their prefixes, whose longest common length is found by binary search. The bytes of all neighbours
        in the order that results are compared (collision verification): a group whose order the bytes do not bear out is
        sorted again by bytes. The smallest id of each run of equal suffixes decides for the others.
    4.  Documents with ranges to remove are joined with them and cut; the others are not shuffled.

Every removed byte lies in a string whose bytes were compared with those of a smaller id, whatever the size of the input.
The filter has at most 2 ** common.LARGE bits; with far more repeated anchors than that it lets other contexts through,
which costs shuffle but changes no result.

Defined results
    * A null text is empty. A null id counts as larger than all others; rows that share an id are one document and do
      not match each other. Texts shorter than LENGTH bytes lose nothing and match nothing. An empty table gives no rows.
    * Ids must be whole numbers. Whole texts are used; only id and text are read.
"""

from __future__ import annotations

import hashlib
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Bits, bit_filter, dropped, log_size, marked, mix, sent, shared_folder, slot, small_batches, staged, table, text_session

LENGTH, K = 50, 24
W = LENGTH - K + 1
PLACE = np.uint64((1 << 30) - 1)
#: Contexts that a task holds before it sends them, that a bucket is to receive, and that are sorted at once.
BLOCK, BUCKET, CHUNK = 200_000, 400_000, 10_000
#: An anchor with more different contexts than this, or than a hundred-thousandth of all, is split by its windows.
MANY = 20_000
LAST = 2**63 - 1


class Contexts:
    """The contexts of consecutive texts: where each starts and ends, its anchor, row, key of content, and so on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        up, self.down = common._powers.upto(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(common._BYTE_CODE[data] * up[:n], out=self.prefix[1:])
        if n < LENGTH:
            self.start = self.count = self.anchor = self.row = np.zeros(0, np.int64)
            self.gram = self.content = np.zeros(0, np.uint64)
            return
        gram = mix((self.prefix[K:] - self.prefix[:-K]) * self.down[: n - K + 1])
        low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        step = 1
        while 2 * step <= W:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: n - LENGTH + 1], low[W - step : W - step + n - LENGTH + 1])
        owner = (low & PLACE).astype(np.int64)
        inside = np.ones(len(owner), bool)
        for e in offsets[1:-1].tolist():  # windows across the end of a text
            inside[max(0, e - LENGTH + 1) : e] = False
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
        self.start = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1])
        self.count = np.flatnonzero(closes) + 1 - self.start
        self.anchor = owner[self.start]
        self.gram = mix(gram[self.anchor] ^ np.uint64(0x6A09E667F3BCC909))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        end = self.start + self.count - 1 + LENGTH
        shape = ((self.anchor - self.start) * 4096 + self.count).astype(np.uint64)
        self.content = mix((self.prefix[end] - self.prefix[self.start]) * self.down[self.start] + mix(shape))


def contexts_of(texts: pa.Array):
    """(first row, end row, contexts) for slices of a column."""
    whole, offsets = common.utf8(texts)
    for a, b in common.slices(offsets, 1 << 19):
        yield a, b, Contexts(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some pieces of ``data``, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each element starts a run of equal keys."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


# -- which anchors matter ---------------------------------------------------------------------------------------------
class Anchors:
    """What the first pass has found: a filter of the anchors of several documents, and the anchors to split, by the first
    bits of their hashes, all but ``shift``."""

    def __init__(self, several: Bits, split: np.ndarray, bucket_log: int):
        self.several, self.split, self.bucket_log = several, np.sort(split), bucket_log

    def kept(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors to be sorted whole, and of those to be split."""
        at = np.flatnonzero(self.several.has(gram))
        if not len(self.split):
            return at, at[:0]
        v = gram[at] >> np.uint64(32 - self.bucket_log)
        split = self.split[np.minimum(np.searchsorted(self.split, v), len(self.split) - 1)] == v
        return at[~split], at[split]


def count_anchors(docs: DataFrame, size: int) -> Anchors:
    """``size``: bytes of all texts. To the driver come 2 ** LARGE bits at most and 100,000 anchors at most."""
    expected = size // (W // 2) + 1
    bucket_log = min(16, max(8, (expected // BUCKET).bit_length()))
    inner, shift, many = max(3, log_size(size / 4) - bucket_log), np.uint64(32 - bucket_log), max(MANY, expected // 100_000)

    def emit(held: list[tuple[np.ndarray, ...]]):
        v, content, row = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((content, v))
        v, content, row = v[order], content[order], row[order]
        first = np.flatnonzero(_runs(v))
        texts = np.add.reduceat(_runs(v, content).astype(np.int64), first)
        several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first)
        v = v[first]
        bucket = (v >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        parts = [np.split(x, cuts) for x in (v.astype(np.uint32), np.minimum(texts, 65535).astype(np.uint16), several.astype(np.uint8))]
        return _batch([bucket[np.concatenate(([0], cuts))], *[pa.array([x.tobytes() for x in p], pa.binary()) for p in parts]], ["bucket", "v", "texts", "several"])

    def scan(batches):
        held, n, rows = [], 0, 0
        for batch in batches:
            for a, _, c in contexts_of(batch.column(0)):
                held.append((c.gram >> shift, c.content, (rows + a + c.row).astype(np.int32)))
                n += len(c.gram)
                if n >= 4 * BLOCK:
                    yield emit(held)
                    held, n = [], 0
            rows = (rows + batch.num_rows) % (1 << 30)
            common.release()
        if n:
            yield emit(held)
        del held
        common.release()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, texts, several = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("v", np.uint32), ("texts", np.uint16), ("several", np.uint8)))
        order = np.argsort(v)
        v, first = v[order], np.flatnonzero(_runs(v[order]))
        documents = np.add.reduceat(1 + several[order].astype(np.int64), first)
        total = np.add.reduceat(texts[order].astype(np.int64), first)
        slots = np.unique(v[first][documents > 1] >> np.uint32(32 - inner))
        bits = np.zeros((1 << inner) // 8, np.uint8)
        np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
        return pd.DataFrame({"bucket": [key[0]], "bits": [bits.tobytes()], "split": [v[first][total > many].tobytes()]})

    with small_batches(docs.sparkSession):
        found = docs.select("text").mapInArrow(scan, "bucket int, v binary, texts binary, several binary").groupBy("bucket").applyInPandas(merge, "bucket int, bits binary, split binary").toPandas()
    out, split = np.zeros((1 << bucket_log, (1 << inner) // 8), np.uint8), [np.zeros(0, np.uint64)]
    for bucket, bits, v in zip(found["bucket"], found["bits"], found["split"], strict=True):
        out[bucket] = np.frombuffer(bits, np.uint8)
        split.append((np.uint64(bucket) << np.uint64(32)) | np.frombuffer(v, np.uint32))
    return Anchors(Bits(inner + bucket_log, out.ravel()), np.concatenate(split), bucket_log)


# -- contexts on their way --------------------------------------------------------------------------------------------
class Pieces:
    """Contexts with their bytes. ``fields``: gram and content (hashes), doc, version, start, count (of windows) and place
    (of the anchor), an array each."""

    NAMES = ("gram", "content", "doc", "version", "start", "count", "place")
    KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint8, np.uint8)

    def __init__(self, fields: dict[str, np.ndarray], data: np.ndarray):
        self.fields, self.data = fields, data

    def __getitem__(self, name: str) -> np.ndarray:
        return self.fields[name]

    def __len__(self) -> int:
        return len(self.fields["gram"])

    @property
    def size(self) -> np.ndarray:
        return self["count"].astype(np.int64) - 1 + LENGTH

    def take(self, at: np.ndarray) -> Pieces:
        size = self.size
        return Pieces({n: x[at] for n, x in self.fields.items()}, gathered(self.data, (np.cumsum(size) - size)[at], size[at]))

    @classmethod
    def joined(cls, parts: list[Pieces]) -> Pieces:
        return cls({n: np.concatenate([p[n] for p in parts]) for n in cls.NAMES}, np.concatenate([p.data for p in parts]))

    def packed(self) -> bytes:
        return b"".join([np.int64(len(self)).tobytes(), *[self[n].astype(k).tobytes() for n, k in zip(self.NAMES, self.KINDS, strict=True)], self.data.tobytes()])

    @classmethod
    def unpacked(cls, buffer: bytes) -> Pieces:
        n, at, fields = int(np.frombuffer(buffer, np.int64, 1)[0]), 8, {}
        for name, kind in zip(cls.NAMES, cls.KINDS, strict=True):
            fields[name] = np.frombuffer(buffer, kind, n, at)
            at += fields[name].nbytes
        return cls(fields, np.frombuffer(buffer, np.uint8, -1, at))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """An order by gram, content and id, and where in it a new text starts. Contents are compared by their hashes and
        then by their bytes; where those differ in spite of equal hashes, the bytes sort."""
        order = np.lexsort((self["start"], self["version"], self["doc"], self["content"], self["gram"]))
        x, y = order[:-1], order[1:]
        same = np.append(False, (self["gram"][x] == self["gram"][y]) & (self["content"][x] == self["content"][y]))
        alike = same.copy()
        at = np.flatnonzero(same)
        size, begin = self.size, np.cumsum(self.size) - self.size
        shape = (self["count"][order[at]] == self["count"][order[at - 1]]) & (self["place"][order[at]] == self["place"][order[at - 1]])
        alike[at[~shape]] = False
        at = at[shape]
        for some in np.array_split(at, 1 + len(at) // 50_000):
            if len(some):
                n = size[order[some]]
                equal = gathered(self.data, begin[order[some]], n) == gathered(self.data, begin[order[some - 1]], n)
                alike[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        if (same & ~alike).any():
            group = np.cumsum(~same)
            for g in np.unique(group[same & ~alike]):
                at = np.flatnonzero(group == g)
                keys = [(int(self["count"][i]), int(self["place"][i]), self.data[begin[i] : begin[i] + size[i]].tobytes()) for i in order[at]]
                rank = sorted(range(len(at)), key=lambda k: (keys[k], int(self["doc"][order[at[k]]])))  # noqa: B023
                order[at] = order[at[rank]]
                alike[at] = [k > 0 and keys[rank[k]] == keys[rank[k - 1]] for k in range(len(at))]
        return order, ~alike


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


RANGE = {"doc": np.int64, "version": np.int32, "low": np.int64, "high": np.int64}


def merged(doc: np.ndarray, version: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Ranges of one row that overlap or touch as one range."""
    order = np.lexsort((low, version, doc))
    doc, version, low, high = (x[order] for x in (doc, version, low, high))
    opens = _runs(doc, version)
    if len(doc):
        row = np.cumsum(opens).astype(np.int64)
        wide = row << 32  # rows in a row of numbers of their own; a text has fewer than 2 ** 32 bytes
        end = np.maximum.accumulate(wide + high)
        opens[1:] |= wide[1:] + low[1:] > end[:-1]
        first = np.flatnonzero(opens)
        return [doc[first], version[first], low[first], np.maximum.reduceat(high, first)]
    return [doc, version, low, high]


def contexts_to_sort(docs: DataFrame, shared) -> DataFrame:
    """``bucket, payload``: packed contexts by bucket, and, with negative buckets, ranges that a block has settled."""

    def taken(c: Contexts, doc: np.ndarray, version: np.ndarray) -> list[Pieces]:
        whole, split = shared.value.kept(c.gram)
        out = []
        if len(whole):
            fields = [c.gram[whole], c.content[whole], doc[c.row[whole]], version[c.row[whole]], c.start[whole] - c.offsets[c.row[whole]], c.count[whole], c.anchor[whole] - c.start[whole]]
            out.append(Pieces(dict(zip(Pieces.NAMES, fields, strict=True)), gathered(c.data, c.start[whole], c.count[whole] - 1 + LENGTH)))
        if len(split):
            n = c.count[split]
            at = np.repeat(c.start[split] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row, one, none = np.repeat(c.row[split], n), np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
            window = mix((c.prefix[at + LENGTH] - c.prefix[at]) * c.down[at] + np.uint64(LENGTH))
            out.append(Pieces(dict(zip(Pieces.NAMES, [window, window, doc[row], version[row], at - c.offsets[row], one, none], strict=True)), gathered(c.data, at, none + LENGTH)))
        return out

    def emit(held: list[Pieces]):
        all_ = Pieces.joined(held)
        order, opens = all_.classes()
        first = np.flatnonzero(opens)
        least = np.minimum.reduceat(all_["doc"][order], first)[np.cumsum(opens) - 1]
        local = all_["doc"][order] > least
        some = order[local]
        begin = all_["start"][some].astype(np.int64)
        ranges = merged(all_["doc"][some], all_["version"][some], begin, begin + all_.size[some])
        log = shared.value.bucket_log
        left = order[~local]  # in the order of grams, and so of buckets
        bucket = (all_["gram"][left] >> np.uint64(64 - log)).astype(np.int32)
        names, payloads = [], []
        for at in np.split(np.arange(len(left)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(at):
                names.append(int(bucket[at[0]]))
                payloads.append(all_.take(left[at]).packed())
        own = -1 - (mix(ranges[0].view(np.uint64)) >> np.uint64(64 - log)).astype(np.int32)
        order = np.argsort(own, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(at):
                names.append(int(own[at[0]]))
                payloads.append(b"".join(x[at].astype(k).tobytes() for x, k in zip(ranges, RANGE.values(), strict=True)))
        return _batch([np.array(names, np.int32), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            doc, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for a, b, c in contexts_of(batch.column(0)):
                held += taken(c, doc[a:b], version[a:b])
                n += len(held[-1]) if held else 0
                if sum(map(len, held)) >= BLOCK:
                    yield emit(held)
                    held = []
            common.release()
        if held:
            yield emit(held)
        del held
        common.release()

    return docs.select("text", "doc", "version").mapInArrow(scan, "bucket int, payload binary")


# -- sorting ----------------------------------------------------------------------------------------------------------
class Suffixes:
    """Bytes with prefix hashes; suffixes are compared over their first LENGTH bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = common._powers.upto(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(common._BYTE_CODE[data] * up[: len(data)], out=self.prefix[1:])

    def hashed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.down[at]

    def common_length(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefix, up to LENGTH, by binary search on hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.hashed(x[open_], middle) == self.hashed(y[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1

    def below(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones as ``ties`` says."""
        n = self.common_length(x, y)
        at = np.minimum(n, LENGTH - 1)
        return np.where(n == LENGTH, ties, self.data[x + at] < self.data[y + at])

    def sort(self, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merge sort of the suffixes ``at`` inside groups; ``first`` and ``size`` are those of each element's group. The
        elements of all runs of one width find their ranks in the neighbouring runs together. Returns an order."""
        order, width = np.arange(len(at)), 1
        while True:
            here = np.flatnonzero(size > width)
            if not len(here):
                return order
            place = here - first[here]
            run = place // width
            low = first[here] + np.minimum((run ^ 1) * width, size[here])
            start, high = low.copy(), first[here] + np.minimum((run ^ 1) * width + width, size[here])
            right = (run & 1).astype(bool)  # an element of a right run comes after equal ones of the left
            own = at[order[here]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                before = self.below(at[order[middle]], own[open_], right[open_])
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            target = first[here] + (run // 2) * 2 * width + place % width + (low - start)
            merged = order.copy()
            merged[target] = order[here]
            order, width = merged, 2 * width

    def settled(self, at: np.ndarray, group: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the suffixes ``at`` inside groups in which equal ones are neighbours, and whether each is equal to the
        one before. The bytes of all neighbours are compared; a group whose order they contradict is sorted by bytes, and so
        is one for which merging, misled by equal hashes, gave no order at all."""
        order = self.sort(at, first, size)
        inside = np.append(False, group[1:] == group[:-1])
        equal, step = inside.copy(), np.arange(LENGTH)
        wrong = set(group[np.bincount(order, minlength=len(at)) != 1].tolist())
        some = np.flatnonzero(inside)
        for part in np.array_split(some, 1 + len(some) // 50_000):
            if len(part):
                x, y = self.data[at[order[part - 1]][:, None] + step], self.data[at[order[part]][:, None] + step]
                apart = x != y
                where = apart.argmax(1)
                differ = apart[np.arange(len(part)), where]
                equal[part] = ~differ
                row = np.arange(len(part))[differ]
                wrong.update(group[part[differ][x[row, where[differ]] > y[row, where[differ]]]].tolist())
        for g in sorted(wrong):
            here = np.flatnonzero(group == g)
            texts = {i: self.data[at[i] : at[i] + LENGTH].tobytes() for i in here.tolist()}
            order[here] = sorted(texts, key=texts.__getitem__)
            equal[here] = np.append(False, [texts[i] == texts[j] for i, j in zip(order[here][1:].tolist(), order[here][:-1].tolist(), strict=True)])
        return order, equal


def settle(pieces: Pieces) -> list[np.ndarray]:
    """Ranges to remove, from all contexts of some anchors."""
    order, opens = pieces.classes()
    pieces = pieces.take(order)
    which, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
    doc, start = pieces["doc"], pieces["start"].astype(np.int64)
    least = np.minimum.reduceat(doc, first)
    covered = np.flatnonzero(doc > least[which])
    out = [(doc[covered], pieces["version"][covered], start[covered], start[covered] + pieces.size[covered])]
    # one row for each text; those alone under their anchor match nothing else
    gram = pieces["gram"][first]
    alone = _runs(gram) & np.append(_runs(gram)[1:], True)
    texts = np.flatnonzero(~alone)
    if len(texts):
        rows = pieces.take(first[texts])
        count = rows["count"].astype(np.int64)
        base = np.cumsum(rows.size) - rows.size
        text = np.repeat(np.arange(len(texts)), count)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        place = rows["place"].astype(np.int64)[text] - inner
        by = np.lexsort((place, rows["gram"][text]))
        text, inner, place = text[by], inner[by], place[by]
        opens = _runs(rows["gram"][text], place)
        group, firsts = np.cumsum(opens) - 1, np.flatnonzero(opens)
        size = np.diff(np.append(firsts, len(text)))
        by, equal = Suffixes(rows.data).settled(base[text] + inner, group, firsts[group], size[group])
        text, inner = text[by], inner[by]
        smallest = least[texts][text]
        runs = np.flatnonzero(~equal)
        hit = np.flatnonzero(smallest > np.minimum.reduceat(smallest, runs)[np.cumsum(~equal) - 1])
        # every place where the smallest id of a text has it
        own = np.flatnonzero(doc == least[which])
        lo, hi = np.searchsorted(which[own], texts[text[hit]]), np.searchsorted(which[own], texts[text[hit]], "right")
        n = hi - lo
        at = own[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        low = start[at] + np.repeat(inner[hit], n)
        out.append((doc[at], pieces["version"][at], low, low + LENGTH))
    return merged(*[np.concatenate(x) for x in zip(*out, strict=True)])


def sorted_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    """``doc, version, low, high`` from one bucket, whole anchors at a time."""
    payloads = [x.as_py() for x in rows.column("payload")]
    if key[0].as_py() < 0:
        found = []
        for p in payloads:
            n, at, one = len(p) // sum(np.dtype(k).itemsize for k in RANGE.values()), 0, []
            for k in RANGE.values():
                one.append(np.frombuffer(p, k, n, at))
                at += one[-1].nbytes
            found.append(one)
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
    else:
        pieces = Pieces.joined([Pieces.unpacked(p) for p in payloads])
        del payloads
        order = np.argsort(pieces["gram"], kind="stable")
        begins = np.flatnonzero(_runs(pieces["gram"][order]))
        found, a = [], 0
        while a < len(order):
            b = begins[min(np.searchsorted(begins, a + CHUNK), len(begins) - 1)]
            b = int(b) if b > a and b >= a + CHUNK else len(order)
            found.append(settle(pieces.take(order[a:b])))
            a = b
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
    common.release()
    return pa.table([pa.array(x.astype(k)) for x, k in zip(out, RANGE.values(), strict=True)], names=list(RANGE))


def removed(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed and maximal runs removed."""
    kept, end, gone, spans = [], 0, 0, 0
    for low, high in sorted(ranges):
        if low > end or not spans:
            kept.append(text[end:low])
            spans += 1
            gone += high - low
            end = high
        elif high > end:
            gone += high - end
            end = high
    return b"".join([*kept, text[end:]]), gone, spans


def cutter():
    def cut(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        whole, offsets = common.utf8(texts)
        out = []
        for i, (x, y) in enumerate(zip(low.to_pylist(), high.to_pylist(), strict=True)):
            out.append(removed(whole[offsets[i] : offsets[i + 1]].tobytes(), list(zip(x or (), y or (), strict=True))))
        kept, gone, spans = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())], ["kept", "n_removed", "n_spans"])

    return cut


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept (binary)`` for every row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"), text.alias("text"))
    rows = rows.withColumn("version", (F.crc32(F.col("text").cast("binary")) - 2147483648).cast("int"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    with ExitStack() as held:
        anchors = sent(spark, count_anchors(rows, size), held)
        with small_batches(spark):
            found = contexts_to_sort(rows, anchors).groupBy("bucket").applyInArrow(sorted_bucket, "doc bigint, version int, low bigint, high bigint")
            lists = found.groupBy("doc", "version").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
            lists = staged(lists, folder, "ranges")
    shared = spark.sparkContext.broadcast(bit_filter(lists.select("doc", "version")))
    may = common.per_batch("boolean", lambda: lambda slots: marked(shared.value, slots))
    cut = common.per_batch("struct<kept:binary,n_removed:bigint,n_spans:bigint>", cutter, 3)
    flagged = rows.withColumn("may", may(slot("doc", "version")))
    none = F.lit(0).cast("bigint")
    plain = flagged.filter("not may").select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    met = flagged.filter("may").drop("may").join(lists.hint("merge"), ["doc", "version"], "left")
    met = met.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), cut("text", "low", "high").alias("c")).select("id", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
    return plain.unionByName(met).withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same for a few small texts, by looking every string up; for tests."""
    first: dict[bytes, int] = {}
    keyed = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in keyed:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, t), (shown, _) in zip(keyed, rows, strict=True):
        hits = [(p, p + length) for p in range(len(t) - length + 1) if first[t[p : p + length]] < i]
        kept, gone, spans = removed(t, hits)
        out.append((shown, len(t), gone, spans, hashlib.sha256(kept).hexdigest()))
    return out


SQL = """
WITH doc AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
    SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM doc)
), hit AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM strings) WHERE doc_id > least
), jump AS (
    SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS opens FROM hit
), span AS (
    SELECT doc_id, n, min(p) AS low, max(p) + 50 AS high FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM jump) GROUP BY doc_id, n
), piece AS (
    SELECT doc_id, n, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS a, low AS b, high FROM span
), total AS (
    SELECT doc_id, sum(high - b) AS n_removed, count(*) AS n_spans, max(high) AS last,
           string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY n) AS kept
    FROM piece JOIN doc USING (doc_id) GROUP BY doc_id
)
SELECT doc.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE concat(kept, substr(h, CAST(2 * last + 1 AS BIGINT))) END)) AS kept_sha256
FROM doc LEFT JOIN total USING (doc_id)
"""
