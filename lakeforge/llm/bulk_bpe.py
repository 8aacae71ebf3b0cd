"""Byte-pair merges for many words at once.

The symbols of all words of about one length stand in the rows of a matrix, beside the ranks of their neighbouring pairs.
A step merges in each row the pair of lowest rank, the leftmost of several, and looks up the two pairs that this makes;
a row leaves when no pair of it has a rank. So each word takes the merges in the order in which they apply to it alone.
Ranks are found in small tables without collisions, by the pair's two ids.
"""

from __future__ import annotations

import json

import numpy as np

from .bpe import byte_letters

NONE = np.int32(2**31 - 1)
#: Rows of a matrix.
ROWS = 1 << 15
#: Lengths up to which words stand in one matrix.
CLASSES = (1, 4, 6, 8, 10, 13, 18, 32, 1 << 40)


class PairTable:
    """From pairs of ids to their ranks: hash tables, each with the pairs that collided in those before it."""

    def __init__(self, pairs: np.ndarray, log: int = 19):
        self.log, self.levels, ranks = log, [], np.arange(len(pairs), dtype=np.int32)
        keys = self.key(pairs[:, 0], pairs[:, 1])
        while len(keys):
            odd = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * len(self.levels) & 0xFFFFFFFFFFFFFFFF | 1)
            slot = self.slot(keys, odd)
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << log, np.uint64(2**64 - 1)), np.full(1 << log, NONE)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((odd, held, rank))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks = keys[left], ranks[left]

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def slot(self, keys: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((keys * odd) >> np.uint64(64 - self.log)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; ids below 0 are in no pair."""
        keys, out, left = self.key(a.ravel(), b.ravel()), None, None
        for odd, held, rank in self.levels:
            slot = self.slot(keys if left is None else keys[left], odd)
            there = held[slot]
            if left is None:
                same = there == keys
                out = np.where(same, rank[slot], NONE)
                left = np.flatnonzero(~same & (rank[slot] != NONE))  # only these can be in a later table
            else:
                same = there == keys[left]
                out[left[same]] = rank[slot[same]]
                left = left[~same & (rank[slot] != NONE)]
            if not len(left):
                break
        return out.reshape(a.shape)


class BulkEncoder:
    """Merges of a tokenizer file with byte letters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        model = self.spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab.get(x, -1) for x in letters], np.int32)
        self.final = np.array([vocab.get(x + end, -1) for x in letters], np.int32)
        self.pairs = PairTable(np.array([(vocab[a], vocab[b]) for a, b in model["merges"]], np.int64).reshape(-1, 2))
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has. ``data`` holds the words' bytes without gaps; none is empty."""
        stops = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[stops - 1] = self.final[data[stops - 1]]
        if (symbols < 0).any():  # letters that the vocabulary lacks have no token
            known = symbols >= 0
            sums = np.concatenate(([0], np.cumsum(known)))
            lengths = sums[stops] - sums[stops - lengths]
            symbols = symbols[known]
            stops = np.cumsum(lengths)
        counts, parts, low = np.zeros(len(lengths), np.int64), [], 0
        for high in CLASSES:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                width = int(lengths[some].max())
                there = np.arange(width) < lengths[some, None]
                matrix = np.full(there.shape, -1, np.int32)
                matrix[there] = symbols[((stops - lengths)[some, None] + np.arange(width))[there]]
                matrix = self.merged(matrix)
                there = matrix >= 0
                counts[some] = there.sum(1)
                parts.append((some, matrix[there]))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(offsets[-1], np.int32)
        for some, ids in parts:
            before = np.concatenate(([0], np.cumsum(counts[some])))
            out[np.repeat(offsets[some] - before[:-1], counts[some]) + np.arange(len(ids))] = ids
        return out, counts

    def merged(self, now: np.ndarray) -> np.ndarray:
        """Rows of symbols (then -1) with all merges applied, each row's in its own order."""
        out, live = now.copy(), np.arange(len(now))
        ranks = self.pairs.ranks(now[:, :-1], now[:, 1:])
        while ranks.shape[1] and len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            going = best != NONE
            if not going.all():
                rest = ~going
                out[live[rest], : now.shape[1]] = now[rest]
                out[live[rest], now.shape[1] :] = -1
                now, ranks, at, best, live = now[going], ranks[going], at[going], best[going], live[going]
                if not len(live):
                    return out
            row, places = np.arange(len(at)), np.arange(now.shape[1] - 1)
            now = np.take_along_axis(now, places + (places > at[:, None]), 1)
            now[row, at] = self.made[best]
            places = places[:-1]
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), 1)
            for side in (at - 1, at):  # the pairs that the new symbol is in
                inside = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[inside, side[inside]] = self.pairs.ranks(now[inside, side[inside]], now[inside, side[inside] + 1])
        out[live, : now.shape[1]] = now
        out[live, now.shape[1] :] = -1
        return out
