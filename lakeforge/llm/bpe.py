"""Byte-pair encoding and decoding with a public tokenizer file, by prefix-sharing trie traversal.

A merge list gives every prefix of a word exactly one last token: a token that ends there, whose two-token sequence
with the last token before it is left alone by the merges. So the encoding of a word follows from the last tokens of
its prefixes. The distinct new words of a batch are walked as a trie, depth first, which computes the last token of each
node once for all words that share the prefix; words are kept in a bounded table for later batches of the same task.

The work is one pass over the documents without any shuffle; the tokenizer file is opened where it is used, in each
Python worker, by its path (a parameter; it is part of the installed environment, not of this repository).

Defined results
    * A null text is the empty text, which has no tokens and decodes to the empty string.
    * The strings of special tokens inside a text become those tokens, as the tokenizers library has it.
    * Whole texts of any length are encoded; a word of n bytes takes time and memory in proportion to n.
    * An empty table gives an empty result; there is no order in which ties could matter.
    * Columns ``ids`` and ``decoded`` are added or replaced; all others, rows that repeat included, stay as they are.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import table, text_session

#: Distinct words whose encodings a task keeps (beyond that, only those met more than once), and bytes of text that it cuts
#: into words at once.
KEPT_WORDS, SLICE = 250_000, 1 << 21


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Tokenizer of a file with white space dropped, lower case, and merges that know the end of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()}
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        (pattern,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.letters = byte_letters()
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.starts = {t[:n] for known in (self.inner, self.final) for t in known for n in range(1, len(t) + 1)}
        self.steps: dict[str, tuple[str, tuple, tuple]] = {}
        self.agrees: dict[tuple[int, int], bool] = {}

    # -- merges -------------------------------------------------------------------------------------------------
    def symbols(self, token: int) -> list[str]:
        text = self.text[token]
        if text.endswith(self.end):
            text = text[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(text)

    def merged(self, parts: list[str]) -> list[str]:
        """The merges applied one by one, the best ranked first; only used on pairs of tokens."""
        rank_of = self.ranks.get
        ranks = [rank_of(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == _NONE:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), _NONE)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), _NONE)
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether the merges leave ``before, token`` as they are (``before`` -1: ``token`` alone)."""
        known = self.agrees.get((before, token))
        if known is None:
            if len(self.agrees) > 400_000:
                self.agrees.clear()
            parts = (self.symbols(before) if before >= 0 else []) + self.symbols(token)
            wanted = ([self.text[before]] if before >= 0 else []) + [self.text[token]]
            known = self.agrees[before, token] = self.merged(parts) == wanted
        return known

    def step(self, text: str) -> tuple[str, tuple, tuple]:
        """For the end of a prefix: its longest part that starts some token, and the tokens that end there, as (length,
        id), the longest first, inside a word and at its end."""
        known = self.steps.get(text)
        if known is None:
            if len(self.steps) > 200_000:
                self.steps.clear()
            part = text
            while part and part not in self.starts:
                part = part[1:]
            ends = [part[i:] for i in range(len(part))]
            known = self.steps[text] = part, *(tuple((len(x), vocab[x]) for x in ends if x in vocab) for vocab in (self.inner, self.final))
        return known

    def encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of words given in byte letters, by one depth-first walk over their trie.

        Words in order are the leaves of the trie from left to right. The path to the word before is kept, with the state
        of each node on it (the last token of that prefix, where it starts, and what of it can still begin a token); a word
        goes on from the deepest node that both share. A letter that the vocabulary lacks has no token."""
        out: dict[str, tuple[int, ...]] = {}
        agrees, follows, steps = self.agrees.get, self.follows, self.steps
        last, start, parts, before = [-1], [0], [""], ""
        for word in sorted(words):
            shared, most, size = 0, min(len(last) - 1, len(before), len(word) - 1), len(word)
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], start[shared + 1 :], parts[shared + 1 :]
            part = parts[shared]
            for depth in range(shared + 1, size + 1):
                text = part + word[depth - 1]
                part, inner, final = steps.get(text) or self.step(text)
                token, at = -2, depth
                for length, candidate in inner if depth < size else final:
                    at = depth - length
                    previous = last[at]
                    if previous >= 0 or at == 0:
                        known = agrees((previous, candidate))
                        if known or known is None and follows(previous, candidate):
                            token = candidate
                            break
                if depth < size:
                    last.append(token)
                    start.append(at if token >= 0 else depth)
                    parts.append(part)
            ids = []
            while token >= 0:
                ids.append(token)
                token, at = last[at], start[at]
            out[word] = tuple(reversed(ids)) if ids and token == -1 else tuple(self.plain(word))
            before = word
        return out

    def plain(self, word: str) -> list[int]:
        """Merges applied to the whole word, without letters that the vocabulary lacks."""
        known = [x for x in [*word[:-1], word[-1] + self.end] if x in self.vocab]
        return [self.vocab[x] for x in self.merged(known)]

    # -- words of a text ----------------------------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """Words and special tokens in the order of the text, normalised. Special tokens are sought in the text as it is."""
        if self.cut_special and any(t in text for t in self.special):
            parts = self.cut_special.split(text)
            return [w for part in parts for w in ((part,) if part in self.special else self.split(part))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def spelled(self, word: str) -> str:
        """A word in byte letters."""
        return word if _PRINTABLE(word) else "".join(map(self.letters.__getitem__, word.encode()))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_NONE = 1 << 60
_PRINTABLE = regex.compile("[!-~]+").fullmatch


class WordTable:
    """Encodings of the words met so far, ids in one flat array."""

    def __init__(self, path: str):
        self.encoder = WordEncoder(path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends, self.decoded = array("i"), array("q", [0]), []
        self.used = np.zeros(0, np.int64)

    def thin(self) -> None:
        """Forget the words met only once; all, if that leaves too many."""
        often = np.flatnonzero(self.used > 1).tolist()
        if len(often) > KEPT_WORDS // 2:
            return self.clear()
        words, flat, ends, decoded = list(self.number), self.flat, self.ends, self.decoded  # words stand in the order of their numbers
        self.clear()
        for i in often:
            self.number[words[i]] = len(self.decoded)
            self.flat.extend(flat[ends[i] : ends[i + 1]])
            self.ends.append(len(self.flat))
            self.decoded.append(decoded[i])
        self.used = np.ones(len(often), np.int64)

    def learn(self, words: set[str]) -> None:
        special, text = self.encoder.special, self.encoder.text
        spelled = {w: self.encoder.spelled(w) for w in words if w not in special}
        ids = self.encoder.encode_words(set(spelled.values()))
        for word in words:
            own = ids[spelled[word]] if word in spelled else (special[word],)
            self.number[word] = len(self.decoded)
            self.flat.extend(own)
            self.ends.append(len(self.flat))
            self.decoded.append(" ".join(map(text.__getitem__, own)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, where each text's begin (length texts + 1), and the decoded texts."""
        words = list(map(self.encoder.split, texts))
        known = [list(map(self.number.get, own)) for own in words]
        new = {w for own, at in zip(words, known, strict=True) if None in at for w, i in zip(own, at, strict=True) if i is None}
        if new:
            if len(self.number) + len(new) > KEPT_WORDS:
                self.thin()
                new = {w for own in words for w in own if w not in self.number}
            self.learn(new)
            known = [list(map(self.number.__getitem__, own)) for own in words]
        counts = np.zeros(len(texts) + 1, np.int64)
        counts[1:] = [len(own) for own in known]
        decoded = [" ".join(filter(None, map(self.decoded.__getitem__, own))) for own in known]
        at = np.concatenate([np.array(own, np.int64) for own in known]) if known else np.zeros(0, np.int64)
        met = np.bincount(at, minlength=len(self.decoded))
        met[: len(self.used)] += self.used
        self.used = met
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        lengths = ends[at + 1] - ends[at]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(ends[at] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        return ids, offsets[np.cumsum(counts)], decoded


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_column(text: Column, path: str) -> Column:
    """struct(ids, decoded) of a text column."""

    def make():
        words = WordTable(path)  # lives as long as the task

        def run(texts: pa.Array) -> pa.Array:
            ids, decoded, counts, before = [], [], [np.zeros(1, np.int64)], 0
            _, offsets = common.utf8(texts)
            for a, b in common.slices(offsets, SLICE):
                own, ends, plain = words.encode([t or "" for t in texts[a:b].to_pylist()])
                ids.append(own)
                decoded.append(pa.array(plain, pa.string()))
                counts.append(ends[1:] + before)
                before += len(own)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(counts).astype(np.int32)), pa.array(np.concatenate(ids or [np.zeros(0, np.int32)]), pa.int32()))
            return pa.StructArray.from_arrays([lists, pa.concat_arrays(decoded) if decoded else pa.array([], pa.string())], ["ids", "decoded"])

        return run

    return common.per_batch(ENCODED, make)(F.coalesce(text, F.lit("")))


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded``."""
    own = "__bpe"
    return docs.withColumn(own, encode_column(F.col(text_col), path)).withColumns({"ids": F.col(f"{own}.ids"), "decoded": F.col(f"{own}.decoded")}).drop(own)


def decode_column(ids: Column, path: str) -> Column:
    """Text of a column of id lists; null for null, and unknown ids are left out."""

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        text = encoder(path).text
        return pa.array([None if x is None else " ".join(text[i] for i in x if i in text) for x in lists.to_pylist()], pa.string())

    return run(ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, default_path()).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
