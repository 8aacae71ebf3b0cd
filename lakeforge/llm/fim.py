"""Fill-in-the-middle: a text is cut at two unit boundaries, and its three parts change places behind sentinels.

The byte offsets at which the units of a text begin form a set in the manner of compressed bitmaps: stretches of 65,536
offsets are containers, each of the kind that takes least room (a sorted array, a bitmap, or runs), and the number of
offsets before each container is kept. The k-th boundary is found by a binary search for its container and a select
inside it, so both cuts are byte offsets and the parts are sliced without counting characters again. Lines are arrays,
plain ASCII characters are runs, characters of mixed scripts are bitmaps.

One pass over the documents, nothing is shuffled. Texts go to Python once and two offsets come back; the parts are cut
and joined by built-in functions.

Defined results
    * A null text is the empty text. A text that is empty or holds a sentinel is ``plain``: the text itself.
    * A null id draws as the empty id. Rows that repeat an id are cut by the same draws, each over its own text.
    * Whole texts of any length are cut. A text may be all prefix, all middle or all suffix; parts may be empty.
    * An empty table gives an empty result. Columns added replace columns of the same names; all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table, text_session

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Out of a hundred: texts that are changed, and changed ones whose suffix comes first.
CHANGED, SUFFIX_FIRST = 90, 20
CONTAINER, ARRAY_MOST = 1 << 16, 4096


class BoundarySet:
    """A sorted set of offsets in containers, made of a mask over all offsets."""

    def __init__(self, mask: np.ndarray):
        self.before, self.containers = [0], []
        for at in range(0, len(mask), CONTAINER):
            kind, parts, size = container(mask[at : at + CONTAINER])
            self.containers.append((at, kind, parts))
            self.before.append(self.before[-1] + size)
        self.before = np.array(self.before)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        c = int(np.searchsorted(self.before, k, "right")) - 1
        at, kind, parts = self.containers[c]
        return at + LOCAL[kind](parts, k - int(self.before[c]))


def container(mask: np.ndarray) -> tuple[str, tuple, int]:
    """Kind, content and number of members of a stretch, in the kind that is smallest in bytes."""
    size = int(np.count_nonzero(mask))
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    first, stop = edges[0::2], edges[1::2]
    if 4 * len(first) <= min(2 * size, CONTAINER // 8):
        return "run", (first.astype(np.uint16), np.concatenate(([0], np.cumsum(stop - first)))), size
    if size <= ARRAY_MOST:
        return "array", (np.flatnonzero(mask).astype(np.uint16),), size
    bits = np.packbits(mask, bitorder="little")
    words = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
    words[: len(bits)] = bits
    words = words.view("<u8")
    return "bitmap", (words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))), size


def in_run(parts: tuple, k: int) -> int:
    first, before = parts
    r = int(np.searchsorted(before, k, "right")) - 1
    return int(first[r]) + k - int(before[r])


def in_bitmap(parts: tuple, k: int) -> int:
    words, before = parts
    w = int(np.searchsorted(before, k, "right")) - 1
    word = int(words[w])
    for _ in range(k - int(before[w])):
        word &= word - 1  # without its lowest member
    return 64 * w + (word & -word).bit_length() - 1


LOCAL = {"run": in_run, "array": lambda parts, k: int(parts[0][k]), "bitmap": in_bitmap}


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Mask over the bytes of a text and its end: where a unit begins, and the end."""
    mask = np.ones(len(data) + 1, bool)
    if unit == "char":
        mask[:-1] = (data & 0xC0) != 0x80
    elif unit == "line":
        mask[1:-1] = data[:-1] == 10
    elif unit == "word":  # the white space before a word belongs to the unit before
        space = _SPACE[data]
        mask[1:-1] = space[:-1] & ~space[1:]
    else:
        raise ValueError(f"unknown unit {unit}")
    return mask


_SPACE = common.byte_class(lambda b: b in b" \t\n\r\x0b\x0c")
CUT = "struct<units:bigint,first:bigint,last:bigint,prefix_chars:bigint,middle_chars:bigint>"


def cutter(unit: str):
    """For texts and two draws each: units, byte offsets of both cuts, and characters of prefix and middle."""

    def one(data: np.ndarray, h1: int, h2: int) -> tuple[int, ...]:
        found = BoundarySet(unit_starts(data, unit))
        n = len(found) - 1
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        first, last = found.select(a), found.select(b)
        if unit != "char":
            a, b = (int(np.count_nonzero((data[:x] & 0xC0) != 0x80)) for x in (first, last))
        return n, first, last, a, b - a

    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        data, offsets = common.utf8(texts)
        draws = zip(h1.to_numpy(zero_copy_only=False).tolist(), h2.to_numpy(zero_copy_only=False).tolist(), strict=True)
        cuts = [one(data[offsets[i] : offsets[i + 1]], *draw) for i, draw in enumerate(draws)]
        columns = np.array(cuts, np.int64).reshape(len(cuts), 5).T
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["units", "first", "last", "prefix_chars", "middle_chars"])

    return run


def draw(id_col: str, seed: int, k: int) -> Column:
    """The k-th group of 8 digits of the hash of seed and id, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1) -> DataFrame:
    """Add ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), "__cut"
    raw = text.cast("binary")
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | holds | (draw(id_col, seed, 3) % 100 >= CHANGED), "plain").when(draw(id_col, seed, 4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = common.per_batch(CUT, lambda: cutter(unit), 3)(text, draw(id_col, seed, 1), draw(id_col, seed, 2))
    with_cuts = docs.withColumns({own: cut, f"{own}_form": form})
    first, last = F.col(f"{own}.first").cast("int"), F.col(f"{own}.last").cast("int")
    prefix, middle, suffix = (b.cast("string") for b in (raw.substr(F.lit(1), first), raw.substr(first + 1, last - first), raw.substr(last + 1, F.octet_length(raw) - last)))
    kind, changed = F.col(f"{own}_form"), F.col(f"{own}_form") != "plain"
    output = F.when(kind == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(kind == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    counts = {c: F.when(changed, F.col(f"{own}.{c}")) for c in ("prefix_chars", "middle_chars")}
    return with_cuts.withColumns({"n": F.col(f"{own}.units"), "form": kind, **counts, "output": output}).drop(own, f"{own}_form")


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone. A sentinel cannot begin inside another, so the first of each kind is the one
    that was put there."""
    before, after = lambda c, s: F.substring_index(c, s, 1), lambda c, s: F.substring_index(c, s, -1)
    middle, rest = after(output, MIDDLE), before(output, MIDDLE)
    psm = F.concat(after(before(rest, SUFFIX), PREFIX), middle, after(rest, SUFFIX))
    spm = F.concat(after(rest, PREFIX), middle, after(before(rest, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, t, n,
         CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
  FROM drawn
), cut AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
