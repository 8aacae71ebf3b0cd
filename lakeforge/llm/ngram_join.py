"""Set-similarity join of documents on word n-grams, with adaptive multi-match prefixes.

A document is its set of distinct n-word shingles (64-bit hashes). With the shingles of every document in one global
order, two sets that are similar enough share at least L tokens in their L-prefixes, the first
``size - ceil(t * size) + L`` tokens. The order puts frequent shingles last; each document picks the L for which the
estimated cost (index rows, plus candidates thinned by the matches required) is least, and a pair is compared only if it
shares as many prefix tokens as the smaller L of the two asks for. Where a shared token stands in both orders bounds what
can follow it, so a pair counts at a token only if the rest of both sets could still bring the overlap that is needed.

The result is exact, and no group is ever expanded into all its pairs:
    1.  Documents with the same set are one class, found by a digest of 128 bits.
    2.  In every prefix token's group each member is proposed together with one hub, the one with fewest rarer shingles
        (of near copies, that nearest to their original): a number of pairs linear in the group. Proposed pairs that share
        the prefix tokens asked for are compared.
    3.  Pairs that still lie in different components meet at their shared prefix tokens, the smaller set of a pair being
        sought by its shorter index prefix. A pair becomes a row only if parity sketches of both sets (``SKETCH`` words of
        64 bits; bits that differ never outnumber shingles that differ) leave room for the overlap that is needed; then
        its shared prefix tokens are counted, and enough of them have it compared.

Frequencies are counted over all documents: each block of a task sends its sorted shingle hashes, four bytes each, to the
bucket of their first bits; the number of buckets follows the input. A bucket gives a bit for every shingle that stands in
several documents, and the counts of its most frequent ones (at most ``ORDERED`` in all are broadcast). A shingle without
a bit stands in one document only: it comes first in the order and is never sent. So documents that are mostly their own
words send nothing at all. The bits are at most 2 ** common.LARGE; with far more repeated shingles than that the filter
lets more rows through, and the exact counts behind it do the rest.

Defined results
    * Null or empty texts and texts without words have no shingle and no links; fewer than n words are one shingle.
    * Rows that repeat an id are one node; a row whose id is null has a null component and takes no part in links.
    * Empty input gives an empty result; columns other than id and text are not read.
    * Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Bits, bit_filter, dropped, log_size, marked, sent, shared_folder, slot, small_batches, staged, table, text_session
from .components import smallest_reachable

#: Most shingles whose frequency is broadcast (9 bytes each).
ORDERED = 1 << 18
#: Shingle hashes that a task sends at once, and that a bucket is to receive at most.
BLOCK, BUCKET = 1 << 21, 1 << 22
#: Words of 64 bits in a document's parity sketch.
SKETCH = 8
#: Largest L, and the cost of comparing a pair in units of an index row.
MOST_MATCHES, COMPARE = 4, 8.0
IS_WORD = common.byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def shingle_sets(texts: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text."""
    whole, offsets = common.utf8(texts)
    for a, b in common.slices(offsets, 1 << 20):
        data = common.lowered(whole[offsets[a] : offsets[b]])
        starts, stops, first = common.word_bounds(data, offsets[a : b + 1] - offsets[a], IS_WORD)
        words = common.word_hashes(data, starts, stops)
        runs = common.run_hashes(words, n)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= n:
                yield np.unique(runs[lo : hi - n + 1])
            elif hi > lo:
                yield common.run_hashes(words[lo:hi], hi - lo)
            else:
                yield runs[:0]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    salts = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
    return tuple(int(common.mix(tokens ^ np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) if len(tokens) else 0 for x in salts)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * SKETCH classes of shingles: whether the set has an odd number of them."""
    odd = np.bincount((tokens >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


FACTS = "doc bigint, size bigint, digest bigint, digest_2 bigint" + "".join(f", sketch_{i} bigint" for i in range(SKETCH))


def facts(docs: DataFrame, n: int) -> DataFrame:
    """``doc, size``, digest and sketch of every row."""

    def run(batches):
        for batch in batches:
            got = np.array([(len(tokens), *digest(tokens), *sketch(tokens)) for tokens in shingle_sets(batch.column(1), n)], np.int64).reshape(batch.num_rows, 3 + SKETCH)
            yield _batch([batch.column(0), *np.ascontiguousarray(got.T)], [x.split()[0] for x in FACTS.split(", ")])
            common.release()

    return docs.mapInArrow(run, FACTS)


class Frequencies:
    """Which shingles stand in several documents, and how many documents have the most frequent ones (by the first bits of
    their hash, all but ``shift``)."""

    def __init__(self, several: Bits, values: np.ndarray, counts: np.ndarray, shift: int):
        order = np.argsort(values)
        self.several, self.values, self.counts, self.shift = several, values[order], counts[order], np.uint64(shift)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """1 for a shingle of one document; 2 or the count for others."""
        often = np.where(self.several.has(tokens), 2, 1)
        if len(self.values):
            v = tokens >> self.shift
            at = np.minimum(np.searchsorted(self.values, v), len(self.values) - 1)
            often = np.where((often > 1) & (self.values[at] == v), self.counts[at], often)
        return often


def frequencies(docs: DataFrame, n: int, total: int) -> Frequencies:
    """Counted over all documents, ``total`` shingles; what comes to the driver has a fixed bound."""
    log, bucket_log = log_size(total), min(16, max(8, (total // BUCKET).bit_length()))
    inner, most, shift = max(3, log - bucket_log), ORDERED >> bucket_log, 32 - bucket_log
    log = inner + bucket_log

    def emit(held: list[np.ndarray]):
        v = np.sort(np.concatenate(held) >> np.uint64(shift))
        bucket = (v >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        parts = np.split(v.astype(np.uint32), cuts)
        return _batch([bucket[np.concatenate(([0], cuts))], pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "hashes"])

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for tokens in shingle_sets(batch.column(1), n):
                if len(tokens):
                    held.append(tokens)
                    size += len(tokens)
                    if size >= BLOCK:
                        yield emit(held)
                        held, size = [], 0
                        common.release()
        if size:
            yield emit(held)
        del held
        common.release()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]]), return_counts=True)
        slots = np.unique(v[counts > 1] >> np.uint32(32 - inner))
        bits = np.zeros((1 << inner) // 8, np.uint8)
        np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
        top = np.flatnonzero(counts > 2)
        top = top[np.lexsort((v[top], -counts[top]))[:most]]
        return pd.DataFrame({"bucket": [key[0]], "bits": [bits.tobytes()], "v": [v[top].tobytes()], "n": [counts[top].astype(np.int64).tobytes()]})

    with small_batches(docs.sparkSession):
        found = docs.mapInArrow(scan, "bucket int, hashes binary").groupBy("bucket").applyInPandas(merge, "bucket int, bits binary, v binary, n binary").toPandas()
    data = np.zeros((1 << bucket_log, (1 << inner) // 8), np.uint8)
    values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for bucket, bits, v, k in zip(found["bucket"], found["bits"], found["v"], found["n"], strict=True):
        data[bucket] = np.frombuffer(bits, np.uint8)
        values.append((np.uint64(bucket) << np.uint64(32)) | np.frombuffer(v, np.uint32))
        counts.append(np.frombuffer(k, np.int64))
    return Frequencies(Bits(log, data.ravel()), np.concatenate(values), np.concatenate(counts), shift)


def prefix(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens of a document's prefix that other documents may have, their places in its order, and its number of
    matches."""
    size = len(tokens)
    base, most = size - (percent * size + 99) // 100, min(MOST_MATCHES, (percent * size + 99) // 100)
    order = np.lexsort((tokens, often))
    cost = np.cumsum(often[order][: base + most] - 1)
    choices = [(base + m + COMPARE * cost[base + m - 1] / 4 ** (m - 1), m) for m in range(1, most + 1)]
    matches = min(choices)[1]
    places = np.flatnonzero(often[order][: base + matches] > 1)
    return tokens[order[places]], places, matches


def prefixes(docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """``token, doc, size, place, own, matches`` for every prefix token of several documents, ``own`` being the number of
    shingles that only this document has; a set met before in the same task is left to its digest. ``shared``: the
    frequencies, broadcast."""

    def run(batches):
        seen: set[int] = set()
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            rows: list[tuple] = []
            for doc, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if doc is None or not len(tokens):
                    continue
                often = shared.value.of(tokens)
                own = int(np.count_nonzero(often == 1))
                if own > len(tokens) - (percent * len(tokens) + 99) // 100:
                    continue  # more shingles of its own than any similar pair leaves
                same = digest(tokens)
                if same in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(same)
                chosen, places, matches = prefix(tokens, often, percent)
                rows.append((chosen, places, doc, len(tokens), own, matches))
            if rows:
                lengths = [len(r[0]) for r in rows]
                each = lambda i, kind: np.repeat(np.array([r[i] for r in rows], kind), lengths)  # noqa: E731, B023
                yield _batch([np.concatenate([r[0] for r in rows]).astype(np.int64), each(2, np.int64), each(3, np.int32), np.concatenate([r[1] for r in rows]).astype(np.int32), each(4, np.int32), each(5, np.int8)], ["token", "doc", "size", "place", "own", "matches"])
            common.release()

    return docs.mapInArrow(run, "token bigint, doc bigint, size int, place int, own int, matches tinyint")


def passing(rows: DataFrame, column: str, values: DataFrame, held: ExitStack) -> DataFrame:
    """Rows whose value may be among ``values``; a join has the last word, but has little left to shuffle."""
    shared = sent(rows.sparkSession, bit_filter(values), held)

    def run(batches):
        for batch in batches:
            yield batch.filter(marked(shared.value, batch.column(batch.num_columns - 1))).select(range(batch.num_columns - 1))

    schema = rows.schema
    return rows.select("*", slot(column).alias("__slot")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, n: int, ids: DataFrame, held: ExitStack) -> DataFrame:
    """``doc, tokens`` of the documents in ``ids`` (and of a few others that its bit filter lets through)."""
    shared = sent(docs.sparkSession, bit_filter(ids), held)

    def run(batches):
        for whole in batches:
            whole = whole.filter(marked(shared.value, whole.column(2)))
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                own = list(shingle_sets(batch.column(1), n))
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc", "tokens"])
            common.release()

    return docs.filter(F.col("doc").isNotNull()).select("doc", "text", slot("doc").alias("slot")).mapInArrow(run, "doc bigint, tokens array<bigint>")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))


def matched(pairs: DataFrame, groups: DataFrame, held: ExitStack) -> DataFrame:
    """Of proposed pairs those that share as many prefix tokens as the smaller L of the two asks for."""
    own = passing(groups.select("token", "matches", "doc"), "doc", ends(pairs), held).groupBy("doc").agg(F.collect_set("token").alias("tokens"), F.min("matches").alias("matches"))
    side = lambda s: own.select(F.col("doc").alias(s), F.col("tokens").alias(f"tokens_{s}"), F.col("matches").alias(f"matches_{s}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.filter("size(array_intersect(tokens_a, tokens_b)) >= least(matches_a, matches_b)").select("a", "b")


def similar(pairs: DataFrame, docs: DataFrame, n: int, percent: int, held: ExitStack) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the similarity, by comparing the sets themselves."""
    sets = sets_of(docs, n, ends(pairs), held)
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    common_ = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common_ >= percent * (F.size("x") + F.size("y") - common_)).select("a", "b").distinct()


class Join:
    """The steps of the join over one table, ``doc, text``; every table is written to ``folder``."""

    def __init__(self, docs: DataFrame, n: int, percent: int, folder: str, held: ExitStack):
        self.docs, self.n, self.percent, self.folder, self.held = docs, n, percent, folder, held
        self.facts = staged(facts(docs, n), folder, "facts")
        total = self.facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        known = sent(docs.sparkSession, frequencies(docs, n, total), held)
        rows = staged(prefixes(docs, n, percent, known), folder, "prefixes")
        often = staged(rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), folder, "often")
        met = passing(rows, "token", often.select(F.col("token").alias("v")), held).join(often.hint("merge"), "token")
        #: prefix tokens that several documents have in their prefixes
        self.groups = staged(met, folder, "groups")

    def enough(self, overlap: str) -> str:
        return f"{100 + self.percent} * ({overlap}) >= {self.percent} * (size_a + size_b)"

    def reach(self, spare: str):
        """Whether a pair that shares a token can be similar: what is left of both sets from the token on must hold the
        overlap, but for ``spare`` tokens that may have been shared before; and so must both sets without the shingles of
        their own."""
        return F.expr(f"100 * least(size_a, size_b) >= {self.percent} * greatest(size_a, size_b) and {self.enough('least(size_a - own_a, size_b - own_b)')} and {self.enough(f'least(size_a - place_a, size_b - place_b) + {spare}')}")

    def same_sets(self) -> DataFrame:
        """Links ``a, b`` of every document to the smallest one with the same set."""
        live, key = self.facts.filter("doc is not null and size > 0"), ["size", "digest", "digest_2"]
        firsts = staged(live.groupBy(*key).agg(F.min("doc").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n"), self.folder, "firsts")
        return staged(live.select(F.col("doc").alias("a"), *key).join(firsts.hint("merge"), key).filter("a <> b").select("a", "b"), self.folder, "links_same")

    def placed(self, parts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Prefix tokens with the component of each document, and the tokens whose group has several, with a hub."""
        rows = self.groups.join(parts.hint("merge"), self.groups.doc == parts.node, "left").select("token", "doc", "size", "place", "own", "matches", F.coalesce("component", "doc").alias("part"))
        rows = staged(rows, self.folder, f"placed_{name}")
        hub = F.min_by(F.struct("doc", "size", "place", "own", "part"), F.struct(F.col("place") / F.col("size"), "doc")).alias("hub")
        return rows, rows.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), hub).filter("p <> q")

    def with_hubs(self, parts: DataFrame) -> DataFrame:
        """Links found by comparing each member of a token's group with the group's hub."""
        rows, mixed = self.placed(parts, "hub")
        met = rows.join(mixed.hint("merge"), "token").filter("part <> hub.part")
        met = met.select(*[F.col(f"hub.{c}").alias(f"{c}_a") for c in ("doc", "size", "place", "own")], *[F.col(c).alias(f"{c}_b") for c in ("doc", "size", "place", "own")]).filter(self.reach("0"))
        proposed = staged(met.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct(), self.folder, "proposed")
        return self.compared(matched(proposed, self.groups, self.held), "hub")

    def across(self, parts: DataFrame) -> DataFrame:
        """Links between documents that are still in different components."""
        rows, mixed = self.placed(parts, "across")
        some = staged(rows.join(mixed.select("token").hint("merge"), "token"), self.folder, "some")
        words = [f"sketch_{i}" for i in range(SKETCH)]
        sketches = passing(self.facts.filter("doc is not null").select("size", *words, "doc"), "doc", some.select(F.col("doc").alias("v")), self.held).distinct()
        some = staged(some.join(sketches.hint("merge"), ["doc", "size"]), self.folder, "sketched")
        side = lambda df, s: df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "size", "place", "own", "matches", "part", *words)])
        index = some.filter(f"{100 + self.percent} * (size - place + matches - 1) >= {2 * self.percent} * size")  # of the smaller set
        apart = " + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words)
        close = f"{100 + self.percent} * (size_a + size_b - ({apart})) >= {2 * self.percent} * (size_a + size_b)"
        smaller = F.expr(f"part_a <> part_b and struct(size_a, doc_a) < struct(size_b, doc_b) and {close}")
        met = side(index, "a").hint("merge").join(side(some, "b"), "token").filter(smaller & self.reach("least(matches_a, matches_b) - 1"))
        pairs = met.groupBy("doc_a", "doc_b").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("matches_a", "matches_b", "size_a", "size_b", "place_a", "place_b", "own_a", "own_b")])
        pairs = pairs.filter(F.expr("n >= least(matches_a, matches_b)") & self.reach("0")).select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))
        return self.compared(pairs, "across")

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = staged(pairs, self.folder, f"pairs_{name}")
        return staged(similar(pairs, self.docs, self.n, self.percent, self.held), self.folder, f"links_{name}")


def link(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row; linked means at least ``percent`` / 100 Jaccard similarity."""
    spark = docs.sparkSession
    work, folder = shared_folder(spark), shared_folder(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    with ExitStack() as held:
        join = Join(docs, n, percent, work, held)
        links = join.same_sets()
        parts = smallest_reachable(links, work, "parts_same")
        for step, name in ((join.with_hubs, "hub"), (join.across, "across")):
            links = links.unionByName(step(parts))
            parts = smallest_reachable(links, work, f"parts_{name}")
        out = join.facts.select("doc", "size").join(parts.withColumnRenamed("node", "doc").hint("merge"), "doc", "left")
        out = staged(out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")), folder, "linked")
    dropped(spark, work)
    return out


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_session(spark)
    return link(table(spark, sf_dir, "documents"), n=4, percent=85)


SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
    SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), step AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT doc_id AS a, doc_id AS r FROM doc
    UNION
    SELECT step.b, reach.r FROM reach JOIN step ON step.a = reach.a
)
SELECT doc.doc_id, coalesce(max(size.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM doc JOIN reach ON reach.a = doc.doc_id LEFT JOIN size ON size.doc_id = doc.doc_id
GROUP BY doc.doc_id
"""
