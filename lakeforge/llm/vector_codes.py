"""Product codes for vectors, learned by an active-entry Lloyd iteration in exact whole numbers.

A vector becomes whole numbers floor(scale * x) and is cut into equal parts; each part position has a codebook. A round
assigns every part to its nearest entry and moves every used entry to the floor of its parts' mean. What a part was
assigned, and at which distance, is kept from round to round. A part whose entry stayed where it was has already beaten
every other entry that stayed, so it is compared with the entries that moved only; a part whose entry moved is compared
with all. Of equal distances the lower index wins in both cases.

A round is one pass over the written state: it gives the next state and, once for each task, the sums of each entry's
parts, which are added up by entry. Codebooks are of fixed size (parts * entries * width numbers) and are the only thing
that comes to the driver or goes out to tasks. Vectors are not shuffled.

Defined results
    * Rows whose vector is null, or holds a null or non-finite component, or one beyond ``MOST`` (whole numbers that
      64 bits can no longer square and add), are dropped; so are those of another length than the kept one that comes
      first by id. That length must be a multiple of ``parts``, otherwise it is an error.
    * The first codebooks are the kept vectors that come first by id (a null id last, then by content); with fewer kept
      vectors than entries there are so many entries fewer. Repeated rows count each time and are all coded.
    * An entry that no part uses stays. Rounds end early when no entry has moved, which changes nothing.
    * Without kept vectors the result and the codebooks are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, shared_folder, table

#: The greatest whole number of a component, and that below which products of parts are exact as 64-bit floats.
MOST, EXACT_FLOAT = 1 << 27, 1 << 20
#: Vectors compared with a codebook at once.
BLOCK = 2048
#: Labels whose sums are sent to all tasks; beyond it they are joined by shuffle.
MOST_SENT = 100_000


class Codebooks:
    """``entries[part, index, place]`` and which of them moved last; all have moved at first."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries.astype(np.int64)
        self.moved = np.ones(entries.shape[:2], bool) if moved is None else moved

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))

    def after(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each used entry at the floor of its parts' mean."""
        entries = self.entries.copy()
        for (part, index), (n, total) in sums.items():
            entries[part, index] = np.array(total, np.int64) // n
        return Codebooks(entries, (entries != self.entries).any(axis=2))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the lowest index of the nearest entry, and the squared distance."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < EXACT_FLOAT:
        product = (x.astype(float) @ entries.T.astype(float)).astype(np.int64)  # sums of whole numbers under 2^53
    else:
        product = x @ entries.T
    distance = (x * x).sum(1)[:, None] - 2 * product + (entries * entries).sum(1)
    index = distance.argmin(1)
    return index, distance[np.arange(len(x)), index]


def assign(x: np.ndarray, books: Codebooks, index: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Assignments and distances of the parts of ``x[row, part, place]``, given those before the entries moved. Third: how
    many parts were compared with all entries."""
    rows, parts, _ = x.shape
    if index is None:
        index, distance = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
        whole = np.ones((rows, parts), bool)
    else:
        index, distance = index.copy(), distance.copy()
        whole = books.moved[np.arange(parts), index]
    for p in range(parts):
        entries, moved = books.entries[p], np.flatnonzero(books.moved[p])
        for at in range(0, rows, BLOCK):
            here = slice(at, at + BLOCK)
            again = np.flatnonzero(whole[here, p]) + at
            if len(again):
                index[again, p], distance[again, p] = nearest(x[again, p], entries)
            rest = np.flatnonzero(~whole[here, p]) + at
            if len(rest) and len(moved):
                near, d = nearest(x[rest, p], entries[moved])
                near = moved[near]
                better = (d < distance[rest, p]) | (d == distance[rest, p]) & (near < index[rest, p])
                index[rest[better], p], distance[rest[better], p] = near[better], d[better]
    return index, distance, int(whole.sum())


def sums_of(x: np.ndarray, index: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
    """Add the parts of each entry to ``count[part, entry]`` and ``total[part, entry, place]``."""
    rows, parts, width = x.shape
    entries = count.shape[1]
    for p in range(parts):
        count[p] += np.bincount(index[:, p], minlength=entries)
        for at in range(0, rows, BLOCK):  # so many numbers of at most 2^27 are exact as floats
            own = x[at : at + BLOCK, p]
            places = index[at : at + BLOCK, p, None] * width + np.arange(width)
            total[p] += np.bincount(places.ravel(), own.ravel().astype(float), entries * width).astype(np.int64).reshape(entries, width)


def numbers(column: pa.Array, dtype=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def one_round(books: Codebooks, kept: list[str], schema: T.StructType):
    """Next state of a partition's rows (kind 0), then the sums of its parts by entry (kind 1)."""
    types = {f.name: f.dataType for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        parts, entries, width = books.entries.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        arrow = {n: to_arrow_type(t) for n, t in types.items()}

        def rows(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, arrow[c]) for c in arrow], names=list(arrow))

        def lists(values: np.ndarray, kind) -> pa.Array:
            n = values.shape[1] if values.ndim == 2 else 0
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(values).ravel(), kind))

        for batch in batches:
            if not batch.num_rows:
                continue
            x = numbers(batch.column("x")).reshape(batch.num_rows, parts, width)
            known = "entry" in batch.schema.names
            index, distance, _ = assign(x, books, numbers(batch.column("entry")) if known else None, numbers(batch.column("distance")) if known else None)
            sums_of(x, index, count, total)
            own = {c: batch.column(c) for c in kept}
            yield rows(batch.num_rows, own | {"kind": pa.array(np.zeros(batch.num_rows, np.int32)), "x": batch.column("x"), "entry": lists(index, pa.int32()), "distance": lists(distance, pa.int64())})
        part, entry = np.nonzero(count)
        if len(part):
            yield rows(len(part), {"kind": pa.array(np.ones(len(part), np.int32)), "slot": pa.array((part * entries + entry).astype(np.int32)), "n": pa.array(count[part, entry]), "total": lists(total[part, entry], pa.int64())})

    return run


def whole_numbers(vectors: DataFrame, scale: int, vector_col: str, kept: dict) -> DataFrame:
    """``kept`` columns and ``x``, the components as whole numbers, of the rows that can be coded."""
    scaled = lambda v: v.cast("double") * scale
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(scaled(v)) <= MOST))
    return vectors.filter(F.col(vector_col).isNotNull() & fine).select(*(c.alias(n) for n, c in kept.items()), F.transform(vector_col, lambda v: F.floor(scaled(v)).cast("bigint")).alias("x"))


def quantise(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Codebooks]:
    """``keep`` columns, ``code`` (hex digits of the entries in part order) and ``error`` of every kept vector, and the
    codebooks. ``entries`` is at most 256."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    own = {f"k{i}": F.col(c) for i, c in enumerate(keep)}
    rows = whole_numbers(vectors, scale, vector_col, own | {"id": F.col(id_col)}).filter(F.size("x") > 0)
    order = [F.col("id").isNull(), F.col("id"), F.col("x")]
    width = (rows.orderBy(*order).select(F.size("x")).first() or [0])[0]
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = rows.filter(F.size("x") == width)
    first = [r[0] for r in rows.orderBy(*order).select("x").limit(entries).collect()]  # a codebook, of fixed size
    if not first:
        return vectors.select(*keep).limit(0).select("*", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), Codebooks(np.zeros((parts, 0, 0)))
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    state = rows.drop("id")
    schema = T.StructType([*(state.schema[c] for c in own), *T.StructType.fromDDL("kind int, x array<bigint>, entry array<int>, distance array<bigint>, slot int, n bigint, total array<bigint>")])
    schema = T.StructType([f for f in schema if f.name != "kind"] + [schema["kind"]])  # as it is read back
    for i in range(rounds + 1):
        path = f"{folder}/round{i}"
        state.mapInArrow(one_round(books, list(own), schema), schema).write.partitionBy("kind").parquet(path)
        written = spark.read.schema(schema).parquet(path)
        state = written.filter("kind = 0").select(*own, "x", "entry", "distance")
        if i:
            dropped(spark, f"{folder}/round{i - 1}")
        if i == rounds:
            break
        sums = written.filter("kind = 1").groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width // parts)))
        books = books.after({divmod(r[0], len(first)): (r[1], list(r[2:])) for r in sums.collect()})  # at most parts * entries rows
        if not books.moved.any():
            break
    code = F.array_join(F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    error = F.aggregate("distance", F.lit(0).cast("bigint"), lambda a, d: a + d)
    return state.select(*(F.col(n).alias(c) for n, c in zip(own, keep, strict=True)), code.alias("code"), error.alias("error")), books


def with_total(coded: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` summed over the rows of equal ``by``, nulls together. The rows of a group never meet."""
    totals = coded.groupBy(by).agg(F.sum(value).alias(name)).withColumnRenamed(by, "__by")
    few = totals.limit(MOST_SENT + 1).count() <= MOST_SENT
    side = F.broadcast(totals) if few else totals.hint("merge")
    return coded.join(side, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantise(table(spark, sf_dir, "embeddings"), ("vec_id", "label"))
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return with_total(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 4, entries: int = 256, width: int = 16, rounds: int = 4) -> str:
    """Every round compares every part with every entry."""
    distance = f"list_sum(list_transform(range(1, {width + 1}), lambda j: (x.v[j] - b.v[j]) * (x.v[j] - b.v[j])))"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, p, x[p * {width} + 1 : p * {width} + {width}] AS v FROM kept, range({parts}) AS r(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM cut QUALIFY k < {entries}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, p, min(struct_pack(d := d, k := k)) AS best FROM (
    SELECT x.vec_id, x.p, b.k, CAST({distance} AS BIGINT) AS d FROM cut x JOIN book{i} b ON x.p = b.p
  ) GROUP BY vec_id, p
)""")
        if i < rounds:
            means = ", ".join(f"CAST(floor(sum(x.v[{j}]) / count(*)) AS BIGINT)" for j in range(1, width + 1))
            steps.append(f"""book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT x.p, n.best.k AS k, [{means}] AS v FROM cut x JOIN near{i} n ON x.vec_id = n.vec_id AND x.p = n.p GROUP BY x.p, n.best.k
  ) m ON b.p = m.p AND b.k = m.k
)""")
    last = f"""coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(n.best.k)), 2, '0'), '' ORDER BY n.p) AS code, CAST(sum(n.best.d) AS BIGINT) AS error
  FROM kept k JOIN near{rounds} n ON k.vec_id = n.vec_id GROUP BY k.vec_id, k.label
), final AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS digest FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM final) AS codebooks_sha256 FROM coded"""
    return "WITH " + ",\n".join([*steps, last])


SQL = sql()
