"""Secret scan: three fixed patterns, and character Markov models for strings that no pattern describes.

Everything is DataFrame functions: matches come from ``regexp_extract_all``; where they stand follows from the lengths of
the pieces that ``split`` leaves between them. Labelled samples train two first-order Markov chains over characters: the
values that the patterns find are the random strings, all other runs of six or more token characters in all documents
the ordinary identifiers. Runs of 16 or more token characters whose log-likelihood ratio speaks for a random string are
reported as ``markov``.

The scan is one pass over the documents, staged without their texts; training reads that table and, in a second pass, the
tokens of all texts, and its result is one row of fixed size. Distinct tokens are shuffled, after partial aggregation;
documents are not.

Defined results
    * A null text is the empty text and has no spans. Whole texts are scanned.
    * Equal values count once in training, however many copies of a document there are. Both chains grow with the input.
    * A token that overlaps or touches a match of the patterns is not an ordinary identifier. Random strings that no pattern
      describes are among the ordinary ones, once each.
    * Without any value found by the patterns there is nothing to learn from, and no ``markov`` span is added.
    * Repeated rows have a result each; other columns are not read. An empty table gives an empty result. Spans that start
      together are listed by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, staged, table

# Patterns of the base kinds. A shorter hex or access match has no longer one in its own run of characters,
# so the least length may stand in the pattern; a short assignment uses up its text and is dropped afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: The same characters as in CANDIDATE, in whole runs that do not touch what CUT stands for.
ORDINARY = r"(?<![A-Za-z0-9+/_\x00-])[A-Za-z0-9+/_-]{6,}+={0,2}+(?!\x00)"
#: Stands for a match of the base patterns.
CUT = "\0"

#: Values that a fold goes over at a time.
BLOCK = 32
#: Least log-likelihood ratio, in nats.
LEAST_RATIO = 12.0
#: Weight of a character's own frequency beside its frequency after another one.
BACKOFF = 100.0
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
N = len(LETTERS) + 1
KINDS = ("assign", "access", "hex", "markov")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine, start: Column, levels: int = 2) -> Column:
    """array<int> of the running results of an associative ``combine`` with the neutral element ``start``.

    A fold copies what it has gathered at every step, so it goes over BLOCK values at a time; blocks are then moved on by the
    running results over their last values, which are found in the same way. The work follows the number of values.
    """
    empty = F.expr("array()").cast("array<int>")

    def fold(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("last"), empty.alias("all")),
            lambda acc, x: F.struct(combine(acc["last"], x).alias("last"), F.array_append(acc["all"], combine(acc["last"], x)).alias("all")),
            lambda acc: acc["all"],
        )

    def moved(blocks: Column) -> Column:
        ends = running(F.transform(blocks, lambda b: F.element_at(b, -1)), combine, start, levels - 1)
        before = F.concat(F.array(start), F.slice(ends, F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b, lambda x: combine(at, x))))

    def cut(all_values: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(all_values) - 1, F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: fold(F.slice(all_values, i + 1, F.lit(BLOCK))))
        return F.when(F.size(all_values) == 0, empty).otherwise(bound(blocks, moved))

    return bound(values, cut) if levels else fold(values)


def placed(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct(start, end, value)> of the non-overlapping matches; ends are exclusive, in code points."""

    def spans(whole: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        ends = running(F.zip_with(gaps, whole, lambda g, w: F.length(g) + F.length(w)), lambda a, b: a + b, F.lit(0))
        each = F.arrays_zip(ends.alias("end"), whole.alias("own"), values.alias("value"))
        return F.transform(each, lambda x: F.struct((x["end"] - F.length(x["own"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    empty = F.expr("array()").cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(empty)


def unmet(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``: both are put in one order of starts, and a span is free if what came
    before it ends before it, and what comes after it begins behind it."""
    item = lambda rank: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value"))
    far = F.lit(2**31 - 1)

    def free(both: Column) -> Column:
        until = running(F.transform(both, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(0)), F.greatest, F.lit(0))
        after = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(far))), F.least, far))
        each = F.arrays_zip(both.alias("span"), until.alias("until"), after.alias("after"))
        left = F.filter(each, lambda x: (x["span"]["rank"] == 1) & (x["until"] <= x["span"]["start"]) & (x["after"] >= x["span"]["end"]))
        return F.transform(left, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["span"]["value"].alias("value")))

    both = F.sort_array(F.concat(F.transform(base, item(0)), F.transform(spans, item(1))))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(bound(both, free))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, assign, access, hex, candidate``: the matches of every row, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        id_col,
        F.filter(placed(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 12).alias("assign"),
        placed(text, ACCESS).alias("access"),
        placed(text, HEX).alias("hex"),
        placed(text, CANDIDATE).alias("candidate"),
    )


def codes(token: Column) -> Column:
    """Places of the characters of a token in LETTERS, 1 to N - 1; 0 for others, and in front as the start."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(LETTERS), c))))


def pairs(token: Column) -> Column:
    """array<int> of N * before + after for every two characters in a row."""
    c = codes(token)
    return F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * N + b)


def ordinary(text: Column) -> Column:
    """array<string> of the distinct tokens of a text outside the matches of the base patterns."""
    long, value = ASSIGN.removeprefix("(?i)").removesuffix("+)") + "{12,})", r"[A-Za-z0-9+/_.=-]"
    text = F.replace(text, F.lit(CUT), F.lit(" "))
    # a short assignment uses up its text but is no match: it is put back behind a mark, and the mark is taken out again,
    # which no value character follows elsewhere
    text = F.regexp_replace(text, F.lit(f"(?i)(?:{long}|({ASSIGN.removeprefix('(?i)')}))"), F.lit(f"{CUT}$3"))
    text = F.regexp_replace(text, F.lit(f"{CUT}(?={value})"), F.lit(""))
    for pattern in (ACCESS, HEX):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(CUT))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0)))


def train(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row ``ratio array<double>``: log P(after | before) as a random string less that as an ordinary identifier."""
    values = F.concat(*[F.transform(F.col(k), lambda x: x["value"]) for k in KINDS[:3]])
    random = found.select(F.explode(values).alias("token")).distinct().withColumn("kind", F.lit("random"))
    plain = docs.select(F.explode(ordinary(F.col(text_col))).alias("token")).distinct().withColumn("kind", F.lit("ordinary"))
    seen = random.unionByName(plain).select("kind", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(F.count_if(F.col("kind") == "random").alias("r"), F.count_if(F.col("kind") == "ordinary").alias("o"))
    every = docs.sparkSession.range(N * N).select(F.col("id").cast("int").alias("pair")).join(seen, "pair", "left").fillna(0, ["r", "o"])
    marginal = lambda column, name: every.groupBy(column.alias(name)).agg(F.sum("r").alias(f"r_{name}"), F.sum("o").alias(f"o_{name}"))
    first, second = F.floor(F.col("pair") / N), F.col("pair") % N
    sums = every.agg(F.sum("r").alias("r_all"), F.sum("o").alias("o_all"))
    # N rows and one row: the sides of these joins have a fixed size
    met = every.join(F.broadcast(marginal(first, "before")), first == F.col("before")).join(F.broadcast(marginal(second, "after")), second == F.col("after")).join(F.broadcast(sums))
    single = lambda k: (F.col(f"{k}_after") + 1) / (F.col(f"{k}_all") + N)
    chance = lambda k: F.log((F.col(k) + BACKOFF * single(k)) / (F.col(f"{k}_before") + BACKOFF))
    ratio = met.select("pair", "r", (chance("r") - chance("o")).alias("x"))
    gathered = ratio.agg(F.array_sort(F.collect_list(F.struct("pair", "x"))).alias("s"), F.sum("r").alias("n"))
    return gathered.select(F.when(F.col("n") > 0, F.transform("s", lambda v: v["x"])).otherwise(F.array_repeat(F.lit(0.0), N * N)).alias("ratio"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """``id_col, assign, access, hex, markov``: arrays of struct(start, end, value) for every row of ``docs``."""
    folder = shared_folder(docs.sparkSession)
    found = staged(scan(docs, id_col, text_col), folder, "matches")
    model = staged(train(found, docs, text_col), folder, "model")  # one row of N * N numbers
    scored = found.join(F.broadcast(model))
    base = F.concat("assign", "access", "hex")
    total = lambda token: F.aggregate(pairs(token), F.lit(0.0), lambda acc, p: acc + F.col("ratio")[p])
    return scored.select(id_col, *KINDS[:3], F.filter(unmet(F.col("candidate"), base), lambda c: total(c["value"]) >= least).alias("markov"))


def listed(*kinds: str) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    each = F.concat(*map(of, kinds))
    return F.array_join(F.transform(F.array_sort(each), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        listed(*KINDS).alias("spans"),
    )
