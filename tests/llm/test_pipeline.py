"""Every stage of the pipeline on its own input, followed by brute force, and awkward rows through the whole."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from lakeforge.llm import toxicity
from tests.conftest import DATA

from .test_exact import AWKWARD, brute_components, brute_hits


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, {}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            toxic = {r[0] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").select("doc_id").collect()}
            clean = {r[0] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 0").select("doc_id").collect()}
            assert len(toxic & held[name]) <= 0.1 * len(toxic) and len(clean & held[name]) >= 0.99 * len(clean)
        elif name == "exact_dedup":
            last = {}
            for i, t in before:
                last[t] = max(last.get(t, i), i)
            assert held[name] == set(last.values())
        elif name == "near_dedup":
            parts = brute_components(before, 5, 80)
            assert held[name] == set(parts.values())
        elif name == "decontamination":
            windows = {w for _, t in items for w in re.findall(r"[a-z0-9]+", t.lower())[:1]}
            assert windows and held[name] == {i for i, t in before if not brute_hits_fast(t, items)}
        else:
            assert held[name] == {i for i, _ in before} and docs.columns == ["doc_id", "ids", "n_tokens"]
        if name != "bpe":
            assert docs.columns == columns


def brute_hits_fast(text, items, known={}):  # noqa: B006
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not known:
        for _, t in items:
            w = words(t)
            n = min(10, len(w))
            known.setdefault(n, set()).update(tuple(w[j : j + n]) for j in range(len(w) - n + 1) if n)
    own = words(text)
    return any(tuple(own[p : p + n]) in some for n, some in known.items() if n for p in range(len(own) - n + 1))


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for some in (docs, docs.limit(0)):
        frame, folder = some, tmp_path / str(some is docs)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, DATA).write.parquet(str(folder / name))
            frame = spark.read.parquet(str(folder / name))
        assert frame.count() <= some.count() and (frame.count() > 0) == (some is docs)


def test_near_copies_of_a_repeated_id(spark):
    """Two texts share an id; only the one that is a near copy goes."""
    words = [f"w{i}" for i in range(80)]
    near, other = " ".join([*words[:-1], "changed"]), "nothing like the others at all in this short text"
    rows = [(1, " ".join(words)), (5, near), (5, other), (None, near + " again"), (None, None), (7, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()}
    assert left == {(1, " ".join(words)), (5, other), (None, None), (7, None)}


def test_names_and_brute_force_agree():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    assert brute_hits("a b c", [("q", "a b c")]) == (3, 3, ["q"]) and toxicity.THRESHOLD == 0.7
    assert F is not None
