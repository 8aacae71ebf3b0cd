"""Operators that learn: held-out accuracy, method details, and awkward rows."""

import bisect
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import labelled, language_id, quality, toxicity
from tests.conftest import DATA

from .test_exact import AWKWARD, documents


def truth(spark, name):
    return {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", name).collect()}


def test_folds_are_crc32(spark):
    got = {r["doc_id"]: r["f"] for r in documents(spark, [(1, ""), (77, ""), (123456, "")]).withColumn("f", labelled.fold("doc_id", 5)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in got}


# -- quality ----------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    marks, rows = truth(spark, "quality"), quality.op3_quality(spark, DATA).collect()
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in held]) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((3000, len(quality.NAMES)))
    x[:, :3] = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.95


def plain_measures(text):
    """Features of a text, one byte, word and line at a time."""
    data = (text or "").encode()
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[^\x00-\x20]+", data)]
    lines = re.findall(rb"[^\n]+", data)
    n, m, size = len(words), len(lines), max(len(data), 1)
    share = lambda test: sum(map(test, data)) / size
    upper, lower = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122)
    repeated = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    runs = [len(list(g)) for _, g in itertools.groupby(words)]
    return [
        np.log1p(len(data)), np.log1p(n), np.mean([len(w) for w in words]) if n else 0, upper / max(upper + lower, 1e-9), share(lambda b: 48 <= b <= 57), share(lambda b: b in b"#*%$&@^~_=+<>{}[]\\/"),
        share(lambda b: b == 124), share(lambda b: b == 33), share(lambda b: b in b".,;:?"), share(lambda b: b >= 192), 1 - repeated(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n - 1, 1),
        max(map(words.count, set(words))) / n if n else 0, np.mean([len(w) <= 3 for w in words]) if n else 0, m / max(n, 1), repeated(lines), np.log1p(np.mean([len(x) for x in lines])) if m else 0,
        np.mean([x[-1:] in (b".", b"!", b"?", b":", b'"', b"'", b")") for x in lines]) if m else 0, repeated(list(zip(words, words[1:], strict=False))), np.log1p(max(runs)) if n else 0,
    ]


def test_quality_scores_equal_brute_force(spark):
    """Features one by one, then bins and tables one by one, whatever other texts are in the batch."""
    rng = random.Random(6)
    words = ["spam", "spam", "Eggs!", "a", "12", "||", "é", "end.", "\n", "\n\n", "Tea"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(200)] + ["spam spam", "spam spam", "", "\n", " spam"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id bigint, text string").coalesce(1)
    plain = {i: plain_measures(t) for i, t in [*enumerate(texts), (999, None)]}
    assert np.allclose(quality.measure(pa.array(texts)), [plain[i] for i in range(len(texts))])
    labels = spark.createDataFrame([(i, int(t.count("spam") * 3 > len(t.split()))) for i, t in enumerate(texts)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert len({round(r["score"], 6) for r in quality.score(docs, model).collect()}) > 20
    for r in quality.score(docs, model).collect():
        bins = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, plain[r["doc_id"]], strict=True)]
        total = model.intercept + sum(float(t[b]) for t, b in zip(model.tables, bins, strict=True))
        total += sum(float(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]) for (i, j), t in model.pairs.items())
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)


def test_quality_awkward(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    docs = documents(spark, AWKWARD)
    for labels in (marks, marks.limit(0), marks.filter("quality = 1")):
        out = quality.score(docs, quality.train(docs, labels)).collect()
        assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(docs.limit(0), quality.train(docs, marks)).count() == 0


# -- language ---------------------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r["lang_pred"], lang[r["doc_id"]]) for r in language_id.op6_language_id(spark, DATA).collect() if r["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def language_places(text):
    """Places of the grams of 2, 3 and 4 bytes, one by one."""
    data, out = text.encode().lower() if text.isascii() else bytes(b + 32 if 65 <= b < 91 else b for b in text.encode()), set()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 257 + b) % (1 << 32)
            out.add((code * 2654435761 % (1 << 32)) >> 18)
    return out


def test_language_scores_equal_kernel_ridge(spark):
    """With every training text a landmark the Nyström map is exact, so scores are those of plain kernel ridge regression."""
    words = {"aa": ["der", "und", "nicht", "Straße", "ein"], "bb": ["the", "and", "not", "street", "a"], "cc": ["el", "calle", "niño", "y", "no"]}
    rng = random.Random(2)
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 12)))
    train = [(i, text(lang), lang) for i, lang in enumerate(list(words) * 9)]
    new = [(100 + i, text(lang) + " XYZ", lang) for i, lang in enumerate(list(words) * 4)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(frame(new), language_id.train(frame(train))).collect()}
    sets = [language_places(t) for _, t, _ in train]
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    gram = np.array([[k(a, b) for b in sets] for a in sets])
    wanted = np.array([[1.0 if lang == one else -1.0 for one in sorted(words)] for _, _, lang in train])
    weights = np.linalg.solve(gram + language_id.RIDGE * len(train) * np.eye(len(train)), wanted)
    for i, t, _ in new:
        f = np.array([k(language_places(t), b) for b in sets]) @ weights
        p = np.exp(language_id.SHARPNESS * (f - f.max()))
        assert got[i]["lang_pred"] == sorted(words)[int(f.argmax())] and abs(got[i]["score"] - p.max() / p.sum()) < 5e-3


def test_language_sample_is_bounded(spark):
    """Rows that repeat an id count once, and no language is left out where there are many."""
    rows = [(7, f"hello number {i}", "en") for i in range(2500)] + [(100 + i, f"other {i}", "en") for i in range(400)] + [(600 + i, f"autre {i}", "fr") for i in range(100)]
    docs = spark.createDataFrame([*rows, (7, "deux langues", "fr"), (None, "x", "en"), (8, None, "en"), (9, "x", None)], "doc_id bigint, text string, lang string")
    drawn = language_id.sample(docs, per_language=300).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in drawn} == {"en": 300, "fr": 101}
    assert language_id.sample(docs, per_language=600).filter("y = 'en'").count() == 401
    many = spark.createDataFrame([(i, f"text {i % 50} of a language", f"l{i % 50:02}") for i in range(400)], "doc_id bigint, text string, lang string")
    assert language_id.sample(many, most_rows=120).groupBy("y").count().filter("count = 2").count() == 50
    model = language_id.train(many, most_rows=20, landmarks=8)  # one row and one landmark for each
    assert len(model.languages) == 50 == model.landmarks.shape[1]
    assert language_id.identify(many, model).filter("lang_pred = lang").count() > 300


def test_language_kernel_and_awkward(spark):
    (_, x, _), = language_id.presence(pa.array(["abab", "abab abab", "zzzz"]))
    assert x[0].sum() == 2 + 2 + 1 and (x[0] <= x[1]).all() and x[0] @ x[2] == 0
    docs = documents(spark, AWKWARD + [(70, "123 456 !!"), (71, "ñ")])
    for model in (language_id.train(docs), language_id.train(docs.limit(0))):
        got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
        assert got[1, None] == got[2, ""] == got[70, "123 456 !!"] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert got[71, "ñ"][0] == "und" and language_id.identify(docs.limit(0), model).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def detector(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet").filter(labelled.fold("doc_id", 3) != 1)).opened()


def test_toxicity_held_out(spark):
    marks, rows = truth(spark, "toxic"), toxicity.op7_toxicity(spark, DATA).collect()
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([b for a, b in held if a]) >= 0.95  # precision


def test_toxicity_recall(spark):
    marks, rows = truth(spark, "toxic"), toxicity.op7_toxicity(spark, DATA).collect()
    caught = [(r["held_out"], r["predicted"]) for r in rows if marks.get(r["doc_id"]) == 1]
    assert np.mean([p for _, p in caught]) >= 0.9 and np.mean([p for h, p in caught if h]) >= 0.8


def test_words_are_learned_by_evidence(spark):
    """Few rows are enough where little else is tested; what is rare among many toxic rows is learned; chance is not."""

    def learned(rows):
        docs = spark.createDataFrame([(i, f"{t} n{i} m{i} k{i} l{i} j{i}") for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(rows)], "doc_id bigint, toxic int")
        first = toxicity.train(docs, labels).words
        assert toxicity.train(docs.repartition(7), labels.orderBy(F.desc("doc_id"))).words == first
        return set(first)

    plain = [(0, f"w{chr(97 + i % 26)}{chr(97 + i % 7)}") for i in range(900)]
    assert learned(plain + [(1, "vile")] * 5 + [(1, "foul")] * 6) == {"vile", "foul"}
    assert learned(plain * 3 + [(1, "foul")] * 900 + [(1, "vile")] * 12) == {"vile", "foul"}
    assert not learned([(int(i % 2 == 0), "x" + "abcdefghij"[i // 3 % 10] + "abcdefghij"[i // 30 % 10]) for i in range(900)])


def test_least_evidence_counts_what_could_pass():
    assert toxicity.least_evidence({1: 10**9, 5: 100}, 0.1) == pytest.approx(np.log(100)) and toxicity.least_evidence({}, 0.1) == np.inf
    assert toxicity.evidence(5, 5, 0.1) == pytest.approx(5 * np.log(10)) and toxicity.evidence(1, 10, 0.1) == pytest.approx(0)


def test_beginnings_of_several_words_of_a_text():
    assert {"ache***", "ache**", "ache*"} <= set(toxicity.features("achea acheb achea")) and "ache***" not in toxicity.features("achea acheb")
    detector = toxicity.Detector(np.zeros(toxicity.SYMBOLS**3, np.int64), {"ache***": 5.0}, [0.0] * 4).opened()
    assert [detector.hits(t)[0] for t in ("achea acheb achea", "achea acheb", "ache")] == [1, 0, 0]
    assert toxicity.word_list({"ache**": (9, 9), "ache***": (8, 8), "achea": (5, 5), "idio**": (4, 4), "idiot": (8, 8)}).keys() == {"ache**", "idiot"}


def test_viterbi_equals_trying_all_readings():
    rng = np.random.default_rng(2)
    model = toxicity.CharModel(rng.integers(0, 50, toxicity.SYMBOLS**3), {}).opened()

    def cost(readings):
        a = b = 0
        total = 0.0
        for letters, c in [*readings, (" ", 0.0)]:
            total += c
            for s in toxicity._symbols(letters):
                total += model.log[a][b][s]
                a, b = b, s
        return total

    import itertools

    for span in ("1d10t", "a-b", "looooser", "p4$$"):
        lattice = toxicity.lattice(span)
        best = max(itertools.product(*lattice), key=cost)
        assert model.best(lattice) == "".join(x for x, _ in best).strip()


def disguised(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oieast", "013457"))
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        at = rng.randrange(1, len(word))
        return word[:at] + word[at] * 4 + word[at + 1 :]
    return ".".join(word)


def test_disguised_words_are_restored(detector):
    rng = random.Random(4)
    plain = [w for w in detector.words if not w.endswith("*")]
    assert len(plain) >= 5
    tried = [disguised(w, rng) for w in plain for _ in range(6)]
    caught = [detector.score(f"There was nothing but {t} in the whole place, they said.") >= 0.7 for t in tried]
    assert np.mean(caught) >= 0.8, [t for t, ok in zip(tried, caught, strict=True) if not ok]
    assert detector.score("There was nothing but 3 mail5.example.com and 2nd hand stuff in the whole place, 100% sure.") < 0.7


def test_toxicity_awkward(spark, detector):
    docs = documents(spark, AWKWARD + [(60, "a1" * 30_000)])
    out = {(r["doc_id"], r["text"]): r["predicted"] for r in toxicity.score(docs, detector).collect()}
    assert not any(out.values())
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, none).filter("score <> 0").count() == 0 and toxicity.score(docs.limit(0), detector).count() == 0


def test_what_is_counted_covers_all_documents(spark):
    docs = documents(spark, [(1, "abc"), (2, "abc"), (None, "abc"), (3, None)])
    counts = toxicity.corpus_counts(docs, "text").reshape((toxicity.SYMBOLS,) * 3)
    assert counts[1, 2, 3] == 3
