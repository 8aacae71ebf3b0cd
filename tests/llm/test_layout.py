"""Fill-in-the-middle, vector codes and packing: against brute force on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import fim, packing, registry, vector_codes
from lakeforge.llm.bpe import default_path
from tests.conftest import DATA

from .test_exact import AWKWARD, documents

MIXED = "日本語 text — ñandú 𝔘𝔫𝔦 "


# -- fill in the middle -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("density", [0.0, 0.001, 0.03, 0.3, 0.9, 1.0])
def test_boundary_set_selects_like_a_list(density):
    rng = np.random.default_rng(int(density * 1000))
    mask = rng.random(200_000) < density
    mask[70_000:140_000] = True  # a run over a container's edge
    found, places = fim.BoundarySet(mask), np.flatnonzero(mask)
    assert len(found) == len(places)
    assert [found.select(int(k)) for k in range(0, len(places), 97)] == places[::97].tolist()


def test_containers_of_every_kind():
    array, run, bitmap = np.zeros(65536, bool), np.ones(65536, bool), np.arange(65536) % 3 == 0
    array[::1000] = True
    for mask, kind in ((array, "array"), (run, "run"), (bitmap, "bitmap")):
        got, parts, size = fim.container(mask)
        assert got == kind and size == mask.sum()
        assert [fim.LOCAL[kind](parts, k) for k in range(size)] == np.flatnonzero(mask).tolist()


def fim_by_hand(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fim_awkward(spark):
    rows = [*AWKWARD, *((100 + i, MIXED * i) for i in range(60)), (200, "a <P> b"), (201, "<S>"), (202, "<<M"), (203, MIXED * 9000), (204, "<P" * 50), (205, ">"), (206, "é" * 70_000), (206, "é" * 70_000)]
    docs = documents(spark, rows).withColumns({"form": F.lit("x"), "n": F.lit("y"), "output": F.lit(None)})
    made = fim.transform(docs)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert set(made.columns) == set(docs.columns) | {"n", "form", "prefix_chars", "middle_chars", "output"}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *fim_by_hand(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_fim_by_words_and_lines(spark):
    rows = [(i, f"line {i}\n  two  words\tand\n\nmore {MIXED}" * (i + 1)) for i in range(40)] + [(50, "\n"), (51, " "), (52, "x")]
    for unit in ("word", "line"):
        got = fim.transform(documents(spark, rows), unit=unit).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert all(r.back == r.text for r in got)
        for r in got:
            starts = [0, *(i for i in range(1, len(r.text)) if (r.text[i - 1] == "\n" if unit == "line" else r.text[i - 1].isspace() and not r.text[i].isspace())), len(r.text)]
            assert r.n == len(starts) - 1
            assert r.form == "plain" or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= set(starts)


# -- vector codes -----------------------------------------------------------------------------------------------------
def lloyd_by_hand(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine: dict = {}
            for _, v in kept:
                mine.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in mine.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v in kept]
    return sorted((str(i), "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b)) for (i, _), b in zip(kept, best, strict=True)), books


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, code string, x int").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_vector_codes_equal_plain_lloyd(spark, seed):
    rng = random.Random(seed)
    # few different values, so that distances tie and entries repeat
    rows = [(i if i % 9 else 7, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.001, 2.0]) for _ in range(8)]) for i in range(90)]
    rows += [(None, [0.1] * 8), (500, None), (501, [None] + [0.0] * 7), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (504, [1.0] * 4), (505, []), (506, [1e30] * 8)]
    coded, books = vector_codes.quantise(vectors(spark, rows), parts=4, entries=12, rounds=4)
    wanted, plain = lloyd_by_hand([r for r in rows if r[0] not in (504, 506)], 4, 12, 4)
    assert sorted((str(r.vec_id), r.code, r.error) for r in coded.collect()) == wanted
    assert books.entries.tolist() == plain


def test_vector_codes_awkward(spark):
    empty, books = vector_codes.quantise(vectors(spark, [(1, None), (2, [])]))
    assert empty.count() == 0 and books.text() == "" and empty.columns == ["vec_id", "code", "error"]
    one, _ = vector_codes.quantise(vectors(spark, [(1, [0.5] * 8)] * 5), keep=("vec_id", "x", "code"))
    assert [(r[2], r.error) for r in one.collect()] == [("x", 0)] * 5
    with pytest.raises(ValueError):
        vector_codes.quantise(vectors(spark, [(1, [0.5] * 6)]))


def test_active_entries_are_compared_alone():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (3000, 4, 3))
    books = vector_codes.Codebooks(x[:40].transpose(1, 0, 2))
    index, distance, whole = vector_codes.assign(x, books, None, None)
    assert whole == 12_000
    shares = []
    for _ in range(12):
        count, total = np.zeros((4, 40), np.int64), np.zeros((4, 40, 3), np.int64)
        vector_codes.sums_of(x, index, count, total)
        books = books.after({(p, k): (int(count[p, k]), total[p, k].tolist()) for p, k in zip(*np.nonzero(count), strict=True)})
        index, distance, whole = vector_codes.assign(x, books, index, distance)
        plain = [vector_codes.nearest(x[:, p], books.entries[p]) for p in range(4)]
        assert (index == np.stack([i for i, _ in plain], 1)).all() and (distance == np.stack([d for _, d in plain], 1)).all()
        shares.append(whole / 12_000)
    assert shares[-1] < 0.9 and min(shares) == shares[-1]  # fewer and fewer parts meet all entries


def test_whole_number_products_beyond_floats():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 16)), rng.integers(-(1 << 27), 1 << 27, (20, 16))
    index, distance = vector_codes.nearest(x, c)
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c)) for v in x]
    assert [(d, k) for d, k in zip(distance.tolist(), index.tolist(), strict=True)] == exact


def test_group_totals(spark):
    frame = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 0, 7), (4, 1, 8)], "vec_id int, label int, error bigint")
    wanted = {1: 11, 2: 11, 3: 7, 4: 8}
    assert {r.vec_id: r.t for r in vector_codes.with_total(frame, "label", "error", "t").collect()} == wanted
    sent, vector_codes.MOST_SENT = vector_codes.MOST_SENT, 1
    try:
        assert {r.vec_id: r.t for r in vector_codes.with_total(frame, "label", "error", "t").collect()} == wanted
    finally:
        vector_codes.MOST_SENT = sent


# -- packing ----------------------------------------------------------------------------------------------------------
def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_padding()
    t.no_truncation()
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def held(pieces, rows, window):
    """Pieces lie gapless in full windows, in order in their documents, and hold the library's ids."""
    by_window, by_doc = {}, {}
    for r in pieces:
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((str(r.id), r.position), []).append(r)
    for s, own in by_window.items():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
        assert sum(n for _, n in own) == window or s == max(by_window)
    assert sorted(by_window) == list(range(len(by_window)))
    wanted = sorted((str(i), ids) for (i, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True))
    got = []
    for (i, _), own in by_doc.items():
        own.sort(key=lambda r: r.start)
        ids = [x for r in own for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.doc_tokens == len(ids) and r.length > 0 for r in own)
        got.append((i, ids))
    assert sorted(got) == wanted


@pytest.mark.parametrize("window", [1, 7, 2048])
@pytest.mark.parametrize("sent", [True, False])
def test_packing_awkward(spark, window, sent, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SENT", 1 << 18 if sent else 0)
    monkeypatch.setattr(packing, "BLOCK", 2)
    rows = [(i, t[:3000] if t and window == 1 else t) for i, t in AWKWARD] + [(20, "<|endoftext|> a<|startoftext|>b"), (21, MIXED * 50), (22, "A B\x1cC\x85D E Σ́ΑΣ")]
    run = packing.encoded(documents(spark, rows), default_path())
    made = packing.pieces(run, window).collect()
    held(made, rows, window)
    whole = [x for r in sorted(run.collect(), key=lambda r: r.position) for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    begun = {r.position for r in made}
    for r in packing.sequences(run, window).collect():
        at = r.sequence_id * window
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == whole[at : at + window] and r.length == len(whole[at : at + window])
        assert [at + s for s in r.starts] == sorted(p for p in begun if at <= p < at + window)


def test_packing_of_nothing(spark):
    run = packing.encoded(documents(spark, AWKWARD).limit(0), default_path())
    assert packing.pieces(run).count() == 0 and packing.sequences(run).count() == 0


def test_stretches_equal_the_library_on_random_texts(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 300)  # the table is cleared again and again
    rng, letters = random.Random(4), "abcXYZ  \t\n\r\x0b\x0c'’.,!?0123éÉñßΣσ日本ا́ \x1c\x85 😀<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(600)] + ["<|endoftext|>'s  I'LL", "q" * 500 + " " + "q" * 500]
    table = packing.StretchTable(default_path())
    for a in range(0, len(texts), 50):
        some = [t.encode() for t in texts[a : a + 50]]
        ids, at = table.encode(np.frombuffer(b"".join(some), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in some]))), 1)
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == library_ids(texts[a : a + 50])


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_packing"](spark, DATA).collect()
    ids = {i: x for (i, _), x in zip(docs, library_ids([t for _, t in docs]), strict=True)}
    assert all(r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length <= 2048 - r.offset for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids.values())) and max(r.sequence_id for r in got) == (sum(map(len, ids.values())) - 1) // 2048
