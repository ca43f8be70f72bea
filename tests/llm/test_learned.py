"""Toxicity, fill-in-middle and Ball k-means against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from mapweave.llm import balls, infill, toxicity
from mapweave.llm.kernels import chunks

from .helpers import noise, rng

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# -- fill in the middle

TEXTS = [None, "", "a", "zwei Wörter", "x<P>y", "tail <M>", "<S>", "line\none\r\n\ttwo\x00", "é" * 70, "\U0001f926\U0001f3fc‍♂️ smile " * 9, "word " * 40_000]


def plain_infill(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def test_infill_as_plain(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(220)] + [(5, TEXTS[5], "x")] * 2
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string, output string")).collect()
    got = sorted((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)) for r in made)
    assert got == sorted((i, plain_infill(i, t)) for i, t, _ in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    texts = {i: t or "" for i, t, _ in rows}
    assert all(infill.restore(r.output, r.form) == texts[r.doc_id] for r in made)


@pytest.mark.parametrize("unit", [r"\X", r"\S+\s*", r"(?m)^.*\n?", "nothing matches this"])
def test_infill_by_other_units(spark, unit):
    rows = [(i, f" {noise(rng(i), 30)}\n{TEXTS[9]}é́ end") for i in range(60)]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=100, spm=50).collect()
    texts = dict(rows)
    for r in made:
        text, ends = texts[r.doc_id], [m.end() for m in regex.finditer(unit, texts[r.doc_id])]
        ends = [0, *ends[:-1], len(text)] if ends else [0]
        assert r.n == len(ends) - 1 and infill.restore(r.output, r.form) == text
        assert r.prefix_chars == ends[r.prefix_units]
        assert r.prefix_chars + r.middle_chars == ends[r.prefix_units + r.middle_units]


def test_infill_marks_that_meet_text_stay_plain(spark):
    marks = infill.Marks("aa", "ab", "b")
    rows = [(i, "a" * (i % 2) + "c" * 20 + "a") for i in range(200)]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), marks=marks, rate=100).collect()
    assert all(infill.restore(r.output, r.form, marks) == dict(rows)[r.doc_id] for r in made)


def test_infill_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, made string")
    assert infill.transform(empty).count() == 0
    odd = infill.transform(spark.createDataFrame([(None, "some text", 1), (None, None, 2)], "doc_id long, text string, n int")).collect()
    assert sorted(r.n for r in odd) == [0, 9] and all(r.doc_id is None for r in odd)


# -- Ball k-means


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))[:k]
    centres = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(rounds, -1, -1):
        own = [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if left:
            for j in range(len(centres)):
                if group := [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]:
                    centres[j] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    per = {j: sum(d for d, o in own if o == j) for _, j in own}
    return sorted(
        ((-1 if i is None else i), j, d, per[j], sum(per.values()), sha(",".join(map(str, centres[j])))) for (i, _), (d, j) in zip(kept, own, strict=True)
    )


def clustered(spark, rows, **more):
    found = balls.cluster(spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, cluster int"), **more)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect())


def vectors_of(seed, n, spread, dims=64):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + spread * g.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_balls_as_plain(spark, spread):
    rows = vectors_of(3, 300, spread)
    assert clustered(spark, rows) == plain_clusters(rows)


def test_balls_with_ties_copies_and_odd_rows(spark):
    g = rng(5)
    small = [(i, [float(g.randrange(2)) for _ in range(64)]) for i in range(40)]
    odd = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [1.0] * 63 + [float("nan")]), (104, [float("inf")] * 64), (105, []), (None, [0.5] * 64), (None, [0.25] * 64)]
    rows = small + small[:20] + [(7, small[9][1])] + odd + [(200 + i, [0.0] * 64) for i in range(30)]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_balls_with_fewer_vectors_than_clusters(spark):
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []
    rows = vectors_of(4, 5, 1.0)
    assert clustered(spark, rows) == plain_clusters(rows)
    short = vectors_of(4, 30, 1.0, dims=3)
    assert clustered(spark, short, k=4, rounds=5, dims=3) == plain_clusters(short, 4, 5, 3)


def test_balls_beyond_whole_numbers_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, [(1, [1e30] * 64)])


def test_balls_leave_out_far_centroids():
    g = np.random.default_rng(1)
    centres = [[1000 * i, 0] for i in range(10)]
    x = np.vstack([np.array(c) + g.integers(-9, 10, (50, 2)) for c in centres])
    own = np.repeat(np.arange(10), 50)
    found, best, work = balls.Balls.of(centres, [14] * 10).assign(x, own)
    assert (found == own).all() and work == len(x)  # only the own centroid was looked at
    assert (best == ((x - np.array(centres)[own]) ** 2).sum(axis=1)).all()
    same, _, more = balls.Balls.of(centres, [None] * 10).assign(x, np.zeros(len(x), int))
    assert (same == own).all() and more < 8 * len(x)  # 10 * len(x) would be all of them


# -- toxicity

WORDS = regex.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def plain_terms(text):
    words = WORDS.findall((text or "").lower())
    found = {("word", w) for w in words}
    found |= {(n, w[:n]) for w in words for n in (4, 5) if len(w) > n}
    return found | {(d, a, b) for d in (1, 2, 3) for a, b in zip(words, words[d:], strict=False)}


def places_of(texts, bits):
    import pyarrow as pa

    out = {}
    for start, end, data, offsets in chunks(toxicity._lower(pa.array(texts, pa.string()))):
        for row, place in toxicity.terms(data, offsets, bits):
            for r, p in zip(row.tolist(), place.tolist(), strict=True):
                out.setdefault(start + r, set()).add(p)
        assert end <= len(texts)
    return [out.get(i, set()) for i in range(len(texts))]


def test_terms_as_plain():
    texts = ["You, YOU idiot! you idiot...", None, "", "Größe größer am größten; groß", "a", "ab12 abcd abcde abcdef", "x y z x y z", "日本語テスト 日本語テ"]
    got = places_of(texts, 40)
    plain = [plain_terms(t) for t in texts]
    assert [len(g) for g in got] == [len(p) for p in plain]  # 40 bits: no two terms meet
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(plain[i] & plain[j])


def plain_fit(rows, rates, n_rows):
    """rows: (mark, batch, places). Coordinate by coordinate, as the formulas say."""
    l1 = rates.l1 * math.sqrt(n_rows)
    positive = sum(m for m, _, _ in rows)
    start = math.log((positive + 0.5) / (n_rows - positive + 0.5))
    z, n = {}, {}

    def weight(p):
        bound = 0 if p < 0 else l1
        if abs(z.get(p, 0)) <= bound:
            return 0.0
        return -(z[p] - math.copysign(bound, z[p])) / ((rates.beta + math.sqrt(n[p])) / rates.alpha + rates.l2)

    for step in range(rates.passes * rates.batches):
        g = {}
        for mark, batch, places in rows:
            if batch == step % rates.batches:
                error = 1 / (1 + math.exp(-(start + weight(-1) + sum(weight(p) for p in places)))) - mark
                for p in (-1, *places):
                    g[p] = g.get(p, 0) + error
        old = {p: weight(p) for p in g}
        for p, x in g.items():
            before = n.get(p, 0.0)
            n[p] = before + x * x
            z[p] = z.get(p, 0.0) + x - (math.sqrt(n[p]) - math.sqrt(before)) / rates.alpha * old[p]
    return start + weight(-1), {p: weight(p) for p in z if p >= 0 and weight(p) != 0}


def test_ftrl_as_plain(spark):
    g = rng(8)
    rows = []
    for _ in range(120):
        mark = int(g.random() < 0.3)
        places = sorted({g.randrange(60) for _ in range(12)} | ({63} if mark and g.random() < 0.9 else set()))
        rows.append((mark, g.randrange(2), places))
    rows.append((0, 1, []))
    rates = toxicity.Rates(l1=0.2, batches=2, passes=3)
    w = toxicity.fit(spark.createDataFrame(rows, "mark int, batch int, places array<int>"), 6, rates)
    bias, expected = plain_fit(rows, rates, len(rows))
    assert w.bias == pytest.approx(bias, abs=1e-9)
    assert dict(zip(w.places.tolist(), w.values.tolist(), strict=True)) == pytest.approx(expected, abs=1e-9)
    assert 63 in expected and len(expected) < 40
    with pytest.raises(RuntimeError, match="more than 1 weights"):
        toxicity.fit(spark.createDataFrame(rows, "mark int, batch int, places array<int>"), 6, rates, most_weights=1)


def corpus(n=400):
    g, docs, marks = rng(11), [], []
    for i in range(n):
        words, bad = noise(g, 30 + g.randrange(200), 900).split(), g.random() < 0.25
        for _ in range(bad * (1 + g.randrange(4))):
            words.insert(g.randrange(len(words)), g.choice(["Grumpf!", "zonk", "blargh", "flimmer" + g.choice(["en", "st", "te"])]))
        docs.append((i, " ".join(words), "en"))
        marks.append((i, int(bad)))
    return docs, marks


def test_toxicity_on_held_out_rows(spark):
    docs, marks = corpus()
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, score string"), labels).collect()
    truth = dict(marks)
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert 80 < len(held) < 200
    assert not [r for r in held if r.predicted and not truth[r.doc_id]]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    assert sum(caught) >= 0.85 * len(caught)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, score string"), turned).collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in again) == sorted((r.doc_id, round(r.score, 9)) for r in rows)


def test_toxicity_of_a_bounded_sample(spark):
    docs, marks = corpus()
    own, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    sample = toxicity.labelled(own, labels, F.lit(False), "toxic", 100, 4, 20)
    assert 50 < sample.count() < 160
    assert toxicity.score(own, labels, most_labelled=100, rates=toxicity.Rates(passes=1)).count() == len(docs)


def test_toxicity_of_odd_rows(spark):
    docs, marks = corpus(80)
    docs += [(None, "zonk", "en"), (900, None, "en"), (901, "", None), (902, "?!", "en"), (903, "zonk " * 50_000, "en"), (3, docs[3][1], "en"), (904, "a" * 300_000, "en")]
    marks += [(None, 1), (3, None), (3, 1 - marks[3][1]), (901, 0), (5000, 1)]
    own = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, place int, mark int")
    rows = toxicity.score(own, spark.createDataFrame(marks, "doc_id long, toxic int"), rates=toxicity.Rates(passes=1)).collect()
    assert len(rows) == len(docs)
    bare = {r.doc_id: r.score for r in rows}
    assert bare[900] == bare[901] == bare[902]
    assert not [r for r in rows if r.doc_id is None][0].held_out
    none = toxicity.score(own, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert toxicity.score(own.limit(0), spark.createDataFrame(marks, "doc_id long, toxic int"), rates=toxicity.Rates(passes=1)).count() == 0
