"""The pipeline's stages on the smallest tables."""

from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from mapweave.llm import pii

from .helpers import components, shingles


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append((name, before.collect(), docs.collect()))
    stages = {name: (b, a) for name, b, a in seen}

    good = [r for r in stages["quality"][0] if r.doc_id in marks and marks[r.doc_id].quality == 1]
    kept = {r.doc_id for r in stages["quality"][1]}
    assert sum(r.doc_id in kept for r in good) >= 0.95 * len(good)

    before, after = stages["minhash"]
    sets = {r.doc_id: shingles(r.text, 5) for r in before}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in after} == set(components(sets, links).values())

    assert Counter(r.doc_id for r in stages["pii"][0]) == Counter(r.doc_id for r in stages["pii"][1])
    again = pii.digest(spark.createDataFrame(stages["pii"][1], docs.schema)).agg({"n_email": "sum", "n_card": "sum"}).first()
    assert tuple(again) == (0, 0)

    rows = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages["mixing"][1]}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, tokens long, rate double, component_id string, kept int, shares int, __rows int"


def odd_rows(spark, rows):
    return spark.createDataFrame([(i, t, None, None, n, 1.0, "s", 2, 3.0, "c", 0, 5, 6) for i, t, n in rows], ODD)


@pytest.fixture
def small(spark, tmp_path):
    """A folder with a labels table of its own, nulls and both marks for one document included."""
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (3, 1, None), (None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


PROSE = "the quick brown fox jumps over the lazy dog near the river bank at noon"
ROWS = [(1, PROSE, 70), (1, PROSE, 70), (1, PROSE + " once", None), (2, PROSE, 70), (None, PROSE, 70), (None, PROSE, 70), (3, None, None), (4, "", 0), (5, " \n\t", 3), (6, "x" * 30_000, 30_000), (7, "write me@a.org", 14)]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, odd_rows(spark, ROWS), small)
    rows = found.collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "packing":
        assert ids == Counter({1: 3, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: ids[6], 7: 1}) and ids[6] >= 1
        assert sorted(r.length for r in rows if r.doc_id in (3, 4)) == [1, 1]
    else:
        assert found.columns == corpus_pipeline.COLUMNS
        texts = {t for _, t, _ in ROWS}
        if name == "minhash":
            assert ids == Counter({1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
        if name == "pii":
            assert ids == Counter(i for i, _, _ in ROWS)
            assert {(r.text, r.n_chars) for r in rows if r.doc_id in (3, 4, 7)} == {(None, None), ("", 0), ("write <EMAIL>", 13)}
        else:
            assert {r.text for r in rows} <= texts
        if name in ("quality", "mixing"):
            assert {i for i in ids if i != 3} <= {i for i, _, _ in ROWS}
    empty = stage(spark, odd_rows(spark, []), small)
    assert empty.columns == found.columns and empty.count() == 0


def test_repeated_rows_are_one_document(spark, small):
    rows = [(1, PROSE, 1)] * 3 + [(2, "another text of a few words", 2)]
    found = corpus_pipeline.dedup_stage(spark, odd_rows(spark, rows), small).collect()
    assert sorted(r.doc_id for r in found) == [1, 2]
