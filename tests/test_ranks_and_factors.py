"""Places over ranges, exclusive choice by thresholds and singular factors against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.operators import crowd, factors, labels, ranks, spatial


def test_places_of_a_hot_group_as_plain(spark):
    g = random.Random(7)
    rows = [(g.choice([1, 1, 1, 1, 2, None]), float(g.randrange(40)), i) for i in range(3000)]
    found = ranks.numbered(spark.createDataFrame(rows, "country int, score double, id long"), "country", [F.desc("score"), F.asc("id")])
    plain = {}
    for c in (1, 2, None):
        plain |= {i: p for p, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2])), 1)}
    assert {r.id: r.place for r in found.collect()} == plain
    assert found.columns == ["country", "score", "id", "place"]


def test_average_rank_as_plain(spark):
    g = random.Random(8)
    rows = [(g.choice([1, 1, 1, 2]), g.choice([None, *range(9)]), i) for i in range(400)]
    found = labels.average_rank(spark.createDataFrame(rows, "country int, v int, id long"), "country", "v").collect()
    key = lambda v: -1 if v is None else v
    for r in found:
        own = [key(v) for c, v, _ in rows if c == r.country]
        low, ties = 1 + sum(v > key(r.v) for v in own), sum(v == key(r.v) for v in own)
        assert (r.min_rank, r.avg_rank) == (low, low + (ties - 1) / 2)
    assert len(found) == 400


def test_best_of_parts_as_plain(spark):
    g = random.Random(9)
    rows = [(g.choice([1, 1, 1, 2]), g.randrange(50), i) for i in range(900)]
    found = ranks.best(spark.createDataFrame(rows, "country int, v int, id long"), "country", 7, F.desc("v"), F.asc("id"), parts=5)
    for c in (1, 2):
        plain = [i for _, _, i in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))[:7]]
        assert [r.id for r in sorted(found.filter(F.col("country") == c).collect(), key=lambda r: r.place)] == plain


@pytest.mark.parametrize("seed", range(3))
def test_exclusive_choice_with_many_ties_as_the_sequential_one(spark, seed):
    g = random.Random(seed)
    rows = [(c, f"l{i}", float(g.randrange(6))) for c in range(4) for i in range(60) if g.random() < 0.7]
    taken, room = {}, dict.fromkeys(range(4), 5)
    for c, label, score in sorted(rows, key=lambda r: (-r[2], r[1], r[0])):
        if label not in taken and room[c]:
            taken[label], room[c] = c, room[c] - 1
    found = labels.exclusive_top_n(spark.createDataFrame(rows, "country int, label string, score double"), 5)
    assert {r.label: r.country for r in found.collect()} == taken


def test_factors_as_the_dense_decomposition(spark):
    g = np.random.default_rng(5)
    dense = g.normal(size=(60, 6)) @ np.diag([9, 7, 5, 3, 2, 1]) @ g.normal(size=(6, 90)) + 0.05 * g.normal(size=(60, 90))
    rows = [(i, f"l{j:02d}", float(dense[i, j]) / 2) for i in range(60) for j in range(90)] * 2  # weights of a cell add up
    rows += [(None, "l01", 1.0), (3, None, 1.0), (4, "l01", None), (5, "l02", float("nan"))]
    found = factors.label_svd(spark.createDataFrame(rows, "article_id long, label string, weight double"), 5, extra=4).collect()
    left, _, right = np.linalg.svd(dense, full_matrices=False)
    signs = np.sign(right[np.arange(5), np.abs(right[:5]).argmax(axis=1)])
    assert np.allclose(np.array([r.factors for r in sorted(found, key=lambda r: r.article_id)]), left[:, :5] * signs, atol=1e-5)


def test_factors_that_do_not_settle_are_an_error(spark):
    rows = [(i, f"l{j}", float((i * 7 + j * 13) % 11)) for i in range(30) for j in range(30)]
    with pytest.raises(RuntimeError, match="off by"):
        factors.label_svd(spark.createDataFrame(rows, "article_id long, label string, weight double"), 3, extra=0, tolerance=1e-15, max_rounds=1)


@pytest.mark.parametrize("tau", [0.0, 0.5, 10.0, 50.0, 1000.0])
def test_terms_of_the_heat_kernel_leave_next_to_nothing(tau):
    weights = spatial.heat_weights(tau)
    assert 0 <= 1 - sum(weights) < 2e-9 and (tau == 0 or len(weights) > tau)


def test_listed_labels_get_no_place(spark):
    votes = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (1, None, 7), (1, "a", 1), (2, "b", 3)], "country int, label string, points long")
    listed = spark.createDataFrame([("b",), ("b",), (None,)], "label string")
    assert [tuple(r) for r in crowd.top_voted(votes, ["country"], listed).collect()] == [(1, "a", 6, 1)]


def test_stacked_sources_have_every_column(spark):
    a = spark.createDataFrame([("x", 1.5), ("x", 1.5), (None, None)], "label string, tfidf double")
    b = spark.createDataFrame([(7, "y")], "votes long, label string")
    rows = [tuple(r) for r in crowd.stacked(a, b).select("label", "tfidf", "votes").collect()]
    assert sorted(rows, key=str) == sorted([("x", 1.5, 0), ("x", 1.5, 0), (None, 0.0, 0), ("y", 0.0, 7)], key=str)
    assert crowd.stacked(a.limit(0), b.limit(0)).count() == 0


def test_shares_of_all_shown_items(spark):
    rows = [("a", 1, True, True), ("a", 1, True, True), ("a", 1, False, None), ("a", 2, False, True), ("b", 3, True, True), ("c", 4, True, True), ("c", 4, True, True), ("c", 4, False, True), ("c", 4, False, True), ("c", 4, False, True)]
    rows += [(None, 5, True, True), ("a", None, True, True)]
    answers = spark.createDataFrame(rows, "worker string, response int, is_check boolean, flagged boolean")
    # a caught 2 of 4 and flagged 3 of 16, b caught 1 of 2 and flagged 1 of 8, c flagged 5 of 8.
    found = {r.worker: (r.check_share, r.flag_share) for r in crowd.valid_workers_of_all(answers, 2, 8).collect()}
    assert found == {"a": (0.5, 3 / 16), "b": (0.5, 1 / 8)}
    assert crowd.valid_workers_of_all(answers.limit(0), 2, 8).count() == 0
