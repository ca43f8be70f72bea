"""Steps whose work or results depended on the size or the order of the tables."""

import math

import pytest

from mapweave.operators import cluster, crowd, labels, topics


def test_unit_tf_idf_counts_pairs_without_making_them(spark):
    n = 300_000  # 9e10 pairs
    rows = spark.range(n).selectExpr("'p' project", "1 cluster", "if(id % 3 = 0, 'a', 'b') label", "cast(id as string) article")
    found = {r.label: r.tfidf for r in crowd.unit_tf_idf(rows.select("project", "cluster", "label"), rows.select("project", "cluster", "article")).collect()}
    for label, own in (("a", n // 3), ("b", n - n // 3)):
        assert found[label] == pytest.approx(own * n / (n * n + 1) * math.log(n / (own * n + 10)))


def test_exact_sums_tie_in_any_order(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.3), (1, 0.2), (1, 0.1), (2, 1e300), (2, 0.5), (3, float("nan")), (3, 1.0)], "g int, x double").coalesce(1)
    found = {r.g: r.s for r in rows.groupBy("g").agg(labels.exact_sum("x").alias("s")).collect()}
    assert found[0] == found[1] == 0.6
    assert found[2] == 1e300 and math.isnan(found[3])


def test_vectors_without_a_cosine_move_no_centre(spark):
    rows = [(0, None), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.1, 0.8]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [None, 1.0])]
    found, centres = cluster.kmeans_cosine(spark.createDataFrame(rows, "article_id long, vector array<double>"), 2)
    assert centres == [pytest.approx([0.95, 0.05], abs=1e-5), pytest.approx([0.05, 0.9], abs=1e-5)]
    assert {r.article_id: r.country for r in found.collect() if r.article_id in (1, 2, 3, 4)} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert found.count() == len(rows)


@pytest.mark.parametrize("two_stages", [False, True])
def test_joint_kmeans_is_the_same_by_sent_sums_and_by_joins(spark, two_stages):
    import numpy as np

    rng = np.random.default_rng(5)
    n, k = 40, 3
    v, xy, m = rng.random((n, 4)), rng.random((n, 2)), (rng.random((n, 30)) < 0.4) * rng.random((n, 30))
    rows = spark.createDataFrame([(i, v[i].tolist(), *xy[i].tolist()) for i in range(n)], "article_id long, vector array<double>, x double, y double")
    weights = spark.createDataFrame([(int(i), f"l{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "article_id long, label string, weight double")
    sent, joined = ({r.article_id: (r.country, round(r.distance, 9)) for r in cluster.joint_kmeans(rows, weights, k, two_stages=two_stages, most_sums=most).collect()} for most in (10_000, 0))
    assert sent == joined and len(sent) == n


def test_mixtures_shuffle_only_the_shares(spark):
    shares = spark.createDataFrame([(1, 0, 0.75), (1, 1, 0.25), (2, 1, 1.0), (3, 9, 1.0)], "doc_id long, topic int, prob double")
    words = spark.createDataFrame([(0, "b", 0.5), (0, "a", 0.5), (1, "c", 1.0), (1, "zero", 0.0)], "topic int, word string, prob double")
    found = topics.lda_mixture(shares, words, 3)
    assert sorted((r.doc_id, r.place, r.word, r.prob) for r in found.collect()) == [(1, 1, "a", 0.375), (1, 2, "b", 0.375), (1, 3, "c", 0.25), (2, 1, "c", 1.0), (2, 2, "zero", 0.0)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_keywords_of_more_documents_than_are_held_at_once(spark):
    docs = spark.createDataFrame([(i, None if i == 70 else ["tea", "milk", f"w{i}"]) for i in range(150)], "doc_id long, words array<string>").coalesce(1)
    found = topics.text_rank(docs, top=1).collect()
    assert sorted(r.doc_id for r in found) == [i for i in range(150) if i != 70] and {r.word for r in found} == {"milk"}


def test_changes_add_up_alike_with_and_without_a_shuffle(spark):
    import numpy as np

    from mapweave.operators import cluster

    rows = spark.range(0, 5000, 1, 4)
    told = lambda batch, sent: (np.array([batch.num_rows, 1.0])[:2] * [1, 0], batch.column(0).to_numpy() % sent, np.ones(batch.num_rows))
    for few in (0, 10, 10_000):  # by Spark, too many for the driver and so by Spark, by the driver
        total, at, by = cluster._changes(rows, told, 70, 2, few)
        assert total.tolist() == [5000, 0]
        assert dict(zip(at.tolist(), by.tolist(), strict=True)) == {i: len(range(i, 5000, 70)) for i in range(70)}
    _, at, _ = cluster._changes(rows, lambda batch, sent: (np.zeros(2), np.zeros(0, int), np.zeros(0)), None, 2, 10)
    assert not len(at)  # what doesn't change doesn't travel


def test_packed_lists_are_the_same_numbers():
    import numpy as np
    import pyarrow as pa

    from mapweave.operators import cluster

    lists = pa.array([[1.5, 2.0], None, [], [3.0]], pa.list_(pa.float64()))
    for part in (lists, lists.slice(1), lists.slice(1, 2)):
        values, size = cluster._unpacked(cluster._packed(part), np.float64)
        assert values.tolist() == [x for row in part.to_pylist() for x in row or []] and size.tolist() == [len(row or []) for row in part.to_pylist()]
    packed = cluster._packed(lists)
    assert cluster._unpacked(packed.slice(3), np.float64)[0].tolist() == [3.0] and cluster._unpacked(packed.slice(0, 0), np.float64)[0].tolist() == []
