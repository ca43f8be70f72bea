"""What a step shuffles, and what it needn't read."""

from pyspark.sql import functions as F

from mapweave.operators import cluster, topics
from mapweave.operators.labels import label_counts, listed_counts
from mapweave.plans.registry import article_labels, label_lists


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_neighbour_clusters_read_no_labels(spark):
    rows = spark.createDataFrame([(i, [1.0 + i, float(i % 2)], float(i), 0.0) for i in range(12)], "article_id long, vector array<double>, x double, y double")
    near = spark.createDataFrame([(i, (i + 2) % 12) for i in range(12)], "id long, other long")
    found = cluster.joint_kmeans(rows, None, 2, plane_weight=0.0, label_sign=1, neighbours=near).collect()
    assert sorted(r.article_id for r in found) == list(range(12))


def test_passes_hold_their_batches_and_add_up_by_blocks(spark):
    held = cluster._blocks(spark.range(5000).select(F.col("id").cast("double").alias("x")))
    assert held.is_cached and max(b.num_rows for b in held.collect()) <= 1024
    told = lambda batch, sent: batch.column(0).to_numpy().sum() * sent
    for block in (8, 2):
        assert list(cluster._totals(held, told, cluster.np.arange(5.0), 5, block)) == [4999 * 2500 * i for i in range(5)]
    held.unpersist()


def test_labels_of_unique_documents_are_not_shuffled(spark, tmp_path):
    folder = _documents(spark, tmp_path, [(1, "Red red apple"), (2, None), (3, "a b"), (4, "apple tree")])
    assert "Exchange" not in _plan(article_labels(spark, folder))
    assert {(r.article_id, r.label) for r in article_labels(spark, folder).collect()} == {(1, "red"), (1, "apple"), (4, "apple"), (4, "tree")}


def test_labels_of_repeated_documents_come_once(spark, tmp_path):
    folder = _documents(spark, tmp_path, [(1, "red apple"), (1, "apple tree"), (2, "tree"), (None, "void"), (None, "void")])
    found = sorted((str(r.article_id), r.label) for r in article_labels(spark, folder).collect())
    assert found == [("1", "apple"), ("1", "red"), ("1", "tree"), ("2", "tree"), ("None", "void")]
    of = spark.createDataFrame([(2,), (2,), (None,)], "article_id long")
    assert [(r.article_id, r.labels) for r in label_lists(spark, folder, of).collect()] == [(2, ["tree"])]


def test_counts_of_lists_are_those_of_labels(spark):
    lists = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "b"]), (2, 0, ["a", None]), (3, 1, []), (4, None, ["a"]), (5, 1, None), (None, 1, ["c"]), (6, 1, [None])], "article_id long, country int, labels array<string>")
    flat = lists.select("article_id", F.explode("labels").alias("label")).distinct()
    found, expected = (sorted(map(tuple, df.select(*listed_counts(lists).columns).collect())) for df in (listed_counts(lists), label_counts(flat, lists.select("article_id", "country"))))
    assert found == expected


def test_runs_of_a_document_are_counted_in_its_row(spark):
    texts = ["a b a b a b a b c", "x " * 9 + "a b c " * 4, "", "q r s " * 3]
    words = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)] + [(8, ["a", None, "b"] * 5), (9, None)], "doc_id long, w array<string>")
    columns = ["doc_id", "phrase", "length", "tf", "all", "long"]
    for seen, cutoff in ((4, 200), (3, 2), (2, 5)):
        found, expected = (sorted(map(tuple, f(words, 3, seen, cutoff).select(*columns).collect())) for f in (topics._runs_by_row, topics._runs_by_document))
        assert found == expected and found
    assert "Exchange" not in _plan(topics._runs_by_row(words, 3, 4, 200))
