"""What the review of round 4 found: sums in order, steps without a limit."""

import inspect
import random

import pytest

from mapweave.llm import embedding
from mapweave.operators import cluster, labels, topics, voronoi
from mapweave.runtime import materialize, release


def test_sums_in_order_round_as_one_scan_does(spark):
    g = random.Random(3)
    rows = [(i, g.choice([1, 2, 3, None]), g.choice([0.1, 0.2, 0.3, 1e15, -1e15, None])) for i in range(4000)]
    shuffled = g.sample(rows, len(rows))
    found = labels.summed_in_order(spark.createDataFrame(shuffled, "at long, k int, x double").repartition(7), "k", "x", "at").collect()
    plain = {}
    for _, k, x in rows:
        if k is not None and x is not None:
            plain[k] = plain.get(k, 0.0) + x
    assert {r.k: r.total for r in found} == plain and len(found) == 3
    empty = spark.createDataFrame([], "at long, k int, x double")
    assert labels.summed_in_order(empty, "k", "x", "at").count() == 0


def test_popularity_ranks_tell_equal_sums_apart_as_the_sql_does(spark, tmp_path):
    import duckdb

    import __spark_entry__

    # ten times 0.1 is less than 1.0 when added one after another: user 1 comes after user 2, though the exact sums are equal
    events = [(i, 1, 0.1) for i in range(10)] + [(10, 2, 1.0)] + [(11, 3, 0.7)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, value double").selectExpr("*", "timestamp'2024-01-01' as ts")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("topup_popular", "popularity_buckets"):
        con = duckdb.connect()
        for t in ("events", "embeddings"):
            con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        expected = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
        found = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(found) == sorted(expected), name
    assert [r[0] for r in sorted(expected, key=lambda r: -r[2])] == [2, 1, 3]


def test_kmeans_takes_as_many_steps_as_it_takes(spark):
    # a chain of 400 points on an arc, two seeds at one end: the border moves along it in small steps
    import math

    import numpy as np

    at = [math.pi / 2 * (i / 400) ** 2 for i in range(400)]
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(at)]
    x, centres, steps = np.array([v for _, v in rows]), np.array([v for _, v in rows[:6]]), 0
    while True:
        group = (x @ (centres / np.linalg.norm(centres, axis=1)[:, None]).T).argmax(axis=1)
        moved = np.array([x[group == c].sum(axis=0) / ((group == c).sum() + 1e-6) for c in range(6)])
        steps, shift, centres = steps + 1, np.abs(moved - centres).sum(axis=1).max(), moved
        if shift < 1e-12:
            break
    frame = spark.createDataFrame(rows, "article_id long, vector array<double>").coalesce(1)
    with pytest.raises(RuntimeError, match=f"after {steps - 2} steps"):
        cluster.kmeans_cosine(frame, 6, max_iterations=steps - 2, tolerance=1e-12)
    found, _ = cluster.kmeans_cosine(frame, 6, tolerance=1e-12)
    assert {r.article_id: r.country for r in found.collect()} == dict(enumerate(group.tolist()))


def test_no_clustering_has_a_limit_of_steps():
    for f in (cluster.kmeans_cosine, cluster.joint_kmeans):
        assert inspect.signature(f).parameters["max_iterations"].default is None
    assert [n for n, _ in zip(cluster._steps(None), range(1000))][-1] == 999 and list(cluster._steps(2)) == [0, 1]


def test_steps_that_go_round_in_a_circle_are_told():
    import numpy as np

    circle = cluster._Circle()
    for step, x in enumerate([1.0, 2.0, 3.0, 2.5]):
        circle.check(step, np.array([[x, 0.0]]))
    with pytest.raises(RuntimeError, match="never rest"):
        circle.check(4, np.array([[2.0, -0.0]]))


@pytest.mark.parametrize("window", [2, 4])
def test_text_rank_over_arrays_is_the_plain_loop(spark, window):
    g = random.Random(5)
    docs = [(i, [g.choice("abcdefghijklmno") * g.choice([1, 2]) for _ in range(g.choice([0, 1, 2, 3, 40, 300]))]) for i in range(150)]
    found = {}
    for r in topics.text_rank(spark.createDataFrame(docs, "doc_id long, words array<string>"), window=window).collect():
        found.setdefault(r.doc_id, []).append((r.word, r.score))
    for doc, words in docs:
        near = {}
        for i, a in enumerate(words):
            for b in words[i + 1 : i + window]:
                if a != b:
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
        score = dict.fromkeys(near, 1.0)
        for _ in range(30):
            score = {w: 0.15 + 0.85 * sum(score[v] / len(near[v]) for v in near[w]) for w in near}
        plain = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:10]
        assert [w for w, _ in found.get(doc, [])] == [w for w, _ in plain], doc
        assert [s for _, s in found.get(doc, [])] == pytest.approx([s for _, s in plain])
    # words that are null and equal scores: by letters, null last (this raised an error before)
    odd = spark.createDataFrame([(1, ["b", None, "a"]), (2, None), (3, []), (None, ["y", "x"])], "doc_id long, words array<string>")
    assert sorted(((r.doc_id, r.word) for r in topics.text_rank(odd, window=3).collect()), key=str) == [(1, "a"), (1, "b"), (1, None), (None, "x"), (None, "y")]


def test_phrases_in_rows_are_those_by_joins(spark):
    g = random.Random(8)
    docs = [(i % 50, [g.choice(["new", "york", "city", "of", "new", "york", "x", f"r{g.randrange(300)}", None]) for _ in range(g.choice([0, 1, 2, 60, 200]))]) for i in range(80)] + [(None, None), (7, ["new", "york"] * 5)]
    frame = spark.createDataFrame(docs, "doc_id long, w array<string>").coalesce(2).cache()
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    for least, threshold in ((5, 0.01), (3, 0.02), (10, -1.0)):
        sent, joined = (key(topics.collocations(frame, least, threshold, most_words=m).collect()) for m in (1000, 0))
        assert sent == joined and sent
        sent, few, joined = (key(topics.with_phrases(frame, least, threshold, m, n).collect()) for m, n in ((1000, 1000), (1000, 0), (0, 0)))
        assert sent == joined == few and any("_" in str(w) for _, w in sent)


def test_phrases_shuffle_no_word_of_a_document(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(40)], "doc_id long, w array<string>")
    plan = topics.with_phrases(docs, 5, 0.001)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("least", [0.8, 0.95])
def test_embedding_blocks_meet_where_they_are_read(spark, least):
    import numpy as np

    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 5))
    rows = [(i, (centres[i % 12] + r.normal(size=5) * r.uniform(0.02, 0.6)).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= least).sum(axis=1) - 1
    by_read, by_join = (sorted(map(tuple, embedding.near_duplicates(frame, least, block_rows=16, most_blocks=m).collect())) for m in (8192, 0))
    assert by_read == by_join and [row[1] for row in by_read] == links.tolist() and links.max() > 5


def test_embedding_blocks_are_not_shuffled_for_pairs(spark, tmp_path):
    blocks = spark.createDataFrame([([2, 0, 0], p, [p], [b"0" * 16], [1]) for p in range(4)], "cell array<int>, part int, ids array<long>, units array<binary>, weights array<long>")
    blocks.write.parquet(f"{tmp_path}/blocks")
    pairs = embedding._block_pairs(spark.read.parquet(f"{tmp_path}/blocks"), 2, 100)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan and pairs.count() == 10


def test_relief_goes_by_numbers_and_leaves_no_table_of_a_round(spark, monkeypatch):
    kinds, collected, held = set(), [], {}

    def kept(df, name, *more, **how):
        table = materialize(df, name, *more, **how)
        if name in ("heights", "front"):
            kinds.add(dict(df.dtypes)["corner"])
            collected.append(how.get("collect", True))
            held[id(table)] = table
        return table

    def gone(*tables):
        release(*tables)
        for t in tables:
            held.pop(id(t), None)

    monkeypatch.setattr(voronoi, "materialize", kept)
    monkeypatch.setattr(voronoi, "release", gone)
    edges = [(0, 1, "c0", "c1", True)] + [(0, 1, f"c{i}", f"c{i + 1}", False) for i in range(1, 10)]
    centres = spark.createDataFrame([(0, 1), (1, 2)], "id long, country int")
    corners, _ = voronoi.relief(centres, spark.createDataFrame(edges, "a long, b long, v string, w string, is_border boolean"), 10)
    found = {r.corner: r.elevation for r in corners.collect()}
    assert found["c0"] == found["c1"] == 0 and len(found) == 11
    assert all(1.01 <= found[f"c{i + 1}"] - found[f"c{i}"] < 2.01 for i in range(1, 10))
    assert kinds == {"bigint"} and sum(collected) == 2  # the first table and the eighth round
    assert len(held) <= 3  # the heights, the last front and the empty one that ends the rounds
