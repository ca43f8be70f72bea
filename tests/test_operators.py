"""Operators on small tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.functions.text import category_name, is_article_title, joined_at, lemma, ngrams, porter_stem, wiki_links, with_word_forms
from mapweave.functions.vectors import cosine_distance
from mapweave.operators import cluster, crowd, labels, metrics, spatial, topics
from mapweave.operators.graph import connected_components
from mapweave.operators.plane import nearest_in_plane
from mapweave.sources import tables


def test_titles(spark):
    titles = ["List of teas", "Apollo 13", "1999 film", "Category:Tea", "Green tea"]
    rows = spark.createDataFrame([(t,) for t in titles], "title string").filter(is_article_title("title"))
    assert [r.title for r in rows.collect()] == ["Green tea"]


def test_category_names(spark):
    rows = spark.createDataFrame([("Books by type",), ("Category:Types of cake",), ("Cheese",)], "c string").select(category_name("c").alias("n"))
    assert [r.n for r in rows.collect()] == ["Books", "cake", "Cheese"]


def test_wiki_links_start_at_the_lead(spark):
    row = spark.createDataFrame([("[[before]] '''Tea''' is a [[drink|hot drink]] of [[China]].",)], "t string").select(wiki_links("t").alias("l")).first()
    assert row.l == ["drink", "China"]


def test_ngrams_and_phrases(spark):
    df = spark.createDataFrame([(["new", "york", "new", "york"],), (["a"],), ([],)], "w array<string>")
    assert [r.n for r in df.select(ngrams("w", 2).alias("n")).collect()] == [["new york", "york new", "new york"], [], []]
    four = df.filter("size(w) = 4")
    assert four.select(joined_at("w", F.array(F.lit(1), F.lit(3))).alias("m")).first().m == ["new_york", "new_york"]
    assert four.select(joined_at("w", F.array(F.lit(2))).alias("m")).first().m == ["new", "york_new", "york"]
    assert [r.m for r in df.select(joined_at("w", F.array().cast("array<int>")).alias("m")).collect()] == [["new", "york", "new", "york"], ["a"], []]


def greedily_joined(words, good):
    out, i = [], 0
    while i < len(words):
        step = 2 if tuple(words[i : i + 2]) in good else 1
        out.append("_".join(words[i : i + step]))
        i += step
    return out


def test_phrases_as_a_greedy_scan(spark):
    import random
    import time

    g = random.Random(6)
    common = ["a", "a", "b", "c", "d"]
    docs = [(i, [g.choice(common) if g.random() < 0.3 else f"w{g.randrange(400)}" for _ in range(g.randrange(60))]) for i in range(60)] + [(7, ["a"] * 9), (None, ["a", "b"]), (100, []), (101, [w for _ in range(50_000) for w in ("long", f"text{g.randrange(3)}")])]
    frame = spark.createDataFrame(docs, "doc_id long, w array<string>")
    good = {(r.a, r.b) for r in topics.collocations(frame, 5, 0.005).collect()}
    assert good
    began = time.time()
    rows = topics.with_phrases(frame, 5, 0.005).collect()
    assert time.time() - began < 60
    number = lambda i: -1 if i is None else i
    got = sorted([number(r["doc_id"]), *r["w"]] for r in rows)
    expected = sorted([number(i), *greedily_joined(w, good)] for i, w in docs)
    assert [len(x) for x in got] == [len(x) for x in expected]
    assert all(a == b for a, b in zip(got, expected, strict=True))


def test_lemmas_need_the_singular(spark):
    words = "glasses glass series buses bus ponies pony churches church wolves wolf women woman news axes ax axe axe class boss s".split()
    found = {r.word: r.lemma for r in topics.lemmas(spark.createDataFrame([(w,) for w in [*words, None]], "word string")).collect()}
    changed = {"glasses": "glass", "buses": "bus", "ponies": "pony", "churches": "church", "wolves": "wolf", "women": "woman", "axes": "axe"}
    assert found == {w: changed.get(w, w) for w in words}


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control")])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_word_forms(spark):
    rows = with_word_forms(spark.createDataFrame([("green teas",), (None,), ("green teas",)], "label string")).collect()
    assert len(rows) == 3
    assert {(r.label, r.stem, r.lemma) for r in rows} == {("green teas", "green tea", "green tea"), (None, None, None)}
    assert lemma("glass") == "glass"


def test_label_counts_drop_nulls(spark):
    l = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, None), (4, "a")], "article_id long, label string")  # noqa: E741
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "article_id long, country int")
    rows = {(r.country, r.label): r for r in labels.label_counts(l, c).collect()}
    assert set(rows) == {(0, "a"), (1, "b")}
    assert rows[0, "a"].clc == 2 and rows[0, "a"].n_country_articles == 2 and rows[0, "a"].n_articles == 3


def greedy(rows, n):
    left, used, out = {}, set(), set()
    for country, label, score in sorted(rows, key=lambda r: (-r[2], r[1], r[0])):
        if label not in used and left.setdefault(country, n) > 0:
            left[country] -= 1
            used.add(label)
            out.add((country, label))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exclusive_labels_equal_the_sequential_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(c, f"l{i}", round(rng.random(), 1)) for c in range(3) for i in range(8) if rng.random() < 0.8]
    found = labels.exclusive_top_n(spark.createDataFrame(rows, "country int, label string, score double"), 2)
    assert {(r.country, r.label) for r in found.collect()} == greedy(rows, 2)


def test_a_bumped_label_goes_to_its_next_country(spark):
    rows = [(0, "A", 3.0), (1, "A", 2.0), (0, "B", 2.5), (1, "B", 1.0)]
    found = labels.exclusive_top_n(spark.createDataFrame(rows, "country int, label string, score double"), 1)
    assert {(r.country, r.label) for r in found.collect()} == {(0, "A"), (1, "B")}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    lowest = {}

    def top(x):
        while lowest.get(x, x) != x:
            x = lowest[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lowest.setdefault(a, a), lowest.setdefault(b, b)
            p, q = top(a), top(b)
            lowest[max(p, q)] = min(p, q)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: top(x) for x in lowest}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_kmeans_assigns_to_the_nearest_centre(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.1, 0.8]), (5, [0.0, 0.0])], "article_id long, vector array<double>")
    found, centres = cluster.kmeans_cosine(rows, 2)
    assert {r.article_id: r.country for r in found.collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}
    assert len(centres) == 2


def test_cosine_of_a_zero_vector(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(cosine_distance("a", "b").alias("d")).first()
    assert row.d == 1.0


def test_rand_index(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "article_id long, country long")
    same = a.withColumn("country", (F.col("country") + 1) % 3)
    assert metrics.adjusted_rand(a, same).first()[0] == pytest.approx(1.0)
    assert metrics.adjusted_mutual_information(a, same).first()[0] == pytest.approx(1.0)
    other = spark.createDataFrame([(i, i // 10) for i in range(30)], "article_id long, country long")
    assert metrics.adjusted_rand(a, other).first()[0] == pytest.approx(metrics.adjusted_rand(other, a).first()[0])


def test_range_pairs_cross_cells(spark):
    points = [(i, x, 0.0) for i, x in enumerate((0.0, 0.9, 1.1, -0.5, 5.0))]
    found = metrics.range_pairs(spark.createDataFrame(points, "id long, x double, y double"), 1.0)
    assert {(r.u, r.v) for r in found.collect()} == {(0, 1), (1, 2), (0, 3)}


def test_outlines_close_and_have_holes(spark):
    ring = [(x, y, 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    cells = spatial.regions(spark.createDataFrame([*ring, (1, 1, 2), (7, 7, 1)], "cx long, cy long, country int"))
    rows = spatial.outlines(spatial.borders(cells, 1.0)).collect()
    assert sorted((r.country, r.hole) for r in rows) == [(1, False), (1, False), (1, True), (2, False)]
    assert all(r.points[0] == r.points[-1] for r in rows)


def test_elevation_rises_inland(spark):
    land = spark.createDataFrame([(x, y, 0) for x in range(5) for y in range(5)], "cx long, cy long, country int")
    heights = {(r.cx, r.cy): round(r.height, 6) for r in spatial.elevation(land).collect()}
    assert heights[0, 0] == 0.1 and heights[2, 2] == 0.3 and len(heights) == 25


def test_workers(spark):
    rows = [(w, i % 2 == 0, flag(i)) for w, flag in ((1, lambda i: i % 2 == 0), (2, lambda i: True), (3, lambda i: False)) for i in range(4)]
    found = crowd.valid_workers(spark.createDataFrame(rows, "worker int, is_check boolean, flagged boolean"))
    assert [r.worker for r in found.collect()] == [1]


def test_group_parts(spark):
    row = spark.createDataFrame([("my_map_c3_g12",)], "g string").select(crowd.group_parts(F.col("g")).alias("p")).first()
    assert (row.p.name, row.p.cluster, row.p["group"]) == ("my_map", 3, 12)


def test_label_matches_compare_words(spark):
    chosen = spark.createDataFrame([(0, "tea green"), (0, "abc")], "country int, label string")
    truth = spark.createDataFrame([(0, "Green tea")], "country int, label string")
    rows = {r.label: (r.exact, r.subset) for r in crowd.label_matches(chosen, truth).collect()}
    assert rows == {"tea green": (False, True), "abc": (False, False)}


def test_vector_files_have_heads_of_their_own(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\ntea 1 2\nmilk 1 x\nlong 1 2 3\nwater 0.5 -1\n")
    (tmp_path / "w.txt").write_text("2 1\n7 8\nrum 9\n")
    (tmp_path / "x.txt").write_text("gin 1 2\n")
    rows = {r.title: (r.vector, r.as_head) for r in tables.read_vectors(spark, str(tmp_path)).collect()}
    assert rows == {"tea": ([1.0, 2.0], True), "water": ([0.5, -1.0], True), "long": ([1.0, 2.0, 3.0], False), "7": ([8.0], True), "rum": ([9.0], True), "gin": ([1.0, 2.0], None)}
    assert "long" not in {r.title for r in tables.read_vectors(spark, str(tmp_path), keep_other_lengths=False).collect()}


def test_titles_meet_vectors_by_their_names(spark):
    vectors = spark.createDataFrame([("green_tea", [1.0])], "title string, vector array<double>")
    concepts = spark.createDataFrame([(1, "green tea"), (2, "rum")], "article_id long, article_name string")
    found, missed = tables.missing_titles(vectors, concepts)
    assert [r.article_id for r in found.collect()] == [1] and [r.article_id for r in missed.collect()] == [2]


@pytest.mark.parametrize("long_first", [True, False])
def test_metric_log_keeps_the_last_of_all_files(spark, tmp_path, long_first):
    filler = "".join(f'{{"other{i}": {i}}}\n' for i in range(50))
    (tmp_path / "a-old.json").write_text((filler if long_first else "") + '{"a": 1}\n{"b": 2}\n{"a": 3}\n')
    (tmp_path / "b-new.json").write_text(("" if long_first else filler) + '{"a": 4}\n')
    found = {r.metric: r.value for r in tables.read_metric_log(spark, str(tmp_path)).collect()}
    assert (found["a"], found["b"]) == ("4", "2")


def test_parameters_are_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_parameters(spark, path, {"k": 8, "name": "food"})
    assert {r.metric: r.value for r in tables.read_metric_log(spark, path).collect()} == {"k": "8", "name": "food"}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", name\nof two lines'), (2, None)], tables.ARTICLE)
    tables.write_csv(rows, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), tables.ARTICLE, quoted_breaks=True).collect() == rows.collect()


def test_experiment_ids(spark):
    assert tables.next_experiment_id(spark.createDataFrame([(3,), (9,)], "experiment_id int")) == 10
    assert tables.next_experiment_id(spark.createDataFrame([], "experiment_id int")) == 1


def test_tables_side_by_side(spark):
    one = spark.createDataFrame([("g", "b"), ("g", "a")], "group string, item string")
    two = spark.createDataFrame([("g", "c"), ("h", "d")], "group string, item string")
    rows = {(r.group, r.n): (r["item"], r["item_1"]) for r in tables.padded_side_by_side([one, two], "item").collect()}
    assert rows == {("g", 1): ("a", "c"), ("g", 2): ("b", None), ("h", 1): (None, "d")}


def test_members_are_padded(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "g int, v string")
    assert {r.g: r["values"] for r in labels.members(rows, "g", "v", 3).collect()} == {1: ["a", "b", ""], 2: ["", "", ""]}


def test_dense_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(i * i % 997, f"v{i % 300}") for i in range(3000)] + [(10**15, "far"), (5, None)], "at long, v string")
    first = {}
    for r in sorted(rows.collect(), key=lambda r: (r["at"], r.v or "")):
        if r.v is not None:
            first.setdefault(r.v, len(first))
    assert {r.v: r.label_id for r in labels.dense_ids(rows, "v", "at").collect()} == first


def test_labels_of_one_stem_exclude_each_other(spark):
    rows = [(0, "teas", 3.0), (0, "tea", 2.5), (1, "tea", 2.8), (0, "rum", 2.0), (1, "cake", 1.0), (1, "rums", 0.5)]
    found = labels.exclusive_top_n(spark.createDataFrame(rows, "country int, label string, score double"), 2, distinct_stems=True)
    assert {(r.country, r.label) for r in found.collect()} == {(0, "teas"), (0, "rum"), (1, "cake")}


def test_sinks(spark):
    cells = spark.createDataFrame([(0, 0, "red")], "cx int, cy int, colour string")
    titles = spark.createDataFrame([(1.0, 2.0, "a<b", 10)], "x double, y double, text string, points int")
    assert "a&lt;b" in tables.svg(cells, titles, 2.0)
    with pytest.raises(ValueError):
        tables.svg(cells, titles, 2.0, most=0)
    metrics = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "metric string, value double")
    assert "<td>m</td>" in tables.html_report("r", metrics)
    with pytest.raises(ValueError):
        tables.html_report("r", metrics, most=1)


def test_geojson_puts_holes_into_their_outline(spark):
    ring = [(x, y, 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    cells = spatial.regions(spark.createDataFrame([*ring, (7, 7, 1)], "cx long, cy long, country int"))
    polygons = spatial.multipolygons(spatial.outlines(spatial.borders(cells, 1.0)))
    feature = tables.geojson(polygons, spark.createDataFrame([(1, "one")], "country int, label string")).first().feature
    coordinates = json.loads(feature)["geometry"]["coordinates"]
    assert sorted(len(p) for p in coordinates) == [1, 2]
    document = json.loads(tables.feature_collection(tables.geojson(polygons, spark.createDataFrame([(1, "one")], "country int, label string"))))
    assert document["features"][0]["properties"] == {"clusterID": 1, "label": "one"}


def test_map_document_with_relevance(spark):
    one = lambda value, name: spark.createDataFrame([(1, value)], f"article_id long, {name}")
    layout = spark.createDataFrame([(1, 0.12345, -2.0)], "article_id long, x double, y double")
    made = tables.map_document(one("tea", "article_name string"), one(10.0, "popularity double"), one(3, "country int"), layout, one(0.5, "distance double")).first().document
    assert made == '{"Article":"tea","Popularity":10.000,"Country":3,"x":0.123,"y":-2.000,"relevance":0.500}'


def test_popularity_stream(spark, sf, tmp_path):
    from mapweave.streaming.popularity import windowed_popularity

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_popularity(stream).writeStream.outputMode("complete").format("memory").queryName("popular").start()
    query.processAllAvailable()
    query.stop()
    streamed = spark.sql("select sum(popularity) from popular").first()[0]
    assert math.isclose(streamed, windowed_popularity(events).agg(F.sum("popularity")).first()[0], rel_tol=1e-9)


def test_lda_query_passes_over_all_documents(spark, sf, monkeypatch):
    """The query's fit draws 20 times the documents, over words that only the document frequencies bound."""
    from mapweave.operators import topics
    from mapweave.plans.catalogue import QUERIES

    class Stop(Exception):
        pass

    fits = []

    class Recorded(topics.LDA):
        def fit(self, counts):
            fits.append((self.getMaxIter() * self.getSubsamplingRate(), self.getOptimizer()))
            raise Stop

    monkeypatch.setattr(topics, "LDA", Recorded)
    with pytest.raises(Stop):
        QUERIES["lda_topics"](spark, sf)
    assert fits == [(20.0, "online")]


def test_lda_vocabulary(spark):
    from mapweave.operators import topics

    docs = spark.createDataFrame([(i, ["all", "all", "even" if i % 2 == 0 else "odd", *(["rare"] if i < 4 else []), *(["some"] if i < 5 else [])]) for i in range(13)], "doc_id long, words array<string>")
    assert topics.vocabulary(docs) == ["even", "odd", "some"]
    assert topics.vocabulary(docs, most=1) == ["even"]


def test_label_svd_is_that_of_the_real_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    dense = np.where(rng.random((40, 600)) < 0.05, rng.random((40, 600)) + 0.5, 0.0)
    rows = [(int(i), f"l{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    found = {r.article_id: r.factors for r in cluster.label_svd(spark.createDataFrame(rows, "article_id long, label string, weight double"), 4).collect()}
    left = np.linalg.svd(dense, full_matrices=False)[0][:, :4]
    mine = np.array([found[i] for i in range(40)])
    assert np.allclose(np.abs((left * mine).sum(axis=0)), 1, atol=1e-6)
    assert np.allclose(mine.T @ mine, np.eye(4), atol=1e-6)


def test_label_svd_of_small_matrices(spark):
    empty = spark.createDataFrame([], "article_id long, label string, weight double")
    assert cluster.label_svd(empty, 3).count() == 0
    one = spark.createDataFrame([(1, "a", 3.0), (2, "a", 4.0)], "article_id long, label string, weight double")
    assert {r.article_id: [round(x, 9) for x in r.factors] for r in cluster.label_svd(one, 3).collect()} == {1: [0.6], 2: [0.8]}


def _unit(a):
    import numpy as np

    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def _joint_by_hand(v, xy, m, k, mode, wanted, near):
    """The variants of the joint clustering as a loop over whole matrices."""
    import numpy as np

    def means(a, g, old):
        return np.array([a[g == c].sum(axis=0) / ((g == c).sum() + 1e-6) if (g == c).any() else old[c] for c in range(k)])

    c, group = v[:k], None
    for _ in range(500):
        group = (1 - _unit(v) @ _unit(c).T).argmin(axis=1)
        c, old = means(v, group, c), c
        if np.abs(c - old).sum(axis=1).max() < 5e-5:
            break
    plane_weight = 0.0 if mode == "neighbours" else 0.05
    share = np.array([[(group[near[i]] == c).mean() for c in range(k)] for i in range(len(v))])
    c, flat = v[:k], xy[:k]
    while True:
        plane = np.linalg.norm(xy[:, None] - flat[None], axis=2) / ((xy.max() - xy.min()) * 2**0.5)
        loss = (1 - _unit(v) @ _unit(c).T) * (0.92 - plane_weight) + plane * plane_weight
        if mode == "two stages":
            first = loss.argmin(axis=1)
            tops = np.array([m[first == j].mean(axis=0) if (first == j).any() else np.zeros(m.shape[1]) for j in range(k)])
            loss = loss - (1 - _unit(m) @ _unit(tops).T) * 0.08
        elif mode == "neighbours":
            loss = loss + (1 - share) * 0.08
        else:
            loss = loss - np.array([[m[i][wanted[c]].sum() for c in range(k)] for i in range(len(v))]) * 0.08
        group = loss.argmin(axis=1)
        c, old, flat = means(v, group, c), c, means(xy, group, flat)
        if np.abs(c - old).sum(axis=1).max() < 5e-5:
            return group.tolist()


@pytest.mark.parametrize("mode", ["candidates", "neighbours", "two stages"])
def test_joint_variants_equal_the_plain_loop(spark, mode):
    import numpy as np

    rng = np.random.default_rng(21)
    n, k = 40, 3
    v, xy = rng.random((n, 4)), rng.random((n, 2))
    m = (rng.random((n, 12)) < 0.3) * rng.random((n, 12))
    m[:, 0] += 0.1
    wanted = [[0, 1, 2], [3, 4], [5, 6, 7]]
    near = [np.argsort(np.linalg.norm(xy - xy[i], axis=1))[1:6] for i in range(n)]
    rows = spark.createDataFrame([(i, v[i].tolist(), *xy[i].tolist()) for i in range(n)], "article_id long, vector array<double>, x double, y double")
    weights = spark.createDataFrame([(int(i), f"l{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "article_id long, label string, weight double")
    more = {
        "candidates": {"candidates": spark.createDataFrame([(c, f"l{j}") for c, js in enumerate(wanted) for j in js], "country int, label string")},
        "neighbours": {"neighbours": nearest_in_plane(rows.withColumnRenamed("article_id", "id"), 5), "plane_weight": 0.0, "label_sign": 1},
        "two stages": {"two_stages": True},
    }[mode]
    found = {r.article_id: r.country for r in cluster.joint_kmeans(rows, weights, k, **more).collect()}
    assert found == dict(enumerate(_joint_by_hand(v, xy, m, k, mode, wanted, near)))


def test_nearest_in_plane_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(100, 2)) * 1e-3 + 5, np.repeat(rng.normal(size=(4, 2)), 20, axis=0), [[1e6, 1e6]]])
    ids = np.arange(len(points)) * 7 % 1009
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(ids, points, strict=True)]
    df = spark.createDataFrame([*rows, (5000, None, 1.0), (5001, float("nan"), 0.0)], "id long, x double, y double")
    found = {}
    for r in nearest_in_plane(df, 6).collect():
        found.setdefault(r.id, {})[r.place] = r.other
    for i, x, y in rows:
        d = np.sqrt((points[:, 0] - x) ** 2 + (points[:, 1] - y) ** 2)
        d[ids == i] = np.inf
        assert [found[i][p] for p in range(1, 7)] == ids[np.lexsort((ids, d))[:6]].tolist()
    assert nearest_in_plane(df.limit(0), 3).count() == 0
    three = df.filter("id < 1000").limit(3)
    assert nearest_in_plane(three, 7).count() == 6
    asked = spark.createDataFrame([(1, 4.0, 4.0), (2, -3.0, 1.0)], "id long, x double, y double")
    for r in nearest_in_plane(df, 1, asked).collect():
        at = {1: (4.0, 4.0), 2: (-3.0, 1.0)}[r.id]
        assert r.distance == pytest.approx(np.linalg.norm(points - at, axis=1).min())


def test_elevation_is_not_bounded(spark):
    land = spark.range(121).select(F.col("id").alias("cx")).crossJoin(spark.range(121).select(F.col("id").alias("cy"))).withColumn("country", F.lit(0))
    top = spatial.elevation(land).agg(F.max("height"), F.count("*")).first()
    assert (round(top[0], 6), top[1]) == (6.1, 121 * 121)


def test_water_surrounds_the_land(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0), (4.0, 3.0, 1)], "x double, y double, country int")
    box = spatial.bounding_box(points, 8.0)
    cells = {(r.cx, r.cy): r.country for r in spatial.voronoi_cells(spatial.with_water(points, box, 9), 1.0, box).collect()}
    assert len(cells) == 21 * 20 and cells[0, 0] == 0 and cells[4, 3] == 1
    assert all(cells[x, y] == 9 for x, y in ((-8, -8), (12, 11), (-8, 5)))
    many = spark.createDataFrame([(float(i), 0.0, 0) for i in range(500)], "x double, y double, country int")
    drawn = spatial.random_water(many, spatial.bounding_box(many)).collect()
    assert len(drawn) == 100 and all(-30 <= r.x <= 529 and -30 <= r.y <= 30 for r in drawn)
    assert 150 < sum(r.x for r in drawn) / 100 < 350


def test_noise_splits_edges_alike_from_both_sides(spark):
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 0.0), (2, 1, 1.0, 0.0, 0.0, 0.0)], "region long, country int, x1 double, y1 double, x2 double, y2 double")
    rows = spatial.noisy(edges, 0.3, rounds=3).collect()
    one = [(r.x1, r.y1, r.x2, r.y2) for r in rows if r.region == 1]
    two = [(r.x2, r.y2, r.x1, r.y1) for r in rows if r.region == 2]
    assert len(one) == 8 and sorted(one) == sorted(two)
    assert len({p for x1, y1, x2, y2 in one for p in ((x1, y1), (x2, y2))}) == 9


def test_points_run_clockwise(spark):
    points = spark.createDataFrame([(0, 1.0, 0.0), (0, 0.0, 1.0), (0, -1.0, 0.0), (0, 0.0, -1.0)], "g int, x double, y double").withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0)})
    ring = [(p.x, p.y) for p in spatial.clockwise(points, "g", "cx", "cy").first().points]
    assert ring == [(-1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, -1.0)]


def test_text_helpers(spark):
    from mapweave.functions import text as T

    def one(value, f):
        return spark.createDataFrame([(value,)], "t string").select(f("t").alias("v")).first().v

    assert one("One. Two! three?\n\nFour", T.sentences) == ["One.", "Two!", "three?", "Four"]
    assert one("See www.a.org, the 3,000 cats (and a dog).", T.word_tokens) == ["see", "cats", "dog"]
    assert one("[1, 2]", T.list_cell) == [1, 2]
    assert one("green tea of China", T.two_words_a_line) == "green tea\nof China"
    assert one("Café CAN'T wait!", lambda c: T.without_accents(T.expanded(c))) == "cafe cannot wait"
    assert one("== Head ==\nx {\\math} y (gone) word", T.cleaned) == "word"
    assert one("a  b\t c", T.display_name) == "a_b_c"


def test_topics_are_kept(spark, tmp_path):
    from mapweave.operators import topics

    docs = spark.createDataFrame([(i, ["tea", "milk"] if i % 2 else ["rock", "sand"]) for i in range(12)], "doc_id long, words array<string>")
    model, counts, known = topics.fit_topics(docs, k=2, iterations=5)
    topics.save_topics(model, str(tmp_path / "model"))
    again = topics.load_topics(str(tmp_path / "model"))
    assert again.k if hasattr(again, "k") else True
    assert (again.topicsMatrix().toArray() == model.topicsMatrix().toArray()).all()
    mixed, words = topics.lda(docs, k=2, iterations=5)
    assert topics.topic_of_document(mixed).count() == 12
    best = topics.lda_mixture(mixed, words, 1)
    assert {r.word for r in best.collect()} <= set(known)


def test_best_regression_by_folds(spark):
    from mapweave.operators import topics

    rows = spark.createDataFrame([(float(i % 17), float(i % 5), 2.0 * (i % 17) - (i % 5)) for i in range(120)], "a double, b double, y double")
    kind, model, assembler, errors = topics.best_regression(rows, ["a", "b"], "y", kinds=("linear", "tree"), folds=3)
    assert kind == "linear" and errors["linear"] < 1e-6 < errors["tree"]
    assert topics.predict(model, assembler, rows).count() == 120


def test_phrases_of_three_words(spark):
    from mapweave.operators import topics

    noise = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, ["new", "york", "times", noise[i], noise[i + 1]]) for i in range(39)], "doc_id long, w array<string>")
    twice = topics.with_phrases(topics.with_phrases(docs, 30, 0.1), 10, 0.1)
    assert twice.filter("doc_id = 0").first().w[0] == "new_york_times"


def test_expanded_categories(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "article_id long, category string")
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "category string, parent string")
    found = {(r.article_id, r.category, r.level) for r in labels.expanded_categories(own, parents, 2).collect()}
    assert found == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "b", 0), (2, "c", 1), (2, "a", 2), (2, "c", 0), (2, "a", 1), (2, "b", 2)}


def test_label_cleaning(spark):
    rows = spark.createDataFrame([("none",), ("a stub of",), ("tea",), (None,)], "label string")
    assert [r.label for r in crowd.clean_labels(rows, ["none"], ["stub"]).collect()] == ["tea"]


def test_synonyms_stand_for_words(spark):
    chosen, truth = (spark.createDataFrame([(0, x)], "country int, label string") for x in ("hot chai", "hot tea"))
    synonyms = spark.createDataFrame([("tea", "chai")], "word string, synonym string")
    assert not crowd.label_matches(chosen, truth).first().subset
    assert crowd.label_matches(chosen, truth, synonyms).first().subset


def test_hierarchy_score_by_scaled_values(spark):
    rows = spark.createDataFrame([(0, "a", 1.0, 2, 4, 1, 100), (0, "b", 3.0, 1, 4, 1, 100)], "country int, label string, tfidf double, clc long, ncl long, lcp long, n_labels long")
    found = {r.label: (r.scaled, r.score) for r in labels.hierarchy_score(rows, by_normalised=True).collect()}
    assert found["a"] == (0.0, 0.0) and found["b"] == (1.0, pytest.approx(0.25 * math.log(100 / 6)))


@pytest.mark.parametrize(("label", "flat_part", "sign"), [(0.08, 0.05, -1), (0.2, 0.05, 1), (0.08, 0.0, -1), (0.0, 0.05, -1)])
def test_joint_kmeans_equals_the_plain_loop(spark, label, flat_part, sign):
    import numpy as np

    rng = np.random.default_rng(8)
    n, k = 60, 3
    v, xy = rng.random((n, 4)), rng.random((n, 2))
    m = (rng.random((n, 12)) < 0.3) * rng.random((n, 12))
    m[:, 0] += 0.1
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)

    def means(a, g, old):
        return np.array([a[g == c].sum(axis=0) / ((g == c).sum() + 1e-6) if (g == c).any() else old[c] for c in range(k)])

    c = v[:k]
    for _ in range(500):
        group = (1 - unit(v) @ unit(c).T).argmin(axis=1)
        c, old = means(v, group, c), c
        if np.abs(c - old).sum(axis=1).max() < 5e-5:
            break
    c, flat, steps = v[:k], xy[:k], 0
    while True:
        steps += 1
        sums = np.array([m[group == j].sum(axis=0) for j in range(k)])
        plane = np.linalg.norm(xy[:, None] - flat[None], axis=2) / ((xy.max() - xy.min()) * 2**0.5)
        group = ((1 - unit(v) @ unit(c).T) * (1 - flat_part - label) + plane * flat_part + sign * (1 - unit(m) @ unit(sums).T) * label).argmin(axis=1)
        c, old, flat = means(v, group, c), c, means(xy, group, flat)
        if np.abs(c - old).sum(axis=1).max() < 5e-5:
            break
    rows = spark.createDataFrame([(i, v[i].tolist(), *xy[i].tolist()) for i in range(n)], "article_id long, vector array<double>, x double, y double")
    labels = spark.createDataFrame([(int(i), f"l{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "article_id long, label string, weight double")
    assert steps > 1
    assert {r.article_id: r.country for r in cluster.joint_kmeans(rows, labels, k, label, flat_part, sign).collect()} == dict(enumerate(group.tolist()))
    with pytest.raises(RuntimeError):
        cluster.joint_kmeans(rows, labels, k, max_iterations=1)


def test_neighbour_layout_keeps_groups_together(spark):
    import numpy as np

    from mapweave.operators import layout

    assert layout.curve(1.0, 0.1) == (pytest.approx(1.577, abs=2e-3), pytest.approx(0.895, abs=2e-3))
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(12)[i % 12] + rng.normal(size=12) * 0.15).tolist(), i % 12) for i in range(120)]
    v = spark.createDataFrame(rows, "article_id long, vector array<double>, country int")

    def share(xy):
        placed = xy.join(v, "article_id").withColumnRenamed("article_id", "id")
        return metrics.neighbour_homogeneity(placed, 3).agg(F.avg("share")).first()[0]

    assert share(layout.neighbour_layout(v, k=8)) > 0.9 > 0.6 > share(cluster.pca_layout(v))
