"""Topics whose number the fit finds."""

import random

import numpy as np
import pytest

from mapweave.operators import hdp


def themes(g, n_themes, n_docs):
    rows = []
    for d in range(n_docs):
        own = g.sample(range(n_themes), g.choice([1, 2]))
        rows.append((d, [f"common{g.randrange(20)}" if g.random() < 0.15 else f"t{g.choice(own)}w{min(int(g.expovariate(1 / 6)), 24)}" for _ in range(60)], own))
    return rows


def test_the_planted_number_of_themes_is_found(spark):
    rows = themes(random.Random(11), 4, 200)
    docs = spark.createDataFrame([(d, w) for d, w, _ in rows] + [(900, []), (901, None), (902, ["unseen"])], "doc_id long, words array<string>")
    mixed, topics = hdp.hdp(docs, most_topics=20)
    found = {}
    for r in topics.collect():
        found.setdefault(r.topic, []).append(r)
    assert sorted(found) == [0, 1, 2, 3]
    theme_of = {}
    for t, words in found.items():
        weight = [sum(r.prob for r in words if r.word.startswith(f"t{i}w")) for i in range(4)]
        theme_of[t] = int(np.argmax(weight))
        assert max(weight) > 0.7 and sum(r.prob for r in words) <= 1 + 1e-9
    assert sorted(theme_of.values()) == [0, 1, 2, 3]
    shares = [found[t][0].share for t in range(4)]
    assert shares == sorted(shares, reverse=True) and sum(shares) > 0.95
    own = {d: set(o) for d, _, o in rows}
    right = [theme_of[r.topic] in own[r.doc_id] for r in mixed.collect() if r.prob > 0.2]
    assert np.mean(right) > 0.95 and {r.doc_id for r in mixed.collect()} == set(own)


def test_too_few_topics_or_passes_are_an_error(spark):
    docs = spark.createDataFrame([(d, w) for d, w, _ in themes(random.Random(5), 4, 60)], "doc_id long, words array<string>")
    with pytest.raises(RuntimeError, match="allow more"):
        hdp.hdp(docs, most_topics=2)
    with pytest.raises(RuntimeError, match="passes"):
        hdp.hdp(docs, most_topics=8, max_passes=1, tolerance=1e-9)


def test_no_words_have_no_topics(spark):
    mixed, topics = hdp.hdp(spark.createDataFrame([(1, []), (2, None)], "doc_id long, words array<string>"))
    assert mixed.count() == topics.count() == 0


def test_digamma_and_sticks():
    x = np.array([0.01, 0.5, 1.0, 3.7, 25.0])
    # Fixed values of the function.
    assert np.allclose(hdp._digamma(x), [-100.5608854578687, -1.9635100260214235, -0.5772156649015329, 1.167267071061226, 3.1987425128235453], rtol=1e-7, atol=1e-3)
    assert np.allclose(np.exp(hdp._log_sticks(np.array([1e6, 1e6]), np.array([1e6, 3e6]))), [0.5, 0.125, 0.375], rtol=1e-4)
    assert hdp._above(np.array([1.0, 2.0, 4.0])).tolist() == [6.0, 4.0]


def test_a_batch_is_dealt_out_over_all_cores_and_words_are_not_shuffled(spark, monkeypatch):
    kept = {}
    keep = hdp.materialize

    def seen(df, name, *more, **named):
        kept[name] = keep(df, name, *more, **named)
        if name == "bags":
            kept["plan"] = df._jdf.queryExecution().executedPlan().toString()
            kept["files"] = {}
            for f in kept[name].inputFiles():
                batch = f.split("batch=")[1].split("/")[0]
                kept["files"][batch] = kept["files"].get(batch, 0) + 1
            kept["rows"] = [(r.doc_id, r.ids, r.counts) for r in kept[name].collect()]
        return kept[name]

    monkeypatch.setattr(hdp, "materialize", seen)
    rows = themes(random.Random(11), 4, 200)
    docs = spark.createDataFrame([(d, w) for d, w, _ in rows] + [(900, []), (901, None), (902, ["unseen", None])], "doc_id long, words array<string>")
    hdp.hdp(docs, most_topics=20)
    assert min(kept["files"].values()) >= spark.sparkContext.defaultParallelism / 2
    assert "Join" not in kept["plan"] and "HashAggregate" not in kept["plan"]
    known = hdp.vocabulary(docs)
    assert {d for d, _, _ in kept["rows"]} == {d for d, _, _ in rows}
    for d, ids, counts in kept["rows"]:
        words = [w for w in rows[d][1] if w in known]
        assert ids == sorted({known.index(w) for w in words}) and counts == [float(words.count(known[i])) for i in ids]
