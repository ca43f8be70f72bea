"""Near duplicates and substrings against brute force."""

import hashlib
from itertools import combinations

import numpy as np
import pytest

from mapweave.llm import embedding, minhash, substring

from .helpers import WORD, components, copies, noise, rng, shingles


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, component_id long, kept string")


def near_by_force(texts, n, percent=80):
    sets = {i: shingles(t, n) for i, t in texts}
    links = []
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    return sets, components(sets, links)


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(spark, size):
    r = rng(size)
    texts = ["", None, "one", "One", "one two", " \t\n", "a b c d e", "a b c d e f", "b c d e a", "x " * 5000]
    for length, n, edits in ((12, 12, 2), (60, 40, 8), (150, 60, 24), (400, 25, 40)):
        texts += copies(r, noise(r, length), n, edits)
    shared = noise(r, 40)
    texts += [f"{shared} {noise(r, 40, 10**6)}" for _ in range(30)]  # a passage that unrelated texts share
    texts += [noise(r, r.randrange(3, 7), 6) for _ in range(60)]  # tiny sets
    texts += ["same text again and again"] * 20
    rows = list(enumerate(texts))
    sets, expected = near_by_force(rows, size)
    found = minhash.near_duplicates(documents(spark, [(i, t, 9, "z") for i, t in rows]), shingle_words=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), expected[i], expected[i] == i) for i, _ in rows}


def test_minhash_of_a_template(spark):
    """Texts that fill in one template are far from each other and from any hub, but for a few pairs."""
    r = rng(12)
    template = noise(r, 300)
    texts = [f"{template} {noise(r, 100, 10**6)}" for _ in range(60)]
    texts += [t.rsplit(" ", 12)[0] for t in texts[:5]]
    rows = list(enumerate(texts))
    sets, expected = near_by_force(rows, 2)
    assert len(set(expected.values())) == 60
    found = minhash.near_duplicates(documents(spark, [(i, t, 9, "z") for i, t in rows]), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_minhash_odd_rows(spark):
    rows = [(1, "a b c d e f g", 0, ""), (1, "q r s t u v w", 0, ""), (2, "q r s t u v w", 0, ""), (None, "a b c d e f g", 0, ""), (3, None, 0, "")]
    found = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert found == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_minhash_bounds():
    assert minhash.run_length(96, 80) == 3
    assert minhash.least_runs(96, 1, 80) >= 50
    assert minhash.small_sets(96, 3, 80)[4][0] == [2, 3]


def embeddings_by_force(rows, least):
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a, b in combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, components(n, links)


@pytest.mark.parametrize("block", [32, 4096])
def test_embedding_equals_brute_force(spark, block):
    r = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        centre = r.normal(size=24)
        rows += [(centre + r.normal(size=24) * s).tolist() for s in r.uniform(0.02, 0.5, 30)]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[0]], [0.0] * 24, None, [], [1.0] * 3, [1.0] * 3, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23]
    rows = list(enumerate(rows))
    n, expected = embeddings_by_force(rows, 0.95)
    df = spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<double>, n_links int, unit double")
    found = embedding.near_duplicates(df, 0.95, block_rows=block).collect()
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in found} == {i: (n[i], expected[i], expected[i] == i) for i in n}


def test_embedding_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<double>")
    assert sorted((str(x.vec_id), x.n_links, x.kept) for x in embedding.near_duplicates(df).collect()) == [("1", 0, True), ("None", 0, True)]
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def repeats_by_force(rows, window):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_equals_brute_force(spark):
    r = rng(1)
    passages = [noise(r, n, 10**6) for n in (12, 13, 14, 30, 60)]
    texts = ["", None, "é ü " * 300, "the " * 40, "the " * 13, "the " * 12, "x" * 100_000]
    for _ in range(60):
        parts = [noise(r, r.randrange(30), 10**6)] + [r.choice(passages) + " " + noise(r, r.randrange(20), 10**6) for _ in range(r.randrange(3))]
        texts.append(" \n".join(parts))
    texts += texts[10:14]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, places binary")
    found = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(df).collect()}
    assert found == repeats_by_force(rows, 13)


def test_substring_same_seed_other_words(spark):
    """A phrase that many texts hold is their common seed; only windows with equal words are repeats."""
    r = rng(7)
    phrase = "all rights reserved by us"
    texts = [f"{noise(r, 12, 10**6)} {phrase} {noise(r, 12, 10**6)}" for _ in range(200)]
    left, right = noise(r, 8, 10**6), noise(r, 8, 10**6)
    texts += [f"{left} {phrase} {noise(r, 9, 10**6)}", f"{noise(r, 9, 10**6)} {phrase} {right}", f"{left} {phrase} {right}", f"{left} {phrase} {right[:-1]}"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(df).collect()}
    assert found == repeats_by_force(rows, 13)
    assert found[202][1] == 21 and found[203][1] == 20 and not any(found[i][1] for i in range(202))


def test_substring_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, same), (1, same), (None, same), (2, same)], "doc_id long, text string")
    found = sorted((str(x.doc_id), x.n_removed) for x in substring.remove_repeats(df, with_text=True).collect())
    assert found == [("1", 0), ("1", 0), ("2", 20), ("None", 0)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_components_joined_further(spark):
    seen = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (7, 2), (9, 4), (4, 4)], "node long, component long")
    more = spark.createDataFrame([(7, 5), (9, 30), (30, 31), (40, 41)], "a long, b long")
    found = sorted((r.node, r.component) for r in minhash._joined_further(seen, more).collect())
    assert found == [(1, 1), (2, 1), (4, 4), (5, 1), (7, 1), (9, 4), (30, 4), (31, 4), (40, 40), (41, 40)]
    assert sorted((r.node, r.component) for r in minhash._joined_further(seen, more.limit(0)).collect()) == sorted((r.node, r.component) for r in seen.collect())
